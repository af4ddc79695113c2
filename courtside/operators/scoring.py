"""Ensembles as rows of a table: fitted from sums, saved, loaded by a later batch and applied as column expressions.

A row holds all that scoring needs (medians, means, deviations, coefficients, weights, calibration), so that a batch never
refits anything, and its scores do not depend on what else is in the batch. The size of a row is that of the models, not
of the data; scoring is map-only and stays on the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from courtside.operators.qualification import Design, fit_logits
from courtside.operators.quantiles import exact_quantiles_of
from courtside.operators.selection import grams, held_out_rmse
from courtside.shared import materialize

ENSEMBLE = (
    "target string, task string, calibration array<struct<x: double, y: double>>, models array<struct<model: string, weight: double, scaled: boolean, "
    "intercept: double, terms: array<struct<feature: string, median: double, mean: double, std: double, coefficient: double>>>>"
)
#: A value that stands for a missing one: features are clipped there.
SENTINEL = 1e6
#: What a scaled model keeps of its weight when inputs are missing: all of it up to this share, then 1 - 3 x share, a tenth at least.
MISSING_SHARE, MISSING_SLOPE, LEAST_WEIGHT = 0.05, 3.0, 0.1
#: Models further from the median than this many median deviations are left out, if two or more stay.
OUTLIER = 3.0
#: Probabilities of single models are kept inside this range.
CLIP = (0.01, 0.99)


@dataclass(frozen=True)
class Spec:
    """One model of an ensemble: its features, whether they are scaled, and its weight (null: found by held-out seasons)."""

    name: str
    features: tuple[str, ...]
    scaled: bool = False
    weight: float | None = None


def cleaned(name: str) -> Column:
    """A feature with null for NaN, infinite values and the sentinel."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != SENTINEL) & (F.abs(x) < float("inf")), x)


def fit_ensemble(train: DataFrame, target: str, season: str, specs: list[Spec], task: str = "regression", calibrated: bool = False) -> DataFrame:
    """One row of ``ENSEMBLE``: least squares (regression) or maximum likelihood (classification, target 0 or 1) for each spec.

    Missing inputs take the training median. Regression takes one aggregation of sums of products for all models, by
    season, so that a weight left open is the inverse of the squared error on seasons held out; classification takes
    the rounds of ``fit_logits``, and open weights are equal. ``calibrated`` adds knots of an isotonic regression of the
    target on the blend, rounded to thousandths, so that there are 1,001 at most.

    Rows without a target or season are left out. A feature without any value in training is an error, as is a table
    without rows; one that doesn't vary gets the deviation 1 and, in regression, the coefficient 0 of the least-norm solution.
    """
    names = sorted({f for s in specs for f in s.features})
    rows = train.where(F.col(target).isNotNull() & F.col(season).isNotNull())
    rows = materialize(rows.select(F.col(season).alias("__season"), F.col(target).cast("double").alias("__target"), *[cleaned(n).alias(n) for n in names]), "training-rows")
    medians = {n: q[0] for n, q in exact_quantiles_of(rows, {n: F.col(f"`{n}`") for n in names}, [0.5]).items()}
    empty = [n for n in names if medians[n] is None]
    if empty:
        raise ValueError(f"no training values for {', '.join(empty)}")
    filled = rows.select("__season", "__target", *[F.coalesce(F.col(f"`{n}`"), F.lit(medians[n])).alias(n) for n in names])
    sums = grams(filled, [*names, "__target"], "__season")
    total = sum(sums.values())
    n, at = total[0, 0], {name: k + 1 for k, name in enumerate(names)}
    means = {f: float(total[0, k] / n) for f, k in at.items()}
    varied = {f: total[k, k] / n - means[f] ** 2 > 1e-12 * max(total[k, k] / n, 1e-300) for f, k in at.items()}
    stds = {f: math.sqrt((total[k, k] - n * means[f] ** 2) / max(n - 1, 1)) if varied[f] else 1.0 for f, k in at.items()}

    if task == "classification":
        designs = [Design(s.name, s.features, tuple(means[f] for f in s.features), tuple(stds[f] for f in s.features)) for s in specs]
        fits = fit_logits(filled, "__target", "__season", designs)
        solved = {s.name: np.array(fits[s.name].coefficients) for s in specs}
        weights = {s.name: 1.0 for s in specs}
    else:
        solved, weights, y = {}, {}, len(names) + 1
        for s in specs:
            use = [at[f] for f in s.features]
            shift, scale = np.array([means[f] for f in s.features]), np.array([stds[f] for f in s.features])
            cov = (total[np.ix_(use, use)] - n * np.outer(shift, shift)) / np.outer(scale, scale)
            side = (total[use, y] - shift * total[0, y]) / scale
            varying = np.array([varied[f] for f in s.features], dtype=bool)
            b = np.linalg.lstsq(np.where(np.outer(varying, varying), cov, 0.0), np.where(varying, side, 0.0), rcond=1e-12)[0]
            solved[s.name] = np.concatenate([[total[0, y] / n], b])
            weights[s.name] = 1.0 if s.weight is not None or len(sums) < 2 else 1 / max(held_out_rmse(sums, use, y) ** 2, 1e-12)

    models = []
    for s in specs:
        b = solved[s.name]
        terms, intercept = [], float(b[0])
        for f, c in zip(s.features, b[1:], strict=True):
            # an unscaled model takes its inputs as they are
            coefficient = float(c) if s.scaled else float(c) / stds[f]
            intercept -= 0.0 if s.scaled else coefficient * means[f]
            terms.append(Row(feature=f, median=float(medians[f]), mean=float(means[f]), std=float(stds[f]), coefficient=coefficient))
        models.append(Row(model=s.name, weight=float(weights[s.name] if s.weight is None else s.weight), scaled=s.scaled, intercept=intercept, terms=terms))
    spark = train.sparkSession
    bundle = Row(target=target, task=task, calibration=None, models=models)
    if calibrated:
        blend = score(filled, bundle).select(F.round("score.mean", 3).alias("blend"), "__target")
        knots = IsotonicRegression(featuresCol="blend", labelCol="__target", weightCol="n").fit(blend.groupBy("blend").agg(F.avg("__target").alias("__target"), F.count("*").cast("double").alias("n")))
        bundle = Row(target=target, task=task, calibration=[Row(x=float(x), y=float(y)) for x, y in zip(knots.boundaries.toArray(), knots.predictions.toArray(), strict=True)], models=models)
    return spark.createDataFrame([bundle], ENSEMBLE)


def load_ensembles(spark: SparkSession, path: str) -> dict[str, Row]:
    """target -> ensemble, from a table that holds a row for each; two rows of one target are an error."""
    rows = spark.read.schema(ENSEMBLE).parquet(path).collect()  # a row for each target
    found = {r["target"]: r for r in rows}
    if len(found) < len(rows):
        raise ValueError(f"two ensembles for one target in {path}")
    return found


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _interpolated(x: Column, knots: list[Row]) -> Column:
    """The line through the knots at x, level beyond both ends."""
    table = F.array(*[F.struct(F.lit(float(k["x"])).alias("x"), F.lit(float(k["y"])).alias("y")) for k in knots])
    below, above = F.element_at(F.filter(table, lambda k: k["x"] <= x), -1), F.get(F.filter(table, lambda k: k["x"] > x), F.lit(0))
    inside = F.try_divide((x - below["x"]) * (above["y"] - below["y"]), above["x"] - below["x"]) + below["y"]
    return F.when(x < knots[0]["x"], F.lit(float(knots[0]["y"]))).when(x >= knots[-1]["x"], F.lit(float(knots[-1]["y"]))).otherwise(inside)


def score(batch: DataFrame, ensemble: Row, name: str = "score") -> DataFrame:
    """batch with a struct ``name``: mean, std (of the models that count), n_models, missing (share of all inputs), low_weight.

    Inputs that are null, NaN, infinite or the sentinel are missing and take the stored median. A scaled model of which more
    than 5 % of the inputs are missing loses weight (``low_weight`` tells that one did). Of three models or more, those
    further than three median deviations from the median are left out. Probabilities are clipped for each model, and the
    blend of a calibrated ensemble goes through its knots. A batch that lacks a column is an error, one without rows
    gives none; other columns are kept, but for one called ``name``, which is replaced.
    """
    models = ensemble["models"]
    features = sorted({t["feature"] for m in models for t in m["terms"]})
    lacking = [f for f in features if f not in batch.columns]
    if lacking:
        raise ValueError(f"the batch lacks {', '.join(lacking)}")
    kept = [F.col(f"`{c}`") for c in batch.columns if c != name]
    x = lambda f: F.col("__x").getField(f"f{features.index(f)}")
    rows = batch.select(F.struct(*kept).alias("__row"), F.struct(*[cleaned(f).alias(f"f{k}") for k, f in enumerate(features)], F.lit(1).alias("one")).alias("__x"))

    def one(m: Row) -> Column:
        out, gone = F.lit(m["intercept"]), F.lit(0)
        for t in m["terms"]:
            value = F.coalesce(x(t["feature"]), F.lit(t["median"]))
            out = out + F.lit(t["coefficient"]) * ((value - t["mean"]) / t["std"] if m["scaled"] else value)
            gone = gone + x(t["feature"]).isNull().cast("int")
        if ensemble["task"] == "classification":
            out = F.least(F.greatest(1 / (1 + F.exp(-out)), F.lit(CLIP[0])), F.lit(CLIP[1]))
        share = gone / max(len(m["terms"]), 1)
        weight = F.lit(m["weight"])
        if m["scaled"]:
            weight = weight * F.when(share > MISSING_SHARE, F.greatest(F.lit(LEAST_WEIGHT), 1 - share * MISSING_SLOPE)).otherwise(1.0)
        return F.struct(out.alias("p"), weight.alias("w"), gone.alias("gone"), (weight < m["weight"]).alias("low"))

    rows = rows.select("__row", F.array(*map(one, models)).alias("__all"))
    rows = rows.withColumn("__median", _median(F.transform("__all", lambda m: m["p"])))
    rows = rows.withColumn("__mad", _median(F.transform("__all", lambda m: F.abs(m["p"] - F.col("__median")))))
    near = F.filter("__all", lambda m: F.abs(m["p"] - F.col("__median")) <= OUTLIER * F.col("__mad"))
    rows = rows.withColumn("__near", near if len(models) >= 3 else F.col("__all"))
    rows = rows.withColumn("__used", F.when((F.col("__mad") > 0) & (F.size("__near") >= 2), F.col("__near")).otherwise(F.col("__all")))
    total = lambda of: F.aggregate("__used", F.lit(0.0), lambda s, m: s + of(m))
    rows = rows.withColumn("__mean", total(lambda m: m["w"] * m["p"]) / total(lambda m: m["w"]))
    rows = rows.withColumn("__flat", total(lambda m: m["p"]) / F.size("__used"))
    mean = F.col("__mean") if not ensemble["calibration"] else _interpolated(F.col("__mean"), ensemble["calibration"])
    spread = F.sqrt(total(lambda m: (m["p"] - F.col("__flat")) * (m["p"] - F.col("__flat"))) / F.size("__used"))
    terms = sum(len(m["terms"]) for m in models)
    gone = F.aggregate("__all", F.lit(0), lambda s, m: s + m["gone"])
    got = F.struct(mean.alias("mean"), spread.alias("std"), F.size("__used").alias("n_models"), (gone / max(terms, 1)).alias("missing"), F.exists("__all", lambda m: m["low"]).alias("low_weight"))
    return rows.select("__row.*", got.alias(name))


def synthetic_total(residuals: DataFrame, first: str, second: str, first_std: str, second_std: str) -> Row:
    """From the rows that two models were judged on: cov and variance (of the sum of residuals), rho (of the models' spreads, 0 where they don't vary)."""
    total, rho = F.col(first) + F.col(second), F.corr(first_std, second_std)
    return residuals.agg(F.count("*").alias("n"), F.covar_samp(first, second).alias("cov"), F.var_samp(total).alias("variance"), F.coalesce(F.when(~F.isnan(rho), rho), F.lit(0.0)).alias("rho")).first()


def combined_std(first: Column, second: Column, rho: float) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), first * first + second * second + 2 * rho * first * second))
