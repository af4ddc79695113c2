"""Whether features suit a logistic model: inflation of variance, linear log-odds, coefficients stable over seasons.

All logistic models of a step are fitted together by Newton's method: tasks fold their rows, batch by batch, into one
gradient and one matrix of second derivatives for each model, and these are summed by model. A round reads the table once,
however many models there are, and what leaves a task has the size of the models. Rows are packed once, as bytes of whole
columns for each batch, as a round would else spend more time on handing rows to Python than on its sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.importance import covariances
from courtside.operators.selection import grams
from courtside.shared import materialize


def variance_inflation(cov: np.ndarray) -> np.ndarray:
    """The diagonal of the inverse correlation matrix; infinite for columns that depend on others exactly."""
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    if (sd == 0).any():
        raise ValueError("a column does not vary")
    corr = cov / np.outer(sd, sd)
    try:
        found = np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        return np.full(len(cov), math.inf)
    return np.where((found < 1 - 1e-9) | (found > 1e12), math.inf, found)


def thin_out(cov: np.ndarray, names: list[str], most: float = 5.0) -> tuple[list[str], dict[str, float]]:
    """(features kept, their inflation): the worst goes as long as one has ``most`` or more; of equals the first in ``names``.

    Features that do not vary go first.
    """
    left = [k for k in range(len(names)) if cov[k, k] > 1e-14]
    while len(left) > 1:
        found = variance_inflation(cov[np.ix_(left, left)])
        if found.max() < most:
            return [names[k] for k in left], {names[k]: float(v) for k, v in zip(left, found, strict=True)}
        left.pop(int(np.argmax(found)))
    return [names[k] for k in left], {names[k]: 1.0 for k in left}


@dataclass(frozen=True)
class Design:
    """A logistic model of ``columns``, each less its mean and by its deviation, on all seasons but ``without``."""

    name: str
    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    without: object = None


@dataclass(frozen=True)
class Fit:
    coefficients: tuple[float, ...]
    errors: tuple[float, ...]
    rounds: int
    converged: bool


def _sums(x: list[np.ndarray], y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The gradient and the second derivatives of a model of standardised columns x, by dot products."""
    eta = np.full(len(y), beta[0])
    for b, v in zip(beta[1:], x, strict=True):
        eta += b * v
    p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    off, w = y - p, p * (1 - p)
    k = len(x) + 1
    out = np.empty(k + k * k)
    second = out[k:].reshape(k, k)
    out[0], second[0, 0] = off.sum(), w.sum()
    for i, v in enumerate(x, 1):
        weighed = w * v
        out[i] = off @ v
        second[i, 0] = second[0, i] = weighed.sum()
        for j in range(1, i + 1):
            second[i, j] = second[j, i] = weighed @ x[j - 1]
    return out


@dataclass(frozen=True)
class Packed:
    """Rows with label and season as one record for each batch, a column's values as bytes, so that rounds do not convert them again."""

    rows: DataFrame
    columns: tuple[str, ...]
    seasons: tuple


def packed(df: DataFrame, label: str, season: str, columns: list[str], seasons: list) -> Packed:
    """``seasons`` are those that models leave out. Nulls in ``columns`` become NaN."""
    number = F.lit(-1)
    for k, s in enumerate(seasons):
        number = F.when(F.col("__season") == F.lit(s), k).otherwise(number)
    narrow = df.select(F.col(season).alias("__season"), F.col(label).cast("double").alias("__label"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=["__season", "__label"])
    narrow = narrow.select(number.cast("int").alias("season"), "__label", *columns)
    names = ["season", *[f"c{k}" for k in range(len(columns) + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                first, *rest = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (first.astype(np.int32), *[v.astype(np.float64) for v in rest])], names)

    rows = narrow.mapInArrow(run, ", ".join(f"{n} binary" for n in names))
    return Packed(materialize(rows, "packed-rows"), tuple(columns), tuple(seasons))


def fit_logits(df: DataFrame | Packed, label: str, season: str, designs: list[Design], rounds: int = 25, tolerance: float = 1e-9, start: dict[str, np.ndarray] | None = None) -> dict[str, Fit]:
    """Maximum likelihood by name of design; rows with a null in a model's columns, the label or the season are left out of it.

    Models whose matrix becomes singular (separated classes, dependent columns, no rows) do not converge. A round fits
    only models that still move. ``start`` has the coefficients that models begin at, zeros where it has none. Several
    calls can share rows that were ``packed`` before.
    """
    if not isinstance(df, Packed):
        df = packed(df, label, season, sorted({c for d in designs for c in d.columns}), list(dict.fromkeys(d.without for d in designs if d.without is not None)))
    columns, left_out = df.columns, df.seasons
    beta = {d.name: np.zeros(len(d.columns) + 1) if start is None or d.name not in start else np.array(start[d.name], float) for d in designs}
    done: dict[str, Fit] = {}
    active = list(designs)

    for turn in range(1, rounds + 1):
        if not active:
            break
        todo, at = list(active), {d.name: beta[d.name].copy() for d in active}
        used = [c for c in columns if any(c in d.columns for d in todo)]

        def sums(batches: Iterator[pa.RecordBatch], todo: list[Design] = todo, at: dict[str, np.ndarray] = at, used: list[str] = used) -> Iterator[pa.RecordBatch]:
            totals: dict[str, np.ndarray] = {}
            of_fold: dict[object, list[Design]] = {}
            for d in todo:
                of_fold.setdefault(d.without, []).append(d)
            for packs in batches:
                for k in range(packs.num_rows):
                    seasons = np.frombuffer(packs.column(0)[k].as_buffer(), np.int32)
                    y, *rest = [np.frombuffer(c[k].as_buffer(), np.float64) for c in packs.columns[1:]]
                    every = dict(zip(used, rest, strict=True))
                    holes = {c for c, v in every.items() if np.isnan(v).any()}
                    for without, some in of_fold.items():  # the rows of a fold are cut out once for all its models
                        stay = slice(None) if without is None else seasons != left_out.index(without)
                        values, t = {c: every[c][stay] for c in {c for d in some for c in d.columns}}, y[stay]
                        for d in some:
                            x, own = [values[c] for c in d.columns], t
                            if not holes.isdisjoint(d.columns):
                                good = ~np.isnan(x).any(axis=0)
                                x, own = [v[good] for v in x], t[good]
                            x = [(v - m) / s for v, m, s in zip(x, d.means, d.deviations, strict=True)]
                            totals[d.name] = totals.get(d.name, 0.0) + _sums(x, own, at[d.name])
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], ["model", "sums"])

        size = max((len(d.columns) + 1) * (len(d.columns) + 2) for d in todo)
        partial = df.rows.select("season", "c0", *[f"c{columns.index(c) + 1}" for c in used]).mapInArrow(sums, "model string, sums array<double>")
        cells = F.array(*[F.sum(F.coalesce(F.get("sums", F.lit(k)), F.lit(0.0))) for k in range(size)])
        totals = {r["model"]: np.array(r["sums"]) for r in partial.groupBy("model").agg(cells.alias("sums")).collect()}
        active = []
        for d in todo:
            k = len(d.columns) + 1
            found = totals.get(d.name, np.zeros(size))
            gradient, second = found[:k], found[k : k + k * k].reshape(k, k)
            if not np.isfinite(second).all() or np.linalg.matrix_rank(second, tol=1e-8 * max(np.abs(second).max(), 1e-300)) < k:
                done[d.name] = Fit(tuple(beta[d.name].tolist()), (math.nan,) * k, turn, False)
                continue
            inverse = np.linalg.inv(second)
            step = inverse @ gradient
            beta[d.name] += step
            errors = tuple(np.sqrt(np.maximum(np.diag(inverse), 0)).tolist())
            if np.abs(step).max() < tolerance:
                done[d.name] = Fit(tuple(beta[d.name].tolist()), errors, turn, True)
            else:
                done[d.name] = Fit(tuple(beta[d.name].tolist()), errors, turn, False)
                active.append(d)
    return done


def wald_p(coefficient: float, error: float) -> float:
    """The two-sided chance of a normal variable as far from zero."""
    return math.erfc(abs(coefficient / error) / math.sqrt(2)) if error > 0 else math.nan


def bent_designs(df: DataFrame, features: list[str], label: str, season: str) -> tuple[DataFrame, list[Design]]:
    """df with x ln x of each feature as ``<feature>__bent``, and models of both, standardised; features without values have none.

    x is first shifted to be positive by its least value.
    """
    x = {f: F.col(f).cast("double") for f in features}
    known = df.where(F.col(label).isNotNull() & F.col(season).isNotNull())
    least = known.agg(*[F.min(v).alias(f) for f, v in x.items()]).first()
    usable = [f for f in features if least[f] is not None]
    shifted = {f: x[f] - least[f] + 1e-6 for f in usable}
    wide = known.select(label, season, *[x[f].alias(f) for f in usable], *[(s * F.ln(s)).alias(f"{f}__bent") for f, s in shifted.items()])
    names = [n for f in usable for n in (f, f"{f}__bent")]
    if not names:
        return wide, []
    row = wide.agg(*[g(n) for n in names for g in (F.avg, F.stddev_pop)]).first()
    mean, sd = dict(zip(names, row[0::2], strict=True)), dict(zip(names, row[1::2], strict=True))
    return wide, [Design(f, (f, f"{f}__bent"), (mean[f], mean[f"{f}__bent"]), (sd[f] or 1.0, sd[f"{f}__bent"] or 1.0)) for f in usable]


def log_odds_linearity(df: DataFrame | Packed, features: list[str], label: str, season: str, designs: list[Design] | None = None) -> dict[str, tuple[float | None, float | None]]:
    """feature -> (coefficient, p) of x ln x beside x in a logistic model, both standardised (Box-Tidwell).

    None where the model does not converge. Packed rows hold the columns of the ``bent_designs`` given with them.
    """
    if designs is None:
        df, designs = bent_designs(df, features, label, season)
    fits = fit_logits(df, label, season, designs) if designs else {}
    return {f: (fits[f].coefficients[2], wald_p(fits[f].coefficients[2], fits[f].errors[2])) if f in fits and fits[f].converged else (None, None) for f in features}


def coefficient_stability(df: DataFrame | Packed, features: list[str], label: str, season: str, sums: dict[object, np.ndarray], least: int = 150) -> dict[str, list[float]]:
    """feature -> its coefficient in a logistic model of it alone, for each season left out, in the order of seasons.

    ``sums`` are ``grams`` of the features: each fold standardises by its own rows. Folds of fewer than ``least`` rows, and
    models that do not converge, are left out. Folds begin at the coefficients of all seasons, from which they move little.
    """
    total, designs = sum(sums.values()), []
    for s in sorted(sums, key=str):
        rest = total - sums[s]
        if rest[0, 0] < least:
            continue
        cov = covariances(rest)
        for k, f in enumerate(features, 1):
            designs.append(Design(f"{f}\n{s}", (f,), (rest[0, k] / rest[0, 0],), (math.sqrt(max(cov[k, k], 0.0)) + 1e-10,), s))
    spread = np.sqrt(np.maximum(np.diag(covariances(total)), 0.0)) + 1e-10 if designs else np.ones(1)
    whole = {f: Design(f, (f,), (total[0, k] / total[0, 0],), (float(spread[k]),)) for k, f in enumerate(features, 1)}
    every = fit_logits(df, label, season, list(whole.values())) if designs else {}
    start = {}
    for d in designs:
        of = whole[d.columns[0]]
        if every[of.name].converged:
            b0, b1 = every[of.name].coefficients
            slope = b1 / of.deviations[0]
            start[d.name] = np.array([b0 + slope * (d.means[0] - of.means[0]), slope * d.deviations[0]])
    fits = fit_logits(df, label, season, designs, start=start) if designs else {}
    out: dict[str, list[float]] = {f: [] for f in features}
    for d in designs:
        if fits[d.name].converged:
            out[d.columns[0]].append(fits[d.name].coefficients[1])
    return out


@dataclass(frozen=True)
class Limits:
    inflation: float = 5.0
    linearity: float = 0.05
    signs: float = 0.8
    variation: float = 1.0
    folds: int = 3
    rows: int = 100


def qualify(df: DataFrame, features: list[str], label: str, season: str, limits: Limits = Limits()) -> DataFrame:
    """One row for each feature: the three tests and whether it passes all.

    Features that inflate variances go first, one by one; the others are tested one by one. Rows with a null in a feature,
    the label or the season are left out of all tests; with fewer than ``limits.rows`` rows nothing qualifies.
    """
    full = df.dropna(subset=[*features, label, season])
    sums = grams(full, features, season)
    schema = "feature string, vif double, passes_vif boolean, bent double, linearity_p double, passes_linearity boolean, sign_consistency double, variation double, mean double, folds int, passes_stability boolean, qualifies boolean"
    n = sum(m[0, 0] for m in sums.values())
    if n < limits.rows:
        return df.sparkSession.createDataFrame([(f, None, False, None, None, False, None, None, None, 0, False, False) for f in features], schema)
    kept, inflation = thin_out(covariances(sum(sums.values()))[1:, 1:], features, limits.inflation)
    at = [0, *[features.index(f) + 1 for f in kept]]
    wide, designs = bent_designs(full, kept, label, season)
    rows = packed(wide, label, season, sorted({c for d in designs for c in d.columns}), list(sums))
    bent = log_odds_linearity(rows, kept, label, season, designs)
    stable = coefficient_stability(rows, kept, label, season, {s: m[np.ix_(at, at)] for s, m in sums.items()})
    rows = []
    for f in features:
        if f not in inflation:
            rows.append((f, None, False, None, None, False, None, None, None, 0, False, False))
            continue
        b, p = bent[f]
        linear = p is not None and p >= limits.linearity
        c = np.array(stable[f])
        if len(c) < limits.folds:
            signs = variation = mean = None
            steady = False
        else:
            mean = float(c.mean())
            signs = float((c > 0).mean() if mean > 0 else (c < 0).mean())
            variation = float(c.std() / (abs(mean) + 1e-10))
            steady = signs >= limits.signs and variation < limits.variation
        rows.append((f, inflation[f], True, b, p, linear, signs, variation, mean, len(c), steady, linear and steady))
    return df.sparkSession.createDataFrame(rows, schema)
