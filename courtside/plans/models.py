"""Models by Spark ML: leave-one-season-out predictions, calibration, importance, reduction and blending.

Loops run over seasons, features or steps, each of which is a Spark job over the whole table; only coefficients, small
matrices and metrics come to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.importance import covariances
from courtside.operators.qualification import Design, fit_logits
from courtside.operators.selection import grams
from courtside.plans.registry import query
from courtside.shared import materialize
from courtside.sources import domain as D

FEATURES = ["pred_a", "pred_b", "pred_c", "prob"]


def _data(spark, sf_dir) -> DataFrame:
    return materialize(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(D.oof(spark, sf_dir)).withColumn("label", F.col("label").cast("double")), "oof")


def _seasons(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("season").distinct().collect())


@query()
def l1_l2_season_oof(spark, sf_dir):
    """Out-of-fold scores of a ridge regression, each season predicted by the others; metrics by season."""
    df = _data(spark, sf_dir)
    parts = []
    for season in _seasons(df):
        train = df.where(F.col("season") != season)
        if train.count() < 150:
            continue
        model = LinearRegression(labelCol="y_true", regParam=0.1, elasticNetParam=0.0).fit(train)
        parts.append(model.transform(df.where(F.col("season") == season)).select("game_id", "line", "season", "y_true", "prediction"))
    out = reduce(DataFrame.unionByName, parts)
    e = F.col("prediction") - F.col("y_true")
    return out.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


@query()
def l8_isotonic_calibration(spark, sf_dir):
    """Calibrated probabilities by isotonic regression, compared with raw ones by tenths."""
    df = D.oof(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    model = IsotonicRegression(featuresCol="prob", labelCol="label").fit(df)
    scored = model.transform(df).withColumn("tenth", F.floor(F.col("prob") * 10))
    return scored.groupBy("tenth").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 4).alias("raw"), F.round(F.avg("prediction"), 4).alias("calibrated"), F.round(F.avg("label"), 4).alias("actual"))


@query()
def m6_m20_forest_importance(spark, sf_dir):
    """Mean decrease in impurity of a forest of one-feature splits."""
    df = _data(spark, sf_dir)
    model = RandomForestClassifier(numTrees=20, maxDepth=4, impurity="entropy", featureSubsetStrategy="1", minWeightFractionPerNode=0.02, seed=3).fit(df)
    return spark.createDataFrame([(n, round(float(v), 5)) for n, v in zip(FEATURES, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


@query()
def m7_permutation_importance(spark, sf_dir):
    """Loss of log-likelihood when a feature's values are dealt anew among the rows of a season.

    Values are dealt by a join of two orders of a season's rows; a window over (season, bucket of the id) keeps groups small.
    """
    from pyspark.sql import Window

    rows = D.oof(spark, sf_dir).select("season", "game_id", "line", "y_true", F.col("label").cast("double").alias("label"), *FEATURES)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label"))
    w = Window.partitionBy("season", "bucket")
    df = rows.withColumn("bucket", F.pmod(F.xxhash64("game_id"), F.lit(32)))
    numbered = df.withColumns({"i": F.row_number().over(w.orderBy("game_id", "line", "y_true")), "j": F.row_number().over(w.orderBy(F.xxhash64("game_id", "line", F.lit(3)), "y_true"))})
    numbered = materialize(numbered.select("season", "bucket", "i", "j", "label", *FEATURES), "numbered")
    # one join deals all features: each is then moved alone
    other = numbered.select("season", "bucket", F.col("j").alias("i"), *[F.col(n).alias(f"dealt_{n}") for n in FEATURES])
    both = numbered.drop("j").join(other, ["season", "bucket", "i"])
    weights = dict(zip(FEATURES, model.coefficients.toArray().tolist(), strict=True))

    def loss(moved: str | None):
        z = sum((F.col(f"dealt_{n}" if n == moved else n) * w for n, w in weights.items()), F.lit(0.0)) + float(model.intercept)
        p = F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(1e-15)), F.lit(1 - 1e-15))
        return F.avg(-(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p)))

    losses = both.agg(loss(None).alias("base"), *[loss(n).alias(n) for n in FEATURES])
    return losses.unpivot(["base"], FEATURES, "feature", "loss").select("feature", F.round(F.col("loss") - F.col("base"), 6).alias("importance"))


@query()
def m3_m17_principal_components(spark, sf_dir):
    """Variance that each principal component of the standardised features explains."""
    df = _data(spark, sf_dir)
    fitted = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=len(FEATURES), inputCol="scaled", outputCol="pc")]).fit(df)
    shares = fitted.stages[1].explainedVariance.toArray()
    return spark.createDataFrame([(k + 1, round(float(s), 5)) for k, s in enumerate(shares)], "component int, share double")


@query()
def l6_blend_weights(spark, sf_dir):
    """Weights on the simplex that lessen the blend's squared error, by exponentiated gradient.

    The error is quadratic in the weights, so one aggregation of cross products gives every gradient.
    """
    from math import exp

    names = ["pred_a", "pred_b", "pred_c"]
    cells = [F.avg(F.col(a) * F.col(b)) for a in names for b in names] + [F.avg(F.col(a) * F.col("y_true")) for a in names]
    row = D.oof(spark, sf_dir).agg(*cells).first()
    n = len(names)
    cross, side = [row[i * n : (i + 1) * n] for i in range(n)], row[n * n :]
    weights = [1 / n] * n
    for _ in range(500):
        gradient = [2 * (sum(cross[i][j] * weights[j] for j in range(n)) - side[i]) for i in range(n)]
        low = min(gradient)
        moved = [w * exp(-0.5 * (g - low)) for w, g in zip(weights, gradient, strict=True)]
        weights = [m / sum(moved) for m in moved]
    return spark.createDataFrame([(m, round(w, 5)) for m, w in zip(names, weights, strict=True)], "model string, weight double")


def _seasons(df: DataFrame) -> list[int]:
    return sorted(r["season"] for r in df.select("season").distinct().collect())


@query()
def l7_stacking(spark, sf_dir):
    """A meta-learner over out-of-fold columns, fitted without the season that it scores, against their mean."""
    df = _data(spark, sf_dir)
    regression = LinearRegression(labelCol="y_true", featuresCol="features", regParam=0.01)
    scored = reduce(DataFrame.unionByName, [regression.fit(df.where(F.col("season") != s)).transform(df.where(F.col("season") == s)) for s in _seasons(df)])
    flat = (F.col("pred_a") + F.col("pred_b") + F.col("pred_c")) / 3
    return scored.groupBy("season").agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y_true"))), 5).alias("stacked"), F.round(F.avg(F.abs(flat - F.col("y_true"))), 5).alias("flat"))


@query()
def m8_single_feature_scores(spark, sf_dir):
    """Accuracy of each feature alone, each season scored by a model of the others, against that of the commoner class."""
    rows = materialize(D.oof(spark, sf_dir).select("season", F.col("label").cast("double").alias("label"), *FEATURES), "oof-features")
    models = _models_without_a_season(rows)
    season = F.col("season")

    def hit(name: str):
        predicted = F.lit(None).cast("double")
        for s, (intercept, slope) in models[name].items():
            predicted = F.when(season == s, (intercept + slope * F.col(name) > 0).cast("double")).otherwise(predicted)
        return F.avg((predicted == F.col("label")).cast("int"))

    scores = rows.agg(F.avg("label").alias("ones"), *[hit(n).alias(n) for n in FEATURES])
    null_score = F.round(F.greatest("ones", 1 - F.col("ones")), 5).alias("null_score")
    return scores.unpivot(["ones"], FEATURES, "feature", "accuracy").select("feature", F.round("accuracy", 5).alias("accuracy"), null_score)


def _models_without_a_season(rows: DataFrame) -> dict[str, dict[int, tuple[float, float]]]:
    """feature -> season -> (intercept, slope) of a logistic model of that feature alone on all other seasons.

    All models are fitted together (``fit_logits``), a reading of the table for each round; one that has no maximum
    (classes apart, one class only) is fitted by Spark ML alone.
    """
    sums = grams(rows, FEATURES, "season")
    total, designs = sum(sums.values()), {}
    for s in sums:
        rest = total - sums[s]
        cov = covariances(rest)
        for k, name in enumerate(FEATURES, 1):
            designs[name, s] = Design(f"{name}\n{s}", (name,), (float(rest[0, k] / rest[0, 0]),), (math.sqrt(max(cov[k, k], 0.0)) or 1.0,), s)
    fits = fit_logits(rows, "label", "season", list(designs.values()))
    found: dict[str, dict[int, tuple[float, float]]] = {n: {} for n in FEATURES}
    for (name, s), d in designs.items():
        fit = fits[d.name]
        if fit.converged:
            slope = fit.coefficients[1] / d.deviations[0]
            found[name][s] = (fit.coefficients[0] - slope * d.means[0], slope)
        else:
            one = VectorAssembler(inputCols=[name], outputCol="one").transform(rows.where(F.col("season") != s))
            model = LogisticRegression(featuresCol="one", maxIter=10).fit(one)
            found[name][s] = (float(model.intercept), float(model.coefficients[0]))
    return found
