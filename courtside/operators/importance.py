"""What a linear model loses when a feature, or a cluster of features, is dealt anew among the rows of a season held out.

The expected loss over all ways of dealing has a closed form in the sums of products of each season: with the residual r
and the moved part d of the prediction it is 2 cov(r, d) + 2 var(d). So nothing is shuffled, no column is joined back, and
one reading of the table (``selection.grams``) serves all features, clusters and kinds of importance. Losses are shares of
the variance of the target in the season held out (differences of R squared).

Seasons with fewer than two rows or a target that does not vary are left out. A feature that does not vary has importance
0; equal features share the coefficient (least squares of the smallest norm), and only the kinds that take one cluster's
members apart show that each of them is informative.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Grams = dict[object, np.ndarray]


def least_squares(m: np.ndarray, use: list[int], target: int) -> np.ndarray:
    """Coefficients (0 for columns outside ``use``), from sums of products; of the smallest norm if columns are dependent."""
    b = np.zeros(len(m))
    if use:
        scale = np.sqrt(np.maximum(np.diag(m)[use], 0))
        scale[scale == 0] = 1
        b[use] = np.linalg.lstsq(m[np.ix_(use, use)] / np.outer(scale, scale), m[use, target] / scale, rcond=1e-10)[0] / scale
    return b


def covariances(m: np.ndarray) -> np.ndarray:
    mean = m[0] / m[0, 0]
    return m / m[0, 0] - np.outer(mean, mean)


def _folds(sums: Grams, target: int) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(season, sums of the other seasons, covariances in the season)."""
    total = sum(sums.values())
    found = []
    for season in sorted(sums, key=str):
        m = sums[season]
        if m[0, 0] < 2 or total[0, 0] - m[0, 0] < 2:
            continue
        cov = covariances(m)
        if cov[target, target] > 1e-12 * max(m[target, target] / m[0, 0], 1e-300):
            found.append((season, total - m, cov))
    return found


def _loss(cov: np.ndarray, b: np.ndarray, moved: list[int], target: int) -> float:
    r, d = -b, np.zeros(len(b))
    r[target], d[moved] = 1.0, b[moved]
    return float(2 * (r @ cov @ d + d @ cov @ d) / cov[target, target])


def _dealt(sums: Grams, models: dict[str, tuple[list[int], list[int]]], target: int) -> list[tuple[str, object, float]]:
    """(name, season, loss) of each model: the columns it uses and those among them that are dealt anew together."""
    rows = []
    for season, rest, cov in _folds(sums, target):
        fitted: dict[tuple, np.ndarray] = {}
        for name, (use, moved) in models.items():
            key = (0, *use)
            if key not in fitted:
                fitted[key] = least_squares(rest, list(key), target)
            rows.append((name, season, _loss(cov, fitted[key], moved, target)))
    return rows


def single_scores(sums: Grams, names: list[str]) -> list[tuple[str, object, float]]:
    """R squared of each feature alone in the season held out; the constant scores about 0."""
    target, rows = len(names) + 1, []
    for season, rest, cov in _folds(sums, target):
        m = sums[season]
        for k, name in enumerate(names, 1):
            b = -least_squares(rest, [0, k], target)
            b[target] = 1.0
            rows.append((name, season, float(1 - (b @ m @ b) / m[0, 0] / cov[target, target])))
    return rows


def permuted(sums: Grams, names: list[str]) -> list[tuple[str, object, float]]:
    """Each feature dealt anew in a model of all."""
    every = list(range(1, len(names) + 1))
    return _dealt(sums, {n: (every, [k]) for k, n in enumerate(names, 1)}, len(names) + 1)


def permuted_clusters(sums: Grams, names: list[str], clusters: dict[str, str]) -> list[tuple[str, object, float]]:
    """All members of a cluster dealt anew together, their rows kept, in a model of all; by cluster."""
    every = list(range(1, len(names) + 1))
    return _dealt(sums, {c: (every, [k for k in every if clusters[names[k - 1]] == c]) for c in sorted(set(clusters.values()))}, len(names) + 1)


def desubstituted(sums: Grams, names: list[str], clusters: dict[str, str]) -> list[tuple[str, object, float]]:
    """Each feature dealt anew in a model of it and the features of other clusters, so that no relative stands in for it."""
    models = {}
    for k, n in enumerate(names, 1):
        models[n] = (sorted([k, *[j for j, o in enumerate(names, 1) if clusters[o] != clusters[n]]]), [k])
    return _dealt(sums, models, len(names) + 1)


def residualised(sums: Grams, names: list[str], clusters: dict[str, str]) -> list[tuple[str, object, float]]:
    """Each feature less what the features of other clusters tell about it (over all seasons, without a constant), then as in ``permuted``."""
    total = sum(sums.values())
    t = np.eye(len(names) + 2)
    for k, n in enumerate(names, 1):
        t[:, k] -= least_squares(total, [j for j, o in enumerate(names, 1) if clusters[o] != clusters[n]], k)
    return permuted({s: t.T @ m @ t for s, m in sums.items()}, names)


def principal(sums: Grams, names: list[str], share: float = 0.95) -> tuple[list[tuple[str, object, float]], list[tuple[str, object, float]]]:
    """(by feature, by component): components of the standardised features dealt anew, given back to features by absolute loadings.

    The first components that explain ``share`` of the variance take part.
    """
    total, p = sum(sums.values()), len(names)
    mean, sd = total[0] / total[0, 0], np.sqrt(np.maximum(np.diag(covariances(total)) * total[0, 0] / max(total[0, 0] - 1, 1), 0))
    sd[sd == 0] = 1.0
    inside = slice(1, p + 1)
    values, vectors = np.linalg.eigh(covariances(total)[inside, inside] / np.outer(sd[inside], sd[inside]))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = min(int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share)) + 1, p)
    loadings = vectors[:, :k]
    t = np.zeros((p + 2, k + 2))
    t[0, 0] = t[p + 1, k + 1] = 1.0
    t[inside, 1 : k + 1] = loadings / sd[inside, None]
    t[0, 1 : k + 1] = -(mean[inside] / sd[inside]) @ loadings
    parts = permuted({s: t.T @ m @ t for s, m in sums.items()}, [f"PC_{c}" for c in range(k)])
    by_season: dict[object, np.ndarray] = {}
    for name, season, v in parts:
        by_season.setdefault(season, np.zeros(k))[int(name[3:])] = v
    return [(n, s, float(np.abs(loadings[i]) @ v)) for s, v in by_season.items() for i, n in enumerate(names)], parts


def signed_rank_p(values: Column) -> Column:
    """The exact chance that a signed-rank sum is as large as that of the array (zeros left out, ties by mean ranks); null below four values.

    Sign patterns are counted by the sum of doubled ranks, one value after the other.
    """
    kept = F.filter(values, lambda v: v.isNotNull() & (v != 0))
    size = F.size(kept)
    rank = lambda v: (2 * F.size(F.filter(kept, lambda o: F.abs(o) < F.abs(v))) + F.size(F.filter(kept, lambda o: F.abs(o) == F.abs(v))) + 1).cast("int")
    ranks = F.transform(kept, rank)
    whole = size * (size + 1)
    start = F.transform(F.sequence(F.lit(0), whole), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(ranks, start, lambda c, r: F.transform(c, lambda x, i: x + F.coalesce(F.get(c, i - r), F.lit(0.0))))
    observed = F.aggregate(F.zip_with(kept, ranks, lambda v, r: F.when(v > 0, r).otherwise(0)), F.lit(0), lambda a, r: a + r)
    above = F.aggregate(F.slice(counts, observed + 1, F.size(counts)), F.lit(0.0), lambda a, x: a + x)
    return F.when(size >= 4, above / F.pow(F.lit(2.0), size))


def bootstrap_bounds(values: Column, draws: int = 2000, level: float = 0.95) -> Column:
    """struct(low, high): percentiles of the means of ``draws`` drawings with replacement; null for an empty array.

    Drawings come from an integer rule, so that the same values have the same bounds everywhere.
    """
    size = F.size(values)

    def drawn(b: Column, i: Column) -> Column:
        x = (b * 1009 + i * 9176 + 12345).cast("long")
        for _ in range(3):
            x = (x * x + b * 7919 + i * 104729 + 1) % F.lit(2147483647)
        return x % size

    def mean(b: Column) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(values, drawn(b, i).cast("int"))), F.lit(0.0), lambda a, v: a + v) / size

    means = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), mean))

    def at(q: float) -> Column:
        place = q * (draws - 1)
        low = int(place)
        return F.get(means, F.lit(low)) + (place - low) * (F.get(means, F.lit(min(low + 1, draws - 1))) - F.get(means, F.lit(low)))

    return F.when(size > 0, F.struct(at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high")))


def feature_tiers(raw: DataFrame, scores: tuple[str, ...] = ("sfi",), p_threshold: float = 0.1, draws: int = 2000) -> DataFrame:
    """Tiers of features from raw values (method, feature, fold, value): one row for each feature.

    A method in ``scores`` is passed if the lower bound of its mean lies above 0; another one if that holds or the signed
    ranks are significant. Below four folds a method is not passed, with no row it is not available. All passed: ACCEPTED,
    none: REJECTED, some: NEEDS SPECIFICATION. Null values are left out. ``rank`` is the mean of a feature's places by
    method (features without the method last), 1 for the best.
    """
    found = raw.where("value IS NOT NULL").groupBy("method", "feature").agg(F.array_sort(F.collect_list(F.struct("fold", "value"))).alias("v")).withColumn("v", F.col("v.value"))
    bounds, p = bootstrap_bounds(F.col("v"), draws), signed_rank_p(F.col("v"))
    told = found.select("method", "feature", "v", bounds.alias("b"), p.alias("p"))
    enough, above = F.size("v") >= 4, F.coalesce(F.col("b.low") > 0, F.lit(False))
    single = F.col("method").isin(*scores) if scores else F.lit(False)
    told = told.select("method", "feature", (enough & (above | (~single & F.coalesce(F.col("p") < p_threshold, F.lit(False))))).alias("passed"), (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"))
    names, methods = raw.select("feature").distinct(), raw.select("method").distinct()
    grid = names.crossJoin(F.broadcast(methods)).join(told, ["method", "feature"], "left")  # a report: features times methods
    better = grid.alias("a").join(grid.select("method", F.col("mean").alias("other")).alias("o"), "method")
    place = better.groupBy("method", "feature").agg((F.count_if(F.coalesce(F.col("other") > F.col("mean"), F.col("mean").isNull() & F.col("other").isNotNull())) + 1).alias("place"))
    grid = grid.join(place, ["method", "feature"])
    out = grid.groupBy("feature").agg(F.count("passed").alias("n_methods"), F.count_if("passed").alias("n_passed"), F.avg("place").alias("rank"))
    tier = F.when(F.col("n_methods") == 0, "UNKNOWN").when(F.col("n_passed") == F.col("n_methods"), "ACCEPTED").when(F.col("n_passed") == 0, "REJECTED").otherwise("NEEDS SPECIFICATION")
    return out.select("feature", "n_methods", "n_passed", tier.alias("tier"), "rank")
