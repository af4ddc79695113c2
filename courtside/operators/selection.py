"""Selecting features and models from sums of products, clustering features, and fitting residuals by sums over rows.

A table is read once for each set of sums, never once for each step, model or feature (the t fit reads one column once
for each iteration). What comes to the driver has the size of the number of columns squared, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grams(df: DataFrame, columns: list[str], group: str) -> dict[object, np.ndarray]:
    """By group, the sums of products of each pair of columns, of a constant 1 before them too; rows with nulls are left out."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    rows = df.dropna(subset=[*columns, group]).groupBy(group).agg(F.array(*[F.sum(names[i] * names[j]) for i, j in pairs]).alias("sums")).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, r["sums"], strict=True):
            m[i, j] = m[j, i] = v
        out[r[group]] = m
    return out


@dataclass
class Moments:
    """Of each pair of columns over the rows that have both: count, mean and squared deviations of the first, and codeviations."""

    n: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(values: np.ndarray, known: np.ndarray) -> Moments:
        """values: a column for each variable; what is not ``known`` counts for none of its pairs."""
        m = known.astype(float)
        shift = np.where(known, values, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
        shift[~np.isfinite(shift)] = 0.0
        z = np.where(known, values - shift, 0.0)
        n, s = m.T @ m, z.T @ m
        at_least = np.maximum(n, 1)
        return Moments(n, s / at_least + np.where(n > 0, shift[:, None], 0.0), (z * z).T @ m - s * s / at_least, z.T @ z - s * s.T / at_least)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        moved, weight = other.mean - self.mean, self.n * share
        return Moments(n, self.mean + moved * share, self.squares + other.squares + moved * moved * weight, self.products + other.products + moved * moved.T * weight)

    def corr(self, i: int, j: int) -> float | None:
        """None where one of the two does not vary."""
        spread = self.squares[i, j] * self.squares[j, i]
        return None if self.n[i, j] < 2 or spread <= 0 else float(self.products[i, j] / math.sqrt(spread))


def moments(df: DataFrame, columns: list[str], group: str) -> dict[object, Moments]:
    """By group, the moments of all pairs of columns from one reading; a pair takes the rows that have both.

    Tasks fold their rows, batch by batch, into one set of matrices for each group, which are then merged by group.
    """
    p, kind = len(columns), df.schema[group].dataType
    parts = ("n", "mean", "squares", "products")
    narrow = df.select(F.col(group).alias("group"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    schema = f"group {kind.simpleString()}, " + ", ".join(f"{x} array<double>" for x in parts)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[object, Moments] = {}
        of_group = pa.null()
        for b in batches:
            if not b.num_rows:
                continue
            of_group = b.column(0).type
            keys = b.column(0).dictionary_encode("encode")
            code = keys.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(keys.dictionary)))
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(float)[order]
            known = np.column_stack([np.ones(b.num_rows, bool) if not c.null_count else c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns[1:]])[order]
            for g, start, end in zip(keys.dictionary.to_pylist(), [0, *ends[:-1]], ends, strict=True):
                new = Moments.of(values[start:end], known[start:end])
                found[g] = found[g] + new if g in found else new
        if found:
            flat = [pa.array([getattr(m, x).ravel().tolist() for m in found.values()], pa.list_(pa.float64())) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), of_group), *flat], ["group", *parts])

    def matrices(row) -> Moments:
        return Moments(*[np.array(row[x]).reshape(p, p) for x in parts])

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for row in table.to_pylist():
            total = matrices(row) if total is None else total + matrices(row)
        return pa.table({"group": table.column("group").slice(0, 1), **{x: pa.array([getattr(total, x).ravel().tolist()], pa.list_(pa.float64())) for x in parts}})

    rows = narrow.mapInArrow(fold, schema).groupBy("group").applyInArrow(merge, schema).collect()
    return {r["group"]: matrices(r) for r in rows}


def held_out_rmse(by_group: dict[object, np.ndarray], use: list[int], target: int, ridge: float = 1e-8) -> float:
    """Root mean squared error of least squares on the columns ``use`` (0 is the constant), each group predicted by the others."""
    total, squares, n = sum(by_group.values()), 0.0, 0.0
    at = [0, *use]
    for m in by_group.values():
        rest = total - m
        b = np.linalg.solve(rest[np.ix_(at, at)] + ridge * np.eye(len(at)), rest[at, target])
        squares += m[target, target] - 2 * b @ m[at, target] + b @ m[np.ix_(at, at)] @ b
        n += m[0, 0]
    return math.sqrt(max(squares, 0.0) / n)


def forward_selection(by_group: dict[object, np.ndarray], names: list[str], accepted: list[str], candidates: list[str], target: str, gain: float, patience: int) -> list[tuple[int, str, float, bool]]:
    """(step, candidate, error with it, kept): candidates in their order, kept if the error falls by more than ``gain``.

    It ends after ``patience`` candidates in a row that were not kept. Step 0 is the accepted features alone.
    """
    at = {c: k + 1 for k, c in enumerate(names)}
    kept = [at[a] for a in accepted]
    best, misses = held_out_rmse(by_group, kept, at[target]), 0
    log = [(0, "", best, True)]
    for step, c in enumerate(candidates, 1):
        score = held_out_rmse(by_group, [*kept, at[c]], at[target])
        good = best - score > gain
        log.append((step, c, score, good))
        if good:
            kept.append(at[c])
            best, misses = score, 0
        else:
            misses += 1
            if misses >= patience:
                break
    return log


def diverse_models(df: DataFrame, models: list[str], target: str, most: int = 30, max_corr: float = 0.98, max_ratio: float = 1.15) -> list[tuple[int, str, float, float | None]]:
    """(place, model, mean absolute error, largest correlation with those before): the best model, then ever the most different.

    Models with an error above ``max_ratio`` times the best are left out, as are those that correlate by ``max_corr`` or
    more with a chosen one; a model gains by a low correlation and loses a tenth of its relative excess of error. One
    aggregation over the rows that have all values tells errors and correlations.
    """
    full = df.dropna(subset=[*models, target])
    errors = [F.avg(F.abs(F.col(m) - F.col(target))) for m in models]
    pairs = [(i, j) for i in range(len(models)) for j in range(i)]
    row = full.agg(*errors, *[F.corr(models[i], models[j]) for i, j in pairs]).first()
    error = dict(zip(models, row[: len(models)], strict=True))
    if error[models[0]] is None:
        return []
    corr = {frozenset((models[i], models[j])): v for (i, j), v in zip(pairs, row[len(models) :], strict=True)}
    first = min(models, key=lambda m: (error[m], m))
    left = [m for m in models if m != first and error[m] <= max_ratio * error[first]]
    chosen: list[tuple[int, str, float, float | None]] = [(1, first, error[first], None)]
    while left and len(chosen) < most:
        near = {m: max(corr[frozenset((m, c[1]))] for c in chosen) for m in left}
        open_ = [m for m in left if near[m] < max_corr]
        if not open_:
            break
        best = max(open_, key=lambda m: ((1 - near[m]) - 0.1 * (error[m] - error[first]) / error[first], m))
        chosen.append((len(chosen) + 1, best, error[best], near[best]))
        left.remove(best)
    return chosen


def student_fit(residuals: DataFrame, value: str, stages: int = 5, rounds: int = 40, points: int = 9) -> tuple[float, float, float]:
    """(degrees of freedom, scale, log-likelihood) of a Student t around zero, by maximum likelihood.

    For ``points`` degrees of freedom at once the scales follow by expectation-maximisation: with the weights that the
    present scale gives, the next one is a mean, and a round is one aggregation for all of them. The likelihoods tell
    between which two the best lies, where the next stage puts its points. Degrees end at 1,000, as good as normal.
    """
    r2 = F.col(value) * F.col(value)
    n, mean = residuals.agg(F.count(value), F.avg(r2)).first()
    if not n or not mean:
        return math.nan, 0.0, math.nan
    low, high, best = math.log(0.2), math.log(1000.0), (-math.inf, math.nan, mean)
    for _ in range(stages):
        nus = [math.exp(low + (high - low) * k / (points - 1)) for k in range(points)]
        scales = [best[2]] * points
        for _ in range(rounds):
            new = list(residuals.agg(*[F.avg((nu + 1) * r2 / (nu + r2 / s)) for nu, s in zip(nus, scales, strict=True)]).first())
            moved = max(abs(a / b - 1) for a, b in zip(new, scales, strict=True))
            scales = new
            if moved < 1e-7:
                break
        logs = residuals.agg(*[F.avg(F.log1p(r2 / (nu * s))) for nu, s in zip(nus, scales, strict=True)]).first()
        told = [(n * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu * s) - (nu + 1) / 2 * x), nu, s) for nu, s, x in zip(nus, scales, logs, strict=True)]
        k = max(range(points), key=lambda i: told[i][0])
        best = max(best, told[k])
        low, high = math.log(nus[max(k - 1, 0)]), math.log(nus[min(k + 1, points - 1)])
    return best[1], math.sqrt(best[2]), best[0]


def student_above(t: Column, nu: float, terms: int = 300) -> Column:
    """The probability that a Student t variable of any (real) degrees of freedom lies above ``t``.

    The incomplete beta function as a continued fraction, from its far end to its beginning.
    """
    x = nu / (nu + t * t)
    a, b = nu / 2, 0.5
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def fraction(x: Column, a: float, b: float) -> Column:
        def step(tail: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + even / (1 + odd / tail)

        inner = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(1.0), lambda tail, m: step(tail, m.cast("double")))
        return F.exp(front + a * F.ln(x) + b * F.log1p(-x)) / a / (1 - (a + b) * x / (a + 1) / inner)

    near = 1 - fraction(1 - x, b, a)  # converges where x is large
    tail = F.when(t == 0, 1.0).when(x < (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(near) / 2
    return F.when(t >= 0, tail).otherwise(1 - tail)


def silhouettes(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each point (b - a) / max(a, b) of its mean distances to its own and the nearest other cluster; 0 if alone."""
    apart = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(axis=2), 0))
    kinds = np.unique(labels)
    means = np.stack([apart[:, labels == k].sum(axis=1) for k in kinds], axis=1)
    sizes = np.array([(labels == k).sum() for k in kinds])
    own = labels[:, None] == kinds[None]
    inside = means[own] / np.maximum(sizes[np.argmax(own, axis=1)] - 1, 1)
    other = np.where(own, np.inf, means / sizes).min(axis=1)
    return np.where(sizes[np.argmax(own, axis=1)] > 1, (other - inside) / np.maximum(np.maximum(inside, other), 1e-300), 0.0)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 100) -> np.ndarray:
    rng = np.random.default_rng([seed, k])
    centres = points[[rng.integers(len(points))]]
    while len(centres) < k:  # the next centre by its distance from the nearest
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        total = near.sum()
        centres = np.vstack([centres, points[rng.choice(len(points), p=near / total if total else None)]])
    labels = np.full(len(points), -1)
    for _ in range(rounds):
        new = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
        centres = np.stack([points[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
    return labels


def _split(spark: SparkSession, corr: np.ndarray, most: int, seeds: int) -> np.ndarray | None:
    """Labels of the best of all trials (number of clusters, seed), which run as groups of one table; None if none has two clusters."""
    p = len(corr)
    most = min(most, p - 1)
    if most < 2:
        return None
    points = np.sqrt(np.maximum((1 - np.nan_to_num(corr)) / 2, 0))
    trials = spark.range(2, most + 1).withColumnRenamed("id", "k").crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))

    def one(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        labels = k_means(points, int(key[0]), int(key[1]))
        if len(np.unique(labels)) < 2:
            return pd.DataFrame({"quality": [], "k": [], "seed": [], "labels": []})
        s = silhouettes(points, labels)
        return pd.DataFrame({"quality": [s.mean() / (s.std() + 1e-10)], "k": [key[0]], "seed": [key[1]], "labels": [labels.tolist()]})

    done = trials.groupBy("k", "seed").applyInPandas(one, "quality double, k long, seed long, labels array<int>")
    best = done.orderBy(F.desc("quality"), "k", "seed").first()
    return None if best is None else np.array(best["labels"])


def _mean_quality(corr: np.ndarray, labels: np.ndarray) -> tuple[float, dict[int, float]]:
    points = np.sqrt(np.maximum((1 - np.nan_to_num(corr)) / 2, 0))
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0, {int(k): 0.0 for k in kinds}
    s = silhouettes(points, labels)
    by = {int(k): float(s[labels == k].mean()) for k in kinds}
    return float(np.mean(list(by.values()))), by


def correlations(m: Moments | None, size: int) -> np.ndarray:
    """The first ``size`` columns' correlation matrix; 0 where one does not vary or the value is not known."""
    corr = np.eye(size)
    for i in range(size):
        for j in range(i):
            v = None if m is None else m.corr(i, j)
            corr[i, j] = corr[j, i] = 0.0 if v is None or math.isnan(v) else v
    return corr


def cluster_features(df: DataFrame, features: list[str], most: int | None = None, seeds: int = 10) -> dict[str, str]:
    """feature -> cluster (named by its first member): features cluster by the correlation distance sqrt((1 - r) / 2).

    Of all trials of k-means the one with the largest ratio of the silhouettes' mean to their deviation wins; then the
    worst clusters of four or more are split in the same way, as long as the clusters' mean silhouette rises.
    Correlations come from one reading of the table; the matrix of the features (not of the rows) goes to the trials.
    """
    found = moments(df.withColumn("__all", F.lit(0)), features, "__all") if features else {}
    return clusters_of(df.sparkSession, correlations(found.get(0), len(features)), features, most, seeds)


def clusters_of(spark: SparkSession, corr: np.ndarray, features: list[str], most: int | None = None, seeds: int = 10) -> dict[str, str]:
    """``cluster_features`` of features whose correlation matrix is known."""
    most = most or len(features) - 1
    labels = _split(spark, corr, most, seeds)
    if labels is None:
        return dict.fromkeys(features, features[0])
    quality, by = _mean_quality(corr, labels)
    improved = True
    while improved:
        improved = False
        for k in sorted(by, key=by.get):
            members = np.flatnonzero(labels == k)
            if len(members) < 4:
                continue
            inner = _split(spark, corr[np.ix_(members, members)], most, seeds)
            if inner is None:
                continue
            trial = labels.copy()
            trial[members] = labels.max() + 1 + inner
            new, new_by = _mean_quality(corr, trial)
            if new > quality:
                labels, quality, by, improved = trial, new, new_by, True
                break
    return {f: features[int(np.flatnonzero(labels == labels[i])[0])] for i, f in enumerate(features)}
