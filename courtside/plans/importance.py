"""Importance of features by dealing them anew, alone and by clusters, and the tiers that follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.operators import importance as I
from courtside.operators.selection import grams
from courtside.plans.registry import query
from courtside.plans.selection import _FEATURES_SQL, featured

NAMES = ["u0", "u1", "v2", "v3", "z"]
CLUSTERS = {n: n[0] for n in NAMES}
_ALL = ["1", *NAMES, "y"]
_Y, _USED = len(NAMES) + 1, list(range(1, len(NAMES) + 1))


def _data(spark, sf_dir):
    """Two features of each of two signals and one, z, that has nothing to do with the target; their noise is not shared."""
    return featured(spark, sf_dir).withColumn("z", (F.col("w3") * 1000003) % 1.0).select("season", *NAMES, "y")


_DATA_SQL = f"{_FEATURES_SQL}, d AS (SELECT season, u0, u1, v2, v3, (w3 * 1000003::DOUBLE) % 1.0::DOUBLE AS z, y FROM f)"


def _sums_sql(source: str, columns: list[str]) -> str:
    cells = ", ".join(f"sum({a}::DOUBLE * {b}::DOUBLE) AS g_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns))
    return f"SELECT season, {cells} FROM {source} GROUP BY season"


def _rest_sql(source: str, size: int) -> str:
    cells = ", ".join(f"(SELECT sum(g_{i}_{j}) FROM {source}) - g_{i}_{j} AS g_{i}_{j}" for i in range(size) for j in range(size))
    return f"SELECT season, {cells} FROM {source}"


def _swept_sql(name: str, source: str, size: int, use: list[int]) -> str:
    """CTEs that sweep the columns ``use`` out of the matrix, one each; coefficients are then in the target's column."""
    parts, before = [], source
    for step, k in enumerate(use):
        cell = lambda i, j: f"g_{k}_{j} / g_{k}_{k}" if i == k else f"g_{i}_{j} - g_{i}_{k} * g_{k}_{j} / g_{k}_{k}"  # noqa: E731, B023
        here = f"{name}{step}" if step < len(use) - 1 else name
        parts.append(f"{here} AS MATERIALIZED (SELECT season, " + ", ".join(f"{cell(i, j)} AS g_{i}_{j}" for i in range(size) for j in range(size)) + f" FROM {before})")
        before = here
    return ", ".join(parts)


def _loss_sql(model: str, sums: str, use: list[int], moved: list[int], y: int, label: str) -> str:
    cov = lambda i, j: f"(s.g_{i}_{j} / s.g_0_0 - s.g_0_{i} / s.g_0_0 * s.g_0_{j} / s.g_0_0)"
    b = lambda j: f"m.g_{j}_{y}"
    rd = " + ".join(f"{b(j)} * ({cov(y, j)} - ({' + '.join(f'{b(k)} * {cov(k, j)}' for k in use)}))" for j in moved)
    dd = " + ".join(f"{b(j)} * {b(k)} * {cov(j, k)}" for j in moved for k in moved)
    return f"SELECT {label}, s.season AS fold, 2 * ({rd} + {dd}) / {cov(y, y)} AS value FROM {model} m JOIN {sums} s USING (season)"


def _raw_sql() -> str:
    """raw (method, feature, fold, value) by sweeps: plain, clustered, de-substituted, residualised, and single scores."""
    size = len(_ALL)
    with_ = [_DATA_SQL, f"s AS MATERIALIZED ({_sums_sql('d', _ALL)})", f"rest AS MATERIALIZED ({_rest_sql('s', size)})", _swept_sql("whole", "rest", size, [0, *_USED])]
    raw = [_loss_sql("whole", "s", _USED, [k], _Y, f"'mda' AS method, '{n}' AS feature") for k, n in enumerate(NAMES, 1)]
    for c in sorted(set(CLUSTERS.values())):
        raw.append(_loss_sql("whole", "s", _USED, [k for k, n in enumerate(NAMES, 1) if n[0] == c], _Y, f"'clustered' AS method, '{c}' AS feature"))
    resid = []
    for k, n in enumerate(NAMES, 1):
        others = [j for j, o in enumerate(NAMES, 1) if o[0] != n[0]]
        use = sorted([k, *others])
        with_ += [_swept_sql(f"desub_{n}_", "rest", size, [0, *use]), _swept_sql(f"single_{n}_", "rest", size, [0, k])]
        raw.append(_loss_sql(f"desub_{n}_", "s", use, [k], _Y, f"'desub' AS method, '{n}' AS feature"))
        a, b = f"m.g_0_{_Y}", f"m.g_{k}_{_Y}"
        error = f"(s.g_{_Y}_{_Y} - 2 * {a} * s.g_0_{_Y} - 2 * {b} * s.g_{k}_{_Y} + {a} * {a} * s.g_0_0 + 2 * {a} * {b} * s.g_0_{k} + {b} * {b} * s.g_{k}_{k}) / s.g_0_0"
        raw.append(f"SELECT 'sfi', '{n}', s.season, 1 - {error} / (s.g_{_Y}_{_Y} / s.g_0_0 - pow(s.g_0_{_Y} / s.g_0_0, 2)) FROM single_{n}_ m JOIN s USING (season)")
        with_ += [_swept_sql(f"other_{n}_", "every", size, others)]
        resid.append(f"{n} - (" + " + ".join(f"(SELECT g_{j}_{k} FROM other_{n}_) * {NAMES[j - 1]}" for j in others) + f") AS {n}")
    every = "every AS MATERIALIZED (SELECT 0 AS season, " + ", ".join(f"sum(g_{i}_{j}) AS g_{i}_{j}" for i in range(size) for j in range(size)) + " FROM s)"
    with_.insert(3, every)
    with_ += [f"e AS MATERIALIZED (SELECT season, {', '.join(resid)}, y FROM d)", f"es AS MATERIALIZED ({_sums_sql('e', _ALL)})", f"erest AS MATERIALIZED ({_rest_sql('es', size)})", _swept_sql("ewhole", "erest", size, [0, *_USED])]
    raw += [_loss_sql("ewhole", "es", _USED, [k], _Y, f"'resid' AS method, '{n}' AS feature") for k, n in enumerate(NAMES, 1)]
    return "WITH " + ", ".join(with_) + ", raw AS MATERIALIZED (" + " UNION ALL ".join(raw) + ")"


def _raw(spark, sf_dir):
    sums = grams(_data(spark, sf_dir), [*NAMES, "y"], "season")
    kinds = {
        "sfi": I.single_scores(sums, NAMES),
        "mda": I.permuted(sums, NAMES),
        "clustered": I.permuted_clusters(sums, NAMES, CLUSTERS),
        "desub": I.desubstituted(sums, NAMES, CLUSTERS),
        "resid": I.residualised(sums, NAMES, CLUSTERS),
    }
    return spark.createDataFrame([(m, f, s, v) for m, rows in kinds.items() for f, s, v in rows], "method string, feature string, fold long, value double")


@query(_raw_sql() + " SELECT method, feature, count(*) AS folds, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(*)), 6) AS std FROM raw GROUP BY 1, 2")
def m7_dealt_importance(spark, sf_dir):
    """Importance of features and clusters in seasons held out: single scores, dealt anew alone, together, de-substituted and residualised."""
    return _raw(spark, sf_dir).groupBy("method", "feature").agg(F.count("*").alias("folds"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value") / F.sqrt(F.count("*")), 6).alias("std"))


@query()
def m7_component_importance(spark, sf_dir):
    """Principal components dealt anew, given back to features by their loadings; shares of the whole."""
    by_feature, _ = I.principal(grams(_data(spark, sf_dir), [*NAMES, "y"], "season"), NAMES)
    raw = spark.createDataFrame(by_feature, "feature string, fold long, value double").groupBy("feature").agg(F.avg("value").alias("mean"))
    total = raw.agg(F.sum("mean").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("feature", F.round("mean", 6).alias("mean"), F.round(F.col("mean") / F.col("total"), 6).alias("share"))


_DRAWS = 500
_TIERS_SQL = f"""{_raw_sql()}, kept AS (SELECT * FROM raw WHERE method IN ('sfi', 'desub', 'resid')),
v AS MATERIALIZED (SELECT method, feature, list(value ORDER BY fold) AS v, count(*) AS n, avg(value) AS mean FROM kept GROUP BY 1, 2),
x0 AS (SELECT b, i, n, b * 1009 + i * 9176 + 12345 AS x FROM range(1, {_DRAWS + 1}) t(b), range(0, 64) u(i), (SELECT DISTINCT n FROM v) WHERE i < n),
x1 AS (SELECT b, i, n, (x * x + b * 7919 + i * 104729 + 1) % 2147483647 AS x FROM x0),
x2 AS (SELECT b, i, n, (x * x + b * 7919 + i * 104729 + 1) % 2147483647 AS x FROM x1),
x3 AS MATERIALIZED (SELECT b, i, n, (x * x + b * 7919 + i * 104729 + 1) % 2147483647 % n AS k FROM x2),
means AS (SELECT method, feature, b, sum(v[k + 1]) / any_value(v.n) AS m FROM v JOIN x3 USING (n) GROUP BY 1, 2, 3),
low AS (SELECT method, feature, quantile_cont(m, 0.025) AS low FROM means GROUP BY 1, 2),
r AS (SELECT method, feature, value, row_number() OVER w AS place FROM kept WHERE value <> 0 WINDOW w AS (PARTITION BY method, feature ORDER BY abs(value))),
w AS (SELECT method, feature, count(*) AS n, sum(CASE WHEN value > 0 THEN place ELSE 0 END) AS w FROM r GROUP BY 1, 2),
signs AS MATERIALIZED (SELECT n, s, sum((s >> (k - 1)::INT & 1) * k) AS total FROM (SELECT DISTINCT n FROM w) a, range(0, 1024) t(s), range(1, 11) u(k) WHERE s < 1 << n::INT AND k <= n GROUP BY 1, 2),
p AS (SELECT method, feature, avg(CASE WHEN total >= w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM w JOIN signs USING (n) GROUP BY 1, 2),
t AS (SELECT method, feature, v.n >= 4 AND (low > 0 OR (method <> 'sfi' AND coalesce(p < 0.1, false))) AS passed, rank() OVER (PARTITION BY method ORDER BY mean DESC) AS place FROM v JOIN low USING (method, feature) LEFT JOIN p USING (method, feature))
SELECT feature, count(*) AS n_methods, count(CASE WHEN passed THEN 1 END) AS n_passed,
  CASE WHEN count(CASE WHEN passed THEN 1 END) = count(*) THEN 'ACCEPTED' WHEN count(CASE WHEN passed THEN 1 END) = 0 THEN 'REJECTED' ELSE 'NEEDS SPECIFICATION' END AS tier, round(avg(place), 6) AS rank FROM t GROUP BY feature"""


@query(_TIERS_SQL)
def m10_feature_tiers(spark, sf_dir):
    """ACCEPTED, NEEDS SPECIFICATION or REJECTED, by how many of three kinds of importance a feature passes over the seasons."""
    raw = _raw(spark, sf_dir).where("method IN ('sfi', 'desub', 'resid')")
    return I.feature_tiers(raw, draws=_DRAWS).withColumn("rank", F.round("rank", 6))
