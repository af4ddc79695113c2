"""Whether features suit a logistic model of a target: inflation of variance, linearity and stability, and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.operators import qualification as Q
from courtside.operators.importance import covariances
from courtside.operators.selection import grams
from courtside.plans.importance import _DATA_SQL, NAMES, _data, _sums_sql, _swept_sql
from courtside.plans.registry import query
from courtside.shared import materialize


def _labelled(spark, sf_dir):
    return materialize(_data(spark, sf_dir).select("season", *NAMES, (F.col("y") > 1.5).cast("int").alias("label")), "labelled")


_SIZE = len(NAMES) + 1
_SUMS_SQL = f"s AS MATERIALIZED ({_sums_sql('d', ['1', *NAMES])}), every AS MATERIALIZED (SELECT 0 AS season, " + ", ".join(f"sum(g_{i}_{j}) AS g_{i}_{j}" for i in range(_SIZE) for j in range(_SIZE)) + " FROM s)"
_VIF_SQL = ", ".join(_swept_sql(f"vif_{n}_", "every", _SIZE, [0, *[j for j in range(1, _SIZE) if j != k]]) for k, n in enumerate(NAMES, 1))
_VIF_SQL += ", vif AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, (e.g_{k}_{k} - e.g_0_{k} * e.g_0_{k} / e.g_0_0) / v.g_{k}_{k} AS vif FROM every e, vif_{n}_ v" for k, n in enumerate(NAMES, 1)) + ")"


_PAIRS = [(g, n) for g in NAMES for n in NAMES if n != g]
#: Inflation of what is left when each feature is the first to go.
_NEXT_SQL = ", ".join(_swept_sql(f"next_{g}_{n}_", "every", _SIZE, [0, *[j for j, o in enumerate(NAMES, 1) if o not in (g, n)]]) for g, n in _PAIRS)
_NEXT_SQL += ", next AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{g}' AS without, '{n}' AS feature, (e.g_{k}_{k} - e.g_0_{k} * e.g_0_{k} / e.g_0_0) / v.g_{k}_{k} AS vif FROM every e, next_{g}_{n}_ v" for g, n in _PAIRS for k in [NAMES.index(n) + 1]) + ")"


@query(f"WITH {_DATA_SQL}, {_SUMS_SQL}, {_VIF_SQL} SELECT feature, round(vif, 4) AS vif FROM vif")
def m13_variance_inflation(spark, sf_dir):
    """How much each feature's variance is inflated by the others, from one aggregation."""
    sums = grams(_data(spark, sf_dir), NAMES, "season")
    found = Q.variance_inflation(covariances(sum(sums.values()))[1:, 1:])
    return spark.createDataFrame([(n, round(float(v), 4)) for n, v in zip(NAMES, found, strict=True)], "feature string, vif double")


def _newton_sql(name: str, rows: str, terms: list[str], folds: bool, rounds: int = 9) -> str:
    """CTEs of Newton's method: ``rows`` (feature, season, label and the terms); one model for each (feature, fold left out)."""
    k, size = len(terms), len(terms) + 1
    parts = [f"{name}_b0 AS (SELECT DISTINCT {'a.feature AS feature, b.season AS fold' if folds else 'a.feature AS feature, 0 AS fold'}{''.join(f', 0.0::DOUBLE AS b{i}' for i in range(k))} FROM {rows} a{f', (SELECT DISTINCT season FROM {rows}) b' if folds else ''})"]
    for r in range(1, rounds + 1):
        eta = " + ".join(f"b{i} * {t}" for i, t in enumerate(terms))
        cell = lambda i, j: "0.0::DOUBLE" if i == k else (f"sum(({terms[i]}) * (label - p))" if j == k else f"sum(({terms[i]}) * ({terms[j]}) * p * (1 - p))")
        parts.append(f"{name}_p{r} AS (SELECT x.*, fold, 1 / (1 + exp(-({eta}))) AS p FROM {rows} x JOIN {name}_b{r - 1} m ON x.feature = m.feature{' AND x.season <> m.fold' if folds else ''})")
        parts.append(f"{name}_g{r} AS MATERIALIZED (SELECT feature || '|' || fold AS season, {', '.join(f'{cell(i, j)} AS g_{i}_{j}' for i in range(size) for j in range(size))} FROM {name}_p{r} GROUP BY 1)")
        parts.append(_swept_sql(f"{name}_s{r}_", f"{name}_g{r}", size, list(range(k))))
        parts.append(f"{name}_b{r} AS MATERIALIZED (SELECT feature, fold, {', '.join(f'b{i} + g_{i}_{k} AS b{i}' for i in range(k))} FROM {name}_b{r - 1} JOIN {name}_s{r}_ ON season = feature || '|' || fold)")
    return ", ".join(parts)


_Z = "abs(b2) / se"
_T = f"(1 / (1 + 0.2316419::DOUBLE * {_Z}))"
_TAIL = f"0.3989422804014327::DOUBLE * exp(-pow({_Z}, 2) / 2) * ({_T} * (0.31938153 + {_T} * (-0.356563782 + {_T} * (1.781477937 + {_T} * (-1.821255978 + {_T} * 1.330274429)))))"
_REPORT_SQL = f"""WITH {_DATA_SQL}, {_SUMS_SQL}, {_VIF_SQL}, {_NEXT_SQL},
first_gone AS MATERIALIZED (SELECT arg_max(feature, vif) AS feature FROM vif WHERE vif >= 5),
gone AS MATERIALIZED (SELECT feature FROM first_gone UNION ALL SELECT arg_max(n.feature, vif) FROM next n JOIN first_gone f ON n.without = f.feature WHERE vif >= 5),
k AS MATERIALIZED (SELECT season, label, feature, x FROM (SELECT season, CAST(y > 1.5 AS INT) AS label, u0, u1, v2, v3, z FROM d) UNPIVOT (x FOR feature IN (u0, u1, v2, v3, z)) WHERE feature NOT IN (SELECT feature FROM gone)),
three AS (SELECT CASE WHEN 'u0' IN (SELECT feature FROM gone) THEN u1 ELSE u0 END AS a, CASE WHEN 'v2' IN (SELECT feature FROM gone) THEN v3 ELSE v2 END AS b, z AS c FROM d),
r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM three),
left_vif AS (SELECT unnest(['u', 'v', 'z']) AS kind, unnest([1 - bc * bc, 1 - ac * ac, 1 - ab * ab]) / (1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc) AS vif FROM r),
low AS (SELECT feature, min(x) AS low FROM k GROUP BY 1),
bent AS (SELECT feature, season, label, x, (x - low + 1e-6::DOUBLE) * ln(x - low + 1e-6::DOUBLE) AS t FROM k JOIN low USING (feature)),
sd AS (SELECT feature, avg(x) AS mx, stddev_pop(x) AS sx, avg(t) AS mt, stddev_pop(t) AS st FROM bent GROUP BY 1),
bt AS MATERIALIZED (SELECT feature, season, label, (x - mx) / sx AS x, (t - mt) / st AS t FROM bent JOIN sd USING (feature)),
{_newton_sql('lin', 'bt', ['1', 'x', 't'], False)},
lin AS (SELECT b.feature, b2, sqrt(1 / (s.g_2_2)) AS se FROM lin_b9 b JOIN lin_s9_1 s ON s.season = b.feature || '|0'),
fold AS (SELECT feature, o.season AS fold, avg(x) AS m, stddev_pop(x) AS s FROM k, (SELECT DISTINCT season FROM k) o WHERE k.season <> o.season GROUP BY 1, 2),
{_newton_sql('loyo', 'k', ['1', 'x'], True)},
c AS (SELECT feature, b1 * s AS b FROM loyo_b9 JOIN fold USING (feature, fold)),
st AS (SELECT feature, avg(b) AS mean, stddev_pop(b) AS sd, avg(CASE WHEN b > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS up, avg(CASE WHEN b < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS down, CAST(count(*) AS INT) AS folds FROM c GROUP BY 1),
q AS (SELECT feature, v.vif, b2, 2 * {_TAIL} AS p, CASE WHEN mean > 0 THEN up ELSE down END AS signs, sd / abs(mean) AS variation, mean, folds FROM lin JOIN st USING (feature) JOIN left_vif v ON v.kind = left(feature, 1))
SELECT feature, round(vif, 4) AS vif, true AS passes_vif, round(b2, 4) AS bent, round(p, 4) AS linearity_p, p >= 0.05 AS passes_linearity, round(signs, 4) AS sign_consistency, round(variation, 4) AS variation, round(mean, 4) AS mean, folds,
  signs >= 0.8 AND variation < 1 AS passes_stability, p >= 0.05 AND signs >= 0.8 AND variation < 1 AS qualifies FROM q
UNION ALL SELECT feature, NULL, false, NULL, NULL, false, NULL, NULL, NULL, 0, false, false FROM gone"""


@query(_REPORT_SQL)
def m14_m22_logistic_qualification(spark, sf_dir):
    """The report of the three tests: inflation, Box-Tidwell linearity, and coefficients over seasons left out."""
    got = Q.qualify(_labelled(spark, sf_dir), NAMES, "label", "season")
    return got.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])
