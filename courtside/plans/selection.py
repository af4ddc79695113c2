"""Features and models selected from sums of products; distributions of residuals."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import normality as N
from courtside.operators import selection as L
from courtside.operators.quantiles import cumulative_counts, exact_quantiles
from courtside.plans.registry import query
from courtside.shared import materialize
from courtside.sources import domain as D
from courtside.tables import table

#: Signals that features follow, and how many features each has.
SIGNALS = {"u": 7919, "v": 104729, "w": 15485863}
PER_SIGNAL = 4
FEATURES = [f"{s}{k}" for s in SIGNALS for k in range(PER_SIGNAL)]
_SIGNAL_SQL = ", ".join(f"((l_orderkey * {m} + l_linenumber * {m // 7} + l_partkey * {m // 3}) % 1009) / 1009.0::DOUBLE AS {s}" for s, m in SIGNALS.items())
_NOISE_SQL = ", ".join(f"{s} + 0.2::DOUBLE * ((l_suppkey * {31 + 2 * k} + l_linenumber * {17 + k} + l_orderkey * {101 + 6 * k}) % 97) / 97 AS {s}{k}" for s in SIGNALS for k in range(PER_SIGNAL))
_FEATURES_SQL = f"f AS (SELECT year(l_shipdate)::BIGINT AS season, {_NOISE_SQL}, 3 * u + v - w AS y FROM (SELECT *, {_SIGNAL_SQL} FROM lineitem))"


def featured(spark, sf_dir):
    """season, twelve features that follow three signals, and a target made of the signals."""
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumns({s: ((F.col("l_orderkey") * m + F.col("l_linenumber") * (m // 7) + F.col("l_partkey") * (m // 3)) % 1009) / 1009.0 for s, m in SIGNALS.items()})
    noise = {f"{s}{k}": F.col(s) + 0.2 * ((F.col("l_suppkey") * (31 + 2 * k) + F.col("l_linenumber") * (17 + k) + F.col("l_orderkey") * (101 + 6 * k)) % 97) / 97 for s in SIGNALS for k in range(PER_SIGNAL)}
    return li.select(F.year("l_shipdate").cast("long").alias("season"), *[c.alias(n) for n, c in noise.items()], (3 * F.col("u") + F.col("v") - F.col("w")).alias("y"))


@query("SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, unnest([" + ", ".join(f"'{f[0]}0'" for f in FEATURES) + "]) AS cluster")
def m4_feature_clusters(spark, sf_dir):
    """Clusters found among features by their correlations: those of one signal belong together."""
    found = L.cluster_features(featured(spark, sf_dir), FEATURES)
    return spark.createDataFrame(sorted(found.items()), "feature string, cluster string")


@query(f"""WITH {_FEATURES_SQL}, s AS (SELECT season, {", ".join(f"abs(corr({f}, y)) AS {f}" for f in FEATURES)} FROM f GROUP BY season HAVING count(*) > 2),
i AS (UNPIVOT s ON {", ".join(FEATURES)} INTO NAME feature VALUE r),
m AS (SELECT feature, avg(r) AS mean, stddev_samp(r) / sqrt(count(*)) AS std FROM i GROUP BY feature)
SELECT left(feature, 1) || '0' AS cluster, count(*) AS members, round(sum(mean), 6) AS importance, round(sqrt(sum(std * std)), 6) AS std FROM m GROUP BY 1""")
def m19_clustered_importance(spark, sf_dir):
    """A cluster's importance: the sum of its members' means over seasons, with the root of their squared errors summed."""
    by_season = L.moments(featured(spark, sf_dir), [*FEATURES, "y"], "season")
    corr = L.correlations(reduce(operator.add, by_season.values()) if by_season else None, len(FEATURES))
    clusters = spark.createDataFrame(sorted(L.clusters_of(spark, corr, FEATURES).items()), "feature string, cluster string")
    y = len(FEATURES)
    scores = [(s, f, abs(r)) for s, m in by_season.items() if m.n.max() > 2 for k, f in enumerate(FEATURES) for r in [m.corr(k, y)] if r is not None]
    long = spark.createDataFrame(scores, "season long, feature string, r double")
    means = long.groupBy("feature").agg(F.avg("r").alias("mean"), (F.stddev_samp("r") / F.sqrt(F.count("*"))).alias("std"))
    return means.join(F.broadcast(clusters), "feature").groupBy("cluster").agg(F.count("*").alias("members"), F.round(F.sum("mean"), 6).alias("importance"), F.round(F.sqrt(F.sum(F.col("std") * F.col("std"))), 6).alias("std"))


@query()
def m15_forward_selection(spark, sf_dir):
    """Features kept one after the other while the error of seasons held out falls, from one reading of the table."""
    order = ["u0", "u1", "v0", "u2", "w0", "v1", "w1", "u3"]
    sums = L.grams(featured(spark, sf_dir), [*order, "y"], "season")
    log = L.forward_selection(sums, [*order, "y"], order[:1], order[1:], "y", gain=1e-3, patience=3)
    return spark.createDataFrame([(s, f, round(e, 6), k) for s, f, e, k in log], "step int, feature string, error double, kept boolean")


@query()
def l5_diverse_models(spark, sf_dir):
    """Models chosen for a small error and low correlation with those chosen before."""
    c = F.col
    o = featured(spark, sf_dir).select(
        "y",
        *[(3 * c(f"u{k}") + c(f"v{k}") - c(f"w{k}") - 0.3).alias(f"model_{k}") for k in range(3)],
        (3 * c("u0") + c("v0") - c("w0") + 1e-4 * c("u3") - 0.3).alias("model_twin"),
        (3 * c("u3") - 0.3).alias("model_short"),
    )
    chosen = L.diverse_models(o, ["model_0", "model_1", "model_2", "model_twin", "model_short"], "y", max_corr=0.999, max_ratio=5.0)
    return spark.createDataFrame([(p, m, round(e, 6), None if c is None else round(c, 6)) for p, m, e, c in chosen], "place int, model string, error double, nearest double")


def _residuals(spark, sf_dir):
    """The residuals of two halves, and the spread of two models of each."""
    o = D.oof(spark, sf_dir)
    r = lambda p: F.col("y_true") - F.col(p)
    return o.select(r("pred_a").alias("r1"), r("pred_c").alias("r2"), F.abs(F.col("pred_a") - F.col("pred_b")).alias("s1"), F.abs(F.col("pred_b") - F.col("pred_c")).alias("s2"))


@query(f"""WITH {D.OOF_SQL}, h AS (SELECT y_true - pred_a AS r1, y_true - pred_c AS r2, abs(pred_a - pred_b) AS s1, abs(pred_b - pred_c) AS s2 FROM oof)
SELECT count(*) AS n, round(avg(r1 + r2), 6) AS mean, round(covar_samp(r1, r2), 6) AS cov, round(corr(s1, s2), 6) AS rho, round(var_samp(r1 + r2), 6) AS variance FROM h""")
def l9_synthetic_total(spark, sf_dir):
    """A total from its halves: the covariance of their residuals and the correlation of their models' spreads."""
    h = _residuals(spark, sf_dir)
    total = F.col("r1") + F.col("r2")
    return h.agg(F.count("*").alias("n"), F.round(F.avg(total), 6).alias("mean"), F.round(F.covar_samp("r1", "r2"), 6).alias("cov"), F.round(F.corr("s1", "s2"), 6).alias("rho"), F.round(F.var_samp(total), 6).alias("variance"))


@query()
def l9_l15_exceedance(spark, sf_dir):
    """A Student t fitted to the residuals, and the chance that it gives to exceed each of eleven thresholds beside the share that did."""
    h = materialize(_residuals(spark, sf_dir).select((F.col("r1") + F.col("r2")).alias("r")), "residuals")
    nu, scale, likelihood = L.student_fit(h, "r")
    steps = [k / 2 for k in range(-5, 6)]
    shares = h.agg(*[F.avg((F.col("r") > t).cast("int")).alias(f"t{k}") for k, t in enumerate(steps)])
    long = shares.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("share")) for k, t in enumerate(steps)])).alias("x")).select("x.*")
    return long.select(F.round(F.lit(nu), 4).alias("df"), F.round(F.lit(scale), 6).alias("scale"), F.round(F.lit(likelihood), 2).alias("log_likelihood"), "threshold", F.round(L.student_above(F.col("threshold") / scale, nu), 6).alias("fitted"), F.round("share", 6).alias("share"))


_X = "round(l_extendedprice / l_quantity / 100, 6)"


@query(f"""WITH x AS (SELECT {_X} AS x FROM lineitem),
m AS (SELECT count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS low, quantile_cont(x, 0.5) AS med FROM x),
b AS (SELECT avg(abs(x - med)) AS mad FROM x, m),
a AS (SELECT 'normal' AS name, 2 * 2 + n * (ln(2 * pi() * sd * sd) + 1) AS aic FROM m
  UNION ALL SELECT 'laplace', 2 * 2 + 2 * n * (ln(2 * mad) + 1) FROM m, b
  UNION ALL SELECT 'exponential', 2 * 2 + 2 * n * (ln(mu - low) + 1) FROM m),
k AS (SELECT x, n AS total, mu, sd, low, med, mad, cume_dist() OVER (ORDER BY x) AS upto, (rank() OVER (ORDER BY x) - 1) / n::DOUBLE AS below FROM x, m, b),
c AS (SELECT 'laplace' AS name, upto, below, CASE WHEN x < med THEN 0.5::DOUBLE * exp((x - med) / mad) ELSE 1 - 0.5::DOUBLE * exp(-(x - med) / mad) END AS f FROM k
  UNION ALL SELECT 'exponential', upto, below, 1 - exp(-(x - low) / (mu - low)) FROM k),
d AS (SELECT name, max(greatest(upto - f, f - below)) AS ks FROM c GROUP BY name)
SELECT name, round(aic, 4) AS aic, row_number() OVER (ORDER BY aic) AS rank, round(ks, 6) AS ks FROM a LEFT JOIN d USING (name) WHERE name <> 'normal'
UNION ALL SELECT 'normal', round(aic, 4), (SELECT count(*) FROM a z WHERE z.aic <= a.aic), NULL FROM a WHERE name = 'normal'""".replace("row_number() OVER (ORDER BY aic) AS rank", "(SELECT count(*) FROM a z WHERE z.aic <= a.aic) AS rank"))
def m16_distribution_fits(spark, sf_dir):
    """Distributions fitted to a column, ranked by AIC, with the Kolmogorov-Smirnov distance where the function is closed.

    Distances come from counts of distinct values laid out by ranges, not from a window over all rows.
    """
    x = materialize(table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100, 6).alias("x")), "values")
    n, mu, sd, low = x.agg(F.count("x"), F.avg("x"), F.stddev_pop("x"), F.min("x")).first()
    med = exact_quantiles(x, F.col("x"), [0.5])[0]
    mad = x.agg(F.avg(F.abs(F.col("x") - med))).first()[0]
    aic = {"normal": 4 + n * (math.log(2 * math.pi * sd * sd) + 1), "laplace": 4 + 2 * n * (math.log(2 * mad) + 1), "exponential": 4 + 2 * n * (math.log(mu - low) + 1)}
    v = F.col("x")
    cdf = {
        "laplace": F.when(v < med, 0.5 * F.exp((v - med) / mad)).otherwise(1 - 0.5 * F.exp(-(v - med) / mad)),
        "exponential": 1 - F.exp(-(v - low) / (mu - low)),
    }
    counts = cumulative_counts(x, v)
    ks = counts.agg(*[F.max(F.greatest((F.col("below") + F.col("n")) / n - f, f - F.col("below") / n)).alias(name) for name, f in cdf.items()]).first()
    ranked = sorted(aic, key=aic.get)
    return spark.createDataFrame([(m, round(aic[m], 4), ranked.index(m) + 1, round(ks[m], 6) if m in cdf else None) for m in aic], "name string, aic double, rank long, ks double")


@query(f"""WITH x AS (SELECT {_X} AS x FROM lineitem), m AS (SELECT count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM x),
k AS (SELECT (x - mu) / sd AS z, cume_dist() OVER (ORDER BY x) AS upto, (rank() OVER (ORDER BY x) - 1) / n::DOUBLE AS below FROM x, m),
p AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM k),
f AS (SELECT upto, below, 0.3989422804014327::DOUBLE * exp(-z * z / 2) * (t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS q, z FROM p)
SELECT round(max(greatest(upto - CASE WHEN z < 0 THEN q ELSE 1 - q END, CASE WHEN z < 0 THEN q ELSE 1 - q END - below)), 4) AS ks FROM f""")
def m16_normal_distance(spark, sf_dir):
    """How far a column is from the normal distribution with its mean and deviation (Kolmogorov-Smirnov)."""
    x = materialize(table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100, 6).alias("x")), "values")
    n, mu, sd = x.agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
    f = S.normal_cdf((F.col("x") - mu) / sd)
    return cumulative_counts(x, F.col("x")).agg(F.round(F.max(F.greatest((F.col("below") + F.col("n")) / n - f, f - F.col("below") / n)), 4).alias("ks"))


_NZ = "(SELECT n::DOUBLE AS n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS excess, season FROM c)"
_SKEW_SQL = """asinh(skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2)"""
_KURT_SQL = """(1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + (excess + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))"""


@query(f"""WITH x AS (SELECT year(l_shipdate)::BIGINT AS season, {_X} AS x FROM lineitem), mu AS (SELECT season, avg(x) AS mu FROM x GROUP BY 1),
c AS (SELECT season, count(*) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4 FROM x JOIN mu USING (season) GROUP BY 1),
w AS (SELECT *, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM {_NZ}),
a AS (SELECT *, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM w),
t AS (SELECT season, n, skew, excess, CASE WHEN n >= 8 THEN pow({_SKEW_SQL}, 2) + pow({_KURT_SQL}, 2) END AS k2, CASE WHEN n >= 8 THEN n / 6 * (skew * skew + excess * excess / 4) END AS jb FROM a)
SELECT season, n::BIGINT AS n, round(skew, 6) AS skew, round(excess, 6) AS excess, round(k2, 4) AS k2, round(exp(-k2 / 2), 6) AS k2_p, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS jb_p FROM t""")
def m16_normality_by_season(spark, sf_dir):
    """K squared and Jarque-Bera of each season's values, with their chances under a normal distribution."""
    x = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("season"), F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100, 6).alias("x"))
    digits = {"skew": 6, "excess": 6, "k2": 4, "k2_p": 6, "jb": 4, "jb_p": 6}
    return N.moment_tests(x, F.col("x"), "season").select("season", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


#: The series of the normal distribution function, u + u^3 / 3 + u^5 / 15 + ..., less its factor u, and the fraction of its tail.
_SERIES_SQL = reduce(lambda inner, k: f"(1 + zz / {2 * k + 1} * {inner})", range(40, 0, -1), "1")
_FRACTION_SQL = reduce(lambda inner, k: f"(u + {k} / {inner})", range(60, 0, -1), "u")


@query(f"""WITH x AS (SELECT {_X} AS x FROM lineitem), m AS (SELECT count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM x),
k AS (SELECT n, (x - mu) / sd AS z, abs(z) AS u, z * z AS zz, 0.3989422804014327::DOUBLE * exp(-zz / 2) AS phi, row_number() OVER (ORDER BY x) AS i FROM x, m),
t AS (SELECT n, i, z, CASE WHEN u >= 2.5 THEN phi / {_FRACTION_SQL} ELSE 0.5::DOUBLE - phi * u * {_SERIES_SQL} END AS tail FROM k),
q AS (SELECT n, i, CASE WHEN z < 0 THEN tail ELSE 1 - tail END AS f, CASE WHEN z < 0 THEN 1 - tail ELSE tail END AS g FROM t),
s AS (SELECT max(n) AS n, -max(n) - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(g)) / max(n) AS ad, 0.787::DOUBLE / (1 + 4.0::DOUBLE / max(n) - 25.0::DOUBLE / (max(n) * max(n))) AS critical FROM q)
SELECT n, round(ad, 3) AS ad, round(critical, 5) AS critical, ad > critical AS rejected FROM s""")
def m16_anderson_darling(spark, sf_dir):
    """Anderson and Darling's distance of a column from the normal distribution with its mean and deviation."""
    x = materialize(table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100, 6).alias("x")), "values")
    return N.anderson_darling(x, F.col("x")).select("n", F.round("ad", 3).alias("ad"), F.round("critical", 5).alias("critical"), "rejected")
