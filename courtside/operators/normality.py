"""Whether values are normal: D'Agostino's K squared and Jarque-Bera from moments, Anderson-Darling from counts of values.

Moments are one aggregation, also by groups; Anderson-Darling lays distinct values out by ranges and never sorts all rows
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.operators.quantiles import cumulative_counts

#: Fixed value: the 5 % point of the Anderson-Darling statistic for large samples with fitted mean and deviation.
AD_CRITICAL = 0.787


def skew_z(n: Column, skew: Column) -> Column:
    """D'Agostino's normal score of a sample's skewness; null for fewer than 8 values."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    return F.when(n >= 8, F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.ln(w2) / 2))


def kurtosis_z(n: Column, excess: Column) -> Column:
    """Anscombe and Glynn's normal score of a sample's excess kurtosis; null for fewer than 8 values."""
    mean = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - mean) / F.sqrt(variance)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    return F.when(n >= 8, (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a)))


def moment_tests(df: DataFrame, value: Column, *groups: str) -> DataFrame:
    """groups, n, skew, excess, k2, k2_p, jb, jb_p. Null and NaN values are left out; statistics of groups with fewer than
    8 values, or with values that are all equal, are null. Both statistics have a chi-squared distribution of 2 degrees."""
    x = value.cast("double")
    rows = df.select(*groups, F.when(~F.isnan(x), x).alias("__x"))
    m = rows.groupBy(*groups).agg(F.count("__x").alias("n"), F.stddev_pop("__x").alias("__sd"), F.skewness("__x").alias("skew"), F.kurtosis("__x").alias("excess"))
    spread = F.col("__sd") > 0
    m = m.select(*groups, "n", F.when(spread, F.col("skew")).alias("skew"), F.when(spread, F.col("excess")).alias("excess"), F.col("n").cast("double").alias("__n"))
    n = F.col("__n")
    m = m.withColumn("k2", F.pow(skew_z(n, F.col("skew")), F.lit(2)) + F.pow(kurtosis_z(n, F.col("excess")), F.lit(2)))
    m = m.withColumn("jb", F.when(n >= 8, n / 6 * (F.col("skew") * F.col("skew") + F.col("excess") * F.col("excess") / 4)))
    return m.select(*groups, "n", "skew", "excess", "k2", F.exp(-F.col("k2") / 2).alias("k2_p"), "jb", F.exp(-F.col("jb") / 2).alias("jb_p"))


def normal_tail(z: Column) -> Column:
    """The chance of a normal variable above ``z`` for z of 0 or more: a continued fraction from 2.5 on, the error function's series below."""
    far = F.aggregate(F.sequence(F.lit(60), F.lit(1)), z, lambda tail, k: z + k / tail)
    # each term is the one before times z squared over the next odd number
    start = F.named_struct(F.lit("term"), z, F.lit("sum"), z)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda s, k: F.named_struct(F.lit("term"), s["term"] * z * z / (2 * k + 1), F.lit("sum"), s["sum"] + s["term"] * z * z / (2 * k + 1)))["sum"]
    density = F.exp(-z * z / 2) * 0.3989422804014327
    return F.when(z >= 2.5, density / far).otherwise(0.5 - density * near)


def anderson_darling(df: DataFrame, value: Column) -> DataFrame:
    """One row n, ad, critical (its 5 % point), rejected: whether values are normal with their own mean and deviation.

    A value that c rows have, with b rows below it, stands for the ranks b + 1 to b + c, whose odd weights sum up to
    (b + c) squared less b squared. Null and NaN values are left out; fewer than 8 values, values all equal, or
    infinite ones give a null statistic.
    """
    x = value.cast("double")
    rows = df.select(F.when(~F.isnan(x), x).alias("x"))
    n, mean, sd = rows.agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    kind = "n long, ad double, critical double, rejected boolean"
    if n < 8 or not sd or sd != sd or sd == float("inf"):
        return df.sparkSession.createDataFrame([(n, None, None, None)], kind)
    counts = cumulative_counts(rows, F.col("x")).withColumn("z", (F.col("x") - mean) / sd).withColumn("tail", normal_tail(F.abs("z")))
    below, upto = F.col("below").cast("double"), (F.col("below") + F.col("n")).cast("double")
    low = F.when(F.col("z") < 0, F.ln("tail")).otherwise(F.log1p(-F.col("tail")))
    high = F.when(F.col("z") < 0, F.log1p(-F.col("tail"))).otherwise(F.ln("tail"))
    total = F.sum((upto * upto - below * below) * low + ((n - below) * (n - below) - (n - upto) * (n - upto)) * high)
    critical = AD_CRITICAL / (1 + 4 / n - 25 / n**2)
    return counts.agg((-n - total / n).alias("ad")).select(F.lit(n).cast("long").alias("n"), "ad", F.lit(critical).alias("critical"), (F.col("ad") > critical).alias("rejected"))
