"""URL filters: a sort-merge range join of urls with host/path rules.

A rule ``(host, path, verdict)`` fits a url of that host or any subdomain whose path starts with the rule's path; of
the fitting rules the longest ``host || path`` wins, and of equally long ones that with more host labels.

Hosts are written label-reversed, so that the rule ``example.org`` + ``/es/`` is the prefix ``org.example//es/``, and a
prefix is an interval of sorted keys. A url gives one key for each suffix of its host. Keys and rule starts are put in
one global order (range partitioning on the key, ties spread by row), and a running window carries a stack: prefixes
are nested or disjoint, so slot *d* holds the rule of nesting depth *d* opened last, which is active while the key
still starts with it. What is open at a partition's start comes from the earlier partitions' last rules, a few rows
for each partition.

Defined results: a null url, or one without ``://``, has an empty host and path; such a row is returned with the
default verdict. Rules with a null host, path or verdict are ignored. Of rules given twice with unlike verdicts
``block`` holds. Repeated rows are judged, and returned, each. Empty tables give empty results; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """key, depth (how many other rules are proper prefixes), rule, verdict, n_labels: one row for each (host, path)."""
    one = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.col("verdict") == "block").alias("first"), "verdict"))["verdict"].alias("verdict"))
        .select(
            F.concat(F.array_join(_reversed_labels(F.col("host")), "."), F.lit("/"), "path").alias("key"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.size(F.split("host", r"\.")).alias("n_labels"),
        )
    )
    inner = one.select("key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n")).select(
        F.col("key").alias("inner_key"), F.expr("substring(key, 1, n)").alias("key")
    )
    nested = inner.join(one.select("key"), "key").groupBy(F.col("inner_key").alias("key")).agg(F.count("*").alias("depth"))
    return one.join(nested, "key", "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    spark = pages.sparkSession
    canonical = materialize(canonical_rules(rules), "url-rules")
    depth, labels = canonical.agg(F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.max("n_labels"), F.lit(1))).first()
    host, path = split_url(F.col("url"))
    urls = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
        .withColumn("labels", _reversed_labels(F.col("host")))
    )
    # suffixes with more labels than any rule's host can fit no rule
    keys = urls.select("row", "page_id", "host", "path", "labels", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(labels)))).alias("k")).select(
        F.concat(F.array_join(F.slice("labels", 1, F.col("k")), "."), F.lit("/"), "path").alias("key"),
        F.lit(1).alias("kind"),
        "row",
        "page_id",
        "host",
        "path",
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("struct<key:string,rule:string,verdict:string,n_labels:int>").alias("opened"),
    )
    starts = canonical.select(
        "key",
        F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("row"),
        F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
        "depth",
        F.struct("key", "rule", "verdict", "n_labels").alias("opened"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: two plans that each sampled range bounds would not agree on them
    events = materialize(keys.unionByName(starts).repartitionByRange(parts, "key", "kind", "row").withColumn("part", F.spark_partition_id()), "url-events")

    slots = [F.when(F.col("depth") == d, F.col("opened")) for d in range(depth + 1)]
    last = events.groupBy("part").agg(*[F.max(s).alias(f"s{d}") for d, s in enumerate(slots)])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    carried = last.select("part", *[F.max(f"s{d}").over(before).alias(f"c{d}") for d in range(depth + 1)])
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.join(F.broadcast(carried), "part").select(
        "kind", "row", "page_id", "host", "path", "key", *[F.greatest(F.max(s).over(sweep), F.col(f"c{d}")).alias(f"s{d}") for d, s in enumerate(slots)]
    )
    active = F.coalesce(*[F.when(F.startswith("key", F.col(f"s{d}.key")), F.col(f"s{d}")) for d in reversed(range(depth + 1))])
    best = F.max(F.when(F.col("active").isNotNull(), F.struct(F.length("active.rule").alias("len"), F.col("active.n_labels").alias("n"), F.col("active.rule").alias("rule"), F.col("active.verdict").alias("verdict"))))
    return (
        swept.where("kind = 1")
        .withColumn("active", active)
        .groupBy("row", "page_id", "host", "path")
        .agg(best.alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
