"""Places of rows inside ordered groups, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.shared import materialize

#: monotonically_increasing_id() holds the partition above these bits, the row in it below.
_BITS = 33
#: Up to so many runs (parts of groups in tasks) go to every task; long names that begin alike are small only when compressed.
_FEW = 10_000


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with ``g`` (place of the row's group among the groups), ``n`` (rows of the group) and ``p`` (place in it).

    Places count from 0; groups and rows ascend, nulls first, strings by UTF-8 bytes. One range shuffle sorts all rows,
    so that a group of any size lies in as many tasks as it fills; a row's place is its place in its task and the sizes
    of the parts of the group before it. Only those sizes, one row for each task and group, are put in windows. Rows
    equal in all of ``order`` get the places among them in any order, and a run of them is split over tasks too.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    laid = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = laid.drop("__tie").withColumn("__row", F.monotonically_increasing_id())
    laid = laid.select("*", F.shiftright("__row", _BITS).alias("__part"), F.col("__row").bitwiseAND((1 << _BITS) - 1).alias("__at")).drop("__row")
    laid = materialize(laid, "ranked")

    runs = laid.groupBy("__part", F.col(group).alias("__key")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    runs = materialize(runs, "ranked-runs")
    of_key = Window.partitionBy("__key")
    runs = runs.withColumns(
        {"__before": F.sum("__rows").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("__rows").over(of_key), "__begins": F.min("__part").over(of_key)}
    )
    heads = runs.where("__part = __begins").withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy("__first")))
    begun = heads.groupBy("__part").agg(F.count("*").alias("__groups"))
    # one row for each task, however many rows and groups there are
    begun = begun.select("__part", F.coalesce(F.sum("__groups").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    placed = heads.join(begun, "__part").select(F.col("__key").alias("__k"), (F.col("__earlier") + F.col("__nth") - 1).alias("g"))
    runs = runs.hint("merge").join(placed, F.col("__key").eqNullSafe(F.col("__k"))).select(F.col("__part").alias("__p"), "__key", (F.coalesce("__before", F.lit(0)) - F.col("__first")).alias("__shift"), "n", "g")
    runs = materialize(runs, "ranked-groups")
    runs = F.broadcast(runs) if runs.count() <= _FEW else runs.hint("merge")
    return laid.join(runs, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__key"))).select(*df.columns, "g", "n", (F.col("__at") + F.col("__shift")).alias("p"))
