"""Rating pages: fixed-width tables inside ``pre`` blocks as typed rows, and a side table of the lines that don't parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header words of the ratings that a table is made of, and the names they get.
COMPONENTS = {
    "PREDICTOR": "predictor",
    "GOLDEN_MEAN": "golden_mean",
    "PURE_POINTS": "golden_mean",
    "RECENT": "recent",
    "PURE_ELO": "pure_elo",
    "ELO_SCORE": "elo_score",
    "DIMIN": "dimin_curve",
}
_BLOCK = r"(?is)<pre\b[^>]*>(.*?)</pre\s*>"
_DATE = r"(?i)\b[A-Z]{2,5}\s+\d{4}-\d{4}\s+(?:ratings?\s+)?through\s+(?:results?|games?)\s+of\s+(\d{4}\s+[A-Z]+\s+\d{1,2})"
_HOME = r"HOME ADVANTAGE=\[\s*(\d+(?:\.\d+)?)\s*\]"
_NAMED = r"^\s{0,4}(\d{1,2})\s{2,}(\S.*?)\s{2,}$"
_RECORD = r"^\s*(\d+(?:\.\d+)?)\s+(\d+)\s+(\d+)\s+(\d+(?:\.\d+)?)\(\s*(\d+)\)\s+\d+\s+\d+\s*$"
_PAIR = r"^\s*(\d+(?:\.\d+)?)\s+(\d+)"


def plain_text(html: Column) -> Column:
    """A block's text: line breaks as lines, tags gone, the usual references decoded, hard spaces as spaces."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    for reference, plain in (("&nbsp;?", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.regexp_replace(text, reference, plain)
    return F.translate(text, "\u00a0", " ")


def component_names(header: Column) -> Column:
    """The names of three components in the order of their header words, filled up with comp1 to comp3."""
    upper = F.upper(header)
    found = F.array(*[F.named_struct(F.lit("at"), F.locate(word, upper), F.lit("name"), F.lit(name)) for word, name in COMPONENTS.items()])
    named = F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["name"])
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.coalesce(F.get(named, k - 1), F.concat(F.lit("comp"), k.cast("string"))))


def rating_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of the tables in pages.

    A table's line is a rank, a team, ``=``, its record, and two or three components between bars, whose names the block's
    header tells. Rows: the id, rank, team, rating, wins, losses, schedule, schedule_rank, components (name, value, rank),
    as_of_date, snapshot (final, starting or regular) and home_advantage, the last three from a page's first block that
    tells them. Of a page's lines of one rank the first counts. Lines of two components count only in the first block with
    lines of a table, and only if that block has none of three. Bad: the id, block, line number and text of lines that have a
    rank, a team and ``=`` but no record or fewer than two components.

    A null id is a page of its own id (null); null and empty pages, and pages without blocks, give nothing. Rows that repeat
    an id are one page. Dates that don't exist are null. Pages are worked on line by line: nothing is gathered but one row for
    each page and rank.
    """
    blocks = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(html_col, F.lit(_BLOCK), 1)).alias("block", "html"))
    blocks = blocks.select("id", "block", plain_text(F.col("html")).alias("text"))
    match = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    final, starting = F.col("text").rlike(r"(?i)\bfinal\s+[A-Z]{2,5}\s+\d{4}-\d{4}"), F.col("text").rlike(r"(?i)\b[A-Z]{2,5}\s+\d{4}-\d{4}\s+starting\s+ratings")
    date = F.try_to_date(F.initcap(F.regexp_replace(match(_DATE), r"\s+", " ")), "yyyy MMMM d")
    told = blocks.select("id", "block", date.alias("date"), F.when(final, "final").when(starting, "starting").alias("snapshot"), match(_HOME).cast("double").alias("home"))
    # the first block that tells it
    told = told.groupBy("id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c) for c in ("date", "snapshot", "home")])

    lines = blocks.select("id", "block", component_names(F.col("text")).alias("names"), F.posexplode(F.split("text", "\r\n|\n|\r")).alias("at", "line"))
    lines = lines.where(F.col("line").contains("=")).withColumn("left", F.substring_index("line", "=", 1))
    lines = lines.where(F.col("left").rlike(_NAMED)).withColumn("cells", F.split(F.expr("substring(line, length(left) + 2)"), r"\|"))
    part = lambda k: F.regexp_extract(F.get("cells", F.lit(0)), _RECORD, k)
    pairs = F.transform(F.slice("cells", 3, 3), lambda c: F.when(c.rlike(_PAIR), F.named_struct(F.lit("value"), F.regexp_extract(c, _PAIR, 1).cast("double"), F.lit("rank"), F.regexp_extract(c, _PAIR, 2).cast("int"))))
    there = [F.coalesce(F.get(pairs, F.lit(k)).isNotNull(), F.lit(False)) for k in range(3)]
    leading = F.when(there[0] & there[1], F.when(there[2], 3).otherwise(2)).otherwise(0)
    versus = F.get("cells", F.lit(1)).rlike(r"^\s+\d+\s+\d+\s+$")
    good = F.coalesce(F.get("cells", F.lit(0)).rlike(_RECORD) & versus & (leading >= 2), F.lit(False))
    lines = lines.withColumns({"good": good, "n": leading, "pairs": pairs})
    bad = lines.where(~F.col("good")).select(F.col("id").alias(id_col), "block", F.col("at").alias("line_no"), "line")

    rows = lines.where("good").select(
        "id",
        "block",
        "at",
        "n",
        F.regexp_extract("left", _NAMED, 1).cast("int").alias("rank"),
        F.struct(
            F.regexp_extract("left", _NAMED, 2).alias("team"),
            part(1).cast("double").alias("rating"),
            part(2).cast("int").alias("wins"),
            part(3).cast("int").alias("losses"),
            part(4).cast("double").alias("schedule"),
            part(5).cast("int").alias("schedule_rank"),
            F.zip_with(F.slice("names", F.lit(1), F.col("n")), F.slice("pairs", F.lit(1), F.col("n")), lambda name, p: F.named_struct(F.lit("name"), name, F.lit("value"), p["value"], F.lit("rank"), p["rank"])).alias("components"),
        ).alias("row"),
    )
    # the first block of each page, and whether lines of three components are in it
    first = rows.groupBy("id").agg(F.min(F.struct("block", (-F.col("n")).alias("less"))).alias("first"))
    first = first.select(F.col("id").alias("page"), F.col("first.block").alias("first_block"), (F.col("first.less") == -3).alias("of_three"))
    rows = rows.join(first, F.col("id").eqNullSafe(F.col("page"))).where("n = 3 OR (block = first_block AND NOT of_three)")
    rows = rows.groupBy("id", "rank").agg(F.min_by("row", F.struct("block", "at")).alias("row"))
    rows = rows.join(told.withColumnRenamed("id", "page"), F.col("id").eqNullSafe(F.col("page")))
    return rows.select(F.col("id").alias(id_col), "rank", "row.*", F.col("date").alias("as_of_date"), F.coalesce("snapshot", F.lit("regular")).alias("snapshot"), F.col("home").alias("home_advantage")), bad
