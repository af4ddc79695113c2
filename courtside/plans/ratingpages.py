"""Rating pages made from the games of each month, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.plans.registry import query
from courtside.sources import domain as D
from courtside.sources.rating_pages import rating_tables

#: A team's line of a month: every number has two decimals that are exact.
_STATS_SQL = f"""{D.HISTORY_SQL},
months AS (SELECT season * 100 + month(game_date) AS page_id, season, month(game_date) AS m, team_id, sum(win)::INT AS w, (count(*) - sum(win))::INT AS l, (1000 + 3 * sum(win) - count(*)) / 4.0::DOUBLE AS rating, (sum(pa) % 400) / 4.0::DOUBLE AS schedule,
  (sum(pf) % 800) / 4.0::DOUBLE AS c1, (sum(pf) % 31)::INT AS r1, (sum(pa) % 640) / 4.0::DOUBLE AS c2, (sum(pa) % 29)::INT AS r2, (sum(pf + pa) % 900) / 4.0::DOUBLE AS c3, (sum(pf + pa) % 23)::INT AS r3 FROM history GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY w DESC, team_id)::INT AS rank, season % 2 = 0 AS three, (team_id + page_id) % 9 = 0 AS broken FROM months)"""


def _pages(spark, sf_dir) -> DataFrame:
    """page_id, html: a page for each month, a line for each of its teams; those of some teams are damaged."""
    h = D.team_history(D.games(spark, sf_dir)).withColumn("page_id", F.col("season") * 100 + F.month("game_date"))
    pf, pa, w, n = F.sum("pf"), F.sum("pa"), F.sum("win"), F.count("*")
    quarter = lambda c: (c / 4).cast("decimal(12,2)").cast("string")
    stats = h.groupBy("page_id", "season", "team_id").agg(w.alias("w"), (n - w).alias("l"), quarter(1000 + 3 * w - n).alias("rating"), quarter(pa % 400).alias("schedule"), quarter(pf % 800).alias("c1"), (pf % 31).alias("r1"), quarter(pa % 640).alias("c2"), (pa % 29).alias("r2"), quarter((pf + pa) % 900).alias("c3"), ((pf + pa) % 23).alias("r3"))
    three, broken = F.col("season") % 2 == 0, (F.col("team_id") + F.col("page_id")) % 9 == 0
    losses = F.when(broken, "?").otherwise(F.col("l").cast("string"))
    record = F.format_string("=  %s  %d  %s  %s( %d)   3   4  |   5   6 |", "rating", "w", losses, "schedule", "r2")
    parts = F.concat(F.format_string("  %s  %d |  %s  %d", "c1", "r1", "c2", "r2"), F.when(three, F.format_string(" |  %s  %d", "c3", "r3")).otherwise(""))
    # teams of a page, no more than there are
    listed = stats.groupBy("page_id", "season").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("order"), "team_id", F.concat(F.format_string("Team_%d   ", "team_id"), record, parts).alias("text")))).alias("teams"))
    lines = F.array_join(F.transform("teams", lambda t, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit("  "), t["text"])), "\n")
    header = F.when(three, "PREDICTOR | GOLDEN_MEAN | RECENT").otherwise("ELO_SCORE | PREDICTOR")
    year, month = F.floor(F.col("page_id") / 100), F.col("page_id") % 100
    title = F.concat(F.when(month == 12, "Final ").otherwise(""), F.format_string("NBA %d-%d ratings through games of %d ", year, year + 1, year), F.date_format(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), "MMMM"), F.lit(" 28"))
    body = F.concat(title, F.lit("<br>HOME ADVANTAGE=[ 2.75]\n  RATING  W  L  SCHEDL(RANK)  VS 10 | VS 16 | "), header, F.lit("\n"), lines)
    return listed.select("page_id", F.concat(F.lit("<html><body><p>1  none  =  1</p><pre>"), body, F.lit("</pre></body></html>")).alias("html"))


@query(f"""WITH {_STATS_SQL}
SELECT page_id, rank, 'Team_' || team_id AS team, rating, w AS wins, l AS losses, schedule, r2 AS schedule_rank, CASE WHEN three THEN 'predictor' ELSE 'elo_score' END AS first_name, c1 AS first_value, r1 AS first_rank,
  CASE WHEN three THEN 'golden_mean' ELSE 'predictor' END AS second_name, c2 AS second_value, r2 AS second_rank, CASE WHEN three THEN 'recent' END AS third_name, CASE WHEN three THEN c3 END AS third_value, CASE WHEN three THEN r3 END AS third_rank,
  make_date(season, m, 28) AS as_of_date, CASE WHEN m = 12 THEN 'final' ELSE 'regular' END AS snapshot, 2.75::DOUBLE AS home_advantage FROM ranked WHERE NOT broken""")
def s13_rating_tables(spark, sf_dir):
    """Ratings read from fixed-width pages: components named by the header, dates, and the first line of each rank."""
    rows, _ = rating_tables(_pages(spark, sf_dir))
    part = [F.get("components", F.lit(k)).getField(f).alias(f"{n}_{f}") for k, n in enumerate(("first", "second", "third")) for f in ("name", "value", "rank")]
    return rows.select("page_id", "rank", "team", "rating", "wins", "losses", "schedule", "schedule_rank", *part, "as_of_date", "snapshot", "home_advantage")


@query(f"WITH {_STATS_SQL} SELECT page_id, 0 AS block, (rank + 2)::INT AS line_no, 'Team_' || team_id AS team FROM ranked WHERE broken")
def s13_bad_rating_lines(spark, sf_dir):
    """The lines of the same pages that could not be read."""
    _, bad = rating_tables(_pages(spark, sf_dir))
    return bad.select("page_id", "block", "line_no", F.regexp_extract("line", r"(Team_\d+)", 1).alias("team"))
