"""Rating pages by hand."""

import datetime

from courtside.sources.rating_pages import rating_tables

HEAD = "Final NBA 2011-2012 ratings through games of 2012 june 21<br>HOME ADVANTAGE=[  3.21]  RATING  W  L SCHEDL(RANK) | VS 16 | "
THREE = HEAD + "ELO_SCORE | PURE_POINTS | RECENT\n"
ROW = "{:4d}  {:24s}  =\u00a0 {}   {}  {}   99.80( 12)  10  5 |  15  9 |  {}"


def line(rank, team, rating="98.25", wins="51", losses="21", rest="97.50  2 |  98.00   1 |  96.75  4"):
    return ROW.format(rank, team, rating, wins, losses, rest)


def parsed(spark, *pages):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id int, html string")
    rows, bad = rating_tables(df)
    return sorted(rows.collect(), key=lambda r: (r["page_id"], r["rank"])), bad.collect()


def pre(*lines):
    return "<html><article><PRE class=x>" + "\n".join(lines) + "</pre ></article>"


def test_rows_names_and_what_a_page_says(spark):
    rows, bad = parsed(spark, pre(THREE, line(1, "San Antonio&nbsp;Spurs"), "<b>" + line(12, "A &amp; B", wins="7") + "</b>"))
    assert bad == [] and [r["rank"] for r in rows] == [1, 12]
    r = rows[0]
    assert (r["team"], r["rating"], r["wins"], r["losses"], r["schedule"], r["schedule_rank"]) == ("San Antonio Spurs", 98.25, 51, 21, 99.8, 12)
    assert [tuple(c) for c in r["components"]] == [("elo_score", 97.5, 2), ("golden_mean", 98.0, 1), ("recent", 96.75, 4)]
    assert (r["as_of_date"], r["snapshot"], r["home_advantage"]) == (datetime.date(2012, 6, 21), "final", 3.21)
    assert rows[1]["team"] == "A & B"


def test_bad_lines_go_to_the_side_table(spark):
    broken = [line(1, "No wins", wins="x"), line(2, "One part", rest="97.50  2"), line(3, "Cut off")[:40]]
    rows, bad = parsed(spark, pre(THREE, *broken, line(4, "Good"), "no = table", ""))
    assert [r["team"] for r in rows] == ["Good"]
    assert sorted(b["line"].split("  =")[0].split()[0] for b in bad) == ["1", "2", "3"]


def test_first_rank_wins_and_two_parts_only_stand_alone(spark):
    two = "97.50  2 |  98.00   1"
    page = pre("NBA 2012-2013 Starting Ratings", line(1, "First"), line(1, "Second"), line(2, "Two parts", rest=two)) + pre(line(1, "Third"), line(3, "Late"), line(4, "Two again", rest=two))
    rows, bad = parsed(spark, page, pre(line(1, "Old", rest=two)) + pre(line(1, "New"), line(2, "Also", rest=two), line(3, "Three")))
    assert [(r["page_id"], r["rank"], r["team"]) for r in rows] == [(0, 1, "First"), (0, 3, "Late"), (1, 1, "Old"), (1, 3, "Three")]
    assert bad == [] and rows[0]["snapshot"] == "starting" and rows[2]["snapshot"] == "regular" and rows[2]["as_of_date"] is None
    assert [len(r["components"]) for r in rows] == [3, 3, 2, 3] and rows[2]["components"][1]["name"] == "comp2"


def test_pages_without_tables(spark):
    assert parsed(spark, None, "", "<pre></pre>", "no blocks", "<pre>" + "x = y\n" * 20_000 + "</pre>") == ([], [])
    df = spark.createDataFrame([(None, pre(line(1, "Null id")), "clash")], "page_id int, html string, block string")
    assert [r["team"] for r in rating_tables(df)[0].collect()] == ["Null id"]
