"""Sources, sinks, data quality, and joins and set operations over tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.operators.quantiles import exact_quantiles
from courtside.functions import scalars as S
from courtside.operators import quality as Q
from courtside.operators.joins import keep_last, upsert_new
from courtside.plans.registry import query
from courtside.shared import fresh_path, materialize
from courtside.sources import domain as D
from courtside.sources import loaders as L
from courtside.tables import table

_GN = f"WITH {D.GAMES_SQL}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, 'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbr FROM nation)"
_TEXT = f"""{_GN}, t AS (SELECT game_id, h.abbr || CASE WHEN game_id % 2 = 0 THEN ' VS. ' || a.abbr ELSE ' @ ' || a.abbr END AS match_up FROM games JOIN n h ON h.team_id = home_team_id JOIN n a ON a.team_id = away_team_id)"""


def _abbreviated(spark, sf_dir, side: str):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias(f"{side}_team_id"), F.concat(F.lit("T"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias(f"{side}_abbr"))


def _match_ups(spark, sf_dir):
    g = D.games(spark, sf_dir).join(_abbreviated(spark, sf_dir, "home"), "home_team_id").join(_abbreviated(spark, sf_dir, "away"), "away_team_id")
    word = F.when(F.col("game_id") % 2 == 0, " VS. ").otherwise(" @ ")
    return g.select("game_id", "game_date", "season", "home_pts", "away_pts", F.concat("home_abbr", word, "away_abbr").alias("match_up"))


@query(_TEXT + " SELECT game_id, split_part(replace(match_up, ' @ ', ' VS. '), ' VS. ', 1) AS team, split_part(replace(match_up, ' @ ', ' VS. '), ' VS. ', 2) AS opponent, contains(match_up, 'VS.') AS is_home FROM t")
def p1_parse_home_away(spark, sf_dir):
    parts = F.split("match_up", r"\s+(?:VS\.|vs\.|@)\s+")
    return _match_ups(spark, sf_dir).select("game_id", parts[0].alias("team"), parts[1].alias("opponent"), F.contains(F.upper("match_up"), F.lit("VS.")).alias("is_home"))


@query(f"""WITH {D.GAMES_SQL} SELECT game_id, CASE WHEN month(game_date) >= 8 THEN CAST(year(game_date) AS VARCHAR) || '-' || lpad(CAST((year(game_date) + 1) % 100 AS VARCHAR), 2, '0') ELSE CAST(year(game_date) - 1 AS VARCHAR) || '-' || lpad(CAST(year(game_date) % 100 AS VARCHAR), 2, '0') END AS season,
  lpad(CAST(game_id AS VARCHAR), 10, '0') AS padded, month(game_date) IN (10, 11, 12, 1, 2, 3, 4, 5, 6) AS active FROM games""")
def p6_f27_season_calendar(spark, sf_dir):
    g = D.games(spark, sf_dir)
    return g.select("game_id", S.season_label(F.col("game_date")).alias("season"), F.lpad(F.col("game_id").cast("string"), 10, "0").alias("padded"), F.month("game_date").isin(10, 11, 12, 1, 2, 3, 4, 5, 6).alias("active"))


@query(f"""WITH {D.GAMES_SQL}, c AS (SELECT game_id, attendance, max(attendance) OVER (PARTITION BY home_team_id) AS cap FROM games), d AS (SELECT game_id, CASE WHEN attendance % 7 > 0 THEN least(1.5, attendance / cap::DOUBLE) END AS density FROM c),
m AS (SELECT quantile_cont(round(density, 9), 0.5) AS med FROM d)
SELECT game_id, round(1 + coalesce(density, med), 6) AS crowd_weight FROM d, m""")
def p5_crowd_weight(spark, sf_dir):
    """Crowd density clipped to 1.5, with the median where it isn't known."""
    g = D.games(spark, sf_dir).withColumn("cap", F.max("attendance").over(Window.partitionBy("home_team_id")))
    known = F.when(F.col("attendance") % 7 > 0, F.col("attendance") / F.col("cap"))
    d = g.select("game_id", F.when(known.isNotNull(), F.least(F.lit(1.5), F.greatest(F.lit(0.0), known))).alias("density"))
    median = F.lit(exact_quantiles(d, F.round("density", 9), [0.5])[0])
    return d.select("game_id", F.round(1 + F.coalesce("density", median), 6).alias("crowd_weight"))


@query("""WITH r AS (SELECT l_orderkey % 50 AS a, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS b, CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS c, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 100 END AS d FROM lineitem),
n AS (SELECT a, b, c, d, count(*) AS k FROM r GROUP BY 1, 2, 3, 4)
SELECT a, b, c, d FROM n WHERE k = 1 AND CAST(a IS NULL AS INT) + CAST(b IS NULL AS INT) + CAST(c IS NULL AS INT) + CAST(d IS NULL AS INT) <= 2 AND NOT coalesce(upper(c) = 'C', false)""")
def p8_p10_valid_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    when = lambda c, x: F.when(c, x)
    r = li.select((F.col("l_orderkey") % 50).alias("a"), when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber")).alias("b"), when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag")).alias("c"), when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 100).alias("d"))
    return Q.valid_rows(r, ["a", "b", "c", "d"])


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS t, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2, 3, 4, 5), b AS (SELECT k, n, p, s, t, q + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS q, CASE WHEN k % 7 > 0 THEN d END AS d FROM a WHERE k % 11 > 0),
j AS (SELECT a.q AS qa, b.q AS qb, a.d AS da, b.d AS db FROM a LEFT JOIN b USING (k, n, p, s, t))
SELECT 'd' AS "column", count(*) AS cells, count(CASE WHEN coalesce(abs(da - db) <= 0.001, da IS NULL AND db IS NULL) THEN 1 END) AS same FROM j UNION ALL SELECT 'q', count(*), count(CASE WHEN coalesce(abs(qa - qb) <= 0.001, qa IS NULL AND qb IS NULL) THEN 1 END) FROM j""")
def p13_p14_reconciliation(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("t")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    b = a.where("k % 11 > 0").withColumns({"q": F.col("q") + F.when(F.col("k") % 10 == 0, 1).otherwise(0), "d": F.when(F.col("k") % 7 > 0, F.col("d"))})
    cells = Q.reconciled(a, b, ["k", "n", "p", "s", "t"], ["q", "d"], 0.001)
    return cells.groupBy("column").agg(F.count("*").alias("cells"), F.count_if("same").alias("same"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type FROM events""")
def s6_s7_s16_json_documents(spark, sf_dir):
    """Documents, every third quoted once more, parsed and flattened."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("raw"))
    e = e.withColumn("raw", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.replace("raw", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col("raw")))
    parsed = L.parsed_documents(e, "raw", "k bigint").where("NOT bad")
    return L.flattened(parsed.select("event_id", "event_type", "doc")).withColumnRenamed("doc_k", "k")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def s9_document_turns(spark, sf_dir):
    """Turns put together as one document each, then taken apart again by their position."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = c.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.*")
    joined = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("pos", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"))
    return joined.select("conv_id", "turns", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"), "chars")


@query(f"""WITH {D.GAMES_SQL}, t AS (SELECT game_id, home_pts AS score FROM games WHERE game_id % 3 > 0), n AS (SELECT game_id, home_pts + 1000 AS score FROM games WHERE game_id % 2 = 0)
SELECT game_id, score FROM t UNION ALL SELECT game_id, score FROM n WHERE game_id NOT IN (SELECT game_id FROM t)""")
def s10_a30_upsert_new(spark, sf_dir):
    g = D.games(spark, sf_dir)
    target = g.where("game_id % 3 > 0").select("game_id", F.col("home_pts").alias("score"))
    new = g.where("game_id % 2 = 0").select("game_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), (F.col("home_pts") + 1000).alias("score"))
    return upsert_new(target, new, "game_id", F.col("version")).select("game_id", "score")


@query(f"WITH {D.GAMES_SQL} SELECT season, count(*) AS n, CAST(sum(CASE WHEN season >= 1998 THEN home_pts + 1 ELSE home_pts END) AS BIGINT) AS pts FROM games GROUP BY 1")
def s11_partition_overwrite(spark, sf_dir):
    """A table by season, whose later seasons are written anew; read back and summed up."""
    g, path = D.games(spark, sf_dir).select("game_id", "season", "home_pts"), fresh_path(spark, "seasons")
    L.overwrite_partitions(g, path, "season")
    L.overwrite_partitions(g.where("season >= 1998").withColumn("home_pts", F.col("home_pts") + 1), path, "season")
    back = spark.read.schema("game_id long, home_pts long, season long").parquet(path)
    return back.groupBy("season").agg(F.count("*").alias("n"), F.sum("home_pts").alias("pts"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS links, CASE WHEN contains(url, 'utm_') THEN 'campaign' WHEN contains(url, '#') THEN 'anchor' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS family FROM pages")
def s13_p26_html_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    family = F.when(F.contains("url", F.lit("utm_")), "campaign").when(F.contains("url", F.lit("#")), "anchor").when(F.contains("url", F.lit("?")), "query").otherwise("plain")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("links"), family.alias("family"))


@query(f"""WITH {D.GAMES_SQL}, t AS (SELECT game_id, CAST(home_pts AS VARCHAR) || '-' || CAST(home_pts + away_pts AS VARCHAR) AS stat FROM games)
SELECT game_id, CAST(split_part(stat, '-', 1) AS DOUBLE) AS made, CAST(split_part(stat, '-', 2) AS DOUBLE) AS attempted FROM t""")
def s15_composite_stats(spark, sf_dir):
    stat = D.games(spark, sf_dir).select("game_id", F.concat_ws("-", F.col("home_pts").cast("string"), (F.col("home_pts") + F.col("away_pts")).cast("string")).alias("stat"))
    parts = F.split("stat", "-")
    return stat.select("game_id", parts[0].try_cast("double").alias("made"), parts[1].try_cast("double").alias("attempted"))


@query(f"""WITH {D.GAMES_SQL}, {D.OFFICIALS_SQL}, {D.ROSTERS_SQL}, p AS (SELECT game_id, 'games' AS t FROM games UNION SELECT game_id, 'officials' FROM officials UNION SELECT game_id, 'rosters' FROM rosters WHERE side = 1)
SELECT game_id, count(*) = 3 AS complete, CASE WHEN count(*) = 3 THEN '' ELSE array_to_string(list_filter(['games', 'officials', 'rosters'], lambda x: NOT list_contains(list(t), x)), ',') END AS missing FROM p GROUP BY 1""")
def s24_completeness(spark, sf_dir):
    """Which of the required tables each game lacks."""
    required = F.array(F.lit("games"), F.lit("officials"), F.lit("rosters"))
    parts = [D.games(spark, sf_dir).select("game_id", F.lit("games").alias("t")), D.officials(spark, sf_dir).select("game_id", F.lit("officials").alias("t")), D.rosters(spark, sf_dir).where("side = 1").select("game_id", F.lit("rosters").alias("t"))]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("game_id").agg(F.collect_set("t").alias("have"))
    missing = F.array_except(required, "have")
    return found.select("game_id", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"))


@query(f"""WITH {D.GAMES_SQL}, done AS (SELECT game_id FROM games WHERE game_id % 5 > 0 AND game_date < DATE '1999-01-01'), w AS (SELECT max(game_date) AS mark FROM games JOIN done USING (game_id))
SELECT game_id, game_date > mark AS after_mark FROM games, w WHERE game_id NOT IN (SELECT game_id FROM done)""")
def j11_missing_games(spark, sf_dir):
    g = D.games(spark, sf_dir).select("game_id", "game_date")
    done = g.where("game_id % 5 > 0 AND game_date < DATE '1999-01-01'")
    mark = done.agg(F.max("game_date").alias("mark"))
    return g.join(done.select("game_id"), "game_id", "left_anti").crossJoin(F.broadcast(mark)).select("game_id", (F.col("game_date") > F.col("mark")).alias("after_mark"))


@query(f"""{_GN}, k AS (SELECT game_id, 'GAME-' || strftime(game_date, '%Y%m%d') || '-' || a.abbr || h.abbr AS ticker FROM games JOIN n h ON h.team_id = home_team_id JOIN n a ON a.team_id = away_team_id)
SELECT game_id, ticker, strptime(substr(ticker, 6, 8), '%Y%m%d')::DATE AS day, least(substr(ticker, 15, 3), substr(ticker, 18, 3)) AS first_team, greatest(substr(ticker, 15, 3), substr(ticker, 18, 3)) AS second_team FROM k""")
def f15_j12_j23_tickers(spark, sf_dir):
    """Tickers made and parsed again into a day and an unordered pair."""
    g = D.games(spark, sf_dir).join(_abbreviated(spark, sf_dir, "home"), "home_team_id").join(_abbreviated(spark, sf_dir, "away"), "away_team_id")
    t = g.select("game_id", F.concat(F.lit("GAME-"), F.date_format("game_date", "yyyyMMdd"), F.lit("-"), "away_abbr", "home_abbr").alias("ticker"))
    part = lambda k: F.regexp_extract("ticker", r"^GAME-(\d{8})-(T\d{2})(T\d{2})$", k)
    return t.select("game_id", "ticker", F.to_date(part(1), "yyyyMMdd").alias("day"), F.least(part(2), part(3)).alias("first_team"), F.greatest(part(2), part(3)).alias("second_team"))


@query(f"""WITH {D.RATINGS_SQL}, a AS (SELECT * FROM snaps WHERE team_id % 4 > 0), b AS (SELECT team_id, as_of_date, rating + team_id % 3 AS rating FROM snaps WHERE team_id % 5 > 0)
SELECT coalesce(a.team_id, b.team_id) AS team_id, coalesce(a.as_of_date, b.as_of_date) AS day, concat_ws('|', CASE WHEN a.team_id IS NULL THEN 'no_a' END, CASE WHEN b.team_id IS NULL THEN 'no_b' END, CASE WHEN round(abs(a.rating - b.rating), 4) > 1 THEN 'differs' END) AS flags
FROM a FULL JOIN b ON a.team_id = b.team_id AND a.as_of_date = b.as_of_date""")
def j17_rating_audit(spark, sf_dir):
    """Days that one of two rating tables lacks or on which they differ by more than 1, told in the ratings' own four digits.

    Where a rating plus 1 passes a power of two the difference in doubles is a little more or less than 1; unrounded, the
    last bit of a rating (and so the order of its sum) would decide. Ratings are averaged once and written: averaged for
    each table anew, in another order, those on a rounding tie would differ from themselves in the fourth digit. A day whose
    rating is null is there all the same.
    """
    s = materialize(D.rating_snapshots(spark, sf_dir), "ratings")
    a = s.where("team_id % 4 > 0").select("team_id", "as_of_date", F.col("rating").alias("ra"), F.lit(True).alias("in_a"))
    b = s.where("team_id % 5 > 0").select("team_id", "as_of_date", (F.col("rating") + F.col("team_id") % 3).alias("rb"), F.lit(True).alias("in_b"))
    both = a.join(b, ["team_id", "as_of_date"], "full_outer")
    flags = F.concat_ws("|", F.when(F.col("in_a").isNull(), "no_a"), F.when(F.col("in_b").isNull(), "no_b"), F.when(F.round(F.abs(F.col("ra") - F.col("rb")), 4) > 1, "differs"))
    return both.select("team_id", F.col("as_of_date").alias("day"), flags.alias("flags"))


@query(f"""WITH {D.GAMES_SQL}, t AS (SELECT home_team_id AS team_id, season, max(game_id) AS last_game FROM games GROUP BY 1, 2) SELECT team_id, season, last_game FROM t QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY season DESC) = 1""")
def j24_team_dimension(spark, sf_dir):
    t = D.games(spark, sf_dir).groupBy(F.col("home_team_id").alias("team_id"), "season").agg(F.max("game_id").alias("last_game"))
    return keep_last(t, ["team_id"], F.col("season"))


@query("""WITH a AS (SELECT user_id AS ticker, max_by(event_type, event_id) AS status, max_by(value, event_id) AS price FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT user_id AS ticker, max_by(event_type, event_id) AS status, max_by(value, event_id) AS price FROM events WHERE event_id % 2 = 1 AND user_id % 3 > 0 GROUP BY 1)
SELECT coalesce(a.ticker, c.ticker) AS ticker, coalesce(a.status, c.status) AS status, coalesce(c.price, a.price) AS price FROM a FULL JOIN c ON a.ticker = c.ticker WHERE a.ticker IS NOT NULL OR c.status = 'click'""")
def j26_position_merge(spark, sf_dir):
    """Fresh positions replace cached ones, which give the entry price; cached ones that are absent stay only in one status."""
    e = table(spark, sf_dir, "events")

    def side(rows, name):
        return rows.groupBy(F.col("user_id").alias("ticker")).agg(F.max_by("event_type", "event_id").alias(f"status_{name}"), F.max_by("value", "event_id").alias(f"price_{name}"))

    both = side(e.where("event_id % 2 = 0"), "a").join(side(e.where("event_id % 2 = 1 AND user_id % 3 > 0"), "c"), "ticker", "full_outer")
    return both.where("status_a IS NOT NULL OR status_c = 'click'").select("ticker", F.coalesce("status_a", "status_c").alias("status"), F.coalesce("price_c", "price_a").alias("price"))


@query(f"""WITH {D.GAMES_SQL}, a AS (SELECT game_id FROM games WHERE game_id % 2 = 0), b AS (SELECT game_id FROM games WHERE game_id % 3 = 0)
SELECT game_id, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT game_id, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT game_id, 'kept' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def o6_o7_schedule_changes(spark, sf_dir):
    g = D.games(spark, sf_dir).select("game_id")
    a, b = g.where("game_id % 2 = 0"), g.where("game_id % 3 = 0")
    tag = lambda d, t: d.withColumn("change", F.lit(t))
    return tag(b.subtract(a), "added").unionByName(tag(a.subtract(b), "removed")).unionByName(tag(a.intersect(b), "kept"))


@query(f"""WITH {D.GAMES_SQL}, e AS (SELECT quantile_cont(attendance, [0.2, 0.4, 0.6, 0.8]) AS q FROM games) SELECT game_id, CAST(len(list_filter(q, lambda x: x < attendance)) AS INT) AS fifth FROM games, e""")
def w25_quantile_bins(spark, sf_dir):
    """Bins by quantile edges; equal values share a bin."""
    g = D.games(spark, sf_dir).select("game_id", "attendance")
    edges = F.array(*map(F.lit, exact_quantiles(g, F.col("attendance"), [0.2, 0.4, 0.6, 0.8])))
    return g.select("game_id", F.size(F.filter(edges, lambda x: x < F.col("attendance"))).alias("fifth"))


@query("""WITH c AS (SELECT 100 * count(value) / count(*)::DOUBLE AS v, 100 * count(CASE WHEN event_type <> 'error' THEN props END) / count(*)::DOUBLE AS p FROM events) SELECT 'value' AS "column", round(v, 6) AS coverage FROM c UNION ALL SELECT 'props', round(p, 6) FROM c""")
def a26_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").agg((100 * F.count("value") / F.count("*")).alias("value"), (100 * F.count(F.when(F.col("event_type") != "error", F.col("props"))) / F.count("*")).alias("props"))
    return e.unpivot([], ["value", "props"], "column", "coverage").select("column", F.round("coverage", 6).alias("coverage"))


@query("SELECT l_orderkey AS game_id, l_suppkey % 100 AS rated, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def o3_o4_best_by_game(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "game_id"})
    best = li.groupBy("game_id").agg(F.min(F.struct(-F.col("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")).alias("b"))
    return best.select("game_id", (F.col("b.l_suppkey") % 100).alias("rated"), F.col("b.l_linenumber").alias("line"))
