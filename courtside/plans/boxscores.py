"""Box scores, identities, ladders and reports."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from courtside.operators import boxscores as B
from courtside.operators import windows as W
from courtside.operators.joins import upsert_new
from courtside.operators.quality import all_null
from courtside.plans.registry import query
from courtside.shared import fresh_path
from courtside.sources import domain as D
from courtside.tables import table


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


_T, _G, _H, _O = f"WITH {D.TAPE_SQL}", f"WITH {D.GAMES_SQL}", f"WITH {D.HISTORY_SQL}", f"WITH {D.OOF_SQL}"

_BOX_SQL = f"""WITH {D.GAMES_SQL},
l AS (SELECT l_orderkey AS game_id, CAST(l_linenumber % 2 AS INT) AS side, l_quantity AS q, l_discount AS d, l_returnflag AS f FROM lineitem),
a AS (SELECT game_id, side, round(avg(q), 4) AS fgpct, count(*) AS tov FROM l GROUP BY 1, 2),
b AS (SELECT game_id, side, sum(CASE WHEN f = 'R' THEN 1 ELSE -1 END)::BIGINT AS plus_minus FROM l WHERE f <> 'A' GROUP BY 1, 2),
c AS (SELECT game_id, side, round(max(d), 4) AS ft_rate FROM l WHERE q > 10 GROUP BY 1, 2),
box AS (SELECT a.game_id, a.side, fgpct, tov, plus_minus, ft_rate, season_type FROM a LEFT JOIN b USING (game_id, side) LEFT JOIN c USING (game_id, side) JOIN games USING (game_id))"""


def _box(spark, sf_dir):
    """Three categories of a box score on (game, side), with the names that files have, for both season types."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), (F.col("l_linenumber") % 2).cast("int").alias("side"), "l_quantity", "l_discount", "l_returnflag")
    keys = ["game_id", "side"]
    a = rows.groupBy(*keys).agg(F.round(F.avg("l_quantity"), 4).alias("FG%"), F.count("*").alias("TOV"))
    b = rows.where("l_returnflag <> 'A'").groupBy(*keys).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(-1)).alias("+/-"))
    c = rows.where("l_quantity > 10").groupBy(*keys).agg(F.round(F.max("l_discount"), 4).alias("FT RATE"), F.count("*").alias("TOV"))
    box = B.joined_categories([B.normalized(x) for x in (a, b, c)], keys)
    return box.join(D.games(spark, sf_dir).select("game_id", "season_type"), "game_id")


@query(f"{_BOX_SQL} SELECT game_id, side, fgpct, tov, plus_minus, ft_rate, season_type FROM box")
def s1_p2_box_scores(spark, sf_dir):
    return _box(spark, sf_dir).select("game_id", "side", "fgpct", "tov", "plus_minus", "ft_rate", "season_type")


@query(f"{_BOX_SQL} SELECT h.game_id, h.fgpct AS home_fgpct, a.fgpct AS away_fgpct, h.tov AS home_tov, a.tov AS away_tov, h.plus_minus AS home_plus_minus, a.plus_minus AS away_plus_minus FROM box h JOIN box a USING (game_id) WHERE h.side = 1 AND a.side = 0")
def j1_game_rows(spark, sf_dir):
    rows = B.game_rows(_box(spark, sf_dir).select("game_id", "side", "fgpct", "tov", "plus_minus"), "game_id", F.col("side") == 1)
    return rows.drop("home_side", "away_side")


@query(f"{_H} SELECT h.game_id, h.season, h.pf - a.pf AS spread, h.pf + a.pf AS total FROM history h JOIN history a USING (game_id) WHERE h.is_away = 0 AND a.is_away = 1")
def j25_game_scores(spark, sf_dir):
    history = D.team_history(D.games(spark, sf_dir)).select("game_id", "season", "is_away", "pf")
    rows = B.game_rows(history, "game_id", F.col("is_away") == 0)
    return rows.select("game_id", F.col("home_season").alias("season"), (F.col("home_pf") - F.col("away_pf")).alias("spread"), (F.col("home_pf") + F.col("away_pf")).alias("total"))


@query(f"WITH {D.ROSTERS_SQL} SELECT game_id, player_id, CAST(side AS INT) AS team_side, CASE WHEN inactive THEN 'INACTIVE' END AS status FROM rosters")
def s5_player_status(spark, sf_dir):
    return D.rosters(spark, sf_dir).select("game_id", "player_id", F.col("side").cast("int").alias("team_side"), F.when(F.col("inactive"), "INACTIVE").alias("status"))


@query("""WITH n AS (SELECT o_orderkey AS game_id, CASE o_orderkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' stars' WHEN 2 THEN substr(n_name, 1, 4) ELSE 'nobody' END AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT DISTINCT name FROM n), x AS (SELECT name, min(n_nationkey) AS id FROM d JOIN nation ON lower(name) = lower(n_name) GROUP BY 1),
y AS (SELECT name, min(n_nationkey) AS id FROM d JOIN nation ON contains(lower(name), lower(n_name)) OR contains(lower(n_name), lower(name)) WHERE name NOT IN (SELECT name FROM x) GROUP BY 1)
SELECT game_id, name, CAST(coalesce(x.id, y.id) AS BIGINT) AS team_id FROM n LEFT JOIN x USING (name) LEFT JOIN y USING (name)""")
def j4_team_names(spark, sf_dir):
    """Team ids by name, with containment either way where no name is equal."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), "n_name")
    homes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("team_id"))
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lower("n_name"), F.lit(" stars"))).when(k == 2, F.substring("n_name", 1, 4)).otherwise("nobody")
    rows = homes.select(F.col("o_orderkey").alias("game_id"), name.alias("name"))
    return rows.join(B.named_ids(rows, nations, "name", "n_name", "team_id"), "name", "left").select("game_id", "name", "team_id")


@query(f"""{_G}, l AS (SELECT l_orderkey AS game_id, l_linenumber % 2 AS side, CASE WHEN l_linenumber % 3 > 0 THEN CASE WHEN l_linenumber % 2 = 1 THEN home_team_id ELSE away_team_id END END AS team_id, l_quantity AS deflections, home_team_id, away_team_id FROM lineitem JOIN games ON game_id = l_orderkey)
SELECT game_id, coalesce(team_id, CASE WHEN side = 1 THEN home_team_id ELSE away_team_id END) AS team_id, sum(deflections)::DOUBLE AS deflections, count(*) AS players FROM l GROUP BY 1, 2""")
def j9_a6_hustle_sums(spark, sf_dir):
    """Players' hustle counts by team: the team id where it is known, else that of the player's side of the game."""
    games = D.games(spark, sf_dir).select("game_id", "home_team_id", "away_team_id")
    side = F.col("l_linenumber") % 2
    players = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), side.alias("side"), F.col("l_linenumber").alias("slot"), F.col("l_quantity").cast("double").alias("deflections"))
    sides = games.select("game_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("home_team_id").alias("of_side")), F.struct(F.lit(0).alias("side"), F.col("away_team_id").alias("of_side")))).alias("s")).select("game_id", "s.*")
    known = players.join(games, "game_id").withColumn("team_id", F.when(F.col("slot") % 3 > 0, F.when(F.col("side") == 1, F.col("home_team_id")).otherwise(F.col("away_team_id"))))
    resolved = known.select("game_id", "side", "team_id", "deflections").join(sides, ["game_id", "side"], "left")
    return resolved.groupBy("game_id", F.coalesce("team_id", "of_side").alias("team_id")).agg(F.sum("deflections").alias("deflections"), F.count("*").alias("players"))


@query(f"""WITH {D.QUARTERS_SQL} SELECT game_id, CASE WHEN team_id = home_team_id THEN 'home' ELSE 'away' END AS side, CAST(substr(period_label, 2) AS INT) AS slot, period_score AS score, period_score * 4 AS pace FROM quarters JOIN games USING (game_id)""")
def a32_wide_to_long(spark, sf_dir):
    """Columns ``stat.side.slot`` as rows (side, slot) with a column for each stat."""
    games = D.games(spark, sf_dir)
    wide = ["game_id"]
    for side in ("home", "away"):
        part = F.floor(F.col(f"{side}_pts") / 4).cast("long")
        for slot in range(1, 5):
            score = part if slot < 4 else F.col(f"{side}_pts") - 3 * part
            wide += [score.alias(f"score.{side}.{slot}"), (score * 4).alias(f"pace.{side}.{slot}")]
    wide = games.select(*wide)
    long = wide.unpivot(["game_id"], [F.col(f"`{c}`") for c in wide.columns[1:]], "name", "value").withColumn("part", F.split("name", r"\."))
    long = long.select("game_id", F.get("part", F.lit(1)).alias("side"), F.get("part", F.lit(2)).cast("int").alias("slot"), F.get("part", F.lit(0)).alias("stat"), "value")
    return long.groupBy("game_id", "side", "slot").pivot("stat", ["score", "pace"]).agg(F.first("value"))


@query(f"""{_G}, k AS (SELECT game_date, home_team_id, CASE WHEN count(*) = 1 THEN max(game_id) END AS found FROM games GROUP BY 1, 2)
SELECT game_id, strftime(game_date, '%Y%m%d') || '/' || home_team_id AS game_code, found FROM games JOIN k USING (game_date, home_team_id)""")
def j10_backfilled_ids(spark, sf_dir):
    """Game ids by the date and team of a code; a key that several games have gives none, so rows are never multiplied."""
    games = D.games(spark, sf_dir)
    lookup = B.unique_lookup(games.select(F.date_format("game_date", "yyyyMMdd").alias("day"), F.col("home_team_id").cast("string").alias("team"), F.col("game_id").alias("found")), ["day", "team"], "found")
    coded = games.select("game_id", F.concat_ws("/", F.date_format("game_date", "yyyyMMdd"), F.col("home_team_id").cast("string")).alias("game_code"))
    keyed = coded.withColumn("day", F.substring("game_code", 1, 8)).withColumn("team", F.split_part("game_code", F.lit("/"), F.lit(2)))
    return keyed.join(lookup, ["day", "team"], "left").select("game_id", "game_code", "found")


@query(f"""{_G}, a AS (SELECT DISTINCT home_team_id AS id_a, substr(n_name, 1, 5) AS franchise FROM games JOIN nation ON n_nationkey = home_team_id), b AS (SELECT DISTINCT 1000 + s_nationkey AS id_b, substr(n_name, 1, 5) AS franchise FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT DISTINCT franchise, id_a, CAST(id_b AS BIGINT) AS id_b FROM a JOIN b USING (franchise)""")
def j19_franchise_crosswalk(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.substring("n_name", 1, 5).alias("franchise"))
    a = D.games(spark, sf_dir).select(F.col("home_team_id").alias("n")).distinct().join(nation, "n").select("franchise", F.col("n").alias("id_a"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("n")).distinct().join(nation, "n").select("franchise", (1000 + F.col("n")).alias("id_b"))
    return a.join(b, "franchise").distinct()


@query(f"""{_O}, p AS (SELECT game_id, line, max(CASE WHEN line % 2 = 1 THEN pred_a END) AS held_out, max(CASE WHEN line % 3 < 2 THEN pred_b END) AS inferred FROM oof GROUP BY 1, 2)
SELECT game_id, line, round(coalesce(held_out, inferred) + 1e-9::DOUBLE, 6) AS prediction, held_out IS NOT NULL AS is_oof FROM p WHERE coalesce(held_out, inferred) IS NOT NULL""")
def j22_coalesced_predictions(spark, sf_dir):
    """Out-of-fold values first, inferred ones for keys without (the largest, where a key repeats); keys with neither go."""
    o = D.oof(spark, sf_dir)
    keys = ["game_id", "line"]
    held = o.where("line % 2 = 1").groupBy(*keys).agg(F.max("pred_a").alias("held_out"))
    inferred = o.where("line % 3 < 2").groupBy(*keys).agg(F.max("pred_b").alias("inferred"))
    joined = o.select(*keys).distinct().join(held, keys, "left").join(inferred, keys, "left").where("coalesce(held_out, inferred) IS NOT NULL")
    return joined.select(*keys, _r(F.coalesce("held_out", "inferred") + 1e-9, "prediction"), F.col("held_out").isNotNull().alias("is_oof"))


@query(f"{_O}, {D.GAMES_SQL} SELECT games.season AS season, count(*) AS n, round(avg(abs(pred_a - y_true)), 6) AS mae FROM oof JOIN games USING (game_id) GROUP BY 1")
def a36_season_of_predictions(spark, sf_dir):
    """Seasons of out-of-fold rows come from their games, by id."""
    o = D.oof(spark, sf_dir).select("game_id", F.abs(F.col("pred_a") - F.col("y_true")).alias("e"))
    return o.join(D.games(spark, sf_dir).select("game_id", "season"), "game_id").groupBy("season").agg(F.count("*").alias("n"), _r(F.avg("e"), "mae"))


def _t_sql(t: str) -> str:
    """Student's t distribution function with 4 degrees of freedom in closed form."""
    s = f"(({t}) / sqrt(4 + ({t}) * ({t})))"
    return f"(0.5 + 0.5 * {s} * (1 + 0.5 * (1 - {s} * {s})))"


@query(f"""{_O}, b AS (SELECT least(9, CAST(floor(prob * 10) AS INT)) AS bin, prob, label, {_t_sql('(pred_a - 15) / 2.0::DOUBLE')} AS modelled FROM oof)
SELECT bin, count(*) AS n, round(avg(label), 6) AS empirical, round(avg(modelled), 6) AS modelled, round(avg(label) - avg(modelled), 6) AS bias FROM b GROUP BY 1 HAVING count(*) >= 50""")
def a24_bias_table(spark, sf_dir):
    """Empirical against modelled rate (t distributed residuals) in each bin of predictions with 50 rows at least."""
    o = D.oof(spark, sf_dir).select(F.least(F.lit(9), F.floor(F.col("prob") * 10).cast("int")).alias("bin"), "label", B.student_t_cdf((F.col("pred_a") - 15) / 2.0, 4).alias("m"))
    return o.groupBy("bin").agg(F.count("*").alias("n"), _r(F.avg("label"), "empirical"), _r(F.avg("m"), "modelled"), _r(F.avg("label") - F.avg("m"), "bias")).where("n >= 50")


@query(f"""{_O}, r AS (SELECT round(y_true - pred_a, 9) AS e FROM oof), s AS (SELECT count(*) AS n, stddev_samp(e) / sqrt(2.0::DOUBLE) AS scale FROM r),
d AS (SELECT k / 10.0::DOUBLE AS delta, count(CASE WHEN e > k / 10.0::DOUBLE + 1e-6::DOUBLE THEN 1 END) AS above FROM r, generate_series(-10, 10, 2) AS t(k) GROUP BY k)
SELECT delta, above, round(CASE WHEN above < 20 OR n - above < 20 THEN 1 - {_t_sql('delta / scale')} ELSE above / n::DOUBLE END, 5) AS survival FROM d, s""")
def l10_u4_survival(spark, sf_dir):
    """Survival of residuals: counted where 20 values lie on both sides, else the tail of a scaled t distribution."""
    r = D.oof(spark, sf_dir).select(F.round(F.col("y_true") - F.col("pred_a"), 9).alias("e"))
    s = r.agg(F.count("*").alias("n"), (F.stddev_samp("e") / 2**0.5).alias("scale"))
    d = r.select("e", F.explode(F.array(*[F.lit(k / 10) for k in range(-10, 11, 2)])).alias("delta")).groupBy("delta").agg(F.count_if(F.col("e") > F.col("delta") + 1e-6).alias("above"))
    tail = 1 - B.student_t_cdf(F.col("delta") / F.col("scale"), 4)
    body = F.col("above") / F.col("n")
    return d.crossJoin(F.broadcast(s)).select("delta", "above", _r(F.when((F.col("above") < 20) | (F.col("n") - F.col("above") < 20), tail).otherwise(body), "survival", 5))


@query(f"""{_H}, w AS (SELECT team_id, game_id, count(pf) OVER w AS n, avg(pf) OVER w AS off, avg(pa) OVER w AS def, stddev_samp(pa) OVER w AS sd FROM history WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT g.game_id, round(h.off - a.def - (a.off - h.def), 6) AS matchup_advantage, CASE WHEN h.sd > 0 THEN round(h.def / h.sd, 5) END AS home_consistency, CASE WHEN a.sd > 0 THEN round(a.def / a.sd, 5) END AS away_consistency,
round(2 * (g.home_pts // 4) / g.home_pts::DOUBLE, 6) AS home_half_rate, round(attendance / 20000.0::DOUBLE * (h.off - h.def), 6) AS crowd_pressure
FROM games g JOIN w h ON h.game_id = g.game_id AND h.team_id = g.home_team_id JOIN w a ON a.game_id = g.game_id AND a.team_id = g.away_team_id""")
def f6_f8_f10_f11_game_features(spark, sf_dir):
    """Offence against defence over the last ten games, consistency of defence, first-half share of points, crowd pressure."""
    games, w = D.games(spark, sf_dir), W.lagged(10, "team_id", W.BLOCK)
    h = W.own_rows(W.in_blocks(D.team_history(games), 10, "team_id"), "team_id", "game_id", F.avg("pf").over(w).alias("off"), F.avg("pa").over(w).alias("def"), F.stddev_samp("pa").over(w).alias("sd"))
    g = W.to_games(games, h, ["off", "def", "sd"])
    c = F.col
    return g.select(
        "game_id",
        _r(c("home_off") - c("away_def") - (c("away_off") - c("home_def")), "matchup_advantage"),
        *[F.when(c(f"{s}_sd") > 0, F.round(c(f"{s}_def") / c(f"{s}_sd"), 5)).alias(f"{s}_consistency") for s in ("home", "away")],
        _r(2 * F.floor(c("home_pts") / 4) / c("home_pts"), "home_half_rate"),
        _r(c("attendance") / 20000.0 * (c("home_off") - c("home_def")), "crowd_pressure"),
    )


#: Abbreviations that changed, with the first season of the new one.
_ERAS = [("ALG", "ALR", 1995), ("BRA", "BRZ", 1994), ("CHI", "CHN", 1996)]


@query(f"""{_G}, t AS (SELECT game_id, season, upper(substr(n_name, 1, 3)) AS raw FROM games JOIN nation ON n_nationkey = home_team_id)
SELECT game_id, raw, CASE {" ".join(f"WHEN raw = '{a}' AND season >= {y} THEN '{b}'" for a, b, y in _ERAS)} ELSE raw END AS abbr FROM t""")
def f16_abbreviations_by_era(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("home_team_id"), F.upper(F.substring("n_name", 1, 3)).alias("raw"))
    eras = spark.createDataFrame(_ERAS, "raw string, later string, since long")  # a rule table
    rows = D.games(spark, sf_dir).select("game_id", "season", "home_team_id").join(names, "home_team_id").join(F.broadcast(eras), "raw", "left")
    return rows.select("game_id", "raw", F.when(F.col("season") >= F.col("since"), F.col("later")).otherwise(F.col("raw")).alias("abbr"))


@query("""WITH s AS (SELECT event_id, upper(event_type) || CASE WHEN event_id % 2 = 0 THEN ' over ' ELSE ' under -' END || CAST(round(least(value, 99)) AS INT) || '.5' AS signal FROM events),
t AS (SELECT event_id, signal, CAST(regexp_extract(signal, '(-?[0-9]+[.]5)', 1) AS DOUBLE) AS threshold FROM s)
SELECT event_id, threshold, CASE WHEN starts_with(signal, 'PURCHASE') THEN 'winner' WHEN threshold < 0 THEN 'spread-against' WHEN threshold < 10 THEN 'spread-close' ELSE 'total' END AS cluster FROM t""")
def f21_signal_clusters(spark, sf_dir):
    """The signed threshold in a signal's text, and the cluster that its type and threshold belong to."""
    sign = F.when(F.col("event_id") % 2 == 0, " over ").otherwise(" under -")
    s = table(spark, sf_dir, "events").select("event_id", F.concat(F.upper("event_type"), sign, F.round(F.least("value", F.lit(99.0))).cast("int").cast("string"), F.lit(".5")).alias("signal"))
    t = s.withColumn("threshold", F.regexp_extract("signal", r"(-?[0-9]+[.]5)", 1).cast("double"))
    cluster = F.when(F.startswith("signal", F.lit("PURCHASE")), "winner").when(F.col("threshold") < 0, "spread-against").when(F.col("threshold") < 10, "spread-close").otherwise("total")
    return t.select("event_id", "threshold", cluster.alias("cluster"))


@query(f"""{_T}, e AS (SELECT ticker, yes_price AS p, actual_win AS w, CASE WHEN yes_price < 0.5 THEN 'fade' ELSE 'back' END AS side FROM tape)
SELECT ticker, side, count(*) AS n, round(sum(CASE WHEN side = 'back' THEN w - p ELSE p - w END), 5) AS pnl FROM e GROUP BY 1, 2""")
def f22_back_and_fade(spark, sf_dir):
    """Profit of each market from backing favourites at their price and fading the others."""
    t = D.tape(spark, sf_dir).select("ticker", F.col("yes_price").alias("p"), F.col("actual_win").alias("w"), F.when(F.col("yes_price") < 0.5, "fade").otherwise("back").alias("side"))
    return t.groupBy("ticker", "side").agg(F.count("*").alias("n"), _r(F.sum(F.when(F.col("side") == "back", F.col("w") - F.col("p")).otherwise(F.col("p") - F.col("w"))), "pnl", 5))


@query(f"""{_T}, m AS (SELECT ticker, round(40 * avg(yes_price) - 20, 6) AS predicted, round(avg(yes_price), 6) AS mid FROM tape GROUP BY 1),
l AS (SELECT ticker, CAST(k AS INT) AS threshold, {_t_sql('(predicted - k) / 6.0::DOUBLE')} AS prob, least(0.97::DOUBLE, greatest(0.03::DOUBLE, mid - k / 50.0::DOUBLE)) AS ask FROM m, generate_series(-10, 10, 5) AS t(k)),
s AS (SELECT ticker, threshold, 'yes' AS side, prob, ask AS price FROM l UNION ALL SELECT ticker, threshold, 'no', 1 - prob, 1 - ask FROM l),
e AS (SELECT *, prob - price - ceil(round(7.0::DOUBLE * price * (1 - price), 8)) / 100 AS edge FROM s)
SELECT ticker, threshold, side, round(prob, 6) AS prob, round(price, 6) AS price, round(edge, 6) AS edge FROM e WHERE edge > 0.0300001""")
def b9_b12_u5_ladder_signals(spark, sf_dir):
    """Each market's ladder of thresholds, both sides, against t distributed outcomes around its prediction; edges after fees."""
    m = D.tape(spark, sf_dir).groupBy("ticker").agg(F.round(40 * F.avg("yes_price") - 20, 6).alias("predicted"), F.round(F.avg("yes_price"), 6).alias("mid"))
    ladder = m.select("ticker", "predicted", "mid", F.explode(F.sequence(F.lit(-10), F.lit(10), F.lit(5))).alias("threshold"))
    prob = B.student_t_cdf((F.col("predicted") - F.col("threshold")) / 6.0, 4)
    l = ladder.select("ticker", "threshold", prob.alias("p"), F.least(F.lit(0.97), F.greatest(F.lit(0.03), F.col("mid") - F.col("threshold") / 50.0)).alias("ask"))
    sides = F.array(F.struct(F.lit("yes").alias("side"), F.col("p").alias("prob"), F.col("ask").alias("price")), F.struct(F.lit("no").alias("side"), (1 - F.col("p")).alias("prob"), (1 - F.col("ask")).alias("price")))
    s = l.select("ticker", "threshold", F.explode(sides).alias("s")).select("ticker", "threshold", "s.*")
    edge = F.col("prob") - F.col("price") - F.ceil(F.round(7.0 * F.col("price") * (1 - F.col("price")), 8)) / 100
    return s.withColumn("edge", edge).where("edge > 0.0300001").select("ticker", "threshold", "side", _r(F.col("prob"), "prob"), _r(F.col("price"), "price"), _r(F.col("edge"), "edge"))


@query(f"""{_T}, x AS (SELECT ticker, count(*) AS n_trades, sum(size) AS volume, round(avg(yes_price), 6) AS mean_price, max(actual_win) AS win FROM tape GROUP BY 1),
g AS (SELECT ticker % 20 AS game, ticker, n_trades, volume, mean_price, win FROM x)
SELECT game, count(*) AS markets, sum(n_trades)::BIGINT AS trades, sum(volume)::BIGINT AS volume, round(avg(win - mean_price), 6) AS mean_return FROM g GROUP BY 1""")
def b13_game_summaries(spark, sf_dir):
    """The tape by market, then by the game that markets belong to."""
    t = D.tape(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.round(F.avg("yes_price"), 6).alias("price"), F.max("actual_win").alias("win"))
    return t.groupBy((F.col("ticker") % 20).alias("game")).agg(F.count("*").alias("markets"), F.sum("n").alias("trades"), F.sum("volume").alias("volume"), _r(F.avg(F.col("win") - F.col("price")), "mean_return"))


@query("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 25 END AS h, o_orderkey % 25 AS a, CASE o_orderkey % 5 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'x' END AS neutral FROM orders)
SELECT CAST(id AS BIGINT) AS game_id, h AS home_team_id, a AS away_team_id, coalesce(lower(trim(neutral)) IN ('true', '1', 'yes', 'y', 't'), false) AS is_neutral FROM r WHERE h IS NOT NULL AND h <> a""")
def p4_normalized_games(spark, sf_dir):
    """Game rows with typed keys and flags read from text; rows without a key, or of a team against itself, go."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, " TRUE").when(k % 5 == 1, "no").when(k % 5 == 2, "1").when(k % 5 == 3, "x")
    raw = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.when(k % 9 > 0, F.col("o_custkey") % 25).alias("h"), (k % 25).alias("a"), text.alias("neutral"))
    flag = F.coalesce(F.lower(F.trim("neutral")).isin("true", "1", "yes", "y", "t"), F.lit(False))
    return raw.dropna(subset=["id", "h", "a"]).where("h <> a").select(F.col("id").cast("long").alias("game_id"), F.col("h").alias("home_team_id"), F.col("a").alias("away_team_id"), flag.alias("is_neutral"))


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'TOTAL ' ELSE '' END || n_name AS team, strftime(o_orderdate, '%Y-%m-%d') AS day, round(60 + o_totalprice / 8000, 2) AS rating FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT team, day, max(rating) AS rating FROM r WHERE regexp_matches(day, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND rating > 60 AND rating < 110 AND NOT regexp_matches(lower(team), 'total|average|rank') AND length(team) BETWEEN 3 AND 30 GROUP BY 1, 2""")
def p15_plausible_ratings(spark, sf_dir):
    """Ratings in a plausible range of rows that name a team and a day; the best of each team and day."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = rows.select(F.concat(F.when(F.col("o_orderkey") % 11 == 0, "TOTAL ").otherwise(""), "n_name").alias("team"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.round(60 + F.col("o_totalprice") / 8000, 2).alias("rating"))
    fits = F.col("day").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.col("rating") > 60) & (F.col("rating") < 110) & ~F.lower("team").rlike("total|average|rank") & F.length("team").between(3, 30)
    return raw.where(fits).groupBy("team", "day").agg(F.max("rating").alias("rating"))


@query(f"""{_O}, s AS (SELECT DISTINCT season FROM oof ORDER BY 1 DESC LIMIT 3)
SELECT game_id, line, season, CAST(round(100 * prob, 1) AS DOUBLE) AS prob_pct, label FROM oof WHERE season IN (SELECT season FROM s) AND y_true IS NOT NULL""")
def p22_p23_p28_model_matrix(spark, sf_dir):
    """The last three seasons' rows with a target, shares as percentages and a typed label."""
    o = D.oof(spark, sf_dir)
    last = F.broadcast(o.select("season").distinct().orderBy(F.desc("season")).limit(3))  # three rows
    return o.join(last, "season", "left_semi").where("y_true IS NOT NULL").select("game_id", "line", "season", _r(100 * F.col("prob"), "prob_pct", 1), "label")


@query("""SELECT page_id, CAST(len(regexp_extract_all(coalesce(url, ''), '[0-9]+')) AS INT) AS numbers, CAST(len(regexp_extract_all(coalesce(html, ''), '=[ ]*"[0-9]')) AS INT) AS numeric_attributes FROM pages""")
def p25_structural_fingerprint(spark, sf_dir):
    n = lambda c, p: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)))
    return table(spark, sf_dir, "pages").select("page_id", n("url", "[0-9]+").alias("numbers"), n("html", '=[ ]*"[0-9]').alias("numeric_attributes"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'id'))), ',') AS added, array_to_string(list_sort(list_filter(['id', 'k'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing FROM events WHERE props IS NOT NULL""")
def p27_key_differences(spark, sf_dir):
    """Top-level keys of each document that a reference document lacks, and the other way round."""
    keys, known = F.json_object_keys("props"), F.array(F.lit("id"), F.lit("k"))
    joined = lambda x: F.array_join(F.sort_array(x), ",")
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", joined(F.array_except(keys, known)).alias("added"), joined(F.array_except(known, keys)).alias("missing"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 6 > 0 THEN value END AS a, CASE WHEN event_id % 4 > 0 THEN event_type END AS b FROM events) SELECT event_id, a, b FROM r WHERE a IS NOT NULL OR b IS NOT NULL""")
def p9_drop_empty(spark, sf_dir):
    """Columns and rows without any value go."""
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select("event_id", F.when(k % 6 > 0, F.col("value")).alias("a"), F.when(k % 4 > 0, F.col("event_type")).alias("b"), F.lit(None).cast("string").alias("c"))
    values = ["a", "b", "c"]
    there = raw.agg(*[F.count(c).alias(c) for c in values]).first()
    kept = [c for c in values if there[c]]
    return raw.select("event_id", *kept).where(~all_null(kept))


@query("""WITH v AS (SELECT 'orders' AS dataset, 's3' AS source, 1 AS priority, count(o_totalprice) AS n FROM orders UNION ALL SELECT 'orders', 'local', 2, count(CASE WHEN o_orderkey % 3 > 0 THEN 1 END) FROM orders UNION ALL SELECT 'events', 's3', 1, count(props) FROM events UNION ALL SELECT 'events', 'local', 2, count(props) FROM events)
SELECT dataset, arg_max(source, n * 10 + priority) AS source, max(n) AS valid_rows FROM v GROUP BY 1""")
def p11_best_source(spark, sf_dir):
    """The copy of each dataset with most valid rows; the local one of equal copies."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    counts = [("orders", "s3", 1, o.agg(F.count("o_totalprice").alias("n"))), ("orders", "local", 2, o.where("o_orderkey % 3 > 0").agg(F.count("*").alias("n"))), ("events", "s3", 1, e.agg(F.count("props").alias("n"))), ("events", "local", 2, e.agg(F.count("props").alias("n")))]
    variants = [d.select(F.lit(name).alias("dataset"), F.lit(source).alias("source"), F.lit(priority).alias("priority"), "n") for name, source, priority, d in counts]
    v = variants[0].unionByName(variants[1]).unionByName(variants[2]).unionByName(variants[3])
    return v.groupBy("dataset").agg(F.max_by("source", F.struct("n", "priority")).alias("source"), F.max("n").alias("valid_rows"))


@query(f"""{_T}, p AS (SELECT 'back' AS model, CAST(trade_time AS DATE) AS day, actual_win - yes_price AS pnl FROM tape WHERE yes_price >= 0.5 UNION ALL SELECT 'fade', CAST(trade_time AS DATE), yes_price - actual_win FROM tape WHERE yes_price < 0.5),
d AS (SELECT model, day, sum(pnl) AS pnl, count(*) AS n, sum(CAST(pnl > 0 AS INT)) AS won FROM p GROUP BY 1, 2),
c AS (SELECT *, sum(pnl) OVER (PARTITION BY model ORDER BY day) AS run FROM d), m AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY model ORDER BY day)) - run AS fall FROM c)
SELECT model, sum(n)::BIGINT AS trades, round(sum(pnl), 5) AS pnl, round(avg(pnl) / stddev_samp(pnl) * sqrt(252.0::DOUBLE), 5) AS sharpe, round(max(fall), 5) AS drawdown, round(sum(won) / sum(n)::DOUBLE, 6) AS win_rate FROM m GROUP BY 1""")
def a15_model_report(spark, sf_dir):
    """Trades, profit, Sharpe ratio, drawdown and win rate of each model, from its sums by day."""
    t = D.tape(spark, sf_dir)
    back = F.col("yes_price") >= 0.5
    p = t.select(F.when(back, "back").otherwise("fade").alias("model"), F.to_date("trade_time").alias("day"), F.when(back, F.col("actual_win") - F.col("yes_price")).otherwise(F.col("yes_price") - F.col("actual_win")).alias("pnl"))
    d = p.groupBy("model", "day").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("won"))
    w = Window.partitionBy("model").orderBy("day")
    c = d.withColumn("run", F.sum("pnl").over(w))
    m = c.withColumn("fall", F.greatest(F.lit(0.0), F.max("run").over(w)) - F.col("run"))
    return m.groupBy("model").agg(F.sum("n").alias("trades"), _r(F.sum("pnl"), "pnl", 5), _r(F.avg("pnl") / F.stddev_samp("pnl") * 252**0.5, "sharpe", 5), _r(F.max("fall"), "drawdown", 5), _r(F.sum("won") / F.sum("n"), "win_rate"))


@query(f"""{_G}, f AS (SELECT season, count(CASE WHEN game_id % 8 > season % 3 THEN attendance END) / count(*)::DOUBLE AS coverage FROM games GROUP BY 1), k AS (SELECT CASE WHEN coverage >= 0.75 THEN 'full' ELSE 'no attendance' END AS design FROM f)
SELECT design, count(*) AS seasons FROM k GROUP BY 1""")
def a34_design_availability(spark, sf_dir):
    """How many seasons have the coverage for each design."""
    known = F.when(F.col("game_id") % 8 > F.col("season") % 3, F.col("attendance"))
    f = D.games(spark, sf_dir).groupBy("season").agg((F.count(known) / F.count("*")).alias("coverage"))
    return f.groupBy(F.when(F.col("coverage") >= 0.75, "full").otherwise("no attendance").alias("design")).agg(F.count("*").alias("seasons"))


@query("""WITH r AS (SELECT CASE WHEN event_id % 3 > 0 THEN value END AS a, CASE WHEN event_id % 5 > 0 THEN event_type END AS b, CASE WHEN event_id % 7 > 0 THEN props END AS c, CASE WHEN event_id % 2 > 0 THEN user_id END AS d FROM events),
s AS (SELECT 1 - count(a) / count(*)::DOUBLE AS a, 1 - count(b) / count(*)::DOUBLE AS b, 1 - count(c) / count(*)::DOUBLE AS c, 1 - count(d) / count(*)::DOUBLE AS d FROM r)
SELECT name, round(share, 6) AS null_share FROM (UNPIVOT s ON a, b, c, d INTO NAME name VALUE share) ORDER BY share DESC LIMIT 2""")
def o2_worst_columns(spark, sf_dir):
    """The two columns with most nulls."""
    k = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.when(k % 3 > 0, F.col("value")).alias("a"), F.when(k % 5 > 0, F.col("event_type")).alias("b"), F.when(k % 7 > 0, F.col("props")).alias("c"), F.when(k % 2 > 0, F.col("user_id")).alias("d"))
    s = r.agg(*[(1 - F.count(c) / F.count("*")).alias(c) for c in "abcd"]).unpivot([], list("abcd"), "name", "share")
    return s.orderBy(F.desc("share")).limit(2).select("name", _r(F.col("share"), "null_share"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CASE WHEN event_type <> 'error' THEN event_type END AS stat FROM events WHERE props IS NOT NULL""")
def s14_embedded_json(spark, sf_dir):
    """Documents inside page scripts: the payload after a marker, parsed, with ``--`` as null."""
    stat = F.when(F.col("event_type") == "error", "--").otherwise(F.col("event_type"))
    html = F.concat(F.lit("<html><script>window['data']={\"team\":{\"stats\":"), "props", F.lit(",\"stat\":\""), stat, F.lit("\"}};</script></html>"))
    pages = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", html.alias("html"))
    doc = F.from_json(F.regexp_extract("html", r"window\['data'\]=(\{.*\});</script>", 1), "team struct<stats:struct<k:long>,stat:string>")
    return pages.select("event_id", doc.alias("d")).select("event_id", F.col("d.team.stats.k").alias("k"), F.nullif(F.col("d.team.stat"), F.lit("--")).alias("stat"))


@query("""SELECT o_orderkey AS game_id, o_totalprice AS price, CAST(NULL AS VARCHAR) AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1""")
def s8_widening_sink(spark, sf_dir):
    """A table that got a column later: earlier rows stay and read as null there."""
    path = fresh_path(spark, "widening")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    rows.where("game_id % 2 = 0").drop("status").write.mode("append").parquet(path)
    rows.where("game_id % 2 = 1").write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).select("game_id", "price", "status")


@query(f"""{_T} SELECT event_id, ticker, round(yes_price, 6) AS price, strftime(trade_time, '%Y-%m-%d') AS day FROM tape""")
def s17_s21_logged_trades(spark, sf_dir):
    """Trades logged as JSON lines in a folder for each day, read back with declared types."""
    path = fresh_path(spark, "trade-log")
    t = D.tape(spark, sf_dir).select("event_id", "ticker", F.round("yes_price", 6).alias("price"), F.date_format("trade_time", "yyyy-MM-dd").alias("day"))
    t.repartition("day").write.partitionBy("day").json(path)
    return spark.read.schema("event_id long, ticker long, price double, day string").json(path)


@query("""WITH c AS (SELECT user_id AS ticker, date_trunc('hour', ts) AS hour, min(value) AS bid, CASE WHEN count(*) > 1 THEN max(value) END AS ask FROM events GROUP BY 1, 2)
SELECT ticker, hour, round((bid + ask) / 2, 6) AS mid FROM c WHERE bid IS NOT NULL AND ask IS NOT NULL""")
def s22_candle_files(spark, sf_dir):
    """Candle files of several batches, quotes as text: cast, without those that lack a side, and their mid price."""
    path = fresh_path(spark, "candles")
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.date_trunc("hour", "ts").alias("hour")).agg(F.min("value").alias("bid"), F.when(F.count("*") > 1, F.max("value")).alias("ask"))
    text = c.select("ticker", "hour", F.col("bid").cast("string").alias("bid"), F.coalesce(F.col("ask").cast("string"), F.lit("n/a")).alias("ask"), (F.col("ticker") % 3).alias("batch"))
    text.write.partitionBy("batch").parquet(path)
    got = spark.read.parquet(f"{path}/batch=*").select("ticker", "hour", F.col("bid").try_cast("double").alias("bid"), F.col("ask").try_cast("double").alias("ask")).dropna(subset=["bid", "ask"])
    return got.select("ticker", "hour", _r((F.col("bid") + F.col("ask")) / 2, "mid"))


@query("""WITH old AS (SELECT o_orderkey AS game_id, o_orderdate AS day FROM orders WHERE o_orderkey % 3 > 0), new AS (SELECT o_orderkey - o_orderkey % 2 AS game_id, max(o_orderdate) AS day FROM orders GROUP BY 1)
SELECT game_id, CAST(day AS DATE) AS day FROM old UNION ALL SELECT game_id, CAST(day AS DATE) FROM new WHERE game_id NOT IN (SELECT game_id FROM old)""")
def s23_refreshed_ids(spark, sf_dir):
    """A table of ids with those of a fetch that it lacks, the last row of each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("day"))
    new = o.select((F.col("game_id") - F.col("game_id") % 2).alias("game_id"), "day")
    return upsert_new(o.where("game_id % 3 > 0"), new, "game_id", F.col("day"))
