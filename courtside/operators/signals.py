"""Trade signals of matches: model prices against quotes, edges, sizes, and agreement with signals of another kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizing:
    """How a position follows from an edge. The defaults are fixed values: tiers, multipliers, Kelly share, cap and fee rate."""

    std_tiers: tuple[float, float] = (0.028, 0.038)
    tier_multipliers: tuple[float, float, float] = (1.0, 0.75, 0.5)
    agree: float = 1.5
    neutral: float = 1.0
    disagree: float = 0.5
    kelly_share: float = 0.25
    most: float = 0.05
    fee_rate: float = 0.07
    bankroll: float = 1000.0


def confidence(std: Column, sizing: Sizing = Sizing()) -> Column:
    """HIGH, MEDIUM or LOW by how much an ensemble's models differ; LOW where that is not known."""
    low, high = sizing.std_tiers
    return F.when(std <= low, "HIGH").when(std <= high, "MEDIUM").otherwise("LOW")


def latest_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(game_id, team, call) and (game_id, call of the first team by name, calls by team), from calls (game_id, team, call, edge, hours, made_at).

    The latest call for a team counts; those made at or after the start, not to trade, or without an edge are none.
    """
    by_team = calls.where("hours > 0").groupBy("game_id", "team").agg(F.max_by(F.struct("call", "edge"), F.struct("made_at", "call", "edge")).alias("c"))
    by_team = by_team.select("game_id", "team", F.when(F.col("c.call").isin("BACK", "FADE") & (F.col("c.edge") != 0), F.col("c.call")).otherwise("NONE").alias("call"))
    named = F.when(F.col("team").isNotNull(), F.struct("team", "call"))
    return by_team, by_team.groupBy("game_id").agg(F.min_by("call", "team").alias("any_call"), F.map_from_entries(F.collect_list(named)).alias("calls"))


def match_signals(matches: DataFrame, markets: DataFrame, calls: DataFrame, exceeds, sizing: Sizing = Sizing()) -> DataFrame:
    """One row for each market: side, edge and size.

    matches: game_id, home, away, win_prob, win_std, spread (one row a game). markets: game_id, market (winner or spread),
    threshold (null for winner), yes, no. ``exceeds`` (a column function of spread and threshold) gives the chance that
    the home side wins by more than a threshold. The side is that with the larger edge, yes of equals; a call for the team
    the side or threshold favours agrees or disagrees with it (without one, the other team's call does). Markets of games without a match are left out.
    A market without both quotes, or a match without a prediction, has null side, edge and size and is not actionable.
    ``agree_pp`` is how far apart the two models' chances to win are, in points.
    """
    _, by_game = latest_calls(calls)
    m = markets.join(matches.join(by_game, "game_id", "left"), "game_id")  # calls come with a game, before its markets
    m = m.withColumn("prob", F.when(F.col("market") == "winner", F.col("win_prob")).otherwise(exceeds(F.col("spread"), F.col("threshold"))))
    m = m.withColumn("edge_yes", F.col("prob") - F.col("yes")).withColumn("edge_no", 1 - F.col("prob") - F.col("no"))
    yes = F.col("edge_yes") >= F.col("edge_no")
    m = m.withColumn("side", F.when(yes, "YES").when(~yes, "NO")).withColumn("edge", F.when(yes, F.col("edge_yes")).when(~yes, F.col("edge_no"))).withColumn("price", F.when(yes, F.col("yes")).when(~yes, F.col("no")))
    for_home = F.when(F.col("market") == "winner", yes).otherwise(F.col("threshold") > 0)
    m = m.withColumn("team", F.when(for_home, F.col("home")).otherwise(F.col("away")))
    called = F.coalesce(F.try_element_at("calls", F.col("team")), "any_call", F.lit("NONE"))
    right = F.when(called == "FADE", "NO").otherwise("YES") == F.col("side")
    status = F.when(called == "NONE", "NO SIGNAL").when(right, "AGREES").otherwise("DISAGREES")
    tier = F.when(F.col("market") == "winner", confidence(F.col("win_std"), sizing)).otherwise("FIXED")
    high, medium, low = sizing.tier_multipliers
    by_tier = F.when(tier == "MEDIUM", medium).when(tier == "LOW", low).otherwise(F.lit(high) if high == 1 else F.when(tier == "HIGH", high).otherwise(1.0))
    by_status = F.when(status == "AGREES", sizing.agree).when(status == "DISAGREES", sizing.disagree).otherwise(sizing.neutral)
    kelly = F.when((F.col("price") < 1) & (F.col("edge") > 0), F.col("edge") / (1 - F.col("price"))).when(F.col("edge").isNotNull(), 0.0)
    bet = F.round(F.least(kelly * sizing.kelly_share * by_tier * by_status, F.lit(sizing.most)) * sizing.bankroll, 2)
    return m.select(
        "game_id",
        "market",
        "threshold",
        "team",
        "side",
        "prob",
        "price",
        "edge",
        kelly.alias("kelly"),
        tier.alias("confidence"),
        status.alias("status"),
        F.when(F.col("edge").isNotNull(), bet).alias("bet"),
        F.coalesce(F.col("edge") >= sizing.fee_rate * F.col("price"), F.lit(False)).alias("actionable"),
        (100 * F.abs(F.col("win_prob") - exceeds(F.col("spread"), F.lit(0.0)))).alias("agree_pp"),
    )
