"""Signals of hand-made markets."""

import pytest
from pyspark.sql import functions as F

from courtside.operators.signals import Sizing, match_signals

MATCHES = [(1, "A", "B", 0.7, 0.01, 4.0), (2, "C", "D", 0.5, 0.03, 0.0), (3, "E", "F", None, None, None)]
MARKETS = [
    (1, "winner", None, 0.6, 0.42),  # yes by 0.1
    (1, "spread", 5.0, 0.3, 0.72),  # chance 0.4: yes by 0.1, for the home side
    (1, "spread", -5.0, 0.99, 0.02),  # chance 0.9: no by 0.08, the away side's threshold
    (2, "winner", None, 0.55, 0.48),  # no by 0.02: less than the fee
    (2, "spread", 0.0, None, 0.5),
    (3, "winner", None, 0.5, 0.5),
    (9, "winner", None, 0.5, 0.5),
]
#: game, team, call, edge, hours, made at
CALLS = [(1, "A", "BACK", 5.0, 2.0, 1), (1, "A", "FADE", 5.0, 2.0, 2), (1, "A", "BACK", 5.0, -1.0, 3), (1, "B", "BACK", 0.0, 2.0, 1), (2, "D", "FADE", 3.0, 1.0, 1)]


def signals(spark, calls=CALLS, markets=MARKETS):
    m = spark.createDataFrame(MATCHES, "game_id int, home string, away string, win_prob double, win_std double, spread double")
    k = spark.createDataFrame(markets, "game_id int, market string, threshold double, yes double, no double")
    c = spark.createDataFrame(calls, "game_id int, team string, call string, edge double, hours double, made_at int")
    exceeds = lambda spread, threshold: F.least(F.lit(0.9), F.greatest(F.lit(0.1), 0.5 + (spread - threshold) / 10))
    return {(r["game_id"], r["market"], r["threshold"]): r for r in match_signals(m, k, c, exceeds, Sizing()).collect()}


def test_sides_sizes_and_agreement(spark):
    got = signals(spark)
    assert set(got) == {(g, m, t) for g, m, t, _, _ in MARKETS if g != 9}
    w = got[1, "winner", None]
    # the latest call before the start fades the home side, and the model backs it
    assert (w["side"], w["team"], w["confidence"], w["status"], w["actionable"]) == ("YES", "A", "HIGH", "DISAGREES", True)
    assert (w["edge"], w["kelly"], w["bet"], w["agree_pp"]) == pytest.approx((0.1, 0.25, 31.25, 20.0))
    s = got[1, "spread", 5.0]
    assert (s["side"], s["team"], s["confidence"], s["bet"]) == ("YES", "A", "FIXED", pytest.approx(1000 * 0.1 / 0.7 * 0.25 * 0.5, abs=0.005))
    a = got[1, "spread", -5.0]
    assert (a["side"], a["team"], a["status"], a["price"]) == ("NO", "B", "NO SIGNAL", 0.02)  # that call has no edge
    low = got[2, "winner", None]
    assert (low["side"], low["confidence"], low["status"], low["actionable"]) == ("NO", "MEDIUM", "AGREES", False)


def test_what_is_missing_is_not_traded(spark):
    got = signals(spark)
    for key in ((2, "spread", 0.0), (3, "winner", None)):
        assert (got[key]["side"], got[key]["edge"], got[key]["bet"], got[key]["actionable"]) == (None, None, None, False)
    assert {r["status"] for r in signals(spark, calls=[]).values()} == {"NO SIGNAL"}
    assert signals(spark, markets=[]) == {}


def test_positions_are_capped(spark):
    got = signals(spark, calls=[], markets=[(1, "winner", None, 0.05, 0.97), (1, "winner", None, 1.0, 1.0)][:1])
    assert got[1, "winner", None]["bet"] == 50.0
