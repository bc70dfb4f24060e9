"""Relational invariants of the working tables."""
from pyspark.sql import functions as F


def test_balls_cover_every_delivery_once(ws):
    assert ws["balls"].count() == ws["deliveries"].count() == ws["balls"].select("delivery_id").distinct().count()


def test_innings_totals_equal_the_last_running_score(ws):
    last = ws["deliveries"].groupBy("match_id", "innings_no").agg(F.max(F.struct("seq", (F.col("score_before") + F.col("runs_total")).alias("s")))["s"].alias("s"))
    assert last.join(ws["innings"], ["match_id", "innings_no"]).filter("s <> total_runs").count() == 0


def test_partnerships_share_out_all_runs(ws):
    p = ws["partnerships"].groupBy("match_id", "innings_no").agg(F.sum("runs").alias("r"))
    assert p.join(ws["innings"], ["match_id", "innings_no"]).filter("r <> total_runs").count() == 0


def test_spells_share_out_all_overs(ws):
    overs = ws["balls"].select("match_id", "innings_no", "bowler_id", "over").distinct()
    assert ws["spells"].count() == overs.count()


def test_balls_left_identity_and_no_negative_counts(ws):
    b = ws["balls"]
    assert b.filter("balls_left + legal_balls_before <> innings_balls_limit").count() == 0
    assert b.filter("team_dot_streak < 0 or batter_dot_streak < 0 or team_boundary_streak < 0 or recent_runs < 0").count() == 0


def test_bowling_wickets_equal_credited_dismissals(ws):
    assert ws["bowl_innings"].agg(F.sum("wickets")).first()[0] == ws["dis"].filter("bowler_credited").count()


def test_battles_have_their_minimum(ws):
    assert ws["battles"].filter("balls < 12").count() == 0


def test_state_buckets_share_out_the_balls(ws):
    from inswing.operators.evidence import BAT_STATES, _state_sums, state_rows
    rows, dims = state_rows(ws, "batting")
    sums = _state_sums(rows, ["pid"], dims)
    whole = sums.filter("dimension = 'all'").agg(F.sum("n")).first()[0]
    for d in (x for x in BAT_STATES if x != "chase_state"):
        assert sums.filter(F.col("dimension") == d).agg(F.sum("n")).first()[0] == whole
