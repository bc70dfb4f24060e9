"""Libraries of innings, spells, battles and stands; competitions, teams and matches."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import ranked, ratio
from inswing.functions.stats import mean_diff, poisson_tail
from inswing.plans.filters import Filters
from inswing.plans.workspace import Workspace



def c(name: str) -> Column:
    return F.col(name)


INN = ["match_id", "innings_no"]


def _n(test: str) -> Column:
    return F.count_if(F.expr(test))


def _by_format(t20: float, odi: float) -> str:
    return f"case when format_group = 'T20' then {t20} else {odi} end"


Order = Callable[[], list[Column]]
# category: row predicate, order
INNINGS: dict[str, tuple[str, Order]] = {
    "highest": ("true", lambda: [F.desc("runs"), F.asc("balls")]),
    "fastest": (f"runs >= {_by_format(30, 50)}", lambda: [F.desc(c("runs") / c("balls"))]),
    "boundary_heavy": (f"balls >= {_by_format(20, 40)}", lambda: [F.desc((c("fours") + c("sixes")) / c("balls"))]),
    "low_dot": (f"balls >= {_by_format(25, 60)}", lambda: [F.asc(c("dots") / c("balls"))]),
    "difficult_chase": (f"chasing and won and rrr_at_arrival >= {_by_format(9.0, 6.5)} and runs >= 30", lambda: [F.desc("runs")]),
    "late_acceleration": (f"balls >= {_by_format(30, 60)} and b10 = 10",
                          lambda: [F.desc(100.0 * c("r10") / 10 - 100.0 * (c("runs") - c("r10")) / (c("balls") - 10))]),
    "death_hitting": (f"death_balls >= {_by_format(10, 20)}", lambda: [F.desc("death_runs"), F.asc("death_balls")]),
    "longest": ("true", lambda: [F.desc("balls")]),
}
SPELLS: dict[str, tuple[str, Order]] = {
    "best_figures": ("true", lambda: [F.desc("wickets"), F.asc("runs")]),
    "economical": (f"balls >= {_by_format(24, 48)}", lambda: [F.asc(c("runs") / c("balls")), F.desc("wickets")]),
    "most_dots": ("true", lambda: [F.desc("dots"), F.asc("runs")]),
    "death_spells": (f"death_balls >= {_by_format(12, 24)}", lambda: [F.desc("death_wkts"), F.asc(c("death_runs") / c("death_balls"))]),
    "wicket_bursts": ("best_burst12 >= 3", lambda: [F.desc("best_burst12"), F.desc("wickets"), F.asc("runs")]),
    "vs_set": (f"set_balls >= {_by_format(12, 30)} and set_wkts >= 2", lambda: [F.desc("set_wkts"), F.asc(c("set_runs") / c("set_balls"))]),
    "defending": (f"defending and won and balls >= {_by_format(18, 42)}", lambda: [F.desc("wickets"), F.asc(c("runs") / c("balls"))]),
}
BATTLES: dict[str, tuple[str, Order]] = {
    "most_balls": ("true", lambda: [F.desc("balls")]), "most_runs": ("true", lambda: [F.desc("runs")]),
    "most_dismissals": ("true", lambda: [F.desc("outs"), F.asc("balls")]),
    "lowest_sr": ("balls >= {big}", lambda: [F.asc(c("runs") / c("balls"))]), "highest_sr": ("balls >= {big}", lambda: [F.desc(c("runs") / c("balls"))]),
    "one_sided": ("balls >= {mid} and outs >= 3 and outs > 1.8 * expected and expected > 0", lambda: [F.asc(F.round("p", 12))]),
    "longest_running": ("balls >= {mid}", lambda: [F.desc(F.datediff("last_date", "first_date"))]),
    "recent": ("balls >= {small} and year(last_date) >= latest - 1", lambda: [F.desc("balls")]),
}


def _library(rows: DataFrame, test: str, order: list[Column], who: str, k: int, full_members: bool) -> DataFrame:
    rows = Filters(full_members=full_members or None).apply(rows, "library", False).filter("balls > 0").filter(test)
    return ranked(rows, ["gender", "format_group"], [*order, F.asc("match_id"), F.asc("innings_no"), F.asc(who)], k)


def innings_library(ws: Workspace, category: str, k: int = 25, full_members: bool = True) -> DataFrame:
    """Best innings of each gender and format in a category; minimums depend on the format."""
    test, order = INNINGS[category]
    return _library(ws["bat_innings"], test, order(), "batter_id", k, full_members)


def spell_library(ws: Workspace, category: str, k: int = 25, full_members: bool = True) -> DataFrame:
    test, order = SPELLS[category]
    return _library(ws["bowl_innings"], test, order(), "bowler_id", k, full_members)


def battle_universe(ws: Workspace, category: str, k: int = 25, big: int = 120, mid: int = 60, small: int = 30) -> DataFrame:
    """Battles of each gender in a category, with the dismissals the batter's usual rate predicts and their Poisson tail."""
    test, order = BATTLES[category]
    rows = ws["battles"].withColumn("expected", c("balls") * c("batter_out_rate"))
    if category == "one_sided":
        rows = rows.withColumn("p", poisson_tail("outs", "expected"))
    if category == "recent":
        latest = ws["team_results"].agg(F.max("year").alias("latest")).withColumn("one", F.lit(1))  # a single row
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(latest), "one")
    rows = rows.filter(test.format(big=big, mid=mid, small=small))
    return ranked(rows, ["gender"], [*order(), F.asc("batter_id"), F.asc("bowler_id")], k)


# ---------------------------------------------------------------- partnerships

def best_pairs(ws: Workspace, sort: str = "runs", phase: str | None = None, min_innings: int = 8, min_balls: int = 240, k: int = 20) -> DataFrame:
    """Pairs by runs, run rate, average or innings together, optionally within one phase."""
    if phase:
        both = (F.col("batter_id") == F.least("batter_id", "non_striker_id"))
        rows = ws["balls"].filter(c("phase") == phase).withColumns({
            "p1": F.least("batter_id", "non_striker_id"), "p2": F.greatest("batter_id", "non_striker_id"), "own": both})
        g = rows.groupBy("gender", "p1", "p2").agg(
            F.countDistinct(*INN).alias("innings"), F.sum("runs_total").alias("runs"), _n("legal").alias("balls"), _n("is_four or is_six").alias("boundaries"),
            _n("legal and runs_total = 0").alias("dots"), _n("legal and runs_batter in (1, 2, 3)").alias("rotations"),
            F.sum(F.when(c("own"), c("runs_batter"))).alias("p1_runs"), F.sum(F.when(~c("own"), c("runs_batter"))).alias("p2_runs"), F.lit(0).alias("wickets"))
    else:
        g = ws["partnerships"].groupBy("gender", "p1", "p2").agg(
            F.count("*").alias("innings"), *[F.sum(x).alias(x) for x in ("runs", "balls", "boundaries", "dots", "rotations", "p1_runs", "p2_runs")],
            _n("ended = 'wicket'").alias("wickets"))
    own = F.coalesce("p1_runs", F.lit(0)) + F.coalesce("p2_runs", F.lit(0))
    g = g.filter((c("innings") >= min_innings) & (c("balls") >= min_balls)).withColumns({
        "run_rate": ratio(c("runs"), c("balls"), 6.0), "average": ratio(c("runs"), c("wickets")), "boundary_pct": ratio(c("boundaries"), c("balls"), 100.0),
        "dot_pct": ratio(c("dots"), c("balls"), 100.0), "rotation_pct": ratio(c("rotations"), c("balls"), 100.0),
        "p1_share": ratio(F.coalesce("p1_runs", F.lit(0)), own, 100.0)})
    return ranked(g, ["gender"], [F.desc_nulls_last(sort), F.desc("runs"), F.asc("p1"), F.asc("p2")], k)


def top_stands(ws: Workspace, k: int = 20) -> DataFrame:
    return ranked(ws["partnerships"], ["gender", "format_group"], [F.desc("runs"), F.asc("balls"), F.asc("partnership_id")], k)


def partner_effect(ws: Workspace, min_balls: dict[str, int] | None = None, cell: int = 40) -> DataFrame:
    """A batter's scoring with each partner against their scoring with all others and against their phase-and-year rate."""
    least = min_balls or {"T20": 120, "ODI": 200}
    me = ["batter_id", "format_group"]
    r = c("runs_batter").cast("long")
    rows = ws["balls"].filter("faced").groupBy(*me, "non_striker_id", "phase", "year").agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"))

    def over(*keys: str) -> Window:
        return Window.partitionBy(*me, *keys)
    cell_n, cell_s = F.sum("n").over(over("phase", "year")), F.sum("s").over(over("phase", "year"))
    phase_rate = F.sum("s").over(over("phase")) / F.sum("n").over(over("phase"))
    rows = rows.withColumn("expected", c("n") * F.when(cell_n >= cell, cell_s / cell_n).otherwise(phase_rate))
    g = rows.groupBy(*me, c("non_striker_id").alias("partner_id")).agg(*[F.sum(x).alias(x) for x in ("n", "s", "ss", "expected")])
    g = g.withColumns({f"{x}_all": F.sum(x).over(over()) for x in ("n", "s", "ss")}).filter(
        c("n") >= F.when(c("format_group") == "T20", least["T20"]).otherwise(least["ODI"]))
    g = g.withColumns({f"{x}_other": c(f"{x}_all") - c(x) for x in ("n", "s", "ss")})
    g = g.withColumns({"d": mean_diff("s", "ss", "n", "s_other", "ss_other", "n_other"), "sr": ratio(c("s"), c("n"), 100.0),
                       "expected_sr": 100 * c("expected") / c("n")})
    g = g.withColumns({"diff": 100 * c("d.diff"), "lo": 100 * c("d.lo"), "hi": 100 * c("d.hi"), "vs_expected": c("sr") - c("expected_sr")}).drop("d")
    return g.withColumn("clear", F.coalesce(((c("lo") > 0) | (c("hi") < 0)) & (F.abs("vs_expected") >= 8), F.lit(False)))


def pair_totals(ws: Workspace) -> DataFrame:
    return ws["partnerships"].groupBy("p1", "p2", "format_group").agg(
        F.count("*").alias("stands"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.max("runs").alias("best"),
        F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"), _n("ended = 'unbroken'").alias("unbroken"))


# ---------------------------------------------------------------- competitions, teams, rivalries

COMP = ["competition", "gender"]


def competitions(ws: Workspace, min_matches: int = 6) -> DataFrame:
    return ws["team_results"].filter("competition is not null").groupBy(*COMP).agg(
        F.count("*").alias("matches"), F.countDistinct("season").alias("editions"), F.min("start_date").alias("first"), F.max("start_date").alias("last")
    ).filter(c("matches") >= min_matches)


def editions(ws: Workspace) -> DataFrame:
    """Seasons of a competition; the winner of the last match recorded as a final."""
    final = c("event_stage") == "Final"
    return ws["team_results"].filter("competition is not null").groupBy(*COMP, "season").agg(
        F.count("*").alias("matches"), F.min("start_date").alias("first"), F.max("start_date").alias("last"), F.coalesce(F.bool_or(final), F.lit(False)).alias("has_final"),
        F.max(F.when(final, F.struct("start_date", "match_id", "winner_c")))["winner_c"].alias("final_winner"))


def _both_teams(ws: Workspace) -> DataFrame:
    return ws["team_results"].select("*", F.inline(F.array(
        F.struct(c("ta").alias("team"), c("tb").alias("opponent")), F.struct(c("tb").alias("team"), c("ta").alias("opponent")))))


def standings(ws: Workspace, keys: list[str]) -> DataFrame:
    won = c("winner_c") == c("team")
    return _both_teams(ws).groupBy(*keys).agg(F.count("*").alias("played"), F.count_if(won).alias("won"), F.count_if(c("winner_c").isNotNull() & ~won).alias("lost"))


def competition_table(ws: Workspace) -> DataFrame:
    return standings(ws, [*COMP, "team"]).filter("competition is not null")


def competition_leaders(ws: Workspace, min_balls: int = 120, k: int = 5) -> DataFrame:
    """Runs, wickets, strike rate, economy, scores, figures, stands and battles of each competition, ranked in one table."""
    bat = ws["bat_innings"].filter("competition is not null")
    bowl = ws["bowl_innings"].filter("competition is not null")
    br = bat.groupBy(*COMP, "batter_id").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls"))
    bw = bowl.groupBy(*COMP, "bowler_id").agg(F.sum("wickets").alias("wickets"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls"))
    pairs = ws["balls"].filter("competition is not null").groupBy(*COMP, "batter_id", "bowler_id").agg(_n("faced").alias("balls"))
    ik = F.concat_ws("|", *INN, "batter_id")
    sk = F.concat_ws("|", *INN, "bowler_id")
    boards = [
        ("runs", br, c("batter_id"), c("runs"), []), ("wickets", bw, c("bowler_id"), c("wickets"), [F.asc("runs")]),
        ("strike_rate", br.filter(c("balls") >= min_balls), c("batter_id"), ratio(c("runs"), c("balls"), 100.0), []),
        ("economy", bw.filter(c("balls") >= min_balls), c("bowler_id"), -ratio(c("runs"), c("balls"), 6.0), []),
        ("score", bat, ik, c("runs"), [F.asc("balls")]), ("figures", bowl, sk, c("wickets"), [F.asc("runs")]),
        ("stand", ws["partnerships"].filter("competition is not null"), c("partnership_id"), c("runs"), []),
        ("battle", pairs, F.concat_ws("|", "batter_id", "bowler_id"), c("balls"), []),
    ]
    out = None
    for name, rows, key, value, then in boards:
        rows = rows.withColumns({"key": key, "value": value.cast("double")})
        part = ranked(rows, COMP, [F.desc("value"), *then, F.asc("key")], k).select(*COMP, F.lit(name).alias("board"), "rank", "key", F.abs("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def competition_trend(ws: Workspace) -> DataFrame:
    return ws["balls"].filter("competition is not null").groupBy(*COMP, "season").agg(
        ratio(F.sum("runs_total"), _n("legal"), 6.0).alias("run_rate"), ratio(_n("is_four or is_six"), _n("faced"), 100.0).alias("boundary_pct"),
        ratio(_n("legal and runs_total = 0"), _n("legal"), 100.0).alias("dot_pct"), F.countDistinct("match_id").alias("matches"))


def coverage_notes(ws: Workspace) -> DataFrame:
    return competitions(ws, 0).join(ws["source_coverage_pct"], "competition", "left").withColumn(
        "status", F.when(c("have").isNull(), "UNKNOWN").when(c("have") == c("of"), "COMPLETE").otherwise("PARTIAL"))


def rivalry(ws: Workspace) -> DataFrame:
    """Each pair of teams: wins, ties, closeness and the run environment."""
    close = ((c("win_by_runs") <= 10) | (c("win_by_wickets") <= 2) | (c("result") == "tie"))
    total = F.coalesce(c("i1_runs"), F.lit(0)) + F.coalesce(c("i2_runs"), F.lit(0))
    balls = F.coalesce(c("i1_balls"), F.lit(0)) + F.coalesce(c("i2_balls"), F.lit(0))
    return ws["team_results"].groupBy("ta", "tb", "gender", "format_group").agg(
        F.count("*").alias("played"), F.count_if(c("winner_c") == c("ta")).alias("a_won"), F.count_if(c("winner_c") == c("tb")).alias("b_won"),
        F.count_if(close).alias("close_matches"), F.max(F.greatest("i1_runs", "i2_runs")).alias("biggest_total"), F.max("win_by_runs").alias("biggest_win"),
        F.avg("i1_runs").alias("avg_first_innings"), ratio(F.sum(total), F.sum(balls), 6.0).alias("run_rate"))


def rivalry_leaders(ws: Workspace, k: int = 3) -> DataFrame:
    keys = ["ta", "tb", "gender"]
    pair = ws["team_results"].select("match_id", "ta", "tb")
    bat = ws["bat_innings"].join(pair, "match_id").groupBy(*keys, c("batter_id").alias("key")).agg(F.sum("runs").alias("value")).withColumn("board", F.lit("runs"))
    bowl = ws["bowl_innings"].join(pair, "match_id").groupBy(*keys, c("bowler_id").alias("key")).agg(F.sum("wickets").alias("value")).withColumn("board", F.lit("wickets"))
    bts = ws["balls"].join(pair, "match_id").groupBy(*keys, F.concat_ws("|", "batter_id", "bowler_id").alias("key")).agg(
        _n("faced").alias("value"), F.countDistinct("match_id").alias("m")).filter("m >= 3").drop("m").withColumn("board", F.lit("battle"))
    return ranked(bat.unionByName(bowl).unionByName(bts), [*keys, "board"], [F.desc("value"), F.asc("key")], k)


def rivalry_years(ws: Workspace) -> DataFrame:
    return ws["team_results"].groupBy("ta", "tb", "gender", "year").agg(
        F.count("*").alias("played"), F.count_if(c("winner_c") == c("ta")).alias("a_won"), F.count_if(c("winner_c") == c("tb")).alias("b_won"))


def teams(ws: Workspace) -> DataFrame:
    return _both_teams(ws).groupBy("team", "gender").agg(F.count("*").alias("matches"), F.min("start_date").alias("first"), F.max("start_date").alias("last"))


# ---------------------------------------------------------------- match pages

def fall_of_wickets(ws: Workspace) -> DataFrame:
    w = Window.partitionBy(*INN).orderBy("seq", "wicket_idx")
    return ws["dis"].filter("counts_as_dismissal").select(
        *INN, F.row_number().over(w).alias("wicket"), "player_out_id", "kind", (c("score_before") + c("runs_total")).alias("score"), "over", "delivery_id")


def match_overs(ws: Workspace) -> DataFrame:
    return ws["balls"].groupBy(*INN, "over").agg(F.sum("runs_total").alias("runs"), F.sum("n_wickets").alias("wickets"), F.min("phase").alias("phase"))


def match_phases(ws: Workspace) -> DataFrame:
    return ws["balls"].groupBy(*INN, "phase").agg(F.sum("runs_total").alias("runs"), F.sum("n_wickets").alias("wickets"), _n("legal").alias("balls"), F.sum("runs_extras").alias("extras"))


def match_events(ws: Workspace, wickets: int = 3, balls: int = 18, runs: int = 20) -> DataFrame:
    """Biggest over, milestones, hauls and collapses of each innings.

    Collapses are clusters of wickets close together; overlapping clusters are thinned greedily over the innings' own
    wickets, of which there are at most a side's worth.
    """
    over = ranked(match_overs(ws), INN, [F.desc("runs"), F.asc("over")], 1).select(
        *INN, F.lit("biggest_over").alias("kind"), c("over").cast("string").alias("key"), c("runs").cast("long").alias("value"))
    marks = ws["balls"].select(*INN, "delivery_id", F.explode(F.array(F.lit(50), F.lit(100))).alias("mark"), "batter_runs_before", "runs_batter").filter(
        "batter_runs_before < mark and batter_runs_before + runs_batter >= mark").select(
        *INN, F.lit("milestone").alias("kind"), c("delivery_id").alias("key"), c("mark").cast("long").alias("value"))
    haul = ws["bowl_innings"].filter("wickets >= 4").select(*INN, F.lit("haul").alias("kind"), c("bowler_id").alias("key"), c("wickets").cast("long").alias("value"))
    w = Window.partitionBy(*INN).orderBy("seq")
    fell = ws["balls"].filter("n_wickets > 0").withColumns({
        "i": F.row_number().over(w), "legal_at": c("legal_balls_before") + c("legal").cast("int"), "score_after": c("score_before") + c("runs_total")})
    last = fell.withColumns({"z_legal": F.lead("legal_at", wickets - 1).over(w), "z_score": F.lead("score_after", wickets - 1).over(w)})
    hit = last.filter((c("z_legal") - c("legal_at") + 1 <= balls) & (c("z_score") - c("score_before") <= runs))
    # keep a cluster only when it starts after the previously kept one has ended
    starts = hit.groupBy(*INN).agg(F.array_sort(F.collect_list(F.struct("i", "delivery_id", (c("z_score") - c("score_before")).cast("long").alias("r")))).alias("s"))
    empty = F.filter("s", lambda x: F.lit(False))
    kept = F.aggregate("s", empty, lambda acc, x: F.when(
        F.coalesce(F.array_max(F.transform(acc, lambda y: y["i"])), F.lit(-99)) + wickets <= x["i"],
        F.concat(acc, F.array(x))).otherwise(acc))
    fall = starts.select(*INN, F.explode(kept).alias("e")).select(*INN, F.lit("collapse").alias("kind"), c("e.delivery_id").alias("key"), c("e.r").alias("value"))
    return over.unionByName(marks).unionByName(haul).unionByName(fall)


def in_competition_ranks(ws: Workspace, k: int = 10) -> DataFrame:
    """Innings totals and scores that rank in a competition's top ten; the rank of a value is counted over distinct values."""
    tot = ws["innings"].filter("not super_over").join(ws["team_results"].select("match_id", *COMP), "match_id").filter("competition is not null") \
        .select(*COMP, F.lit("total").alias("what"), F.concat_ws("|", *INN).alias("key"), c("total_runs").alias("value"))
    sc = ws["bat_innings"].filter("competition is not null").select(*COMP, F.lit("score").alias("what"), F.concat_ws("|", *INN, "batter_id").alias("key"), c("runs").alias("value"))
    rows = tot.unionByName(sc)
    w = Window.partitionBy(*COMP, "what").orderBy(F.desc("value"))
    counts = rows.groupBy(*COMP, "what", "value").agg(F.count("*").alias("n")).withColumn(
        "rank", 1 + F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(c("rank") <= k)
    return rows.join(counts.drop("n"), [*COMP, "what", "value"]).filter("what = 'total' or value >= 50")


def match_battles(ws: Workspace, min_balls: int = 6, k: int = 10) -> DataFrame:
    b = ws["balls"].groupBy("match_id", "batter_id", "bowler_id", "gender").agg(_n("faced").alias("balls"), F.sum("runs_batter").alias("runs"), _n("striker_credited").alias("outs")) \
        .filter(c("balls") >= min_balls)
    career = ws["battles"].select("batter_id", "bowler_id", "gender", c("balls").alias("career_balls"), c("outs").alias("career_outs"))
    return ranked(b, ["match_id"], [F.desc("outs"), F.desc("balls"), F.asc("batter_id"), F.asc("bowler_id")], k).join(career, ["batter_id", "bowler_id", "gender"], "left")


def on_this_day(ws: Workspace, month: int, day: int, per_match: int = 2) -> DataFrame:
    """Notable innings and spells on a calendar day, at most two per match."""
    when = (F.month("start_date") == month) & (F.dayofmonth("start_date") == day)
    inn = ws["bat_innings"].filter(when & (c("runs") >= 50)).select("match_id", "gender", "start_date", F.lit("innings").alias("what"), c("batter_id").alias("who"), (c("runs") / 50.0).alias("weight"))
    sp = ws["bowl_innings"].filter(when & (c("wickets") >= 3)).select("match_id", "gender", "start_date", F.lit("spell").alias("what"), c("bowler_id").alias("who"), (c("wickets") / 3.0).alias("weight"))
    return ranked(inn.unionByName(sp), ["match_id"], [F.desc("weight"), F.asc("what"), F.asc("who")], per_match)


def coverage_totals(ws: Workspace) -> DataFrame:
    dims = ["gender", "format_group", "team_type"]
    return ws["team_results"].groupingSets([[*dims], ["gender"], ["format_group"], ["team_type"], []], *dims).agg(
        F.grouping_id().alias("level"), F.count("*").alias("matches"), F.min("start_date").alias("first"), F.max("start_date").alias("last"))


def recognisability(ws: Workspace) -> DataFrame:
    """How well known a player is likely to be (log of covered matches; 300 count as fully known) and how recent (decay by calendar year, six years)."""
    act = ws["player_profile"].select("person_id", c("matches").alias("played"), c("last_match").alias("last"))
    latest = ws["team_results"].agg(F.max("start_date").alias("latest")).withColumn("one", F.lit(1))
    return act.withColumn("one", F.lit(1)).join(F.broadcast(latest), "one").select(
        "person_id", (F.log1p(c("played")) / F.log1p(F.lit(300.0))).alias("known"),
        F.coalesce(F.exp(-F.greatest(F.lit(0), F.year("latest") - F.year("last")) / 6.0), F.lit(0.3)).alias("recent"))
