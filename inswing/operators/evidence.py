"""Peer-relative evidence: battles, dismissal stories, states, strengths and weaknesses, fingerprints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import ranked, ratio
from inswing.functions.stats import Z90, Z99, benjamini_hochberg, mean_diff, percentile_rank, poisson_interval, rate_ratio, shrink, two_sided, wilson
from inswing.operators.players import stage_of
from inswing.plans.workspace import Workspace, relation

LIMITED = "format_group in ('T20', 'ODI')"


def _n(test: str) -> Column:
    return F.count_if(F.expr(test))


# ---------------------------------------------------------------- battles

def _faced(b: DataFrame, *keys: str) -> DataFrame:
    return b.groupBy(*keys).agg(_n("faced").alias("balls"), F.sum("runs_batter").alias("runs"), _n("striker_credited").alias("dismissals"),
                                F.var_samp(F.when(F.col("faced"), F.col("runs_batter"))).alias("var"))


def battle_edges(ws: Workspace, min_balls: int = 12) -> DataFrame:
    """Each battle against what the usual rates of both players, in the formats they met in, would predict."""
    b = ws["balls"].filter(LIMITED)
    by_format = _faced(b, "batter_id", "bowler_id", "format_group").select("batter_id", "bowler_id", "format_group")
    bat = _faced(b, "batter_id", "format_group").select("batter_id", "format_group", F.col("balls").alias("b_n"), F.col("runs").alias("b_r"), F.col("dismissals").alias("b_o"))
    bowl = _faced(b, "bowler_id", "format_group").select("bowler_id", "format_group", F.col("balls").alias("w_n"), F.col("runs").alias("w_r"), F.col("dismissals").alias("w_o"))
    usual = by_format.join(bat, ["batter_id", "format_group"]).join(bowl, ["bowler_id", "format_group"]).groupBy("batter_id", "bowler_id").agg(
        *[F.sum(x).alias(x) for x in ("b_n", "b_r", "b_o", "w_n", "w_r", "w_o")])
    rows = _faced(b, "batter_id", "bowler_id").filter(F.col("balls") >= min_balls).join(usual, ["batter_id", "bowler_id"])
    c = F.col
    se = F.when(c("balls") > 1, 100 * F.sqrt(F.coalesce("var", F.lit(0.0)) / c("balls")))
    sr = ratio(c("runs"), c("balls"), 100.0)
    span = poisson_interval(c("dismissals"))
    return rows.withColumns({
        "strike_rate": sr, "sr_lo": sr - 1.645 * se, "sr_hi": sr + 1.645 * se, "batter_usual_sr": ratio(c("b_r"), c("b_n"), 100.0),
        "bowler_usual_sr": ratio(c("w_r"), c("w_n"), 100.0), "outs_lo": span["lo"], "outs_hi": span["hi"],
        "expected_by_batter": ratio(c("balls") * c("b_o"), c("b_n")), "expected_by_bowler": ratio(c("balls") * c("w_o"), c("w_n")),
        "sample": F.when(c("balls") < 60, "small").when(c("balls") < 150, "moderate").otherwise("reasonable")})


def battle_breakdown(ws: Workspace) -> DataFrame:
    """Battles by phase, innings, year and format from one scan."""
    dims = ["phase", "innings_no", "year", "format_group"]
    b = ws["balls"].select("batter_id", "bowler_id", "faced", "runs_batter", "striker_credited", *[F.col(d).cast("string").alias(d) for d in dims])
    g = b.groupingSets([["batter_id", "bowler_id", d] for d in dims], "batter_id", "bowler_id", *dims).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims], _n("faced").alias("balls"), F.sum("runs_batter").alias("runs"), _n("striker_credited").alias("dismissals"))
    return _unset(g, dims, ["batter_id", "bowler_id"], ["balls", "runs", "dismissals"])


def _unset(g: DataFrame, dims: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Grouping sets of single dimensions as (dimension, bucket) rows."""
    dim, bucket = None, None
    for d in dims:
        here = F.col(f"g_{d}") == 0
        dim = F.when(here, d) if dim is None else dim.when(here, d)
        bucket = F.when(here, F.col(d)) if bucket is None else bucket.when(here, F.col(d))
    return g.select(*keys, dim.alias("dimension"), bucket.alias("bucket"), *values)


def notable_battles(ws: Workspace, k: int = 12) -> DataFrame:
    return ranked(ws["battles"], ["gender"], [F.desc("balls"), F.asc("batter_id"), F.asc("bowler_id")], k)


def meetings(ws: Workspace) -> DataFrame:
    """One row per match of a battle, split into an earlier and a later half by balls."""
    keys = ["batter_id", "bowler_id"]
    m = ws["balls"].groupBy(*keys, "match_id").agg(F.min("start_date").alias("start_date"), _n("faced").alias("balls"), F.sum("runs_batter").alias("runs"),
                                                   _n("striker_credited").alias("outs"))
    # meetings of a pair are added up by day before the running total, which bounds the window by the calendar
    day = m.groupBy(*keys, "start_date").agg(F.sum("balls").alias("day_balls"))
    w = Window.partitionBy(*keys).orderBy("start_date")
    day = day.withColumns({"before": F.coalesce(F.sum("day_balls").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                           "whole": F.sum("day_balls").over(Window.partitionBy(*keys))})
    return m.join(day, [*keys, "start_date"]).withColumn("half", F.when(F.col("before") * 2 < F.col("whole"), "earlier").otherwise("later"))


def matchup_lists(ws: Workspace, min_balls: int = 60, k: int = 5) -> DataFrame:
    """A batter's most telling battles: biggest, most dismissals, dominated, took apart, balanced and unusual."""
    c = F.col
    b = ws["battles"].filter(c("balls") >= min_balls).withColumns({
        "expected": c("balls") * c("batter_out_rate"), "rpb": c("runs") / c("balls")})
    b = b.withColumns({"z": (c("outs") - c("expected")) / F.sqrt(F.greatest(c("expected"), F.lit(0.5))), "lift": c("rpb") / F.nullif(c("batter_rpb"), F.lit(0.0))})
    lists = {
        "biggest": (None, F.desc("balls")), "most_dismissals": (c("outs") > 0, F.desc("outs")),
        "took_apart": (c("lift") >= 1.2, F.desc("lift")), "kept_quiet": (c("lift") <= 0.8, F.asc("lift")),
        "balanced": (c("lift").between(0.9, 1.1) & (F.abs("z") < 1), F.desc("balls")), "unusual": (F.abs("z") >= 2, F.desc(F.abs("z"))),
    }
    out = None
    for name, (test, order) in lists.items():
        rows = b if test is None else b.filter(test)
        part = ranked(rows, ["batter_id"], [order, F.asc("bowler_id")], k).select(
            "batter_id", F.lit(name).alias("list"), "rank", "bowler_id", "balls", "outs", "z", "lift")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- dismissal story

def dismissal_story(ws: Workspace) -> DataFrame:
    """Share of each route among a batter's dismissals, with its interval and the balls faced per such dismissal."""
    d = ws["dis"].filter("counts_as_dismissal").groupBy("player_out_id", "route").agg(F.count("*").alias("n"))
    balls = ws["balls"].groupBy(F.col("batter_id").alias("player_out_id")).agg(_n("faced").alias("balls"))
    w = Window.partitionBy("player_out_id")
    d = d.withColumn("of_total", F.sum("n").over(w)).join(balls, "player_out_id", "left")
    ci = wilson("n", "of_total")
    return d.withColumns({"share": ratio(F.col("n"), F.col("of_total"), 100.0), "share_lo": 100 * ci["lo"], "share_hi": 100 * ci["hi"],
                          "balls_per": ratio(F.col("balls"), F.col("n"))})


def story_splits(ws: Workspace) -> DataFrame:
    """Each route of each batter by format, phase, over, bowler, fielder, year and score, from one scan."""
    dims = ["format_group", "phase", "over_no", "bowler_id", "fielder_id", "year", "score"]
    score = F.when(F.col("batter_runs_before") < 10, "0-9").when(F.col("batter_runs_before") < 30, "10-29").when(F.col("batter_runs_before") < 50, "30-49").otherwise("50+")
    rows = ws["dis"].select("player_out_id", "route", "format_group", "phase", (F.col("over") + 1).cast("string").alias("over_no"), "bowler_id", "fielder_id",
                            F.col("year").cast("string").alias("year"), score.alias("score"))
    g = rows.groupingSets([["player_out_id", "route", d] for d in dims], "player_out_id", "route", *dims).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims], F.count("*").alias("n"))
    return _unset(g, dims, ["player_out_id", "route"], ["n"]).filter("bucket is not null")


# ---------------------------------------------------------------- states

BANDS = {"top": (1, 3), "middle": (4, 7), "lower": (8, 11)}  # fixed values: batting positions
STATE_MIN = {"T20": 60, "ODI": 100}
BAT_STATES = ["balls_faced", "wickets", "innings", "chase_state", "phase"]
BOWL_STATES = ["batter_stage", "defending", "chase_state", "spell_over", "wickets", "phase"]


def band_of(position: Column) -> Column:
    return F.when(position.isNull() | (position <= 3), "top").when(position <= 7, "middle").otherwise("lower")


def _wickets_bucket() -> Column:
    return F.when(F.col("wickets_before") <= 2, "0-2").when(F.col("wickets_before") <= 5, "3-5").otherwise("6+")


def state_rows(ws: Workspace, role: str) -> tuple[DataFrame, list[str]]:
    """Balls with their state buckets and the three quantities a state is measured by."""
    chase = F.coalesce("chasing", F.lit(False))
    b = ws["balls"].filter(LIMITED)
    if role == "batting":
        f = F.col("batter_balls_before")
        faced = F.when(f < 10, "1-10").when(f < 20, "11-20").when(f < 30, "21-30").when(f < 50, "31-50").otherwise("51+")
        rows = b.filter("faced").select(
            F.col("batter_id").alias("pid"), "format_group", "gender", "batter_position", F.lit(1).alias("counted"), F.col("runs_batter").alias("r"),
            F.col("striker_dismissed").cast("int").alias("out"), F.expr("is_four or is_six").alias("bnd"), (F.col("runs_batter") == 0).alias("dot"),
            faced.alias("balls_faced"), _wickets_bucket().alias("wickets"), F.when(chase, "chasing").otherwise("setting").alias("innings"), "chase_state", "phase")
        return rows, BAT_STATES
    overs = ws["spells"].select("match_id", "innings_no", "bowler_id", "over", F.row_number().over(
        Window.partitionBy("match_id", "innings_no", "bowler_id", "spell_no").orderBy("over")).alias("k"))
    rc = F.col("runs_batter") + F.col("wides") + F.col("noballs")
    k = F.col("k")
    rows = b.join(overs, ["match_id", "innings_no", "bowler_id", "over"]).select(
        F.col("bowler_id").alias("pid"), "format_group", "gender", F.lit(None).cast("int").alias("batter_position"), F.col("legal").cast("int").alias("counted"),
        rc.alias("r"), F.col("wk").cast("int").alias("out"), F.expr("is_four or is_six").alias("bnd"), (F.col("legal") & (rc == 0)).alias("dot"),
        "batter_stage", F.when(chase, "defending").otherwise("bowling first").alias("defending"), "chase_state",
        F.when(k == 1, "1st").when(k == 2, "2nd").when(k == 3, "3rd").otherwise("4th+").alias("spell_over"), _wickets_bucket().alias("wickets"), "phase")
    return rows, BOWL_STATES


def _state_sums(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    sets = [[*keys, d] for d in dims] + [keys]
    r = F.col("r").cast("long")
    g = rows.groupingSets(sets, *keys, *dims).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims], F.sum("counted").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"),
        F.sum("out").alias("outs"), F.count_if("bnd").alias("bnd"), F.count_if("dot").alias("dots"))
    out = _unset(g, dims, keys, ["n", "s", "ss", "outs", "bnd", "dots"])
    whole = F.col("dimension").isNull()
    return out.withColumns({"bucket": F.when(whole, "all").otherwise(F.col("bucket")), "dimension": F.when(whole, "all").otherwise(F.col("dimension"))}) \
        .filter("bucket is not null and n > 0")


def states(ws: Workspace, role: str = "batting", min_n: dict[str, int] | None = None) -> DataFrame:
    """Every player's state buckets beside their own overall record and their peers' change in the same state."""
    least = min_n or STATE_MIN
    scale, risk = (100.0, "outs_per_100") if role == "batting" else (6.0, "wkts_per_100")
    rows, dims = state_rows(ws, role)
    me = _state_sums(rows, ["pid", "format_group", "gender"], dims)
    if role == "batting":
        usual = rows.groupBy("pid", "format_group", "gender", "batter_position").agg(F.count("*").alias("k"))
        best = F.max(F.struct(F.col("k"), (-F.col("batter_position")).alias("neg")))
        mode = usual.filter("batter_position is not null").groupBy("pid", "format_group", "gender").agg(best.alias("m"))
        me = me.join(mode.select("pid", "format_group", "gender", band_of(-F.col("m.neg")).alias("band")), ["pid", "format_group", "gender"], "left")
        peers = _state_sums(rows.withColumn("band", band_of(F.col("batter_position"))), ["format_group", "gender", "band"], dims)
    else:
        me = me.withColumn("band", F.lit("all"))
        peers = _state_sums(rows.withColumn("band", F.lit("all")), ["format_group", "gender", "band"], dims)
    c = F.col

    def measured(df: DataFrame, p: str) -> DataFrame:
        m = c("s") / c("n")
        return df.withColumns({f"{p}main": scale * m, f"{p}{risk}": 100.0 * c("outs") / c("n")})

    keys = ["format_group", "gender", "band"]
    peer = measured(peers, "peer_").select(*keys, "dimension", "bucket", "peer_main", F.col(f"peer_{risk}").alias("peer_risk"))
    pbase = peer.filter("dimension = 'all'").select(*keys, c("peer_main").alias("pb_main"), c("peer_risk").alias("pb_risk"))
    var = F.when(c("n") > 1, F.greatest(F.lit(1e-9), (c("ss") - c("n") * (c("s") / c("n")) * (c("s") / c("n"))) / (c("n") - 1)))
    mine = measured(me, "").withColumn("se", scale * F.sqrt(var / c("n"))).withColumnRenamed(risk, "risk")
    base = mine.filter("dimension = 'all'").select("pid", "format_group", "gender", c("main").alias("base_main"), c("risk").alias("base_risk"))
    j = mine.filter("dimension <> 'all'").join(base, ["pid", "format_group", "gender"]).join(
        peer, [*keys, "dimension", "bucket"], "left").join(pbase, keys, "left")
    expected = c("base_main") + (c("peer_main") - c("pb_main"))
    floor = F.when(c("format_group") == "T20", least["T20"]).otherwise(least["ODI"])
    off = F.abs(expected - c("main")) > Z99 * c("se")
    ci = wilson("outs", "n")
    return j.withColumns({
        "main_lo": c("main") - Z90 * c("se"), "main_hi": c("main") + Z90 * c("se"), "risk_lo": 100 * ci["lo"], "risk_hi": 100 * ci["hi"],
        "relative_main": (c("main") - c("base_main")) - (c("peer_main") - c("pb_main")), "relative_risk": (c("risk") - c("base_risk")) - (c("peer_risk") - c("pb_risk")),
        "expected_if_typical": expected, "small_sample": c("n") < floor, "clear": F.coalesce(off & (c("n") >= 2 * floor), F.lit(False))})


# ---------------------------------------------------------------- strengths and weaknesses

MIN_IN = {"T20": 90, "ODI": 150}
MIN_OUT = {"T20": 150, "ODI": 250}
PRESSURE = {"T20": 10.0, "ODI": 7.0}
K_SHRINK = 60.0
FIELDS = ["n", "runs", "ss", "bnd", "dots", "outs"]
SPLITS = {  # fixed values: the situations compared with the rest of a batter's balls
    "phase:powerplay": "phase = 'powerplay'", "phase:middle": "phase = 'middle'", "phase:death": "phase = 'death'", "chasing": "coalesce(chasing, false)",
    "stage:0-9": "batter_balls_before < 10", "stage:10-19": "batter_balls_before between 10 and 19", "stage:20-29": "batter_balls_before between 20 and 29",
    "stage:30+": "batter_balls_before >= 30", "wk:0-2": "wickets_before <= 2", "wk:3-5": "wickets_before between 3 and 5",
    "pressure": "coalesce(chasing, false) and required_rate >= case when format_group = 'T20' then 10 else 7 end",
}


def _split_long(ws: Workspace, b: DataFrame, keys: list[str], out_col: str) -> DataFrame:
    """(keys, split, inside sums, total sums): every fixed split, then every opponent.

    Balls are added up once, by key, opponent and the set of splits they are in (bits of `mask`); the few sums that are left
    are laid out on the splits. One aggregate with a column for each split and measure is too wide for generated code.
    """
    c = F.col
    hit, runs = F.expr("is_four or is_six"), c("runs_batter").cast("bigint")
    mask = sum((F.when(F.expr(test), 2**i).otherwise(0) for i, test in enumerate(SPLITS.values())), F.lit(0))

    def add_up(df: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
        return df.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in sums.items()])

    faced = {"n": F.lit(1), "runs": runs, "ss": runs * runs, "bnd": hit.cast("int"), "dots": (c("runs_batter") == 0).cast("int")}
    cells = ws.stage(add_up(b.withColumn("mask", mask), [*keys, "bowling_team", "mask"],
                            {f: F.when(c("faced"), x) for f, x in faced.items()} | {"outs": c(out_col)}), "split_cells")
    names = F.posexplode(F.array(*[F.lit(name) for name in SPLITS])).alias("bit", "split")
    inside = c("mask").bitwiseAND(F.expr("shiftleft(1, bit)")) != 0
    total = {f"t_{f}": c(f) for f in FIELDS}
    # a cell has one row for each split, inside or not, so that a split without balls has its zeros
    fixed = add_up(add_up(cells, [*keys, "mask"], {f: c(f) for f in FIELDS}).select(*keys, "mask", *FIELDS, names), [*keys, "split"],
                   total | {f"in_{f}": F.when(inside, c(f)) for f in FIELDS})
    fixed = fixed.select(*keys, *total, "split", *[f"in_{f}" for f in FIELDS])
    opp = add_up(cells, [*keys, F.concat(F.lit("opp:"), "bowling_team").alias("split")], {f"in_{f}": c(f) for f in FIELDS})
    return fixed.unionByName(opp.join(add_up(cells, keys, total), keys).select(*fixed.columns))


def _median_day(b: DataFrame, keys: list[str]) -> DataFrame:
    """The day of the middle faced ball of each group, from counts by day."""
    day = b.filter("faced").groupBy(*keys, "start_date").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    day = day.withColumns({"cum": F.sum("k").over(w.orderBy("start_date")), "all": F.sum("k").over(w)})
    return day.filter("cum > floor(all / 2)").groupBy(*keys).agg(F.min("start_date").alias("median_day"))


SPLIT_KEYS = ["batter_id", "format_group", "gender"]


@relation("split_own")
def split_own(ws: Workspace) -> DataFrame:
    b = ws["balls"].filter(LIMITED).withColumn("own_out", F.col("striker_dismissed").cast("int"))
    return _split_long(ws, b, SPLIT_KEYS, "own_out")


@relation("split_half")
def split_half(ws: Workspace) -> DataFrame:
    """The same sums for the earlier and the later half of each batter's balls."""
    b = ws["balls"].filter(LIMITED)
    b = b.join(_median_day(b, SPLIT_KEYS), SPLIT_KEYS).withColumns({
        "late": F.col("start_date") >= F.col("median_day"), "own_out": F.col("striker_dismissed").cast("int")})
    return _split_long(ws, b, [*SPLIT_KEYS, "late"], "own_out")


@relation("split_league")
def split_league(ws: Workspace) -> DataFrame:
    b = ws["balls"].filter(LIMITED).withColumn("band", band_of(F.col("batter_position")))
    return _split_long(ws, b, ["format_group", "gender", "band"], "outs")


def split_tests(ws: Workspace, min_in: dict[str, int] | None = None, min_out: dict[str, int] | None = None, q: float = 0.10,
                opponents: int | None = 8) -> DataFrame:
    """Every batter's splits against the rest of their balls, relative to how batters of their position change.

    Of the opponents the most faced ones are tested, all of them where `opponents` is None. Four measures per split; a test passes on the false-discovery rate over the batter's own tests, an effect size and
    an interval, and is stable when both halves of the covered period point the same way.
    """
    lo_in, lo_out = min_in or MIN_IN, min_out or MIN_OUT
    c = F.col
    keys = SPLIT_KEYS
    b = ws["balls"].filter(LIMITED)
    place = b.filter("faced and batter_position is not null").groupBy(*keys).agg(F.expr("percentile_disc(0.5) within group (order by batter_position desc)").alias("mid"))
    me, half, league = ws["split_own"], ws["split_half"], ws["split_league"]
    league = league.select("format_group", "gender", "band", "split", *[c(f"in_{f}").alias(f"li_{f}") for f in FIELDS],
                           *[(c(f"t_{f}") - c(f"in_{f}")).alias(f"lo_{f}") for f in FIELDS])
    t20 = c("format_group") == "T20"
    floor_in, floor_out = F.when(t20, lo_in["T20"]).otherwise(lo_in["ODI"]), F.when(t20, lo_out["T20"]).otherwise(lo_out["ODI"])
    rows = me.withColumns({f"out_{f}": c(f"t_{f}") - c(f"in_{f}") for f in FIELDS}).filter((c("in_n") >= floor_in) & (c("out_n") >= floor_out))
    if opponents is not None:
        opp = c("split").startswith("opp:")
        first = F.row_number().over(Window.partitionBy(*keys, opp).orderBy(F.desc("in_n"), "split"))
        rows = rows.withColumn("place", first).filter(~opp | (c("place") <= opponents)).drop("place")
    rows = rows.join(place, keys, "left").withColumn("band", band_of(c("mid"))).join(league, ["format_group", "gender", "band", "split"])

    # one row per measure with its raw counts; the statistics follow in stages, each on named columns
    zero = F.lit(0)
    parts = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), *[c(f"{side}_{f}").cast("double").alias(f"{side}_x") for side in ("in", "out", "li", "lo")],
                      (c("in_ss") if k == "mean" else zero).cast("double").alias("in_q"), (c("out_ss") if k == "mean" else zero).cast("double").alias("out_q"))
             for m, f, k in (("out_rate", "outs", "rate"), ("bnd_rate", "bnd", "rate"), ("dot_rate", "dots", "rate"), ("sr", "runs", "mean"))]
    rate = c("kind") == "rate"
    # a row for a batter's split: staged, as the optimizer would else merge all steps into one expression
    tests = ws.stage(rows.select(*keys, "band", "split", "in_n", "out_n", "li_n", "lo_n", F.inline(F.array(*parts))), "split_rows")
    inside, outside = c("li_x") / F.greatest(c("li_n"), F.lit(1)), c("lo_x") / F.greatest(c("lo_n"), F.lit(1))
    tests = tests.withColumns({"typical": F.when(rate, F.nullif(inside / F.nullif(outside, F.lit(0.0)), F.lit(0.0))).otherwise(inside - outside),
                               "rr": F.when(rate, rate_ratio("in_x", "in_n", "out_x", "out_n")), "md": F.when(~rate, mean_diff("in_x", "in_q", "in_n", "out_x", "out_q", "out_n")),
                               "rest": c("out_x") / c("out_n")}).filter("typical is not null")
    tests = ws.stage(tests, "split_ratios").withColumns({
        "prior": F.when(rate, c("rest") * c("typical")).otherwise(c("rest") + c("typical")), "base": F.when(c("rest") > 0, c("rest")).otherwise(1e-9),
        "se": F.when(rate, F.ln("rr.hi") - F.ln("rr.lo")).otherwise(c("md.hi") - c("md.lo")) / (2 * Z90),
        "gap": F.when(rate, F.ln(c("rr.ratio") / c("typical"))).otherwise(c("md.diff") - c("typical"))})
    tests = tests.withColumns({"z": c("gap") / c("se"), "own": shrink("in_x", "in_n", "prior", K_SHRINK)})
    tests = tests.select(
        *keys, "band", "split", "in_n", "out_n", "metric", "kind", F.when(rate, 1.0).otherwise(0.0).alias("null"),
        F.when(rate, c("own") / c("base") / c("typical")).otherwise(100 * (c("own") - c("rest")) - 100 * c("typical")).alias("effect"),
        F.when(rate, c("typical")).otherwise(100 * c("typical")).alias("typical"),
        F.when(rate, c("rr.lo") / c("typical")).otherwise(100 * (c("md.lo") - c("typical"))).alias("lo"),
        F.when(rate, c("rr.hi") / c("typical")).otherwise(100 * (c("md.hi") - c("typical"))).alias("hi"), two_sided(c("z")).alias("p")).filter("p is not null")
    tests = benjamini_hochberg(ws.stage(tests, "split_tests"), keys, "p", q)
    sr_min = F.when(t20, 15.0).otherwise(10.0)
    enough = F.when(rate, F.abs(c("effect") - 1) >= 0.25).otherwise(F.abs("effect") >= sr_min)
    tests = tests.withColumns({"direction": F.when(c("effect") > c("null"), "higher").otherwise("lower"),
                               "effect_ok": enough & ((c("lo") > c("null")) | (c("hi") < c("null")))})

    def way(f: str, kind: str) -> Column:
        inside, outside = c(f"in_{f}") / c("in_n"), (c(f"t_{f}") - c(f"in_{f}")) / (c("t_n") - c("in_n"))
        return inside / F.when(outside > 0, outside).otherwise(1e-9) if kind == "rate" else 100 * (inside - outside)
    ok = (c("in_n") >= 30) & (c("t_n") - c("in_n") >= 30)
    sides = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(ok, way(f, k)).alias("seen"))
                               for m, f, k in (("out_rate", "outs", "rate"), ("bnd_rate", "bnd", "rate"), ("dot_rate", "dots", "rate"), ("sr", "runs", "mean"))]))
    both = half.select(*keys, "late", "split", sides).groupBy(*keys, "split", "metric").agg(
        F.max(F.when(~c("late"), c("seen"))).alias("early_seen"), F.max(F.when(c("late"), c("seen"))).alias("late_seen"))
    out = tests.join(both, [*keys, "split", "metric"], "left")
    higher_good = c("metric").isin("bnd_rate", "sr")

    def points(x: str) -> Column:
        return F.when(c(x) > c("typical"), "higher").otherwise("lower")
    unsure = c("early_seen").isNull() | c("late_seen").isNull()
    return out.withColumns({
        "strength": (c("direction") == "higher") == higher_good,
        "stability": F.when(unsure, "not enough data").when((points("early_seen") == c("direction")) & (points("late_seen") == c("direction")), "same").otherwise("not consistent"),
        "card": c("passed") & c("effect_ok")}).drop("null")


# ---------------------------------------------------------------- fingerprints

PEER_MIN = {"batting": {"T20": 500, "ODI": 800}, "bowling": {"T20": 480, "ODI": 900}}
DIM_MIN = {"batting": {"T20": 60, "ODI": 100}, "bowling": {"T20": 60, "ODI": 120}}
OUTS_MIN = 10
COUNTED_IN_OUTS = ["bowler_conc", "route_conc", "stumps_share"]
_PR = "coalesce(chasing, false) and required_rate >= case when format_group = 'T20' then 10 else 7 end"
BAT_SUBSETS = {"pp": "phase = 'powerplay'", "mid": "phase = 'middle'", "death": "phase = 'death'", "ch": "coalesce(chasing, false)",
               "set": "not coalesce(chasing, false)", "top": "wickets_before <= 2", "pr": _PR, "a30": "batter_balls_before >= 30", "b30": "batter_balls_before < 30"}
BOWL_SUBSETS = {"pp": "phase = 'powerplay'", "mid": "phase = 'middle'", "death": "phase = 'death'", "def": "coalesce(chasing, false)",
                "new": "batter_stage = 'new'", "set": "batter_stage = 'set'"}


def _dims(pairs: list[tuple[str, Column, Column]]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("double").alias("value"), n.cast("long").alias("n")) for k, v, n in pairs]))


def batting_dimensions(ws: Workspace) -> DataFrame:
    """Seventeen batting dimensions of every player, gender and format, in long form with their samples."""
    keys = ["pid", "gender", "format_group"]
    b = ws["balls"].filter(LIMITED).withColumnRenamed("batter_id", "pid")
    aggs = [_n("faced").alias("balls"), F.sum("runs_batter").alias("runs"), _n("faced and runs_batter = 0").alias("dots"), _n("is_four").alias("fours"), _n("is_six").alias("sixes")]
    for tag, test in BAT_SUBSETS.items():
        aggs += [_n(f"faced and ({test})").alias(f"{tag}_b"), F.sum(F.expr(f"case when {test} then runs_batter end")).alias(f"{tag}_r")]
    bat = b.groupBy(*keys).agg(*aggs)
    o = ws["dis"].filter("counts_as_dismissal and " + LIMITED).withColumnRenamed("player_out_id", "pid")
    outs = o.groupBy(*keys).agg(F.count("*").alias("outs"), _n("batter_balls_before >= 30 and striker_out").alias("a30_o"), _n("batter_balls_before < 30 and striker_out").alias("b30_o"))
    credited = o.filter("route not in ('RUN_OUT', 'OTHER', 'RETIRED_NOT_OUT')").groupBy(*keys, "bowler_id").agg(F.count("*").alias("k"))
    first3 = ranked(credited, keys, [F.desc("k"), F.asc("bowler_id")], 3).groupBy(*keys).agg(F.sum("k").alias("top3"))
    conc = credited.groupBy(*keys).agg(F.sum("k").alias("credited")).join(first3, keys)
    common = o.groupBy(*keys, "route").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.max("k").alias("top_route"))
    j = bat.join(outs, keys, "left").join(conc, keys, "left").join(common, keys, "left").fillna(0, ["outs", "a30_o", "b30_o", "top3", "credited", "top_route"])
    c = F.col
    sr = lambda t: (ratio(c(f"{t}_r"), c(f"{t}_b"), 100.0), c(f"{t}_b"))
    pct = lambda x, n: ratio(x, c(n), 100.0)
    pairs = [("sr", pct(c("runs"), "balls"), c("balls")), ("boundary_pct", pct(c("fours") + c("sixes"), "balls"), c("balls")), ("six_pct", pct(c("sixes"), "balls"), c("balls")),
             ("dot_pct", pct(c("dots"), "balls"), c("balls")), ("out_rate", pct(c("outs"), "balls"), c("balls")), ("pp_sr", *sr("pp")), ("mid_sr", *sr("mid")), ("death_sr", *sr("death")),
             ("chase_sr", *sr("ch")), ("set_sr", *sr("set")), ("top_sr", *sr("top")), ("pressure_sr", *sr("pr")), ("after30_sr", *sr("a30")),
             ("after30_out", pct(c("a30_o"), "a30_b"), c("a30_b")), ("early_out", pct(c("b30_o"), "b30_b"), c("b30_b")),
             ("bowler_conc", pct(c("top3"), "credited"), c("credited")), ("route_conc", pct(c("top_route"), "outs"), c("outs"))]
    return j.select(*keys, "balls", _dims(pairs))


def bowling_dimensions(ws: Workspace) -> DataFrame:
    """Twelve bowling dimensions of every player, gender and format, in long form with their samples."""
    keys = ["pid", "gender", "format_group"]
    b = ws["balls"].filter(LIMITED).withColumnRenamed("bowler_id", "pid").withColumn("rc", F.expr("runs_batter + wides + noballs"))
    aggs = [_n("legal").alias("balls"), F.sum("rc").alias("runs"), _n("legal and rc = 0").alias("dots"), _n("is_four or is_six").alias("bnd"),
            _n("wides > 0 or noballs > 0").alias("extras"), F.sum("wk").alias("wkts"), F.sum(F.expr("case when batter_balls_before < 10 then wk end")).alias("new_w")]
    for tag, test in BOWL_SUBSETS.items():
        aggs += [_n(f"legal and ({test})").alias(f"{tag}_b"), F.sum(F.expr(f"case when {test} then rc end")).alias(f"{tag}_r")]
    stumps = ws["dis"].filter("bowler_credited and kind in ('bowled', 'lbw')").groupBy(F.col("bowler_id").alias("pid"), "gender", "format_group").agg(F.count("*").alias("stumps"))
    j = b.groupBy(*keys).agg(*aggs).join(stumps, keys, "left").fillna(0, ["stumps", "new_w"])
    c = F.col
    econ = lambda t: (ratio(c(f"{t}_r"), c(f"{t}_b"), 6.0), c(f"{t}_b"))
    pct = lambda x, n: ratio(c(x), c(n), 100.0)
    pairs = [("econ", ratio(c("runs"), c("balls"), 6.0), c("balls")), ("dot_pct", pct("dots", "balls"), c("balls")), ("bnd_pct", pct("bnd", "balls"), c("balls")),
             ("extras_pct", pct("extras", "balls"), c("balls")), ("wkt_rate", pct("wkts", "balls"), c("balls")), ("stumps_share", pct("stumps", "wkts"), c("wkts")),
             ("pp_econ", *econ("pp")), ("mid_econ", *econ("mid")), ("death_econ", *econ("death")), ("def_econ", *econ("def")), ("new_wkt", pct("new_w", "new_b"), c("new_b")), ("set_econ", *econ("set"))]
    return j.select(*keys, "balls", _dims(pairs))


def fingerprint(ws: Workspace, role: str = "batting", peer_min: dict[str, int] | None = None, dim_min: dict[str, int] | None = None,
                outs_min: int = OUTS_MIN) -> DataFrame:
    """Each dimension's percentile among peers with enough balls overall and enough of the dimension's own sample."""
    pm, dm = peer_min or PEER_MIN[role], dim_min or DIM_MIN[role]
    rows = batting_dimensions(ws) if role == "batting" else bowling_dimensions(ws)
    t20 = F.col("format_group") == "T20"
    least = F.when(F.col("dimension").isin(*COUNTED_IN_OUTS), outs_min).when(t20, dm["T20"]).otherwise(dm["ODI"])
    rows = rows.withColumn("enough", F.col("value").isNotNull() & (F.col("n") >= least))
    pool = F.col("enough") & (F.col("balls") >= F.when(t20, pm["T20"]).otherwise(pm["ODI"]))
    keys = ["gender", "format_group", "dimension"]
    out = percentile_rank(ws.stage(rows.withColumn("in_pool", pool), "dimensions"), keys, "value", F.col("in_pool"))
    return out.withColumn("percentile", F.when(F.col("enough"), F.col("percentile")))


def extremes(prints: DataFrame, low: float = 12, high: float = 88, k: int = 6) -> DataFrame:
    rows = prints.filter((F.col("percentile") <= low) | (F.col("percentile") >= high))
    return ranked(rows, ["pid", "gender", "format_group"], [F.desc(F.abs(F.col("percentile") - 50)), F.asc("dimension")], k)
