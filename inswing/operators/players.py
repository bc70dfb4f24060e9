"""Player tables for the whole population; a caller filters on the player."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import ranked, ratio
from inswing.plans.workspace import Workspace

INN = ["match_id", "innings_no"]


def _n(test: str) -> Column:
    return F.count_if(F.expr(test))


def featured(ws: Workspace, k: int = 4) -> DataFrame:
    """The players of each gender with most balls faced and bowled."""
    bat = ws["balls"].groupBy(F.col("batter_id").alias("person_id")).agg(_n("faced").alias("balls_faced"))
    bowl = ws["balls"].groupBy(F.col("bowler_id").alias("person_id")).agg(_n("legal").alias("balls_bowled"))
    rows = (
        ws["player_profile"].select("person_id", "name", "role", "matches", F.get("genders", F.lit(0)).alias("gender"))
        .join(bat, "person_id", "left").join(bowl, "person_id", "left").fillna(0, ["balls_faced", "balls_bowled"])
    )
    return ranked(rows, ["gender"], [F.desc(F.col("balls_faced") + F.col("balls_bowled")), F.asc("person_id")], k)


def alias_search(ws: Workspace, text: str, limit: int = 12) -> DataFrame:
    """Players by id, or by any alias that contains the text in any case."""
    hit = F.exists("aliases", lambda a: F.lower(a).contains(text.lower()))
    return ws["player_profile"].filter((F.col("person_id") == text) | hit).orderBy(F.desc("matches"), "person_id").limit(limit)


def appearances(ws: Workspace) -> DataFrame:
    """One row per player and match, with the match's columns and both teams from the player's side."""
    m = ws["matches"].select("match_id", "start_date", "format_group", "team_type", "competition", "gender", "team1", "team2")
    mine = F.col("team") == F.col("team1")
    return ws["players_in_match"].select("match_id", "team", "person_id").join(m, "match_id").withColumn(
        "opponent", F.when(mine, F.col("team2")).otherwise(F.col("team1")))


def coverage(ws: Workspace) -> DataFrame:
    """Per player and competition (or international format): span, matches and what the source says is missing."""
    fmt = F.when(F.col("format_group") == "T20", "T20I").otherwise(F.col("format_group"))
    label = F.when(F.col("team_type") == "international", fmt).otherwise(F.col("competition"))
    rows = appearances(ws).withColumn("label", label).groupBy("person_id", "label", "team_type", "format_group", "gender").agg(
        F.min("team").alias("team"), F.countDistinct("match_id").alias("matches"), F.min("start_date").alias("first_date"),
        F.max("start_date").alias("last_date"))
    pct = ws["source_coverage_pct"].select(F.col("competition").alias("label"), "have", "of")
    # missing matches of each team, one row per team and day, running total by day: a range count becomes two lookups
    missing = ws["source_missing_matches"].select(
        "gender", "start_date", F.explode(F.array("team1", "team2")).alias("team")).groupBy("gender", "team", "start_date").agg(F.count("*").alias("n"))
    spans = rows.filter("team_type = 'international' and format_group = 'ODI'").select("person_id", "label", "format_group", "gender", "team", "first_date", "last_date")
    gap = (
        spans.join(missing, ["gender", "team"]).filter(F.col("start_date").between(F.col("first_date"), F.col("last_date")))
        .groupBy("person_id", "label", "format_group", "gender").agg(F.sum("n").alias("listed_missing"))
    )
    out = rows.join(pct, "label", "left").join(gap, ["person_id", "label", "format_group", "gender"], "left")
    intl = F.col("team_type") == "international"
    status = (
        F.when(~intl, F.when(F.col("have").isNull(), "UNKNOWN").when(F.col("have") == F.col("of"), "COMPLETE").otherwise("PARTIAL"))
        .when(F.col("format_group") == "ODI", F.when(F.coalesce("listed_missing", F.lit(0)) == 0, "COMPLETE_FOR_TEAM").otherwise("PARTIAL"))
        .otherwise("UNKNOWN")
    )
    return out.withColumn("status", status)


def left_censored(ws: Workspace, days: int = 365) -> DataFrame:
    """First covered match close to the start of the source's coverage: earlier matches are likely."""
    first = appearances(ws).filter("competition is not null").groupBy("person_id", "competition").agg(F.min("start_date").alias("first_date"))
    return first.join(ws["source_coverage_periods"], "competition").withColumn(
        "possible_earlier_matches", F.datediff("first_date", "coverage_from") <= days)


def batting_lines(ws: Workspace) -> DataFrame:
    """Every innings in which a player appeared at the crease, with the score and whether they were out."""
    out = ws["wickets"].groupBy(*INN, F.col("player_out_id").alias("batter_id")).agg(F.bool_or("counts_as_dismissal").alias("is_out"))
    return ws["bat_innings"].select(
        *INN, "batter_id", "position", "start_date", "format_group", "gender", "competition", "team", "opponent", "runs", "balls",
        "fours", "sixes").join(out, [*INN, "batter_id"], "left").withColumn("is_out", F.coalesce("is_out", F.lit(False)))


def batting_summary(ws: Workspace, by: tuple[str, ...] = ("batter_id",)) -> DataFrame:
    b = ws["bat_innings"]
    out = ~F.col("not_out")
    best = F.max(F.struct(F.col("runs"), F.col("not_out").cast("int").alias("no")))
    return b.groupBy(*by).agg(
        F.count("*").alias("innings"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.count_if(out).alias("outs"),
        _n("not_out").alias("not_outs"), F.max("runs").alias("hs"), (best["no"] == 1).alias("hs_not_out"),
        _n("runs >= 50 and runs < 100").alias("fifties"), _n("runs >= 100").alias("hundreds"), F.count_if(out & (F.col("runs") == 0)).alias("ducks"),
        F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"),
    ).withColumns({"average": ratio(F.col("runs"), F.col("outs")), "strike_rate": ratio(F.col("runs"), F.col("balls"), 100.0)})


def bowling_summary(ws: Workspace, by: tuple[str, ...] = ("bowler_id",)) -> DataFrame:
    return ws["bowl_innings"].groupBy(*by).agg(
        F.count("*").alias("innings"), F.sum("balls").alias("balls"), F.sum("runs").alias("runs"), F.sum("wickets").alias("wickets"),
        F.max("wickets").alias("best_wickets_innings"), _n("wickets >= 4").alias("four_plus"),
    ).withColumns({"economy": ratio(F.col("runs"), F.col("balls"), 6.0), "average": ratio(F.col("runs"), F.col("wickets")),
                   "strike_rate": ratio(F.col("balls"), F.col("wickets"))})


def fielding_summary(ws: Workspace) -> DataFrame:
    f = ws["wicket_fielders"].select("match_id", "delivery_id", "wicket_idx", F.col("fielder_id").alias("who"), F.col("substitute").alias("sub"))
    x = ws["dis"].select("match_id", "delivery_id", "wicket_idx", "kind", "route").join(f, ["match_id", "delivery_id", "wicket_idx"])
    return x.filter("who is not null").groupBy("who").agg(
        _n("kind = 'caught' and not sub").alias("catches"), _n("kind = 'caught' and route = 'CAUGHT_KEEPER'").alias("catches_as_keeper"),
        _n("kind = 'stumped'").alias("stumpings"), _n("kind = 'run out'").alias("run_out_involvements")).withColumnRenamed("who", "person_id")


def dismissal_routes(ws: Workspace) -> DataFrame:
    """How each player gets out: count, share and mean confidence of each route."""
    rows = ws["dis"].filter("route <> 'RETIRED_NOT_OUT'").groupBy("player_out_id", "route").agg(
        F.count("*").alias("n"), F.avg("route_confidence").alias("confidence"))
    whole = Window.partitionBy("player_out_id")
    return rows.withColumn("total", F.sum("n").over(whole)).withColumn("pct", ratio(F.col("n"), F.col("total"), 100.0))


def dismissal_splits(ws: Workspace) -> DataFrame:
    """Dismissals by bowler family and by phase in one pass of grouping sets."""
    rows = ws["dis"].filter("counts_as_dismissal").withColumn("family", F.coalesce("bowler_family", F.lit("unknown")))
    rows = rows.groupingSets([["player_out_id", "family"], ["player_out_id", "phase"]], "player_out_id", "family", "phase").agg(
        F.grouping("family").alias("by_phase"), F.count("*").alias("n"))
    by_phase = F.col("by_phase") == 1
    return rows.select("player_out_id", F.when(by_phase, "phase").otherwise("family").alias("dimension"),
                       F.when(by_phase, F.col("phase")).otherwise(F.col("family")).alias("bucket"), "n")


def chief_dismissers(ws: Workspace, k: int = 5) -> DataFrame:
    bowl = ws["dis"].filter("bowler_credited").groupBy("player_out_id", F.col("bowler_id").alias("other_id")).agg(F.count("*").alias("n")) \
        .withColumn("what", F.lit("bowler"))
    catch = ws["dis"].filter("kind = 'caught' and fielder_id is not null").groupBy("player_out_id", F.col("fielder_id").alias("other_id")) \
        .agg(F.count("*").alias("n")).withColumn("what", F.lit("catcher"))
    return ranked(bowl.unionByName(catch), ["player_out_id", "what"], [F.desc("n"), F.asc("other_id")], k)


MATCHUP_KEYS = {"bowler": "bowler_id", "batter": "batter_id", "bowler_family": "bowler_family", "bowler_style": "bowler_style",
                "bowler_arm": "bowler_arm", "batter_hand": "batter_hand"}


def matchups(ws: Workspace, by: str, role: str = "batter", rows: DataFrame | None = None) -> DataFrame:
    """A player against the members of a group; an unknown attribute stays its own (null) group."""
    if by not in MATCHUP_KEYS:
        raise ValueError(f"unknown matchup grouping {by}")
    me = "batter_id" if role == "batter" else "bowler_id"
    key = MATCHUP_KEYS[by]
    b = ws["balls"] if rows is None else rows
    other = F.col("striker_dismissed") & ~F.col("striker_credited")
    out = b.groupBy(F.col(me).alias("person_id"), F.col(key).alias("k")).agg(
        _n("faced").alias("balls"), F.sum("runs_batter").alias("runs"), _n("faced and runs_batter = 0").alias("dots"),
        _n("faced and runs_batter = 1").alias("ones"), _n("faced and runs_batter = 2").alias("twos"), _n("faced and runs_batter = 3").alias("threes"),
        _n("is_four").alias("fours"), _n("is_six").alias("sixes"), _n("striker_credited").alias("dismissals"), F.count_if(other).alias("other_dismissals"))
    c = F.col
    return out.withColumns({
        "strike_rate": ratio(c("runs"), c("balls"), 100.0), "runs_per_dismissal": ratio(c("runs"), c("dismissals")),
        "dot_pct": ratio(c("dots"), c("balls"), 100.0), "boundary_pct": ratio(c("fours") + c("sixes"), c("balls"), 100.0),
        "balls_per_dismissal": ratio(c("balls"), c("dismissals"))})


def stage_of(faced: Column, bounds: list[int]) -> Column:
    """'0-9', '10-19', ..., '50+' for the given upper bounds."""
    out, low = None, 0
    for b in bounds:
        label = f"{low}-{b - 1}"
        out = F.when(faced < b, label) if out is None else out.when(faced < b, label)
        low = b
    return out.otherwise(f"{low}+")


SITUATIONS = ["over_no", "wickets_down", "innings_stage", "rate_band", "chase", "phase"]


def situations(ws: Workspace) -> DataFrame:
    """Six views of each batter's record from one scan: over, wickets down, stage, required rate, chase, phase."""
    rate = F.when(F.coalesce("chasing", F.lit(False)) & F.col("required_rate").isNotNull(),
                  F.when(F.col("required_rate") < 6, "<6").when(F.col("required_rate") < 8, "6-8").when(F.col("required_rate") < 10, "8-10")
                  .when(F.col("required_rate") < 12, "10-12").otherwise("12+"))
    b = ws["balls"].select(
        "batter_id", "phase", "faced", "runs_batter", "is_four", "is_six", "striker_dismissed", (F.col("over") + 1).cast("string").alias("over_no"),
        F.col("wickets_before").cast("string").alias("wickets_down"), stage_of(F.col("batter_balls_before"), [10, 20, 30, 50]).alias("innings_stage"),
        rate.alias("rate_band"), F.when(F.coalesce("chasing", F.lit(False)), "chasing").otherwise("setting").alias("chase"))
    sets = [["batter_id", d] for d in SITUATIONS]
    g = b.groupingSets(sets, "batter_id", *SITUATIONS).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in SITUATIONS], _n("faced").alias("balls"), F.sum("runs_batter").alias("runs"),
        _n("striker_dismissed").alias("dismissals"), _n("faced and runs_batter = 0").alias("dots"), _n("is_four or is_six").alias("boundaries"))
    dim, bucket = None, None
    for d in SITUATIONS:
        here = F.col(f"g_{d}") == 0
        dim = F.when(here, d) if dim is None else dim.when(here, d)
        bucket = F.when(here, F.col(d)) if bucket is None else bucket.when(here, F.col(d))
    c = F.col
    return g.select("batter_id", dim.alias("dimension"), bucket.alias("bucket"), "balls", "runs", "dismissals", "dots", "boundaries").withColumns({
        "strike_rate": ratio(c("runs"), c("balls"), 100.0), "dismissal_rate": ratio(c("dismissals"), c("balls"), 100.0),
        "dot_pct": ratio(c("dots"), c("balls"), 100.0), "boundary_pct": ratio(c("boundaries"), c("balls"), 100.0)})


def drill_down(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """One page of the balls behind each group's number, newest first, with the group's total.

    Only the first offset + limit rows of a group pass the shuffle; the total is a separate aggregate.
    """
    order = [F.desc("start_date"), F.asc("match_id"), F.asc("innings_no"), F.asc("seq")]
    page = ranked(rows, [key], order, offset + limit, "n").filter(F.col("n") > offset)
    return page.join(rows.groupBy(key).agg(F.count("*").alias("total")), key)


def career_timeline(ws: Workspace, period: str = "year") -> DataFrame:
    """A batter's record by year or season, format and level."""
    return ws["bat_innings"].groupBy("batter_id", period, "format_group", "team_type").agg(
        F.count("*").alias("innings"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.count_if(~F.col("not_out")).alias("outs"),
        F.countDistinct("match_id").alias("matches")).withColumns({
            "strike_rate": ratio(F.col("runs"), F.col("balls"), 100.0), "average": ratio(F.col("runs"), F.col("outs"))})


def gap_years(ws: Workspace) -> DataFrame:
    """Years without a covered match inside a player's active span."""
    years = appearances(ws).select("person_id", F.year("start_date").alias("year")).distinct()
    span = years.groupBy("person_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return span.select("person_id", F.explode(F.sequence("a", "b")).alias("year")).join(years, ["person_id", "year"], "left_anti")


def missing_by_year(ws: Workspace) -> DataFrame:
    """Matches of a team that the source lists as missing, by year."""
    return ws["source_missing_matches"].select("gender", F.year("start_date").alias("year"), F.explode(F.array("team1", "team2")).alias("team")) \
        .groupBy("gender", "team", "year").agg(F.count("*").alias("n"))


def career_both(ws: Workspace) -> DataFrame:
    """Batting and bowling by player, year and format side by side; either side may be absent."""
    keys = ["person_id", "year", "format_group"]
    bat = ws["bat_innings"].groupBy(F.col("batter_id").alias("person_id"), "year", "format_group").agg(
        F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.count_if(~F.col("not_out")).alias("outs"))
    bowl = ws["bowl_innings"].groupBy(F.col("bowler_id").alias("person_id"), "year", "format_group").agg(
        F.sum("runs").alias("conceded"), F.sum("balls").alias("bowled"), F.sum("wickets").alias("wickets"))
    c = F.col
    return bat.join(bowl, keys, "full").withColumns({
        "strike_rate": ratio(c("runs"), c("balls"), 100.0), "average": ratio(c("runs"), c("outs")), "economy": ratio(c("conceded"), c("bowled"), 6.0)})


def milestones(ws: Workspace, marks: tuple[int, ...] = (1000, 5000, 10000)) -> DataFrame:
    """Dates of a batter's first fifty, first hundred and career-run marks, with runs added up by day first."""
    b = ws["bat_innings"]
    first = b.groupBy("batter_id").agg(F.min(F.when(F.col("runs") >= 50, F.col("start_date"))).alias("first_fifty"),
                                       F.min(F.when(F.col("runs") >= 100, F.col("start_date"))).alias("first_hundred"))
    w = Window.partitionBy("batter_id").orderBy("start_date").rowsBetween(Window.unboundedPreceding, 0)
    run = b.groupBy("batter_id", "start_date").agg(F.sum("runs").alias("r")).withColumn("career", F.sum("r").over(w))
    reach = run.groupBy("batter_id").agg(*[F.min(F.when(F.col("career") >= m, F.col("start_date"))).alias(f"runs_{m}") for m in marks],
                                         F.max("career").alias("career"))
    return first.join(reach, "batter_id")


def peak_and_trough(ws: Workspace, min_balls: int = 300, min_years: int = 3) -> DataFrame:
    """Best and worst strike-rate year among years with enough balls, for players with enough such years."""
    y = ws["bat_innings"].groupBy("batter_id", "year").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls")).filter(F.col("balls") >= min_balls)
    y = y.withColumn("sr", ratio(F.col("runs"), F.col("balls"), 100.0))
    return y.groupBy("batter_id").agg(F.count("*").alias("years"), F.max(F.struct("sr", "year")).alias("p"), F.min(F.struct("sr", "year")).alias("t")) \
        .filter(F.col("years") >= min_years).select("batter_id", "years", F.col("p.year").alias("peak_year"), F.col("p.sr").alias("peak_sr"),
                                                    F.col("t.year").alias("trough_year"), F.col("t.sr").alias("trough_sr"))


def year_detail(ws: Workspace, k: int = 3) -> DataFrame:
    """Per player and year: best innings, best spells, bowlers faced most and opponents met most."""
    keys = ["person_id", "year"]
    inn = ranked(ws["bat_innings"].withColumn("key", F.concat_ws("|", *INN)), ["batter_id", "year"], [F.desc("runs"), F.asc("balls"), F.asc("key")], k) \
        .select(F.col("batter_id").alias("person_id"), "year", F.lit("innings").alias("what"), "rank", "key", F.col("runs").cast("double").alias("value"))
    spell = ranked(ws["bowl_innings"].withColumn("key", F.concat_ws("|", *INN)), ["bowler_id", "year"], [F.desc("wickets"), F.asc("runs"), F.asc("key")], k) \
        .select(F.col("bowler_id").alias("person_id"), "year", F.lit("spell").alias("what"), "rank", "key", F.col("wickets").cast("double").alias("value"))
    faced = ws["balls"].groupBy(F.col("batter_id").alias("person_id"), "year", F.col("bowler_id").alias("key")).agg(_n("faced").cast("double").alias("value"))
    met = ws["bat_innings"].groupBy(F.col("batter_id").alias("person_id"), "year", F.col("opponent").alias("key")).agg(F.sum("runs").cast("double").alias("value"))
    out = inn.unionByName(spell)
    for what, rows in (("bowler", faced), ("opponent", met)):
        out = out.unionByName(ranked(rows, keys, [F.desc("value"), F.asc("key")], k).withColumn("what", F.lit(what)))
    return out


INNINGS_ORDER = {"recent": [("start_date", False)], "runs": [("runs", False), ("balls", True)], "strike_rate": [("sr", False)]}


def innings_list(ws: Workspace, sort: str = "recent", min_balls: int = 0, k: int = 20) -> DataFrame:
    rows = ws["bat_innings"].filter(F.col("balls") >= min_balls).withColumn("sr", ratio(F.col("runs"), F.col("balls"), 100.0))
    order = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in INNINGS_ORDER[sort]]
    return ranked(rows, ["batter_id"], [*order, F.asc("match_id"), F.asc("innings_no")], k)


def spells_list(ws: Workspace, k: int = 20) -> DataFrame:
    s = ws["spells"].groupBy(*INN, "bowler_id", "spell_no").agg(
        F.min("start_date").alias("start_date"), F.count("*").alias("overs"), F.sum("balls").alias("balls"), F.sum("runs").alias("runs"),
        F.sum("wickets").alias("wickets"), F.sum("dots").alias("dots"), F.min("over").alias("first_over"), F.max("over").alias("last_over"))
    return ranked(s, ["bowler_id"], [F.desc("start_date"), F.asc("match_id"), F.asc("innings_no"), F.asc("spell_no")], k)


def wicket_profile(ws: Workspace) -> DataFrame:
    return ws["dis"].filter("bowler_credited").groupBy("bowler_id").agg(
        F.count("*").alias("wickets"), *[_n(f"kind = '{k}'").alias(k.replace(" ", "_")) for k in ("bowled", "lbw", "caught", "stumped", "caught and bowled")],
        *[_n(f"phase = '{p}'").alias(f"{p}_wickets") for p in ("powerplay", "middle", "death")],
        _n("batter_balls_before < 10").alias("new_batters"), _n("batter_balls_before >= 30").alias("set_batters"))


def primary_role(ws: Workspace, min_each: int = 1000) -> DataFrame:
    """Bowler if balls bowled exceed balls faced by three tenths, else batter; all-rounder apart from that, on enough of both."""
    bat = ws["bat_innings"].groupBy(F.col("batter_id").alias("person_id")).agg(F.sum("balls").alias("faced"))
    bowl = ws["bowl_innings"].groupBy(F.col("bowler_id").alias("person_id")).agg(F.sum("balls").alias("bowled"))
    j = bat.join(bowl, "person_id", "full").fillna(0, ["faced", "bowled"])
    less, more = F.least("faced", "bowled"), F.greatest("faced", "bowled")
    return j.withColumns({"role": F.when(F.col("bowled") > 1.3 * F.col("faced"), "bowler").otherwise("batter"),
                          "allrounder": (less >= min_each) & (less >= 0.35 * more)})


def dismissal_dna(ws: Workspace) -> DataFrame:
    """Dismissals by route, bowler, format, phase and style, with the share of them whose style is known."""
    dims = ["route", "bowler_id", "format_group", "phase", "bowler_style"]
    rows = ws["dis"].filter("counts_as_dismissal")
    g = rows.groupingSets([["player_out_id", d] for d in dims], "player_out_id", *dims).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims], F.count("*").alias("n"))
    dim, bucket = None, None
    for d in dims:
        here = F.col(f"g_{d}") == 0
        dim = F.when(here, d) if dim is None else dim.when(here, d)
        bucket = F.when(here, F.col(d)) if bucket is None else bucket.when(here, F.col(d))
    known = rows.groupBy("player_out_id").agg((F.count("bowler_style") / F.count(F.lit(1)) >= 0.5).alias("style_known"))
    return g.select("player_out_id", dim.alias("dimension"), bucket.alias("bucket"), "n").join(known, "player_out_id")


def best_partners(ws: Workspace, k: int = 5, min_stands: int = 1) -> DataFrame:
    """The partners with whom each player added most runs; each stand counts for both of its batters."""
    both = ws["partnerships"].select("runs", "balls", F.inline(F.array(
        F.struct(F.col("p1").alias("person_id"), F.col("p2").alias("partner_id")), F.struct(F.col("p2").alias("person_id"), F.col("p1").alias("partner_id")))))
    g = both.groupBy("person_id", "partner_id").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.count("*").alias("stands"),
                                                    F.max("runs").alias("best")).filter(F.col("stands") >= min_stands)
    return ranked(g, ["person_id"], [F.desc("runs"), F.asc("partner_id")], k)


def innings_facts(ws: Workspace) -> DataFrame:
    """Facts of each stay at the crease: strike changes, balls to 50 and 100, longest dot run, partners, best ten-ball rate."""
    w = Window.partitionBy(*INN, "batter_id").orderBy("seq")
    inn = Window.partitionBy(*INN).orderBy("seq")
    last10 = w.rowsBetween(-9, 0)
    b = ws.spread(ws["balls"], *INN).withColumn("swapped", (F.col("batter_id") != F.lag("batter_id").over(inn)).cast("int"))
    faced = b.filter("faced").withColumns({
        "runs_after": F.col("batter_runs_before") + F.col("runs_batter"), "balls_after": F.col("batter_balls_before") + 1,
        "rate10": F.when(F.col("batter_balls_before") >= 9, 10.0 * F.sum("runs_batter").over(last10)),
        "island": F.sum((F.col("runs_batter") > 0).cast("int")).over(w)})
    run = faced.withColumn("dot_run", F.sum((F.col("runs_batter") == 0).cast("int")).over(
        Window.partitionBy(*INN, "batter_id", "island")))

    def reached(n: int) -> Column:
        return F.min(F.when(F.col("runs_after") >= n, F.col("balls_after")))
    return run.groupBy(*INN, "batter_id").agg(
        F.count("*").alias("balls"), F.coalesce(F.sum("swapped"), F.lit(0)).alias("came_on_strike"), reached(50).alias("balls_to_50"),
        reached(100).alias("balls_to_100"), F.max("dot_run").alias("longest_dots"), F.max("rate10").alias("best_rate10"),
        F.countDistinct("non_striker_id").alias("partners"))


def spell_facts(ws: Workspace) -> DataFrame:
    """Facts of each bowler's innings: longest run of dots, batters faced, wicket balls and the over they bowled best."""
    w = Window.partitionBy(*INN, "bowler_id").orderBy("seq")
    rc = F.col("runs_batter") + F.col("wides") + F.col("noballs")
    b = ws.spread(ws["balls"], *INN).withColumn("rc", rc)
    b = b.withColumn("island", F.sum((~(F.col("legal") & (F.col("rc") == 0))).cast("int")).over(w))
    b = b.withColumn("dots", F.sum((F.col("legal") & (F.col("rc") == 0)).cast("int")).over(Window.partitionBy(*INN, "bowler_id", "island")))
    return b.groupBy(*INN, "bowler_id").agg(
        F.max("dots").alias("longest_dots"), F.countDistinct("batter_id").alias("batters"), F.sum("wk").alias("wickets"),
        F.min("over").alias("first_over"), F.max("over").alias("last_over"))


def compare_pairs(ws: Workspace, ids: list[str]) -> DataFrame:
    """Warnings for each pair of chosen players: eras apart, samples far apart, different levels, different gender."""
    s = ws["bat_innings"].filter(F.col("batter_id").isin(*ids)).groupBy("batter_id").agg(
        F.min("year").alias("y0"), F.max("year").alias("y1"), F.sum("balls").alias("balls"), F.min("gender").alias("gender"),
        (F.avg((F.col("team_type") == "club").cast("double"))).alias("club"))
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, F.col("a.batter_id") < F.col("b.batter_id"))
    lo, hi = F.least("a.balls", "b.balls"), F.greatest("a.balls", "b.balls")
    return j.select(
        F.col("a.batter_id").alias("left_id"), F.col("b.batter_id").alias("right_id"),
        ((F.col("a.y0") > F.col("b.y1")) | (F.col("b.y0") > F.col("a.y1"))).alias("eras_apart"), (hi >= 4 * lo).alias("samples_apart"),
        (F.abs(F.col("a.club") - F.col("b.club")) > 0.5).alias("levels_apart"), (F.col("a.gender") != F.col("b.gender")).alias("genders_differ"))


def hero(ws: Workspace, min_each: int = 1000) -> DataFrame:
    """Headline numbers of a player and the layout they call for."""
    bat = batting_summary(ws).select(F.col("batter_id").alias("person_id"), "runs", F.col("strike_rate").alias("bat_sr"), F.col("average").alias("bat_avg"))
    bowl = bowling_summary(ws).select(F.col("bowler_id").alias("person_id"), "wickets", "economy", F.col("average").alias("bowl_avg"))
    return primary_role(ws, min_each).join(bat, "person_id", "left").join(bowl, "person_id", "left").withColumn(
        "layout", F.when(F.col("allrounder"), "both").when(F.col("role") == "bowler", "bowling").otherwise("batting"))
