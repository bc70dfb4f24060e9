"""Working relations: the denormalised ball, the dismissal, and the per-innings, per-pair and per-team tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import canonical_team
from inswing.operators.sequence import with_marks, with_situation
from inswing.plans.workspace import Workspace, relation

INN = ["match_id", "innings_no"]
LIMITED = "format_group in ('T20', 'ODI')"


def seq_of(delivery_id: Column) -> Column:
    return F.element_at(F.split(delivery_id, ":"), -1).cast("int")


@relation("batting_order")
def batting_order(ws: Workspace) -> DataFrame:
    """Order of first appearance at the crease; of the opening pair the striker of ball 1 comes first."""
    d = ws["deliveries"]
    at_crease = d.select(*INN, "seq", F.explode(F.array("batter_id", "non_striker_id")).alias("person_id"),
                         F.col("batter_id").alias("striker"))
    gone = ws["wickets"].select(*INN, seq_of(F.col("delivery_id")).alias("seq"),
                                F.col("player_out_id").alias("person_id"), F.lit(None).cast("string").alias("striker"))
    first = (
        at_crease.unionByName(gone).filter("person_id is not null")
        .groupBy(*INN, "person_id").agg(
            F.min("seq").alias("first_seq"),
            F.bool_or((F.col("seq") == 1) & (F.col("striker") == F.col("person_id"))).alias("opened"))
    )
    raw = F.row_number().over(Window.partitionBy(*INN).orderBy("first_seq", "person_id"))
    return first.withColumn("raw", raw).select(
        *INN, "person_id",
        F.when(F.col("first_seq") == 1, F.when(F.coalesce("opened", F.lit(False)), 1).otherwise(2))
        .otherwise(F.col("raw")).alias("batting_position"))


@relation("keeper_inference")
def keeper_inference(ws: Workspace) -> DataFrame:
    """Who kept wicket: the only player with a stumping in the match, else the XI's dominant career stumper."""
    side = ws["innings"].select(*INN, F.col("bowling_team").alias("team"))
    stump = (
        ws["wickets"].filter("kind = 'stumped'").select(*INN, "delivery_id", "wicket_idx")
        .join(ws["wicket_fielders"].filter("not substitute and fielder_id is not null")
              .select("delivery_id", "wicket_idx", F.col("fielder_id").alias("person_id")),
              ["delivery_id", "wicket_idx"])
        .join(side, INN).select("match_id", "team", "person_id").distinct()
    )
    alone = stump.groupBy("match_id", "team").agg(F.count("*").alias("k"), F.min("person_id").alias("person_id")) \
        .filter("k = 1").select("match_id", "team", "person_id", F.lit("stumping_in_match").alias("method"),
                                F.lit(0.97).alias("confidence"))
    career = stump.groupBy("person_id").agg(F.countDistinct("match_id").alias("stumping_matches"))
    bowled = ws["deliveries"].select(*INN, F.col("bowler_id").alias("person_id")).distinct().join(side, INN) \
        .select("match_id", "team", "person_id").distinct()
    w = Window.partitionBy("match_id", "team").orderBy(F.desc("stumping_matches"), "person_id")
    best = (
        ws["players_in_match"].select("match_id", "team", "person_id").join(career, "person_id")
        .join(bowled, ["match_id", "team", "person_id"], "left_anti")
        .withColumn("rk", F.row_number().over(w))
        .withColumn("runner_up", F.lead("stumping_matches").over(w))
        .filter("rk = 1 and stumping_matches >= 2 and stumping_matches >= 3 * coalesce(runner_up, 0)")
    )
    sole = F.col("runner_up").isNull()
    inferred = best.join(alone, ["match_id", "team"], "left_anti").select(
        "match_id", "team", "person_id",
        F.when(sole, "sole_career_keeper_in_xi").otherwise("dominant_career_keeper_in_xi").alias("method"),
        F.when(sole, 0.95).otherwise(0.90).alias("confidence"))
    return alone.unionByName(inferred)


def route(kind: Column, fielder: Column, bowler: Column, keeper: Column, substitute: Column) -> Column:
    """How the batter got out, as far as the scorecard says; a catcher's role is never guessed."""
    caught, sub = kind == "caught", F.coalesce(substitute, F.lit(False))
    return (
        F.when(caught & (fielder == bowler), "CAUGHT_BOWLER")
        .when(caught & fielder.isNull(), "CAUGHT_UNKNOWN_FIELDER")
        .when(caught & ~sub & (fielder == keeper), "CAUGHT_KEEPER")
        .when(caught & (sub | keeper.isNotNull()), "CAUGHT_FIELDER")
        .when(caught, "CAUGHT_KEEPER_STATUS_UNKNOWN")
        .when(kind == "caught and bowled", "CAUGHT_BOWLER")
        .when(kind.isin("bowled", "lbw", "stumped", "run out", "hit wicket"),
              F.upper(F.replace(kind, F.lit(" "), F.lit("_"))))
        .when(kind.isin("retired hurt", "retired not out"), "RETIRED_NOT_OUT")
        .otherwise("OTHER")
    )


@relation("dismissals")
def dismissals(ws: Workspace) -> DataFrame:
    """One row per wicket with the route, where it comes from and how sure it is."""
    fielders = ws["wicket_fielders"].groupBy("delivery_id", "wicket_idx").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("fielder_idx").alias("idx"), F.col("fielder_id").alias("id"), F.col("fielder").alias("name"),
            F.col("substitute").alias("sub")))).alias("fielders"))
    lead = F.filter("fielders", lambda f: f["idx"] == 0)[0]
    ball = ws["deliveries"].filter("n_wickets > 0").select("delivery_id", "match_id", "bowler_id", "batter_id", "over", "ball_label", "phase")
    side = ws["innings"].select(*INN, "bowling_team")
    keeper = ws["keeper_inference"].select(
        "match_id", F.col("team").alias("bowling_team"), F.col("person_id").alias("keeper_id"),
        F.col("method").alias("keeper_method"), F.col("confidence").alias("keeper_conf"))
    rows = (
        ws["wickets"].join(ball, ["match_id", "delivery_id"]).join(side, INN)
        .join(fielders, ["delivery_id", "wicket_idx"], "left").join(keeper, ["match_id", "bowling_team"], "left")
        .withColumn("fielder_id", lead["id"]).withColumn("fielder", lead["name"]).withColumn("substitute", lead["sub"])
    )
    held = (F.col("kind") == "caught") & (F.col("fielder_id") != F.col("bowler_id"))
    sub = F.coalesce(F.col("substitute"), F.lit(False))
    caught = F.col("kind") == "caught"
    return (
        rows
        .withColumn("route", route(F.col("kind"), F.col("fielder_id"), F.col("bowler_id"), F.col("keeper_id"),
                                   F.col("substitute")))
        .withColumn("route_prov", F.when(held, "DERIVED").otherwise("OBSERVED"))
        .withColumn("route_confidence", F.when(caught & sub, 0.95)
                    .when(caught & ((F.col("fielder_id") == F.col("keeper_id")) | held), F.col("keeper_conf")))
        .withColumn("route_method", F.when(held, "route_from_keeper_inference/v1"))
    )


MATCH_COLUMNS = ("gender format_group match_type team_type competition season start_date venue city team1 team2 winner "
                 "result method event_stage").split()


def innings_context(ws: Workspace) -> DataFrame:
    """Everything a ball inherits from its match and innings, one row per innings.

    The people, positions and wickets of an innings are bounded by the size of a side, so they travel as maps on this
    row, and the ball needs one join on (match_id, innings_no) instead of one per attribute.
    """
    d = ws["deliveries"]
    traits = ws["player_profile"].select(
        "person_id", F.struct("batting_hand", "batting_hand_source", "bowling_family", "bowling_family_prov",
                              "bowling_family_source", "bowling_arm", "bowling_style").alias("traits"))
    people = (
        d.select(*INN, F.explode(F.array("batter_id", "bowler_id")).alias("person_id")).distinct()
        .join(traits, "person_id").groupBy(*INN)
        .agg(F.map_from_entries(F.collect_list(F.struct("person_id", "traits"))).alias("people"))
    )
    places = ws["batting_order"].groupBy(*INN).agg(
        F.map_from_entries(F.collect_list(F.struct("person_id", "batting_position"))).alias("places"))
    falls = (
        ws["wickets"].groupBy(*INN, "delivery_id").agg(
            F.count_if("bowler_credited").alias("wk"), F.count_if("counts_as_dismissal").alias("outs"),
            F.bool_or(F.col("counts_as_dismissal") & F.col("striker_out")).alias("striker_dismissed"),
            F.bool_or(F.col("bowler_credited") & F.col("striker_out")).alias("striker_credited"))
        .groupBy(*INN).agg(F.map_from_entries(F.collect_list(F.struct(
            "delivery_id", F.struct("wk", "outs", "striker_dismissed", "striker_credited")))).alias("falls"))
    )
    m = ws["matches"].select("match_id", *MATCH_COLUMNS, "scheduled_overs", "balls_per_over")
    i = ws["innings"].filter("not super_over").select(*INN, "batting_team", "bowling_team", "target_overs")
    return i.join(m, "match_id").join(people, INN, "left").join(places, INN, "left").join(falls, INN, "left")


@relation("balls", partition_by=("format_group", "gender"))
def balls(ws: Workspace) -> DataFrame:
    """One row per delivery with match, innings, player and situation columns; super overs are left out."""
    # the context of the innings in a task is small: hashed, it leaves the balls unsorted
    b = with_marks(ws.spread(ws["deliveries"], *INN)).join(innings_context(ws).hint("shuffle_hash"), INN)
    bowl, bat, fell = F.col("people")[F.col("bowler_id")], F.col("people")[F.col("batter_id")], \
        F.col("falls")[F.col("delivery_id")]
    b = b.withColumns({
        "year": F.year("start_date"),
        "bowler_family": bowl["bowling_family"], "bowler_family_prov": bowl["bowling_family_prov"],
        "bowler_family_source": bowl["bowling_family_source"], "bowler_arm": bowl["bowling_arm"],
        "bowler_style": bowl["bowling_style"],
        "batter_hand": bat["batting_hand"], "batter_hand_source": bat["batting_hand_source"],
        "batter_position": F.col("places")[F.col("batter_id")],
        "faced": F.col("wides") == 0,
        "wk": F.coalesce(fell["wk"], F.lit(0)), "outs": F.coalesce(fell["outs"], F.lit(0)),
        "striker_dismissed": F.coalesce(fell["striker_dismissed"], F.lit(False)),
        "striker_credited": F.coalesce(fell["striker_credited"], F.lit(False)),
    }).drop("people", "places", "falls")
    out = with_situation(b).drop("scheduled_overs", "balls_per_over", "target_overs")
    return out.sortWithinPartitions("format_group", "gender", "match_id", "innings_no", "seq")


BALL_ON_DISMISSAL = (
    "gender format_group team_type competition season start_date year batting_team bowler batter bowler_family "
    "bowler_family_prov bowler_arm bowler_style chasing score_before wickets_before batter_runs_before "
    "batter_balls_before runs_total required_rate batter_position batter_hand bowler_family_source non_striker_id "
    "chase_state batter_stage seq venue"
).split()


@relation("dis")
def dis(ws: Workspace) -> DataFrame:
    """One row per wicket with the context of its ball."""
    return ws["dismissals"].join(ws["balls"].filter("n_wickets > 0").select("match_id", "delivery_id", *BALL_ON_DISMISSAL),
                                 ["match_id", "delivery_id"])


@relation("partnerships")
def partnerships(ws: Workspace) -> DataFrame:
    """Runs of consecutive balls with the same unordered pair at the crease, and how each ended."""
    inn = Window.partitionBy(*INN).orderBy("seq")
    b = ws.spread(ws["balls"].filter(LIMITED), *INN)
    pair = F.concat_ws("|", "p1", "p2")
    hit = F.col("runs_batter").isin(4, 6) & ~F.col("non_boundary")
    p1, p2, faced = F.col("batter_id") == F.col("p1"), F.col("batter_id") == F.col("p2"), F.col("faced")
    rows = (
        b.withColumn("p1", F.least("batter_id", "non_striker_id"))
        .withColumn("p2", F.greatest("batter_id", "non_striker_id"))
        .withColumn("fresh", (~pair.eqNullSafe(F.lag(pair).over(inn))).cast("int"))
        .withColumn("part_no", F.sum("fresh").over(inn).cast("int"))
        .withColumn("innings_end", F.max("seq").over(Window.partitionBy(*INN)))
    )
    firsts = ["p1", "p2", "gender", "format_group", "team_type", "competition", "season", "start_date", "year", "venue",
              "batting_team", "bowling_team", "innings_end"]
    parts = rows.groupBy(*INN, "part_no").agg(
        *[F.min(x).alias(x) for x in firsts],
        F.min("wickets_before").alias("wicket_no"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("over").alias("first_over"), F.max("over").alias("last_over"), F.min("score_before").alias("score_start"),
        F.sum("runs_total").alias("runs"), F.count_if("legal").alias("balls"),
        F.coalesce(F.sum(F.when(p1, F.col("runs_batter"))), F.lit(0)).alias("p1_runs"),
        F.count_if(p1 & faced).alias("p1_balls"),
        F.coalesce(F.sum(F.when(p2, F.col("runs_batter"))), F.lit(0)).alias("p2_runs"),
        F.count_if(p2 & faced).alias("p2_balls"), F.sum("runs_extras").alias("extras"),
        F.count_if(hit).alias("boundaries"), F.count_if(F.col("legal") & (F.col("runs_total") == 0)).alias("dots"),
        F.count_if(F.col("legal") & F.col("runs_batter").isin(1, 2, 3)).alias("rotations"),
        F.max_by("delivery_id", "seq").alias("last_delivery_id"),
    )
    gone = ws["wickets"].groupBy("match_id", F.col("delivery_id").alias("last_delivery_id")).agg(
        F.array_sort(F.collect_list("player_out_id")).alias("ended_outs"), F.collect_list("kind").alias("kinds"))
    mine = F.array_contains("ended_outs", F.col("p1")) | F.array_contains("ended_outs", F.col("p2"))
    retired = F.arrays_overlap("kinds", F.array(F.lit("retired hurt"), F.lit("retired not out")))
    return (
        parts.join(gone, ["match_id", "last_delivery_id"], "left")
        .withColumn("ended", F.when(mine, F.when(retired, "retired").otherwise("wicket"))
                    .when(F.col("last_seq") == F.col("innings_end"), "unbroken").otherwise("other"))
        .withColumn("partnership_id", F.concat_ws(":", "match_id", "innings_no", "part_no"))
        .drop("kinds", "innings_end")
    )


@relation("spells")
def spells(ws: Workspace) -> DataFrame:
    """A bowler's overs, numbered by spell: a gap of more than two overs starts a new one."""
    b = ws.spread(ws["balls"].filter(LIMITED), *INN)
    hit = F.col("runs_batter").isin(4, 6) & ~F.col("non_boundary")
    overs = b.groupBy(*INN, "bowler_id", "over").agg(
        F.min("bowler").alias("bowler"), F.min("gender").alias("gender"), F.min("format_group").alias("format_group"),
        F.min("start_date").alias("start_date"),
        F.sum(F.col("runs_batter") + F.col("wides") + F.col("noballs")).alias("runs"),
        F.count_if("legal").alias("balls"), F.count_if(F.col("legal") & (F.col("runs_total") == 0)).alias("dots"),
        F.count_if(hit).alias("boundaries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("score_before").alias("score_start"), F.min("wickets_before").alias("wkts_start"),
        F.sum("wk").alias("wickets"))
    w = Window.partitionBy(*INN, "bowler_id").orderBy("over")
    gap = F.col("over") - F.lag("over").over(w)
    return overs.withColumn("brk", F.when(gap <= 2, 0).otherwise(1)).withColumn(
        "spell_no", F.sum("brk").over(w).cast("int"))


@relation("bat_innings")
def bat_innings(ws: Workspace) -> DataFrame:
    """One row per batter and innings: state on arrival, the innings, its last ten balls and its end.

    Balls are shuffled once by innings; the striker's ball count, the two roles and the aggregate all reuse that.
    """
    b = ws.spread(ws["balls"].filter(LIMITED), *INN)
    n_faced = F.count_if("faced").over(Window.partitionBy(*INN, "batter_id"))
    arrival = F.struct(
        "seq", "gender", "format_group", "team_type", "competition", "season", "start_date", "year", "venue", "city",
        "batting_team", "bowling_team", "winner", "result", "method", "chasing", "score_before", "wickets_before",
        "over", "runs_required", "balls_left", "required_rate")
    on = F.col("on_strike")
    faced, death = on & F.col("faced"), F.col("phase") == "death"
    late = faced & (F.col("batter_balls_before") >= F.col("n_faced") - 10)

    def runs(when: Column) -> Column:
        return F.sum(F.when(when, F.col("runs_batter")))

    rows = (
        b.withColumn("n_faced", n_faced).withColumn("arrival", arrival)
        .select(*INN, "seq", "arrival", "faced", "phase", "batter_balls_before", "n_faced", "runs_batter", "is_four",
                "is_six", F.inline(F.array(
                    F.struct(F.col("batter_id").alias("pid"), F.lit(True).alias("on_strike")),
                    F.struct(F.col("non_striker_id").alias("pid"), F.lit(False).alias("on_strike")))))
        .filter("pid is not null")
    )
    stays = rows.groupBy(*INN, "pid").agg(
        F.min("arrival").alias("a"), F.max("seq").alias("last_seq"),
        F.coalesce(runs(on), F.lit(0)).alias("runs"), F.count_if(faced).alias("balls"),
        F.count_if(on & F.col("is_four")).alias("fours"), F.count_if(on & F.col("is_six")).alias("sixes"),
        F.count_if(faced & (F.col("runs_batter") == 0)).alias("dots"),
        F.coalesce(runs(on & death), F.lit(0)).alias("death_runs"), F.count_if(faced & death).alias("death_balls"),
        runs(late).alias("r10"), F.nullif(F.count_if(late), F.lit(0)).alias("b10"))
    outs = ws["dis"].filter("counts_as_dismissal").groupBy(*INN, F.col("player_out_id").alias("pid")).agg(
        F.min(F.struct("delivery_id", "kind", "bowler_id", "bowler")).alias("o"))
    places = ws["batting_order"].select(*INN, F.col("person_id").alias("pid"), F.col("batting_position").alias("position"))
    j = stays.join(outs, [*INN, "pid"], "left").join(places, [*INN, "pid"], "left")
    same = ["gender", "format_group", "team_type", "competition", "season", "start_date", "year", "venue", "city"]
    return j.select(
        *INN, F.col("pid").alias("batter_id"), *[F.col(f"a.{x}") for x in same],
        F.col("a.batting_team").alias("team"), F.col("a.bowling_team").alias("opponent"), "a.winner", "a.result",
        "a.method", "runs", "balls", "fours", "sixes", "dots", "death_runs", "death_balls", "r10", "b10",
        F.col("o.kind").alias("out_kind"), F.col("o.bowler_id").alias("out_bowler_id"),
        F.col("o.bowler").alias("out_bowler"), F.col("o.delivery_id").alias("out_delivery_id"),
        F.col("o").isNull().alias("not_out"), "position", "a.chasing",
        (F.col("a.winner") == F.col("a.batting_team")).alias("won"), F.col("a.score_before").alias("arrived_score"),
        F.col("a.wickets_before").alias("arrived_wickets"), F.col("a.over").alias("arrived_over"),
        F.col("a.runs_required").alias("req_at_arrival"), F.col("a.balls_left").alias("balls_left_at_arrival"),
        F.col("a.required_rate").alias("rrr_at_arrival"), F.col("a.seq").alias("first_seq"), "last_seq")


@relation("bowl_innings")
def bowl_innings(ws: Workspace) -> DataFrame:
    """One row per bowler and innings: figures, death and set-batter splits, best burst of wickets in 12 balls."""
    rc = F.col("runs_batter") + F.col("wides") + F.col("noballs")
    w = Window.partitionBy(*INN, "bowler_id").orderBy("seq").rowsBetween(-11, 0)
    b = ws.spread(ws["balls"].filter(LIMITED), *INN).withColumn("rc", rc).withColumn("burst", F.sum("wk").over(w))
    death, to_set, legal = F.col("phase") == "death", F.col("batter_stage") == "set", F.col("legal")
    firsts = {"bowler": "bowler_name", "gender": "gender", "format_group": "format_group", "team_type": "team_type",
              "competition": "competition", "season": "season", "start_date": "start_date", "year": "year",
              "venue": "venue", "bowling_team": "team", "batting_team": "opponent", "winner": "winner"}
    return b.groupBy(*INN, "bowler_id").agg(
        *[F.min(k).alias(v) for k, v in firsts.items()],
        F.bool_or(F.coalesce("chasing", F.lit(False))).alias("defending"),
        F.count_if(legal).alias("balls"), F.sum("rc").alias("runs"), F.sum("wk").alias("wickets"),
        F.count_if(legal & (F.col("rc") == 0)).alias("dots"),
        F.count_if(F.col("is_four") | F.col("is_six")).alias("boundaries"),
        F.count_if((F.col("wides") > 0) | (F.col("noballs") > 0)).alias("extras_balls"),
        F.count_if(legal & death).alias("death_balls"), F.sum(F.when(death, F.col("rc"))).alias("death_runs"),
        F.sum(F.when(death, F.col("wk"))).alias("death_wkts"), F.count_if(legal & to_set).alias("set_balls"),
        F.sum(F.when(to_set, F.col("rc"))).alias("set_runs"),
        F.coalesce(F.sum(F.when(to_set, F.col("wk"))), F.lit(0)).alias("set_wkts"),
        F.max("burst").alias("best_burst12"), F.countDistinct("over").alias("overs_bowled"),
    ).withColumn("won", F.col("winner") == F.col("team"))


BATTLE_MIN_BALLS = 12


@relation("battles")
def battles(ws: Workspace) -> DataFrame:
    """Batter against bowler, with the usual rates of both; credited wickets come from the ball's own flag."""
    b = ws["balls"].filter(LIMITED)
    faced = F.col("faced")

    def usual(who: str, prefix: str, out: str, fell: Column) -> DataFrame:
        return b.groupBy(who, "gender").agg(
            (F.sum(F.when(faced, F.col("runs_batter"))) / F.nullif(F.count_if(faced), F.lit(0))).alias(f"{prefix}_rpb"),
            F.count_if(faced).alias(f"{prefix}_balls_all"), F.sum(fell).alias("w")) \
            .withColumn(out, F.col("w") / F.nullif(F.col(f"{prefix}_balls_all"), F.lit(0))).drop("w")

    pairs = b.groupBy("batter_id", "bowler_id", "gender").agg(
        F.count_if(faced).alias("balls"), F.sum("runs_batter").alias("runs"),
        F.count_if(faced & (F.col("runs_batter") == 0)).alias("dots"), F.count_if("is_four").alias("fours"),
        F.count_if("is_six").alias("sixes"), F.countDistinct("match_id").alias("matches"),
        F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"),
        F.avg((F.col("phase") == "powerplay").cast("double")).alias("pp_share"),
        F.avg((F.col("phase") == "death").cast("double")).alias("death_share"),
        F.avg((F.col("format_group") == "T20").cast("double")).alias("t20_share"),
        F.array_sort(F.collect_set("format_group")).alias("formats"),
        F.array_sort(F.collect_set("competition")).alias("competitions"),
        F.min("batter").alias("batter_name"), F.min("bowler").alias("bowler_name"),
        F.sum(F.col("striker_credited").cast("int")).alias("outs"),
    ).filter(F.col("balls") >= BATTLE_MIN_BALLS)
    return (
        pairs.join(usual("batter_id", "batter", "batter_out_rate", F.col("striker_credited").cast("int")), ["batter_id", "gender"])
        .join(usual("bowler_id", "bowler", "bowler_wkt_rate", F.col("wk")), ["bowler_id", "gender"])
    )


@relation("team_results")
def team_results(ws: Workspace) -> DataFrame:
    """One row per limited-overs match: both innings side by side, and the team pair under current names."""
    def at(no: int, col: str, name: str) -> Column:
        return F.max(F.when(F.col("innings_no") == no, F.col(col))).alias(f"i{no}_{name}")
    t = ws["innings"].filter("not super_over").groupBy("match_id").agg(*[
        at(no, col, name) for no in (1, 2) for col, name in (
            ("batting_team", "team"), ("total_runs", "runs"), ("total_wickets", "wkts"), ("legal_balls", "balls"))])
    a, b = canonical_team("team1"), canonical_team("team2")
    m = ws["matches"].filter(LIMITED).select(
        "match_id", "start_date", F.year("start_date").alias("year"), "season", "gender", "format_group", "team_type",
        "competition", "event_stage", "venue", "city", "team1", "team2", F.least(a, b).alias("ta"),
        F.greatest(a, b).alias("tb"), F.when(F.col("winner").isNotNull(), canonical_team("winner")).alias("winner_c"),
        "winner", "result", "method", "win_by_runs", "win_by_wickets", "toss_winner", "toss_decision",
        "player_of_match")
    return m.join(t, "match_id", "left")
