"""Context that follows from the order of the balls in an innings.

One shuffle by match serves every window here: each window's partition keys contain match_id, so a frame that is
already hash partitioned by match_id needs no further exchange.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import before, upto
from inswing.schema import BOWLER_CREDITED, NOT_DISMISSAL

INNINGS = ("match_id", "innings_no")


def phase(fmt: Column, over: Column, scheduled: Column, super_over: Column) -> Column:
    """Phase of the over; limited-overs formats have fixed bounds, others use shares of the scheduled overs."""
    def by(first: float, last: float, x: Column) -> Column:
        return F.when(x < first, "powerplay").when(x >= last, "death").otherwise("middle")
    return (
        F.when(super_over, "super_over")
        .when(fmt == "T20", by(6, 15, over))
        .when(fmt == "ODI", by(10, 40, over))
        .when(F.coalesce(scheduled, F.lit(0)) > 0, by(0.3, 0.75, over / scheduled))
        .otherwise("none")
    )


def overs_to_balls(overs: Column, per_over: Column) -> Column:
    """31.2 overs are 31 overs and 2 balls."""
    whole = F.floor(overs)
    return (whole * per_over + F.round((overs - whole) * 10)).cast("int")


def with_running_context(balls: DataFrame, order: str = "seq") -> DataFrame:
    """Score, wickets, legal balls, the striker's runs and balls and the stand, each just before the ball.

    Needs runs_total, runs_batter, wides, legal, over, dismissals (departures that count) and departures (any). The stand
    and the over are read off running totals at their first ball, so the innings is sorted once for all of them.
    """
    inn = before(*INNINGS, order=order)
    here = upto(*INNINGS, order=order)
    bat = before(*INNINGS, "batter_id", order=order)
    legal = F.col("legal").cast("int")

    def run(x: Column, w) -> Column:
        return F.coalesce(F.sum(x).over(w), F.lit(0)).cast("int")

    turn = ~F.col("over").eqNullSafe(F.lag("over").over(Window.partitionBy(*INNINGS).orderBy(order)))
    rows = balls.withColumns({
        "score_before": run(F.col("runs_total"), inn),
        "wickets_before": run(F.col("dismissals"), inn),
        "legal_balls_before": run(legal, inn),
        "over_turn": turn,
    })
    gone = F.col("departures") > 0
    rows = rows.withColumns({
        "stand_score": F.coalesce(F.max(F.when(gone, F.col("score_before") + F.col("runs_total"))).over(inn), F.lit(0)),
        "stand_balls": F.coalesce(F.max(F.when(gone, F.col("legal_balls_before") + legal)).over(inn), F.lit(0)),
        "over_balls": F.max(F.when(F.col("over_turn"), F.col("legal_balls_before"))).over(here),
        "batter_runs_before": run(F.col("runs_batter"), bat),
        "batter_balls_before": run((F.col("wides") == 0).cast("int"), bat),
    })
    number = F.col("legal_balls_before") - F.col("over_balls") + 1
    label = F.concat(F.col("over").cast("string"), F.lit("."), number.cast("string"))
    given = F.col("actual_delivery") if "actual_delivery" in balls.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "partnership_runs_before": (F.col("score_before") - F.col("stand_score")).cast("int"),
        "partnership_balls_before": (F.col("legal_balls_before") - F.col("stand_balls")).cast("int"),
        "ball_in_over": number.cast("int"),
        "ball_label": F.coalesce(given, label),  # an illegal ball carries the number of the legal ball that follows
    }).drop("over_turn", "stand_score", "stand_balls", "over_balls", "actual_delivery")


def with_chase(balls: DataFrame) -> DataFrame:
    """Chase equation before the ball; needs the innings' target and its limit in balls."""
    chasing = F.col("target_runs").isNotNull() & ~F.col("format_group").isin("Test", "MDM")
    left = F.when(chasing & (F.col("limit_balls") > 0), F.col("limit_balls") - F.col("legal_balls_before"))
    need = F.when(chasing, F.col("target_runs") - F.col("score_before"))
    return (
        balls
        .withColumn("chasing", F.coalesce(chasing, F.lit(False)))
        .withColumn("balls_remaining", left.cast("int"))
        .withColumn("runs_required", need.cast("int"))
        .withColumn("target_runs", F.when(chasing, F.col("target_runs")))
        .withColumn("required_rate", F.when(F.col("balls_remaining") > 0,
                                            F.col("runs_required") * 6.0 / F.col("balls_remaining")))
        .withColumn("current_rate", F.when(F.col("legal_balls_before") > 0,
                                           F.col("score_before") * 6.0 / F.col("legal_balls_before")))
    )


def wicket_flags(kind: Column) -> dict[str, Column]:
    return {"bowler_credited": kind.isin(*BOWLER_CREDITED), "counts_as_dismissal": ~kind.isin(*NOT_DISMISSAL)}


def innings_totals(deliveries: DataFrame) -> DataFrame:
    """Runs, wickets and legal balls per innings, before penalties."""
    return deliveries.groupBy(*INNINGS).agg(
        F.sum("runs_total").alias("runs"),
        F.sum("dismissals").alias("total_wickets"),
        F.count_if("legal").alias("legal_balls"),
    )


# ---------------------------------------------------------------- situation of a ball

RECENT = {"T20": 12, "ODI": 30}          # fixed values: legal balls in the recent window
CHASE_BAND = {"T20": 1.0, "ODI": 0.5}    # fixed values: runs per over


MARKS = ("last_team_hit last_team_run last_team_other recent_short recent_long fell_short fell_long last_bat_hit "
         "last_bat_run").split()


def _recent(value: str, span: int):
    w = Window.partitionBy(*INNINGS).orderBy("legal_balls_before").rangeBetween(-span, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("int")


def with_marks(balls: DataFrame) -> DataFrame:
    """Places of the last hits and runs and the recent windows, from columns of the balls alone.

    They come before a ball is joined with its match and people, while its rows are narrow. The legal balls before a ball
    never fall along the innings, so one order by them and the ball's number serves the innings and the value ranges; the
    striker's own balls take the other sort.
    """
    inn, bat = Window.partitionBy(*INNINGS).orderBy("legal_balls_before", "seq").rowsBetween(
        Window.unboundedPreceding, -1), before(*INNINGS, "batter_id")
    team_ix = F.col("legal_balls_before") + F.col("legal").cast("int")
    bat_ix = F.col("batter_balls_before") + 1
    hit = F.col("runs_batter").isin(4, 6) & ~F.col("non_boundary")
    return balls.withColumns({
        "last_team_hit": F.max(F.when(hit, team_ix)).over(inn),
        "last_team_run": F.max(F.when(F.col("runs_total") > 0, team_ix)).over(inn),
        "last_team_other": F.max(F.when(F.col("legal") & ~hit, team_ix)).over(inn),
    }).withColumns({
        "recent_short": _recent("runs_total", RECENT["T20"]), "recent_long": _recent("runs_total", RECENT["ODI"]),
        "fell_short": _recent("n_wickets", RECENT["T20"]), "fell_long": _recent("n_wickets", RECENT["ODI"]),
    }).withColumns({
        "last_bat_hit": F.max(F.when(hit, bat_ix)).over(bat),
        "last_bat_run": F.max(F.when((F.col("wides") == 0) & (F.col("runs_batter") > 0), bat_ix)).over(bat),
    })


def with_situation(marks: DataFrame) -> DataFrame:
    """Innings length, chase state, batter stage, streaks and the recent window of balls with their marks.

    Super overs must be excluded; outside limited-overs formats every column is null.
    """
    t20 = F.col("format_group") == "T20"
    length = F.coalesce(F.col("target_overs"), F.col("scheduled_overs").cast("double")) \
        * F.coalesce(F.col("balls_per_over"), F.lit(6))
    limit = F.round(length).cast("int")
    band = F.when(t20, CHASE_BAND["T20"]).otherwise(CHASE_BAND["ODI"])
    need, rate = F.col("required_rate"), F.col("current_rate")

    def since(count: str, mark: str) -> Column:
        return F.col(count) - F.coalesce(F.col(mark), F.lit(0))

    out = {
        "wickets_in_hand": 10 - F.col("wickets_before"),
        "innings_balls_limit": limit,
        "limit_uncertain": (F.col("innings_no") == 1) & F.col("method").isNotNull(),
        "balls_left": limit - F.col("legal_balls_before"),
        "progress_pct": F.round(100.0 * F.col("legal_balls_before") / F.nullif(length, F.lit(0.0)), 1),
        "chase_state": F.when(need < rate - band, "ahead").when(need > rate + band, "behind")
        .when(need.isNotNull() & rate.isNotNull(), "around"),
        "batter_stage": F.when(F.col("batter_balls_before") < 10, "new")
        .when(F.col("batter_balls_before") < 30, "settling").otherwise("set"),
        "batter_balls_since_boundary": since("batter_balls_before", "last_bat_hit"),
        "team_balls_since_boundary": since("legal_balls_before", "last_team_hit"),
        "recent_window": F.when(t20, RECENT["T20"]).otherwise(RECENT["ODI"]),
        "recent_runs": F.when(t20, F.col("recent_short")).otherwise(F.col("recent_long")),
        "recent_wickets": F.when(t20, F.col("fell_short")).otherwise(F.col("fell_long")),
        "team_dot_streak": since("legal_balls_before", "last_team_run"),
        "batter_dot_streak": since("batter_balls_before", "last_bat_run"),
        "team_boundary_streak": F.when(F.col("last_team_hit").isNull(), 0)
        .otherwise(since("legal_balls_before", "last_team_other")),
    }
    limited = F.col("format_group").isin("T20", "ODI")
    return marks.withColumns({name: F.when(limited, col) for name, col in out.items()}).drop(*MARKS)


SITUATION_COLUMNS = (
    "wickets_in_hand innings_balls_limit limit_uncertain balls_left progress_pct chase_state batter_stage "
    "batter_balls_since_boundary team_balls_since_boundary recent_window recent_runs recent_wickets "
    "team_dot_streak batter_dot_streak team_boundary_streak"
).split()
