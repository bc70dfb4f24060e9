"""Templates that answer a structured question for every player at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import ratio
from inswing.functions.stats import poisson_tail, shrink
from inswing.plans.workspace import Workspace

PULL = 60.0  # pseudo-balls towards the usual rate


def c(name: str) -> Column:
    return F.col(name)


def _split_rates(ws: Workspace, first: str, second: str, keys: list[str]) -> DataFrame:
    """Balls and runs of each key on either side of a split, in one pass."""
    aggs = []
    for tag, test in (("a", first), ("b", second)):
        aggs += [F.count_if(F.expr(f"faced and ({test})")).alias(f"n_{tag}"), F.coalesce(F.sum(F.expr(f"case when faced and ({test}) then runs_batter end")), F.lit(0)).alias(f"s_{tag}")]
    return ws["balls"].groupBy(*keys).agg(*aggs)


def change(ws: Workspace, first: str, second: str, min_first: int, min_second: int) -> DataFrame:
    """A batter's strike rate on the second side of a split, pulled towards that of all who qualify, less the rate on the first.

    `vs_typical` takes away the change of all who qualify together."""
    keys = ["format_group", "gender"]
    me = _split_rates(ws, first, second, ["batter_id", *keys]).filter((c("n_a") >= min_first) & (c("n_b") >= min_second))
    usual = me.groupBy(*keys).agg(ratio(F.sum("s_a"), F.sum("n_a")).alias("u_a"), ratio(F.sum("s_b"), F.sum("n_b")).alias("u_b"))
    me = me.join(usual, keys).withColumns({"sr_a": 100 * c("s_a") / c("n_a"), "sr_b": 100 * c("s_b") / c("n_b"), "change": 100 * (shrink("s_b", "n_b", "u_b", PULL) - c("s_a") / c("n_a"))})
    return me.withColumn("vs_typical", c("change") - 100 * (c("u_b") - c("u_a")))


def faced_change(ws: Workspace, after: int) -> DataFrame:
    """Every batter before and after a number of balls of an innings: strike rate, boundaries, dots and dismissals, as they are."""
    b = ws["balls"].withColumn("late", c("batter_balls_before") >= after)
    outs = ws["dis"].filter("counts_as_dismissal").groupBy("delivery_id", c("player_out_id").alias("batter_id")).agg(F.count("*").alias("o"))
    b = b.join(outs, ["delivery_id", "batter_id"], "left")
    aggs = []
    for tag, test in (("a", ~c("late")), ("b", c("late"))):
        some = lambda x, test=test: F.count_if(test & x)
        aggs += [some(c("faced")).alias(f"n_{tag}"), F.sum(F.when(test, c("runs_batter")).otherwise(0)).alias(f"runs_{tag}"), some(c("faced") & (c("is_four") | c("is_six"))).alias(f"bnd_{tag}"),
                 some(c("faced") & (c("runs_batter") == 0)).alias(f"dots_{tag}"), F.sum(F.when(test, F.coalesce("o", F.lit(0))).otherwise(0)).alias(f"outs_{tag}")]
    g = b.groupBy("batter_id").agg(*aggs).filter("n_a > 0 and n_b > 0")
    return g.select("batter_id", "n_a", "n_b", *[(100 * c(f"{x}_{t}") / c(f"n_{t}")).alias(f"{x}_{t}") for t in "ab" for x in ("runs", "bnd", "dots", "outs")])


def scored_fastest_against(ws: Workspace, min_balls: int = 60) -> DataFrame:
    """Strike rate of each batter against each bowler, pulled towards the batter's own rate."""
    g = ws["balls"].groupBy("batter_id", "bowler_id").agg(F.count_if("faced").alias("n"), F.sum("runs_batter").alias("s"))
    own = g.groupBy("batter_id").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("usual"))
    return g.filter(c("n") >= min_balls).join(own, "batter_id").withColumn("sr", 100 * shrink("s", "n", "usual", PULL))


def troubled_by(ws: Workspace, min_balls: int = 30) -> DataFrame:
    """How much a bowler troubles a batter: dismissals above expectation, then a strike rate below the usual."""
    b = ws["battles"].filter(c("balls") >= min_balls).withColumn("expected", c("balls") * c("batter_out_rate"))
    return b.withColumn("score", (c("outs") - c("expected")) / F.sqrt(F.greatest(F.lit(1.0), c("expected"))) + 100 * (c("batter_rpb") - c("runs") / c("balls")) / 40)


def rivalry_battles(ws: Workspace, min_balls: int = 48, often: float = 1.8, swing: float = 35.0) -> DataFrame:
    """Battles within each pair of sides that stand out against the batter's usual rates: dismissed often, or scoring far from usual."""
    side = [F.least("batting_team", "bowling_team").alias("side_a"), F.greatest("batting_team", "bowling_team").alias("side_b")]
    g = ws["balls"].groupBy("gender", *side, "batter_id", "bowler_id").agg(
        F.count_if("faced").alias("balls"), F.sum("runs_batter").alias("runs"), F.sum(c("striker_credited").cast("int")).alias("outs")).filter(c("balls") >= min_balls)
    usual = ws["battles"].select("batter_id", "bowler_id", "gender", "batter_out_rate", "batter_rpb")
    g = g.join(usual, ["batter_id", "bowler_id", "gender"], "left").withColumn("expected", c("balls") * F.coalesce("batter_out_rate", F.lit(0.0)))
    g = g.withColumns({"tail": poisson_tail("outs", "expected"), "gap": 100 * (c("runs") / c("balls") - F.coalesce("batter_rpb", F.lit(0.0)))})
    return g.filter((c("outs") > often * c("expected")) | (F.abs("gap") >= swing))


def bowler_summary(ws: Workspace) -> DataFrame:
    return ws["bowl_innings"].groupBy("bowler_id", "format_group").agg(
        F.sum("balls").alias("balls"), F.sum("wickets").alias("wickets"), ratio(F.sum("runs"), F.sum("balls"), 6.0).alias("economy"), ratio(F.sum("dots"), F.sum("balls"), 100.0).alias("dot_pct"))


def pair_before(ws: Workspace) -> DataFrame:
    """Record of each battle before each of its meetings, by days strictly earlier."""
    keys = ["batter_id", "bowler_id"]
    day = ws["balls"].groupBy(*keys, "start_date").agg(F.count_if("faced").alias("n"), F.sum("runs_batter").alias("s"), F.count_if("striker_credited").alias("o"))
    w = Window.partitionBy(*keys).orderBy("start_date").rowsBetween(Window.unboundedPreceding, -1)
    return day.withColumns({f"{x}_before": F.coalesce(F.sum(x).over(w), F.lit(0)) for x in ("n", "s", "o")})
