"""Win probability before every ball: par score, remaining runs, and a table of states that backs off to coarser ones.

Everything is fitted on matches of the training years and is a handful of aggregates over `balls`: one row for each state that
occurs, so what follows an aggregate no longer grows with the balls. Grids (balls left by wickets down) have a fixed size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.models.chase import SCOPE, eligibility
from inswing.plans.workspace import Workspace

# Ends of the splits, full lengths, first widths of the window and widths of the state bins by format.
TRAIN_BEFORE, VALIDATE_UNTIL = "2023-01-01", "2023-12-31"
FULL = {"T20": 120, "ODI": 300}
FIRST_WIDTH = {"T20": 3, "ODI": 6}
BALL_BIN = {"T20": 6, "ODI": 12}
LEAD_BIN, LEAD_END = {"T20": 5.0, "ODI": 8.0}, {"T20": 60, "ODI": 120}
NEED_BIN, NEED_END = {"T20": 4, "ODI": 8}, {"T20": 60, "ODI": 50}
SHRINK = [10, 30, 100, 300, 1000, 3000]
ENOUGH = 40
LEAST_SD = 3.0
CLIP = 1e-4

GROUP = [*SCOPE, "innings_no"]
STATE = ["balls_bin", "wickets", "runs_bin"]
WIDTHS = sorted({w << j for w in FIRST_WIDTH.values() for j in range(7)})


def by_format(values: dict[str, float]) -> Column:
    return F.when(F.col("format_group") == "T20", values["T20"]).otherwise(values["ODI"])


def population(ws: Workspace, accept: tuple[str, ...] = ("eligible",)) -> DataFrame:
    """Matches with a status of `accept`: split by date, full length, first total, and the label of the side batting first."""
    day = F.col("start_date")
    split = F.when(day < F.lit(TRAIN_BEFORE).cast("date"), "train").when(day <= F.lit(VALIDATE_UNTIL).cast("date"), "validate").otherwise("test")
    return eligibility(ws).where(F.col("status").isin(*accept)).select(
        "match_id", split.alias("split"), F.col("full").alias("limit"), F.col("t1").alias("first_total"), F.col("label"))


def situations(ws: Workspace, accept: tuple[str, ...] = ("eligible",)) -> DataFrame:
    """The legal balls of these matches: state before the ball, and y, the share of a win that the batting side got."""
    b = ws["balls"].where("legal and innings_no <= 2 and format_group in ('T20', 'ODI')").select(
        "delivery_id", "match_id", *GROUP, F.col("legal_balls_before").alias("bowled"), F.col("score_before").alias("score"),
        F.col("wickets_before").alias("wickets"), F.col("target_runs").alias("target"))
    y = F.when(F.col("innings_no") == 1, F.col("label")).otherwise(1 - F.col("label"))
    return b.join(population(ws, accept), "match_id").where("bowled < limit and wickets < 10").withColumn("y", y).drop("label")


def par(train: DataFrame) -> DataFrame:
    """Mean first-innings score after every number of balls; a number that never occurs takes the last one before it, 0 at first."""
    means = train.where("innings_no = 1").groupBy(*SCOPE, "limit", "bowled").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    grid = means.select(*SCOPE, "limit").distinct().select(*SCOPE, "limit", F.explode(F.expr("sequence(0, limit)")).alias("bowled"))
    upto = Window.partitionBy(*SCOPE).orderBy("bowled")  # at most 301 rows
    return grid.join(means, [*SCOPE, "limit", "bowled"], "left").select(
        *SCOPE, "bowled", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.last("mean", ignorenulls=True).over(upto), F.lit(0.0)).alias("par"))


def totals(train: DataFrame) -> DataFrame:
    """Mean and standard deviation of first-innings totals, an innings once."""
    return train.where("innings_no = 1 and bowled = 0").groupBy(*SCOPE).agg(
        F.count("*").alias("innings"), F.avg("first_total").alias("mean"), F.stddev_samp("first_total").alias("sd"))


def remaining(train: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Mean and deviation of the runs still to come by balls left and wickets down, in first innings.

    Around each number of balls left a window doubles until it holds `enough` balls or is wider than the innings. What has no
    balls at all takes the state with a wicket less; then more wickets never mean more runs, and more balls never fewer."""
    runs = F.col("first_total") - F.col("score")
    cells = train.where("innings_no = 1").groupBy(*SCOPE, "limit", (F.col("limit") - F.col("bowled")).alias("left"), "wickets").agg(
        F.count("*").alias("n"), F.sum(runs.cast("long")).alias("s"), F.sum((runs * runs).cast("long")).alias("ss"))
    grid = (cells.select(*SCOPE, "limit").distinct()
            .select(*SCOPE, "limit", F.explode(F.expr("sequence(1, limit)")).alias("left"))
            .select("*", F.explode(F.expr("sequence(0, 9)")).alias("wickets")))
    full = grid.join(cells, [*SCOPE, "limit", "left", "wickets"], "left").fillna(0, ["n", "s", "ss"])
    # the grid has every number of balls, so a window of rows is a window of balls
    near = lambda width: Window.partitionBy(*SCOPE, "wickets").orderBy("left").rowsBetween(-width, width)
    tried = F.array(*[F.struct(F.lit(w).alias("width"), *[F.sum(c).over(near(w)).alias(c) for c in ("n", "s", "ss")]) for w in WIDTHS])
    first = by_format(FIRST_WIDTH)
    fits = lambda t: (t["width"] >= first) & (t["width"] % first == 0) & ((t["n"] >= enough) | (t["width"] > F.col("limit")))
    # widths of the other format may be among the multiples, but only doublings of the first width count
    doubled = lambda t: F.log2(t["width"] / first) == F.floor(F.log2(t["width"] / first))
    w = full.withColumn("tried", tried).withColumn("w", F.get(F.filter("tried", lambda t: fits(t) & doubled(t)), F.lit(0)))
    mean = F.when(F.col("w.n") > 0, F.col("w.s") / F.col("w.n"))
    var = F.greatest(F.col("w.ss") / F.col("w.n") - mean * mean, F.lit(0.0))
    raw = w.select(*SCOPE, "left", "wickets", F.col("w.width").alias("width"), F.col("w.n").alias("n"), mean.alias("mean"),
                   F.when(F.col("w.n") > 0, F.greatest(F.sqrt(var), F.lit(LEAST_SD))).alias("sd"))
    fewer = Window.partitionBy(*SCOPE, "left").orderBy("wickets")
    known = lambda c, default: F.coalesce(F.last(c, ignorenulls=True).over(fewer), F.lit(default))
    filled = raw.withColumns({"mean": known("mean", 0.0), "sd": known("sd", LEAST_SD)}).withColumn("mean", F.min("mean").over(fewer))
    return filled.withColumn("mean", F.max("mean").over(Window.partitionBy(*SCOPE, "wickets").orderBy("left")))


def binned(rows: DataFrame, pars: DataFrame) -> DataFrame:
    """The finest state of every ball: balls left, wickets down, and runs ahead of par or still needed, in bins."""
    j = rows.join(pars.select(*SCOPE, "bowled", "par"), [*SCOPE, "bowled"])
    lead = F.greatest(F.least(F.col("score") - F.col("par"), by_format(LEAD_END)), -by_format(LEAD_END))
    need = F.least(F.floor((F.col("target") - F.col("score")) / by_format(NEED_BIN)), by_format(NEED_END))
    return j.withColumns({
        "balls_bin": F.floor((F.col("limit") - F.col("bowled") - 1) / by_format(BALL_BIN)).cast("long"), "wickets": F.col("wickets").cast("long"),
        "runs_bin": F.when(F.col("innings_no") == 1, F.floor(lead / by_format(LEAD_BIN))).otherwise(need).cast("long")})


def levels() -> list[list[Column]]:
    """Keys of a state from fine to coarse; the last is the whole group."""
    half = lambda c, n: F.floor(F.col(c) / n)
    third = F.when(F.col("wickets") <= 2, 0).when(F.col("wickets") <= 5, 1).otherwise(2)
    keys = [[F.col(c) for c in STATE], [half("balls_bin", 2), half("wickets", 2), half("runs_bin", 2)],
            [half("balls_bin", 4), third, half("runs_bin", 4)], [half("balls_bin", 8), F.lit(0), half("runs_bin", 8)], [F.lit(0)] * 3]
    return [[c.cast("long") for c in k] for k in keys]


def state_table(train: DataFrame) -> DataFrame:
    """(group, level, a, b, c, n, won): balls and wins of every cell of every level, all from the finest cells."""
    fine = train.groupBy(*GROUP, *STATE).agg(F.count("*").alias("n"), F.sum("y").alias("won"))
    places = F.array(*[F.struct(F.lit(i).alias("level"), *[x.alias(n) for x, n in zip(k, "abc")]) for i, k in enumerate(levels())])
    return fine.select(*GROUP, F.explode(places).alias("at"), "n", "won").groupBy(*GROUP, "at.level", "at.a", "at.b", "at.c").agg(
        F.sum("n").alias("n"), F.sum("won").alias("won"))


def backed_off(states: DataFrame, table: DataFrame, k: list[int] | Column) -> DataFrame:
    """`states` (group and finest state) with p by k: each level is shrunk to the next coarser one, k balls strong.

    `k` is a list to try, or a column of `states`. Groups without training balls have no row."""
    out = states.withColumn("k", F.explode(F.array(*map(F.lit, k))) if isinstance(k, list) else k)
    for i, keys in reversed(list(enumerate(levels()))):
        cell = table.where(F.col("level") == i).select(*GROUP, *[F.col(x).alias(f"_{x}") for x in "abc"], F.col("n").alias("_n"), F.col("won").alias("_won"))
        at = out
        for x, key in zip("abc", keys):
            at = at.withColumn(f"_{x}", key)
        joined = at.join(cell, [*GROUP, "_a", "_b", "_c"], "inner" if i == 4 else "left")
        p = F.col("_won") / F.col("_n") if i == 4 else F.when(F.col("_n") > 0, (F.col("_won") + F.col("k") * F.col("p")) / (F.col("_n") + F.col("k"))).otherwise(F.col("p"))
        out = joined.withColumn("p", p).drop("_a", "_b", "_c", "_n", "_won")
    return out


def losses(rows: DataFrame, table: DataFrame, k: list[int]) -> DataFrame:
    """Mean log loss and Brier score by group and k; balls in one state share p, so they are scored once."""
    cells = rows.groupBy(*GROUP, *STATE).agg(F.count("*").alias("n"), F.sum("y").alias("won"), F.sum(F.col("y") * F.col("y")).alias("square"))
    p = F.greatest(F.least("p", F.lit(1 - CLIP)), F.lit(CLIP))
    scored = backed_off(cells, table, k)
    return scored.groupBy(*GROUP, "k").agg(
        F.sum("n").alias("balls"),
        (-F.sum(F.col("won") * F.log(p) + (F.col("n") - F.col("won")) * F.log(1 - p)) / F.sum("n")).alias("log_loss"),
        (F.sum(F.col("n") * F.col("p") * F.col("p") - 2 * F.col("p") * F.col("won") + F.col("square")) / F.sum("n")).alias("brier"))


def choose(tried: DataFrame) -> DataFrame:
    """The k of least validation loss in every group, the smallest of equal ones."""
    return tried.groupBy(*GROUP).agg(F.min(F.struct(F.round("log_loss", 10).alias("loss"), "k")).alias("b")).select(*GROUP, "b.k")


class StateModel:
    """Par, cells and k, each written once."""

    def __init__(self, ws: Workspace, accept: tuple[str, ...] = ("eligible",)):
        rows = ws.stage(situations(ws, accept), "win-situations")
        train = rows.where("split = 'train'")
        self.rows = binned(rows, ws.stage(par(train), "win-par"))
        self.table = ws.stage(state_table(self.rows.where("split = 'train'")), "win-states")
        self.tried = ws.stage(losses(self.rows.where("split = 'validate'"), self.table, SHRINK), "win-losses")
        self.chosen = choose(self.tried)

    def probabilities(self) -> DataFrame:
        """P(the batting side wins) before every ball of the test years; states are looked up once and joined back."""
        test = self.rows.where("split = 'test'").select("delivery_id", *GROUP, *STATE, "y")
        states = test.select(*GROUP, *STATE).distinct().join(self.chosen.withColumnRenamed("k", "chosen"), GROUP)
        found = backed_off(states, self.table, F.col("chosen")).select(*GROUP, *STATE, "p")
        return test.join(found, [*GROUP, *STATE])
