"""Next-ball outcome model: cohort shares with backoff, player multipliers, predictions and their evaluation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inswing.plans.workspace import Workspace

CLASSES = ["DOT", "1", "2", "3", "4", "6", "WICKET"]  # fixed values: 5 counts as 4, 7 and more as 6
LEVELS = ["fmt", "phase", "wk", "press"]
K_CONTEXT, K_PLAYER, MIN_PLAYER = 50.0, 3000.0, 30


def features(ws: Workspace) -> DataFrame:
    """Situation bands and the outcome class of every limited-overs ball."""
    need, t = F.col("required_rate"), F.col("runs_total")
    press = F.when(~F.coalesce("chasing", F.lit(False)) | need.isNull(), "none").when(need < 8, "<8").when(need < 10, "8-10").when(need < 12, "10-12").otherwise("12+")
    y = F.when(F.col("outs") > 0, "WICKET").when(t == 0, "DOT").when(t <= 3, t.cast("string")).when(t <= 5, "4").otherwise("6")
    wk = F.when(F.col("wickets_before") <= 2, "0-2").when(F.col("wickets_before") <= 5, "3-5").otherwise("6+")
    return ws["balls"].filter("format_group in ('T20', 'ODI')").select(
        "delivery_id", "match_id", "start_date", "batter_id", "bowler_id", F.col("format_group").alias("fmt"), "phase", wk.alias("wk"), press.alias("press"), y.alias("y"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("y") == k).cast("double").alias(f"n{j}") for j, k in enumerate(CLASSES)]


def _vector(prefix: str) -> Column:
    return F.array(*[F.col(f"{prefix}{j}") for j in range(len(CLASSES))])


def _blend(counts: Column, parent: Column, k: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda n, p: (n + k * p) / (total + k))


def cohorts(rows: DataFrame) -> DataFrame:
    """Class shares of the finest cohorts, each level pulled towards its parent: one count per finest cohort, rolled up."""
    fine = rows.groupBy(*LEVELS).agg(*_counts())
    whole = fine.agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(CLASSES))])
    share = whole.select(F.transform(_vector("n"), lambda x: x / sum(F.col(f"n{j}") for j in range(len(CLASSES)))).alias("p"), F.lit(1).alias("one"))
    out = None
    for depth in range(1, len(LEVELS) + 1):
        keys = LEVELS[:depth]
        level = fine.groupBy(*keys).agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(CLASSES))]).withColumn("n", _vector("n"))
        above = level.withColumn("one", F.lit(1)).join(F.broadcast(share), "one").drop("one") if out is None else level.join(out, keys[:-1])  # share is a single row
        out = above.select(*keys, _blend(F.col("n"), F.col("p"), K_CONTEXT).alias("p"))
    return out


def multipliers(rows: DataFrame, context: DataFrame, who: str) -> DataFrame:
    """How far a player moves each class from what their own situations would give."""
    per = rows.groupBy(who, *LEVELS).agg(*_counts(), F.count("*").cast("double").alias("n")).join(context, LEVELS)
    sums = per.groupBy(who).agg(F.sum("n").alias("n"), *[F.sum(f"n{j}").alias(f"o{j}") for j in range(len(CLASSES))],
                                *[F.sum(F.col("n") * F.col("p")[j]).alias(f"e{j}") for j in range(len(CLASSES))]).filter(F.col("n") >= MIN_PLAYER)
    parts = [(F.col(f"o{j}") + K_PLAYER * F.col(f"e{j}") / F.col("n")) / (F.col(f"e{j}") + K_PLAYER * F.col(f"e{j}") / F.col("n")) for j in range(len(CLASSES))]
    return sums.select(who, F.array(*parts).alias("m"))


def predict(rows: DataFrame, context: DataFrame, bat: DataFrame, bowl: DataFrame) -> DataFrame:
    """Context shares times both players' multipliers, normalised; unknown players and cohorts change nothing."""
    flat = F.array(*[F.lit(1.0)] * len(CLASSES))
    j = rows.join(context, LEVELS, "left").join(bat.withColumnRenamed("m", "mb"), "batter_id", "left").join(bowl.withColumnRenamed("m", "mw"), "bowler_id", "left")
    p = F.coalesce("p", F.transform(flat, lambda x: x / len(CLASSES)))
    raw = F.zip_with(F.zip_with(p, F.coalesce("mb", flat), lambda a, b: a * b), F.coalesce("mw", flat), lambda a, b: a * b)
    return j.withColumn("raw", raw).withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)).withColumn(
        "pred", F.transform("raw", lambda x: x / F.col("total"))).drop("raw", "total", "mb", "mw")


def train(ws: Workspace, cutoff: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = ws.stage(features(ws).filter(F.col("start_date") < F.lit(cutoff).cast("date")), "nextball_train")
    context = ws.stage(cohorts(rows), "nextball_context")
    return context, multipliers(rows, context, "batter_id"), multipliers(rows, context, "bowler_id")


def scored(ws: Workspace, cutoff: str) -> DataFrame:
    held = features(ws).filter(F.col("start_date") >= F.lit(cutoff).cast("date"))
    index = F.array_position(F.array(*[F.lit(k) for k in CLASSES]), F.col("y")).cast("int")
    return predict(held, *train(ws, cutoff)).withColumn("hit", F.element_at("pred", index))


def evaluate(preds: DataFrame) -> DataFrame:
    """Held-out log loss, Brier score and top-1 share by format."""
    square = F.aggregate("pred", F.lit(0.0), lambda a, x: a + x * x) - 2 * F.col("hit") + 1
    return preds.groupBy("fmt").agg(F.count("*").alias("n"), F.avg(-F.ln(F.greatest("hit", F.lit(1e-12)))).alias("log_loss"), F.avg(square).alias("brier"),
                                    F.avg((F.col("hit") == F.array_max("pred")).cast("double")).alias("top1"))


def calibration(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Wicket probability against wickets taken, in bins of equal width over 0 to 1."""
    p = F.col("pred")[len(CLASSES) - 1]
    return preds.groupBy("fmt", F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg((F.col("y") == "WICKET").cast("double")).alias("rate"))


def pick_scores(preds: DataFrame) -> DataFrame:
    """Points of picking the likeliest class under each scoring rule, and of handing in the whole distribution."""
    best = F.array_max("pred")
    right = F.col("hit") == best
    square = F.aggregate("pred", F.lit(0.0), lambda a, x: a + x * x) - 2 * F.col("hit") + 1
    return preds.select("delivery_id", F.when(right, 10 / best).otherwise(0.0).alias("inverse"), F.when(right, 10 * F.log2(1 / best)).otherwise(0.0).alias("log"), F.when(right, 10.0).otherwise(0.0).alias("flat"),
                        F.least(F.lit(4.0), F.sqrt(best / F.col("hit"))).alias("rarity"), (100 * (1 - square / 2)).alias("confidence"))
