"""Intervals of ratios by resampling whole matches.

The balls of a match depend on one another, so matches are resampled, not balls. Each match has in each draw a Poisson(1)
weight that is read off a digest of seed, draw and match: no weights are stored, reruns agree whatever the partitions, and
one match has one weight in a draw in all groups. Balls are added up by match first; the draws are laid out on those rows
and summed within tasks before the shuffle, which carries a row for each group and draw from each task. Draw 0 weighs every match
once and gives the value itself. A draw in which a group has no match, or a denominator of zero, is left out of its percentiles.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from inswing.models.nextball import CLASSES

DRAWS, SEED, LEVEL = 200, 7, 0.95
RANGE = 2**32
#: a weight is the number of these that the digest's first 32 bits reach: Poisson(1) by its distribution function
STEPS = [math.floor(RANGE * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def weights(match: Column, draws: int, seed: int = SEED) -> Column:
    """The weights of a match in draws 0 to `draws`; each is one digest. Without a match only draw 0 has a weight."""
    def digest(draw: Column) -> Column:
        text = F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), match.cast("string")))
        return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")

    def reached(u: Column, draw: Column) -> Column:
        out = F.when(draw == 0, 1)
        for k, step in enumerate(STEPS):
            out = out.when(u < step, k)
        return out.when(u >= STEPS[-1], len(STEPS))
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(draws)), digest), reached)


def replicates(rows: DataFrame, keys: list[str], sums: list[str], match: str = "match_id", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(keys, draw, matches, sums): weighted sums of every group in draws 0 to `draws`; matches counts weights.

    A match is drawn once for all its groups. The rows before the draws are few and small, so their partitions are fixed by
    number: sized by bytes they would be one task, and the draws multiply them by 200.
    """
    per_match = rows.groupBy(*keys, match).agg(*[F.sum(F.col(x).cast("double")).alias(x) for x in sums])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = per_match.repartition(parts, match).groupBy(match).agg(F.collect_list(F.struct(*keys, *sums)).alias("groups"))
    drawn = groups.select("groups", F.posexplode(weights(F.col(match), draws, seed)).alias("draw", "w")).where("w > 0").select("draw", "w", F.inline("groups"))
    return drawn.groupBy(*keys, "draw").agg(F.sum("w").alias("matches"), *[F.sum(F.col("w") * F.col(x)).alias(x) for x in sums])


def intervals(rows: DataFrame, keys: list[str], ratios: dict[str, tuple[str, str]], match: str = "match_id",
              draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """(keys, metric, value, lo, hi, matches): each ratio of two sums over all rows, and the middle `level` of its draws."""
    sums = sorted({x for pair in ratios.values() for x in pair})
    reps = replicates(rows, keys, sums, match, draws, seed)
    whole, tail = F.col("draw") == 0, (1 - level) / 2
    out = []
    for name, (over, under) in ratios.items():
        ratio = F.try_divide(F.col(over), F.col(under))
        drawn = F.when(~whole, ratio)
        out.append(F.struct(F.lit(name).alias("metric"), F.max(F.when(whole, ratio)).alias("value"),
                            F.percentile(drawn, F.lit(tail)).alias("lo"), F.percentile(drawn, F.lit(1 - tail)).alias("hi")))
    matches = F.max(F.when(whole, F.col("matches"))).alias("matches")
    return reps.groupBy(*keys).agg(F.array(*out).alias("m"), matches).select(*keys, F.inline("m"), "matches")


def _losses(preds: DataFrame) -> DataFrame:
    square = F.aggregate("pred", F.lit(0.0), lambda a, x: a + x * x) - 2 * F.col("hit") + 1
    out = F.col("y") == "WICKET"
    return preds.select("match_id", "fmt", "phase", "press", F.lit(1.0).alias("balls"), (-F.ln(F.greatest("hit", F.lit(1e-12)))).alias("loss"), square.alias("square"),
                        (F.col("hit") == F.array_max("pred")).cast("double").alias("right"), (out.cast("double") - F.col("pred")[len(CLASSES) - 1]).alias("excess"))


METRICS = {"log_loss": ("loss", "balls"), "brier": ("square", "balls"), "top1": ("right", "balls"), "wickets_over_expected": ("excess", "balls")}
SLICES = [["fmt"], ["fmt", "phase"], ["fmt", "press"]]


def slices(preds: DataFrame) -> DataFrame:
    """Held-out metrics of the next-ball model with intervals: by format, by phase, by pressure; 'all' where a slice does not cut."""
    names = ["fmt", "phase", "press"]
    # by match first, so that the balls are read once for all slices
    sums = sorted({x for pair in METRICS.values() for x in pair})
    fine = _losses(preds).groupBy("match_id", *names).agg(*[F.sum(x).alias(x) for x in sums])
    cut = F.explode(F.array(*[F.struct(*[(F.coalesce(F.col(c), F.lit("none")) if c in s else F.lit("all")).alias(c) for c in names]) for s in SLICES])).alias("cut")
    return intervals(fine.select("match_id", *sums, cut).select("match_id", *sums, "cut.*"), names, METRICS)


def rates(balls: DataFrame) -> DataFrame:
    """Runs and bowlers' wickets for a legal ball, with intervals, by format group, gender and phase."""
    rows = balls.select("match_id", "format_group", "gender", "phase", F.col("legal").cast("double").alias("legal"), F.col("runs_total").cast("double").alias("runs"),
                        F.col("striker_credited").cast("double").alias("wickets"))
    return intervals(rows, ["format_group", "gender", "phase"], {"runs": ("runs", "legal"), "wickets": ("wickets", "legal")})


def expected_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error by format, from bins (fmt, n, mean_p, rate)."""
    return bins.groupBy("fmt").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))
