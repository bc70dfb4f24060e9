"""Text of a replayed match: the scorebook symbol of a ball and the line that gives a match's result."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def symbol() -> Column:
    """A wicket before anything else, then wides with their runs, no-balls with the batter's, boundaries, dots and extras."""
    c = F.col
    runs = lambda name: c(name).cast("string")
    extra = (c("runs_batter") == 0)
    return (
        F.when(c("n_wickets") > 0, "W").when(c("wides") > 0, F.concat(runs("wides"), F.lit("wd")))
        .when(c("noballs") > 0, F.concat(F.when(c("runs_batter") > 0, runs("runs_batter")).otherwise(""), F.lit("nb")))
        .when(c("is_six"), "6").when(c("is_four"), "4").when(c("runs_total") == 0, "•")
        .when(extra & (c("byes") > 0), F.concat(runs("runs_extras"), F.lit("b"))).when(extra & (c("legbyes") > 0), F.concat(runs("runs_extras"), F.lit("lb")))
        .otherwise(runs("runs_total")))


def _margin(by: str, unit: str) -> Column:
    return F.concat(F.lit(" by "), F.col(by).cast("string"), F.lit(f" {unit}"), F.when(F.col(by) == 1, "").otherwise("s"))


def result_line() -> Column:
    """Who won and by how much, with the method if there was one; otherwise how the match ended."""
    margin = F.when(F.col("win_by_runs") > 0, _margin("win_by_runs", "run")).when(F.col("win_by_wickets") > 0, _margin("win_by_wickets", "wicket")).otherwise("")
    method = F.when(F.col("method").isNotNull(), F.concat(F.lit(" ("), F.col("method"), F.lit(")"))).otherwise("")
    ended = F.when(F.col("result") == "tie", "Match tied").when(F.col("result") == "no result", "No result").when(F.col("result") == "draw", "Draw").otherwise(F.col("result"))
    return F.when(F.col("winner").isNull(), ended).otherwise(F.concat("winner", F.lit(" won"), margin, method))
