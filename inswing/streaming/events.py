"""The event log of a match: ordered by its place in the match, never by arrival."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from inswing.plans.workspace import Workspace, relation

KINDS = ["match_meta", "playing_xi", "innings_start", "target_revision", "interruption", "pre_ball", "delivery", "correction",
         "innings_end", "match_end"]  # fixed values
OPS = ["update", "retract", "insert"]
RUNS = ["runs_batter", "wides", "noballs", "byes", "legbyes", "penalty"]
LAYERS = ["tracking", "shot", "fielding", "contact"]  # enrichment layers an event may carry

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_id", "match_id", "kind")]
    + [T.StructField(n, T.IntegerType()) for n in ("innings", "over", "idx")]
    + [T.StructField(n, T.StringType()) for n in ("batter_id", "non_striker_id", "bowler_id")]
    + [T.StructField(n, T.IntegerType()) for n in RUNS]
    + [T.StructField(n, T.StringType()) for n in ("wicket_kind", "player_out_id", "op", "target_event_id", "new_event_id")]
    + [T.StructField("target_runs", T.IntegerType()), T.StructField("layer", T.StringType()), T.StructField("seq", T.LongType())])


def end_reason(declared: Column, total: Column, target: Column, wickets: Column, legal: Column, limit: Column) -> Column:
    return (F.when(declared, "declared").when(total >= target, "target reached").when(wickets >= 10, "all out")
            .when(legal >= limit, "overs complete").otherwise("closed"))


def _blank(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


@relation("event_log")
def event_log(ws: Workspace) -> DataFrame:
    """Canonical tables as events: meta, elevens, innings starts and ends, deliveries and the end of the match."""
    m, i = ws["matches"], ws["innings"]
    w = Window.partitionBy("match_id", "innings_no", "over").orderBy("seq")
    outs = ws["wickets"].filter("wicket_idx = 0").select("match_id", "delivery_id", F.col("kind").alias("wicket_kind"), "player_out_id")
    d = ws["deliveries"].join(outs, ["match_id", "delivery_id"], "left").withColumn("idx", F.row_number().over(w) - 1).select(
        F.col("delivery_id").alias("event_id"), "match_id", F.lit("delivery").alias("kind"), F.col("innings_no").alias("innings"), "over", "idx",
        "batter_id", "non_striker_id", "bowler_id", *RUNS, "wicket_kind", "player_out_id", F.col("seq").cast("long").alias("seq"))
    meta = m.select(F.concat_ws(":", "match_id", F.lit("meta")).alias("event_id"), "match_id", F.lit("match_meta").alias("kind"), F.lit(0).alias("innings"))
    xi = ws["players_in_match"].select(F.concat_ws(":", "match_id", F.lit("xi"), "person_id").alias("event_id"), "match_id", F.lit("playing_xi").alias("kind"),
                                       F.lit(0).alias("innings"), F.col("person_id").alias("batter_id"))
    start = i.select(F.concat_ws(":", "match_id", "innings_no", F.lit("start")).alias("event_id"), "match_id", F.lit("innings_start").alias("kind"),
                     F.col("innings_no").alias("innings"), F.lit(-1).alias("over"), "target_runs")
    end = i.select(F.concat_ws(":", "match_id", "innings_no", F.lit("end")).alias("event_id"), "match_id", F.lit("innings_end").alias("kind"),
                   F.col("innings_no").alias("innings"), F.lit(10 ** 6).alias("over"))
    over = m.select(F.concat_ws(":", "match_id", F.lit("end")).alias("event_id"), "match_id", F.lit("match_end").alias("kind"), F.lit(99).alias("innings"))
    out = _blank(d)
    for part in (meta, xi, start, end, over):
        out = out.unionByName(_blank(part))
    return out


def faults(events: DataFrame) -> Column:
    """Why an event is refused; null when it is valid."""
    k = F.col("kind")
    ball = (k == "delivery") | ((k == "correction") & F.col("op").isin("update", "insert"))
    negative = F.lit(False)
    for r in RUNS:
        negative = negative | (F.coalesce(r, F.lit(0)) < 0)
    scored = F.lit(False)
    for r in RUNS:
        scored = scored | F.col(r).isNotNull()
    return (
        F.when(F.col("event_id").isNull() | F.col("match_id").isNull(), "missing id")
        .when(k.isNull() | ~k.isin(*KINDS), "unknown kind")
        .when((k == "delivery") & (F.col("innings").isNull() | F.col("over").isNull() | F.col("idx").isNull()), "no place in the match")
        .when((k == "delivery") & (F.col("batter_id").isNull() | F.col("bowler_id").isNull()), "missing batter or bowler")
        .when((k == "correction") & (F.col("op").isNull() | ~F.col("op").isin(*OPS) | F.col("target_event_id").isNull()), "bad correction")
        .when((k == "pre_ball") & scored, "outcome before the ball")
        .when(ball & negative, "negative runs")
        .when(F.col("layer").isNotNull() & ~F.col("layer").isin(*LAYERS), "unknown enrichment layer")
    )


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    tagged = events.withColumn("fault", faults(events))
    return tagged.filter("fault is null").drop("fault"), tagged.filter("fault is not null")


def up_to(events: DataFrame, cursor: int) -> DataFrame:
    """The first `cursor` deliveries of each match, in match order."""
    w = Window.partitionBy("match_id").orderBy("innings", "over", "idx")
    return events.filter("kind = 'delivery'").withColumn("cursor", F.row_number().over(w) - 1).filter(F.col("cursor") < cursor)


def disturbed(events: DataFrame) -> DataFrame:
    """The same log as a feed might deliver it: wrong values put right later, retracted and inserted balls, duplicates.

    The final state must equal that of the clean log. Places are fixed by the ball's number in its innings.
    """
    d, s = F.col("kind") == "delivery", F.col("seq")
    late = F.lit(10 ** 6)
    wrong = d & (s % 97 == 5)
    missing = d & (s % 83 == 7) & (F.col("idx") > 0)
    base = events.withColumn("runs_batter", F.when(wrong, F.col("runs_batter") + 1).otherwise(F.col("runs_batter"))).filter(~F.coalesce(missing, F.lit(False)))
    fix = events.filter(wrong).withColumns({"kind": F.lit("correction"), "op": F.lit("update"), "target_event_id": F.col("event_id"),
                                            "event_id": F.concat("event_id", F.lit(":fix")), "seq": s + late})
    ghost = events.filter(d & (s % 89 == 3)).withColumns({"event_id": F.concat("event_id", F.lit(":ghost")), "idx": F.col("idx") + 100, "seq": s + late})
    undo = ghost.select("match_id", F.lit("correction").alias("kind"), F.lit("retract").alias("op"), F.col("event_id").alias("target_event_id"),
                        F.concat("event_id", F.lit(":undo")).alias("event_id"), (F.col("seq") + late).alias("seq"))
    place = F.concat_ws(":", "match_id", "innings", (F.col("seq") - 1))
    insert = events.filter(missing).withColumns({
        "kind": F.lit("correction"), "op": F.lit("insert"), "target_event_id": place, "new_event_id": F.col("event_id"),
        "event_id": F.concat("event_id", F.lit(":ins")), "seq": s + late, "innings": F.lit(None).cast("int"), "over": F.lit(None).cast("int"), "idx": F.lit(None).cast("int")})
    again = base.filter(d & (s % 50 == 1)).withColumn("seq", s + 2 * late)
    clash = base.filter(d & (s % 61 == 2)).withColumns({"runs_batter": F.col("runs_batter") + 4, "seq": s + 3 * late})
    out = base
    for part in (fix, ghost, undo, insert, again, clash):
        out = out.unionByName(_blank(part))
    return out
