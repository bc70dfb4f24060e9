"""What is worth saying before a ball: candidates from the state of the match and the baselines of earlier days, and what is shown.

A candidate has five dimensions from 0 to 1; their weighted sum is its score. Everything is known before the ball is bowled: the
state comes from balls before it, the baselines from days before the match. A ball carries its candidates as one short array, so
that choosing among them needs no further shuffle.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import before, ratio, upto
from inswing.operators.asof import FORMAT, PHASES, STAGES, stage_of
from inswing.plans.workspace import Workspace, relation

WEIGHTS = {"relevance": 0.35, "sample": 0.20, "unusual": 0.30, "recency": 0.05, "known": 0.10}  # fixed values
MIN_SCORE, MIN_UNUSUAL, TOP = 0.45, 0.25, 4
INN = ["match_id", "innings_no"]


@dataclass(frozen=True)
class Samples:
    """The least a baseline must rest on."""
    battle: int = 12
    usual: int = 120
    stage: int = 100
    faced: int = 10
    spell: int = 12
    phase: int = 120
    stands: int = 3
    innings: int = 200


def _states(ws: Workspace) -> DataFrame:
    """For each ball what the scorers know before it: score, over, falls, the bowler's spell, the batter at the other end.

    Balls are shuffled once, by innings. Over and spell are read off running totals at their first ball, so the innings and the bowlers are
    sorted once each; the other batter's balls come from one more sort of both ends, in which the ball travels with the end that asks.
    """
    inn, c = INN, F.col
    needed = [*inn, "seq", "over", *FORMAT, "competition", "start_date", "batting_team", "batter_id", "non_striker_id", "bowler_id", "phase", "target_runs", "innings_balls_limit",
              "score_before", "wickets_before", "legal_balls_before", "batter_runs_before", "batter_balls_before", "partnership_runs_before", "partnership_balls_before",
              "team_dot_streak", "legal", "faced", "runs_batter", "runs_total", "wides", "noballs", "n_wickets"]
    b = ws.spread(ws["balls"].select(*needed), *inn)
    fall = F.when(c("n_wickets") > 0, F.struct((c("legal_balls_before") + c("legal").cast("int")).alias("legal"), (c("score_before") + c("runs_total")).alias("score")))
    w = Window.partitionBy(*inn).orderBy("seq")
    b = b.withColumns({"falls": F.collect_list(fall).over(before(*inn)), "over_earlier": F.lag("over").over(w)}).withColumns({
        "fall_a": F.try_element_at("falls", F.lit(-3)), "fall_z": F.try_element_at("falls", F.lit(-1)), "n_falls": F.size("falls"), "fresh": c("over_earlier") != c("over")}).drop("falls")
    turn = ~c("over").eqNullSafe(c("over_earlier"))
    b = b.withColumn("over_start", F.last(F.when(turn, c("score_before")), True).over(upto(*inn))).withColumn("before_start", F.lag("over_start").over(w))
    b = b.withColumns({
        "last_over": F.when(c("fresh"), c("over_earlier")).otherwise(c("over")),
        "last_over_runs": c("score_before") - F.when(c("fresh"), c("before_start")).otherwise(c("over_start")),
        "charged": c("runs_batter") + c("wides") + c("noballs"), "faced": c("faced").cast("int"), "legal": c("legal").cast("int")}).drop(
        "over_earlier", "fresh", "before_start", "runs_total", "wides", "noballs", "n_wickets")
    mine, own = before(*inn, "bowler_id"), upto(*inn, "bowler_id")
    gap = c("over") - F.lag("over").over(Window.partitionBy(*inn, "bowler_id").orderBy("seq"))
    b = b.withColumns({"opens": F.when(gap <= 2, 0).otherwise(1), "bowled": F.coalesce(F.sum("legal").over(mine), F.lit(0)), "conceded": F.coalesce(F.sum("charged").over(mine), F.lit(0))})
    first = c("opens") == 1
    b = b.withColumns({"spell_no": F.sum("opens").over(own), "bowled_first": F.last(F.when(first, c("bowled")), True).over(own), "conceded_first": F.last(F.when(first, c("conceded")), True).over(own)})
    b = b.withColumns({"spell_balls": c("bowled") - c("bowled_first"), "spell_runs": c("conceded") - c("conceded_first")})
    b = b.drop("opens", "bowled", "conceded", "bowled_first", "conceded_first", "charged").withColumnRenamed("legal_balls_before", "legal_before").drop("legal")
    # each ball once for either end; the one of the batter at the other end asks
    ends = b.withColumn("asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("person_id", F.when(c("asks"), c("non_striker_id")).otherwise(c("batter_id")))
    asks, other = c("asks"), before(*inn, "person_id")
    ends = ends.withColumns({"other_runs": F.coalesce(F.sum(F.when(~asks, c("runs_batter")).otherwise(0)).over(other), F.lit(0)),
                             "other_balls": F.coalesce(F.sum(F.when(~asks, c("faced")).otherwise(0)).over(other), F.lit(0))}).filter(asks)
    return ends.drop("asks", "person_id", "runs_batter", "faced").withColumnsRenamed({
        "score_before": "score", "wickets_before": "wickets", "legal_before": "legal", "batter_runs_before": "runs", "batter_balls_before": "balls",
        "partnership_runs_before": "stand_runs", "partnership_balls_before": "stand_balls"})


@relation("ball_states", written=False)
def ball_states(ws: Workspace) -> DataFrame:
    return _states(ws)


ON = [*FORMAT, "start_date"]


def _player_baselines(ws: Workspace) -> DataFrame:
    """One row a player and day: balls, runs and outs in all, by stage and by phase, as whole numbers and not by name."""
    keys = ["person_id", *ON]

    def at(what: str, bucket: str) -> Column:
        return F.max(F.when(F.col("bucket") == bucket, F.col(what)))

    bat = {"usual_balls": at("balls", "all"), "usual_runs": at("runs", "all"), "usual_outs": at("outs", "all")}
    bat |= {f"stage{i}_{x}": at(x, f"stage:{s}") for i, s in enumerate(STAGES) for x in ("balls", "runs")}
    bowl = {"bowled": at("balls", "all")} | {f"phase{i}_{x}": at(x, f"phase:{p}") for i, p in enumerate(PHASES) for x in ("balls", "runs")}
    one = ws["asof_bat"].groupBy(*keys).agg(*[v.alias(k) for k, v in bat.items()])
    two = ws["asof_bowl"].groupBy(*keys).agg(*[v.alias(k) for k, v in bowl.items()])
    known = F.coalesce(F.col("usual_balls"), F.lit(0)) + F.coalesce(F.col("bowled"), F.lit(0))
    return one.join(two, keys, "full").select(*keys, F.struct(*bat, *[k for k in bowl if k != "bowled"], known.alias("known")).alias("past"))


def _mapped(rows: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def _baselines(ws: Workspace) -> DataFrame:
    """Everything known before the day about the people, pairs and places of an innings, one row per innings.

    They are as many as the innings has, so they travel as short maps on this row and a ball needs one join, however long the
    tables of baselines are.
    """
    b, c = ws["balls"].select(*INN, *ON, "batter_id", "non_striker_id", "bowler_id", (F.col("legal_balls_before") - F.col("legal_balls_before") % 6).alias("mark")), F.col
    who = ws.stage(b.select(*INN, *ON, "batter_id", "non_striker_id", "bowler_id").distinct(), "ball-people")
    people = who.select(*INN, *ON, F.explode(F.array("batter_id", "non_striker_id", "bowler_id")).alias("person_id")).distinct()
    people = _mapped(people.join(ws.stage(_player_baselines(ws), "player-baselines"), ["person_id", *ON]), INN, "person_id", "past", "people")
    battles = who.select(*INN, *ON, "batter_id", "bowler_id").distinct().join(
        ws["asof_battle"].select("batter_id", "bowler_id", *ON, F.struct("balls", "runs", "outs", "last").alias("met")), ["batter_id", "bowler_id", *ON])
    battles = _mapped(_mapped(battles, [*INN, "batter_id"], "bowler_id", "met", "met"), INN, "batter_id", "met", "battles")
    pairs = who.select(*INN, *ON, F.least("batter_id", "non_striker_id").alias("a"), F.greatest("batter_id", "non_striker_id").alias("b")).distinct().join(
        ws["asof_pair"].select("a", "b", *ON, F.struct("stands", "runs", "best").alias("pair")), ["a", "b", *ON])
    pairs = _mapped(_mapped(pairs, [*INN, "a"], "b", "pair", "pair"), INN, "a", "pair", "pairs")
    # innings that stood at so many wickets or more, by the number of wickets
    fell = ws["asof_wickets"].groupBy(*ON, "mark").agg(F.sum("n").alias("total"), F.collect_list(F.struct("wickets", "n")).alias("at"))
    fell = fell.withColumn("down", F.expr("transform(sequence(0, array_max(at.wickets)), w -> aggregate(at, cast(0 as bigint), (acc, x) -> acc + if(x.wickets >= w, x.n, 0)))")).drop("at")
    score = ws["asof_score"].select(*ON, "innings_no", "mark", c("n").alias("score_n"), c("score").alias("score_mean"))
    marks = b.select(*INN, *ON, "mark").distinct().join(fell, [*ON, "mark"], "left").join(score, [*ON, "innings_no", "mark"], "left")
    marks = _mapped(marks.withColumn("place", F.struct("total", "down", "score_n", "score_mean")), INN, "mark", "place", "marks")
    p99 = ws["asof_unusual"].groupBy(*ON).agg(*[F.first(F.when(c("what") == w, F.struct("n", "v")), True).alias(f"{w}_99") for w in ("dot_streak", "over_runs")])
    innings = who.select(*INN, *ON).distinct().join(p99, ON, "left").drop(*ON)
    for part in (people, battles, pairs, marks):
        innings = innings.join(part, INN, "left")
    return innings


def with_baselines(ws: Workspace) -> DataFrame:
    c = F.col
    s = _states(ws).withColumns({"a": F.least("batter_id", "non_striker_id"), "b": F.greatest("batter_id", "non_striker_id"), "mark": c("legal") - c("legal") % 6})
    s = s.join(_baselines(ws).hint("shuffle_hash"), INN, "left")
    def found(name: str, *keys: str) -> Column:  # behind a condition, as plain look-ups would be worked out again wherever they are read
        out = c(name)
        for key in keys:
            out = out[c(key)]
        return F.when(c(name).isNotNull(), out)

    s = s.withColumns({"striker": found("people", "batter_id"), "other": found("people", "non_striker_id"), "bowler": found("people", "bowler_id"),
                       "battle": found("battles", "batter_id", "bowler_id"), "pair": found("pairs", "a", "b"), "place": found("marks", "mark")})
    return s.drop("people", "battles", "pairs", "marks")


def _candidate(when: Column, kind: str, key: list[Column | str], subject: Column, relevance: Column | float, sample: Column, unusual: Column,
               recency: Column | float, known: Column | float) -> Column:
    """A struct where the condition holds, else null."""
    one = F.lit(1.0)
    dims = {"relevance": relevance, "sample": F.least(one, sample), "unusual": F.least(one, unusual), "recency": recency, "known": known}
    dims = {k: (v if isinstance(v, Column) else F.lit(v)).cast("double") for k, v in dims.items()}
    text = F.concat_ws("|", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key])
    return F.when(when, F.struct(text.alias("key"), F.lit(kind).alias("type"), subject.alias("subject"), *[v.alias(k) for k, v in dims.items()]))


_CANDIDATE = "array<struct<score:double,key:string,type:string,subject:string," + ",".join(f"{k}:double" for k in WEIGHTS) + ">>"


def _scored(x: Column) -> Column:
    """A candidate with its score as an array of one, or an empty array."""
    score = sum((F.lit(w) * x[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(x.isNotNull(), F.array(F.struct(score.alias("score"), *[x[k].alias(k) for k in ("key", "type", "subject", *WEIGHTS)]))).otherwise(F.array().cast(_CANDIDATE))


def _one_of(name: Column, names: tuple[str, ...], value: Callable[[int], Column]) -> Column:
    out = F.when(name == names[0], value(0))
    for i in range(1, len(names)):
        out = out.when(name == names[i], value(i))
    return out


def _known(*balls: Column) -> Column:
    n = sum((F.coalesce(b, F.lit(0)) for b in balls), F.lit(0))
    return F.least(F.lit(1.0), F.log10(1 + n) / 4)


def candidates(ws: Workspace, need: Samples = Samples()) -> DataFrame:
    """(match_id, innings_no, seq, candidates): for each ball all that could be said before it."""
    s, c, lit = with_baselines(ws), F.col, F.lit
    t20 = c("format_group") == "T20"
    usual_sr, met_sr = ratio(c("striker.usual_runs"), c("striker.usual_balls"), 100), ratio(c("battle.runs"), c("battle.balls"), 100)
    expected = ratio(c("battle.balls") * c("striker.usual_outs"), c("striker.usual_balls"))
    out = [_candidate(
        (c("battle.balls") >= need.battle) & (c("striker.usual_balls") >= need.usual) & (c("striker.usual_runs") > 0), "battle", ["battle", c("batter_id"), c("bowler_id")], c("batter_id"), 1.0, c("battle.balls") / 60,
        F.greatest(F.abs(F.ln(ratio(F.greatest(met_sr, lit(1.0)), usual_sr))) / F.ln(lit(1.6)), F.abs(c("battle.outs") - expected) / F.greatest(lit(1.5), F.sqrt(expected) * 2)),
        F.greatest(lit(0.0), 1 - (F.year("start_date") - F.year("battle.last")) / 5), _known(c("striker.known"), c("bowler.known")))]
    for who, end, runs, balls, relevance in (("striker", "batter_id", "runs", "balls", 0.9), ("other", "non_striker_id", "other_runs", "other_balls", 0.6)):
        stage, past = c(f"{who}_stage"), f"{who}_past"
        s = s.withColumn(f"{who}_stage", stage_of(c(balls) - 1))
        s = s.withColumns({past: _one_of(stage, STAGES, lambda i: F.struct(c(f"{who}.stage{i}_balls").alias("balls"), c(f"{who}.stage{i}_runs").alias("runs")))})
        now, then = ratio(c(runs), c(balls), 100), ratio(c(f"{past}.runs"), c(f"{past}.balls"), 100)
        out.append(_candidate(
            (c(balls) >= need.faced) & (c(f"{past}.balls") >= need.stage), "batter_stage", ["stage", c(end), stage, F.when(now > then, "up").otherwise("down")], c(end), relevance, c(f"{past}.balls") / 400,
            F.abs(F.ln(F.greatest(now, lit(1.0)) / F.greatest(then, lit(1.0)))) / F.ln(lit(1.8)) * F.least(lit(1.0), c(balls) / 20), 1.0, _known(c(f"{who}.known"))))
    s = s.withColumns({"bowler_past": _one_of(c("phase"), PHASES, lambda i: F.struct(c(f"bowler.phase{i}_balls").alias("balls"), c(f"bowler.phase{i}_runs").alias("runs")))})
    past = c("bowler_past")
    now, then = ratio(c("spell_runs"), c("spell_balls"), 6), ratio(past["runs"], past["balls"], 6)
    out.append(_candidate(
        (c("spell_balls") >= need.spell) & (past["balls"] >= need.phase), "bowler_spell", ["spell", c("bowler_id"), c("spell_no"), F.when(now < then, "tight").otherwise("loose")], c("bowler_id"), 0.85,
        past["balls"] / 480, F.abs(now - then) / F.when(t20, 3.0).otherwise(2.0) * F.least(lit(1.0), c("spell_balls") / 24), 1.0, _known(c("bowler.known"))))
    mean = ratio(c("pair.runs"), c("pair.stands"))
    bucket = F.when(c("stand_runs") > c("pair.best"), "best").when(c("stand_runs") > mean, "above_avg").otherwise("below")
    out.append(_candidate(
        (c("stand_balls") >= 6) & (c("pair.stands") >= need.stands), "partnership", ["pair", c("a"), c("b"), bucket], F.concat_ws("|", "a", "b"), 0.7, c("pair.stands") / 10,
        F.when(c("stand_runs") > mean, F.least(lit(1.0), (c("stand_runs") - mean) / F.greatest(mean, lit(10.0)))).otherwise(0.0) + F.when(bucket == "best", 0.4).otherwise(0.0),
        1.0, _known(c("striker.known"), c("other.known"))))
    total = c("place.total")
    down = F.when(total.isNotNull(), F.coalesce(F.get("place.down", c("wickets")), lit(0).cast("long")))
    share = ratio(down, total)
    out.append(_candidate(
        (c("wickets") >= 2) & (c("mark") >= 6) & (total >= need.innings) & (share <= 0.2), "wickets_down", ["wk", c("innings_no"), c("wickets")], c("batting_team"), 0.8, total / 2000, 1 - share / 0.2, 1.0, 0.6))
    level = F.when(c("legal") % 6 == 0, c("score")).when(c("over") * 6 == c("mark"), c("over_start"))
    diff = level - c("place.score_mean")
    out.append(_candidate(
        (c("mark") >= 12) & (c("innings_no") <= 2) & (c("place.score_n") >= need.innings) & level.isNotNull(), "score_rate",
        ["rate", c("innings_no"), F.when(diff > 0, "above").otherwise("below"), F.floor(c("mark") / 36)], c("batting_team"), 0.55, c("place.score_n") / 2000, F.abs(diff) / F.when(t20, 25).otherwise(40), 1.0, 0.6))
    left = c("innings_balls_limit") - c("legal")
    gap = ratio(c("target_runs") - c("score"), left, 6) - ratio(c("score"), c("legal"), 6)
    out.append(_candidate(
        c("target_runs").isNotNull() & (c("score") < c("target_runs")) & (left > 0) & (c("legal") >= 6) & (F.abs(gap) >= 1.5), "chase", ["chase", F.floor(gap / 2)], c("batting_team"),
        F.when(left <= c("innings_balls_limit") / 3, 0.9).otherwise(0.7), lit(1.0), F.abs(gap) / 6, 1.0, 0.6))
    out.append(_candidate(
        c("team_dot_streak") >= c("dot_streak_99.v"), "dot_sequence", ["dots", c("innings_no"), c("legal") - c("team_dot_streak")], c("batting_team"), 0.75, c("dot_streak_99.n") / 2000, lit(0.9), 1.0, 0.6))
    out.append(_candidate(
        (c("legal") + c("score") > 0) & (c("last_over_runs") >= c("over_runs_99.v")), "big_over", ["over", c("innings_no"), c("last_over")], c("batting_team"), 0.75, lit(1.0), lit(0.85), 1.0, 0.6))
    out.append(_candidate(
        (c("n_falls") >= 3) & (c("fall_z.legal") - c("fall_a.legal") <= 18) & (c("fall_z.score") - c("fall_a.score") <= 20) & (c("legal") - c("fall_z.legal") <= 6), "wicket_burst",
        ["burst", c("innings_no"), c("n_falls") - 2], c("batting_team"), 0.85, lit(1.0), lit(0.8), 1.0, 0.6))
    s = s.select("match_id", "innings_no", "seq", "legal", *[x.alias(f"c{i}") for i, x in enumerate(out)])
    # joined as arrays: what stands below a function of array elements is never compiled
    return s.select("match_id", "innings_no", "seq", "legal", F.concat(*[_scored(c(f"c{i}")) for i in range(len(out))]).alias("candidates"))


def chosen(found: DataFrame) -> DataFrame:
    """(..., shown): by score, then key, at most TOP, one of a type and one on a subject; weak ones stay out.

    The array of a ball is short and is gone through once, in order."""
    good = F.filter("candidates", lambda x: (x["score"] >= MIN_SCORE) & (x["unusual"] >= MIN_UNUSUAL))
    ordered = F.sort_array(F.transform(good, lambda x: F.struct((-x["score"]).alias("order"), x["key"].alias("key"), x["type"].alias("type"), x["subject"].alias("subject"))))
    none = F.array().cast("array<struct<order:double,key:string,type:string,subject:string>>")

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["type"] == x["type"]) | (k["subject"] == x["subject"])) | (F.size(kept) >= TOP)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return found.withColumn("shown", F.aggregate(ordered, none, step))


def shown_rows(found: DataFrame) -> DataFrame:
    """One row for each line shown, its place, and whether the ball before showed it too or any ball of the match did."""
    keys = ["match_id", "innings_no", "seq"]
    s = chosen(found).select(*keys, "shown", F.lag("shown").over(Window.partitionBy("match_id").orderBy("innings_no", "seq")).alias("earlier"))
    rows = s.select(*keys, "earlier", F.posexplode("shown").alias("place", "x"))
    new = ~F.coalesce(F.exists("earlier", lambda k: k["key"] == F.col("x.key")), F.lit(False))
    first = F.row_number().over(Window.partitionBy("match_id", "x.key").orderBy("innings_no", "seq")) == 1
    return rows.select(*keys, (F.col("place") + 1).alias("place"), F.col("x.type").alias("type"), F.col("x.key").alias("key"), F.col("x.subject").alias("subject"),
                       (-F.col("x.order")).alias("score"), new.alias("new"), first.alias("first"))


@relation("live_candidates")
def live_candidates(ws: Workspace) -> DataFrame:
    """Candidates of the registered queries, whose careers are short: smaller samples than the published ones."""
    return candidates(ws, Samples(battle=4, usual=30, stage=20, faced=6, spell=6, phase=20, stands=2, innings=20))
