"""What was known before a match: baselines of players, pairs and competitions from strictly earlier days.

Facts are added up by key and day. The days that matches ask for are put among them, each ahead of the facts of its own day, and
one running window per key gives every asked day the sums and extremes of what lies before it. No range join is made, a key is
as long as it has days, and moving or adding a later match cannot change an earlier answer.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import tally
from inswing.plans.workspace import Workspace, relation

STAGES = ("1-10", "11-30", "31+")  # balls of an innings; fixed values
PHASES = ("powerplay", "middle", "death")
FORMAT = ["format_group", "gender"]
BOARD = 25


def stage_of(balls_before: Column) -> Column:
    return F.when(balls_before < 10, STAGES[0]).when(balls_before < 30, STAGES[1]).otherwise(STAGES[2])


def running(facts: DataFrame, asked: DataFrame, keys: list[str], sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), minima: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start_date, columns): of `facts` strictly before each asked day; days without any earlier fact are left out."""
    how = [(F.sum, sums), (F.max, maxima), (F.min, minima)]
    daily = facts.groupBy(*keys, "start_date").agg(*[f(c).alias(c) for f, names in how for c in names]).withColumn("asked", F.lit(False))
    rows = daily.unionByName(asked.select(*keys, "start_date").distinct().withColumn("asked", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("start_date", F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(*keys, "start_date", "asked", F.count_if(~F.col("asked")).over(before).alias("days"), *[f(c).over(before).alias(c) for f, names in how for c in names])
    return out.filter("asked and days > 0").drop("asked", "days")


def squads(ws: Workspace) -> DataFrame:
    m = ws["matches"].select("match_id", *FORMAT, "competition", "start_date")
    return ws["players_in_match"].select("match_id", "person_id").distinct().join(m, "match_id")


def _buckets(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """Each row under 'all' and under its stage and phase."""
    names = F.array(F.lit("all"), *[F.concat(F.lit(f"{k}:"), F.col(k)) for k in kinds])
    return facts.withColumn("bucket", F.explode(F.filter(names, lambda x: x.isNotNull())))


def _asked_buckets(ws: Workspace, names: list[str]) -> DataFrame:
    return squads(ws).select("person_id", *FORMAT, "start_date").distinct().withColumn("bucket", F.explode(F.array(*[F.lit(n) for n in names])))


COUNTS = ("balls", "runs", "outs", "dots", "bnd")


@relation("asof_bat")
def asof_bat(ws: Workspace) -> DataFrame:
    """Batting before a day, in all and by stage of the innings and phase."""
    b = ws["balls"].withColumn("stage", stage_of(F.col("batter_balls_before")))
    facts = b.groupBy(F.col("batter_id").alias("person_id"), *FORMAT, "start_date", "stage", "phase").agg(
        tally(F.col("faced")).alias("balls"), F.sum("runs_batter").alias("runs"), tally(F.col("striker_dismissed")).alias("outs"),
        tally(F.col("faced") & (F.col("runs_batter") == 0)).alias("dots"), tally(F.col("is_four") | F.col("is_six")).alias("bnd"))
    names = ["all", *[f"stage:{s}" for s in STAGES], *[f"phase:{p}" for p in PHASES]]
    return running(_buckets(facts, ["stage", "phase"]), _asked_buckets(ws, names), ["person_id", *FORMAT, "bucket"], COUNTS)


@relation("asof_bowl")
def asof_bowl(ws: Workspace) -> DataFrame:
    """Bowling before a day, in all and by phase; runs are those charged to the bowler."""
    conceded = F.col("runs_batter") + F.col("wides") + F.col("noballs")
    facts = ws["balls"].groupBy(F.col("bowler_id").alias("person_id"), *FORMAT, "start_date", "phase").agg(
        tally(F.col("legal")).alias("balls"), F.sum(conceded).alias("runs"), F.sum("wk").alias("outs"),
        tally(F.col("legal") & (conceded == 0)).alias("dots"), tally(F.col("is_four") | F.col("is_six")).alias("bnd"))
    names = ["all", *[f"phase:{p}" for p in PHASES]]
    return running(_buckets(facts, ["phase"]), _asked_buckets(ws, names), ["person_id", *FORMAT, "bucket"], COUNTS)


@relation("asof_battle")
def asof_battle(ws: Workspace) -> DataFrame:
    """Batter against bowler before a day, for all who meet or met and stand in one match."""
    keys = ["batter_id", "bowler_id", *FORMAT]
    facts = ws["balls"].groupBy(*keys, "start_date").agg(
        tally(F.col("faced")).alias("balls"), F.sum("runs_batter").alias("runs"), tally(F.col("striker_credited")).alias("outs"),
        tally(F.col("faced") & (F.col("runs_batter") == 0)).alias("dots"), tally(F.col("is_four")).alias("fours"), tally(F.col("is_six")).alias("sixes"),
        F.countDistinct("match_id").alias("matches")).withColumns({"first": F.col("start_date"), "last": F.col("start_date")})
    asked = _together(ws, facts, "batter_id", "bowler_id")
    return running(facts, asked, keys, ("balls", "runs", "outs", "dots", "fours", "sixes", "matches"), ("last",), ("first",))


def _together(ws: Workspace, facts: DataFrame, one: str, two: str) -> DataFrame:
    """Pairs of players of one match that `facts` knows from any day. All ordered pairs of a squad are hundreds of rows a match, so each
    player's opposite numbers are looked up in the squad as an array, and only those found become rows."""
    squad = squads(ws).filter("match_id is not null").groupBy("match_id", *FORMAT, "start_date").agg(F.collect_set("person_id").alias("squad"))
    known = facts.groupBy(one, *FORMAT).agg(F.collect_set(two).alias("known"))
    rows = squad.select(*FORMAT, "start_date", "squad", F.explode("squad").alias(one)).join(known, [one, *FORMAT])
    return rows.select(one, *FORMAT, "start_date", F.explode(F.array_intersect("known", "squad")).alias(two)).filter(F.col(one) != F.col(two))


@relation("asof_pair")
def asof_pair(ws: Workspace) -> DataFrame:
    """Stands of two batters before a day."""
    keys = ["a", "b", *FORMAT]
    facts = ws["partnerships"].select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), *FORMAT, "start_date", "runs", "balls").withColumns(
        {"stands": F.lit(1), "best": F.col("runs"), "fifties": (F.col("runs") >= 50).cast("int")})
    asked = _together(ws, facts, "a", "b")
    return running(facts, asked, keys, ("stands", "runs", "balls", "fifties"), ("best",))


@relation("asof_innings")
def asof_innings(ws: Workspace) -> DataFrame:
    """Innings and spells of a player before a day, best ones included; figure orders spells by wickets, then runs."""
    keys = ["person_id", *FORMAT]
    asked = squads(ws)
    bat = ws["bat_innings"].select(F.col("batter_id").alias("person_id"), *FORMAT, "start_date", F.lit(1).alias("innings"), F.col("runs").alias("best"), (F.col("runs") >= 50).cast("int").alias("fifties"))
    bowl = ws["bowl_innings"].select(F.col("bowler_id").alias("person_id"), *FORMAT, "start_date", F.lit(1).alias("spells"), F.col("wickets").alias("best_wickets"),
                                     (F.col("runs") - 1000 * F.col("wickets")).alias("figure"), (F.col("wickets") >= 4).cast("int").alias("hauls"))
    one = running(bat, asked, keys, ("innings", "fifties"), ("best",))
    two = running(bowl, asked, keys, ("spells", "hauls"), ("best_wickets",), ("figure",)).withColumn("best_runs", F.col("figure") + 1000 * F.col("best_wickets")).drop("figure")
    return one.join(two, [*keys, "start_date"], "full")


COMPETITION = ["competition", *FORMAT]


def _competition_days(ws: Workspace) -> DataFrame:
    return ws["matches"].filter("competition is not null").select(*COMPETITION, "start_date").distinct()


@relation("asof_competition")
def asof_competition(ws: Workspace) -> DataFrame:
    """Records of a competition before a day: matches, highest total, score and stand, best haul."""
    of = ws["team_results"].select("match_id", *COMPETITION, "start_date")
    parts = [
        of.withColumn("matches", F.lit(1)),
        ws["innings"].filter(~F.col("super_over")).select("match_id", "total_runs").join(of, "match_id").withColumnRenamed("total_runs", "top_total"),
        ws["bat_innings"].select(*COMPETITION, "start_date", F.col("runs").alias("top_score")),
        ws["bowl_innings"].select(*COMPETITION, "start_date", F.col("wickets").alias("best_wickets")),
        ws["partnerships"].select(*COMPETITION, "start_date", F.col("runs").alias("top_stand"))]
    facts = parts[0].drop("match_id")
    for p in parts[1:]:
        facts = facts.unionByName(p.drop("match_id"), allowMissingColumns=True)
    return running(facts.filter("competition is not null"), _competition_days(ws), COMPETITION, ("matches",), ("top_total", "top_score", "best_wickets", "top_stand"))


@relation("asof_stand")
def asof_stand(ws: Workspace) -> DataFrame:
    """The highest stand for each wicket of a competition before a day."""
    facts = ws["partnerships"].filter("competition is not null").select(*COMPETITION, "start_date", "wicket_no", F.col("runs").alias("top_stand"))
    asked = _competition_days(ws).join(facts.select(*COMPETITION, "wicket_no").distinct(), COMPETITION)
    return running(facts, asked, [*COMPETITION, "wicket_no"], (), ("top_stand",))


@relation("asof_board")
def asof_board(ws: Workspace) -> DataFrame:
    """The first BOARD run scorers and wicket takers of a competition before a day. A competition has as many rows here as
    days times its players of earlier days; they are ranked where they are and leave as BOARD rows."""
    out = []
    for board, table, who, value in (("runs", "bat_innings", "batter_id", "runs"), ("wickets", "bowl_innings", "bowler_id", "wickets")):
        facts = ws[table].filter("competition is not null").select(F.col(who).alias("person_id"), *COMPETITION, "start_date", F.col(value).alias("value"))
        asked = _competition_days(ws).join(facts.select("person_id", *COMPETITION).distinct(), COMPETITION)
        sums = running(facts, asked, ["person_id", *COMPETITION], ("value",))
        w = Window.partitionBy(*COMPETITION, "start_date").orderBy(F.desc("value"), "person_id")
        out.append(sums.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= BOARD).withColumn("board", F.lit(board)))
    return out[0].unionByName(out[1])


@relation("asof_squad")
def asof_squad(ws: Workspace) -> DataFrame:
    """Runs and wickets of a player in a competition before a day."""
    keys = ["person_id", *COMPETITION]
    facts = ws["bat_innings"].select(F.col("batter_id").alias("person_id"), *COMPETITION, "start_date", "runs").unionByName(
        ws["bowl_innings"].select(F.col("bowler_id").alias("person_id"), *COMPETITION, "start_date", "wickets"), allowMissingColumns=True)
    return running(facts.filter("competition is not null"), squads(ws).filter("competition is not null"), keys, ("runs", "wickets"))


def _days(ws: Workspace) -> DataFrame:
    return ws["matches"].select(*FORMAT, "start_date").distinct()


def quantile_before(facts: DataFrame, days: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, start_date, n, v): the discrete quantile of whole numbers before each day, from running histograms.

    The values are few, so a day asks once for each value, and no list of facts is kept."""
    values = facts.groupBy(*keys, "start_date", "value").agg(F.count("*").alias("n"))
    asked = days.join(values.select(*keys, "value").distinct(), keys)
    so_far = running(values, asked, [*keys, "value"], ("n",))
    day = Window.partitionBy(*keys, "start_date")
    upto = so_far.select(*keys, "start_date", "value", F.sum("n").over(day.orderBy("value")).alias("upto"), F.sum("n").over(day).alias("n"))
    needed = F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.lit(q) * F.col("n")))
    return upto.filter(F.col("upto") >= needed).groupBy(*keys, "start_date").agg(F.max("n").alias("n"), F.min("value").alias("v"))


@relation("asof_unusual")
def asof_unusual(ws: Workspace) -> DataFrame:
    """The 99th percentile, before a day, of the longest run of dots in an innings and of the runs of an over."""
    b = ws["balls"]
    dots = b.groupBy(*FORMAT, "start_date", "match_id", "innings_no").agg(F.max("team_dot_streak").alias("value"))
    overs = b.groupBy(*FORMAT, "start_date", "match_id", "innings_no", "over").agg(F.sum("runs_total").alias("value"))
    return quantile_before(dots, _days(ws), FORMAT, 0.99).withColumn("what", F.lit("dot_streak")).unionByName(
        quantile_before(overs, _days(ws), FORMAT, 0.99).withColumn("what", F.lit("over_runs")))


def _marks(ws: Workspace) -> DataFrame:
    return ws["balls"].filter("legal and legal_balls_before % 6 = 0").withColumn("mark", F.col("legal_balls_before"))


@relation("asof_score")
def asof_score(ws: Workspace) -> DataFrame:
    """Innings and their average score at each sixth legal ball, before a day."""
    keys = [*FORMAT, "innings_no", "mark"]
    facts = _marks(ws).filter("innings_no <= 2").select(*keys, "start_date", F.lit(1).alias("n"), F.col("score_before").alias("total"))
    asked = _days(ws).join(facts.select(*keys).distinct(), FORMAT)
    return running(facts, asked, keys, ("n", "total")).withColumn("score", F.round(F.col("total") / F.col("n"), 1)).drop("total")


@relation("asof_wickets")
def asof_wickets(ws: Workspace) -> DataFrame:
    """How many innings stood at each number of wickets at each sixth legal ball, before a day."""
    keys = [*FORMAT, "mark", "wickets"]
    facts = _marks(ws).withColumn("wickets", F.col("wickets_before")).select(*keys, "start_date", F.lit(1).alias("n"))
    asked = _days(ws).join(facts.select(*keys).distinct(), FORMAT)
    return running(facts, asked, keys, ("n",))
