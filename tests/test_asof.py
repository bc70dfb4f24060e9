"""Baselines know strictly earlier days only."""
from __future__ import annotations

import datetime as dt
import random

from inswing.operators import asof
from inswing.plans.workspace import Workspace

SCHEMA = "k string, start_date date, n int, best int"


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def test_running_equals_search(spark):
    rng = random.Random(2)
    facts = [(rng.choice(["a", "a", "a", "b", None]), day(rng.randrange(20)), rng.randrange(9), rng.randrange(99)) for _ in range(200)]
    asked = [(k, day(i)) for k in ("a", "b", None, "nobody") for i in range(0, 25, 2)] * 2
    got = asof.running(spark.createDataFrame(facts, SCHEMA), spark.createDataFrame(asked, "k string, start_date date"), ["k"], ("n",), ("best",)).collect()
    want = []
    for k, d in set(asked):
        earlier = [f for f in facts if f[0] == k and f[1] < d]
        if earlier:
            want.append((k, d, sum(f[2] for f in earlier), max(f[3] for f in earlier)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert asof.running(spark.createDataFrame([], SCHEMA), spark.createDataFrame(asked, "k string, start_date date"), ["k"], ("n",)).count() == 0


def test_quantile_equals_sorted_list(spark):
    rng = random.Random(3)
    facts = [("x", day(rng.randrange(30)), int(rng.expovariate(0.2))) for _ in range(600)]
    days = spark.createDataFrame([("x", day(i)) for i in range(0, 35, 5)], "k string, start_date date")
    for r in asof.quantile_before(spark.createDataFrame(facts, "k string, start_date date, value int"), days, ["k"], 0.99).collect():
        earlier = sorted(v for _, d, v in facts if d < r.start_date)
        assert r.n == len(earlier) and r.v == earlier[len(earlier) - int(len(earlier) - 0.99 * len(earlier)) - 1]


def test_a_later_match_changes_nothing_earlier(spark, ws):
    """Matches of the second half moved a year on, and all their runs doubled: what was known on earlier days stays."""
    from pyspark.sql import functions as F

    middle = ws["matches"].selectExpr("percentile(datediff(start_date, date'2000-01-01'), 0.5) AS d").first().d
    late = F.datediff("start_date", F.lit("2000-01-01")) > middle
    changed = {n: ws[n] for n in ("matches", "players_in_match", "balls", "partnerships", "bat_innings", "bowl_innings", "team_results", "innings")}
    for n in ("matches", "balls", "partnerships", "bat_innings", "bowl_innings", "team_results"):
        changed[n] = changed[n].withColumn("start_date", F.when(late, F.date_add("start_date", 365)).otherwise(F.col("start_date")))
    changed["bat_innings"] = changed["bat_innings"].withColumn("runs", F.when(late, F.col("runs") * 2).otherwise(F.col("runs")))
    other = Workspace(spark, ws.inputs, changed)
    found = 0
    for build in (asof.asof_bat, asof.asof_battle, asof.asof_pair, asof.asof_innings, asof.asof_competition, asof.asof_board, asof.asof_unusual):
        first, second = (sorted(map(str, build(w).filter(~late).collect())) for w in (ws, other))
        assert first == second
        found += len(first)
    assert found
