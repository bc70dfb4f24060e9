"""The typed fold: the order of arrival and the number of batches change nothing, and its state does not grow with the balls."""
from __future__ import annotations

import json

import pytest
from pyspark.sql import Window, functions as F

from inswing.streaming import scorer


@pytest.fixture(scope="module")
def some(ws):
    feed = ws["ball_feed"]
    few = [r.match_id for r in feed.select("match_id").distinct().orderBy("match_id").limit(5).collect()]
    return feed.filter(F.col("match_id").isin(few))


def rows(frame):
    return sorted(str(r.asDict() | {"version": 0}) for r in frame.collect())


def test_any_number_of_batches_ends_alike(ws, some):
    feed = some.unionByName(scorer.revisions(some)).cache()
    assert scorer.revisions(some).count()
    one = rows(scorer.replayed(ws, feed, "test-1", 1))
    assert one == rows(scorer.replayed(ws, feed, "test-4", 4))
    assert sum("'part': 'innings'" in r for r in one) == some.filter("kind = 'innings_end'").count()


def test_a_late_revision_counts_from_its_place(ws, some):
    """Sent behind the ball it refers to, but before its innings ended, it is in force from its place all the same."""
    feed = some.unionByName(scorer.revisions(some))
    inforce = {(r.match_id, r.innings): r.target for r in scorer.targets(feed).withColumn("n", F.max("seq").over(Window.partitionBy("match_id", "innings"))).filter("seq = n").collect()}
    got = {(r.match_id, r.innings): r.target for r in scorer.replayed(ws, feed, "test-late", 3).filter("part = 'innings'").collect()}
    for key, target in inforce.items():
        last = some.filter((F.col("match_id") == key[0]) & (F.col("innings") == key[1])).agg(F.max("seq")).first()[0]
        if last not in (24, 48):  # a revision after the last ball is in force at the end, and before no ball
            assert got[key] == target


def test_state_holds_people_not_balls(ws, some, spark):
    unfinished = some.filter("kind <> 'innings_end' or innings < 2")
    scorer.replayed(ws, unfinished, "test-state", 2)
    cp = f"{ws.root}/stream/test-state/cp"

    def held(name):
        return spark.read.format("statestore").option("stateVarName", name).load(cp).count()

    matches = some.select("match_id").distinct().count()
    assert held("innings") == matches and held("waiting") <= matches
    assert 0 < held("batters") <= 11 * matches and 0 < held("bowlers") <= 11 * matches


def test_each_list_of_a_match_is_one_value(ws, some, spark):
    """Without the start of an innings all its balls wait; copies wait once, and the rest of the feed ends as ever."""
    headless = some.filter("kind <> 'innings_start'")
    scorer.replayed(ws, headless, "test-headless", 2)
    kept = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{ws.root}/stream/test-headless/cp")
    matches = some.select("match_id").distinct().count()
    assert kept.count() == matches
    waiting = [tuple(r) for v in kept.select("value.rows").collect() for r in json.loads(v[0])]
    assert len(waiting) == len(set(waiting)) and set(waiting) == {tuple(r) for r in headless.collect()}
    scorer.replayed(ws, some.filter("kind <> 'innings_end'"), "test-open", 2)
    assert spark.read.format("statestore").option("stateVarName", "batters").load(f"{ws.root}/stream/test-open/cp").count() == matches
