"""Intervals by match against numpy on the same weights."""
import hashlib
import math

import numpy as np
import pytest

from inswing.models import bootstrap as B


def weight(match, draw):
    u = int(hashlib.md5(f"{B.SEED}:{draw}:{match}".encode()).hexdigest()[:8], 16)
    return sum(u >= s for s in B.STEPS)


def test_weights_are_poisson():
    w = np.array([weight(m, d) for m in range(300) for d in range(1, 201)])
    for k in range(5):
        assert np.mean(w == k) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)


def test_intervals_equal_numpy(spark):
    # a third of all rows is one match; one group has a single match, one only zero denominators; a key and a value are null
    rnd = np.random.default_rng(3)
    rows = [("a" if i % 4 else None, 0 if i % 3 == 0 else int(rnd.integers(1, 25)), float(rnd.integers(0, 7)), 1.0) for i in range(900)]
    rows += [("one", 5, 2.0, 1.0), ("one", 5, None, 1.0), ("zero", 6, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, match_id long, x double, n double")
    got = {r.g: r for r in B.intervals(df.repartition(7), ["g"], {"mean": ("x", "n")}).collect()}
    again = {r.g: r for r in B.intervals(df.coalesce(1), ["g"], {"mean": ("x", "n")}).collect()}
    assert got.keys() == {"a", None, "one", "zero"}
    for g in ("a", None, "one"):
        mine = [r for r in rows if r[0] == g]
        ids = sorted({r[1] for r in mine})
        x = np.array([sum(r[2] or 0 for r in mine if r[1] == m) for m in ids])
        n = np.array([sum(r[3] for r in mine if r[1] == m) for m in ids])
        w = np.array([[weight(m, d) for m in ids] for d in range(1, 201)])
        kept = w.sum(1) > 0
        ratio = (w[kept] @ x) / (w[kept] @ n)
        assert got[g].value == pytest.approx(x.sum() / n.sum()) and got[g].matches == len(ids)
        assert (got[g].lo, got[g].hi) == pytest.approx(tuple(np.percentile(ratio, [2.5, 97.5])))
        assert (again[g].lo, again[g].hi) == pytest.approx((got[g].lo, got[g].hi))
    assert (got["zero"].value, got["zero"].lo, got["zero"].hi) == (None, None, None)
    assert B.intervals(df.limit(0), ["g"], {"mean": ("x", "n")}).count() == 0


def test_matches_are_drawn_once_in_several_tasks(spark):
    # a match in many groups has one list of draws; few small rows are not drawn in one task; a row without a match counts in draw 0 only
    df = spark.createDataFrame([(f"g{i % 6}", i % 40 if i else None, 1.0) for i in range(240)], "g string, match_id long, x double")
    reps = B.replicates(df, ["g"], ["x"])
    assert "posexplode" in reps._jdf.queryExecution().optimizedPlan().toString()
    drawn = {(r.g, r.draw): r.matches for r in reps.collect()}
    ids = sorted({i % 40 for i in range(240) if i and i % 6 == 0})
    assert all(drawn.get(("g0", d), 0) == sum(weight(m, d) for m in ids) for d in (1, 2, 200))
    assert drawn["g0", 0] == len(ids) + 1
