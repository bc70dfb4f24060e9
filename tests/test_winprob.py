"""Par score, remaining runs and backed-off states against plain loops over the same balls."""
from __future__ import annotations

import math
import random

import pytest

from inswing.models import winprob as W

COLUMNS = ("delivery_id string, match_id string, format_group string, gender string, innings_no int, bowled int, score int, wickets int, target int, "
           "split string, limit int, first_total int, y double")


@pytest.fixture(scope="module")
def balls():
    rnd, out = random.Random(4), []
    for m in range(60):
        fmt = "ODI" if m % 3 == 0 else "T20"
        limit, total = W.FULL[fmt], rnd.randrange(60, 200)
        split = rnd.choice(["train", "train", "validate"])
        label = rnd.choice([0.0, 1.0, 0.5])
        for inn in (1, 2):
            score = wickets = 0
            for b in range(rnd.randrange(1, limit)):
                if rnd.random() < 0.6:
                    out.append((f"{m}-{inn}-{b}", str(m), fmt, "male", inn, b, score, wickets, total + 1, split, limit, total, label if inn == 1 else 1 - label))
                score = min(total, score + rnd.choice([0, 1, 1, 2, 4]))
                wickets = min(9, wickets + (rnd.random() < 0.05))
    return out


@pytest.fixture(scope="module")
def frame(spark, balls):
    return spark.createDataFrame(balls, COLUMNS)


def train_of(balls, fmt, inn=1):
    return [r for r in balls if r[2] == fmt and r[4] == inn and r[9] == "train"]


def par_of(balls, fmt):
    out, last = [], 0.0
    for b in range(W.FULL[fmt] + 1):
        scores = [r[6] for r in train_of(balls, fmt) if r[5] == b]
        last = sum(scores) / len(scores) if scores else last
        out.append(last)
    return out


def test_par(frame, balls):
    got = {(r.format_group, r.bowled): r.par for r in W.par(frame.where("split = 'train'")).collect()}
    for fmt in W.FULL:
        assert [got[fmt, b] for b in range(W.FULL[fmt] + 1)] == pytest.approx(par_of(balls, fmt))


def test_remaining(frame, balls):
    rows = W.remaining(frame.where("split = 'train'")).collect()
    got = {(r.format_group, r.left, r.wickets): r for r in rows}
    assert len(got) == len(rows) == 4200
    for fmt, limit in W.FULL.items():
        runs: dict = {}
        for r in train_of(balls, fmt):
            runs.setdefault((limit - r[5], r[7]), []).append(r[11] - r[6])
        mean, sd, widths = {}, {}, set()
        for left in range(1, limit + 1):
            for w in range(10):
                width = W.FIRST_WIDTH[fmt]
                while True:
                    x = [v for d in range(left - width, left + width + 1) for v in runs.get((d, w), [])]
                    if len(x) >= W.ENOUGH or width > limit:
                        break
                    width *= 2
                widths.add(width)
                assert (got[fmt, left, w].width, got[fmt, left, w].n) == (width, len(x))
                if x:
                    mean[left, w] = sum(x) / len(x)
                    sd[left, w] = max(math.sqrt(max(sum(v * v for v in x) / len(x) - mean[left, w] ** 2, 0)), W.LEAST_SD)
                else:
                    mean[left, w], sd[left, w] = mean.get((left, w - 1), 0.0), sd.get((left, w - 1), W.LEAST_SD)
        assert len(widths) > 4
        for left in range(1, limit + 1):
            for w in range(10):
                want = max(min(mean[at, v] for v in range(w + 1)) for at in range(1, left + 1))
                assert got[fmt, left, w].mean == pytest.approx(want) and got[fmt, left, w].sd == pytest.approx(sd[left, w])


def keys_of(r, par):
    fmt, inn, left = r[2], r[4], W.FULL[r[2]] - r[5]
    b, w = (left - 1) // W.BALL_BIN[fmt], r[7]
    if inn == 1:
        end = W.LEAD_END[fmt]
        x = math.floor(max(-end, min(end, r[6] - par[r[5]])) / W.LEAD_BIN[fmt])
    else:
        x = min(W.NEED_END[fmt], (r[8] - r[6]) // W.NEED_BIN[fmt])
    return [(0, b, w, x), (1, b // 2, w // 2, x // 2), (2, b // 4, 0 if w <= 2 else 1 if w <= 5 else 2, x // 4), (3, b // 8, 0, x // 8), (4, 0, 0, 0)]


def test_states(spark, frame, balls):
    pars = W.par(frame.where("split = 'train'"))
    rows = W.binned(frame, pars)
    table = W.state_table(rows.where("split = 'train'"))
    cells: dict = {}
    of = {fmt: par_of(balls, fmt) for fmt in W.FULL}
    for r in balls:
        if r[9] == "train":
            for key in keys_of(r, of[r[2]]):
                cell = cells.setdefault((r[2], r[4], *key), [0, 0.0])
                cell[0] += 1
                cell[1] += r[12]
    got = {(r.format_group, r.innings_no, r.level, r.a, r.b, r.c): [r.n, r.won] for r in table.collect()}
    assert got == cells and any(k[-1] < 0 for k in cells)

    def probability(r, k):
        keys = [cells.get((r[2], r[4], *x)) for x in keys_of(r, of[r[2]])]
        p = keys[-1][1] / keys[-1][0]
        for cell in reversed(keys[:-1]):
            p = (cell[1] + k * p) / (cell[0] + k) if cell else p
        return p

    want = {}
    for r in balls:
        if r[9] == "validate":
            for k in W.SHRINK:
                p = min(max(probability(r, k), W.CLIP), 1 - W.CLIP)
                want.setdefault((r[2], r[4], k), []).append((-(r[12] * math.log(p) + (1 - r[12]) * math.log(1 - p)), (p - r[12]) ** 2))
    tried = W.losses(rows.where("split = 'validate'"), table, W.SHRINK)
    seen = {(r.format_group, r.innings_no, r.k): (r.balls, r.log_loss, r.brier) for r in tried.collect()}
    assert set(seen) == set(want)
    for key, x in want.items():
        assert seen[key] == pytest.approx((len(x), sum(a for a, _ in x) / len(x), sum(b for _, b in x) / len(x)), abs=1e-4)
    best = {(r.format_group, r.innings_no): r.k for r in W.choose(tried).collect()}
    for group, k in best.items():
        assert seen[(*group, k)][1] <= min(v[1] for key, v in seen.items() if key[:2] == group) + 1e-9

    # nothing is lost: states never seen in training take the coarser ones
    states = rows.where("split = 'validate'").select("delivery_id", *W.GROUP, *W.STATE)
    p = {r.delivery_id: r.p for r in W.backed_off(states, table, [30]).collect()}
    assert p == {r[0]: pytest.approx(probability(r, 30)) for r in balls if r[9] == "validate"}


def test_empty(frame):
    none = frame.limit(0)
    rows = W.binned(none, W.par(none))
    assert W.remaining(none).count() == 0 and W.losses(rows, W.state_table(rows), [10]).count() == 0
