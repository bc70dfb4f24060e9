"""op12: bytes covered by strings that start earlier, against a search of all windows."""
from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inswing.llm import suffixes
from tests.llm.conftest import ODD, prose


def brute(rows):
    """Every window of every text, in the order of documents."""

    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - suffixes.LENGTH + 1):
            w = raw[i:i + suffixes.LENGTH]
            if w in seen:
                gone[i:i + suffixes.LENGTH] = b"\1" * suffixes.LENGTH
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted([tuple(r) for r in suffixes.report(frame).collect()], key=str)


def mixed(seed):
    """Texts made of shared pieces with edits, repeats inside a text, runs of one byte, and characters of several bytes."""
    rng = random.Random(seed)
    pieces = [prose(rng.randint(5, 60), rng.randint(0, 99)) for _ in range(6)] + ["ä" * 300, "ab" * 200, "\n".join(["line of text"] * 40), "x" * 99, "y" * 100]
    out = []
    for doc in range(60):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 6)))
        if text and rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + rng.randint(0, 3):]
        out.append((doc * 3 % 61, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search_of_all_windows(frame, seed):
    rows = mixed(seed)
    assert got(frame(rows)) == brute(rows)


def test_hot_anchors_window_by_window(frame, monkeypatch):
    """A passage in all documents with other bytes around it: more contexts than are sorted as a group."""
    rows = [(i, f"{i * 7919} {'the very same passage in each of them, ' * 2}{i * 104729} and {prose(20, i)}") for i in range(80)] + mixed(3)[:20]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    texts = suffixes.texts_in_order(frame(rows))
    wide, narrow = (suffixes.repeats(texts, k).select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("b")).distinct() for k in (20_000, 2))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))
    assert got(frame(rows)) == brute(rows)


def test_nulls_ties_and_long_texts(frame, odd, clashing, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 5000)
    rows = [(r[0], r[1]) for r in ODD]
    want = brute(rows)
    # rows of one id come by a hash of their text, so only their sums are the same in any order
    assert [(r[0], r[1], r[2]) for r in got(odd)] == [(r[0], r[1], r[2]) for r in want]
    assert got(clashing) == got(odd)
    assert got(frame([])) == []


def test_whole_copies_and_short_texts(frame):
    rows = [(1, "a" * 99), (2, "a" * 99), (3, prose(40, 1)), (4, prose(40, 1)), (4, prose(40, 1)), (None, prose(40, 1))]
    assert [(r[0], r[2]) for r in got(frame(rows))] == [(r[0], r[2]) for r in brute(rows)]
    assert [r[2] for r in got(frame(rows))].count(0) == 3


def test_sorting_and_tries():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 3, (400, 70), dtype=np.uint8)
    rows[200:, :60] = rows[rng.integers(0, 20, 200), :60]
    rows[300:] = rows[rng.integers(0, 300, 100)]
    order, common = suffixes.deep_shallow(rows)
    texts = [bytes(r) for r in rows]
    assert [texts[i] for i in order] == sorted(texts)
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        assert common[k] == next((i for i in range(70) if a[i] != b[i]), 70)
    some = texts[:50] + texts[:10]
    assert [some[i] for i in suffixes.blind_trie(some)] == sorted(some)
