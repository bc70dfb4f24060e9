"""The fold does not depend on how the feed arrives."""
import random

import pandas as pd

from inswing.streaming import fold


class Held:
    """Stands in for the engine's keyed state."""
    def __init__(self):
        self.value = None
        self.hasTimedOut = False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def ball(n, runs, **kw):
    base = dict(event_id=f"b{n}", match_id="m", kind="delivery", innings=1, over=n // 6, idx=n % 6, batter_id="a", non_striker_id="b", bowler_id="z", runs_batter=runs, wides=0,
                noballs=0, byes=0, legbyes=0, penalty=0, wicket_kind=None, player_out_id=None, op=None, target_event_id=None, new_event_id=None, target_runs=None, layer=None, seq=n)
    return {**base, **kw}


def run(batches):
    state, out = Held(), None
    for rows in batches:
        for frame in fold.fold_match(("m",), iter([pd.DataFrame(rows)]), state):
            out = frame
    return out.iloc[-1]


FEED = [ball(i, i % 5) for i in range(30)]


def test_order_and_duplicates_do_not_matter():
    want = run([FEED])
    rng = random.Random(3)
    for _ in range(5):
        rows = FEED + FEED[::4]
        rng.shuffle(rows)
        got = run([rows[i::3] for i in range(3)])
        assert got.state_hash == want.state_hash and got.anomalies == 0


def test_update_retract_insert_equal_the_clean_feed():
    want = run([FEED])
    fix = ball(4, 4, event_id="c1", kind="correction", op="update", target_event_id="b4", seq=90)
    ghost = ball(7, 6, event_id="g", idx=50, seq=91)
    undo = ball(7, 0, event_id="c2", kind="correction", op="retract", target_event_id="g", seq=92)
    late = ball(10, 0, event_id="c3", kind="correction", op="insert", target_event_id="b9", new_event_id="b10", innings=None, over=None, idx=None, seq=93)
    dirty = [({**r, "runs_batter": 3} if r["event_id"] == "b4" else r) for r in FEED if r["event_id"] != "b10"]
    got = run([[undo, fix, late], dirty[::2], dirty[1::2] + [ghost]])
    assert got.runs == want.runs and got.legal_balls == want.legal_balls and got.open_corrections == 0


def test_conflicting_copy_is_counted_and_the_first_kept():
    got = run([[ball(0, 1)], [ball(0, 4, seq=9)]])
    assert got.runs == 1 and got.anomalies == 1


def test_late_event_restarts_from_a_snapshot():
    late = [r for r in FEED if r["event_id"] != "b13"]
    assert run([late, [FEED[13]]]).state_hash == run([FEED]).state_hash


class Timed(Held):
    timeout = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def live(state, rows):
    return [r for frame in fold.fold_live(("m",), iter([pd.DataFrame(rows)]), state) for r in frame.to_dict("records")]


def test_only_an_ended_match_expires_and_then_never_publishes():
    state = Timed()
    before = live(state, FEED)
    assert state.timeout is None  # a match may rest overnight
    more = live(state, [ball(30, 4)])
    assert more[-1]["runs"] == before[-1]["runs"] + 4
    live(state, [ball(99, None, event_id="end", kind="match_end", innings=99, over=None, idx=None)])
    assert state.timeout == fold.IDLE_MS
    state.hasTimedOut = True
    assert list(fold.fold_live(("m",), iter([]), state)) == []
    state.hasTimedOut = False
    late = live(state, [ball(31, 6), ball(32, 6)])
    assert len(late) == 1 and late[0]["anomalies"] == 2 and late[0]["closed"] and pd.isna(late[0]["runs"])


def test_snapshots_survive_a_correction():
    import json

    state = Held()
    fix = ball(20, 4, event_id="c1", kind="correction", op="update", target_event_id="b20", seq=90)
    for rows in (FEED, [fix], [ball(30, 1)]):
        out = list(fold.fold_match(("m",), iter([pd.DataFrame(rows)]), state))[-1].iloc[-1]
    clean = [({**r, "runs_batter": 4} if r["event_id"] == "b20" else r) for r in FEED] + [ball(30, 1)]
    assert out.state_hash == run([clean]).state_hash
    assert [x[0][1] for x in json.loads(state.value[0])["snaps"]][:3] == [0, 1, 2]
