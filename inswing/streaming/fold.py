"""Structured Streaming fold of the event log into match state.

The state of a match is the set of its events so far. A batch that changes nothing but the tail extends the fold; one
that touches an earlier place restarts from the snapshot of the over before that place.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inswing.plans.workspace import Workspace
from inswing.streaming.events import RUNS, SCHEMA

OUTPUT = ("match_id string, innings int, runs int, wickets int, legal_balls int, extras int, fours int, sixes int, last_over string, "
          "stand_runs int, stand_balls int, fall string, anomalies int, open_corrections int, closed boolean, version long, state_hash string")
STATE = "payload string"
IDLE_MS = 24 * 3600 * 1000
BALL = ["batter_id", "non_striker_id", "bowler_id", *RUNS, "wicket_kind", "player_out_id"]
STAYS = ("retired hurt", "retired not out")


def _fresh() -> dict:
    return {"runs": 0, "wickets": 0, "legal": 0, "extras": 0, "fours": 0, "sixes": 0, "stand": [0, 0], "fall": [], "over": None, "line": []}


def _step(s: dict, over: int, b: list) -> None:
    """One delivery added to an innings."""
    v = dict(zip(BALL, b))
    extras = sum(v[r] or 0 for r in RUNS[1:])
    total = (v["runs_batter"] or 0) + extras
    legal = not (v["wides"] or v["noballs"])
    if s["over"] != over:
        s["over"], s["line"] = over, []
    s["runs"] += total
    s["extras"] += extras
    s["legal"] += legal
    s["fours"] += v["runs_batter"] == 4
    s["sixes"] += v["runs_batter"] == 6
    s["stand"] = [s["stand"][0] + total, s["stand"][1] + legal]
    s["line"].append("W" if v["wicket_kind"] else str(total))
    if v["wicket_kind"]:
        s["stand"] = [0, 0]
        if v["wicket_kind"] not in STAYS:
            s["wickets"] += 1
            s["fall"].append(s["runs"])


def corrected(events: dict, corrections: dict) -> tuple[dict, int]:
    """Events after corrections, in arrival order; a correction whose target is still missing is left open."""
    live = {k: v for k, v in events.items()}
    waiting = sorted(corrections.values(), key=lambda c: c["seq"])
    moved = True
    while waiting and moved:
        moved, rest = False, []
        for c in waiting:
            target = live.get(c["target"])
            if target is None:
                rest.append(c)
                continue
            moved = True
            if c["op"] == "update":
                live[c["target"]] = {**target, "ball": c["ball"]}
            elif c["op"] == "retract":
                live.pop(c["target"])
            else:
                live[c["new"]] = {"kind": "delivery", "at": [*target["at"], c["seq"]], "ball": c["ball"]}
        waiting = rest
    return live, len(waiting)


def refold(live: dict, snaps: list, before: list | None) -> tuple[dict, list]:
    """Innings states of the ordered deliveries, restarted from the last snapshot ahead of the first changed place."""
    kept = [x for x in snaps if before is not None and x[0] < before]
    start, innings = (kept[-1][0], json.loads(kept[-1][1])) if kept else (None, {})
    order = sorted((v["at"], v["ball"]) for v in live.values() if v["kind"] == "delivery" and (start is None or v["at"] > start))
    last, here = None, None
    for at, ball in order:
        here = (at[0], at[1])
        if last is not None and here != last[0]:
            kept.append([last[1], json.dumps(innings)])
        _step(innings.setdefault(str(at[0]), _fresh()), at[1], ball)
        last = (here, at)
    return innings, kept


def _number(x):
    return None if x is None or x != x else x


def fold_live(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """As fold_match, for an endless feed. Only a match that has ended can expire, a day after its last event; a tombstone stays.

    What comes for a match behind its tombstone is refused: it changes nothing, and a row without an innings says how many
    events were refused so far, with the version the match ended on."""
    held = json.loads(state.get[0]) if state.exists else {}
    if state.hasTimedOut:
        state.update((json.dumps({"tombstone": held["version"], "refused": 0}),))
        return
    if "tombstone" in held:
        held["refused"] += sum(len(frame) for frame in batches)
        state.update((json.dumps(held),))
        gone = dict.fromkeys(c.split()[0] for c in OUTPUT.split(", ")) | {
            "match_id": key[0], "anomalies": held["refused"], "closed": True, "version": held["tombstone"]}
        yield pd.DataFrame([gone]).astype({c: "Int64" for c in ("innings", "runs", "wickets", "legal_balls", "extras", "fours", "sixes", "stand_runs", "stand_balls", "open_corrections")})
        return
    yield from fold_match(key, batches, state)
    if any(e["kind"] == "match_end" for e in json.loads(state.get[0])["events"].values()):
        state.setTimeoutDuration(IDLE_MS)


def fold_match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge a batch of one match's events into its state and emit every innings."""
    held = json.loads(state.get[0]) if state.exists else {"events": {}, "corrections": {}, "digests": {}, "anomalies": 0, "snaps": [], "version": 0}
    was, _ = corrected(held["events"], held["corrections"])
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["seq", "event_id"], kind="stable").to_dict("records")
    for r in rows:
        r = {k: _number(v) for k, v in r.items()}
        ball = [int(r[c]) if c in RUNS and r[c] is not None else r[c] for c in BALL]
        digest = hashlib.sha256(json.dumps([r["kind"], r["op"], r["target_event_id"], ball], sort_keys=True).encode()).hexdigest()[:16]
        seq, known = int(r["seq"] or 0), held["digests"].get(r["event_id"])
        if known:
            if known[0] != digest:
                held["anomalies"] += 1
            if known[0] == digest or known[1] <= seq:
                continue  # the copy that arrived first in the feed's own numbering is the one that counts
        held["digests"][r["event_id"]] = [digest, seq]
        if r["kind"] == "correction":
            held["corrections"][r["event_id"]] = {"op": r["op"], "target": r["target_event_id"], "new": r["new_event_id"], "ball": ball, "seq": seq}
        else:
            at = [int(r[c]) if r[c] is not None else -1 for c in ("innings", "over", "idx")]
            held["events"][r["event_id"]] = {"kind": r["kind"], "at": at, "ball": ball}
    live, waiting = corrected(held["events"], held["corrections"])
    # the first place that this batch changed; snapshots ahead of it stay, whatever has been corrected
    moved = [v["at"] for k, v in live.items() if was.get(k) != v] + [v["at"] for k, v in was.items() if k not in live]
    innings, held["snaps"] = refold(live, held["snaps"], min(moved, default=[float("inf")]))
    held["version"] += 1
    state.update((json.dumps(held),))
    done = {v["at"][0] for v in live.values() if v["kind"] == "innings_end"}
    out = []
    for no, s in sorted(innings.items()):
        out.append((key[0], int(no), s["runs"], s["wickets"], s["legal"], s["extras"], s["fours"], s["sixes"], " ".join(s["line"]), s["stand"][0], s["stand"][1],
                    ",".join(map(str, s["fall"])), held["anomalies"], waiting, int(no) in done, held["version"],
                    hashlib.sha256(json.dumps(s, sort_keys=True).encode()).hexdigest()))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def match_states(events: DataFrame, live: bool = True) -> DataFrame:
    """Streaming events to a stream of updated innings states; a bounded replay needs no idle timeout."""
    fn, timeout = (fold_live, GroupStateTimeout.ProcessingTimeTimeout) if live else (fold_match, GroupStateTimeout.NoTimeout)
    return events.groupBy("match_id").applyInPandasWithState(fn, OUTPUT, STATE, "update", timeout)


def latest(states: DataFrame) -> DataFrame:
    w = Window.partitionBy("match_id", "innings").orderBy(F.desc("version"))
    return states.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def run_files(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_trigger: int = 1) -> None:
    """Fold a folder of event files; each micro-batch writes its updates under its own epoch, so a retried batch overwrites itself."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    query = (match_states(stream, live=False).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def replay(ws: Workspace, events: DataFrame, name: str, batches: int = 3) -> DataFrame:
    """Write events as a shuffled file feed, run the stream over it and return the last state of each innings."""
    base = f"{ws.root}/stream/{name}"
    bucket = F.pmod(F.xxhash64("event_id", "seq"), F.lit(batches))
    events.repartition(batches, bucket).write.mode("overwrite").parquet(f"{base}/in")
    run_files(ws.spark, f"{base}/in", f"{base}/out", f"{base}/cp")
    return latest(ws.spark.read.parquet(f"{base}/out"))
