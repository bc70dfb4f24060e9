"""Typed match state: a fold whose state is as large as the people of one innings, not as the balls bowled.

Balls are applied in the order of their number. One that comes ahead of its turn waits until the gap is filled; one that comes again, or late behind its copy, is passed over. People, spells, the open over and the open stand are kept by key; an over,
stand or spell is emitted when the next one begins, an innings when its end has come and all its balls are in, and then its
people are forgotten. Feeds that correct balls go through `fold`, which keeps the log that corrections need.

A target may be revised with effect from a place in the innings that lies before or behind what has been bowled. Revisions are
ordered by place, never by arrival: the one furthest on is in force at the end, and `targets` says which was in force at a ball.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inswing.plans.workspace import Workspace, relation

RECENT = 12
SPELL_GAP = 2  # overs between two of one spell, counted from the earlier one
STAYS = ("retired hurt", "retired not out", "retired out")
NOT_BOWLERS = ("run out", "retired hurt", "retired not out", "retired out", "obstructing the field", "timed out")  # fixed values

FEED = ("match_id string, kind string, innings int, seq int, over int, batter_id string, non_striker_id string, bowler_id string, runs_batter int, "
        "wides int, noballs int, byes int, legbyes int, penalty int, boundary int, wicket_kind string, player_out_id string, target_runs int, limit_balls int")
OUTPUT = ("match_id string, innings int, part string, no int, id string, other string, runs int, balls int, wickets int, dots int, fours int, sixes int, "
          "extras int, target int, limit_balls int, note string, version long")
_OUT = [c.split()[0] for c in OUTPUT.split(", ")]
_INT = [c.split()[0] for c in OUTPUT.split(", ") if c.endswith((" int", " long"))]

INNINGS = ["innings", "seq", "runs", "wickets", "legal", "extras", "fours", "sixes", "dots", "target", "limit_balls", "closed", "last_seq", "started", "version", "over", "over_runs", "over_wickets", "over_legal",
           "stands", "stand_runs", "stand_balls", "stand_a", "stand_b"]
_TEXT = ("stand_a", "stand_b")
INNINGS_TYPE = T.StructType([T.StructField(n, T.StringType() if n in _TEXT else T.LongType()) for n in INNINGS])
ROWS = ("batters", "bowlers", "recent", "waiting", "revised")  # lists of a match, each one value: every row of a map or list state is a call to Spark
BATTER = ["runs", "balls", "dots", "fours", "sixes"]
BOWLER = ["balls", "runs", "wickets", "dots", "fours", "sixes", "spells", "last_over", "spell_overs", "spell_balls", "spell_runs", "spell_wickets", "spell_dots"]
ROWS_TYPE = T.StructType([T.StructField("rows", T.StringType())])
FEED_COLUMNS = [c.split()[0] for c in FEED.split(", ")]
KIND, INN_NO, SEQ = (FEED_COLUMNS.index(c) for c in ("kind", "innings", "seq"))
ORDER = {"innings_start": 0, "delivery": 1, "innings_end": 2}


@relation("ball_feed")
def ball_feed(ws: Workspace) -> DataFrame:
    """Balls, starts and ends of innings as a scorer sends them; the end of an innings names its last ball."""
    outs = ws["wickets"].filter("wicket_idx = 0").select("match_id", "delivery_id", F.col("kind").alias("wicket_kind"), "player_out_id")
    d = ws["deliveries"].join(outs, ["match_id", "delivery_id"], "left").select(
        "match_id", F.lit("delivery").alias("kind"), F.col("innings_no").alias("innings"), "seq", "over", "batter_id", "non_striker_id", "bowler_id", "runs_batter",
        "wides", "noballs", "byes", "legbyes", "penalty", F.when(F.col("is_four"), 4).when(F.col("is_six"), 6).alias("boundary"), "wicket_kind", "player_out_id")
    limit = F.col("scheduled_overs") * F.col("balls_per_over")
    start = ws["innings"].join(ws["matches"].select("match_id", limit.alias("limit_balls")), "match_id").select(
        "match_id", F.lit("innings_start").alias("kind"), F.col("innings_no").alias("innings"), "target_runs", "limit_balls")
    end = ws["deliveries"].groupBy("match_id", F.col("innings_no").alias("innings")).agg(F.max("seq").alias("seq")).withColumn("kind", F.lit("innings_end"))
    return d.unionByName(start, allowMissingColumns=True).unionByName(end, allowMissingColumns=True).select(*[c.split()[0] for c in FEED.split(", ")])


def revisions(feed: DataFrame) -> DataFrame:
    """Revisions as rain might bring them, derived from the feed: in every third chase the target falls and the balls with it
    after ball 24, and in every sixth again after ball 48."""
    h = F.conv(F.substring(F.md5("match_id"), 1, 2), 16, 10).cast("int") % 6
    chase = feed.filter("kind = 'innings_start' and target_runs is not null")
    first = chase.filter(h % 3 == 0).withColumns({"seq": F.lit(24), "target_runs": F.col("target_runs") - 10, "limit_balls": F.col("limit_balls") - 12})
    second = chase.filter(h == 0).withColumns({"seq": F.lit(48), "target_runs": F.col("target_runs") - 25, "limit_balls": F.col("limit_balls") - 30})
    return first.unionByName(second).withColumn("kind", F.lit("target_revision"))


def targets(feed: DataFrame) -> DataFrame:
    """(match_id, innings, seq, target, limit_balls, required): for each ball of a chase what was in force before it.

    A revision with place p holds from ball p + 1; one running window over the innings, no range join."""
    w = Window.partitionBy("match_id", "innings").orderBy("at", "rank")
    at = F.coalesce("seq", F.lit(0))
    rank = F.when(F.col("kind") == "delivery", 0).otherwise(1)
    total = sum(F.coalesce(F.col(c), F.lit(0)) for c in ("runs_batter", "wides", "noballs", "byes", "legbyes", "penalty"))
    ball = F.col("kind") == "delivery"
    legal = (ball & (F.col("wides") == 0) & (F.col("noballs") == 0)).cast("int")
    rows = feed.filter(~F.col("kind").isin("innings_end")).select("match_id", "innings", "seq", "kind", at.alias("at"), rank.alias("rank"), "target_runs", "limit_balls",
                                                                  F.when(ball, total).otherwise(0).alias("total"), legal.alias("legal"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        "match_id", "innings", "seq", "kind", F.last("target_runs", True).over(before).alias("target"), F.last("limit_balls", True).over(before).alias("limit_balls"),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("score"), F.coalesce(F.sum("legal").over(before), F.lit(0)).alias("legal"))
    left = F.col("limit_balls") - F.col("legal")
    return out.filter("kind = 'delivery' and target is not null").select(
        "match_id", "innings", "seq", "target", "limit_balls", F.when(left > 0, 6.0 * (F.col("target") - F.col("score")) / left).alias("required"))


class Scorer(StatefulProcessor):
    """The fold of one match. State is read once and written once for each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.innings = handle.getValueState("innings", INNINGS_TYPE)
        self.rows = {name: handle.getValueState(name, ROWS_TYPE) for name in ROWS}

    def _load(self) -> None:
        held = self.innings.get()
        self.s = dict(zip(INNINGS, held)) if held else {n: None if n in _TEXT or n in ("target", "limit_balls", "last_seq", "over") else 0 for n in INNINGS}
        if not held:
            self.s["innings"] = 1
        values = {name: state.get() for name, state in self.rows.items()} if held else {}
        self.held = {name: v[0] if v else "[]" for name, v in values.items()}
        rows = {name: json.loads(self.held.get(name, "[]")) for name in ROWS}
        self.bat = {who: dict(zip(BATTER, v)) for who, v in rows["batters"]}
        self.bowl = {who: dict(zip(BOWLER, v)) for who, v in rows["bowlers"]}
        self.last = rows["recent"]
        self.later, self.targets = [tuple(r) for r in rows["waiting"]], [tuple(r) for r in rows["revised"]]

    def _store(self) -> None:
        self.innings.update(tuple(self.s[n] for n in INNINGS))
        people = [[[k, [v[n] for n in names]] for k, v in held.items()] for held, names in ((self.bat, BATTER), (self.bowl, BOWLER))]
        for name, rows in zip(ROWS, (*people, self.last, self.later, self.targets)):
            was, now = self.held.get(name, "[]"), json.dumps(rows, separators=(",", ":"))
            if rows and now != was:
                self.rows[name].update((now,))
            elif now != was:
                self.rows[name].clear()

    def _emit(self, part: str, **values) -> None:
        self.out.append({"match_id": self.key, "innings": self.s["innings"], "part": part, "version": self.s["version"], **values})

    def _end_over(self) -> None:
        s = self.s
        if s["over"] is not None:
            self._emit("over", no=s["over"], runs=s["over_runs"], wickets=s["over_wickets"], balls=s["over_legal"])

    def _end_stand(self) -> None:
        s = self.s
        if s["stand_a"] is not None:
            self._emit("stand", no=s["stands"], id=s["stand_a"], other=s["stand_b"], runs=s["stand_runs"], balls=s["stand_balls"])

    def _end_spell(self, who: str) -> None:
        b = self.bowl[who]
        if b["spells"]:
            self._emit("spell", no=b["spells"], id=who, balls=b["spell_balls"], runs=b["spell_runs"], wickets=b["spell_wickets"], dots=b["spell_dots"], extras=b["spell_overs"])

    def _ball(self, r: dict) -> None:
        s, n = self.s, lambda c: int(r[c] or 0)
        conceded = n("runs_batter") + n("wides") + n("noballs")
        extras = n("wides") + n("noballs") + n("byes") + n("legbyes") + n("penalty")
        total, legal, faced = n("runs_batter") + extras, not (n("wides") or n("noballs")), not n("wides")
        four, six, kind = r["boundary"] == 4, r["boundary"] == 6, r["wicket_kind"]
        out = kind is not None and kind not in STAYS
        credited = kind is not None and kind not in NOT_BOWLERS
        if s["over"] != r["over"]:
            self._end_over()
            s |= {"over": int(r["over"]), "over_runs": 0, "over_wickets": 0, "over_legal": 0}
        a, b = sorted((r["batter_id"], r["non_striker_id"]))
        if (s["stand_a"], s["stand_b"]) != (a, b):
            self._end_stand()
            s |= {"stand_a": a, "stand_b": b, "stand_runs": 0, "stand_balls": 0, "stands": s["stands"] + 1}
        bat = self.bat.setdefault(r["batter_id"], dict.fromkeys(BATTER, 0))
        self.bat.setdefault(r["non_striker_id"], dict.fromkeys(BATTER, 0))
        bowl = self.bowl.setdefault(r["bowler_id"], dict.fromkeys(BOWLER, 0) | {"last_over": -1000})
        if bowl["last_over"] != s["over"]:
            if s["over"] - bowl["last_over"] > SPELL_GAP:
                self._end_spell(r["bowler_id"])
                bowl |= {"spells": bowl["spells"] + 1, "spell_overs": 0, "spell_balls": 0, "spell_runs": 0, "spell_wickets": 0, "spell_dots": 0}
            bowl |= {"last_over": s["over"], "spell_overs": bowl["spell_overs"] + 1}
        for c, v in (("runs", total), ("legal", legal), ("extras", extras), ("fours", four), ("sixes", six), ("wickets", out), ("over_runs", total),
                     ("over_legal", legal), ("over_wickets", out), ("stand_runs", total), ("stand_balls", legal), ("dots", legal and total == 0)):
            s[c] += int(v)
        for c, v in (("runs", n("runs_batter")), ("balls", faced), ("dots", faced and n("runs_batter") == 0), ("fours", four), ("sixes", six)):
            bat[c] += int(v)
        for c, v in (("balls", legal), ("runs", conceded), ("wickets", credited), ("dots", legal and conceded == 0), ("fours", four), ("sixes", six),
                     ("spell_balls", legal), ("spell_runs", conceded), ("spell_wickets", credited), ("spell_dots", legal and conceded == 0)):
            bowl[c] += int(v)
        self.last = (self.last + ["W" if out else str(total)])[-RECENT:]
        s["seq"] = int(r["seq"])

    def _in_force(self) -> None:
        """The revision furthest on that the innings has reached."""
        s = self.s
        for _, seq, target, limit in sorted(t for t in self.targets if t[0] == s["innings"] and t[1] <= s["seq"]):
            s |= {"target": target, "limit_balls": limit}

    def _report(self) -> None:
        s = self.s
        self._in_force()
        reason = None
        if s["closed"]:
            reached = s["target"] is not None and s["runs"] >= s["target"]
            reason = ("target reached" if reached else "all out" if s["wickets"] >= 10 else
                      "overs complete" if s["limit_balls"] is not None and s["legal"] >= s["limit_balls"] else "closed")
        self._emit("innings", no=s["innings"], runs=s["runs"], balls=s["legal"], wickets=s["wickets"], dots=s["dots"], fours=s["fours"], sixes=s["sixes"], extras=s["extras"],
                   target=s["target"], limit_balls=s["limit_balls"], note=reason, id=" ".join(self.last))
        for who, v in self.bat.items():
            self._emit("batter", id=who, **v)
        for who, v in self.bowl.items():
            self._emit("bowler", id=who, no=v["spells"], **{c: v[c] for c in ("balls", "runs", "wickets", "dots", "fours", "sixes")})

    def _close(self) -> None:
        """The innings is over: what is open ends, and the people of the next one start afresh."""
        s = self.s
        self._end_over()
        self._end_stand()
        for who in self.bowl:
            self._end_spell(who)
        s["closed"] = 1
        self._report()
        keep = {"innings": s["innings"] + 1, "version": s["version"]}
        self.targets = [t for t in self.targets if t[0] > s["innings"]]
        self.s = {n: None if n in _TEXT or n in ("target", "limit_balls", "last_seq", "over") else 0 for n in INNINGS} | keep
        self.bat, self.bowl, self.last = {}, {}, []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        self.key, self.out = key[0], []
        self.s["version"] += 1
        names = FEED_COLUMNS
        arrived = [tuple(None if x is None or x != x else (int(x) if isinstance(x, float) else x) for x in r) for f in rows for r in f[names].itertuples(index=False)]
        for r in arrived:
            if r[KIND] == "target_revision":
                t = tuple(int(r[names.index(c)]) for c in ("innings", "seq", "target_runs", "limit_balls"))
                if t[0] >= self.s["innings"] and t not in self.targets:
                    self.targets.append(t)
        due = [r for r in self.later + arrived if r[KIND] != "target_revision" and r[INN_NO] >= self.s["innings"]]
        due.sort(key=lambda r: (r[INN_NO], ORDER[r[KIND]], r[SEQ] or 0))
        later = {}  # a row that came twice waits once
        for r in due:
            v, s = dict(zip(names, r)), self.s
            if v["innings"] < s["innings"]:
                continue
            turn = v["innings"] == s["innings"] and (s["started"] or v["kind"] == "innings_start")
            if v["kind"] == "innings_start" and turn:
                if not s["started"]:
                    s |= {"started": 1, "target": v["target_runs"], "limit_balls": v["limit_balls"]}
            elif v["kind"] == "delivery" and turn and v["seq"] <= s["seq"]:
                continue  # a copy
            elif v["kind"] == "delivery" and turn and v["seq"] == s["seq"] + 1:
                self._ball(v)
            elif v["kind"] == "innings_end" and turn and v["seq"] == s["seq"]:
                self._close()
            else:
                later[r] = None
        self.later = list(later)
        if self.s["started"]:
            self._report()
        self._store()
        if self.out:
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in self.out], dtype="Int64" if c in _INT else object) for c in _OUT})

    def close(self) -> None:
        pass


def feed_type() -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(c.split()[0], kinds[c.split()[1]]) for c in FEED.split(", ")])


def scored(feed: DataFrame) -> DataFrame:
    """A stream of feed rows to a stream of innings, people, and finished overs, stands and spells."""
    return feed.groupBy("match_id").transformWithStateInPandas(statefulProcessor=Scorer(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def replayed(ws: Workspace, feed: DataFrame, name: str, files: int = 3) -> DataFrame:
    """Write a feed as files in a shuffled order, some rows twice, run the stream over it, and keep the last version of each row."""
    base = f"{ws.root}/stream/{name}"
    twice = feed.unionByName(feed.filter("seq % 17 = 3"))
    bucket = F.pmod(F.xxhash64("match_id", "kind", "innings", "seq"), F.lit(files))
    twice.repartition(files, bucket).write.mode("overwrite").parquet(f"{base}/in")
    spark = ws.spark
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

        scored(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    w = Window.partitionBy("match_id", "innings", "part", "no_", "id_", "other").orderBy(F.desc("version"))
    rows = spark.read.parquet(f"{base}/out").withColumns({
        # people have one row however their other columns move on; an innings is told by its number
        "id_": F.when(F.col("part") == "innings", F.lit("")).otherwise(F.coalesce("id", F.lit(""))), "no_": F.when(F.col("part").isin("batter", "bowler"), F.lit(0)).otherwise(F.col("no"))})
    return rows.withColumn("latest", F.row_number().over(w)).filter("latest = 1").drop("latest", "no_", "id_", "epoch")


@relation("typed_state")
def typed_state(ws: Workspace) -> DataFrame:
    """The last state of each match after the feed, with revisions, came in disorder."""
    feed = ws["ball_feed"]
    return replayed(ws, feed.unionByName(revisions(feed)), "typed")
