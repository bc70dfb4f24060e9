"""The record book: each definition ranked for every gender and format, for all matches and for major teams."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import ranked
from inswing.operators.records import ENTITIES, METRICS, leaderboard
from inswing.plans.filters import Filters, major
from inswing.plans.workspace import Workspace, relation

TOP = 10
SCOPE = ["gender", "format_group", "major"]


@dataclass(frozen=True)
class Record:
    id: str
    category: str
    kind: str
    value: Callable[[], Column] | None = None
    order: Callable[[], list[Column]] | None = None
    where: str | None = None
    metric: str | None = None
    filters: dict = field(default_factory=dict)
    minimum: int | None = None


def _board(id: str, category: str, metric: str, filters: dict, minimum: int | None = None) -> Record:
    return Record(id, category, "board", metric=metric, filters=filters, minimum=minimum)


_FM = {"full_members": True}
RECORDS: list[Record] = [
    Record("highest-score", "Batting", "innings", lambda: F.col("runs"), lambda: [F.desc("runs"), F.asc("balls")]),
    Record("fastest-fifty", "Batting", "fifty"),
    Record("most-sixes-innings", "Batting", "innings", lambda: F.col("sixes"), lambda: [F.desc("sixes"), F.asc("balls")]),
    Record("highest-sr-innings", "Batting", "innings", lambda: 100.0 * F.col("runs") / F.col("balls"),
           lambda: [F.desc(F.col("runs") / F.col("balls"))], "balls >= 25"),
    _board("most-runs", "Batting", "runs", {}),
    Record("best-figures", "Bowling", "spell", lambda: F.col("wickets"), lambda: [F.desc("wickets"), F.asc("runs")]),
    Record("economical-spell", "Bowling", "spell", lambda: 6.0 * F.col("runs") / F.col("balls"),
           lambda: [F.asc(F.col("runs") / F.col("balls")), F.desc("wickets")],
           "balls >= case when format_group = 'T20' then 24 else 60 end"),
    Record("most-dots-spell", "Bowling", "spell", lambda: F.col("dots"), lambda: [F.desc("dots"), F.asc("runs")]),
    _board("most-wickets", "Bowling", "wickets", {}),
    Record("highest-stand", "Partnerships", "stand"),
    Record("pair-runs", "Partnerships", "pair"),
    _board("pair-dismissals", "Matchups", "pair_dismissals", {}),
    _board("pair-sr", "Matchups", "pair_strike_rate", {}),
    _board("pair-bpd", "Matchups", "pair_balls_per_dismissal", {}),
    _board("death-sr", "Phases", "strike_rate", {"phase": "death", **_FM}, 300),
    _board("death-economy", "Phases", "economy", {"phase": "death", **_FM}, 300),
    _board("pp-economy", "Phases", "economy", {"phase": "powerplay", **_FM}, 300),
    _board("pp-sr", "Phases", "strike_rate", {"phase": "powerplay", **_FM}, 300),
    _board("chase-sr", "Chasing", "strike_rate", {"chasing": True, **_FM}, 500),
    Record("biggest-chases", "Chasing", "chase"),
    Record("highest-totals", "Setting a target", "total"),
    _board("set-sr", "Setting a target", "strike_rate", {"chasing": False, **_FM}, 500),
    _board("sr-3-down", "Wickets down", "strike_rate", {"wk_from": 3, **_FM}, 300),
    _board("avg-0-2-down", "Wickets down", "average", {"wk_to": 2, **_FM}, 500),
    _board("after30-sr", "Innings progression", "strike_rate", {"faced_from": 30, **_FM}, 300),
    _board("first10-dots", "Innings progression", "dot_pct", {"faced_to": 9, **_FM}, 200),
    Record("season-runs", "Competitions", "season", metric="runs"),
    Record("season-wickets", "Competitions", "season", metric="wickets"),
    Record("biggest-wins", "Teams", "wins"),
    _board("runs-since-2020", "Eras", "runs", {"year_from": 2020}),
    _board("wickets-2010s", "Eras", "wickets", {"year_from": 2010, "year_to": 2019}),
    _board("keeper-catches", "Fielding", "keeper_catches", {}),
]
BY_ID = {r.id: r for r in RECORDS}


def _scoped(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Each row once for all matches, and again for major teams where both sides qualify."""
    return rows.withColumn("major", F.explode(F.when(major(a, b), F.array(F.lit(True), F.lit(False)))
                                              .otherwise(F.array(F.lit(False)))))


def _finish(rows: DataFrame, rec: Record, order: list[Column], value: Column, ids: list[str], node: str,
            key: list[str], date: Column, sample: Column) -> DataFrame:
    key_col = F.concat_ws("|", *key)
    rows = rows.withColumn("node_key", key_col)
    best = ranked(rows, SCOPE, [*order, F.asc("node_key")], TOP)
    people = F.array(*ids) if ids else F.array().cast("array<string>")
    return best.select(
        F.lit(rec.id).alias("def_id"), F.lit(rec.category).alias("category"), "gender", "format_group", "major", "rank",
        value.cast("double").alias("value"), sample.cast("long").alias("sample"), date.alias("date"),
        people.alias("ids"), F.lit(node).alias("node_type"), "node_key")


def record(ws: Workspace, rec: Record, minimum: int | None = None) -> DataFrame:
    """Top ten of one definition in every scope."""
    start, none = F.col("start_date"), F.lit(None)
    if rec.kind in ("innings", "spell"):
        who = "batter_id" if rec.kind == "innings" else "bowler_id"
        rows = ws["bat_innings" if rec.kind == "innings" else "bowl_innings"].filter("balls > 0")
        rows = rows.filter(rec.where) if rec.where else rows
        return _finish(_scoped(rows, "team", "opponent"), rec, rec.order(), rec.value(), [who], rec.kind,
                       ["match_id", "innings_no", who], start, F.col("balls"))
    if rec.kind == "fifty":
        rows = ws["balls"].filter("faced and batter_runs_before < 50 and batter_runs_before + runs_batter >= 50")
        rows = rows.withColumn("taken", F.col("batter_balls_before") + 1)
        return _finish(_scoped(rows, "batting_team", "bowling_team"), rec, [F.asc("taken"), F.asc("start_date")],
                       F.col("taken"), ["batter_id"], "innings", ["match_id", "innings_no", "batter_id"], start, F.col("taken"))
    if rec.kind == "stand":
        rows = _scoped(ws["partnerships"], "batting_team", "bowling_team")
        return _finish(rows, rec, [F.desc("runs"), F.asc("balls"), F.asc("partnership_id")], F.col("runs"), ["p1", "p2"],
                       "match", ["match_id"], start, F.col("balls"))
    if rec.kind == "pair":
        rows = _scoped(ws["partnerships"], "batting_team", "bowling_team").groupBy(*SCOPE, "p1", "p2").agg(
            F.sum("runs").alias("runs"), F.count("*").alias("n"), F.max("start_date").alias("start_date")).filter("n >= 5")
        return _finish(rows, rec, [F.desc("runs")], F.col("runs"), ["p1", "p2"], "partnership", ["p1", "p2"], start, F.col("n"))
    if rec.kind in ("chase", "total", "wins"):
        rows = _scoped(ws["team_results"], "team1", "team2")
        test, col = {"chase": ("winner = i2_team and i2_runs is not null", "i2_runs"),
                     "total": ("i1_runs is not null", "i1_runs"), "wins": ("win_by_runs is not null", "win_by_runs")}[rec.kind]
        return _finish(rows.filter(test), rec, [F.desc(col)], F.col(col), [], "match", ["match_id"], start, none)
    if rec.kind == "season":
        runs = rec.metric == "runs"
        who, col, table = ("batter_id", "runs", "bat_innings") if runs else ("bowler_id", "wickets", "bowl_innings")
        rows = ws[table].filter("format_group = 'T20' and team_type = 'club'").groupBy(
            "gender", "format_group", who, "competition", "season").agg(
            F.sum(col).alias("v"), F.count("*").alias("n"), F.max("start_date").alias("start_date"))
        return _finish(rows.withColumn("major", F.lit(False)), rec, [F.desc("v"), F.asc("competition"), F.asc("season")],
                       F.col("v"), [who], "player", [who], start, F.col("n"))
    m = METRICS[rec.metric]
    keys = ENTITIES[m.entity][1]
    rows = leaderboard(ws, rec.metric, Filters.parse(rec.filters), rec.minimum if minimum is None else minimum, TOP,
                       ("gender", "format_group"))
    node = "battle" if len(keys) == 2 else "player"
    return rows.select(
        F.lit(rec.id).alias("def_id"), F.lit(rec.category).alias("category"), "gender", "format_group",
        F.lit(False).alias("major"), "rank", "value", F.col("sample").cast("long").alias("sample"),
        F.col("last_date").alias("date"), F.array(*keys).alias("ids"), F.lit(node).alias("node_type"), F.col("k").alias("node_key"))


def book(ws: Workspace, records: list[Record] | None = None, minimum: int | None = None) -> DataFrame:
    out = None
    for rec in records or RECORDS:
        part = record(ws, rec, minimum if rec.kind == "board" and rec.minimum else None)
        out = part if out is None else out.unionByName(part)
    return out


@relation("record_book")
def record_book(ws: Workspace) -> DataFrame:
    return book(ws)


def held(rows: DataFrame) -> DataFrame:
    """Records a player holds: the best rank of each definition over all scopes."""
    mine = rows.select(F.explode("ids").alias("person_id"), "def_id", "gender", "format_group", "major", "rank", "value")
    w = Window.partitionBy("person_id", "def_id").orderBy("rank", "gender", "format_group", F.desc("major"), "value")
    return mine.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def containing(rows: DataFrame) -> DataFrame:
    """Records in which an innings, spell, match, battle or player appears, best rank per definition."""
    return rows.groupBy("node_type", "node_key", "def_id").agg(F.min("rank").alias("rank"))


def siblings(rows: DataFrame) -> DataFrame:
    """For each record, the other definitions of its category in the same gender and format."""
    defs = rows.groupBy("category", "def_id", "gender", "format_group").agg(F.max("major").alias("major"))
    other = defs.select("category", "gender", "format_group", F.col("def_id").alias("sibling"),
                        F.col("major").alias("sibling_major"))
    return defs.join(other, ["category", "gender", "format_group"]).filter("def_id <> sibling")


def catalogue(rows: DataFrame) -> DataFrame:
    return rows.filter("rank = 1").select("category", "def_id", "gender", "format_group", "major", "value", "node_type", "node_key")
