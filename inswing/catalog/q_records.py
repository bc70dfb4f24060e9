"""Leaderboards, filters and the record book."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from inswing.catalog.registry import QUERIES, add
from inswing.operators import recordbook as rb
from inswing.operators.records import METRICS, PRESETS, leaderboard
from inswing.plans.filters import Filters, major
from inswing.plans.workspace import relation
from inswing.schema import FULL_MEMBERS

FM = "(" + ", ".join(f"'{t}'" for t in FULL_MEMBERS) + ")"
FACED, LEGAL = "sum(faced::INT)", "sum(legal::INT)"
CONCEDED = "sum(runs_batter + wides + noballs)"
# metric: relation, key, side, value, sample, order
SQL = {
    "runs": ("balls", "batter_id", "sum(runs_batter)", FACED, "DESC"),
    "sixes": ("balls", "batter_id", "sum(is_six::INT)", FACED, "DESC"),
    "fours": ("balls", "batter_id", "sum(is_four::INT)", FACED, "DESC"),
    "strike_rate": ("balls", "batter_id", f"100e0 * sum(runs_batter) / {FACED}", FACED, "DESC"),
    "dot_pct": ("balls", "batter_id", f"100e0 * sum((faced AND runs_batter = 0)::INT) / {FACED}", FACED, "ASC"),
    "boundary_pct": ("balls", "batter_id", f"100e0 * sum(hit::INT) / {FACED}", FACED, "DESC"),
    "balls_faced": ("balls", "batter_id", FACED, FACED, "DESC"),
    "average": ("balls", "batter_id", "1e0 * sum(runs_batter) / nullif(sum(striker_dismissed::INT), 0)", FACED, "DESC"),
    "balls_per_dismissal": ("balls", "batter_id", f"1e0 * {FACED} / nullif(sum(striker_dismissed::INT), 0)", FACED, "DESC"),
    "wickets": ("balls", "bowler_id", "sum(wk)", LEGAL, "DESC"),
    "economy": ("balls", "bowler_id", f"6e0 * {CONCEDED} / {LEGAL}", LEGAL, "ASC"),
    "bowl_dot_pct": ("balls", "bowler_id", f"100e0 * sum((legal AND runs_total = 0)::INT) / {LEGAL}", LEGAL, "DESC"),
    "bowling_average": ("balls", "bowler_id", f"1e0 * {CONCEDED} / nullif(sum(wk), 0)", LEGAL, "ASC"),
    "bowling_strike_rate": ("balls", "bowler_id", f"1e0 * {LEGAL} / nullif(sum(wk), 0)", LEGAL, "ASC"),
    "sixes_conceded": ("balls", "bowler_id", "sum(is_six::INT)", LEGAL, "DESC"),
    "keeper_catches": ("dis", "fielder_id", "sum((route = 'CAUGHT_KEEPER')::INT)", "count(*)", "DESC"),
    "stumpings": ("dis", "fielder_id", "sum((kind = 'stumped')::INT)", "count(*)", "DESC"),
    "catches": ("dis", "fielder_id", "sum((kind = 'caught' AND NOT substitute)::INT)", "count(*)", "DESC"),
    "run_out_involvements": ("dis", "fielder_id", "sum((kind = 'run out')::INT)", "count(*)", "DESC"),
    "times_run_out": ("dis", "player_out_id", "sum((kind = 'run out')::INT)", "count(*)", "DESC"),
    "times_bowled": ("dis", "player_out_id", "sum((kind = 'bowled')::INT)", "count(*)", "DESC"),
    "pair_dismissals": ("balls", "batter_id || '|' || bowler_id", "sum(striker_credited::INT)", FACED, "DESC"),
    "pair_strike_rate": ("balls", "batter_id || '|' || bowler_id", f"100e0 * sum(runs_batter) / nullif({FACED}, 0)", FACED, "DESC"),
    "pair_balls_per_dismissal": ("balls", "batter_id || '|' || bowler_id", f"1e0 * {FACED} / nullif(sum(striker_credited::INT), 0)", FACED, "ASC"),
}
NUMBERS = {m: f"L{i:02d}" for i, m in enumerate(METRICS, 1)}
BOARD = "gender k rank:i value:f sample:i matches:i first_date:d last_date:d"


def board_sql(metric: str, where: str = "TRUE", least: int = 0, limit: int = 25, by: str = "gender") -> str:
    table, key, value, sample, order = SQL[metric]
    return f"""SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value {order}, sample DESC, k) AS rank FROM (
        SELECT {by}, {key} AS k, {value} AS value, {sample} AS sample, count(DISTINCT match_id) AS matches,
          min(start_date) AS first_date, max(start_date) AS last_date
        FROM {table} WHERE {where} AND {key} IS NOT NULL GROUP BY ALL)
      WHERE sample >= {least} AND value > 0) WHERE rank <= {limit}"""


# the fixture holds shorter careers than the real data, so a few minimums are lowered for it
FIXTURE_MIN = {"pair_strike_rate": 24, "pair_balls_per_dismissal": 24}
for _m, _no in NUMBERS.items():
    _least = FIXTURE_MIN.get(_m, METRICS[_m].minimum)
    add(f"{_no}_{_m}", BOARD, board_sql(_m, least=_least),
        lambda ws, m=_m, n=_least: leaderboard(ws, m, min_sample=n))

BOTH_MAJOR = f"(team_type = 'club' OR (batting_team IN {FM} AND bowling_team IN {FM}))"
PRESET_SQL = {
    "death-sixes": ("phase = 'death'", 0), "dot-after30": ("batter_balls_before >= 30", 20), "one-bowler": ("TRUE", 0),
    "chase-sr": (f"chasing AND format_group = 'T20' AND {BOTH_MAJOR}", 50), "run-outs": ("TRUE", 0),
    "keeper-catches": ("TRUE", 0), "best-matchup": ("TRUE", 24),
    "death-economy": (f"phase = 'death' AND format_group = 'T20' AND {BOTH_MAJOR}", 30),
}
for _id, (_m, _f, _) in PRESETS.items():
    _where, _least = PRESET_SQL[_id]
    add(f"L25_preset_{_id.replace('-', '_')}", BOARD, board_sql(_m, _where, _least),
        lambda ws, m=_m, f=_f, n=_least: leaderboard(ws, m, Filters.parse(f), n))

# ---- filter keys: the number of balls and the runs each leaves, per gender and format
FILTERS = {
    "F01_format": ({"format": "ODI"}, "format_group = 'ODI'"),
    "F02_team_type": ({"team_type": "club"}, "team_type = 'club'"),
    "F03_competition": ({"competition": "League A"}, "competition = 'League A'"),
    "F04_gender": ({"gender": "female"}, "gender = 'female'"),
    "F05_years": ({"year_from": 2016, "year_to": "2021"}, "year BETWEEN 2016 AND 2021"),
    "F06_before_date": ({"before_date": "2018-07-01"}, "start_date < DATE '2018-07-01'"),
    "F07_full_members": ({"full_members": True}, BOTH_MAJOR),
    "F08_opposition": ({"opposition": "Punjab Kings"}, "bowling_team IN ('Punjab Kings', 'Kings XI Punjab')"),
    "F08_team": ({"team": "Royal Challengers Bengaluru"}, "batting_team IN ('Royal Challengers Bengaluru', 'Royal Challengers Bangalore')"),
    "F09_phase": ({"phase": "death"}, "phase = 'death'"),
    "F09_bowler_family": ({"bowler_family": "spin"}, "bowler_family = 'spin'"),
    "F09_bowler_arm": ({"bowler_arm": "left"}, "bowler_arm = 'left'"),
    "F09_bowler_style": ({"bowler_style": "Leg-spin"}, "bowler_style = 'Leg-spin'"),
    "F09_bowler_id": ({"bowler_id": "m1p7"}, "bowler_id = 'm1p7'"),
    "F09_batter_id": ({"batter_id": "m1p1"}, "batter_id = 'm1p1'"),
    "F09_non_striker_id": ({"non_striker_id": "m1p2"}, "non_striker_id = 'm1p2'"),
    "F09_chase_state": ({"chase_state": "behind"}, "chase_state = 'behind'"),
    "F09_batter_stage": ({"batter_stage": "set"}, "batter_stage = 'set'"),
    "F10_chasing": ({"chasing": False}, "NOT chasing"),
    "F11_overs": ({"over_from": 3, "over_to": 8}, "over BETWEEN 2 AND 7"),
    "F12_state": ({"wk_from": 1, "wk_to": 5, "faced_from": 2, "faced_to": 25, "rrr_from": 6, "innings_no": 2},
                  "wickets_before BETWEEN 1 AND 5 AND batter_balls_before BETWEEN 2 AND 25 AND required_rate >= 6 AND innings_no = 2"),
}


def _left(df):
    return df.groupBy("gender", "format_group").agg(F.count("*").alias("n"), F.sum("runs_total").alias("runs"))


for _name, (_f, _where) in FILTERS.items():
    add(_name, "gender format_group n:i runs:i",
        f"SELECT gender, format_group, count(*) AS n, sum(runs_total) AS runs FROM balls WHERE {_where} GROUP BY ALL",
        lambda ws, f=_f: _left(Filters.parse(f).apply(ws["balls"])))
add("F14_library_scope", "gender format_group n:i runs:i",
    f"""SELECT gender, format_group, count(*) AS n, sum(runs) AS runs FROM bat_innings
        WHERE (team_type = 'club' OR (team IN {FM} AND opponent IN {FM})) AND team = 'India' GROUP BY ALL""",
    lambda ws: Filters(full_members=True, team="India").apply(ws["bat_innings"], "library", False)
    .groupBy("gender", "format_group").agg(F.count("*").alias("n"), F.sum("runs").alias("runs")))
add("F15_major_scope", "gender format_group n:i",
    f"SELECT gender, format_group, count(*) AS n FROM team_results WHERE team_type = 'club' OR (team1 IN {FM} AND team2 IN {FM}) GROUP BY ALL",
    lambda ws: ws["team_results"].filter(major("team1", "team2")).groupBy("gender", "format_group").agg(F.count("*").alias("n")))

# ---- record book
ROWS = "def_id gender format_group major:b rank:i value:f sample:i date:d id1 id2 node_type node_key"


def _flat(df):
    return df.withColumn("id1", F.get("ids", F.lit(0))).withColumn("id2", F.get("ids", F.lit(1)))


def _pick(ws, kinds, minimum=None):
    return _flat(rb.book(ws, [r for r in rb.RECORDS if r.kind in kinds], minimum))


def rec_sql(def_id, table, where, value, order, id1, id2, node, key, sample, date="start_date", teams=("team", "opponent")):
    parts = []
    for flag, scope in (("FALSE", "TRUE"), ("TRUE", f"(team_type = 'club' OR ({teams[0]} IN {FM} AND {teams[1]} IN {FM}))" if teams else None)):
        if scope is None:
            continue
        parts.append(f"""SELECT * FROM (SELECT '{def_id}' AS def_id, gender, format_group, {flag} AS major, {value} AS value, {sample} AS sample,
          {date} AS date, {id1} AS id1, {id2} AS id2, '{node}' AS node_type, {key} AS node_key,
          row_number() OVER (PARTITION BY gender, format_group ORDER BY {order}, {key}) AS rank
          FROM {table.replace('SCOPE', scope)} WHERE {where} {'' if 'SCOPE' in table else 'AND ' + scope}) WHERE rank <= 10""")
    return "\nUNION ALL ".join(parts)


INN_KEY = "match_id || '|' || innings_no || '|' || batter_id"
SP_KEY = "match_id || '|' || innings_no || '|' || bowler_id"
TEAMS2, BAT2 = ("team1", "team2"), ("batting_team", "bowling_team")
R01 = "\nUNION ALL ".join([
    rec_sql("highest-score", "bat_innings", "balls > 0", "runs", "runs DESC, balls", "batter_id", "NULL", "innings", INN_KEY, "balls"),
    rec_sql("most-sixes-innings", "bat_innings", "balls > 0", "sixes", "sixes DESC, balls", "batter_id", "NULL", "innings", INN_KEY, "balls"),
    rec_sql("highest-sr-innings", "bat_innings", "balls >= 25", "100e0 * runs / balls", "1e0 * runs / balls DESC", "batter_id", "NULL", "innings", INN_KEY, "balls")])
add("R01_innings_records", ROWS, R01, lambda ws: _pick(ws, {"innings"}))
add("R02_fastest_fifty", ROWS, rec_sql("fastest-fifty", "balls", "faced AND batter_runs_before < 50 AND batter_runs_before + runs_batter >= 50",
    "batter_balls_before + 1", "batter_balls_before, start_date", "batter_id", "NULL", "innings", INN_KEY, "batter_balls_before + 1", teams=BAT2),
    lambda ws: _pick(ws, {"fifty"}))
add("R03_spell_records", ROWS, "\nUNION ALL ".join([
    rec_sql("best-figures", "bowl_innings", "balls > 0", "wickets", "wickets DESC, runs", "bowler_id", "NULL", "spell", SP_KEY, "balls"),
    rec_sql("economical-spell", "bowl_innings", "balls >= CASE WHEN format_group = 'T20' THEN 24 ELSE 60 END", "6e0 * runs / balls",
            "1e0 * runs / balls, wickets DESC", "bowler_id", "NULL", "spell", SP_KEY, "balls"),
    rec_sql("most-dots-spell", "bowl_innings", "balls > 0", "dots", "dots DESC, runs", "bowler_id", "NULL", "spell", SP_KEY, "balls")]),
    lambda ws: _pick(ws, {"spell"}))
add("R04_highest_stand", ROWS, rec_sql("highest-stand", "partnerships", "TRUE", "runs", "runs DESC, balls, partnership_id", "p1", "p2", "match",
    "match_id", "balls", teams=BAT2), lambda ws: _pick(ws, {"stand"}))
add("R05_pair_runs", ROWS, rec_sql("pair-runs", """(SELECT gender, format_group, p1, p2, sum(runs) AS runs, count(*) AS n, max(start_date) AS start_date
    FROM partnerships WHERE SCOPE GROUP BY ALL)""", "n >= 5", "runs", "runs DESC", "p1", "p2", "partnership", "p1 || '|' || p2", "n", teams=BAT2),
    lambda ws: _pick(ws, {"pair"}))
add("R06_biggest_chases", ROWS, rec_sql("biggest-chases", "team_results", "winner = i2_team", "i2_runs", "i2_runs DESC", "NULL", "NULL", "match", "match_id",
    "NULL", teams=TEAMS2), lambda ws: _pick(ws, {"chase"}))
add("R07_highest_totals", ROWS, rec_sql("highest-totals", "team_results", "TRUE", "i1_runs", "i1_runs DESC", "NULL", "NULL", "match", "match_id", "NULL",
    teams=TEAMS2), lambda ws: _pick(ws, {"total"}))
add("R08_biggest_wins", ROWS, rec_sql("biggest-wins", "team_results", "win_by_runs IS NOT NULL", "win_by_runs", "win_by_runs DESC", "NULL", "NULL", "match",
    "match_id", "NULL", teams=TEAMS2), lambda ws: _pick(ws, {"wins"}))


def _season(def_id, table, who, col):
    return rec_sql(def_id, f"""(SELECT gender, format_group, {who}, competition, season, sum({col}) AS v, count(*) AS n, max(start_date) AS start_date FROM {table}
      WHERE format_group = 'T20' AND team_type = 'club' GROUP BY ALL)""", "TRUE", "v", "v DESC, competition, season", who, "NULL", "player", who, "n", teams=None)


add("R09_season_records", ROWS, _season("season-runs", "bat_innings", "batter_id", "runs") + "\nUNION ALL " +
    _season("season-wickets", "bowl_innings", "bowler_id", "wickets"), lambda ws: _pick(ws, {"season"}))

BOARD_WHERE = {
    "death-sr": f"phase = 'death' AND {BOTH_MAJOR}", "death-economy": f"phase = 'death' AND {BOTH_MAJOR}",
    "pp-economy": f"phase = 'powerplay' AND {BOTH_MAJOR}", "pp-sr": f"phase = 'powerplay' AND {BOTH_MAJOR}",
    "chase-sr": f"chasing AND {BOTH_MAJOR}", "set-sr": f"NOT chasing AND {BOTH_MAJOR}", "sr-3-down": f"wickets_before >= 3 AND {BOTH_MAJOR}",
    "avg-0-2-down": f"wickets_before <= 2 AND {BOTH_MAJOR}", "after30-sr": f"batter_balls_before >= 30 AND {BOTH_MAJOR}",
    "first10-dots": f"batter_balls_before <= 9 AND {BOTH_MAJOR}", "runs-since-2020": "year >= 2020", "wickets-2010s": "year BETWEEN 2010 AND 2019",
}
BOARD_LEAST = 40


def board_rec_sql(r) -> str:
    least = BOARD_LEAST if r.minimum else METRICS[r.metric].minimum
    node = "battle" if METRICS[r.metric].entity == "pair" else "player"
    return f"""SELECT '{r.id}' AS def_id, gender, format_group, FALSE AS major, rank, value, sample, last_date AS date, split_part(k, '|', 1) AS id1,
      nullif(split_part(k, '|', 2), '') AS id2, '{node}' AS node_type, k AS node_key
      FROM ({board_sql(r.metric, BOARD_WHERE.get(r.id, 'TRUE'), least, 10, 'gender, format_group')})"""


BOARDS = [r for r in rb.RECORDS if r.kind == "board"]
add("R10_board_records", ROWS, "\nUNION ALL ".join(board_rec_sql(r) for r in BOARDS), lambda ws: _pick(ws, {"board"}, BOARD_LEAST))
SMALL = {"innings", "spell", "stand", "pair", "total"}
SMALL_SQL = "\nUNION ALL ".join([R01, rec_sql("highest-stand", "partnerships", "TRUE", "runs", "runs DESC, balls, partnership_id", "p1", "p2", "match",
                                              "match_id", "balls", teams=BAT2)])


def _small(ws):
    return rb.book(ws, [r for r in rb.RECORDS if r.kind in ("innings", "stand")])


@relation("registered_records")
def registered_records(ws):
    """The whole record book, with the boards' minimums of R10_board_records."""
    return rb.book(ws, minimum=BOARD_LEAST)


CATEGORY_SQL = f"SELECT *, CASE WHEN def_id = 'highest-stand' THEN 'Partnerships' ELSE 'Batting' END AS category FROM ({SMALL_SQL})"
# all definitions: what R01 to R10 check one kind at a time
BOOK_SQL = "\nUNION ALL BY NAME ".join(f"SELECT * FROM ({q.sql})" for n, q in QUERIES.items() if re.match(r"R(0\d|10)_", n))
BOOK_CATEGORY_SQL = f"SELECT * FROM ({BOOK_SQL}) JOIN (VALUES {', '.join(f"('{r.id}', '{r.category}')" for r in rb.RECORDS)}) c(def_id, category) USING (def_id)"
add("R11_held_by_player", "person_id def_id gender format_group major:b rank:i value:f",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, def_id ORDER BY rank, gender, format_group, major DESC, value) AS n
        FROM (SELECT *, unnest([id1, id2]) AS person_id FROM ({SMALL_SQL})) WHERE person_id IS NOT NULL) WHERE n = 1""",
    lambda ws: rb.held(_small(ws)))
add("R11_containing", "node_type node_key def_id rank:i", f"SELECT node_type, node_key, def_id, min(rank) AS rank FROM ({BOOK_SQL}) GROUP BY ALL",
    lambda ws: rb.containing(ws["registered_records"]))
add("R11_siblings", "category def_id sibling gender format_group",
    f"""WITH d AS (SELECT DISTINCT category, def_id, gender, format_group FROM ({BOOK_CATEGORY_SQL}))
        SELECT a.category, a.def_id, b.def_id AS sibling, a.gender, a.format_group FROM d a JOIN d b USING (category, gender, format_group) WHERE a.def_id <> b.def_id""",
    lambda ws: rb.siblings(ws["registered_records"]))
add("R12_catalogue", "category def_id gender format_group major:b value:f node_key", f"SELECT * FROM ({CATEGORY_SQL}) WHERE rank = 1",
    lambda ws: rb.catalogue(_small(ws)))
