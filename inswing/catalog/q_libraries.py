"""Libraries, partnerships, competitions, teams and matches with their SQL."""
from __future__ import annotations

from inswing.catalog import sqlstats as S
from inswing.catalog.q_records import FM
from inswing.catalog.registry import add
from inswing.operators import libraries as L

_MAJ = f"(team_type = 'club' OR (team IN {FM} AND opponent IN {FM}))"


def _top(src, by, order, k, where="TRUE"):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {src} WHERE {where}) WHERE rank <= {k}"


_INN_ORDER = {"highest": "runs DESC, balls", "fastest": "1e0 * runs / balls DESC", "boundary_heavy": "1e0 * (fours + sixes) / balls DESC", "low_dot": "1e0 * dots / balls", "difficult_chase": "runs DESC",
              "late_acceleration": "100e0 * r10 / 10 - 100e0 * (runs - r10) / (balls - 10) DESC", "death_hitting": "death_runs DESC, death_balls", "longest": "balls DESC"}
for _i, _cat in enumerate(L.INNINGS, 1):
    add(f"B{_i:02d}_innings_{_cat}", "gender format_group rank:i match_id innings_no:i batter_id runs:i balls:i",
        _top("bat_innings", "gender, format_group", f"{_INN_ORDER[_cat]}, match_id, innings_no, batter_id", 25, f"balls > 0 AND {_MAJ} AND {L.INNINGS[_cat][0]}"), lambda ws, k=_cat: L.innings_library(ws, k))
_SP_ORDER = {"best_figures": "wickets DESC, runs", "economical": "1e0 * runs / balls, wickets DESC", "most_dots": "dots DESC, runs", "death_spells": "death_wkts DESC, 1e0 * death_runs / death_balls",
             "wicket_bursts": "best_burst12 DESC, wickets DESC, runs", "vs_set": "set_wkts DESC, 1e0 * set_runs / set_balls", "defending": "wickets DESC, 1e0 * runs / balls"}
for _i, _cat in enumerate(L.SPELLS, 9):
    add(f"B{_i:02d}_spell_{_cat}", "gender format_group rank:i match_id innings_no:i bowler_id wickets:i runs:i balls:i",
        _top("bowl_innings", "gender, format_group", f"{_SP_ORDER[_cat]}, match_id, innings_no, bowler_id", 25, f"balls > 0 AND {_MAJ} AND {L.SPELLS[_cat][0]}"), lambda ws, k=_cat: L.spell_library(ws, k))
_BT_ORDER = {"most_balls": "balls DESC", "most_runs": "runs DESC", "most_dismissals": "outs DESC, balls", "lowest_sr": "1e0 * runs / balls", "highest_sr": "1e0 * runs / balls DESC", "one_sided": "round(p, 12)",
             "longest_running": "last_date - first_date DESC", "recent": "balls DESC"}
_BT = f"(SELECT *, balls * batter_out_rate AS expected, {S.poisson_tail('outs', 'balls * batter_out_rate')} AS p, (SELECT max(year) FROM team_results) AS latest FROM battles)"
for _i, _cat in enumerate(L.BATTLES, 16):
    add(f"B{_i}_battle_{_cat}", "gender rank:i batter_id bowler_id balls:i runs:i outs:i", _top(_BT, "gender", f"{_BT_ORDER[_cat]}, batter_id, bowler_id", 25, L.BATTLES[_cat][0].format(big=36, mid=24, small=24)),
        lambda ws, k=_cat: L.battle_universe(ws, k, big=36, mid=24, small=24))
_PAIR = """(SELECT *, 6e0 * runs / balls AS run_rate, 1e0 * runs / nullif(wickets, 0) AS average, 100e0 * boundaries / balls AS boundary_pct, 100e0 * rotations / balls AS rotation_pct, 100e0 * p1_runs / nullif(p1_runs + p2_runs, 0) AS p1_share FROM (
  SELECT gender, p1, p2, count(*) AS innings, sum(runs) AS runs, sum(balls) AS balls, sum(boundaries) AS boundaries, sum(rotations) AS rotations, sum(p1_runs) AS p1_runs, sum(p2_runs) AS p2_runs, sum((ended = 'wicket')::INT) AS wickets
  FROM partnerships GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND sum(balls) >= 40))"""
for _s in ("runs", "run_rate", "average", "innings"):
    add(f"B26_best_pairs_{_s}", "gender rank:i p1 p2 innings:i runs:i balls:i run_rate:f average:f boundary_pct:f rotation_pct:f p1_share:f", _top(_PAIR, "gender", f"{_s} DESC NULLS LAST, runs DESC, p1, p2", 20),
        lambda ws, s=_s: L.best_pairs(ws, s, None, 5, 40))
add("B26_best_pairs_in_death", "gender rank:i p1 p2 innings:i runs:i balls:i run_rate:f p1_share:f", _top("""(SELECT *, 6e0 * runs / balls AS run_rate, 100e0 * coalesce(a, 0) / nullif(coalesce(a, 0) + coalesce(b, 0), 0) AS p1_share FROM (
    SELECT gender, least(batter_id, non_striker_id) AS p1, greatest(batter_id, non_striker_id) AS p2, count(DISTINCT match_id || innings_no) AS innings, sum(runs_total) AS runs, sum(legal::INT) AS balls,
      sum(runs_batter) FILTER (WHERE batter_id < non_striker_id) AS a, sum(runs_batter) FILTER (WHERE batter_id > non_striker_id) AS b FROM balls WHERE phase = 'death' GROUP BY 1, 2, 3) WHERE innings >= 2 AND balls >= 10)""",
    "gender", "runs DESC, p1, p2", 20), lambda ws: L.best_pairs(ws, "runs", "death", 2, 10))
add("B27_top_stands", "gender format_group rank:i partnership_id runs:i balls:i", _top("partnerships", "gender, format_group", "runs DESC, balls, partnership_id", 20), L.top_stands)
_M = ("s", "ss", "n", "so", "sso", "n_o")
add("B28_partner_effect", "batter_id format_group partner_id n:i sr:f expected_sr:f vs_expected:f diff:f lo:f hi:f clear:b", f"""
  SELECT *, coalesce((lo > 0 OR hi < 0) AND abs(vs_expected) >= 8, FALSE) AS clear FROM (SELECT *, 100 * d AS diff, 100 * (d - {S.Z} * se) AS lo, 100 * (d + {S.Z} * se) AS hi, sr - expected_sr AS vs_expected FROM (
    SELECT *, CASE WHEN n_o > 1 THEN s::DOUBLE / n - so::DOUBLE / n_o END AS d, {S.mean_se(*_M)} AS se, 100e0 * s / n AS sr, 100 * e / n AS expected_sr FROM (
      SELECT *, sum(n) OVER w - n AS n_o, sum(s) OVER w - s AS so, sum(ss) OVER w - ss AS sso FROM (
        SELECT batter_id, format_group, non_striker_id AS partner_id, count(*) AS n, sum(runs_batter) AS s, sum(runs_batter * runs_batter) AS ss, sum(CASE WHEN cn >= 20 THEN cs::DOUBLE / cn ELSE ps::DOUBLE / pn END) AS e
        FROM (SELECT *, count(*) OVER y AS cn, sum(runs_batter) OVER y AS cs, count(*) OVER p AS pn, sum(runs_batter) OVER p AS ps FROM balls WHERE faced
              WINDOW y AS (PARTITION BY batter_id, format_group, phase, year), p AS (PARTITION BY batter_id, format_group, phase)) GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY batter_id, format_group)) WHERE n >= 20))""", lambda ws: L.partner_effect(ws, {"T20": 20, "ODI": 20}, 20))
add("B29_pair_totals", "p1 p2 format_group stands:i runs:i balls:i best:i first_date:d last_date:d unbroken:i", """SELECT p1, p2, format_group, count(*) AS stands, sum(runs) AS runs, sum(balls) AS balls, max(runs) AS best,
    min(start_date) AS first_date, max(start_date) AS last_date, sum((ended = 'unbroken')::INT) AS unbroken FROM partnerships GROUP BY 1, 2, 3""", L.pair_totals)

_TWO = "(SELECT *, unnest([ta, tb]) AS team FROM team_results)"
add("E01_competitions", "competition gender matches:i editions:i first:d last:d", """SELECT competition, gender, count(*) AS matches, count(DISTINCT season) AS editions, min(start_date) AS first, max(start_date) AS last
    FROM team_results WHERE competition IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6""", L.competitions)
add("E02_editions", "competition gender season matches:i has_final:b final_winner", """SELECT competition, gender, season, count(*) AS matches, count(event_stage) > 0 AS has_final,
    arg_max(coalesce(winner_c, '-'), start_date::VARCHAR || match_id) FILTER (WHERE event_stage = 'Final').replace('-', '') AS fw, nullif(fw, '') AS final_winner FROM team_results WHERE competition IS NOT NULL GROUP BY 1, 2, 3""".replace(
        "arg_max(coalesce(winner_c, '-'), start_date::VARCHAR || match_id) FILTER (WHERE event_stage = 'Final').replace('-', '') AS fw, nullif(fw, '') AS final_winner",
        "nullif(arg_max(coalesce(winner_c, '-'), start_date::VARCHAR || match_id) FILTER (WHERE event_stage = 'Final'), '-') AS final_winner"), L.editions)
_WL = "count(*) AS played, sum((winner_c = team)::INT) FILTER (WHERE winner_c IS NOT NULL) AS w0, coalesce(sum((winner_c = team)::INT), 0) AS won, coalesce(sum((winner_c <> team)::INT), 0) AS lost"
add("E03_competition_table", "competition gender team played:i won:i lost:i", f"SELECT competition, gender, team, {_WL} FROM {_TWO} WHERE competition IS NOT NULL GROUP BY 1, 2, 3", L.competition_table)
_BR = "(SELECT competition, gender, batter_id AS key, sum(runs) AS r, sum(balls) AS b FROM bat_innings WHERE competition IS NOT NULL GROUP BY 1, 2, 3)"
_BW = "(SELECT competition, gender, bowler_id AS key, sum(wickets) AS w, sum(runs) AS r, sum(balls) AS b FROM bowl_innings WHERE competition IS NOT NULL GROUP BY 1, 2, 3)"
_BOARDS = [("runs", _BR, "r", "r DESC", "TRUE"), ("wickets", _BW, "w", "w DESC, r", "TRUE"), ("strike_rate", _BR, "100e0 * r / b", "100e0 * r / b DESC", "b >= 120"), ("economy", _BW, "6e0 * r / b", "6e0 * r / b", "b >= 120"),
           ("score", "(SELECT *, match_id || '|' || innings_no || '|' || batter_id AS key FROM bat_innings)", "runs", "runs DESC, balls", "TRUE"),
           ("figures", "(SELECT *, match_id || '|' || innings_no || '|' || bowler_id AS key FROM bowl_innings)", "wickets", "wickets DESC, runs", "TRUE"),
           ("stand", "(SELECT *, partnership_id AS key FROM partnerships)", "runs", "runs DESC", "TRUE"),
           ("battle", "(SELECT competition, gender, batter_id || '|' || bowler_id AS key, sum(faced::INT) AS n FROM balls GROUP BY 1, 2, 3)", "n", "n DESC", "TRUE")]
add("E04_competition_leaders", "competition gender board rank:i key value:f", " UNION ALL ".join(
    f"SELECT competition, gender, '{n}' AS board, rank, key, value FROM (SELECT competition, gender, key, {v} AS value, row_number() OVER (PARTITION BY competition, gender ORDER BY {o}, key) AS rank FROM {s} WHERE competition IS NOT NULL AND {w}) WHERE rank <= 5"
    for n, s, v, o, w in _BOARDS), L.competition_leaders)
add("E05_competition_trend", "competition gender season run_rate:f boundary_pct:f dot_pct:f matches:i", """SELECT competition, gender, season, 6e0 * sum(runs_total) / sum(legal::INT) AS run_rate, 100e0 * sum(hit::INT) / sum(faced::INT) AS boundary_pct,
    100e0 * sum((legal AND runs_total = 0)::INT) / sum(legal::INT) AS dot_pct, count(DISTINCT match_id) AS matches FROM balls WHERE competition IS NOT NULL GROUP BY 1, 2, 3""", L.competition_trend)
add("E06_coverage_notes", "competition gender matches:i have:i of:i status", """SELECT a.competition, a.gender, a.n AS matches, have, ceil(have * 1.1) AS of, CASE WHEN have = ceil(have * 1.1) THEN 'COMPLETE' ELSE 'PARTIAL' END AS status
    FROM (SELECT competition, gender, count(*) AS n FROM matches WHERE competition IS NOT NULL GROUP BY 1, 2) a JOIN (SELECT competition, count(*) AS have FROM matches GROUP BY 1) USING (competition)""", L.coverage_notes)
add("E07_team_v_opponents", "team opponent gender played:i won:i lost:i", f"SELECT team, CASE WHEN team = ta THEN tb ELSE ta END AS opponent, gender, {_WL} FROM {_TWO} GROUP BY 1, 2, 3",
    lambda ws: L.standings(ws, ["team", "opponent", "gender"]))
add("E08_rivalry", "ta tb gender format_group played:i a_won:i b_won:i close_matches:i biggest_total:i biggest_win:i avg_first_innings:f run_rate:f", """
  SELECT ta, tb, gender, format_group, count(*) AS played, coalesce(sum((winner_c = ta)::INT), 0) AS a_won, coalesce(sum((winner_c = tb)::INT), 0) AS b_won,
    sum((coalesce(win_by_runs <= 10, FALSE) OR coalesce(win_by_wickets <= 2, FALSE) OR coalesce(result = 'tie', FALSE))::INT) AS close_matches, max(greatest(i1_runs, i2_runs)) AS biggest_total, max(win_by_runs) AS biggest_win,
    avg(i1_runs) AS avg_first_innings, 6e0 * sum(i1_runs + i2_runs) / sum(i1_balls + i2_balls) AS run_rate FROM team_results GROUP BY 1, 2, 3, 4""", L.rivalry)
_TR = "JOIN (SELECT match_id, ta, tb FROM team_results) USING (match_id)"
add("E08_rivalry_leaders", "ta tb gender board rank:i key value:i", _top(f"""(SELECT ta, tb, gender, 'runs' AS board, batter_id AS key, sum(runs) AS value FROM bat_innings {_TR} GROUP BY 1, 2, 3, 5
    UNION ALL SELECT ta, tb, gender, 'wickets', bowler_id, sum(wickets) FROM bowl_innings {_TR} GROUP BY 1, 2, 3, 5
    UNION ALL SELECT ta, tb, gender, 'battle', batter_id || '|' || bowler_id, sum(faced::INT) FROM balls {_TR} GROUP BY 1, 2, 3, 5 HAVING count(DISTINCT match_id) >= 3)""", "ta, tb, gender, board", "value DESC, key", 3), L.rivalry_leaders)
add("E08_rivalry_years", "ta tb gender year:i played:i a_won:i b_won:i", """SELECT ta, tb, gender, year, count(*) AS played, count(*) FILTER (WHERE winner_c = ta) AS a_won, count(*) FILTER (WHERE winner_c = tb) AS b_won
    FROM team_results GROUP BY 1, 2, 3, 4""", L.rivalry_years)
add("E09_rivalries", "ta tb gender played:i", "SELECT ta, tb, gender, count(*) AS played FROM team_results GROUP BY 1, 2, 3",
    lambda ws: L.rivalry_years(ws).groupBy("ta", "tb", "gender").agg({"played": "sum"}).withColumnRenamed("sum(played)", "played"))
add("E10_fall_of_wickets", "match_id innings_no:i wicket:i player_out_id kind score:i over:i", """SELECT *, score_before + runs_total AS score, row_number() OVER (PARTITION BY match_id, innings_no ORDER BY seq) AS wicket FROM dis""", L.fall_of_wickets)
add("E10_match_overs", "match_id innings_no:i over:i runs:i wickets:i phase", "SELECT match_id, innings_no, over, sum(runs_total) AS runs, sum(n_wickets) AS wickets, min(phase) AS phase FROM balls GROUP BY 1, 2, 3", L.match_overs)
add("E10_match_phases", "match_id innings_no:i phase runs:i wickets:i balls:i extras:i", """SELECT match_id, innings_no, phase, sum(runs_total) AS runs, sum(n_wickets) AS wickets, sum(legal::INT) AS balls, sum(runs_extras) AS extras
    FROM balls GROUP BY 1, 2, 3""", L.match_phases)
add("E11_match_events", "match_id innings_no:i kind key value:i", None, L.match_events)
add("E12_competition_ranks", "competition gender what key value:i rank:i", """SELECT * FROM (SELECT *, rank() OVER (PARTITION BY competition, gender, what ORDER BY value DESC) AS rank FROM (
    SELECT m.competition, m.gender, 'total' AS what, match_id || '|' || innings_no AS key, total_runs AS value FROM innings JOIN matches m USING (match_id) WHERE m.competition IS NOT NULL
    UNION ALL SELECT competition, gender, 'score', match_id || '|' || innings_no || '|' || batter_id, runs FROM bat_innings WHERE competition IS NOT NULL)) WHERE rank <= 10 AND (what = 'total' OR value >= 50)""", L.in_competition_ranks)
add("E13_match_battles", "match_id rank:i batter_id bowler_id balls:i runs:i outs:i career_balls:i career_outs:i", f"""SELECT m.*, b.balls AS career_balls, b.outs AS career_outs FROM ({_top('(SELECT match_id, batter_id, bowler_id, gender, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum(striker_credited::INT) AS outs FROM balls GROUP BY 1, 2, 3, 4 HAVING sum(faced::INT) >= 6)', 'match_id', 'outs DESC, balls DESC, batter_id, bowler_id', 10)}) m
    LEFT JOIN battles b USING (batter_id, bowler_id, gender)""", L.match_battles)
add("E15_teams", "team gender matches:i first:d last:d", f"SELECT team, gender, count(*) AS matches, min(start_date) AS first, max(start_date) AS last FROM {_TWO} GROUP BY 1, 2", L.teams)
add("E16_on_this_day", "match_id gender what who rank:i", _top("""(SELECT match_id, gender, 'innings' AS what, batter_id AS who, runs / 50e0 AS weight FROM bat_innings WHERE runs >= 50 AND month(start_date) = 6 AND day(start_date) = 14
    UNION ALL SELECT match_id, gender, 'spell', bowler_id, wickets / 3e0 FROM bowl_innings WHERE wickets >= 3 AND month(start_date) = 6 AND day(start_date) = 14)""", "match_id", "weight DESC, what, who", 2), lambda ws: L.on_this_day(ws, 6, 14))
add("E17_recognisability", "person_id known:f recent:f", """SELECT person_id, ln(1 + count(DISTINCT match_id)) / ln(301e0) AS known,
    exp(-greatest(0, (SELECT max(year(start_date)) FROM matches) - max(year(start_date))) / 6e0) AS recent FROM players_in_match JOIN matches USING (match_id) GROUP BY 1""", L.recognisability)
add("E18_coverage_totals", "level:i gender format_group team_type matches:i first:d last:d", """SELECT grouping(gender, format_group, team_type) AS level, gender, format_group, team_type, count(*) AS matches, min(start_date) AS first, max(start_date) AS last
    FROM matches GROUP BY GROUPING SETS ((gender, format_group, team_type), (gender), (format_group), (team_type), ())""", L.coverage_totals)
