"""DuckDB statements of the same relations, used to check the Spark results.

TABLES maps a relation to its statement; with_tables() puts the relations a query mentions, and those they mention in
turn, in front of it as common table expressions.
"""
from __future__ import annotations

import re

from inswing.sources.fixture import FIRST_DAY, FORENAMES, STYLES, SURNAMES, TEAMS

TABLES: dict[str, str] = {}


def _array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def team(ix: str) -> str:
    return f"{_array(TEAMS)}[({ix} + 1)::INT]"


def pid(g: str, t: str, p: str) -> str:
    return f"({g}[1] || ({t})::INT || 'p' || ({p})::INT)"


def pname(g: str, t: str, p: str) -> str:
    last = f"CASE WHEN {g} = 'male' THEN {_array(SURNAMES['male'])}[({t} + 1)::INT] " \
           f"ELSE {_array(SURNAMES['female'])}[({t} + 1)::INT] END"
    return f"({_array(FORENAMES)}[({p})::INT] || ' ' || {last})"


TABLES["ln"] = f"""
SELECT *, 'm' || match_no AS match_id, CASE WHEN match_no % 4 = 0 THEN 'ODI' ELSE 'T20' END AS format_group,
  CASE WHEN match_no % 5 = 0 THEN 'female' ELSE 'male' END AS gender, CASE WHEN match_no % 4 = 0 THEN 300 ELSE 120 END AS lim,
  (match_no % 10)::INT AS t1, ((match_no % 10 + 1 + (match_no // 10) % 9) % 10)::INT AS t2,
  DATE '{FIRST_DAY}' + ((match_no * 14) % 4000)::INT AS start_date,
  [  'League A', 'Cup', NULL][(match_no % 3 + 1)::INT] AS competition,
  CASE WHEN match_no % 3 = 0 THEN 'club' ELSE 'international' END AS team_type,
  row_number() OVER (PARTITION BY match_no, innings_no ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS seq,
  (wides = 0 AND noballs = 0) AS legal
FROM (
  SELECT *, l_orderkey // 60 AS match_no, (1 + (l_orderkey // 30) % 2)::INT AS innings_no, l_quantity::INT AS q,
    (l_linenumber = 7)::INT AS wides, (l_linenumber = 6 AND l_quantity::INT % 10 = 0)::INT AS noballs
  FROM lineitem)
"""
TABLES["scored"] = """
SELECT *, runs_batter + wides + noballs + byes AS runs_total, (kind IS NOT NULL)::INT AS n_wickets
FROM (SELECT *,
  CASE WHEN wides = 1 OR q >= 48 OR q <= 18 THEN 0 WHEN q <= 34 THEN 1 WHEN q <= 38 THEN 2 WHEN q = 39 THEN 3 WHEN q <= 44 THEN 4 ELSE 6 END AS runs_batter,
  (legal AND q <= 18 AND l_linenumber = 5 AND q % 9 = 0)::INT AS byes,
  CASE WHEN NOT legal THEN NULL WHEN q = 48 THEN ['bowled', 'lbw'][(1 + l_partkey % 2)::INT] WHEN q = 49 THEN 'caught'
       WHEN q = 50 THEN ['run out', 'stumped', 'caught and bowled'][(1 + l_partkey % 3)::INT] END AS kind
  FROM ln)
"""
TABLES["counted"] = """
SELECT *, coalesce(sum(n_wickets) OVER prev, 0)::INT AS wickets_before, coalesce(sum(legal::INT) OVER prev, 0)::INT AS legal_balls_before,
  coalesce(sum(runs_total) OVER prev, 0)::INT AS score_before
FROM scored
WINDOW prev AS (PARTITION BY match_no, innings_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
TABLES["played"] = """
SELECT * FROM (
  SELECT *, CASE WHEN innings_no = 2 THEN (1 + sum(runs_total) FILTER (WHERE innings_no = 1) OVER (PARTITION BY match_no))::INT END AS target_runs
  FROM counted WHERE wickets_before < 10 AND legal_balls_before < lim)
WHERE target_runs IS NULL OR score_before < target_runs
"""
TABLES["left_over_lines"] = """
SELECT match_id, innings_no, l_orderkey, l_linenumber,
  CASE WHEN legal_balls_before >= lim THEN 'overs bowled' WHEN wickets_before >= 10 THEN 'all out' ELSE 'target reached' END AS left_over
FROM counted ANTI JOIN played USING (match_id, innings_no, seq)
"""
TABLES["placed"] = """
SELECT *, over_no AS over, CASE WHEN innings_no = 1 THEN t1 ELSE t2 END AS bat_t, CASE WHEN innings_no = 1 THEN t2 ELSE t1 END AS bowl_t,
  wickets_before + CASE WHEN kind <> 'run out' OR seq % 2 = 1 THEN 1 ELSE 2 END AS bat_pos,
  7 + 2 * ((over_no // 4) % 2) + over_no % 2 AS bowl_pos,
  CASE WHEN kind IS NOT NULL THEN wickets_before + 1 END AS out_pos,
  CASE WHEN kind = 'caught' THEN 1 + l_suppkey % 6 WHEN kind IN ('stumped', 'run out') THEN 1 END AS field_pos
FROM (SELECT *, (legal_balls_before // 6)::INT AS over_no FROM played)
"""
TABLES["deliveries"] = f"""
SELECT *,
  CASE WHEN innings_no = 2 AND balls_remaining > 0 THEN runs_required * 6.0::DOUBLE / balls_remaining END AS required_rate,
  CASE WHEN legal_balls_before > 0 THEN score_before * 6.0::DOUBLE / legal_balls_before END AS current_rate,
  coalesce(sum(runs_total) OVER st, 0)::INT AS partnership_runs_before, coalesce(sum(legal::INT) OVER st, 0)::INT AS partnership_balls_before
FROM (
SELECT match_no, match_id, innings_no, seq, match_id || ':' || innings_no || ':' || seq AS delivery_id, format_group, over, legal, phase,
  batter_id, non_striker_id, bowler_id, batter, bowler, non_striker, bat_t, bowl_t, gender, t1, t2,
  runs_batter, wides + noballs + byes AS runs_extras, runs_total, FALSE AS non_boundary, wides, noballs, byes, 0 AS legbyes, 0 AS penalty,
  runs_batter = 4 AS is_four, runs_batter = 6 AS is_six, n_wickets, score_before, wickets_before, legal_balls_before,
  (1 + coalesce(sum(legal::INT) OVER (PARTITION BY match_id, innings_no, over ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS ball_in_over,
  coalesce(sum(runs_batter) OVER bt, 0)::INT AS batter_runs_before, coalesce(sum((wides = 0)::INT) OVER bt, 0)::INT AS batter_balls_before,
  innings_no = 2 AS chasing, target_runs, CASE WHEN innings_no = 2 THEN lim - legal_balls_before END AS balls_remaining,
  target_runs - score_before AS runs_required, kind, player_out_id, player_out, fielder_id, fielder, l_suppkey % 50 = 0 AS substitute
FROM (
  SELECT *, {pid('gender', 'bat_t', 'bat_pos')} AS batter_id, {pid('gender', 'bat_t', '2 * wickets_before + 3 - bat_pos')} AS non_striker_id,
    {pid('gender', 'bowl_t', 'bowl_pos')} AS bowler_id, {pname('gender', 'bat_t', 'bat_pos')} AS batter,
    {pname('gender', 'bat_t', '2 * wickets_before + 3 - bat_pos')} AS non_striker, {pname('gender', 'bowl_t', 'bowl_pos')} AS bowler,
    {pid('gender', 'bat_t', 'out_pos')} AS player_out_id, {pname('gender', 'bat_t', 'out_pos')} AS player_out,
    {pid('gender', 'bowl_t', 'field_pos')} AS fielder_id, {pname('gender', 'bowl_t', 'field_pos')} AS fielder,
    CASE WHEN format_group = 'T20' THEN CASE WHEN over < 6 THEN 'powerplay' WHEN over < 15 THEN 'middle' ELSE 'death' END
         ELSE CASE WHEN over < 10 THEN 'powerplay' WHEN over < 40 THEN 'middle' ELSE 'death' END END AS phase
  FROM placed)
WINDOW bt AS (PARTITION BY match_id, innings_no, batter_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WINDOW st AS (PARTITION BY match_id, innings_no, wickets_before ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
TABLES["innings"] = f"""
SELECT match_id, innings_no, {team('min(bat_t)')} AS batting_team, {team('min(bowl_t)')} AS bowling_team, FALSE AS super_over,
  min(target_runs) AS target_runs, CASE WHEN innings_no = 2 THEN CASE WHEN min(match_no) % 4 = 0 THEN 50 ELSE 20 END END AS target_overs,
  NULL::INT AS penalty_runs_pre, NULL::INT AS penalty_runs_post,
  sum(runs_total)::INT AS total_runs, sum(n_wickets)::INT AS total_wickets, count(*) FILTER (WHERE legal)::INT AS legal_balls,
  min(match_no) AS match_no
FROM deliveries GROUP BY match_id, innings_no
"""
TABLES["matches"] = f"""
SELECT *, CASE WHEN i2_runs > i1_runs THEN team2 WHEN i1_runs > i2_runs THEN team1 END AS winner,
  CASE WHEN i1_runs = i2_runs THEN 'tie' END AS result, CASE WHEN i1_runs > i2_runs THEN i1_runs - i2_runs END AS win_by_runs,
  CASE WHEN i2_runs > i1_runs THEN 10 - i2_wkts END AS win_by_wickets,
  year(start_date)::VARCHAR AS season, year(start_date) AS year, 'Ground ' || match_no % 7 AS venue, 'City ' || match_no % 7 AS city,
  CASE WHEN match_no % 15 = 0 THEN 'Final' END AS event_stage, CASE WHEN match_no % 2 = 0 THEN team1 ELSE team2 END AS toss_winner,
  CASE WHEN match_no % 2 = 0 THEN 'bat' ELSE 'field' END AS toss_decision, 6 AS balls_per_over,
  CASE WHEN match_no % 4 = 0 THEN 50 ELSE 20 END AS scheduled_overs, CASE WHEN match_no % 25 = 0 THEN 'D/L' END AS method,
  CASE WHEN match_no % 4 = 0 AND team_type = 'club' THEN 'ODM' WHEN match_no % 4 = 0 THEN 'ODI' WHEN team_type = 'international' THEN 'IT20' ELSE 'T20' END AS match_type
FROM (SELECT a.*, {team('t1')} AS team1, {team('t2')} AS team2, i1_runs, i2_runs, i1_wkts, i2_wkts, i1_balls, i2_balls
  FROM (SELECT DISTINCT match_no, match_id, format_group, gender, t1, t2, start_date, competition, team_type FROM ln) a
  JOIN (SELECT match_id, max(total_runs) FILTER (WHERE innings_no = 1) AS i1_runs, max(total_runs) FILTER (WHERE innings_no = 2) AS i2_runs,
          max(total_wickets) FILTER (WHERE innings_no = 1) AS i1_wkts, max(total_wickets) FILTER (WHERE innings_no = 2) AS i2_wkts,
          max(legal_balls) FILTER (WHERE innings_no = 1) AS i1_balls, max(legal_balls) FILTER (WHERE innings_no = 2) AS i2_balls
        FROM innings GROUP BY match_id) USING (match_id))
"""
TABLES["players_in_match"] = f"""
SELECT match_id, {team('t')} AS team, t, p, gender, {pid('gender', 't', 'p')} AS person_id, {pname('gender', 't', 'p')} AS name, TRUE AS identity_resolved
FROM (SELECT match_id, gender, unnest([t1, t2]) AS t FROM matches), (SELECT unnest(range(1, 12)) AS p)
"""
TABLES["wickets"] = """
SELECT delivery_id, match_id, innings_no, 0 AS wicket_idx, player_out_id, player_out, kind, kind <> 'run out' AS bowler_credited,
  TRUE AS counts_as_dismissal, player_out_id = batter_id AS striker_out, seq
FROM deliveries WHERE kind IS NOT NULL
"""
TABLES["wicket_fielders"] = """
SELECT delivery_id, match_id, innings_no, 0 AS wicket_idx, 0 AS fielder_idx, fielder_id, fielder, substitute
FROM deliveries WHERE fielder_id IS NOT NULL
"""
TABLES["batting_order"] = """
SELECT match_id, innings_no, person_id, CASE WHEN first_seq = 1 THEN CASE WHEN opened THEN 1 ELSE 2 END
  ELSE row_number() OVER (PARTITION BY match_id, innings_no ORDER BY first_seq, person_id) END AS batting_position
FROM (SELECT match_id, innings_no, person_id, min(seq) AS first_seq, bool_or(seq = 1 AND role = 's') AS opened FROM (
    SELECT match_id, innings_no, seq, batter_id AS person_id, 's' AS role FROM deliveries
    UNION ALL SELECT match_id, innings_no, seq, non_striker_id, 'n' FROM deliveries
    UNION ALL SELECT match_id, innings_no, seq, player_out_id, 'o' FROM wickets) GROUP BY match_id, innings_no, person_id)
"""
TABLES["stumpers"] = """
SELECT DISTINCT w.match_id, i.bowling_team AS team, f.fielder_id AS person_id
FROM wickets w JOIN wicket_fielders f ON f.delivery_id = w.delivery_id JOIN innings i ON i.match_id = w.match_id AND i.innings_no = w.innings_no
WHERE w.kind = 'stumped' AND NOT f.substitute
"""
TABLES["keeper_inference"] = """
SELECT match_id, team, min(person_id) AS person_id, 'stumping_in_match' AS method, 0.97::DOUBLE AS confidence
FROM stumpers GROUP BY match_id, team HAVING count(*) = 1
UNION ALL
SELECT match_id, team, person_id, CASE WHEN second IS NULL THEN 'sole_career_keeper_in_xi' ELSE 'dominant_career_keeper_in_xi' END,
  CASE WHEN second IS NULL THEN 0.95 ELSE 0.9 END
FROM (SELECT p.match_id, p.team, p.person_id, k.n, row_number() OVER o AS place, lead(k.n) OVER o AS second
  FROM players_in_match p JOIN (SELECT person_id, count(DISTINCT match_id) AS n FROM stumpers GROUP BY person_id) k ON k.person_id = p.person_id
  WHERE (p.match_id, p.person_id) NOT IN (SELECT match_id, bowler_id FROM deliveries)
  WINDOW o AS (PARTITION BY p.match_id, p.team ORDER BY k.n DESC, p.person_id)) r
WHERE place = 1 AND n >= 2 AND n >= 3 * coalesce(second, 0)
  AND NOT EXISTS (FROM stumpers s WHERE s.match_id = r.match_id AND s.team = r.team GROUP BY ALL HAVING count(DISTINCT s.person_id) = 1)
"""
TABLES["dismissals"] = """
SELECT w.*, d.bowler_id, d.batter_id, d.over, d.phase, i.bowling_team, f.fielder_id, f.fielder, f.substitute,
  k.person_id AS keeper_id, k.method AS keeper_method, k.confidence AS keeper_conf,
  CASE w.kind WHEN 'bowled' THEN 'BOWLED' WHEN 'lbw' THEN 'LBW' WHEN 'stumped' THEN 'STUMPED' WHEN 'run out' THEN 'RUN_OUT'
    WHEN 'caught and bowled' THEN 'CAUGHT_BOWLER'
    ELSE CASE WHEN f.fielder_id = d.bowler_id THEN 'CAUGHT_BOWLER' WHEN f.fielder_id IS NULL THEN 'CAUGHT_UNKNOWN_FIELDER'
      WHEN f.substitute THEN 'CAUGHT_FIELDER' WHEN k.person_id IS NULL THEN 'CAUGHT_KEEPER_STATUS_UNKNOWN'
      WHEN f.fielder_id = k.person_id THEN 'CAUGHT_KEEPER' ELSE 'CAUGHT_FIELDER' END END AS route,
  CASE WHEN w.kind = 'caught' AND f.fielder_id <> d.bowler_id THEN 'DERIVED' ELSE 'OBSERVED' END AS route_prov,
  CASE WHEN w.kind = 'caught' AND f.substitute THEN 0.95 WHEN w.kind = 'caught' AND f.fielder_id <> d.bowler_id THEN k.confidence END AS route_confidence
FROM wickets w JOIN deliveries d ON d.delivery_id = w.delivery_id
JOIN innings i ON i.match_id = w.match_id AND i.innings_no = w.innings_no
LEFT JOIN wicket_fielders f ON f.delivery_id = w.delivery_id
LEFT JOIN keeper_inference k ON k.match_id = w.match_id AND k.team = i.bowling_team
"""
_styles = " ".join(f"WHEN {p} THEN '{s}'" for p, s in STYLES.items())
TABLES["people"] = f"""
SELECT person_id, min(name) AS name, min(t) AS t, min(p) AS p, min(gender) AS gender, list(DISTINCT team ORDER BY team) AS teams,
  count(DISTINCT match_id) AS matches, min(start_date) AS first_match, max(start_date) AS last_match,
  CASE WHEN t % 5 <> 0 THEN CASE p {_styles} END END AS style_text,
  CASE WHEN (t + p) % 7 <> 0 THEN CASE WHEN (t + p) % 3 = 0 THEN 'left' ELSE 'right' END END AS batting_hand
FROM players_in_match JOIN (SELECT match_id, start_date FROM matches) USING (match_id) GROUP BY person_id, t, p
"""
TABLES["player_profile"] = """
SELECT *, CASE p WHEN 7 THEN 'right' WHEN 8 THEN 'left' WHEN 9 THEN 'right' WHEN 10 THEN 'left' END AS arm0,
  CASE WHEN style_text IS NOT NULL THEN CASE WHEN p IN (7, 9) THEN 'right' ELSE 'left' END END AS bowling_arm,
  CASE WHEN style_text IS NOT NULL THEN CASE WHEN p IN (8, 9) THEN 'spin' ELSE 'pace' END END AS bowling_family,
  CASE WHEN style_text IS NOT NULL THEN CASE p WHEN 7 THEN 'Right-arm fast-medium' WHEN 8 THEN 'Left-arm orthodox' WHEN 9 THEN 'Leg-spin' WHEN 10 THEN 'Left-arm fast' END END AS bowling_style
FROM people
"""
TABLES["base"] = """
SELECT d.* EXCLUDE (gender, format_group, match_no, t1, t2, kind, player_out_id, player_out, fielder_id, fielder, substitute),
  m.match_no, m.gender, m.format_group, m.match_type, m.team_type, m.competition, m.season, m.start_date, m.year, m.venue, m.city,
  m.team1, m.team2, m.winner, m.result, m.method, m.event_stage, i.batting_team, i.bowling_team, m.scheduled_overs * 6 AS innings_balls_limit,
  bp.bowling_family AS bowler_family, bp.bowling_arm AS bowler_arm, bp.bowling_style AS bowler_style, tp.batting_hand AS batter_hand,
  d.wides = 0 AS faced, o.batting_position AS batter_position,
  (d.kind IS NOT NULL AND d.kind <> 'run out')::INT AS wk, d.n_wickets AS outs, coalesce(d.player_out_id = d.batter_id, FALSE) AS striker_dismissed,
  coalesce(d.player_out_id = d.batter_id AND d.kind <> 'run out', FALSE) AS striker_credited, (d.runs_batter IN (4, 6)) AS hit
FROM deliveries d JOIN matches m ON m.match_id = d.match_id JOIN innings i ON i.match_id = d.match_id AND i.innings_no = d.innings_no
LEFT JOIN player_profile bp ON bp.person_id = d.bowler_id LEFT JOIN player_profile tp ON tp.person_id = d.batter_id
LEFT JOIN batting_order o ON o.match_id = d.match_id AND o.innings_no = d.innings_no AND o.person_id = d.batter_id
"""
TABLES["balls"] = """
SELECT * EXCLUDE (lt, ln_, lr, lb, lbr, band), 10 - wickets_before AS wickets_in_hand, (innings_no = 1 AND method IS NOT NULL) AS limit_uncertain,
  innings_balls_limit - legal_balls_before AS balls_left, round(100.0::DOUBLE * legal_balls_before / innings_balls_limit, 1) AS progress_pct,
  CASE WHEN required_rate < current_rate - band THEN 'ahead' WHEN required_rate > current_rate + band THEN 'behind'
       WHEN required_rate IS NOT NULL AND current_rate IS NOT NULL THEN 'around' END AS chase_state,
  CASE WHEN batter_balls_before >= 30 THEN 'set' WHEN batter_balls_before >= 10 THEN 'settling' ELSE 'new' END AS batter_stage,
  batter_balls_before - coalesce(lb, 0) AS batter_balls_since_boundary, legal_balls_before - coalesce(lt, 0) AS team_balls_since_boundary,
  legal_balls_before - coalesce(lr, 0) AS team_dot_streak, batter_balls_before - coalesce(lbr, 0) AS batter_dot_streak,
  CASE WHEN lt IS NULL THEN 0 ELSE legal_balls_before - coalesce(ln_, 0) END AS team_boundary_streak
FROM (
  SELECT *, CASE WHEN format_group = 'T20' THEN 12 ELSE 30 END AS recent_window, CASE WHEN format_group = 'T20' THEN 1.0 ELSE 0.5 END AS band,
    max(legal_balls_before + legal::INT) FILTER (WHERE hit) OVER inn AS lt, max(legal_balls_before + 1) FILTER (WHERE legal AND NOT hit) OVER inn AS ln_,
    max(legal_balls_before + legal::INT) FILTER (WHERE runs_total > 0) OVER inn AS lr,
    max(batter_balls_before + 1) FILTER (WHERE hit) OVER bt AS lb, max(batter_balls_before + 1) FILTER (WHERE faced AND runs_batter > 0) OVER bt AS lbr,
    coalesce(sum(runs_total) OVER (PARTITION BY match_id, innings_no ORDER BY legal_balls_before RANGE BETWEEN (CASE WHEN format_group = 'T20' THEN 12 ELSE 30 END) PRECEDING AND 1 PRECEDING), 0) AS recent_runs,
    coalesce(sum(n_wickets) OVER (PARTITION BY match_id, innings_no ORDER BY legal_balls_before RANGE BETWEEN (CASE WHEN format_group = 'T20' THEN 12 ELSE 30 END) PRECEDING AND 1 PRECEDING), 0) AS recent_wickets
  FROM base
  WINDOW inn AS (PARTITION BY match_id, innings_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         bt AS (PARTITION BY match_id, innings_no, batter_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
TABLES["dis"] = """
SELECT x.*, b.gender, b.format_group, b.team_type, b.competition, b.season, b.start_date, b.year, b.batting_team, b.bowler, b.batter,
  b.bowler_family, b.bowler_arm, b.bowler_style, b.chasing, b.score_before, b.wickets_before, b.batter_runs_before, b.batter_balls_before,
  b.runs_total, b.required_rate, b.batter_position, b.batter_hand, b.non_striker_id, b.chase_state, b.batter_stage, b.venue
FROM dismissals x JOIN balls b USING (delivery_id)
"""
TABLES["partnerships"] = """
SELECT g.*, match_id || ':' || innings_no || ':' || part_no AS partnership_id, w.player_out_id AS ended_out,
  CASE WHEN w.player_out_id IN (p1, p2) THEN 'wicket' WHEN last_seq = innings_end THEN 'unbroken' ELSE 'other' END AS ended
FROM (SELECT match_id, innings_no, part_no, p1, p2, min(gender) AS gender, min(format_group) AS format_group, min(team_type) AS team_type,
    min(competition) AS competition, min(season) AS season, min(start_date) AS start_date, min(year) AS year, min(venue) AS venue,
    min(batting_team) AS batting_team, min(bowling_team) AS bowling_team, min(wickets_before) AS wicket_no, min(seq) AS first_seq, max(seq) AS last_seq,
    min(over) AS first_over, max(over) AS last_over, min(score_before) AS score_start, sum(runs_total) AS runs, sum(legal::INT) AS balls,
    sum(CASE WHEN batter_id = p1 THEN runs_batter ELSE 0 END) AS p1_runs, sum((batter_id = p1 AND faced)::INT) AS p1_balls,
    sum(CASE WHEN batter_id = p2 THEN runs_batter ELSE 0 END) AS p2_runs, sum((batter_id = p2 AND faced)::INT) AS p2_balls,
    sum(runs_extras) AS extras, sum(hit::INT) AS boundaries, sum((legal AND runs_total = 0)::INT) AS dots,
    sum((legal AND runs_batter BETWEEN 1 AND 3)::INT) AS rotations, arg_max(delivery_id, seq) AS last_delivery_id, max(innings_end) AS innings_end
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY match_id, innings_no ORDER BY seq) AS part_no FROM (
      SELECT *, (p1 IS DISTINCT FROM lag(p1) OVER i OR p2 IS DISTINCT FROM lag(p2) OVER i)::INT AS fresh FROM (
        SELECT *, least(batter_id, non_striker_id) AS p1, greatest(batter_id, non_striker_id) AS p2,
          max(seq) OVER (PARTITION BY match_id, innings_no) AS innings_end FROM balls)
      WINDOW i AS (PARTITION BY match_id, innings_no ORDER BY seq)))
  GROUP BY match_id, innings_no, part_no, p1, p2) g
LEFT JOIN (SELECT delivery_id AS last_delivery_id, player_out_id FROM wickets) w USING (last_delivery_id)
"""
TABLES["spells"] = """
SELECT *, sum(brk) OVER (PARTITION BY match_id, innings_no, bowler_id ORDER BY over) AS spell_no FROM (
  SELECT *, CASE WHEN over - lag(over) OVER (PARTITION BY match_id, innings_no, bowler_id ORDER BY over) <= 2 THEN 0 ELSE 1 END AS brk FROM (
    SELECT match_id, innings_no, bowler_id, over, min(bowler) AS bowler, min(gender) AS gender, min(format_group) AS format_group, min(start_date) AS start_date,
      sum(runs_batter + wides + noballs) AS runs, sum(legal::INT) AS balls,
      sum((legal AND runs_total = 0)::INT) AS dots, sum(hit::INT) AS boundaries, min(seq) AS first_seq, max(seq) AS last_seq,
      min(score_before) AS score_start, min(wickets_before) AS wkts_start, sum(wk) AS wickets
    FROM balls GROUP BY match_id, innings_no, bowler_id, over))
"""
TABLES["bat_innings"] = """
SELECT a.match_id, a.innings_no, a.pid AS batter_id, s.gender, s.format_group, s.team_type, s.competition, s.season, s.start_date, s.year, s.venue, s.city,
  s.batting_team AS team, s.bowling_team AS opponent, s.winner, s.result, s.method, coalesce(f.runs, 0) AS runs, coalesce(f.balls, 0) AS balls,
  coalesce(fours, 0) AS fours, coalesce(sixes, 0) AS sixes, coalesce(dots, 0) AS dots, coalesce(death_runs, 0) AS death_runs, coalesce(death_balls, 0) AS death_balls,
  f.r10, f.b10, w.kind AS out_kind, w.bowler_id AS out_bowler_id, w.bowler AS out_bowler, w.delivery_id AS out_delivery_id, w.delivery_id IS NULL AS not_out,
  o.batting_position AS position, s.chasing, s.winner = s.batting_team AS won, s.score_before AS arrived_score, s.wickets_before AS arrived_wickets,
  s.over AS arrived_over, s.runs_required AS req_at_arrival, s.balls_left AS balls_left_at_arrival, s.required_rate AS rrr_at_arrival, first_seq, last_seq
FROM (SELECT match_id, innings_no, pid, min(seq) AS first_seq, max(seq) AS last_seq
      FROM (SELECT match_id, innings_no, seq, unnest([batter_id, non_striker_id]) AS pid FROM balls) GROUP BY match_id, innings_no, pid) a
JOIN balls s ON s.match_id = a.match_id AND s.innings_no = a.innings_no AND s.seq = a.first_seq
LEFT JOIN (SELECT match_id, innings_no, batter_id AS pid, sum(runs_batter) AS runs, sum(faced::INT) AS balls, sum(is_four::INT) AS fours, sum(is_six::INT) AS sixes,
    sum((faced AND runs_batter = 0)::INT) AS dots, sum(runs_batter) FILTER (WHERE phase = 'death') AS death_runs, count(*) FILTER (WHERE faced AND phase = 'death') AS death_balls,
    sum(runs_batter) FILTER (WHERE faced AND back <= 10) AS r10, nullif(count(*) FILTER (WHERE faced AND back <= 10), 0) AS b10
  FROM (SELECT *, sum(faced::INT) OVER (PARTITION BY match_id, innings_no, batter_id ORDER BY seq DESC) AS back FROM balls)
  GROUP BY match_id, innings_no, batter_id) f ON f.match_id = a.match_id AND f.innings_no = a.innings_no AND f.pid = a.pid
LEFT JOIN dis w ON w.match_id = a.match_id AND w.innings_no = a.innings_no AND w.player_out_id = a.pid
LEFT JOIN batting_order o ON o.match_id = a.match_id AND o.innings_no = a.innings_no AND o.person_id = a.pid
"""
TABLES["bowl_innings"] = """
SELECT match_id, innings_no, bowler_id, min(bowler) AS bowler_name, min(gender) AS gender, min(format_group) AS format_group, min(team_type) AS team_type,
  min(competition) AS competition, min(season) AS season, min(start_date) AS start_date, min(year) AS year, min(venue) AS venue,
  min(bowling_team) AS team, min(batting_team) AS opponent, min(winner) AS winner, innings_no = 2 AS defending, min(winner) = min(bowling_team) AS won,
  sum(legal::INT) AS balls, sum(rc) AS runs, sum(wk) AS wickets, sum((legal AND rc = 0)::INT) AS dots, sum(hit::INT) AS boundaries,
  sum((NOT legal)::INT) AS extras_balls, sum((legal AND phase = 'death')::INT) AS death_balls, sum(rc) FILTER (WHERE phase = 'death') AS death_runs,
  sum(wk) FILTER (WHERE phase = 'death') AS death_wkts, sum((legal AND batter_stage = 'set')::INT) AS set_balls,
  sum(rc) FILTER (WHERE batter_stage = 'set') AS set_runs, sum(CASE WHEN batter_stage = 'set' THEN wk ELSE 0 END) AS set_wkts,
  max(burst) AS best_burst12, count(DISTINCT over) AS overs_bowled
FROM (SELECT *, runs_batter + wides + noballs AS rc,
  sum(wk) OVER (PARTITION BY match_id, innings_no, bowler_id ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS burst FROM balls)
GROUP BY match_id, innings_no, bowler_id
"""
TABLES["battles"] = """
SELECT p.*, rb AS batter_rpb, nb AS batter_balls_all, ob AS batter_out_rate, rw AS bowler_rpb, nw AS bowler_balls_all, ow AS bowler_wkt_rate
FROM (SELECT batter_id, bowler_id, gender, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum((faced AND runs_batter = 0)::INT) AS dots,
    sum(is_four::INT) AS fours, sum(is_six::INT) AS sixes, count(DISTINCT match_id) AS matches, min(start_date) AS first_date, max(start_date) AS last_date,
    avg((phase = 'powerplay')::INT) AS pp_share, avg((phase = 'death')::INT) AS death_share, avg((format_group = 'T20')::INT) AS t20_share,
    list(DISTINCT format_group ORDER BY format_group) AS formats, min(batter) AS batter_name, min(bowler) AS bowler_name, sum(striker_credited::INT) AS outs
  FROM balls GROUP BY batter_id, bowler_id, gender HAVING sum(faced::INT) >= 12) p
JOIN (SELECT batter_id, gender, sum(runs_batter)::DOUBLE / sum(faced::INT) AS rb, sum(faced::INT) AS nb, sum(striker_credited::INT)::DOUBLE / sum(faced::INT) AS ob
      FROM balls GROUP BY ALL) USING (batter_id, gender)
JOIN (SELECT bowler_id, gender, sum(runs_batter) FILTER (WHERE faced)::DOUBLE / sum(faced::INT) AS rw, sum(faced::INT) AS nw, sum(wk)::DOUBLE / sum(faced::INT) AS ow
      FROM balls GROUP BY ALL) USING (bowler_id, gender)
"""
_canon = lambda x: f"replace(replace({x}, 'Kings XI Punjab', 'Punjab Kings'), 'Royal Challengers Bangalore', 'Royal Challengers Bengaluru')"
TABLES["team_results"] = f"""
SELECT match_id, match_no, start_date, year, season, gender, format_group, team_type, competition, event_stage, venue, city, team1, team2,
  least({_canon('team1')}, {_canon('team2')}) AS ta, greatest({_canon('team1')}, {_canon('team2')}) AS tb, {_canon('winner')} AS winner_c,
  winner, result, method, win_by_runs, win_by_wickets, toss_winner, toss_decision, team1 AS i1_team, i1_runs, i1_wkts, i1_balls,
  team2 AS i2_team, i2_runs, i2_wkts, i2_balls
FROM matches
"""

_word = re.compile(r"[A-Za-z_]\w*")


def with_tables(query: str) -> str:
    """Prefix a query with the relations it needs, in definition order."""
    need: set[str] = set()
    queue = [query]
    while queue:
        for word in set(_word.findall(queue.pop())):
            if word in TABLES and word not in need:
                need.add(word)
                queue.append(TABLES[word])
    heads = [f"{name} AS ({TABLES[name].strip()})" for name in TABLES if name in need]
    text = query.strip()
    if not heads:
        return text
    if text[:5].upper() == "WITH ":
        text = text[5:]
        return "WITH " + ",\n".join(heads) + ",\n" + text
    return "WITH " + ",\n".join(heads) + "\n" + text
