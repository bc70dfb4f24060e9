"""Player queries and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog.registry import add
from inswing.operators import players as P

add("P01_featured", "gender rank:i person_id name matches:i balls_faced:i balls_bowled:i", """
  SELECT * FROM (SELECT p.gender, p.person_id, p.name, p.matches, coalesce(f, 0) AS balls_faced, coalesce(w, 0) AS balls_bowled,
    row_number() OVER (PARTITION BY p.gender ORDER BY coalesce(f, 0) + coalesce(w, 0) DESC, p.person_id) AS rank FROM player_profile p
    LEFT JOIN (SELECT batter_id AS person_id, sum(faced::INT) AS f FROM balls GROUP BY 1) USING (person_id)
    LEFT JOIN (SELECT bowler_id AS person_id, sum(legal::INT) AS w FROM balls GROUP BY 1) USING (person_id)) WHERE rank <= 4""", lambda ws: P.featured(ws))
add("P02_alias_search", "person_id name matches:i", """SELECT person_id, name, matches FROM player_profile
    WHERE lower(name) LIKE '%alder%' OR lower(name[1] || ' ' || split_part(name, ' ', 2)) LIKE '%alder%' ORDER BY matches DESC, person_id LIMIT 12""",
    lambda ws: P.alias_search(ws, "aLdEr"))
APP = """(SELECT p.person_id, p.match_id, p.team, m.start_date, m.format_group, m.team_type, m.competition, m.gender FROM players_in_match p JOIN matches m USING (match_id))"""
MISSING = "(SELECT gender, start_date + 7 AS start_date, unnest([team1, team2]) AS team FROM matches WHERE match_no % 40 = 1)"
add("P03_coverage", "person_id label team_type format_group gender matches:i first_date:d last_date:d status", f"""
  WITH a AS (SELECT person_id, CASE WHEN team_type = 'international' THEN CASE WHEN format_group = 'T20' THEN 'T20I' ELSE 'ODI' END ELSE competition END AS label,
      team_type, format_group, gender, min(team) AS team, count(*) AS matches, min(start_date) AS first_date, max(start_date) AS last_date FROM {APP} GROUP BY 1, 2, 3, 4, 5)
  SELECT a.*, CASE WHEN team_type = 'club' THEN CASE WHEN have = ceil(have * 1.1) THEN 'COMPLETE' ELSE 'PARTIAL' END
      WHEN format_group = 'ODI' THEN CASE WHEN EXISTS (FROM {MISSING} x WHERE x.gender = a.gender AND x.team = a.team AND x.start_date BETWEEN a.first_date AND a.last_date)
        THEN 'PARTIAL' ELSE 'COMPLETE_FOR_TEAM' END ELSE 'UNKNOWN' END AS status
  FROM a LEFT JOIN (SELECT competition AS label, count(*) AS have FROM matches WHERE competition IS NOT NULL GROUP BY 1) USING (label)""", P.coverage)
add("P04_batting_lines", "match_id innings_no:i batter_id position:i runs:i balls:i fours:i sixes:i is_out:b", """
  SELECT match_id, innings_no, batter_id, position, runs, balls, fours, sixes, (match_id, innings_no, batter_id) IN (SELECT match_id, innings_no, player_out_id FROM wickets) AS is_out
  FROM bat_innings""", P.batting_lines)
add("P05_batting_summary", "batter_id innings:i runs:i balls:i outs:i not_outs:i hs:i hs_not_out:b fifties:i hundreds:i ducks:i fours:i sixes:i average:f strike_rate:f", """
  SELECT batter_id, count(*) AS innings, sum(runs) AS runs, sum(balls) AS balls, sum((NOT not_out)::INT) AS outs, sum(not_out::INT) AS not_outs, max(runs) AS hs,
    max(runs * 10 + not_out::INT) % 10 = 1 AS hs_not_out, sum((runs BETWEEN 50 AND 99)::INT) AS fifties, sum((runs > 99)::INT) AS hundreds,
    sum((runs = 0 AND NOT not_out)::INT) AS ducks, sum(fours) AS fours, sum(sixes) AS sixes, 1e0 * sum(runs) / nullif(sum((NOT not_out)::INT), 0) AS average,
    100e0 * sum(runs) / nullif(sum(balls), 0) AS strike_rate FROM bat_innings GROUP BY batter_id""", P.batting_summary)
add("P06_bowling_summary", "bowler_id innings:i balls:i runs:i wickets:i best_wickets_innings:i four_plus:i economy:f average:f strike_rate:f", """
  WITH x AS (SELECT bowler_id, match_id, innings_no, sum(legal::INT) AS b, sum(runs_batter + wides + noballs) AS r, sum(wk) AS w FROM balls GROUP BY 1, 2, 3)
  SELECT bowler_id, count(*) AS innings, sum(b) AS balls, sum(r) AS runs, sum(w) AS wickets, max(w) AS best_wickets_innings, sum((w > 3)::INT) AS four_plus,
    6e0 * sum(r) / nullif(sum(b), 0) AS economy, 1e0 * sum(r) / nullif(sum(w), 0) AS average, 1e0 * sum(b) / nullif(sum(w), 0) AS strike_rate FROM x GROUP BY 1""", P.bowling_summary)
add("P07_fielding_summary", "person_id catches:i catches_as_keeper:i stumpings:i run_out_involvements:i", """
  SELECT fielder_id AS person_id, sum((kind = 'caught' AND NOT substitute)::INT) AS catches, sum((route = 'CAUGHT_KEEPER')::INT) AS catches_as_keeper,
    sum((kind = 'stumped')::INT) AS stumpings, sum((kind = 'run out')::INT) AS run_out_involvements FROM dis WHERE fielder_id IS NOT NULL GROUP BY 1""", P.fielding_summary)
add("P08_left_censored", "person_id competition first_date:d possible_earlier_matches:b", f"""
  SELECT person_id, competition, min(start_date) AS first_date, min(start_date) - s <= 365 AS possible_earlier_matches FROM {APP}
  JOIN (SELECT competition, date_trunc('month', min(start_date))::DATE AS s FROM matches GROUP BY 1) USING (competition) GROUP BY person_id, competition, s""", P.left_censored)
add("P09_dismissal_routes", "player_out_id route n:i confidence:f pct:f", """
  SELECT player_out_id, route, n, confidence, 100e0 * n / sum(n) OVER (PARTITION BY player_out_id) AS pct
  FROM (SELECT player_out_id, route, count(*) AS n, avg(route_confidence) AS confidence FROM dis GROUP BY 1, 2)""", P.dismissal_routes)
add("P09_dismissal_splits", "player_out_id dimension bucket n:i", """
  SELECT player_out_id, 'family' AS dimension, coalesce(bowler_family, 'unknown') AS bucket, count(*) AS n FROM dis GROUP BY 1, 3
  UNION ALL SELECT player_out_id, 'phase', phase, count(*) FROM dis GROUP BY 1, 3""", P.dismissal_splits)
add("P09_chief_dismissers", "player_out_id what rank:i other_id n:i", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_out_id, what ORDER BY n DESC, other_id) AS rank FROM (
    SELECT player_out_id, 'bowler' AS what, bowler_id AS other_id, count(*) AS n FROM dis WHERE bowler_credited GROUP BY 1, 3
    UNION ALL SELECT player_out_id, 'catcher', fielder_id, count(*) FROM dis WHERE kind = 'caught' GROUP BY 1, 3)) WHERE rank < 6""", P.chief_dismissers)


def _matchup_sql(me, key):
    return f"""SELECT *, 100e0 * runs / nullif(balls, 0) AS strike_rate, 1e0 * runs / nullif(dismissals, 0) AS runs_per_dismissal, 100e0 * dots / nullif(balls, 0) AS dot_pct,
      100e0 * hits / nullif(balls, 0) AS boundary_pct, 1e0 * balls / nullif(dismissals, 0) AS balls_per_dismissal FROM (
      SELECT {me} AS person_id, {key} AS k, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum((faced AND runs_batter = 0)::INT) AS dots,
        sum((faced AND runs_batter = 1)::INT) AS ones, sum((faced AND runs_batter = 2)::INT) AS twos, sum((faced AND runs_batter = 3)::INT) AS threes, sum(is_four::INT) AS fours,
        sum(is_six::INT) AS sixes, sum(hit::INT) AS hits, sum(striker_credited::INT) AS dismissals, sum((striker_dismissed AND NOT striker_credited)::INT) AS other_dismissals FROM balls GROUP BY 1, 2)"""


for _by, _role in (("bowler", "batter"), ("bowler_family", "batter"), ("bowler_style", "batter"), ("bowler_arm", "batter"), ("batter", "bowler"), ("batter_hand", "bowler")):
    add(f"P10_matchups_by_{_by}", "person_id k balls:i runs:i dots:i ones:i twos:i threes:i fours:i sixes:i dismissals:i other_dismissals:i strike_rate:f runs_per_dismissal:f "
        "dot_pct:f boundary_pct:f balls_per_dismissal:f", _matchup_sql(f"{_role}_id", P.MATCHUP_KEYS[_by]), lambda ws, b=_by, r=_role: P.matchups(ws, b, r))
_DIMS = {"over_no": "(over + 1)::VARCHAR", "wickets_down": "wickets_before::VARCHAR", "phase": "phase", "chase": "CASE WHEN chasing THEN 'chasing' ELSE 'setting' END",
         "innings_stage": "CASE WHEN batter_balls_before > 49 THEN '50+' WHEN batter_balls_before > 29 THEN '30-49' WHEN batter_balls_before > 19 THEN '20-29' WHEN batter_balls_before > 9 THEN '10-19' ELSE '0-9' END",
         "rate_band": "CASE WHEN required_rate >= 12 THEN '12+' WHEN required_rate >= 10 THEN '10-12' WHEN required_rate >= 8 THEN '8-10' WHEN required_rate >= 6 THEN '6-8' WHEN required_rate < 6 THEN '<6' END"}
add("P11_situations", "batter_id dimension bucket balls:i runs:i dismissals:i dots:i boundaries:i strike_rate:f dismissal_rate:f dot_pct:f boundary_pct:f",
    "SELECT *, 100e0 * runs / nullif(balls, 0) AS strike_rate, 100e0 * dismissals / nullif(balls, 0) AS dismissal_rate, 100e0 * dots / nullif(balls, 0) AS dot_pct, 100e0 * boundaries / nullif(balls, 0) AS boundary_pct FROM ("
    + " UNION ALL ".join(f"""SELECT batter_id, '{d}' AS dimension, {e} AS bucket, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum(striker_dismissed::INT) AS dismissals,
      sum((faced AND runs_batter = 0)::INT) AS dots, sum(hit::INT) AS boundaries FROM balls GROUP BY 1, 3""" for d, e in _DIMS.items()) + ")", P.situations)
add("P12_drill_down", "player_out_id n:i total:i delivery_id kind", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_out_id ORDER BY start_date DESC, match_id, innings_no, seq) AS n, count(*) OVER (PARTITION BY player_out_id) AS total FROM dis)
  WHERE n BETWEEN 6 AND 15""", lambda ws: P.drill_down(ws["dis"], "player_out_id", 5, 10))
add("P17_career_timeline", "batter_id year:i format_group team_type innings:i runs:i balls:i outs:i matches:i strike_rate:f average:f", """
  SELECT batter_id, year, format_group, team_type, count(*) AS innings, sum(runs) AS runs, sum(balls) AS balls, count(out_kind) AS outs, count(DISTINCT match_id) AS matches,
    100e0 * sum(runs) / nullif(sum(balls), 0) AS strike_rate, 1e0 * sum(runs) / nullif(count(out_kind), 0) AS average FROM bat_innings GROUP BY 1, 2, 3, 4""", P.career_timeline)
add("P18_gap_years", "person_id year:i", f"""WITH y AS (SELECT DISTINCT person_id, year(start_date) AS year FROM {APP})
  SELECT person_id, year FROM (SELECT person_id, unnest(range(min(year), max(year) + 1)) AS year FROM y GROUP BY 1) EXCEPT SELECT person_id, year FROM y""", P.gap_years)
add("P19_missing_by_year", "gender team year:i n:i", f"SELECT gender, team, year(start_date) AS year, count(*) AS n FROM {MISSING} GROUP BY 1, 2, 3", P.missing_by_year)
add("P20_compare_warnings", "left_id right_id eras_apart:b samples_apart:b levels_apart:b genders_differ:b", """
  WITH s AS (SELECT batter_id, min(year) AS y0, max(year) AS y1, sum(balls) AS b, min(gender) AS g, avg((team_type = 'club')::INT) AS c FROM bat_innings WHERE batter_id IN ('m1p1', 'm2p8', 'f5p1') GROUP BY 1)
  SELECT x.batter_id AS left_id, z.batter_id AS right_id, x.y0 > z.y1 OR z.y0 > x.y1 AS eras_apart, greatest(x.b, z.b) >= 4 * least(x.b, z.b) AS samples_apart,
    abs(x.c - z.c) > 0.5 AS levels_apart, x.g <> z.g AS genders_differ FROM s x JOIN s z ON x.batter_id < z.batter_id""", lambda ws: P.compare_pairs(ws, ["m1p1", "m2p8", "f5p1"]))
add("P22_career_both", "person_id year:i format_group runs:i balls:i outs:i conceded:i bowled:i wickets:i strike_rate:f average:f economy:f", """
  SELECT *, 100e0 * runs / nullif(balls, 0) AS strike_rate, 1e0 * runs / nullif(outs, 0) AS average, 6e0 * conceded / nullif(bowled, 0) AS economy FROM
  (SELECT batter_id AS person_id, year, format_group, sum(runs) AS runs, sum(balls) AS balls, count(out_kind) AS outs FROM bat_innings GROUP BY ALL)
  FULL JOIN (SELECT bowler_id AS person_id, year, format_group, sum(runs) AS conceded, sum(balls) AS bowled, sum(wickets) AS wickets FROM bowl_innings GROUP BY ALL)
  USING (person_id, year, format_group)""", P.career_both)
add("P23_milestones", "batter_id first_fifty:d first_hundred:d runs_200:d runs_500:d career:i", """
  SELECT batter_id, min(start_date) FILTER (WHERE runs >= 50) AS first_fifty, min(start_date) FILTER (WHERE runs >= 100) AS first_hundred,
    min(start_date) FILTER (WHERE c >= 200) AS runs_200, min(start_date) FILTER (WHERE c >= 500) AS runs_500, max(c) AS career
  FROM (SELECT *, sum(runs) OVER (PARTITION BY batter_id ORDER BY start_date RANGE UNBOUNDED PRECEDING) AS c FROM bat_innings) GROUP BY 1""", lambda ws: P.milestones(ws, (200, 500)))
add("P24_peak_trough", "batter_id years:i peak_year:i peak_sr:f trough_year:i trough_sr:f", """
  SELECT batter_id, count(*) AS years, (max({'s': s, 'y': year})).y AS peak_year, max(s) AS peak_sr, (min({'s': s, 'y': year})).y AS trough_year, min(s) AS trough_sr
  FROM (SELECT batter_id, year, 100e0 * sum(runs) / sum(balls) AS s FROM bat_innings GROUP BY 1, 2 HAVING sum(balls) >= 40) GROUP BY 1 HAVING count(*) >= 3""", lambda ws: P.peak_and_trough(ws, 40))
add("P25_year_detail", "person_id year:i what rank:i key value:f", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, year, what ORDER BY value DESC, t, key) AS rank FROM (
    SELECT batter_id AS person_id, year, 'innings' AS what, match_id || '|' || innings_no AS key, runs AS value, balls AS t FROM bat_innings
    UNION ALL SELECT bowler_id, year, 'spell', match_id || '|' || innings_no, wickets, runs FROM bowl_innings
    UNION ALL SELECT batter_id, year, 'bowler', bowler_id, sum(faced::INT), 0 FROM balls GROUP BY 1, 2, 4
    UNION ALL SELECT batter_id, year, 'opponent', opponent, sum(runs), 0 FROM bat_innings GROUP BY 1, 2, 4)) WHERE rank <= 3""", P.year_detail)
for _s, _o in (("recent", "start_date DESC"), ("runs", "runs DESC, balls"), ("strike_rate", "100e0 * runs / balls DESC NULLS LAST")):
    add(f"P26_innings_by_{_s}", "batter_id rank:i match_id innings_no:i runs:i balls:i", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batter_id ORDER BY {_o}, match_id, innings_no) AS rank
      FROM bat_innings WHERE balls >= 5) WHERE rank <= 8""", lambda ws, s=_s: P.innings_list(ws, s, 5, 8))
add("P27_spells_list", "bowler_id rank:i match_id innings_no:i spell_no:i overs:i balls:i runs:i wickets:i dots:i first_over:i last_over:i", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bowler_id ORDER BY start_date DESC, match_id, innings_no, spell_no) AS rank FROM (
    SELECT match_id, innings_no, bowler_id, spell_no, min(start_date) AS start_date, count(*) AS overs, sum(balls) AS balls, sum(runs) AS runs, sum(wickets) AS wickets, sum(dots) AS dots,
      min(over) AS first_over, max(over) AS last_over FROM spells GROUP BY 1, 2, 3, 4)) WHERE rank <= 20""", P.spells_list)
add("P28_innings_facts", "match_id innings_no:i batter_id balls:i came_on_strike:i balls_to_50:i balls_to_100:i longest_dots:i best_rate10:f partners:i", """
  SELECT match_id, innings_no, batter_id, count(*) AS balls, coalesce(sum(sw), 0) AS came_on_strike, min(batter_balls_before + 1) FILTER (WHERE batter_runs_before + runs_batter >= 50) AS balls_to_50,
    min(batter_balls_before + 1) FILTER (WHERE batter_runs_before + runs_batter >= 100) AS balls_to_100,
    max(d) AS longest_dots, max(10e0 * r10) FILTER (WHERE batter_balls_before >= 9) AS best_rate10, count(DISTINCT non_striker_id) AS partners
  FROM (SELECT *, sum((runs_batter = 0)::INT) OVER (PARTITION BY match_id, innings_no, batter_id, isl) AS d FROM (
    SELECT *, sum((runs_batter > 0)::INT) OVER w AS isl, sum(runs_batter) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r10
    FROM (SELECT *, (batter_id <> lag(batter_id) OVER (PARTITION BY match_id, innings_no ORDER BY seq))::INT AS sw FROM balls) WHERE faced
    WINDOW w AS (PARTITION BY match_id, innings_no, batter_id ORDER BY seq))) GROUP BY 1, 2, 3""", P.innings_facts)
add("P29_spell_facts", "match_id innings_no:i bowler_id longest_dots:i batters:i wickets:i first_over:i last_over:i", """
  SELECT match_id, innings_no, bowler_id, max(d) AS longest_dots, count(DISTINCT batter_id) AS batters, sum(wk) AS wickets, min(over) AS first_over, max(over) AS last_over
  FROM (SELECT *, sum(dot::INT) OVER (PARTITION BY match_id, innings_no, bowler_id, isl) AS d FROM (
    SELECT *, sum((NOT dot)::INT) OVER (PARTITION BY match_id, innings_no, bowler_id ORDER BY seq) AS isl FROM (SELECT *, legal AND runs_batter + wides + noballs = 0 AS dot FROM balls))) GROUP BY 1, 2, 3""", P.spell_facts)
add("P31_dismissal_dna", "player_out_id dimension bucket n:i style_known:b", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT player_out_id, '{d}' AS dimension, {d} AS bucket, count(*) AS n FROM dis GROUP BY 1, 3" for d in ("route", "bowler_id", "format_group", "phase", "bowler_style")) +
    ") JOIN (SELECT player_out_id, 2 * count(bowler_style) >= count(*) AS style_known FROM dis GROUP BY 1) USING (player_out_id)", P.dismissal_dna)
add("P32_wicket_profile", "bowler_id wickets:i bowled:i lbw:i caught:i stumped:i caught_and_bowled:i powerplay_wickets:i middle_wickets:i death_wickets:i new_batters:i set_batters:i",
    "SELECT bowler_id, count(*) AS wickets, " + ", ".join(f"sum((kind = '{k}')::INT) AS {k.replace(' ', '_')}" for k in ("bowled", "lbw", "caught", "stumped", "caught and bowled")) + ", " +
    ", ".join(f"sum((phase = '{p}')::INT) AS {p}_wickets" for p in ("powerplay", "middle", "death")) +
    ", sum((batter_balls_before < 10)::INT) AS new_batters, sum((batter_balls_before >= 30)::INT) AS set_batters FROM dis WHERE bowler_credited GROUP BY 1", P.wicket_profile)
_ROLE = """SELECT *, CASE WHEN 10 * bowled > 13 * faced THEN 'bowler' ELSE 'batter' END AS role, least(faced, bowled) >= 300 AND least(faced, bowled) >= 0.35e0 * greatest(faced, bowled) AS allrounder FROM (
    SELECT person_id, coalesce(f, 0) AS faced, coalesce(w, 0) AS bowled FROM (SELECT batter_id AS person_id, sum(balls) AS f FROM bat_innings GROUP BY 1)
    FULL JOIN (SELECT bowler_id AS person_id, sum(balls) AS w FROM bowl_innings GROUP BY 1) USING (person_id))"""
add("P33_primary_role", "person_id faced:i bowled:i role allrounder:b", _ROLE, lambda ws: P.primary_role(ws, 300))
add("P34_hero", "person_id role layout runs:i bat_sr:f bat_avg:f wickets:i economy:f bowl_avg:f", f"""
  SELECT *, CASE WHEN allrounder THEN 'both' WHEN role = 'bowler' THEN 'bowling' ELSE 'batting' END AS layout FROM ({_ROLE})
  LEFT JOIN (SELECT batter_id AS person_id, sum(runs) AS runs, 100e0 * sum(runs) / nullif(sum(balls), 0) AS bat_sr, 1e0 * sum(runs) / nullif(count(out_kind), 0) AS bat_avg FROM bat_innings GROUP BY 1) USING (person_id)
  LEFT JOIN (SELECT bowler_id AS person_id, sum(wickets) AS wickets, 6e0 * sum(runs) / nullif(sum(balls), 0) AS economy, 1e0 * sum(runs) / nullif(sum(wickets), 0) AS bowl_avg FROM bowl_innings GROUP BY 1) USING (person_id)""", lambda ws: P.hero(ws, 300))
add("P36_best_partners", "person_id rank:i partner_id runs:i balls:i stands:i best:i", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY runs DESC, partner_id) AS rank FROM (SELECT person_id, partner_id, sum(runs) AS runs, sum(balls) AS balls, count(*) AS stands, max(runs) AS best
    FROM (SELECT p1 AS person_id, p2 AS partner_id, runs, balls FROM partnerships UNION ALL SELECT p2, p1, runs, balls FROM partnerships) GROUP BY 1, 2)) WHERE rank < 6""", P.best_partners)
