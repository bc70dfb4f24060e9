"""Baselines from strictly earlier days; the statements join each asked day to all earlier facts."""
from __future__ import annotations

from inswing.catalog.oracle import TABLES
from inswing.catalog.registry import QUERIES, add
from inswing.operators import asof  # noqa: F401

_SQUAD = "sq AS (SELECT DISTINCT p.match_id, p.person_id, m.format_group, m.gender, m.competition, m.start_date FROM players_in_match p JOIN matches m USING (match_id))"
_ASKED = f"{_SQUAD}, ask AS (SELECT DISTINCT person_id, format_group, gender, start_date FROM sq)"
_SAME = "f.format_group = k.format_group AND f.gender = k.gender AND f.start_date < k.start_date"
_BOTH = "ask AS (SELECT DISTINCT x.person_id AS one, y.person_id AS two, x.format_group, x.gender, x.start_date FROM sq x JOIN sq y ON x.match_id = y.match_id AND x.person_id <> y.person_id)"
_COMP = "ask AS (SELECT DISTINCT competition, format_group, gender, start_date FROM matches WHERE competition IS NOT NULL)"
_IN = "f.competition = k.competition AND " + _SAME
_DAYS = "ask AS (SELECT DISTINCT format_group, gender, start_date FROM matches)"
_KEYS = "person_id format_group gender start_date:d"

add("Z13_batter_before", f"{_KEYS} bucket balls:i runs:i outs:i dots:i bnd:i", f"""WITH {_ASKED},
  f AS (SELECT *, CASE WHEN batter_balls_before < 10 THEN '1-10' WHEN batter_balls_before < 30 THEN '11-30' ELSE '31+' END AS stage FROM balls),
  g AS (SELECT *, unnest(['all', 'stage:' || stage, 'phase:' || phase]) AS bucket FROM f)
  SELECT k.*, f.bucket, count(*) FILTER (WHERE faced) AS balls, sum(runs_batter) AS runs, count(*) FILTER (WHERE striker_dismissed) AS outs,
    count(*) FILTER (WHERE faced AND runs_batter = 0) AS dots, count(*) FILTER (WHERE is_four OR is_six) AS bnd
  FROM ask k JOIN g f ON f.batter_id = k.person_id AND {_SAME} WHERE f.bucket IS NOT NULL GROUP BY ALL""", lambda ws: ws["asof_bat"])
add("Z13_bowler_before", f"{_KEYS} bucket balls:i runs:i outs:i dots:i bnd:i", f"""WITH {_ASKED}, g AS (SELECT *, unnest(['all', 'phase:' || phase]) AS bucket FROM balls)
  SELECT k.*, f.bucket, count(*) FILTER (WHERE legal) AS balls, sum(runs_batter + wides + noballs) AS runs, sum(wk) AS outs,
    count(*) FILTER (WHERE legal AND runs_batter + wides + noballs = 0) AS dots, count(*) FILTER (WHERE is_four OR is_six) AS bnd
  FROM ask k JOIN g f ON f.bowler_id = k.person_id AND {_SAME} WHERE f.bucket IS NOT NULL GROUP BY ALL""", lambda ws: ws["asof_bowl"])
add("Z13_battle_before", "batter_id bowler_id format_group gender start_date:d balls:i runs:i outs:i dots:i fours:i sixes:i matches:i first:d last:d", f"""WITH {_SQUAD}, {_BOTH}
  SELECT one AS batter_id, two AS bowler_id, k.format_group, k.gender, k.start_date, count(*) FILTER (WHERE faced) AS balls, sum(runs_batter) AS runs,
    count(*) FILTER (WHERE striker_credited) AS outs, count(*) FILTER (WHERE faced AND runs_batter = 0) AS dots, count(*) FILTER (WHERE is_four) AS fours,
    count(*) FILTER (WHERE is_six) AS sixes, count(DISTINCT match_id) AS matches, min(f.start_date) AS first, max(f.start_date) AS last
  FROM ask k JOIN balls f ON f.batter_id = one AND f.bowler_id = two AND {_SAME} GROUP BY ALL""", lambda ws: ws["asof_battle"])
add("Z13_pair_before", "a b format_group gender start_date:d stands:i runs:i balls:i best:i fifties:i", f"""WITH {_SQUAD}, {_BOTH}
  SELECT one AS a, two AS b, k.format_group, k.gender, k.start_date, count(*) AS stands, sum(runs) AS runs, sum(balls) AS balls, max(runs) AS best, count(*) FILTER (WHERE runs >= 50) AS fifties
  FROM ask k JOIN partnerships f ON least(p1, p2) = one AND greatest(p1, p2) = two AND {_SAME} GROUP BY ALL""", lambda ws: ws["asof_pair"])
add("Z13_innings_before", f"{_KEYS} innings:i best:i fifties:i spells:i best_wickets:i best_runs:i hauls:i", f"""WITH {_ASKED},
  x AS (SELECT k.*, count(*) AS innings, max(runs) AS best, count(*) FILTER (WHERE runs >= 50) AS fifties FROM ask k JOIN bat_innings f ON f.batter_id = k.person_id AND {_SAME} GROUP BY ALL),
  y AS (SELECT k.*, count(*) AS spells, max(wickets) AS best_wickets, arg_min(runs, -wickets * 1000 + runs) AS best_runs, count(*) FILTER (WHERE wickets >= 4) AS hauls
        FROM ask k JOIN bowl_innings f ON f.bowler_id = k.person_id AND {_SAME} GROUP BY ALL)
  SELECT * FROM x FULL JOIN y USING (person_id, format_group, gender, start_date)""", lambda ws: ws["asof_innings"])
add("Z13_competition_before", "competition format_group gender start_date:d matches:i top_total:i top_score:i best_wickets:i top_stand:i", f"""WITH {_COMP},
  t AS (SELECT k.*, count(*) AS matches FROM ask k JOIN team_results f ON {_IN} GROUP BY ALL),
  i AS (SELECT k.*, max(total_runs) AS top_total FROM ask k JOIN team_results f ON {_IN} JOIN innings USING (match_id) WHERE NOT super_over GROUP BY ALL),
  s AS (SELECT k.*, max(runs) AS top_score FROM ask k JOIN bat_innings f ON {_IN} GROUP BY ALL),
  w AS (SELECT k.*, max(wickets) AS best_wickets FROM ask k JOIN bowl_innings f ON {_IN} GROUP BY ALL),
  p AS (SELECT k.*, max(runs) AS top_stand FROM ask k JOIN partnerships f ON {_IN} GROUP BY ALL)
  SELECT * FROM t LEFT JOIN i USING (competition, format_group, gender, start_date) LEFT JOIN s USING (competition, format_group, gender, start_date)
    LEFT JOIN w USING (competition, format_group, gender, start_date) LEFT JOIN p USING (competition, format_group, gender, start_date)""", lambda ws: ws["asof_competition"])
add("Z13_stand_before", "competition format_group gender start_date:d wicket_no:i top_stand:i", f"""WITH {_COMP}
  SELECT k.*, wicket_no, max(runs) AS top_stand FROM ask k JOIN partnerships f ON {_IN} GROUP BY ALL""", lambda ws: ws["asof_stand"])
add("Z13_board_before", "board competition format_group gender start_date:d place:i person_id value:i", f"""WITH {_COMP},
  v AS (SELECT 'runs' AS board, k.*, batter_id AS person_id, sum(runs) AS value FROM ask k JOIN bat_innings f ON {_IN} GROUP BY ALL
        UNION ALL SELECT 'wickets', k.*, bowler_id, sum(wickets) FROM ask k JOIN bowl_innings f ON {_IN} GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY board, competition, format_group, gender, start_date ORDER BY value DESC, person_id) AS place FROM v QUALIFY place <= 25""", lambda ws: ws["asof_board"])
add("Z13_squad_before", "person_id competition format_group gender start_date:d runs:i wickets:i", f"""WITH {_SQUAD}, ask AS (SELECT DISTINCT person_id, competition, format_group, gender, start_date FROM sq WHERE competition IS NOT NULL),
  f AS (SELECT batter_id AS person_id, competition, format_group, gender, start_date, runs, NULL::BIGINT AS wickets FROM bat_innings UNION ALL
        SELECT bowler_id, competition, format_group, gender, start_date, NULL, wickets FROM bowl_innings)
  SELECT k.*, sum(runs) AS runs, sum(wickets) AS wickets FROM ask k JOIN f ON f.person_id = k.person_id AND {_IN} GROUP BY ALL""", lambda ws: ws["asof_squad"])
add("Z13_unusual_before", "what format_group gender start_date:d n:i v:i", f"""WITH {_DAYS},
  d AS (SELECT format_group, gender, start_date, match_id, innings_no, max(team_dot_streak) AS x FROM balls GROUP BY ALL),
  o AS (SELECT format_group, gender, start_date, match_id, innings_no, over, sum(runs_total) AS x FROM balls GROUP BY ALL)
  SELECT 'dot_streak' AS what, k.*, count(*) AS n, quantile_disc(x, 0.99) AS v FROM ask k JOIN d f ON {_SAME} GROUP BY ALL UNION ALL
  SELECT 'over_runs', k.*, count(*), quantile_disc(x, 0.99) FROM ask k JOIN o f ON {_SAME} GROUP BY ALL""", lambda ws: ws["asof_unusual"])
add("Z13_score_before", "format_group gender start_date:d innings_no:i mark:i n:i score:f", f"""WITH {_DAYS}
  SELECT k.*, innings_no, legal_balls_before AS mark, count(*) AS n, round(sum(score_before) / count(*), 1) AS score FROM ask k JOIN balls f ON {_SAME}
  WHERE legal AND innings_no <= 2 AND legal_balls_before % 6 = 0 GROUP BY ALL""", lambda ws: ws["asof_score"])
add("Z13_wickets_before", "format_group gender start_date:d mark:i wickets:i n:i", f"""WITH {_DAYS}
  SELECT k.*, legal_balls_before AS mark, wickets_before AS wickets, count(*) AS n FROM ask k JOIN balls f ON {_SAME} WHERE legal AND legal_balls_before % 6 = 0 GROUP BY ALL""", lambda ws: ws["asof_wickets"])

# for statements that build on these
for _name, _of in (("batter", "bat"), ("bowler", "bowl"), ("battle", "battle"), ("pair", "pair"), ("unusual", "unusual"), ("score", "score"), ("wickets", "wickets")):
    TABLES[f"asof_{_of}"] = QUERIES[f"Z13_{_name}_before"].sql
