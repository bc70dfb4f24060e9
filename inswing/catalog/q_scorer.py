"""The typed fold over a disordered feed against the batch tables, and the target in force at each ball."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog.registry import add
from inswing.streaming import scorer


def _part(name: str, **renamed: str):
    return lambda ws: ws["typed_state"].filter(F.col("part") == name).withColumnsRenamed(renamed)


add("Z08_batters", "match_id innings:i batter_id runs:i balls:i dots:i fours:i sixes:i", """SELECT match_id, innings_no AS innings, batter_id, sum(runs_batter) AS runs,
    count(*) FILTER (WHERE wides = 0) AS balls, count(*) FILTER (WHERE wides = 0 AND runs_batter = 0) AS dots, count(*) FILTER (WHERE is_four) AS fours, count(*) FILTER (WHERE is_six) AS sixes
    FROM deliveries GROUP BY ALL UNION ALL SELECT DISTINCT match_id, innings_no, non_striker_id, 0, 0, 0, 0, 0 FROM deliveries d
    WHERE NOT EXISTS (FROM deliveries x WHERE x.match_id = d.match_id AND x.innings_no = d.innings_no AND x.batter_id = d.non_striker_id)""", _part("batter", id="batter_id"))
add("Z08_bowlers", "match_id innings:i bowler_id balls:i runs:i wickets:i dots:i fours:i sixes:i spells:i", """SELECT d.match_id, d.innings_no AS innings, d.bowler_id, count(*) FILTER (WHERE legal) AS balls,
    sum(runs_batter + wides + noballs) AS runs, count(*) FILTER (WHERE kind IS NOT NULL AND kind <> 'run out') AS wickets, count(*) FILTER (WHERE legal AND runs_batter + wides + noballs = 0) AS dots,
    count(*) FILTER (WHERE is_four) AS fours, count(*) FILTER (WHERE is_six) AS sixes, any_value(n) AS spells FROM deliveries d
    JOIN (SELECT match_id, innings_no, bowler_id, max(spell_no) AS n FROM spells GROUP BY ALL) s ON s.match_id = d.match_id AND s.innings_no = d.innings_no AND s.bowler_id = d.bowler_id GROUP BY ALL""",
    _part("bowler", id="bowler_id", no="spells"))
add("Z22_overs", "match_id innings:i over:i runs:i balls:i wickets:i", """SELECT match_id, innings_no AS innings, over, sum(runs_total) AS runs, count(*) FILTER (WHERE legal) AS balls,
    count(*) FILTER (WHERE n_wickets > 0) AS wickets FROM deliveries GROUP BY ALL""", _part("over", no="over"))
add("Z22_stands", "match_id innings:i stand:i a b runs:i balls:i", """SELECT match_id, innings_no AS innings, row_number() OVER (PARTITION BY match_id, innings_no ORDER BY first_seq) AS stand, p1 AS a, p2 AS b, runs, balls FROM (
    SELECT match_id, innings_no, part, least(any_value(batter_id), any_value(non_striker_id)) AS p1, greatest(any_value(batter_id), any_value(non_striker_id)) AS p2, min(seq) AS first_seq, sum(runs_total) AS runs, count(*) FILTER (WHERE legal) AS balls FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY match_id, innings_no ORDER BY seq) AS part FROM (SELECT *, CASE WHEN least(batter_id, non_striker_id) || '|' || greatest(batter_id, non_striker_id)
        IS DISTINCT FROM lag(least(batter_id, non_striker_id) || '|' || greatest(batter_id, non_striker_id)) OVER (PARTITION BY match_id, innings_no ORDER BY seq) THEN 1 ELSE 0 END AS fresh FROM deliveries)) GROUP BY ALL)""",
    _part("stand", no="stand", id="a", other="b"))
add("Z22_spells", "match_id innings:i bowler_id spell:i overs:i balls:i runs:i wickets:i", """SELECT match_id, innings_no AS innings, bowler_id, spell_no AS spell, count(*) AS overs, sum(balls) AS balls, sum(runs) AS runs,
    sum(wickets) AS wickets FROM spells GROUP BY ALL""", _part("spell", id="bowler_id", no="spell", extras="overs"))
_REVISED = """rv AS (SELECT i.match_id, i.innings_no, u.place, i.target_runs - u.less AS target, m.scheduled_overs * 6 - u.fewer AS lim
    FROM innings i JOIN matches m USING (match_id) JOIN (VALUES (24, 10, 12, 3), (48, 25, 30, 6)) u(place, less, fewer, every) ON ('0x' || md5(i.match_id)[1:2])::INT % u.every = 0
    WHERE i.target_runs IS NOT NULL)"""
add("Z07_target_in_force", "match_id innings:i seq:i target:i limit_balls:i required:f", f"""WITH {_REVISED},
    b AS (SELECT d.match_id, d.innings_no AS innings, d.seq, score_before, legal_balls_before, any_value(i.target_runs) AS t0, any_value(m.scheduled_overs * 6) AS l0, arg_max(rv.target, rv.place) AS t1, arg_max(rv.lim, rv.place) AS l1
      FROM deliveries d JOIN innings i ON i.match_id = d.match_id AND i.innings_no = d.innings_no JOIN matches m ON m.match_id = d.match_id
      LEFT JOIN rv ON rv.match_id = d.match_id AND rv.innings_no = d.innings_no AND rv.place < d.seq WHERE i.target_runs IS NOT NULL GROUP BY ALL)
    SELECT match_id, innings, seq, coalesce(t1, t0) AS target, coalesce(l1, l0) AS limit_balls,
      CASE WHEN coalesce(l1, l0) > legal_balls_before THEN 6.0 * (coalesce(t1, t0) - score_before) / (coalesce(l1, l0) - legal_balls_before) END AS required FROM b""",
    lambda ws: scorer.targets(ws["ball_feed"].unionByName(scorer.revisions(ws["ball_feed"]))))
add("Z07_revised_end", "match_id innings:i target:i limit_balls:i note", f"""WITH {_REVISED},
    e AS (SELECT match_id, innings_no, max(seq) AS balls FROM deliveries GROUP BY ALL),
    r AS (SELECT rv.match_id, rv.innings_no, arg_max(target, place) AS target, arg_max(lim, place) AS lim FROM rv JOIN e ON e.match_id = rv.match_id AND e.innings_no = rv.innings_no WHERE place <= balls GROUP BY ALL)
    SELECT i.match_id, i.innings_no AS innings, coalesce(r.target, i.target_runs) AS target, coalesce(r.lim, m.scheduled_overs * 6) AS limit_balls,
      CASE WHEN total_runs >= coalesce(r.target, i.target_runs) THEN 'target reached' WHEN total_wickets >= 10 THEN 'all out' WHEN legal_balls >= coalesce(r.lim, m.scheduled_overs * 6) THEN 'overs complete' ELSE 'closed' END AS note
    FROM innings i JOIN matches m USING (match_id) LEFT JOIN r ON r.match_id = i.match_id AND r.innings_no = i.innings_no""", _part("innings"))
add("Z09_innings_lifecycle", "match_id innings:i runs:i balls:i wickets:i extras:i fours:i sixes:i dots:i recent note", """SELECT i.match_id, i.innings_no AS innings, total_runs AS runs, legal_balls AS balls, total_wickets AS wickets,
    x.e AS extras, x.f AS fours, x.s AS sixes, x.d AS dots, x.recent, CASE WHEN total_runs >= target_runs THEN 'target reached' WHEN total_wickets >= 10 THEN 'all out'
      WHEN legal_balls >= m.scheduled_overs * 6 THEN 'overs complete' ELSE 'closed' END AS note
    FROM innings i JOIN matches m USING (match_id) JOIN (SELECT match_id, innings_no, sum(runs_extras) AS e, sum(is_four::INT) AS f, sum(is_six::INT) AS s, count(*) FILTER (WHERE legal AND runs_total = 0) AS d,
      array_to_string(list(CASE WHEN n_wickets > 0 THEN 'W' ELSE runs_total::VARCHAR END ORDER BY seq)[-12:], ' ') AS recent FROM deliveries GROUP BY 1, 2) x ON x.match_id = i.match_id AND x.innings_no = i.innings_no""",
    lambda ws: scorer.replayed(ws, ws["ball_feed"], "typed-plain").filter("part = 'innings'").withColumnRenamed("id", "recent"))
