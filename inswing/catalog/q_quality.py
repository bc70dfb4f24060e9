"""Quality checks on tables with faults planted at fixed places, so that every check has something to find."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog.oracle import TABLES
from inswing.catalog.registry import add
from inswing.operators import quality
from inswing.operators.working import seq_of
from inswing.plans.workspace import Workspace


def _no():
    return F.expr("cast(substring(match_id, 2) as bigint)")


def faulty(ws: Workspace) -> dict:
    d = ws["deliveries"].withColumn("no", _no())
    s, wkt = F.col("seq"), F.col("n_wickets") > 0
    d = d.withColumns({
        "runs_total": F.col("runs_total") + F.when(s % 97 == 0, 3).otherwise(0),
        "runs_extras": F.col("runs_extras") + F.when(s % 89 == 0, 1).otherwise(0),
        "wides": F.when(wkt & (s % 4 == 0), 1).otherwise(F.col("wides")),
        "noballs": F.when(((F.col("wides") == 1) & (s % 50 == 0)) | (wkt & (s % 5 == 0)), 1).otherwise(F.col("noballs")),
        "non_boundary": F.col("is_four") & (s % 60 == 0),
        "bowler_id": F.when(s % 101 == 0, F.col("batter_id")).otherwise(F.col("bowler_id")),
        "bowler": F.when(s % 101 == 0, F.col("batter")).otherwise(F.col("bowler")),
        "required_rate": F.col("required_rate") + F.when(s % 103 == 0, 1).otherwise(0),
        "legal": F.col("legal") | (s % 53 == 0),
        "runs_required": F.when(s % 107 == 0, 0).otherwise(F.col("runs_required")),
    })
    d = d.unionByName(d.filter("seq = 7 and no % 10 = 0"))
    m = ws["matches"].withColumn("no", _no())
    m = m.withColumns({
        "winner": F.when(F.col("no") % 70 == 3, "Nobody").otherwise(F.col("winner")),
        "gender": F.when(F.col("no") % 80 == 4, F.lit(None)).otherwise(F.col("gender"))})
    m = m.unionByName(m.filter("no % 50 = 0")).unionByName(
        m.filter("no % 60 = 1").withColumn("match_id", F.concat(F.lit("x"), "match_id")))
    i = ws["innings"].withColumn("no", _no())
    i = i.withColumns({
        "batting_team": F.when(F.col("no") % 75 == 5, "Nobody").otherwise(F.col("batting_team")),
        "target_runs": F.col("target_runs") + F.when(F.col("no") % 65 == 6, 2).otherwise(0)})
    i = i.unionByName(i.filter("no % 60 = 1").withColumn("match_id", F.concat(F.lit("x"), "match_id")))
    w = ws["wickets"].withColumn("no", _no()).withColumn("s", seq_of(F.col("delivery_id")))
    w = w.withColumns({
        "player_out_id": F.when(F.col("s") % 31 == 0, "zz").otherwise(F.col("player_out_id")),
        "bowler_credited": F.col("bowler_credited") | (F.col("s") % 2 == 0)})
    w = w.unionByName(w.filter("s % 29 = 0").withColumn("wicket_idx", F.lit(1))).unionByName(
        w.filter("no % 25 = 7").withColumn("wicket_idx", F.lit(2)))
    f = ws["wicket_fielders"].withColumn("s", seq_of(F.col("delivery_id"))).filter("s % 13 <> 0")
    f = f.withColumn("fielder_id", F.when(F.col("s") % 17 == 0, "zz").otherwise(F.col("fielder_id")))
    p = ws["players_in_match"].withColumn("no", _no()).withColumn("p", F.regexp_extract("person_id", r"p(\d+)$", 1).cast("int"))
    p = p.filter("not (p = 1 and no % 33 = 0)").withColumns({
        "identity_resolved": ~((F.col("p") == 3) & (F.col("no") % 20 == 0)),
        "name": F.when((F.col("p") == 2) & (F.col("no") % 30 == 0), F.concat(F.lit("X "), "name")).otherwise(F.col("name"))})
    return {"deliveries": d, "matches": m, "innings": i, "wickets": w, "wicket_fielders": f, "players_in_match": p,
            "replacements": ws["replacements"], "dismissals": ws["dismissals"]}


TABLES["fd"] = """SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE seq = 7 AND match_no % 10 = 0"""
TABLES["f0"] = """SELECT match_id, match_no, innings_no, seq, delivery_id, over, batter_id, batter, non_striker_id, chasing, balls_remaining, runs_batter, byes, legbyes, penalty, n_wickets,
  runs_total + CASE WHEN seq % 97 = 0 THEN 3 ELSE 0 END AS runs_total, runs_extras + CASE WHEN seq % 89 = 0 THEN 1 ELSE 0 END AS runs_extras,
  CASE WHEN n_wickets > 0 AND seq % 4 = 0 THEN 1 ELSE wides END AS wides,
  CASE WHEN (wides = 1 AND seq % 50 = 0) OR (n_wickets > 0 AND seq % 5 = 0) THEN 1 ELSE noballs END AS noballs, is_four AND seq % 60 = 0 AS non_boundary,
  CASE WHEN seq % 101 = 0 THEN batter_id ELSE bowler_id END AS bowler_id, CASE WHEN seq % 101 = 0 THEN batter ELSE bowler END AS bowler,
  required_rate + CASE WHEN seq % 103 = 0 THEN 1 ELSE 0 END AS required_rate, legal OR seq % 53 = 0 AS legal,
  CASE WHEN seq % 107 = 0 THEN 0 ELSE runs_required END AS runs_required FROM deliveries"""
TABLES["fm"] = """SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE match_no % 50 = 0 UNION ALL SELECT * REPLACE ('x' || match_id AS match_id) FROM m0 WHERE match_no % 60 = 1"""
TABLES["m0"] = """SELECT * REPLACE (CASE WHEN match_no % 70 = 3 THEN 'Nobody' ELSE winner END AS winner, CASE WHEN match_no % 80 = 4 THEN NULL ELSE gender END AS gender) FROM matches"""
TABLES["fi"] = """SELECT * FROM i0 UNION ALL SELECT * REPLACE ('x' || match_id AS match_id) FROM i0 WHERE match_no % 60 = 1"""
TABLES["i0"] = """SELECT * REPLACE (CASE WHEN match_no % 75 = 5 THEN 'Nobody' ELSE batting_team END AS batting_team, target_runs + CASE WHEN match_no % 65 = 6 THEN 2 ELSE 0 END AS target_runs) FROM innings"""
TABLES["fw"] = """SELECT * FROM w0 UNION ALL SELECT * REPLACE (1 AS wicket_idx) FROM w0 WHERE seq % 29 = 0 UNION ALL SELECT * REPLACE (2 AS wicket_idx) FROM w0 WHERE substr(match_id, 2)::INT % 25 = 7"""
TABLES["w0"] = """SELECT * REPLACE (CASE WHEN seq % 31 = 0 THEN 'zz' ELSE player_out_id END AS player_out_id, bowler_credited OR seq % 2 = 0 AS bowler_credited) FROM wickets"""
TABLES["ff"] = """SELECT * REPLACE (CASE WHEN split_part(delivery_id, ':', 3)::INT % 17 = 0 THEN 'zz' ELSE fielder_id END AS fielder_id) FROM wicket_fielders WHERE split_part(delivery_id, ':', 3)::INT % 13 <> 0"""
TABLES["fp"] = """SELECT * REPLACE (NOT (p = 3 AND substr(match_id, 2)::INT % 20 = 0) AS identity_resolved, CASE WHEN p = 2 AND substr(match_id, 2)::INT % 30 = 0 THEN 'X ' || name ELSE name END AS name)
  FROM players_in_match WHERE NOT (p = 1 AND substr(match_id, 2)::INT % 33 = 0)"""
for _later, _first in (("fd", "f0"), ("fm", "m0"), ("fi", "i0"), ("fw", "w0")):  # definition order
    TABLES[_later] = TABLES.pop(_later)

XI = "SELECT match_id, team, person_id FROM fp"
OVERS = """(SELECT d.match_id, d.innings_no, d.over, sum(d.legal::INT) AS legal_balls, min(b) AS bpo FROM fd d
  JOIN (SELECT match_id, min(balls_per_over) AS b FROM fm GROUP BY match_id) USING (match_id) GROUP BY ALL)"""
SQL = {
    "dup_match_id": ("match_id n:i", "SELECT match_id, count(*) AS n FROM fm GROUP BY match_id HAVING count(*) > 1"),
    "dup_match_fingerprint": ("a b start_date:d venue gender totals n:i first_id", """SELECT least(team1, team2) AS a, greatest(team1, team2) AS b, start_date, venue, gender, totals,
        count(*) AS n, min(match_id) AS first_id FROM fm JOIN (SELECT match_id, string_agg(total_runs || '/' || total_wickets, ',' ORDER BY innings_no) AS totals FROM fi GROUP BY match_id) USING (match_id)
        GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) > 1"""),
    "dup_delivery_id": ("delivery_id n:i", "SELECT delivery_id, count(*) AS n FROM fd GROUP BY 1 HAVING count(*) > 1"),
    "dup_delivery_seq": ("match_id innings_no:i seq:i n:i", "SELECT match_id, innings_no, seq, count(*) AS n FROM fd GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "runs_total_sum": ("delivery_id runs_total:i", "SELECT * FROM fd WHERE runs_batter + runs_extras <> runs_total"),
    "innings_total": ("match_id innings_no:i total_runs:i recomputed:i", """SELECT i.match_id, i.innings_no, total_runs, r AS recomputed FROM fi i
        JOIN (SELECT match_id, innings_no, sum(runs_total) AS r FROM fd GROUP BY 1, 2) USING (match_id, innings_no) WHERE r <> total_runs"""),
    "extras_sum": ("delivery_id", "SELECT delivery_id FROM fd WHERE wides + noballs + byes + legbyes + penalty <> runs_extras"),
    "extras_combo": ("delivery_id", "SELECT delivery_id FROM fd WHERE least(wides, noballs) > 0"),
    "boundary_four_six": ("delivery_id runs_batter:i", "SELECT * FROM fd WHERE non_boundary AND runs_batter IN (4, 6)"),
    "wickets_per_innings": ("match_id innings_no:i n:i", "SELECT match_id, innings_no, count(*) AS n FROM fw GROUP BY 1, 2 HAVING count(*) > 10"),
    "wickets_vs_xi": ("match_id innings_no:i n:i xi:i", f"""SELECT * FROM (SELECT match_id, innings_no, count(*) AS n FROM fw GROUP BY 1, 2) JOIN fi USING (match_id, innings_no)
        JOIN (SELECT match_id, team AS batting_team, count(*) AS xi FROM fp GROUP BY 1, 2) USING (match_id, batting_team) WHERE n >= xi"""),
    "legal_per_over": ("match_id innings_no:i over:i legal_balls:i", f"SELECT * FROM {OVERS} WHERE legal_balls > bpo"),
    "short_over_mid_innings": ("match_id innings_no:i over:i legal_balls:i last_over:i", f"""SELECT * FROM (SELECT *, max(over) OVER (PARTITION BY match_id, innings_no) AS last_over
        FROM {OVERS}) WHERE over < last_over AND legal_balls < bpo"""),
    "identity_unresolved": ("match_id team name", "SELECT * FROM fp WHERE NOT identity_resolved"),
    "identity_multi_name": ("person_id n:i name_list", """SELECT person_id, count(DISTINCT name) AS n, array_to_string(list(DISTINCT name ORDER BY name), ',') AS name_list
        FROM fp GROUP BY 1 HAVING count(DISTINCT name) > 1"""),
    "batter_not_in_xi": ("match_id name", f"SELECT DISTINCT d.match_id, d.batter AS name FROM fd d JOIN fi i USING (match_id, innings_no) WHERE (d.match_id, i.batting_team, d.batter_id) NOT IN ({XI})"),
    "bowler_not_in_xi": ("match_id name", f"SELECT DISTINCT d.match_id, d.bowler AS name FROM fd d JOIN fi i USING (match_id, innings_no) WHERE (d.match_id, i.bowling_team, d.bowler_id) NOT IN ({XI})"),
    "innings_team": ("match_id batting_team", "SELECT i.match_id, i.batting_team FROM fi i JOIN (SELECT DISTINCT match_id, team1, team2 FROM fm) USING (match_id) WHERE batting_team <> team1 AND batting_team <> team2"),
    "winner_team": ("match_id winner", "SELECT match_id, winner FROM fm WHERE winner NOT IN (team1, team2)"),
    "match_required": ("match_id", "SELECT match_id FROM fm WHERE coalesce(gender, '') = ''"),
    "player_out_on_ball": ("delivery_id player_out_id", "SELECT w.delivery_id, w.player_out_id FROM fw w JOIN fd d USING (delivery_id) WHERE NOT list_contains([d.batter_id, d.non_striker_id], w.player_out_id)"),
    "bowler_kind_non_striker": ("delivery_id kind", "SELECT delivery_id, kind FROM fw WHERE bowler_credited > striker_out"),
    "dismissed_twice": ("match_id innings_no:i player_out_id n:i", "SELECT match_id, innings_no, player_out_id, count(*) AS n FROM fw GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "wicket_on_wide_kind": ("delivery_id kind", "SELECT w.delivery_id, w.kind FROM fw w JOIN fd d USING (delivery_id) WHERE d.wides > 0 AND w.kind NOT IN ('stumped', 'run out')"),
    "wicket_on_noball_kind": ("delivery_id kind", "SELECT w.delivery_id, w.kind FROM fw w JOIN fd d USING (delivery_id) WHERE d.noballs > 0 AND w.kind <> 'run out'"),
    "fielder_required": ("delivery_id kind", "SELECT delivery_id, kind FROM fw WHERE kind IN ('caught', 'stumped') AND (delivery_id, wicket_idx) NOT IN (SELECT delivery_id, wicket_idx FROM ff)"),
    "fielder_not_in_xi": ("delivery_id fielder_id", f"SELECT f.delivery_id, f.fielder_id FROM ff f JOIN fi i USING (match_id, innings_no) WHERE NOT f.substitute AND (f.match_id, i.bowling_team, f.fielder_id) NOT IN ({XI})"),
    "keeper_unresolved": ("delivery_id fielder", "SELECT delivery_id, fielder FROM dismissals WHERE route = 'CAUGHT_KEEPER_STATUS_UNKNOWN'"),
    "target_mismatch": ("match_id target_runs:i expected:i", """SELECT * FROM (SELECT match_id, max(target_runs) AS target_runs, max(total_runs) FILTER (WHERE innings_no = 1) + 1 AS expected FROM fi GROUP BY 1)
        WHERE target_runs <> expected AND match_id IN (SELECT match_id FROM fm WHERE method IS NULL)"""),
    "chase_result": ("match_id batting_team total_runs:i target_runs:i winner", """SELECT i.match_id, i.batting_team, i.total_runs, i.target_runs, m.winner FROM fi i JOIN fm m USING (match_id)
        WHERE i.innings_no = 2 AND i.total_runs >= i.target_runs AND m.winner IS DISTINCT FROM i.batting_team AND m.result IS NULL"""),
    "chase_overshoot": ("match_id delivery_id", "SELECT match_id, delivery_id FROM fd WHERE chasing AND runs_required < 1"),
    "context_required_rate": ("delivery_id", "SELECT delivery_id FROM fd WHERE abs(required_rate - 6e0 * runs_required / balls_remaining) > 1e-6"),
}
for _n, _c in enumerate(quality.CHECKS, 1):
    add(f"Q{_n:02d}_{_c.id}", SQL[_c.id][0], SQL[_c.id][1], lambda ws, c=_c: c.rows(faulty(ws)))
_counts = "\nUNION ALL ".join(f"SELECT '{c.id}' AS id, '{c.severity}' AS severity, count(*) AS violations FROM ({SQL[c.id][1]})" for c in quality.CHECKS)
add("Q00_report", "id severity violations:i status", f"SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE severity END AS status FROM ({_counts})",
    lambda ws: quality.report(faulty(ws), ws.stage))


def _tagged(ws):
    """Provenance of each dismissal route, with faults planted by ball number."""
    s = F.col("s")
    return ws["dismissals"].withColumn("s", seq_of(F.col("delivery_id"))).select(
        F.when((s % 7 == 0), "ILLUSTRATIVE").when(s % 11 == 0, "GUESSED").otherwise(F.col("route_prov")).alias("prov"),
        F.col("delivery_id").alias("subject_id"), F.when(s % 5 > 0, F.col("source_id")).alias("prov_source_id"),
        F.col("route_method").alias("prov_method"), F.when(s % 13 > 0, "v1").alias("prov_method_version"),
        (F.col("route_confidence") + F.when(s % 3 == 0, 1).otherwise(0)).alias("prov_confidence"))


add("Q33_provenance_rules", "subject_id fault", """
  SELECT delivery_id AS subject_id, fault FROM (SELECT delivery_id, CASE WHEN seq % 7 = 0 THEN 'illustrative row tied to a subject' WHEN seq % 11 = 0 THEN 'unknown class'
    WHEN route_prov = 'OBSERVED' AND seq % 5 = 0 THEN 'required field missing' WHEN route_prov = 'DERIVED' AND seq % 13 = 0 THEN 'required field missing'
    WHEN route_confidence + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END > 1 THEN 'confidence out of range' END AS fault
  FROM dismissals) WHERE fault IS NOT NULL""", lambda ws: quality.provenance_faults(_tagged(ws)))
add("Q35_capability_deliveries", "format_group gender n:i bowler_family_pct:f batter_hand_pct:f bowler_arm_pct:f",
    """SELECT format_group, gender, count(*) AS n, 100e0 * count(bowler_family) / count(*) AS bowler_family_pct, 100e0 * count(batter_hand) / count(*) AS batter_hand_pct,
       100e0 * count(bowler_arm) / count(*) AS bowler_arm_pct FROM balls GROUP BY 1, 2""",
    lambda ws: quality.known_share(ws["balls"], ["bowler_family", "batter_hand", "bowler_arm"], ["format_group", "gender"]))
add("Q36_metadata_coverage", "n:i batting_hand_pct:f bowling_style_pct:f bowling_family_pct:f",
    """SELECT count(*) AS n, 100e0 * count(batting_hand) / count(*) AS batting_hand_pct, 100e0 * count(bowling_style) / count(*) AS bowling_style_pct,
       100e0 * count(bowling_family) / count(*) AS bowling_family_pct FROM player_profile""",
    lambda ws: quality.known_share(ws["player_profile"], ["batting_hand", "bowling_style", "bowling_family"], []))
