"""Streaming queries; a fold over a disturbed feed must end where the clean tables do."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from inswing.catalog.registry import add
from inswing.streaming import events as EV, fold, windows as W

_FINAL = "match_id innings:i runs:i wickets:i legal_balls:i extras:i fours:i sixes:i stand_runs:i stand_balls:i fall closed:b"
_SQL = """SELECT i.match_id, i.innings_no AS innings, total_runs AS runs, total_wickets AS wickets, legal_balls, x.e AS extras, x.f AS fours, x.s AS sixes, TRUE AS closed,
   coalesce(p.r, 0) AS stand_runs, coalesce(p.b, 0) AS stand_balls, coalesce(f.fall, '') AS fall
   FROM innings i JOIN (SELECT match_id, innings_no, sum(runs_extras) AS e, sum(is_four::INT) AS f, sum(is_six::INT) AS s FROM deliveries GROUP BY 1, 2) x USING (match_id, innings_no)
   LEFT JOIN (SELECT match_id, innings_no, string_agg((score_before + runs_total)::VARCHAR, ',' ORDER BY seq) AS fall FROM deliveries WHERE n_wickets > 0 GROUP BY 1, 2) f USING (match_id, innings_no)
   LEFT JOIN (SELECT d.match_id, d.innings_no, sum(runs_total) AS r, sum(legal::INT) AS b FROM deliveries d
      LEFT JOIN (SELECT match_id, innings_no, max(seq) AS w FROM deliveries WHERE n_wickets > 0 GROUP BY 1, 2) l ON l.match_id = d.match_id AND l.innings_no = d.innings_no
      WHERE d.seq > coalesce(l.w, 0) GROUP BY 1, 2) p ON p.match_id = i.match_id AND p.innings_no = i.innings_no"""
add("Z08_fold_clean_feed", _FINAL, _SQL, lambda ws: fold.replay(ws, ws["event_log"], "clean"))
add("Z03_fold_disturbed_feed", _FINAL, _SQL, lambda ws: fold.replay(ws, EV.disturbed(ws["event_log"]), "disturbed"))
add("Z02_conflicting_copies", "match_id anomalies:i", "SELECT match_id, sum((seq % 61 = 2 AND NOT (seq % 83 = 7 AND idx > 0))::INT) AS anomalies FROM (SELECT *, row_number() OVER (PARTITION BY match_id, innings_no, over ORDER BY seq) - 1 AS idx FROM deliveries) GROUP BY 1",
    lambda ws: fold.replay(ws, EV.disturbed(ws["event_log"]), "copies").groupBy("match_id").agg(F.max("anomalies").alias("anomalies")))
add("Z20_reconciliation", "match_id innings:i runs:i total_runs:i", "SELECT match_id, 1 AS innings, 0 AS runs, 0 AS total_runs FROM matches WHERE FALSE",
    lambda ws: fold.replay(ws, ws["event_log"], "reconcile").join(ws["innings"].select("match_id", F.col("innings_no").alias("innings"), "total_runs", "total_wickets"), ["match_id", "innings"], "full")
    .filter(~F.col("runs").eqNullSafe(F.col("total_runs")) | ~F.col("wickets").eqNullSafe(F.col("total_wickets"))))
add("Z12_prefix", "match_id runs:i balls:i", """SELECT match_id, sum(runs_total) AS runs, count(*) AS balls FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY innings_no, seq) AS n FROM deliveries) WHERE n <= 150 GROUP BY 1""",
    lambda ws: EV.up_to(ws["event_log"], 150).groupBy("match_id").agg(F.sum(sum(F.col(r) for r in EV.RUNS)).alias("runs"), F.count("*").alias("balls")))
add("S19_event_log", "event_id match_id kind innings:i over:i idx:i wicket_kind", """
  SELECT delivery_id AS event_id, match_id, 'delivery' AS kind, innings_no AS innings, over, row_number() OVER (PARTITION BY match_id, innings_no, over ORDER BY seq) - 1 AS idx, d.kind AS wicket_kind FROM deliveries d
  UNION ALL SELECT match_id || ':meta', match_id, 'match_meta', 0, NULL, NULL, NULL FROM matches UNION ALL SELECT match_id || ':end', match_id, 'match_end', 99, NULL, NULL, NULL FROM matches
  UNION ALL SELECT match_id || ':xi:' || person_id, match_id, 'playing_xi', 0, NULL, NULL, NULL FROM players_in_match
  UNION ALL SELECT match_id || ':' || innings_no || ':start', match_id, 'innings_start', innings_no, -1, NULL, NULL FROM innings UNION ALL SELECT match_id || ':' || innings_no || ':end', match_id, 'innings_end', innings_no, 1000000, NULL, NULL FROM innings""",
    lambda ws: ws["event_log"])


def _spoilt(ws):
    s = F.col("seq")
    return ws["event_log"].withColumns({
        "kind": F.when((F.col("kind") == "delivery") & (s % 31 == 0), "shout").otherwise(F.col("kind")), "batter_id": F.when((F.col("kind") == "delivery") & (s % 37 == 0), F.lit(None)).otherwise(F.col("batter_id")),
        "runs_batter": F.when((F.col("kind") == "delivery") & (s % 41 == 0), -1).otherwise(F.col("runs_batter")), "layer": F.when((F.col("kind") == "delivery") & (s % 43 == 0), "mood")})


_FAULT = """SELECT delivery_id AS event_id, CASE WHEN seq % 31 = 0 THEN 'unknown kind' WHEN seq % 37 = 0 THEN 'missing batter or bowler' WHEN seq % 41 = 0 THEN 'negative runs' WHEN seq % 43 = 0 THEN 'unknown enrichment layer' END AS fault FROM deliveries"""
add("Q34_event_validity", "event_id fault", f"SELECT * FROM ({_FAULT}) WHERE fault IS NOT NULL", lambda ws: EV.split_valid(_spoilt(ws))[1])
add("Z01_valid_events", "event_id", f"SELECT event_id FROM ({_FAULT}) WHERE fault IS NULL", lambda ws: EV.split_valid(_spoilt(ws))[0].filter("kind = 'delivery'"))
add("D36_innings_end_reason", "match_id innings_no:i reason", """SELECT match_id, innings_no, CASE WHEN total_runs >= coalesce(target_runs, 100000) THEN 'target reached' WHEN total_wickets > 9 THEN 'all out'
    WHEN legal_balls >= CASE WHEN match_no % 4 = 0 THEN 300 ELSE 120 END THEN 'overs complete' ELSE 'closed' END AS reason FROM innings""",
    lambda ws: ws["innings"].join(ws["matches"].select("match_id", "scheduled_overs", "balls_per_over"), "match_id").withColumn("reason", EV.end_reason(
        F.col("declared"), F.col("total_runs"), F.col("target_runs"), F.col("total_wickets"), F.col("legal_balls"), F.col("scheduled_overs") * F.col("balls_per_over"))))
add("Z22_tumbling", "start event_type n:i v:f", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2",
    lambda ws: W.tumbling(ws.source("events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
add("Z22_sliding", "start n:i v:f", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(value) AS v FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1""",
    lambda ws: W.sliding(ws.source("events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
add("Z22_sessions", "user_id:i start n:i v:f", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(value) AS v FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    lambda ws: W.sessions(ws.source("events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
add("Z02_stream_unique", "event_type n:i users:i", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    lambda ws: W.stream_unique(ws).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")))
