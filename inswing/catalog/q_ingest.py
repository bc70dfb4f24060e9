"""Ingest: the tables written as documents and read back must be the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog.registry import add
from inswing.plans.workspace import relation
from inswing.sources import documents as D


@relation("match_documents", large_rows=True)
def match_documents(ws):
    return D.to_documents(ws)


def _table(name):
    return lambda ws: D.ingest(ws["match_documents"])[name]


add("S03_ingest_deliveries", "delivery_id over:i ball_label batter_id bowler_id non_striker_id runs_total:i score_before:i wickets_before:i legal_balls_before:i batter_runs_before:i batter_balls_before:i "
    "partnership_runs_before:i partnership_balls_before:i phase target_runs:i balls_remaining:i required_rate:f", "SELECT *, over || '.' || ball_in_over AS ball_label FROM deliveries", _table("deliveries"))
add("S03_ingest_matches", "match_id gender format_group team_type competition season start_date:d venue team1 team2 winner result method win_by_runs:i win_by_wickets:i event_stage", "SELECT * FROM matches", _table("matches"))
add("S03_ingest_innings", "match_id innings_no:i batting_team bowling_team target_runs:i total_runs:i total_wickets:i legal_balls:i", "SELECT * FROM innings", _table("innings"))
add("S03_ingest_wickets", "delivery_id wicket_idx:i player_out_id kind bowler_credited:b striker_out:b", "SELECT * FROM wickets", _table("wickets"))
add("S03_ingest_fielders", "delivery_id wicket_idx:i fielder_idx:i fielder_id substitute:b", "SELECT * FROM wicket_fielders", _table("wicket_fielders"))
add("S03_ingest_players", "match_id team person_id name identity_resolved:b", "SELECT * FROM players_in_match", _table("players_in_match"))


def _messy(ws):
    """Documents with copies, faults and unknown keys planted by match number."""
    d = ws["match_documents"].withColumn("no", F.regexp_extract("source_ref", r"m(\d+)\.json", 1).cast("int"))
    body = F.when(F.col("no") % 20 == 3, F.replace("content", F.lit('"gender"'), F.lit('"sex"'))).when(F.col("no") % 20 == 7, F.replace("content", F.lit('"dates"'), F.lit('"days"'))) \
        .when(F.col("no") % 20 == 11, F.replace("content", F.lit('"batter":"Amar'), F.lit('"hitter":"Amar'))).otherwise(F.col("content"))
    d = d.withColumn("content", body)
    return d.unionByName(d.filter("no % 10 = 4").withColumn("source_ref", F.concat(F.lit("zcopy/"), "source_ref"))).drop("no")


add("S06_quarantine", "match_id reason", """SELECT match_id, CASE match_no % 20 WHEN 3 THEN 'missing gender' WHEN 7 THEN 'missing dates' ELSE 'batter or bowler missing' END AS reason FROM matches
    WHERE match_no % 20 IN (3, 7, 11) UNION ALL SELECT match_id, 'duplicate match' FROM matches WHERE match_no % 10 = 4""", lambda ws: D.quarantine(_messy(ws)))
add("S05_first_copy_wins", "match_id source_ref", "SELECT match_id, match_id || '.json' AS source_ref FROM matches WHERE match_no % 20 NOT IN (3, 7, 11)", lambda ws: D.judged(_messy(ws)).filter("reason is null"))
add("S07_schema_drift", "level key n:i", """SELECT 'info' AS level, 'sex' AS key, count(*) AS n FROM matches WHERE match_no % 20 = 3 UNION ALL SELECT 'info', 'days', count(*) FROM matches WHERE match_no % 20 = 7
    UNION ALL SELECT 'delivery', 'hitter', count(*) FROM deliveries WHERE match_no % 20 = 11 AND batter LIKE 'Amar %'""", lambda ws: D.drift(_messy(ws)))
add("S08_field_presence", "path n:i documents:i", None, lambda ws: D.field_presence(ws["match_documents"]))
add("S10_fallback_identity", "name person_id", "SELECT DISTINCT name, 'unres:' || sha1(name)[1:10] AS person_id FROM players_in_match",
    lambda ws: ws["players_in_match"].select("name").distinct().withColumn("person_id", D.person_id(F.create_map().cast("map<string,string>"), F.col("name"))))
add("S04_document_checksums", "source_ref ok:b", "SELECT match_id || '.json' AS source_ref, TRUE AS ok FROM matches", lambda ws: ws["match_documents"].withColumn("ok", F.sha2("content", 256) == F.col("sha256")))
