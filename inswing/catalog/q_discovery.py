"""Discovery, edges, search, metadata and question templates with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog import sqlstats as S
from inswing.catalog.q_players import APP  # noqa: F401  (shared text)
from inswing.catalog.q_records import BOARD, BOTH_MAJOR, board_sql
from inswing.catalog.registry import add
from inswing.operators import discovery as G, people as PP, players as P
from inswing.operators.records import leaderboard
from inswing.plans.filters import Filters

_SUM = "sum(faced::INT) AS n, sum(runs_batter) AS s, sum(runs_batter * runs_batter) AS q, sum(striker_credited::INT) AS outs"
_CAND = f"""(SELECT *, n * bo / bn AS expected, {S.poisson_tail('outs', '(n * bo::DOUBLE / bn)')} AS tail, s::DOUBLE / n - bs::DOUBLE / bn AS d, {S.mean_se('s', 'q', 'n', 'bs', 'bq', 'bn')} AS se
  FROM (SELECT batter_id, format_group, gender, bowler_id, {_SUM} FROM balls WHERE {BOTH_MAJOR} GROUP BY 1, 2, 3, 4 HAVING sum(faced::INT) >= 20)
  JOIN (SELECT batter_id, format_group, gender, sum(faced::INT) AS bn, sum(runs_batter) AS bs, sum(runs_batter * runs_batter) AS bq, sum(striker_credited::INT)::DOUBLE AS bo FROM balls WHERE {BOTH_MAJOR} GROUP BY 1, 2, 3 HAVING sum(faced::INT) >= 80)
  USING (batter_id, format_group, gender))"""
add("G01_matchup_candidates", "batter_id bowler_id format_group gender what n:i outs:i expected:f p:f", f"""SELECT *, CASE WHEN what = 'dismissals' THEN tail ELSE pz END AS p FROM (
    SELECT *, CASE WHEN outs >= 2 AND outs >= 1.5 * expected THEN 'dismissals' WHEN d > 0 AND pz < 0.0027 AND outs <= greatest(1, expected * 0.5) AND n >= 30 THEN 'scoring' END AS what FROM (SELECT *, {S.two_sided('(d / se)')} AS pz FROM {_CAND})) WHERE what IS NOT NULL""",
    lambda ws: G.matchup_candidates(ws, 20, 80, 2, 1.5))
_ROUTES = "(" + ", ".join(f"'{r}'" for r in G.ROUTES) + ")"
add("G02_route_candidates", "player_out_id gender format_group route k:i n:i share:f p:f", f"""
  SELECT *, least(1e0, list_sum(list_transform(range(k::INT, n::INT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share))))) AS p FROM (
    SELECT *, sum(k) OVER (PARTITION BY player_out_id, format_group) AS n FROM (SELECT player_out_id, gender, format_group, route, count(*) AS k FROM dis WHERE counts_as_dismissal AND {BOTH_MAJOR} GROUP BY 1, 2, 3, 4))
  JOIN (SELECT gender, format_group, route, 1e0 * count(*) / sum(count(*)) OVER (PARTITION BY gender, format_group) AS share FROM dis WHERE counts_as_dismissal AND batter_position <= 7 AND {BOTH_MAJOR} GROUP BY 1, 2, 3)
  USING (gender, format_group, route) WHERE route IN {_ROUTES} AND n >= 15 AND k >= 3 AND 1e0 * k / n >= 1.4 * share""", lambda ws: G.route_candidates(ws, 15, 3, 1.4))
add("G03_partnership_candidates", "gender format_group p1 p2 stands:i average:f typical:f p:f", f"""SELECT *, {S.two_sided('((average - typical) / (typical / sqrt(w1)))')} AS p FROM (
    SELECT *, runs::DOUBLE / w1 AS average FROM (SELECT gender, format_group, p1, p2, count(*) AS stands, sum(balls) AS balls, sum(runs) AS runs, greatest(1, sum((ended = 'wicket')::INT)) AS w1 FROM partnerships WHERE {BOTH_MAJOR} GROUP BY 1, 2, 3, 4)
    JOIN (SELECT gender, format_group, sum(runs)::DOUBLE / sum((ended = 'wicket')::INT) AS typical FROM partnerships WHERE {BOTH_MAJOR} GROUP BY 1, 2) USING (gender, format_group))
  WHERE stands >= 3 AND balls >= 30 AND average >= 1.2 * typical""", lambda ws: G.partnership_candidates(ws, 3, 30, 1.2))
_YEARS = f"""(SELECT *, s::DOUBLE / n - sp::DOUBLE / n_past AS d, {S.mean_se('s', 'q', 'n', 'sp', 'qp', 'n_past')} AS se FROM (
    SELECT *, row_number() OVER (PARTITION BY batter_id, format_group, gender ORDER BY year DESC) AS pick FROM (
      SELECT *, sum(n) OVER w AS n_past, sum(s) OVER w AS sp, sum(q) OVER w AS qp, max(year) OVER () AS latest FROM (
        SELECT batter_id, format_group, gender, year, count(*) AS n, sum(runs_batter) AS s, sum(runs_batter * runs_batter) AS q FROM balls WHERE faced AND {BOTH_MAJOR} GROUP BY 1, 2, 3, 4)
      WINDOW w AS (PARTITION BY batter_id, format_group, gender ORDER BY year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE year >= latest - 1 AND n >= 20) WHERE pick = 1 AND n_past >= 30)"""
_CHANGED = f"(SELECT *, 100 * d AS change, {S.two_sided('(d / se)')} AS p FROM {_YEARS} WHERE abs(d) >= 0.5 * se AND abs(d) >= 0.05)"
_years = lambda ws: G.year_candidates(ws, 20, 30, 0.5, 0.05, 2000)
add("G05_year_candidates", "batter_id format_group gender year:i n:i n_past:i change:f p:f", f"SELECT * FROM {_CHANGED}", _years)
add("G06_within_reach", "competition what person_id v:i lead:i", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competition, what ORDER BY v DESC, person_id) AS rank, max(v) OVER (PARTITION BY competition, what) AS lead, max(last) OVER (PARTITION BY competition) AS latest FROM (
    SELECT competition, batter_id AS person_id, 'runs' AS what, sum(runs_batter) AS v, max(year) AS last FROM balls WHERE competition IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT competition, batter_id, 'sixes', sum(is_six::INT), max(year) FROM balls WHERE competition IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 6 AND last = latest AND v < lead AND lead - v <= 0.2 * lead""",
    lambda ws: G.within_reach(ws, ("League A", "Cup"), 0.2))
add("G10_did_not_know", "batter_id format_group year:i", f"""WITH t AS (SELECT * FROM {_CHANGED})
  SELECT * FROM t JOIN (SELECT format_group, max(p) AS edge FROM (SELECT format_group, p, count(*) OVER (PARTITION BY format_group ORDER BY p) AS r, count(*) OVER (PARTITION BY format_group) AS m FROM t) WHERE p <= 0.4 * r / m GROUP BY 1) USING (format_group) WHERE p <= edge""",
    lambda ws: G.did_not_know(ws.stage(_years(ws), "years"), ["format_group"], 0.4))
add("G17_player_index", "person_id what rank:i key", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, what ORDER BY v DESC, t, key) AS rank FROM (
    SELECT batter_id AS person_id, 'innings' AS what, match_id || '|' || innings_no AS key, runs AS v, balls AS t FROM bat_innings UNION ALL SELECT bowler_id, 'spell', match_id || '|' || innings_no, wickets, runs FROM bowl_innings
    UNION ALL SELECT a, 'partner', b, sum(runs), 0 FROM (SELECT p1 AS a, p2 AS b, runs FROM partnerships UNION ALL SELECT p2, p1, runs FROM partnerships) GROUP BY 1, 3)) WHERE rank <= CASE what WHEN 'innings' THEN 3 WHEN 'spell' THEN 2 ELSE 4 END""", G.player_index)
add("G15_edges", "src_type src_key relation dst_type dst_key rank:i", None, G.edges)
add("G20_tension", "match_id innings_no:i delivery_id tension:f", """SELECT match_id, innings_no, arg_max(delivery_id, (t, seq)) AS delivery_id, max(t) AS tension FROM (SELECT *, round(
    CASE WHEN chasing AND balls_left > 0 AND balls_left <= 24 AND runs_required > 0 THEN 3e0 + greatest(0, 2 - 2 * abs(1e0 * runs_required / balls_left - 1.4e0)) ELSE 0 END
    + CASE WHEN batter_runs_before % 50 >= 44 AND batter_runs_before < 100 THEN 2.5e0 ELSE 0 END + CASE WHEN phase = 'death' THEN 1 ELSE 0 END, 9) AS t FROM balls) GROUP BY 1, 2""", G.tension)

# ---- search
_STOP = ", ".join(f"'{s}'" for s in G.STOP)
_tok = lambda e: f"list_filter(list_distinct(regexp_extract_all(lower({e}), '[a-z0-9''*/.-]+')), lambda x: x NOT IN ({_STOP}))"
_ROWS = f"""(SELECT kind, key, weight, unnest({_tok('text')}) AS token FROM (
  SELECT 'player' AS kind, person_id AS key, name || ' ' || name[1] || ' ' || split_part(name, ' ', 2) AS text, matches AS weight FROM player_profile
  UNION ALL SELECT 'team', k, k, count(*) FROM (SELECT unnest([ta, tb]) AS k FROM team_results) GROUP BY 2 UNION ALL SELECT 'competition', competition, competition, count(*) FROM team_results WHERE competition IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'match', match_id, team1 || ' ' || team2 || ' ' || season || ' ' || venue, 1 FROM team_results))"""
add("H01_search_rows", "kind key token weight:i", f"SELECT * FROM {_ROWS}", G.search_rows)
_QS = "(SELECT person_id AS query_id, name || ' ' || person_id[2] AS text FROM player_profile)"


def _queries(ws):
    """One question per player: the name and the number of a side."""
    return ws["player_profile"].select(F.col("person_id").alias("query_id"), F.concat_ws(" ", "name", F.substring("person_id", 2, 1)).alias("text"))


add("H03_search", "query_id kind rank:i key score:f", f"""WITH r AS (FROM {_ROWS}), q AS (SELECT query_id, len(ts) AS need, unnest(ts) AS q FROM (SELECT query_id, {_tok('text')} AS ts FROM {_QS})),
  h AS (SELECT query_id, need, kind, key, q, max(CASE WHEN token = q THEN 1e0 ELSE 0.75e0 END) AS s, max(weight) AS weight FROM q JOIN r ON token = q OR (length(q) >= 3 AND starts_with(token, q)) GROUP BY 1, 2, 3, 4, 5),
  g AS (SELECT query_id, need, kind, key, sum(s) / need + log10(1 + max(weight)) / 10 AS score FROM h GROUP BY 1, 2, 3, 4 HAVING count(*) >= greatest(1, need - CASE WHEN need >= 3 THEN 1 ELSE 0 END))
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY round(score, 9) DESC, key) AS rank FROM g) WHERE rank <= 5""", lambda ws: G.search(_queries(ws), ws.stage(G.search_rows(ws), "search_rows")))
add("X15_tokens", "doc_id:i n:i", f"SELECT doc_id, len({_tok('text')}) AS n FROM documents", lambda ws: ws.source("documents").select("doc_id", F.size(G.tokens(F.col("text"))).alias("n")))
add("H04_query_features", "item_id:i versus:b figures:b year", """SELECT item_id, regexp_matches(lower(text), '\\b(v|vs|versus|against)\\b') AS versus, regexp_matches(text, '\\b[0-9]{1,2}/[0-9]{1,3}\\b') AS figures, nullif(regexp_extract(text, '\\b((19|20)[0-9]{2})\\b', 1), '') AS year FROM benchmark""",
    lambda ws: ws.source("benchmark").select("item_id", F.lower("text").rlike(r"\b(v|vs|versus|against)\b").alias("versus"), F.col("text").rlike(r"\b[0-9]{1,2}/[0-9]{1,3}\b").alias("figures"), F.nullif(F.regexp_extract("text", r"\b((19|20)[0-9]{2})\b", 1), F.lit("")).alias("year")))
add("H05_alias_resolution", "alias person_id ambiguous:b", """SELECT alias, arg_max(person_id, lpad(m::VARCHAR, 9, '0') || person_id) AS person_id, count(*) > 1 AND max(m) < 3 * coalesce(max(m) FILTER (WHERE r = 2), 0) AS ambiguous FROM (
    SELECT *, row_number() OVER (PARTITION BY alias ORDER BY m DESC, person_id DESC) AS r FROM (SELECT split_part(name, ' ', 2) AS alias, person_id, matches AS m FROM player_profile)) GROUP BY 1""",
    G.alias_resolution)

# ---- metadata
_OBS = "(SELECT person_id, 'bowling_style' AS field, style_text AS value FROM people WHERE style_text IS NOT NULL UNION ALL SELECT person_id, 'batting_hand', batting_hand FROM people WHERE batting_hand IS NOT NULL)"
_LAB = "CASE value WHEN 'Right-arm fast-medium' THEN '{0}' WHEN 'Slow left-arm orthodox' THEN '{1}' WHEN 'Legbreak' THEN '{2}' WHEN 'Left-arm fast' THEN '{3}' END"
_STY = f"(SELECT *, {_LAB.format('Right-arm fast-medium', 'Left-arm orthodox', 'Leg-spin', 'Left-arm fast')} AS label, {_LAB.format('right', 'left', 'right', 'left')} AS arm, {_LAB.format('pace', 'spin', 'spin', 'pace')} AS family FROM {_OBS})"
add("N01_style_rules", "person_id value label arm family", f"SELECT * FROM {_STY} WHERE field = 'bowling_style'",
    lambda ws: ws["style_observations"].filter("field = 'bowling_style'").withColumn("s", PP.bowling_style(F.col("value"))).select("person_id", "value", "s.label", "s.arm", "s.family"))
add("N03_expanded_rows", "person_id field value", f"SELECT person_id, field, coalesce(label, value) AS value FROM {_STY} UNION ALL SELECT person_id, 'bowling_arm', arm FROM {_STY} WHERE arm IS NOT NULL UNION ALL SELECT person_id, 'bowling_family', family FROM {_STY} WHERE family IS NOT NULL",
    lambda ws: ws["player_metadata"].filter("source_id = 'external'"))
add("N05_best_values", "person_id field value", f"SELECT person_id, field, coalesce(label, value) AS value FROM {_STY} UNION ALL SELECT person_id, 'bowling_arm', arm FROM {_STY} WHERE arm IS NOT NULL UNION ALL SELECT person_id, 'bowling_family', family FROM {_STY} WHERE family IS NOT NULL",
    lambda ws: PP.best_values(ws["player_metadata"]).filter("field not in ('role', 'wicketkeeper')"))
_USE = """(SELECT person_id, matches, coalesce(km, 0) AS km, coalesce(bb, 0) AS bb, ap FROM people LEFT JOIN (SELECT person_id, count(DISTINCT match_id) AS km FROM keeper_inference GROUP BY 1) USING (person_id)
  LEFT JOIN (SELECT bowler_id AS person_id, sum(legal::INT) AS bb FROM deliveries GROUP BY 1) USING (person_id) LEFT JOIN (SELECT person_id, avg(batting_position) AS ap FROM batting_order GROUP BY 1) USING (person_id))"""
add("D29_role_signals", "person_id field value", f"""SELECT person_id, 'role' AS field, CASE WHEN km >= 3 AND km >= 0.3 * matches THEN 'wicketkeeper-batter' WHEN bb >= 12 * matches AND ap <= 7 THEN 'all-rounder' WHEN bb >= 12 * matches THEN 'bowler' WHEN bb >= 3 * matches THEN 'batting all-rounder' ELSE 'batter' END AS value
    FROM {_USE} WHERE matches >= 3 UNION ALL SELECT person_id, 'wicketkeeper', CASE WHEN km >= 0.25 * matches OR km >= 3 THEN 'yes' ELSE 'occasional' END FROM {_USE} WHERE km > 0""", lambda ws: PP.role_signals(PP.usage(ws)))
add("N07_single_valued", "person_id field value", "SELECT player_out_id AS person_id, 'route' AS field, min(route) AS value FROM dis GROUP BY 1 HAVING count(DISTINCT route) = 1",
    lambda ws: PP.single_valued(ws["dis"].select(F.col("player_out_id").alias("person_id"), F.lit("route").alias("field"), F.col("route").alias("value"))))

# ---- question templates on the structured intent
add("K01_leaderboard", BOARD, board_sql("strike_rate", "phase = 'death' AND format_group = 'T20'", 20, 10), lambda ws: leaderboard(ws, "strike_rate", Filters(phase="death", format="T20"), 20, 10))
add("K02_player_stat", "format_group k value:f sample:i", board_sql("average", "batter_id = 'm1p1'", 10, 5, "format_group"), lambda ws: leaderboard(ws, "average", Filters(batter_id="m1p1"), 10, 5, ("format_group",)))
add("K03_dismissal_count", "player_out_id route n:i", "SELECT player_out_id, route, count(*) AS n FROM dis WHERE phase = 'powerplay' GROUP BY 1, 2", lambda ws: Filters(phase="powerplay").apply(ws["dis"]).groupBy("player_out_id", "route").agg(F.count("*").alias("n")))
add("K04_dismissed_by", "batter_id bowler_id n:i", "SELECT batter_id, bowler_id, n FROM (SELECT *, rank() OVER (PARTITION BY batter_id ORDER BY n DESC) AS r FROM (SELECT batter_id, bowler_id, count(*) AS n FROM balls WHERE striker_credited GROUP BY 1, 2)) WHERE r = 1",
    lambda ws: (lambda g: g.join(g.groupBy("batter_id").agg(F.max("n").alias("n")), ["batter_id", "n"]))(ws["balls"].filter("striker_credited").groupBy("batter_id", "bowler_id").agg(F.count("*").alias("n"))))
add("K12_innings_list", "batter_id rank:i match_id runs:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batter_id ORDER BY runs DESC, balls, match_id, innings_no) AS rank FROM bat_innings WHERE balls >= 1) WHERE rank <= 5", lambda ws: P.innings_list(ws, "runs", 1, 5))
add("K14_match_lookup", "match_id start_date:d venue", "SELECT match_id, start_date, venue FROM team_results WHERE ta = 'Australia' AND tb = 'India' AND year BETWEEN 2015 AND 2022", lambda ws: ws["team_results"].filter("ta = 'Australia' and tb = 'India' and year between 2015 and 2022"))
add("K17_period_compare", "batter_id before:f after:f", "SELECT batter_id, 100e0 * sum(runs) FILTER (WHERE year < 2019) / nullif(sum(balls) FILTER (WHERE year < 2019), 0) AS before, 100e0 * sum(runs) FILTER (WHERE year >= 2019) / nullif(sum(balls) FILTER (WHERE year >= 2019), 0) AS after FROM bat_innings GROUP BY 1",
    lambda ws: ws["bat_innings"].groupBy("batter_id").agg(*[(100.0 * F.sum(F.when(t, F.col("runs"))) / F.nullif(F.sum(F.when(t, F.col("balls"))), F.lit(0))).alias(n) for n, t in (("before", F.col("year") < 2019), ("after", F.col("year") >= 2019))]))
add("K23_team_chases", "team chases:i won:i best:i", "SELECT i2_team AS team, count(*) AS chases, coalesce(sum((winner = i2_team)::INT), 0) AS won, max(i2_runs) FILTER (WHERE winner = i2_team) AS best FROM team_results GROUP BY 1",
    lambda ws: ws["team_results"].groupBy(F.col("i2_team").alias("team")).agg(F.count("*").alias("chases"), F.count_if(F.col("winner") == F.col("i2_team")).alias("won"), F.max(F.when(F.col("winner") == F.col("i2_team"), F.col("i2_runs"))).alias("best")))
add("K24_battle_dismissals", "batter_id bowler_id route n:i", "SELECT player_out_id AS batter_id, bowler_id, route, count(*) AS n FROM dis WHERE bowler_credited GROUP BY 1, 2, 3", lambda ws: ws["dis"].filter("bowler_credited").groupBy(F.col("player_out_id").alias("batter_id"), "bowler_id", "route").agg(F.count("*").alias("n")))
