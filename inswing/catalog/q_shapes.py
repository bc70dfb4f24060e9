"""One query per kind of join, aggregate, window, ordering, set operation and scalar function the analytics rely on."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from inswing.catalog.registry import add
from inswing.functions.columns import canonical_team, ranked
from inswing.operators import replay

c = lambda x: F.col(x)
n = lambda x: F.count_if(F.expr(x))

# ---- joins
add("J01_inner", "n_name orders:i", "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    lambda ws: ws.source("orders").join(ws.source("customer"), c("o_custkey") == c("c_custkey")).join(ws.source("nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders")))
add("J02_left_outer", "c_custkey:i orders:i", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    lambda ws: ws.source("customer").join(ws.source("orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k")), "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("orders")))
add("J03_full_outer", "k:i customers:i suppliers:i", "SELECT k, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) USING (k)",
    lambda ws: ws.source("customer").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("customers")).join(ws.source("supplier").groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full"))
add("J04_null_safe", "family balls:i wickets:i", """SELECT b.f AS family, balls, wickets FROM (SELECT bowler_family AS f, count(*) AS balls FROM balls GROUP BY 1) b JOIN (SELECT bowler_family AS f, count(*) AS wickets FROM dis GROUP BY 1) d ON b.f IS NOT DISTINCT FROM d.f""",
    lambda ws: (lambda b, d: b.join(d, b.family.eqNullSafe(d.f)))(ws["balls"].groupBy(c("bowler_family").alias("family")).agg(F.count("*").alias("balls")), ws["dis"].groupBy(c("bowler_family").alias("f")).agg(F.count("*").alias("wickets"))))
add("J05_left_semi", "phase n:i", "SELECT phase, count(*) AS n FROM deliveries WHERE delivery_id IN (SELECT delivery_id FROM wickets WHERE bowler_credited) GROUP BY 1",
    lambda ws: ws["deliveries"].join(ws["wickets"].filter("bowler_credited"), ["match_id", "delivery_id"], "left_semi").groupBy("phase").agg(F.count("*").alias("n")))
add("J06_left_anti", "person_id n:i", "SELECT person_id, count(*) AS n FROM players_in_match WHERE (match_id, person_id) NOT IN (SELECT match_id, person_id FROM batting_order) GROUP BY 1",
    lambda ws: ws["players_in_match"].join(ws["batting_order"], ["match_id", "person_id"], "left_anti").groupBy("person_id").agg(F.count("*").alias("n")))
add("J07_residual", "bowler_id outs:i", "SELECT b.bowler_id, count(*) AS outs FROM balls b JOIN wickets w ON w.delivery_id = b.delivery_id AND w.player_out_id = b.batter_id AND w.bowler_credited GROUP BY 1",
    lambda ws: (lambda b, w: b.join(w, (b.match_id == w.match_id) & (b.delivery_id == w.delivery_id) & (w.player_out_id == b.batter_id) & w.bowler_credited).groupBy(b.bowler_id).agg(F.count("*").alias("outs")))(ws["balls"], ws["wickets"]))
add("J08_either_side", "person_id stands:i", "SELECT person_id, count(*) AS stands FROM player_profile JOIN partnerships ON p1 = person_id OR p2 = person_id GROUP BY 1",
    lambda ws: ws["partnerships"].select(F.explode(F.array("p1", "p2")).alias("person_id")).join(ws["player_profile"].select("person_id"), "person_id").groupBy("person_id").agg(F.count("*").alias("stands")))
add("J09_both_innings", "match_id lead:i", "SELECT a.match_id, a.total_runs - b.total_runs AS lead FROM innings a JOIN innings b ON b.match_id = a.match_id AND a.innings_no = 1 AND b.innings_no = 2",
    lambda ws: ws["innings"].groupBy("match_id").agg((F.max(F.when(c("innings_no") == 1, c("total_runs"))) - F.max(F.when(c("innings_no") == 2, c("total_runs")))).alias("lead")))
add("J10_scalar_subquery", "match_id innings_no:i player_out_id", "SELECT match_id, innings_no, player_out_id FROM wickets w WHERE seq = (SELECT max(seq) FROM deliveries d WHERE d.match_id = w.match_id AND d.innings_no = w.innings_no)",
    lambda ws: ws["wickets"].join(ws["deliveries"].groupBy("match_id", "innings_no").agg(F.max_by("delivery_id", "seq").alias("delivery_id")), ["match_id", "innings_no", "delivery_id"]))
add("J11_history_before", "match_id batter_id runs_before:i", """SELECT m.match_id, m.batter_id, coalesce(sum(h.runs), 0) AS runs_before FROM bat_innings m LEFT JOIN bat_innings h ON h.batter_id = m.batter_id AND h.start_date < m.start_date GROUP BY m.match_id, m.batter_id, m.innings_no""",
    lambda ws: (lambda b: b.join(b.groupBy("batter_id", "start_date").agg(F.sum("runs").alias("r")).withColumn("runs_before", F.coalesce(F.sum("r").over(
        W.partitionBy("batter_id").orderBy("start_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), ["batter_id", "start_date"]))(ws["bat_innings"]))
add("J12_flag", "phase n:i with_wicket:i", "SELECT phase, count(*) AS n, count(w.delivery_id) AS with_wicket FROM deliveries LEFT JOIN (SELECT DISTINCT delivery_id FROM wickets) w USING (delivery_id) GROUP BY 1",
    lambda ws: ws["deliveries"].join(ws["wickets"].groupBy("match_id", "delivery_id").agg(F.count("*").alias("k")), ["match_id", "delivery_id"], "left").groupBy("phase").agg(F.count("*").alias("n"), F.count("k").alias("with_wicket")))
add("J14_names", "batter_id name runs:i", "SELECT batter_id, p.name, sum(runs) AS runs FROM bat_innings JOIN player_profile p ON person_id = batter_id GROUP BY 1, 2",
    lambda ws: ws["bat_innings"].groupBy("batter_id").agg(F.sum("runs").alias("runs")).join(ws["player_profile"].select(c("person_id").alias("batter_id"), "name"), "batter_id"))

# ---- aggregates
LI = "lineitem"
add("A01_conditional", "l_returnflag n:i big:f", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, sum(l_extendedprice) FILTER (WHERE l_discount > 0.05) AS big FROM lineitem GROUP BY 1",
    lambda ws: ws.source(LI).groupBy("l_returnflag").agg(n("l_quantity > 25").alias("n"), F.sum(F.when(c("l_discount") > 0.05, c("l_extendedprice"))).alias("big")))
add("A02_count_distinct", "l_returnflag parts:i pairs:i", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey || ':' || l_suppkey) AS pairs FROM lineitem GROUP BY 1",
    lambda ws: ws.source(LI).groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_partkey", "l_suppkey").alias("pairs")))
add("A03_any_value", "match_id venue", "SELECT match_id, min(venue) AS venue FROM balls GROUP BY 1", lambda ws: ws["balls"].groupBy("match_id").agg(F.min("venue").alias("venue")))
add("A04_arg_max", "batter_id match_id runs:i", "SELECT batter_id, arg_max(match_id, lpad(runs::VARCHAR, 4, '0') || match_id) AS match_id, max(runs) AS runs FROM bat_innings GROUP BY 1",
    lambda ws: ws["bat_innings"].groupBy("batter_id").agg(F.max(F.struct("runs", "match_id")).alias("x")).select("batter_id", "x.match_id", "x.runs"))
add("A05_bool", "team any_won:b all_won:b", "SELECT team, bool_or(won) AS any_won, bool_and(won) AS all_won FROM bat_innings GROUP BY 1", lambda ws: ws["bat_innings"].groupBy("team").agg(F.bool_or("won").alias("any_won"), F.bool_and("won").alias("all_won")))
add("A06_list_distinct", "bowler_id opponents", "SELECT bowler_id, array_to_string(list(DISTINCT opponent ORDER BY opponent), ',') AS opponents FROM bowl_innings GROUP BY 1",
    lambda ws: ws["bowl_innings"].groupBy("bowler_id").agg(F.array_join(F.array_sort(F.collect_set("opponent")), ",").alias("opponents")))
add("A07_list_struct", "match_id innings_no:i falls", "SELECT match_id, innings_no, array_to_string(list(player_out_id || '@' || seq ORDER BY seq), ',') AS falls FROM dis GROUP BY 1, 2",
    lambda ws: ws["dis"].groupBy("match_id", "innings_no").agg(F.array_sort(F.collect_list(F.struct("seq", "player_out_id"))).alias("x")).withColumn("falls", F.array_join(F.transform("x", lambda y: F.concat_ws("@", y["player_out_id"], y["seq"])), ",")))
add("A08_string_agg", "match_id totals", "SELECT match_id, string_agg(total_runs || '/' || total_wickets, ',' ORDER BY innings_no) AS totals FROM innings GROUP BY 1",
    lambda ws: ws["innings"].groupBy("match_id").agg(F.expr("listagg(total_runs || '/' || total_wickets, ',') within group (order by innings_no)").alias("totals")))
add("A09_mode", "batter_id position:i", "SELECT batter_id, min(position) AS position FROM (SELECT batter_id, position, rank() OVER (PARTITION BY batter_id ORDER BY count(*) DESC) AS r FROM bat_innings GROUP BY 1, 2) WHERE r = 1 GROUP BY 1",
    lambda ws: ws["bat_innings"].groupBy("batter_id").agg(F.expr("mode(position, true)").alias("position")))
add("A10_quantile_disc", "format_group p99:i", "SELECT format_group, quantile_disc(team_dot_streak, 0.99) AS p99 FROM balls GROUP BY 1", lambda ws: ws["balls"].groupBy("format_group").agg(F.expr("percentile_disc(0.99) within group (order by team_dot_streak)").alias("p99")))
add("A11_variance", "phase v:f q:i", "SELECT phase, var_samp(runs_batter) AS v, sum(runs_batter * runs_batter) AS q FROM balls WHERE faced GROUP BY 1",
    lambda ws: ws["balls"].filter("faced").groupBy("phase").agg(F.var_samp("runs_batter").alias("v"), F.sum(c("runs_batter") * c("runs_batter")).alias("q")))
add("A12_avg_min_max", "gender a:f first:d last:d", "SELECT gender, avg(i1_runs) AS a, min(start_date) AS first, max(start_date) AS last FROM team_results GROUP BY 1", lambda ws: ws["team_results"].groupBy("gender").agg(F.avg("i1_runs").alias("a"), F.min("start_date").alias("first"), F.max("start_date").alias("last")))
add("A13_grouping_sets", "gender phase g:i n:i", "SELECT gender, phase, grouping(gender, phase) AS g, count(*) AS n FROM balls GROUP BY GROUPING SETS ((gender), (phase), ())",
    lambda ws: ws["balls"].groupingSets([["gender"], ["phase"], []], "gender", "phase").agg(F.grouping_id().alias("g"), F.count("*").alias("n")))
add("A14_group_by_all", "gender format_group phase n:i", "SELECT gender, format_group, phase, count(*) AS n FROM balls GROUP BY ALL", lambda ws: ws["balls"].groupBy("gender", "format_group", "phase").agg(F.count("*").alias("n")))
add("A15_having", "o_custkey:i n:i", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10", lambda ws: ws.source("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 10"))
add("A16_aggregate_over_aggregate", "route phase n:i total:i", "SELECT route, phase, count(*) AS n, sum(count(*)) OVER (PARTITION BY route) AS total FROM dis GROUP BY 1, 2",
    lambda ws: ws["dis"].groupBy("route", "phase").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy("route"))))
add("A17_pivot", "batter_id powerplay:i middle:i death:i", "SELECT batter_id, sum((phase = 'powerplay')::INT) AS powerplay, sum((phase = 'middle')::INT) AS middle, sum((phase = 'death')::INT) AS death FROM balls GROUP BY 1",
    lambda ws: ws["balls"].groupBy("batter_id").pivot("phase", ["powerplay", "middle", "death"]).count().fillna(0))
add("A18_share", "route share:f", "SELECT route, 1e0 * count(*) / sum(count(*)) OVER () AS share FROM dis GROUP BY 1", lambda ws: ws["dis"].groupBy("route").agg(F.count("*").alias("k")).withColumn("share", c("k") / F.sum("k").over(W.partitionBy(F.lit(1)))))

# ---- windows, ordering, set operations
add("W01_row_number", "c_nationkey:i c_custkey:i rank:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3",
    lambda ws: ranked(ws.source("customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3))
add("W02_dense_rank", "batter_id match_id k:i", "SELECT batter_id, match_id, dense_rank() OVER (PARTITION BY batter_id ORDER BY start_date) AS k FROM bat_innings",
    lambda ws: (lambda b: b.select("batter_id", "match_id", "start_date").join(b.select("batter_id", "start_date").distinct().withColumn("k", F.dense_rank().over(W.partitionBy("batter_id").orderBy("start_date"))), ["batter_id", "start_date"]))(ws["bat_innings"]))
_SEQ = lambda: W.partitionBy("match_id", "innings_no").orderBy("seq")
add("W03_lag_lead", "delivery_id prev next", "SELECT delivery_id, lag(batter_id) OVER w AS prev, lead(batter_id) OVER w AS next FROM deliveries WINDOW w AS (PARTITION BY match_id, innings_no ORDER BY seq)",
    lambda ws: ws["deliveries"].withColumns({"prev": F.lag("batter_id").over(_SEQ()), "next": F.lead("batter_id").over(_SEQ())}))
add("W05_sliding_rows", "delivery_id last12:i", "SELECT delivery_id, sum(n_wickets) OVER (PARTITION BY match_id, innings_no ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS last12 FROM deliveries",
    lambda ws: ws["deliveries"].withColumn("last12", F.sum("n_wickets").over(_SEQ().rowsBetween(-11, 0))))
add("W07_whole_partition", "match_id innings_no:i share:f", "SELECT match_id, innings_no, 1e0 * total_runs / sum(total_runs) OVER (PARTITION BY match_id) AS share FROM innings",
    lambda ws: ws["innings"].withColumn("share", c("total_runs") / F.sum("total_runs").over(W.partitionBy("match_id"))))
add("W09_qualify", "bowler_id match_id wickets:i", "SELECT bowler_id, match_id, wickets FROM bowl_innings QUALIFY row_number() OVER (PARTITION BY bowler_id ORDER BY wickets DESC, runs, match_id, innings_no) = 1",
    lambda ws: ranked(ws["bowl_innings"], ["bowler_id"], [F.desc("wickets"), F.asc("runs"), F.asc("match_id"), F.asc("innings_no")], 1))
add("W11_rolling_rate", "delivery_id r10:f", "SELECT delivery_id, 100e0 * avg(runs_batter) OVER (PARTITION BY match_id, innings_no, batter_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r10 FROM balls WHERE faced",
    lambda ws: ws["balls"].filter("faced").withColumn("r10", 100 * F.avg("runs_batter").over(W.partitionBy("match_id", "innings_no", "batter_id").orderBy("seq").rowsBetween(-9, 0))))
add("O01_null_order", "k:i required_rate:f delivery_id", "SELECT row_number() OVER (ORDER BY required_rate DESC NULLS LAST, delivery_id) AS k, required_rate, delivery_id FROM deliveries ORDER BY required_rate DESC NULLS LAST, delivery_id LIMIT 50",
    lambda ws: ws["deliveries"].orderBy(F.desc_nulls_last("required_rate"), "delivery_id").limit(50).withColumn("k", F.row_number().over(W.orderBy(F.desc_nulls_last("required_rate"), "delivery_id"))))
add("O03_top_k", "o_orderkey:i o_totalprice:f", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", lambda ws: ws.source("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20))
add("U01_union_all", "k n:i", "SELECT k, count(*) AS n FROM (SELECT s_name[1:8] AS k FROM supplier UNION ALL SELECT c_name[1:8] FROM customer) GROUP BY 1",
    lambda ws: ws.source("supplier").select(F.substring("s_name", 1, 8).alias("k")).unionByName(ws.source("customer").select(F.substring("c_name", 1, 8).alias("k"))).groupBy("k").agg(F.count("*").alias("n")))
add("U02_union", "k:i", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", lambda ws: ws.source("customer").select(c("c_nationkey").alias("k")).union(ws.source("supplier").select("s_nationkey")).distinct())
add("U03_distinct", "gender venue", "SELECT DISTINCT gender, venue FROM matches", lambda ws: ws["matches"].select("gender", "venue").distinct())

# ---- scalars
add("X02_least_greatest", "match_id lo hi", "SELECT match_id, least(ta, tb) AS lo, greatest(ta, tb) AS hi FROM team_results", lambda ws: ws["team_results"].select("match_id", F.least("ta", "tb").alias("lo"), F.greatest("ta", "tb").alias("hi")))
add("X04_arithmetic", "o_orderkey:i a:i b:i d:f e:i", "SELECT o_orderkey, o_orderkey // 7 AS a, o_orderkey % 7 AS b, abs(o_totalprice - 1000) AS d, ceil(o_totalprice) AS e FROM orders",
    lambda ws: ws.source("orders").select("o_orderkey", F.expr("o_orderkey div 7").alias("a"), (c("o_orderkey") % 7).alias("b"), F.abs(c("o_totalprice") - 1000).alias("d"), F.ceil("o_totalprice").alias("e")))
add("X05_date_parts", "match_id y:i m:i d:i gap:i", "SELECT match_id, year(start_date) AS y, month(start_date) AS m, day(start_date) AS d, start_date - DATE '2015-01-01' AS gap FROM matches",
    lambda ws: ws["matches"].select("match_id", F.year("start_date").alias("y"), F.month("start_date").alias("m"), F.dayofmonth("start_date").alias("d"), F.datediff("start_date", F.lit("2015-01-01")).alias("gap")))
add("X07_strings", "person_id last n:i lo", "SELECT person_id, split_part(name, ' ', 2) AS last, length(name) AS n, lower(name) AS lo FROM player_profile",
    lambda ws: ws["player_profile"].select("person_id", F.split_part("name", F.lit(" "), F.lit(2)).alias("last"), F.length("name").alias("n"), F.lower("name").alias("lo")))
add("X08_patterns", "doc_id:i a:b b:b", "SELECT doc_id, text ILIKE '%the%' AS a, regexp_matches(text, '[0-9]{3,}') AS b FROM documents", lambda ws: ws.source("documents").select("doc_id", c("text").ilike("%the%").alias("a"), c("text").rlike("[0-9]{3,}").alias("b")))
add("X12_half_split", "match_id half:i", "SELECT match_id, ('0x' || md5(match_id)[1:8])::BIGINT % 2 AS half FROM matches", lambda ws: ws["matches"].select("match_id", (F.conv(F.substring(F.md5("match_id"), 1, 8), 16, 10).cast("bigint") % 2).alias("half")))
add("X14_digests", "match_id a b", "SELECT match_id, sha256(match_id) AS a, sha1(match_id) AS b FROM matches", lambda ws: ws["matches"].select("match_id", F.sha2("match_id", 256).alias("a"), F.sha1("match_id").alias("b")))
add("X17_overs_text", "match_id innings_no:i overs", "SELECT match_id, innings_no, (legal_balls // 6) || '.' || (legal_balls % 6) AS overs FROM innings",
    lambda ws: ws["innings"].select("match_id", "innings_no", F.concat_ws(".", F.expr("legal_balls div 6"), c("legal_balls") % 6).alias("overs")))
add("X16_html_text", "page_id:i title links:i", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\\s')) AS links FROM pages", lambda ws: ws.source("pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?i)<a\\s"), F.lit(0))).cast("long").alias("links")))

# ---- replay columns
_SYM = """CASE WHEN n_wickets > 0 THEN 'W' WHEN wides > 0 THEN wides || 'wd' WHEN noballs > 0 THEN coalesce(nullif(runs_batter, 0)::VARCHAR, '') || 'nb'
    WHEN is_six THEN '6' WHEN is_four THEN '4' WHEN runs_total = 0 THEN '•' WHEN runs_batter = 0 AND byes > 0 THEN runs_extras || 'b'
    WHEN runs_batter = 0 AND legbyes > 0 THEN runs_extras || 'lb' ELSE runs_total::VARCHAR END"""
add("D31_symbol", "delivery_id symbol", f"SELECT delivery_id, {_SYM} AS symbol FROM deliveries",
    lambda ws: ws["deliveries"].withColumn("symbol", replay.symbol()))
_ALL = lambda: W.partitionBy("match_id").orderBy("innings_no", "seq")
add("D32_neighbours", "delivery_id prev next before:i after:i", """SELECT delivery_id, lag(delivery_id) OVER w AS prev, lead(delivery_id) OVER w AS next, count(*) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before,
    count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS after FROM deliveries WINDOW w AS (PARTITION BY match_id ORDER BY innings_no, seq)""",
    lambda ws: ws["deliveries"].withColumns({"prev": F.lag("delivery_id").over(_ALL()), "next": F.lead("delivery_id").over(_ALL()), "before": F.size(F.collect_list("delivery_id").over(_ALL().rowsBetween(-12, -1))),
                                             "after": F.size(F.collect_list("delivery_id").over(_ALL().rowsBetween(1, 6)))}))
add("D33_result_line", "match_id line", """SELECT match_id, CASE WHEN winner IS NULL THEN CASE result WHEN 'tie' THEN 'Match tied' WHEN 'no result' THEN 'No result' WHEN 'draw' THEN 'Draw' ELSE result END
    ELSE winner || ' won' || CASE WHEN win_by_runs > 0 THEN ' by ' || win_by_runs || ' run' || CASE WHEN win_by_runs > 1 THEN 's' ELSE '' END
      WHEN win_by_wickets > 0 THEN ' by ' || win_by_wickets || ' wicket' || CASE WHEN win_by_wickets > 1 THEN 's' ELSE '' END ELSE '' END || coalesce(' (' || method || ')', '') END AS line FROM matches""",
    lambda ws: ws["matches"].withColumn("line", replay.result_line()))
add("D34_cursor", "delivery_id cursor:i", "SELECT delivery_id, row_number() OVER (PARTITION BY match_id ORDER BY innings_no, seq) - 1 AS cursor FROM deliveries", lambda ws: ws["deliveries"].withColumn("cursor", F.row_number().over(_ALL()) - 1))
_BW = lambda: W.partitionBy("match_id", "innings_no", "bowler_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
add("D35_bowler_before", "delivery_id balls_before:i runs_before:i wickets_so_far:i", """SELECT delivery_id, coalesce(sum(legal::INT) OVER w, 0) AS balls_before, coalesce(sum(runs_batter + wides + noballs) OVER w, 0) AS runs_before, coalesce(sum(wk) OVER w, 0) AS wickets_so_far
    FROM balls WINDOW w AS (PARTITION BY match_id, innings_no, bowler_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    lambda ws: ws["balls"].withColumns({"balls_before": F.coalesce(F.sum(c("legal").cast("int")).over(_BW()), F.lit(0)), "runs_before": F.coalesce(F.sum(c("runs_batter") + c("wides") + c("noballs")).over(_BW()), F.lit(0)),
                                        "wickets_so_far": F.coalesce(F.sum("wk").over(_BW()), F.lit(0))}))
add("D38_index_in_over", "delivery_id idx:i", "SELECT delivery_id, row_number() OVER (PARTITION BY match_id, innings_no, over ORDER BY seq) AS idx FROM deliveries",
    lambda ws: ws["deliveries"].withColumn("idx", F.row_number().over(W.partitionBy("match_id", "innings_no", "over").orderBy("seq"))))
add("S20_as_of", "match_id batter_id runs:i", "SELECT match_id, batter_id, runs FROM bat_innings WHERE start_date < DATE '2017-01-01'", lambda ws: ws["bat_innings"].filter(c("start_date") < F.lit("2017-01-01").cast("date")))
add("D27_canonical_names", "match_id a b", "SELECT match_id, CASE team1 WHEN 'Kings XI Punjab' THEN 'Punjab Kings' WHEN 'Royal Challengers Bangalore' THEN 'Royal Challengers Bengaluru' ELSE team1 END AS a, team1 AS b FROM matches",
    lambda ws: ws["matches"].select("match_id", canonical_team("team1").alias("a"), c("team1").alias("b")))

# ---- remaining shapes
add("O02_pagination", "bowler_id n:i total:i match_id innings_no:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bowler_id ORDER BY start_date DESC, match_id, innings_no) AS n, count(*) OVER (PARTITION BY bowler_id) AS total FROM bowl_innings) WHERE n BETWEEN 4 AND 6",
    lambda ws: ranked(ws["bowl_innings"], ["bowler_id"], [F.desc("start_date"), F.asc("match_id"), F.asc("innings_no")], 6, "n").filter("n > 3").join(ws["bowl_innings"].groupBy("bowler_id").agg(F.count("*").alias("total")), "bowler_id"))
add("U04_both_orientations", "a b n:i", "SELECT a, b, count(*) AS n FROM (SELECT ta AS a, tb AS b FROM team_results UNION ALL SELECT tb, ta FROM team_results) GROUP BY 1, 2",
    lambda ws: ws["team_results"].select(F.inline(F.array(F.struct(c("ta").alias("a"), c("tb").alias("b")), F.struct(c("tb").alias("a"), c("ta").alias("b"))))).groupBy("a", "b").agg(F.count("*").alias("n")))
add("W06_value_range", "delivery_id n:i", "SELECT delivery_id, count(*) OVER (PARTITION BY match_id, innings_no ORDER BY legal_balls_before RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n FROM deliveries",
    lambda ws: ws["deliveries"].withColumn("n", F.count("*").over(W.partitionBy("match_id", "innings_no").orderBy("legal_balls_before").rangeBetween(-6, -1))))
add("W10_cumulative_by_day", "bowler_id start_date:d career:i", "SELECT DISTINCT bowler_id, start_date, sum(wickets) OVER (PARTITION BY bowler_id ORDER BY start_date RANGE UNBOUNDED PRECEDING) AS career FROM bowl_innings",
    lambda ws: ws["bowl_innings"].groupBy("bowler_id", "start_date").agg(F.sum("wickets").alias("w")).withColumn("career", F.sum("w").over(W.partitionBy("bowler_id").orderBy("start_date").rowsBetween(W.unboundedPreceding, 0))))
add("X01_conditionals", "match_id comp margin:i", "SELECT match_id, coalesce(competition, 'Bilateral') AS comp, CASE WHEN win_by_runs IS NOT NULL THEN win_by_runs ELSE nullif(win_by_wickets, 10) END AS margin FROM matches",
    lambda ws: ws["matches"].select("match_id", F.coalesce("competition", F.lit("Bilateral")).alias("comp"), F.when(c("win_by_runs").isNotNull(), c("win_by_runs")).otherwise(F.nullif("win_by_wickets", F.lit(10))).alias("margin")))
add("X09_lists", "batter_id bowler_id k:i t20:b joined", "SELECT batter_id, bowler_id, len(formats) AS k, list_contains(formats, 'T20') AS t20, array_to_string(list_transform(formats[1:1], lambda x: lower(x)), ',') AS joined FROM battles",
    lambda ws: ws["battles"].select("batter_id", "bowler_id", F.size("formats").alias("k"), F.array_contains("formats", "T20").alias("t20"), F.array_join(F.transform(F.slice("formats", 1, 1), lambda x: F.lower(x)), ",").alias("joined")))
add("X11_map_access", "person_id sb", "SELECT person_id, 'sb-' || person_id AS sb FROM people", lambda ws: ws["persons"].select("person_id", c("external_ids")["key_scorebook"].alias("sb")))
add("X13_math", "o_orderkey:i a:f b:f d:f", "SELECT o_orderkey, ln(o_totalprice) AS a, sqrt(o_totalprice) AS b, tanh(o_totalprice / 100000) AS d FROM orders",
    lambda ws: ws.source("orders").select("o_orderkey", F.ln("o_totalprice").alias("a"), F.sqrt("o_totalprice").alias("b"), F.tanh(c("o_totalprice") / 100000).alias("d")))
add("S14_join_by_external_id", "person_id field value", "SELECT person_id, 'batting_hand' AS field, batting_hand AS value FROM people WHERE batting_hand IS NOT NULL",
    lambda ws: ws["persons"].select("person_id", F.explode("external_ids").alias("scheme", "external")).join(
        ws["style_observations"].filter("field = 'batting_hand'").select(F.concat(F.lit("sb-"), "person_id").alias("external"), "field", "value"), "external"))
