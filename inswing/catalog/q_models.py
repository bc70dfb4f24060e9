"""Models and nearest neighbours with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog.q_evidence import _BATW, _BDIM, print_sql
from inswing.catalog.registry import add
from inswing.models import bootstrap as B, chase, nextball as NB
from inswing.operators import similar as V

_FEAT = """(SELECT delivery_id, match_id, start_date, batter_id, bowler_id, format_group AS fmt, phase, CASE WHEN wickets_before > 5 THEN '6+' WHEN wickets_before > 2 THEN '3-5' ELSE '0-2' END AS wk,
  CASE WHEN required_rate >= 12 THEN '12+' WHEN required_rate >= 10 THEN '10-12' WHEN required_rate >= 8 THEN '8-10' WHEN required_rate < 8 THEN '<8' ELSE 'none' END AS press,
  CASE WHEN n_wickets > 0 THEN 'WICKET' ELSE ['DOT', '1', '2', '3', '4', '4', '6', '6', '6'][least(runs_total, 8)::INT + 1] END AS y FROM balls)"""
add("M01_next_ball_features", "delivery_id fmt phase wk press y", f"SELECT * FROM {_FEAT}", NB.features)
_CUT = "2020-01-01"
_TR = f"(SELECT * FROM {_FEAT} WHERE start_date < DATE '{_CUT}')"
_J = range(7)
_n = ", ".join(f"sum((y = '{k}')::INT)::DOUBLE AS n{j}" for j, k in enumerate(NB.CLASSES))
_tot = " + ".join(f"a.n{j}" for j in _J)


def _level(name, keys, parent):
    on = f"USING ({', '.join(keys[:-1])})" if len(keys) > 1 else "ON TRUE"
    return f"{name} AS (SELECT {', '.join('a.' + k for k in keys)}, {', '.join(f'(a.n{j} + 50e0 * q.p{j}) / ({_tot} + 50e0) AS p{j}' for j in _J)} FROM (SELECT {', '.join(keys)}, {_n} FROM tr GROUP BY ALL) a JOIN {parent} q {on})"


_CTX = f"""tr AS (FROM {_TR}), g0 AS (SELECT {', '.join(f"avg((y = '{k}')::INT) AS p{j}" for j, k in enumerate(NB.CLASSES))} FROM tr), {_level('c1', ['fmt'], 'g0')}, {_level('c2', ['fmt', 'phase'], 'c1')},
 {_level('c3', ['fmt', 'phase', 'wk'], 'c2')}, {_level('c4', NB.LEVELS, 'c3')}"""
_P7 = " ".join(f"p{j}:f" for j in _J)
_spread = lambda df, col, p: df.select("*", *[F.col(col)[j].alias(f"{p}{j}") for j in _J])
add("M02_cohort_shares", f"fmt phase wk press {_P7}", f"WITH {_CTX} SELECT * FROM c4",
    lambda ws: _spread(NB.cohorts(NB.features(ws).filter(F.col("start_date") < F.lit(_CUT).cast("date"))), "p", "p"))


def _mult(who):
    return (f"(SELECT {who}, " + ", ".join(f"(o{j} + 3000e0 * e{j} / n) / (e{j} + 3000e0 * e{j} / n) AS m{j}" for j in _J) + f" FROM (SELECT {who}, count(*) AS n, "
            + ", ".join(f"sum((y = '{k}')::INT) AS o{j}, sum(p{j}) AS e{j}" for j, k in enumerate(NB.CLASSES)) + f" FROM tr JOIN c4 USING (fmt, phase, wk, press) GROUP BY 1) WHERE n >= 30)")


add("M03_player_multipliers", "bowler_id " + " ".join(f"m{j}:f" for j in _J), f"WITH {_CTX} SELECT * FROM {_mult('bowler_id')}", lambda ws: _spread(NB.train(ws, _CUT)[2], "m", "m"))
_RAW = ", ".join(f"coalesce(p{j}, 1e0 / 7) * coalesce(b.m{j}, 1) * coalesce(w.m{j}, 1) AS r{j}" for j in _J)
_SUM = " + ".join(f"r{j}" for j in _J)
_PRED = f"""pr AS (SELECT delivery_id, fmt, y, [{', '.join(f'r{j} / ({_SUM})' for j in _J)}] AS pred FROM (SELECT t.*, {_RAW} FROM (SELECT * FROM {_FEAT} WHERE start_date >= DATE '{_CUT}') t LEFT JOIN c4 USING (fmt, phase, wk, press)
   LEFT JOIN {_mult('batter_id')} b USING (batter_id) LEFT JOIN {_mult('bowler_id')} w USING (bowler_id))),
 sc AS (SELECT *, pred[list_position(['DOT', '1', '2', '3', '4', '6', 'WICKET'], y)] AS hit FROM pr)"""
add("M04_predictions", "delivery_id y hit:f p0:f p6:f", f"WITH {_CTX}, {_PRED} SELECT delivery_id, y, hit, pred[1] AS p0, pred[7] AS p6 FROM sc",
    lambda ws: NB.scored(ws, _CUT).select("delivery_id", "y", "hit", F.col("pred")[0].alias("p0"), F.col("pred")[6].alias("p6")))
add("M05_evaluation", "fmt n:i log_loss:f brier:f top1:f", f"""WITH {_CTX}, {_PRED} SELECT fmt, count(*) AS n, avg(-ln(hit)) AS log_loss, avg(list_sum(list_transform(pred, lambda x: x * x)) - 2 * hit + 1) AS brier,
    avg((hit = list_max(pred))::INT) AS top1 FROM sc GROUP BY 1""", lambda ws: NB.evaluate(NB.scored(ws, _CUT)))
add("T19_calibration_bins", "fmt bin:i n:i mean_p:f rate:f", f"WITH {_CTX}, {_PRED} SELECT fmt, least(floor(pred[7] * 10), 9) AS bin, count(*) AS n, avg(pred[7]) AS mean_p, avg((y = 'WICKET')::INT) AS rate FROM sc GROUP BY 1, 2",
    lambda ws: NB.calibration(NB.scored(ws, _CUT)))


def _intervals(keys: str, ratios: dict[str, tuple[str, str]], rows: str) -> str:
    """Weighted sums of `rows` (keys, match_id, sums) in every draw, and percentiles of their ratios."""
    sums = sorted({x for pair in ratios.values() for x in pair})
    steps = ", ".join(map(str, B.STEPS))
    totals = ", ".join(f"sum(w * {x}) AS {x}" for x in sums)
    each = " UNION ALL ".join(f"SELECT {keys}, draw, matches, '{m}' AS metric, {a} / nullif({b}, 0) AS r FROM reps" for m, (a, b) in ratios.items())
    return f"""per_match AS (SELECT {keys}, match_id, {', '.join(f'sum({x}) AS {x}' for x in sums)} FROM {rows} GROUP BY ALL),
      drawn AS (SELECT *, CASE WHEN draw = 0 THEN 1 ELSE len(list_filter([{steps}], lambda s: s <= ('0x' || substr(md5('{B.SEED}:' || draw || ':' || match_id), 1, 8))::BIGINT)) END AS w
        FROM per_match, unnest(range(0, {B.DRAWS + 1})) AS d(draw)),
      reps AS (SELECT {keys}, draw, sum(w) AS matches, {totals} FROM drawn WHERE w > 0 GROUP BY ALL), long AS ({each})
      SELECT {keys}, metric, max(r) FILTER (WHERE draw = 0) AS value, quantile_cont(r, {(1 - B.LEVEL) / 2}) FILTER (WHERE draw > 0) AS lo,
        quantile_cont(r, {(1 + B.LEVEL) / 2}) FILTER (WHERE draw > 0) AS hi, max(matches) FILTER (WHERE draw = 0) AS matches FROM long GROUP BY {keys}, metric"""


_LOSS = """loss AS (SELECT f.match_id, sc.fmt, coalesce(f.phase, 'none') AS phase, coalesce(f.press, 'none') AS press, 1e0 AS balls, -ln(greatest(hit, 1e-12)) AS loss,
    list_sum(list_transform(pred, lambda x: x * x)) - 2 * hit + 1 AS square, (hit = list_max(pred))::INT::DOUBLE AS "right", (sc.y = 'WICKET')::INT - pred[7] AS excess FROM sc JOIN feat f USING (delivery_id)),
  cut AS (SELECT * REPLACE ('all' AS phase, 'all' AS press) FROM loss UNION ALL SELECT * REPLACE ('all' AS press) FROM loss UNION ALL SELECT * REPLACE ('all' AS phase) FROM loss)"""
_METRICS = {m: tuple('"right"' if x == "right" else x for x in pair) for m, pair in B.METRICS.items()}
add("M18_metric_intervals", "fmt phase press metric value:f lo:f hi:f matches:i", f"WITH {_CTX}, {_PRED}, feat AS (FROM {_FEAT}), {_LOSS}, {_intervals('fmt, phase, press', _METRICS, 'cut')}",
    lambda ws: B.slices(NB.scored(ws, _CUT)))
_RATES = "(SELECT match_id, format_group, gender, phase, legal::INT::DOUBLE AS legal, runs_total::DOUBLE AS runs, striker_credited::INT::DOUBLE AS wickets FROM balls)"
add("T21_rate_intervals", "format_group gender phase metric value:f lo:f hi:f matches:i",
    f"WITH {_intervals('format_group, gender, phase', {'runs': ('runs', 'legal'), 'wickets': ('wickets', 'legal')}, _RATES)}", lambda ws: B.rates(ws["balls"]))
add("T19_expected_error", "fmt n:i ece:f", f"""WITH {_CTX}, {_PRED} SELECT fmt, sum(n) AS n, sum(n * abs(rate - mean_p)) / sum(n) AS ece FROM (
    SELECT fmt, least(floor(pred[7] * 10), 9) AS bin, count(*) AS n, avg(pred[7]) AS mean_p, avg((y = 'WICKET')::INT) AS rate FROM sc GROUP BY 1, 2) GROUP BY 1""",
    lambda ws: B.expected_error(NB.calibration(NB.scored(ws, _CUT))))
add("M21_scoring_rules", "delivery_id inverse:f log:f flat:f confidence:f", f"""WITH {_CTX}, {_PRED} SELECT delivery_id, CASE WHEN r THEN 10 / m ELSE 0 END AS inverse, CASE WHEN r THEN 10 * log2(1 / m) ELSE 0 END AS log, CASE WHEN r THEN 10 ELSE 0 END AS flat,
    100 * (1 - s / 2) AS confidence FROM (SELECT *, list_max(pred) AS m, hit = list_max(pred) AS r, list_sum(list_transform(pred, lambda x: x * x)) - 2 * hit + 1 AS s FROM sc)""", lambda ws: NB.pick_scores(NB.scored(ws, _CUT)))
_CELL = """(SELECT format_group, gender, ceil((innings_balls_limit - legal_balls_before) / 6e0)::INT AS overs_left, wickets_before AS wickets, avg(total_runs - score_before) AS r, count(*) AS n
   FROM balls JOIN (SELECT match_id, total_runs FROM innings WHERE innings_no = 1) USING (match_id) WHERE innings_no = 1 AND legal AND method IS NULL
   AND innings_balls_limit = CASE format_group WHEN 'T20' THEN 120 ELSE 300 END AND start_date < DATE '2025-01-01' GROUP BY 1, 2, 3, 4)"""
add("M06_resource_cells", "format_group gender overs_left:i wickets:i r:f n:i", f"SELECT * FROM {_CELL}", chase.cells)
_FIT = f"""SELECT format_group, gender, wickets, min(cells) AS cells, arg_min(z0, sse) AS z0, arg_min(c, sse) AS c FROM (
    SELECT format_group, gender, wickets, c, count(*) AS cells, sum(n * r * g) / sum(n * g * g) AS z0, sum(n * r * r) - sum(n * r * g) * sum(n * r * g) / sum(n * g * g) AS sse
    FROM (SELECT *, 1 - exp(-overs_left / c) AS g FROM {_CELL} CROSS JOIN (SELECT pow(1.06e0, unnest(range(110))) AS c) WHERE n >= 20 AND wickets < 10 AND overs_left >= 1) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3) GROUP BY 1, 2, 3"""
add("M07_resource_fit", "format_group gender wickets:i cells:i z0:f c:f", _FIT, lambda ws: chase.fit(chase.cells(ws), 20))
_EDGES = "[" + ", ".join(f"{e!r}e0" if "e" not in repr(e) else repr(e) for e in chase.DEMAND_EDGES) + "]"
_TOP = len(chase.DEMAND_EDGES) - 2
# resources wicket by wicket, then demand of every chase ball, then the monotone curve by the max-min formula
_DEMAND = f"""fit AS MATERIALIZED ({_FIT}),
  grid AS (SELECT format_group, gender, unnest(range(CASE format_group WHEN 'T20' THEN 21 ELSE 51 END)) AS ol FROM (SELECT DISTINCT format_group, gender FROM fit)),
  res AS (SELECT g.*, 0 AS w, CASE WHEN ol = 0 THEN 0e0 ELSE coalesce(z0 * (1 - exp(-ol / c)), 0) END AS runs FROM grid g LEFT JOIN fit f ON f.format_group = g.format_group AND f.gender = g.gender AND f.wickets = 0
    UNION ALL SELECT r.format_group, r.gender, r.ol, r.w + 1, least(r.runs, CASE WHEN r.ol = 0 THEN 0e0 ELSE coalesce(z0 * (1 - exp(-r.ol / c)), 0.6e0 * r.runs) END)
    FROM res r LEFT JOIN fit f ON f.format_group = r.format_group AND f.gender = r.gender AND f.wickets = r.w + 1 WHERE r.w < 9),
  dem AS MATERIALIZED (SELECT *, CASE WHEN runs_required <= 0 THEN 0 WHEN expected > 0.5 THEN runs_required / expected ELSE 99 END AS demand FROM (
    SELECT b.delivery_id, b.match_id, b.seq, b.format_group, b.gender, b.start_date, b.legal, b.method, b.runs_required, b.winner <> b.batting_team AS failed,
      x.runs + (y.runs - x.runs) * (balls_left % 6) / 6e0 AS expected FROM balls b
    JOIN res x ON x.format_group = b.format_group AND x.gender = b.gender AND x.w = b.wickets_before AND x.ol = b.balls_left // 6
    JOIN res y ON y.format_group = b.format_group AND y.gender = b.gender AND y.w = b.wickets_before AND y.ol = least(b.balls_left // 6 + 1, innings_balls_limit // 6)
    WHERE chasing AND b.innings_no = 2 AND balls_left > 0)),
  tagged AS (SELECT *, least(len(list_filter({_EDGES}, lambda e: e <= demand)) - 1, {_TOP}) AS bin FROM dem)"""
_CURVE = f"""cnt AS MATERIALIZED (SELECT format_group, gender, bin, sum(failed::INT) AS f, count(*) AS n FROM tagged
    WHERE legal AND method IS NULL AND failed IS NOT NULL AND runs_required > 0 AND start_date < DATE '2025-01-01' GROUP BY 1, 2, 3),
  pair AS (SELECT a.format_group, a.gender, a.bin AS a, b.bin AS b, sum(m.f)::DOUBLE / sum(m.n) AS mean FROM cnt a JOIN cnt b USING (format_group, gender) JOIN cnt m USING (format_group, gender)
    WHERE a.bin <= b.bin AND m.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2, 3, 4),
  fitted AS (SELECT k.format_group, k.gender, k.bin, max((SELECT min(mean) FROM pair p WHERE p.format_group = k.format_group AND p.gender = k.gender AND p.a = s.bin AND p.b >= k.bin)) AS p
    FROM cnt k JOIN cnt s ON s.format_group = k.format_group AND s.gender = k.gender AND s.bin <= k.bin GROUP BY 1, 2, 3),
  curve AS MATERIALIZED (SELECT format_group, gender, bin, coalesce(n, 0) AS n, f::DOUBLE / n AS rate,
      coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY format_group, gender ORDER BY bin), min(p) OVER (PARTITION BY format_group, gender)) AS p_fail
    FROM (SELECT DISTINCT format_group, gender FROM cnt) CROSS JOIN (SELECT unnest(range({_TOP + 1})) AS bin) LEFT JOIN cnt USING (format_group, gender, bin) LEFT JOIN fitted USING (format_group, gender, bin))"""


def _demand(ws):
    return chase.demand(ws, chase.table(ws.stage(chase.fit(chase.cells(ws), 20), "resource_fit")))


add("M08_demand", "delivery_id expected:f demand:f", f"WITH RECURSIVE {_DEMAND} SELECT delivery_id, expected, demand FROM dem", _demand)
add("M09_failure_curve", "format_group gender bin:i n:i rate:f p_fail:f", f"WITH RECURSIVE {_DEMAND}, {_CURVE} SELECT * FROM curve", lambda ws: chase.failure_curve(ws.stage(_demand(ws), "demand")))


def _swings(ws):
    d = ws.stage(_demand(ws), "demand")
    return chase.swings(d, ws.stage(chase.failure_curve(d), "curve"))


add("E14_difficulty_swings", "match_id rank:i delivery_id sdx:f change:f", f"""WITH RECURSIVE {_DEMAND}, {_CURVE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY abs(change) DESC NULLS LAST, seq) AS rank FROM (
    SELECT match_id, seq, delivery_id, 100 * p_fail AS sdx, round(lead(100 * p_fail) OVER (PARTITION BY match_id ORDER BY seq) - 100 * p_fail, 9) AS change FROM tagged LEFT JOIN curve USING (format_group, gender, bin))) WHERE rank <= 5""", _swings)
add("M13_eligibility", "match_id status label:f", """SELECT match_id, CASE WHEN method = 'D/L' THEN 'method_dl' WHEN NOT (lb1 = f OR w1 > 9) THEN 'incomplete_first_innings'
    WHEN result IS NULL AND winner = bt1 AND NOT (lb2 = f OR w2 > 9) THEN 'inconsistent_second_innings' ELSE 'eligible' END AS status,
    CASE WHEN result = 'tie' THEN 0.5 WHEN winner = bt1 THEN 1 ELSE 0 END AS label
    FROM (SELECT match_id, method, result, winner, team1 AS bt1, i1_balls AS lb1, i1_wkts AS w1, i2_balls AS lb2, i2_wkts AS w2, CASE WHEN match_no % 4 = 0 THEN 300 ELSE 120 END AS f FROM matches)""", chase.eligibility)

# ---- neighbours
_few, _fewd = {"T20": 100, "ODI": 100}, {"T20": 30, "ODI": 30}
_VEC = f"""(SELECT * FROM (WITH base AS ({print_sql(_BATW, _BDIM)}), r AS (SELECT *, CASE WHEN dimension = 'none' THEN 5 ELSE 30 END AS least FROM base WHERE dimension NOT IN ('bowler_conc', 'route_conc') AND enough AND balls >= 100),
  s AS (SELECT gender, format_group, dimension, avg(value) AS mu, stddev_pop(value) AS sd FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 20),
  z AS (SELECT r.*, ((value * n + mu * least) / (n + least) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM r JOIN s USING (gender, format_group, dimension))
  SELECT gender, format_group, pid, dimension, z, count(*) OVER (PARTITION BY gender, format_group, pid) AS dims FROM z) WHERE dims >= 8)"""
_vec = lambda ws: V.player_vectors(ws, "batting", _few, _fewd, 5)
add("V01_player_vectors", "gender format_group pid dimension z:f dims:i", f"SELECT * FROM {_VEC}", _vec)
_DIMS = [d for d in _BDIM if d not in ("bowler_conc", "route_conc")]


def _knn(ws):
    v = V.as_vectors(ws.stage(_vec(ws), "vectors"), _DIMS)
    return V.nearest(v, v, 5, rms=True, min_shared=8)


add("V02_nearest_players", "pool id rank:i other distance:f", f"""WITH v AS MATERIALIZED (SELECT * FROM {_VEC}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool, id ORDER BY distance, other) AS rank FROM (
    SELECT a.format_group || '|' || a.gender AS pool, a.pid AS id, b.pid AS other, sqrt(sum((a.z - b.z) * (a.z - b.z)) / count(*)) AS distance FROM v a JOIN v b ON a.gender = b.gender AND a.format_group = b.format_group AND a.dimension = b.dimension AND a.pid <> b.pid
    GROUP BY 1, 2, 3 HAVING count(*) >= 8)) WHERE rank <= 5""", _knn)


def _embedded(ws):
    e = ws.source("embeddings").select(F.lit("all").alias("pool"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return V.nearest(e, e, 3, block=1024)


add("V02_nearest_embeddings", "id rank:i other distance:f", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM (SELECT a.vec_id::VARCHAR AS id, b.vec_id::VARCHAR AS other,
    list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 3""", _embedded)
_FE = ["ln((runs + 60 * br) / (balls + 60) / br)", "ln((runs + 60 * br) / (balls + 60) / wr)", "ln((outs + 60 * bo) / (balls + 60) / bo)", "ln(balls)", "pp_share", "death_share", "t20_share"]
_BV = f"""(SELECT gender, id, [{', '.join(f'(f{j} - avg(f{j}) OVER g) / CASE WHEN stddev_pop(f{j}) OVER g > 0 THEN stddev_pop(f{j}) OVER g ELSE 1 END' for j in _J)}] AS v FROM (SELECT gender, batter_id || '|' || bowler_id AS id, {', '.join(f'{e} AS f{j}' for j, e in enumerate(_FE))}
   FROM (SELECT *, CASE WHEN batter_rpb > 0 THEN batter_rpb ELSE 1e-6 END AS br, CASE WHEN batter_out_rate > 0 THEN batter_out_rate ELSE 1e-6 END AS bo, CASE WHEN bowler_rpb > 0 THEN bowler_rpb ELSE 1e-6 END AS wr FROM battles WHERE balls >= 30)) WINDOW g AS (PARTITION BY gender))"""
_WT = ", ".join(map(str, V.SIM_WEIGHTS))


def _similar_battles(ws):
    v = ws.stage(V.battle_vectors(ws, 30), "battle_vectors")
    return V.nearest(v, v, 6, V.SIM_WEIGHTS)


add("B24_similar_battles", "pool id rank:i other distance:f", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool, id ORDER BY distance, other) AS rank FROM (SELECT a.gender AS pool, a.id, b.id AS other,
    sqrt(list_sum(list_transform(range(1, 8), lambda j: [{_WT}][j] * (a.v[j] - b.v[j]) * (a.v[j] - b.v[j])))) AS distance FROM {_BV} a JOIN {_BV} b ON a.gender = b.gender AND a.id <> b.id)) WHERE rank <= 6""", _similar_battles)
