"""Statistics, battles, states, splits and fingerprints with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog import sqlstats as S
from inswing.catalog.registry import add
from inswing.functions import stats
from inswing.functions.columns import ratio
from inswing.operators import evidence as E
from inswing.operators import players as P

# ---------------------------------------------------------------- statistics on real aggregates
OUTS = "(SELECT batter_id, sum(faced::INT) AS n, sum(striker_dismissed::INT) AS x, sum(runs_batter) FILTER (WHERE faced) AS s, sum(runs_batter * runs_batter) FILTER (WHERE faced) AS q, innings_no FROM balls GROUP BY batter_id, innings_no)"
TWO = f"(SELECT a.batter_id, a.n AS n1, a.x AS x1, a.s AS s1, a.q AS q1, b.n AS n0, b.x AS x0, b.s AS s0, b.q AS q0 FROM {OUTS} a JOIN {OUTS} b USING (batter_id) WHERE a.innings_no = 1 AND b.innings_no = 2 AND a.n > 1 AND b.n > 1)"


def _by_innings(ws):
    r = F.col("runs_batter").cast("long")
    g = ws["balls"].groupBy("batter_id", "innings_no").agg(F.count_if("faced").alias("n"), F.count_if("striker_dismissed").alias("x"),
                                                           F.sum(F.when(F.col("faced"), r)).alias("s"), F.sum(F.when(F.col("faced"), r * r)).alias("q"))
    return g


def _two(ws):
    """First innings beside second innings of each batter."""
    g = _by_innings(ws)
    out = g.groupBy("batter_id").agg(*[F.max(F.when(F.col("innings_no") == no, F.col(v))).alias(f"{v}{tag}") for no, tag in ((1, 1), (2, 0)) for v in "nxsq"])
    return out.filter("n1 > 1 and n0 > 1")


add("T01_wilson", "batter_id innings_no:i lo:f hi:f", f"SELECT batter_id, innings_no, {S.wilson('x', 'n', 'lo')} AS lo, {S.wilson('x', 'n', 'hi')} AS hi FROM {OUTS}",
    lambda ws: _by_innings(ws).select("batter_id", "innings_no", F.inline(F.array(stats.wilson("x", "n")))))
add("T02_shrink_rate", "batter_id innings_no:i rate:f", f"SELECT batter_id, innings_no, (x + 100 * 0.04e0) / (n + 100) AS rate FROM {OUTS}",
    lambda ws: _by_innings(ws).withColumn("rate", stats.shrink("x", "n", 0.04, 100)))
_args = ("x1", "n1", "x0", "n0")
add("T03_rate_ratio", "batter_id ratio:f lo:f hi:f p:f", f"SELECT batter_id, {S.ratio(*_args)} AS ratio, {S.ratio(*_args)} * exp(-{S.Z} * {S.ratio_se(*_args)}) AS lo, "
    f"{S.ratio(*_args)} * exp({S.Z} * {S.ratio_se(*_args)}) AS hi, {S.two_sided(f'(ln({S.ratio(*_args)}) / {S.ratio_se(*_args)})')} AS p FROM {TWO}",
    lambda ws: _two(ws).select("batter_id", F.inline(F.array(stats.rate_ratio(*_args)))))
_m = ("s1", "q1", "n1", "s0", "q0", "n0")
_d = "(s1::DOUBLE / n1 - s0::DOUBLE / n0)"
add("T04_mean_diff", "batter_id diff:f lo:f hi:f p:f", f"SELECT batter_id, {_d} AS diff, {_d} - {S.Z} * {S.mean_se(*_m)} AS lo, {_d} + {S.Z} * {S.mean_se(*_m)} AS hi, "
    f"{S.two_sided(f'({_d} / {S.mean_se(*_m)})')} AS p FROM {TWO}", lambda ws: _two(ws).select("batter_id", F.inline(F.array(stats.mean_diff(*_m)))))
add("T05_poisson_interval", "batter_id innings_no:i lo:f hi:f", f"SELECT batter_id, innings_no, {S.poisson_lo('x')} AS lo, {S.poisson_hi('x')} AS hi FROM {OUTS}",
    lambda ws: _by_innings(ws).select("batter_id", "innings_no", F.inline(F.array(stats.poisson_interval("x")))))
_T3 = f"(SELECT batter_id, batter_id[1] AS g, {S.two_sided(f'(ln({S.ratio(*_args)}) / {S.ratio_se(*_args)})')} AS p FROM {TWO})"
add("T06_benjamini_hochberg", "batter_id g passed:b", f"""
  SELECT batter_id, g, coalesce(p <= edge, FALSE) AS passed FROM {_T3} LEFT JOIN (
    SELECT g, max(p) AS edge FROM (SELECT g, p, count(*) OVER (PARTITION BY g ORDER BY p) AS rank, count(*) OVER (PARTITION BY g) AS m FROM {_T3}) WHERE p <= 0.5 * rank / m GROUP BY 1) USING (g)""",
    lambda ws: stats.benjamini_hochberg(_two(ws).select("batter_id", F.substring("batter_id", 1, 1).alias("g"), stats.rate_ratio(*_args)["p"].alias("p")), ["g"], "p", 0.5))
add("T07_percentile_rank", "batter_id gender sr:f percentile:f", """
  WITH v AS (SELECT batter_id, gender, sum(balls) AS n, 100e0 * sum(runs) / sum(balls) AS sr FROM bat_innings GROUP BY 1, 2 HAVING sum(balls) > 0)
  SELECT batter_id, gender, sr, 100e0 * (SELECT sum((b.sr < a.sr)::INT) + 0.5e0 * sum((b.sr = a.sr)::INT) FROM v b WHERE b.gender = a.gender AND b.n >= 40)
    / (SELECT count(*) FROM v b WHERE b.gender = a.gender AND b.n >= 40) AS percentile FROM v a""",
    lambda ws: stats.percentile_rank(ws["bat_innings"].groupBy("batter_id", "gender").agg(F.sum("balls").alias("n"), ratio(F.sum("runs"), F.sum("balls"), 100.0).alias("sr"))
                                     .filter("n > 0"), ["gender"], "sr", F.col("n") >= 40))
add("T08_poisson_tail", "batter_id bowler_id p:f", f"SELECT batter_id, bowler_id, {S.poisson_tail('outs', 'balls * batter_out_rate')} AS p FROM battles",
    lambda ws: ws["battles"].withColumn("p", stats.poisson_tail("outs", F.col("balls") * F.col("batter_out_rate"))))
add("T09_binomial_tail", "batter_id bowler_id p:f", """SELECT batter_id, bowler_id, CASE WHEN outs = 0 THEN 1 WHEN batter_out_rate = 0 THEN 0 ELSE least(1e0, list_sum(list_transform(range(outs::INT, balls::INT + 1),
    lambda i: exp(lgamma(balls + 1) - lgamma(i + 1) - lgamma(balls - i + 1) + i * ln(nullif(batter_out_rate, 0)) + (balls - i) * ln(1 - batter_out_rate))))) END AS p FROM battles""",
    lambda ws: ws["battles"].withColumn("p", stats.binomial_tail("outs", "balls", "batter_out_rate")))
add("T10_normal_p", "batter_id bowler_id p:f", f"SELECT batter_id, bowler_id, {S.two_sided('((runs::DOUBLE / balls - batter_rpb) * sqrt(balls::DOUBLE))')} AS p FROM battles",
    lambda ws: ws["battles"].withColumn("p", stats.two_sided((F.col("runs") / F.col("balls") - F.col("batter_rpb")) * F.sqrt(F.col("balls").cast("double")))))
add("T12_split_half", "gender r:f lo:f hi:f n:i", """
  SELECT gender, r, tanh(atanh(r) - 1.645e0 / sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.645e0 / sqrt(n - 3)) AS hi, n FROM (
    SELECT gender, corr(a, b) AS r, count(*) AS n FROM (SELECT gender, batter_id, 1e0 * sum(runs) FILTER (WHERE year % 2 = 0) / nullif(sum(balls) FILTER (WHERE year % 2 = 0), 0) AS a,
      1e0 * sum(runs) FILTER (WHERE year % 2 = 1) / nullif(sum(balls) FILTER (WHERE year % 2 = 1), 0) AS b FROM bat_innings GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)""",
    lambda ws: (lambda g: g.groupBy("gender").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n")).withColumns(
        {"lo": F.tanh(F.atanh("r") - 1.645 / F.sqrt(F.col("n") - 3.0)), "hi": F.tanh(F.atanh("r") + 1.645 / F.sqrt(F.col("n") - 3.0))}))(
        ws["bat_innings"].groupBy("gender", "batter_id").agg(*[ratio(F.sum(F.when(F.col("year") % 2 == k, F.col("runs"))), F.sum(F.when(F.col("year") % 2 == k, F.col("balls")))).alias(x)
                                                                for k, x in ((0, "a"), (1, "b"))]).filter("a is not null and b is not null")))
LABELLED = "(SELECT d.source, d.lang, count(*) AS n, sum(quality) AS x FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2)"
add("T01_wilson_labelled_share", "source lang n:i x:i lo:f hi:f", f"SELECT *, {S.wilson('x', 'n', 'lo')} AS lo, {S.wilson('x', 'n', 'hi')} AS hi FROM {LABELLED}",
    lambda ws: ws.source("labels").join(ws.source("documents").select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.sum("quality").alias("x")).select("*", F.inline(F.array(stats.wilson("x", "n")))))

# ---------------------------------------------------------------- battles
USUAL = """(SELECT p.batter_id, p.bowler_id, sum(b.n) AS bn, sum(b.r) AS br, sum(b.o) AS bo, sum(w.n) AS wn, sum(w.r) AS wr, sum(w.o) AS wo
  FROM (SELECT DISTINCT batter_id, bowler_id, format_group FROM balls) p
  JOIN (SELECT batter_id, format_group, sum(faced::INT) AS n, sum(runs_batter) AS r, sum(striker_credited::INT) AS o FROM balls GROUP BY 1, 2) b USING (batter_id, format_group)
  JOIN (SELECT bowler_id, format_group, sum(faced::INT) AS n, sum(runs_batter) AS r, sum(striker_credited::INT) AS o FROM balls GROUP BY 1, 2) w USING (bowler_id, format_group) GROUP BY 1, 2)"""
add("P13_battle_edges", "batter_id bowler_id balls:i runs:i dismissals:i strike_rate:f sr_lo:f sr_hi:f batter_usual_sr:f bowler_usual_sr:f outs_lo:f outs_hi:f expected_by_batter:f expected_by_bowler:f sample", f"""
  SELECT *, sr AS strike_rate, sr - 1.645e0 * se AS sr_lo, sr + 1.645e0 * se AS sr_hi, 100e0 * br / bn AS batter_usual_sr, 100e0 * wr / wn AS bowler_usual_sr,
    {S.poisson_lo('dismissals')} AS outs_lo, {S.poisson_hi('dismissals')} AS outs_hi, 1e0 * balls * bo / bn AS expected_by_batter, 1e0 * balls * wo / wn AS expected_by_bowler,
    CASE WHEN balls < 60 THEN 'small' WHEN balls < 150 THEN 'moderate' ELSE 'reasonable' END AS sample
  FROM (SELECT batter_id, bowler_id, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum(striker_credited::INT) AS dismissals, 100e0 * sum(runs_batter) / sum(faced::INT) AS sr,
      100 * sqrt(coalesce(var_samp(runs_batter) FILTER (WHERE faced), 0) / sum(faced::INT)) AS se FROM balls GROUP BY 1, 2 HAVING sum(faced::INT) >= 12) JOIN {USUAL} USING (batter_id, bowler_id)""", E.battle_edges)
_BD = " UNION ALL ".join(f"SELECT batter_id, bowler_id, '{d}' AS dimension, {d}::VARCHAR AS bucket, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum(striker_credited::INT) AS dismissals FROM balls GROUP BY 1, 2, 4"
                         for d in ("phase", "innings_no", "year", "format_group"))
add("P14_battle_breakdown", "batter_id bowler_id dimension bucket balls:i runs:i dismissals:i", _BD, E.battle_breakdown)
add("P15_notable_battles", "gender rank:i batter_id bowler_id balls:i runs:i outs:i",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY balls DESC, batter_id, bowler_id) AS rank FROM battles) WHERE rank <= 12", E.notable_battles)
add("P21_meetings", "batter_id bowler_id match_id balls:i runs:i outs:i half", """
  SELECT *, CASE WHEN 2 * (run - day) < whole THEN 'earlier' ELSE 'later' END AS half FROM (
    SELECT *, sum(balls) OVER (PARTITION BY batter_id, bowler_id ORDER BY start_date RANGE UNBOUNDED PRECEDING) AS run, sum(balls) OVER (PARTITION BY batter_id, bowler_id, start_date) AS day,
      sum(balls) OVER (PARTITION BY batter_id, bowler_id) AS whole
    FROM (SELECT batter_id, bowler_id, match_id, min(start_date) AS start_date, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum(striker_credited::INT) AS outs FROM balls GROUP BY 1, 2, 3))""", E.meetings)
_LISTS = {"biggest": ("TRUE", "balls DESC"), "most_dismissals": ("outs > 0", "outs DESC"), "took_apart": ("lift >= 1.2", "lift DESC"), "kept_quiet": ("lift <= 0.8", "lift"),
          "balanced": ("lift BETWEEN 0.9 AND 1.1 AND abs(z) < 1", "balls DESC"), "unusual": ("abs(z) >= 2", "abs(z) DESC")}
_LIFT = """(SELECT *, (outs - balls * batter_out_rate) / sqrt(greatest(balls * batter_out_rate, 0.5e0)) AS z, (runs::DOUBLE / balls) / nullif(batter_rpb, 0) AS lift FROM battles WHERE balls >= 24)"""
add("P35_matchup_lists", "batter_id list rank:i bowler_id balls:i outs:i z:f lift:f", " UNION ALL ".join(
    f"SELECT batter_id, '{n}' AS list, rank, bowler_id, balls, outs, z, lift FROM (SELECT *, row_number() OVER (PARTITION BY batter_id ORDER BY {o}, bowler_id) AS rank FROM {_LIFT} WHERE {w}) WHERE rank <= 5"
    for n, (w, o) in _LISTS.items()), lambda ws: E.matchup_lists(ws, 24))
add("P16_dismissal_story", "player_out_id route n:i of_total:i share:f share_lo:f share_hi:f balls_per:f", f"""
  SELECT *, 100e0 * n / of_total AS share, 100 * {S.wilson('n', 'of_total', 'lo')} AS share_lo, 100 * {S.wilson('n', 'of_total', 'hi')} AS share_hi, 1e0 * b / n AS balls_per
  FROM (SELECT player_out_id, route, count(*) AS n, sum(count(*)) OVER (PARTITION BY player_out_id) AS of_total FROM dis GROUP BY 1, 2)
  LEFT JOIN (SELECT batter_id AS player_out_id, sum(faced::INT) AS b FROM balls GROUP BY 1) USING (player_out_id)""", E.dismissal_story)
_SD = {"format_group": "format_group", "phase": "phase", "over_no": "(over + 1)::VARCHAR", "bowler_id": "bowler_id", "fielder_id": "fielder_id", "year": "year::VARCHAR",
       "score": "CASE WHEN batter_runs_before >= 50 THEN '50+' WHEN batter_runs_before >= 30 THEN '30-49' WHEN batter_runs_before >= 10 THEN '10-29' ELSE '0-9' END"}
add("P16_story_splits", "player_out_id route dimension bucket n:i", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT player_out_id, route, '{d}' AS dimension, {e} AS bucket, count(*) AS n FROM dis GROUP BY 1, 2, 4" for d, e in _SD.items()) + ") WHERE bucket IS NOT NULL", E.story_splits)

# ---------------------------------------------------------------- states
_W = "CASE WHEN wickets_before > 5 THEN '6+' WHEN wickets_before > 2 THEN '3-5' ELSE '0-2' END"
_BATD = {"balls_faced": "CASE WHEN batter_balls_before >= 50 THEN '51+' WHEN batter_balls_before >= 30 THEN '31-50' WHEN batter_balls_before >= 20 THEN '21-30' WHEN batter_balls_before >= 10 THEN '11-20' ELSE '1-10' END",
         "wickets": _W, "innings": "CASE WHEN chasing THEN 'chasing' ELSE 'setting' END", "chase_state": "chase_state", "phase": "phase", "all": "'all'"}
_BOWLD = {"batter_stage": "batter_stage", "defending": "CASE WHEN chasing THEN 'defending' ELSE 'bowling first' END", "chase_state": "chase_state",
          "spell_over": "['1st', '2nd', '3rd', '4th+'][least(k, 4)]", "wickets": _W, "phase": "phase", "all": "'all'"}


def _states_sql(src: str, dims: dict, scale: str, band_expr: str, mode: str, n: str, r: str, o: str) -> str:
    # every ball once with its buckets as a list; both sums read that one pass
    buckets = ", ".join(f"{{'dimension': '{d}', 'bucket': {e}}}" for d, e in dims.items())
    sums = "sum(n) AS n, sum(r) AS s, sum(r * r) AS ss, sum(o) AS outs"
    return f"""WITH seen AS MATERIALIZED (SELECT pid, format_group, gender, {band_expr} AS band, {n} AS n, {r} AS r, {o} AS o, [{buckets}] AS bs FROM {src}),
      long AS (SELECT pid, format_group, gender, band, n, r, o, b.dimension AS dimension, b.bucket AS bucket FROM (SELECT *, unnest(bs) AS b FROM seen)),
      me AS MATERIALIZED (SELECT pid, format_group, gender, dimension, bucket, {sums} FROM long WHERE bucket IS NOT NULL GROUP BY ALL HAVING sum(n) > 0),
      peer AS MATERIALIZED (SELECT *, {scale} * s / n AS pm, 100e0 * outs / n AS pr FROM (SELECT format_group, gender, band, dimension, bucket, {sums} FROM long WHERE bucket IS NOT NULL GROUP BY ALL HAVING sum(n) > 0)),
      mine AS MATERIALIZED (SELECT me.*, band, {scale} * s / n AS main, 100e0 * outs / n AS risk, {scale} * sqrt((CASE WHEN n > 1 THEN greatest(1e-9, (ss - n * (s::DOUBLE / n) * (s::DOUBLE / n)) / (n - 1)) END) / n) AS se
               FROM me LEFT JOIN ({mode}) USING (pid, format_group, gender))
      SELECT m.pid, m.format_group, m.gender, m.band, m.dimension, m.bucket, m.n, m.outs, m.main, m.risk, m.main - {S.Z} * m.se AS main_lo, m.main + {S.Z} * m.se AS main_hi,
        100 * {S.wilson('m.outs', 'm.n', 'lo')} AS risk_lo, p.pm AS peer_main, (m.main - b.main) - (p.pm - q.pm) AS relative_main, (m.risk - b.risk) - (p.pr - q.pr) AS relative_risk,
        b.main + (p.pm - q.pm) AS expected_if_typical, coalesce(abs(b.main + (p.pm - q.pm) - m.main) > 2.576 * m.se AND m.n >= 80, FALSE) AS clear
      FROM mine m JOIN mine b ON b.pid = m.pid AND b.format_group = m.format_group AND b.gender = m.gender AND b.dimension = 'all'
      LEFT JOIN peer p ON p.format_group = m.format_group AND p.gender = m.gender AND p.band = m.band AND p.dimension = m.dimension AND p.bucket = m.bucket
      LEFT JOIN peer q ON q.format_group = m.format_group AND q.gender = m.gender AND q.band = m.band AND q.dimension = 'all'
      WHERE m.dimension <> 'all'"""


_BAND = "CASE WHEN {p} > 7 THEN 'lower' WHEN {p} > 3 THEN 'middle' ELSE 'top' END"
_MODE = f"""SELECT pid, format_group, gender, {_BAND.format(p='pos')} AS band FROM (SELECT batter_id AS pid, format_group, gender, batter_position AS pos,
   row_number() OVER (PARTITION BY batter_id, format_group, gender ORDER BY count(*) DESC, batter_position) AS i FROM balls WHERE faced GROUP BY 1, 2, 3, 4) WHERE i = 1"""
_STATE = "pid format_group gender band dimension bucket n:i outs:i main:f risk:f main_lo:f main_hi:f risk_lo:f peer_main:f relative_main:f relative_risk:f expected_if_typical:f clear:b"
_FEW = {"T20": 40, "ODI": 40}
add("P38_batting_states", _STATE, _states_sql("(SELECT *, batter_id AS pid, 1 AS one FROM balls WHERE faced)", _BATD, "100e0", _BAND.format(p="batter_position"), _MODE, "one", "runs_batter", "striker_dismissed::INT"),
    lambda ws: E.states(ws, "batting", _FEW))
add("P38_bowling_states", _STATE, _states_sql("""(SELECT b.*, b.bowler_id AS pid, runs_batter + wides + noballs AS rc, k FROM balls b JOIN (SELECT match_id, innings_no, bowler_id, over,
    row_number() OVER (PARTITION BY match_id, innings_no, bowler_id, spell_no ORDER BY over) AS k FROM spells) s USING (match_id, innings_no, bowler_id, over))""", _BOWLD, "6e0", "'all'",
    "SELECT DISTINCT bowler_id AS pid, format_group, gender, 'all' AS band FROM balls", "legal::INT", "rc", "wk"), lambda ws: E.states(ws, "bowling", _FEW))

# ---------------------------------------------------------------- splits
_SPLIT = {k: v.replace("coalesce(chasing, false)", "chasing") for k, v in E.SPLITS.items()}


def _agg(out, pre, cond="TRUE"):
    return (f"sum((faced AND {cond})::INT) AS {pre}n, coalesce(sum(runs_batter) FILTER (WHERE faced AND {cond}), 0) AS {pre}runs, coalesce(sum(runs_batter * runs_batter) FILTER (WHERE faced AND {cond}), 0) AS {pre}ss, "
            f"sum((faced AND hit AND {cond})::INT) AS {pre}bnd, sum((faced AND runs_batter = 0 AND {cond})::INT) AS {pre}dots, coalesce(sum({out}) FILTER (WHERE {cond}), 0) AS {pre}outs")


def _long(src, keys, out):
    parts = [f"SELECT {keys}, '{k}' AS split, {_agg(out, 'in_', '(' + c + ')')} FROM {src} GROUP BY ALL" for k, c in _SPLIT.items()]
    parts.append(f"SELECT {keys}, 'opp:' || bowling_team AS split, {_agg(out, 'in_')} FROM {src} GROUP BY ALL")
    names = ", ".join(k.split(" AS ")[-1] for k in keys.split(", "))
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) JOIN (SELECT {keys}, {_agg(out, 't_')} FROM {src} GROUP BY ALL) USING ({names}))"


_LOW_IN, _LOW_OUT = 40, 60
_OUT = {f: f"(t_{f} - in_{f})" for f in E.FIELDS}
_tests = []
for _mt, _f in (("out_rate", "outs"), ("bnd_rate", "bnd"), ("dot_rate", "dots")):
    _a = (f"in_{_f}", "in_n", f"out_{_f}", "out_n")
    _ty = f"((li_{_f}::DOUBLE / greatest(li_n, 1)) / nullif(lo_{_f}::DOUBLE / greatest(lo_n, 1), 0))"
    _rest = f"(out_{_f}::DOUBLE / out_n)"
    _tests.append(f"""SELECT batter_id, format_group, gender, band, split, in_n, out_n, '{_mt}' AS metric, 'rate' AS kind, 1e0 AS nul, nullif({_ty}, 0) AS typical,
      ((in_{_f} + {E.K_SHRINK}e0 * ({_rest} * {_ty})) / (in_n + {E.K_SHRINK}) / CASE WHEN out_{_f} > 0 THEN {_rest} ELSE 1e-9 END) / {_ty} AS effect,
      {S.ratio(*_a)} * exp(-{S.Z} * {S.ratio_se(*_a)}) / {_ty} AS lo, {S.ratio(*_a)} * exp({S.Z} * {S.ratio_se(*_a)}) / {_ty} AS hi,
      {S.two_sided(f'(ln({S.ratio(*_a)} / nullif({_ty}, 0)) / {S.ratio_se(*_a)})')} AS p FROM judged""")
_se = S.mean_se("in_runs", "in_ss", "in_n", "out_runs", "out_ss", "out_n")
_ty = "(li_runs::DOUBLE / nullif(li_n, 0) - lo_runs::DOUBLE / nullif(lo_n, 0))"
_df = "(in_runs::DOUBLE / in_n - out_runs::DOUBLE / out_n)"
_tests.append(f"""SELECT batter_id, format_group, gender, band, split, in_n, out_n, 'sr', 'mean', 0e0, 100 * {_ty},
   100 * ((in_runs + {E.K_SHRINK}e0 * (out_runs::DOUBLE / out_n + {_ty})) / (in_n + {E.K_SHRINK}) - out_runs::DOUBLE / out_n) - 100 * {_ty}, 100 * ({_df} - {S.Z} * {_se} - {_ty}), 100 * ({_df} + {S.Z} * {_se} - {_ty}),
   {S.two_sided(f'(({_df} - {_ty}) / {_se})')} FROM judged""")


def _seen(f, kind):
    i, o = f"in_{f}::DOUBLE / in_n", f"(t_{f} - in_{f})::DOUBLE / (t_n - in_n)"
    v = f"({i}) / CASE WHEN {o} > 0 THEN {o} ELSE 1e-9 END" if kind == "rate" else f"100 * ({i} - {o})"
    return f"CASE WHEN in_n >= 30 AND t_n - in_n >= 30 THEN {v} END"


_halves = " UNION ALL ".join(f"SELECT batter_id, format_group, gender, late, split, '{m}' AS metric, {_seen(f, k)} AS seen FROM hl"
                             for m, f, k in (("out_rate", "outs", "rate"), ("bnd_rate", "bnd", "rate"), ("dot_rate", "dots", "rate"), ("sr", "runs", "mean")))
_KEYS = "batter_id, format_group, gender"
SPLIT_SQL = f"""
WITH mid AS (SELECT {_KEYS}, list_sort(list(batter_position::INT) FILTER (WHERE faced))[(sum(faced::INT) // 2 + 1)::INT] AS mid, list_sort(list(start_date) FILTER (WHERE faced))[(sum(faced::INT) // 2 + 1)::INT] AS md FROM balls GROUP BY ALL),
 own AS (SELECT * FROM {_long('balls', _KEYS, 'striker_dismissed::INT')}),
 hl AS (SELECT * FROM {_long('(SELECT b.*, b.start_date >= md AS late FROM balls b JOIN mid USING (batter_id, format_group, gender))', _KEYS + ', late', 'striker_dismissed::INT')}),
 lg AS (SELECT format_group, gender, band, split, {', '.join(f'in_{f} AS li_{f}, t_{f} - in_{f} AS lo_{f}' for f in E.FIELDS)} FROM {_long(f"(SELECT *, {_BAND.format(p='batter_position')} AS band FROM balls)", 'format_group, gender, band', 'outs')}),
 cand AS (SELECT *, {', '.join(f't_{f} - in_{f} AS out_{f}' for f in E.FIELDS)} FROM own WHERE in_n >= {_LOW_IN} AND t_n - in_n >= {_LOW_OUT}),
 kept AS (SELECT *, {_BAND.format(p='mid')} AS band FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, split LIKE 'opp:%' ORDER BY in_n DESC, split) AS place FROM cand) JOIN mid USING ({_KEYS})
          WHERE split NOT LIKE 'opp:%' OR place <= 8),
 judged AS (SELECT * FROM kept JOIN lg USING (format_group, gender, band, split)),
 tests AS (SELECT * FROM ({' UNION ALL '.join(_tests)}) WHERE typical IS NOT NULL AND p IS NOT NULL),
 bh AS (SELECT {_KEYS}, max(p) AS edge FROM (SELECT *, count(*) OVER (PARTITION BY {_KEYS} ORDER BY p) AS r, count(*) OVER (PARTITION BY {_KEYS}) AS m FROM tests) WHERE p <= 0.3 * r / m GROUP BY ALL),
 hv AS (SELECT {_KEYS}, split, metric, max(seen) FILTER (WHERE NOT late) AS e, max(seen) FILTER (WHERE late) AS l FROM ({_halves}) GROUP BY ALL),
 fin AS (SELECT *, CASE WHEN effect > nul THEN 'higher' ELSE 'lower' END AS direction, coalesce(p <= edge, FALSE) AS passed,
   CASE WHEN kind = 'rate' THEN abs(effect - 1) >= 0.25 ELSE abs(effect) >= CASE WHEN format_group = 'T20' THEN 15 ELSE 10 END END AND (lo > nul OR hi < nul) AS effect_ok
   FROM tests LEFT JOIN bh USING ({_KEYS}) LEFT JOIN hv USING ({_KEYS}, split, metric))
SELECT *, (direction = 'higher') = (metric IN ('bnd_rate', 'sr')) AS strength, passed AND effect_ok AS card,
  CASE WHEN e IS NULL OR l IS NULL THEN 'not enough data' WHEN (e > typical) = (direction = 'higher') AND (l > typical) = (direction = 'higher') THEN 'same' ELSE 'not consistent' END AS stability FROM fin"""
_LI, _LO = {"T20": _LOW_IN, "ODI": _LOW_IN}, {"T20": _LOW_OUT, "ODI": _LOW_OUT}
add("P39_strengths_weaknesses", "batter_id format_group gender band split metric in_n:i out_n:i effect:f typical:f lo:f hi:f p:f passed:b effect_ok:b strength:b stability card:b",
    f"SELECT * FROM ({SPLIT_SQL})", lambda ws: E.split_tests(ws, _LI, _LO, 0.3))
_FEW_OPPONENTS = "          WHERE split NOT LIKE 'opp:%' OR place <= 8)"
add("T13_diff_in_diff", "batter_id format_group gender split effect:f lo:f hi:f p:f", f"SELECT * FROM ({SPLIT_SQL.replace(_FEW_OPPONENTS, ')')}) WHERE metric = 'sr'",
    lambda ws: E.split_tests(ws, _LI, _LO, 0.3, None).filter("metric = 'sr'"))
add("T14_both_halves", "batter_id format_group gender split metric stability", f"SELECT * FROM ({SPLIT_SQL}) WHERE passed", lambda ws: E.split_tests(ws, _LI, _LO, 0.3).filter("passed"))

# ---------------------------------------------------------------- fingerprints
_FEWP, _FEWD = {"T20": 100, "ODI": 100}, {"T20": 30, "ODI": 30}
_BS = {k: v.replace("coalesce(chasing, false)", "chasing") for k, v in E.BAT_SUBSETS.items()}
_WS = {k: v.replace("coalesce(chasing, false)", "chasing") for k, v in E.BOWL_SUBSETS.items()}
_sub = lambda subsets, n, r: ", ".join(f"sum(({n} AND {c})::INT) AS {t}_b, sum({r}) FILTER (WHERE {c}) AS {t}_r" for t, c in subsets.items())
_q = lambda x, n, k="100e0": (f"{k} * {x} / nullif({n}, 0)", n)
_BDIM = {"sr": _q("runs", "balls"), "boundary_pct": _q("hits", "balls"), "six_pct": _q("sixes", "balls"), "dot_pct": _q("dots", "balls"), "out_rate": _q("outs", "balls"),
         **{d: _q(f"{t}_r", f"{t}_b") for d, t in (("pp_sr", "pp"), ("mid_sr", "mid"), ("death_sr", "death"), ("chase_sr", "ch"), ("set_sr", "set"), ("top_sr", "top"), ("pressure_sr", "pr"), ("after30_sr", "a30"))},
         "after30_out": _q("a30_o", "a30_b"), "early_out": _q("b30_o", "b30_b"), "bowler_conc": _q("top3", "cred"), "route_conc": _q("rt", "outs")}
_WDIM = {"econ": _q("runs", "balls", "6e0"), "dot_pct": _q("dots", "balls"), "bnd_pct": _q("hits", "balls"), "extras_pct": _q("ex", "balls"), "wkt_rate": _q("wkts", "balls"), "stumps_share": _q("stumps", "wkts"),
         **{f"{t}_econ": _q(f"{t}_r", f"{t}_b", "6e0") for t in ("pp", "mid", "death", "def")}, "new_wkt": _q("new_w", "new_b"), "set_econ": _q("set_r", "set_b", "6e0")}
_K3 = "pid, gender, format_group"
_BATW = f"""(SELECT *, coalesce(o0, 0) AS outs, coalesce(a0, 0) AS a30_o, coalesce(b0, 0) AS b30_o, coalesce(t0, 0) AS top3, coalesce(c0, 0) AS cred, coalesce(r0, 0) AS rt FROM
  (SELECT batter_id AS pid, gender, format_group, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum((faced AND runs_batter = 0)::INT) AS dots, sum(hit::INT) AS hits, sum(is_six::INT) AS sixes, {_sub(_BS, 'faced', 'runs_batter')} FROM balls GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT player_out_id AS pid, gender, format_group, count(*) AS o0, sum((batter_balls_before >= 30 AND striker_out)::INT) AS a0, sum((batter_balls_before < 30 AND striker_out)::INT) AS b0 FROM dis GROUP BY 1, 2, 3) USING ({_K3})
  LEFT JOIN (SELECT {_K3}, sum(k) AS c0, sum(k) FILTER (WHERE i < 4) AS t0 FROM (SELECT player_out_id AS pid, gender, format_group, count(*) AS k, row_number() OVER (PARTITION BY player_out_id, gender, format_group ORDER BY count(*) DESC, bowler_id) AS i
      FROM dis WHERE route <> 'RUN_OUT' GROUP BY player_out_id, gender, format_group, bowler_id) GROUP BY 1, 2, 3) USING ({_K3})
  LEFT JOIN (SELECT {_K3}, max(k) AS r0 FROM (SELECT player_out_id AS pid, gender, format_group, route, count(*) AS k FROM dis GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING ({_K3}))"""
_BOWLW = f"""(SELECT *, coalesce(s0, 0) AS stumps FROM (SELECT bowler_id AS pid, gender, format_group, sum(legal::INT) AS balls, sum(rc) AS runs, sum((legal AND rc = 0)::INT) AS dots, sum(hit::INT) AS hits, sum((NOT legal)::INT) AS ex,
    sum(wk) AS wkts, coalesce(sum(wk) FILTER (WHERE batter_balls_before < 10), 0) AS new_w, {_sub(_WS, 'legal', 'rc')} FROM (SELECT *, runs_batter + wides + noballs AS rc FROM balls) GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT bowler_id AS pid, gender, format_group, count(*) AS s0 FROM dis WHERE kind IN ('bowled', 'lbw') GROUP BY 1, 2, 3) USING ({_K3}))"""


def print_sql(wide, dims):
    long = " UNION ALL ".join(f"SELECT {_K3}, balls, '{d}' AS dimension, {v} AS value, {n} AS n FROM {'w'}" for d, (v, n) in dims.items())
    return f"""WITH w AS (FROM {wide}), f AS (SELECT *, value IS NOT NULL AND n >= CASE WHEN dimension IN ('bowler_conc', 'route_conc', 'stumps_share') THEN 5 ELSE 30 END AS enough FROM ({long})),
      pool AS (SELECT gender, format_group, dimension, value FROM f WHERE enough AND balls >= 100)
      SELECT f.*, z.pool_n, CASE WHEN enough THEN 100e0 * (SELECT sum((p.value < f.value)::INT) + 0.5e0 * sum((p.value = f.value)::INT) FROM pool p WHERE p.gender = f.gender AND p.format_group = f.format_group AND p.dimension = f.dimension) / nullif(pool_n, 0) END AS percentile
      FROM f LEFT JOIN (SELECT gender, format_group, dimension, count(*) AS pool_n FROM pool GROUP BY 1, 2, 3) z USING (gender, format_group, dimension)"""


_FP = "pid gender format_group dimension value:f n:i enough:b percentile:f"
add("P40_batting_fingerprint", _FP, f"SELECT * FROM ({print_sql(_BATW, _BDIM)})", lambda ws: E.fingerprint(ws, "batting", _FEWP, _FEWD, 5))
add("P41_bowling_fingerprint", _FP, f"SELECT * FROM ({print_sql(_BOWLW, _WDIM)})", lambda ws: E.fingerprint(ws, "bowling", _FEWP, _FEWD, 5))
add("P42_extremes", "pid gender format_group dimension rank:i percentile:f", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, gender, format_group ORDER BY abs(percentile - 50) DESC, dimension) AS rank
    FROM ({print_sql(_BATW, _BDIM)}) WHERE percentile <= 12 OR percentile >= 88) WHERE rank <= 6""", lambda ws: E.extremes(E.fingerprint(ws, "batting", _FEWP, _FEWD, 5)))
