"""Win probability by states, with its SQL.

The test tables hold few innings that run their whole length, so the queries also accept matches with a short first innings."""
from __future__ import annotations

from inswing.catalog.registry import add
from inswing.models import winprob as W

ACCEPT = ("eligible", "incomplete_first_innings")


def _of(values: dict) -> str:
    return f"CASE WHEN format_group = 'T20' THEN {values['T20']} ELSE {values['ODI']} END"


_ROWS = f"""pop AS (SELECT match_id, start_date, CASE WHEN match_no % 4 = 0 THEN 300 ELSE 120 END AS full_length, i1_runs,
    CASE WHEN result = 'tie' THEN 0.5 WHEN winner = team1 THEN 1 ELSE 0 END AS label, i1_balls < CASE WHEN match_no % 4 = 0 THEN 300 ELSE 120 END AND i1_wkts < 10 AS short,
    result IS NULL AND winner = team1 AND i2_balls < CASE WHEN match_no % 4 = 0 THEN 300 ELSE 120 END AND i2_wkts < 10 AS odd
  FROM matches WHERE method IS DISTINCT FROM 'D/L'),
sit AS (SELECT delivery_id, format_group, gender, innings_no, legal_balls_before AS bowled, score_before AS score, wickets_before AS wickets, target_runs AS target, full_length AS lim, i1_runs AS t1,
    CASE WHEN p.start_date < DATE '{W.TRAIN_BEFORE}' THEN 'train' WHEN p.start_date <= DATE '{W.VALIDATE_UNTIL}' THEN 'validate' ELSE 'test' END AS split,
    CASE WHEN innings_no = 1 THEN label ELSE 1 - label END AS y
  FROM balls b JOIN pop p USING (match_id) WHERE legal AND (short OR NOT odd) AND legal_balls_before < full_length AND wickets_before < 10)"""
_PAR = """pm AS (SELECT format_group, gender, lim, bowled, avg(score) AS mean, count(*) AS n FROM sit WHERE split = 'train' AND innings_no = 1 GROUP BY ALL),
pg AS (SELECT format_group, gender, lim, unnest(generate_series(0, lim)) AS bowled FROM (SELECT DISTINCT format_group, gender, lim FROM pm)),
par AS (SELECT format_group, gender, bowled, coalesce(n, 0) AS n, coalesce(last_value(mean IGNORE NULLS) OVER (PARTITION BY format_group, gender ORDER BY bowled), 0) AS par
  FROM pg LEFT JOIN pm USING (format_group, gender, lim, bowled))"""
add("M14_par_score", "format_group gender bowled:i n:i par:f", f"WITH {_ROWS}, {_PAR} SELECT * FROM par",
    lambda ws: W.par(W.situations(ws, ACCEPT).where("split = 'train'")))
add("M14_first_totals", "format_group gender innings:i mean:f sd:f",
    f"WITH {_ROWS} SELECT format_group, gender, count(*) AS innings, avg(t1) AS mean, stddev_samp(t1) AS sd FROM sit WHERE split = 'train' AND innings_no = 1 AND bowled = 0 GROUP BY ALL",
    lambda ws: W.totals(W.situations(ws, ACCEPT).where("split = 'train'")))
add("M14_remaining_runs", "format_group gender left:i wickets:i width:i n:i mean:f sd:f", f"""WITH {_ROWS},
cell AS (SELECT format_group, gender, lim - bowled AS l, wickets, count(*) AS n, sum(t1 - score) AS s, sum((t1 - score) * (t1 - score)) AS ss FROM sit WHERE split = 'train' AND innings_no = 1 GROUP BY ALL),
grid AS (SELECT format_group, gender, lim, l, w AS wickets, {_of(W.FIRST_WIDTH)} << j AS width, j FROM (SELECT DISTINCT format_group, gender, lim FROM sit WHERE split = 'train' AND innings_no = 1),
  unnest(generate_series(1, lim)) AS a(l), unnest(generate_series(0, 9)) AS b(w), unnest(generate_series(0, 6)) AS c(j)),
win AS (SELECT g.format_group, g.gender, g.lim, g.l, g.wickets, g.width, coalesce(sum(c.n), 0) AS n, sum(c.s) AS s, sum(c.ss) AS ss
  FROM grid g LEFT JOIN cell c ON c.format_group = g.format_group AND c.gender = g.gender AND c.wickets = g.wickets AND c.l BETWEEN g.l - g.width AND g.l + g.width GROUP BY ALL),
raw AS (SELECT *, s / n AS m FROM win WHERE n >= {W.ENOUGH} OR width > lim QUALIFY row_number() OVER (PARTITION BY format_group, gender, l, wickets ORDER BY width) = 1),
fill AS (SELECT format_group, gender, l, wickets, width, n, coalesce(last_value(CASE WHEN n > 0 THEN m END IGNORE NULLS) OVER f, 0) AS m,
  coalesce(last_value(CASE WHEN n > 0 THEN greatest(sqrt(greatest(ss / n - m * m, 0)), {W.LEAST_SD}) END IGNORE NULLS) OVER f, {W.LEAST_SD}) AS sd
  FROM raw WINDOW f AS (PARTITION BY format_group, gender, l ORDER BY wickets)),
down AS (SELECT *, min(m) OVER (PARTITION BY format_group, gender, l ORDER BY wickets) AS d FROM fill)
SELECT format_group, gender, l AS "left", wickets, width, n, max(d) OVER (PARTITION BY format_group, gender, wickets ORDER BY l) AS mean, sd FROM down""",
    lambda ws: W.remaining(W.situations(ws, ACCEPT).where("split = 'train'")))

_KEYS = ["{b}, {w}, {r}", "floor({b} / 2), floor({w} / 2), floor({r} / 2)", "floor({b} / 4), CASE WHEN {w} <= 2 THEN 0 WHEN {w} <= 5 THEN 1 ELSE 2 END, floor({r} / 4)", "floor({b} / 8), 0, floor({r} / 8)", "0, 0, 0"]
_keys = [k.format(b="balls_bin", w="wickets", r="runs_bin") for k in _KEYS]
_G = "format_group, gender, innings_no"
_BINS = f"""bins AS (SELECT sit.* REPLACE (wickets::DOUBLE AS wickets), floor((lim - bowled - 1) / ({_of(W.BALL_BIN)})) AS balls_bin,
  CASE WHEN innings_no = 1 THEN floor(greatest(least(score - par, {_of(W.LEAD_END)}), -({_of(W.LEAD_END)})) / ({_of(W.LEAD_BIN)}))
    ELSE least(floor((target - score) / ({_of(W.NEED_BIN)})), {_of(W.NEED_END)}) END AS runs_bin FROM sit JOIN par USING (format_group, gender, bowled))"""
_TABLE = "tab AS (" + " UNION ALL ".join(
    f"SELECT {_G}, {i} AS level, row({k}) AS cell, count(*) AS n, sum(y) AS won FROM bins WHERE split = 'train' GROUP BY ALL" for i, k in enumerate(_keys)) + ")"


def _back(states: str, k: str) -> str:
    """States with p, one step from coarse to fine after the other."""
    steps = [f"p4 AS (SELECT s.*, t.won / t.n AS p, {k} AS k FROM {states} s JOIN tab t USING ({_G}){', unnest(' + str(W.SHRINK) + ') AS u(try)' if k == 'try' else ''} WHERE t.level = 4)"]
    for i in (3, 2, 1, 0):
        steps.append(f"p{i} AS (SELECT s.* REPLACE (CASE WHEN t.n > 0 THEN (t.won + k * p) / (t.n + k) ELSE p END AS p) FROM (SELECT *, row({_keys[i]}) AS cell FROM p{i + 1}) s "
                     f"LEFT JOIN (SELECT * FROM tab WHERE level = {i}) t USING ({_G}, cell))".replace("SELECT s.* REPLACE", "SELECT s.* EXCLUDE (cell) REPLACE"))
    return ", ".join(steps)


_CLIPPED = f"greatest(least(p, 1 - {W.CLIP}), {W.CLIP})"
_TRIED = f"""{_back("(SELECT * FROM bins WHERE split = 'validate')", 'try')}, tried AS (SELECT {_G}, k, count(*) AS balls,
  avg(-(y * ln({_CLIPPED}) + (1 - y) * ln(1 - {_CLIPPED}))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM p0 GROUP BY ALL)"""
_HEAD = f"WITH {_ROWS}, {_PAR}, {_BINS}, {_TABLE}, {_TRIED}"
_TEST = _back("(SELECT * FROM bins JOIN chosen USING (" + _G + ") WHERE split = 'test')", "best")
for _i in range(5):
    _TEST = _TEST.replace(f"p{_i} AS", f"q{_i} AS").replace(f"FROM p{_i})", f"FROM q{_i})")
add("M15_state_table", "format_group gender innings_no:i level:i cells:i balls:i largest:i",
    f"WITH {_ROWS}, {_PAR}, {_BINS}, {_TABLE} SELECT {_G}, level, count(*) AS cells, sum(n) AS balls, max(n) AS largest FROM tab GROUP BY ALL",
    lambda ws: W.StateModel(ws, ACCEPT).table.groupBy(*W.GROUP, "level").agg(*map(W.F.expr, ("count(*) AS cells", "sum(n) AS balls", "max(n) AS largest"))))
add("M15_shrinkage", "format_group gender innings_no:i k:i balls:i log_loss:f brier:f", f"{_HEAD} SELECT * FROM tried", lambda ws: W.StateModel(ws, ACCEPT).tried)
add("M15_win_probability", "delivery_id y:f p:f", f"""{_HEAD}, chosen AS (SELECT {_G}, min(struct_pack(l := round(log_loss, 10), k := k)).k AS best FROM tried GROUP BY ALL), {_TEST} SELECT delivery_id, y, p FROM q0""",
    lambda ws: W.StateModel(ws, ACCEPT).probabilities())
