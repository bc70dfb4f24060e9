"""Question templates with their SQL."""
from __future__ import annotations

from inswing.catalog import sqlstats as S
from inswing.catalog.registry import add
from inswing.operators import evidence as E, libraries as L, players as P, questions as Q


def _change(first: str, second: str, few: int, more: int) -> str:
    sums = ", ".join(f"sum((faced AND {t})::INT) AS n_{g}, coalesce(sum(runs_batter) FILTER (WHERE faced AND {t}), 0) AS s_{g}" for g, t in (("a", first), ("b", second)))
    return f"""SELECT *, change - 100 * (u_b - u_a) AS vs_typical FROM (SELECT *, 100e0 * s_a / n_a AS sr_a, 100e0 * s_b / n_b AS sr_b, 100 * ((s_b + 60 * u_b) / (n_b + 60) - s_a::DOUBLE / n_a) AS change
      FROM (SELECT *, sum(s_a) OVER w / (sum(n_a) OVER w)::DOUBLE AS u_a, sum(s_b) OVER w / (sum(n_b) OVER w)::DOUBLE AS u_b
        FROM (SELECT batter_id, format_group, gender, {sums} FROM balls GROUP BY ALL) WHERE n_a >= {few} AND n_b >= {more} WINDOW w AS (PARTITION BY format_group, gender)))"""


_COLS = "batter_id format_group gender n_a:i n_b:i sr_a:f sr_b:f change:f vs_typical:f"
add("K08_phase_change", _COLS, _change("phase = 'middle'", "phase = 'death'", 10, 10), lambda ws: Q.change(ws, "phase = 'middle'", "phase = 'death'", 10, 10))
add("K09_faced_change", _COLS, _change("batter_balls_before < 20", "batter_balls_before >= 20", 30, 30), lambda ws: Q.change(ws, "batter_balls_before < 20", "batter_balls_before >= 20", 30, 30))
_SIDES = " UNION ALL ".join(f"""SELECT batter_id, '{t}' AS t, sum(faced::INT) AS n, sum(runs_batter) AS runs, sum((faced AND hit)::INT) AS bnd, sum((faced AND runs_batter = 0)::INT) AS dots,
    count(*) FILTER (WHERE delivery_id IN (SELECT delivery_id FROM dis WHERE counts_as_dismissal AND player_out_id = balls.batter_id)) AS outs FROM balls WHERE batter_balls_before {o} 10 GROUP BY 1""" for t, o in (("a", "<"), ("b", ">=")))
add("K20_player_faced_change", "batter_id n_a:i n_b:i " + " ".join(f"{x}_{t}:f" for t in "ab" for x in ("runs", "bnd", "dots", "outs")), f"""WITH side AS MATERIALIZED ({_SIDES})
  SELECT a.batter_id, a.n AS n_a, b.n AS n_b, {", ".join(f"100e0 * {t}.{x} / {t}.n AS {x}_{t}" for t in "ab" for x in ("runs", "bnd", "dots", "outs"))}
  FROM side a JOIN side b ON a.batter_id = b.batter_id AND a.t = 'a' AND b.t = 'b' WHERE a.n > 0 AND b.n > 0""", lambda ws: Q.faced_change(ws, 10))
add("K19_scored_fastest_against", "batter_id bowler_id n:i sr:f", """SELECT *, 100 * (s + 60 * usual) / (n + 60) AS sr FROM (SELECT *, sum(s) OVER w / (sum(n) OVER w)::DOUBLE AS usual FROM (
    SELECT batter_id, bowler_id, sum(faced::INT) AS n, sum(runs_batter) AS s FROM balls GROUP BY 1, 2) WINDOW w AS (PARTITION BY batter_id)) WHERE n >= 20""", lambda ws: Q.scored_fastest_against(ws, 20))
add("K16_troubled_by", "batter_id bowler_id score:f", """SELECT batter_id, bowler_id, (outs - balls * batter_out_rate) / sqrt(greatest(1e0, balls * batter_out_rate)) + (100 * batter_rpb - 100e0 * runs / balls) / 40 AS score FROM battles WHERE balls >= 24""",
    lambda ws: Q.troubled_by(ws, 24))
add("K18_rivalry_battles", "gender side_a side_b batter_id bowler_id balls:i outs:i tail:f gap:f", f"""SELECT *, {S.poisson_tail('outs', 'expected')} AS tail FROM (
    SELECT g.*, g.balls * coalesce(t.batter_out_rate, 0e0) AS expected, 100 * (1e0 * g.runs / g.balls - coalesce(t.batter_rpb, 0)) AS gap FROM (
      SELECT gender, least(batting_team, bowling_team) AS side_a, greatest(batting_team, bowling_team) AS side_b, batter_id, bowler_id, sum(faced::INT) AS balls, sum(runs_batter) AS runs, sum(striker_credited::INT) AS outs
      FROM balls GROUP BY 1, 2, 3, 4, 5 HAVING sum(faced::INT) >= 12) g LEFT JOIN battles t USING (batter_id, bowler_id, gender)) WHERE outs > 1.8 * expected OR abs(gap) >= 35""", lambda ws: Q.rivalry_battles(ws, 12))
add("K06_bowler_summary", "bowler_id format_group balls:i wickets:i economy:f dot_pct:f", """SELECT bowler_id, format_group, sum(balls) AS balls, sum(wickets) AS wickets, 6e0 * sum(runs) / nullif(sum(balls), 0) AS economy, 100e0 * sum(dots) / nullif(sum(balls), 0) AS dot_pct
    FROM bowl_innings GROUP BY 1, 2""", Q.bowler_summary)
add("K26_pair_before", "batter_id bowler_id start_date:d n_before:i s_before:i o_before:i", """SELECT DISTINCT a.batter_id, a.bowler_id, a.start_date, coalesce(sum(b.n), 0) AS n_before, coalesce(sum(b.s), 0) AS s_before, coalesce(sum(b.o), 0) AS o_before
    FROM (SELECT DISTINCT batter_id, bowler_id, start_date FROM balls) a LEFT JOIN (SELECT batter_id, bowler_id, start_date, sum(faced::INT) AS n, sum(runs_batter) AS s, sum(striker_credited::INT) AS o FROM balls GROUP BY 1, 2, 3) b
    ON b.batter_id = a.batter_id AND b.bowler_id = a.bowler_id AND b.start_date < a.start_date GROUP BY 1, 2, 3""", Q.pair_before)
add("K10_partnership_leaderboard", "gender rank:i p1 p2 runs:i", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY runs DESC, p1, p2) AS rank FROM (SELECT gender, p1, p2, sum(runs) AS runs, sum(balls) AS b, count(*) AS n FROM partnerships GROUP BY 1, 2, 3)
    WHERE n >= 3 AND b >= 30) WHERE rank <= 10""", lambda ws: L.best_pairs(ws, "runs", None, 3, 30, 10))
add("K11_how_out", "player_out_id bucket n:i", "SELECT player_out_id, route AS bucket, count(*) AS n FROM dis GROUP BY 1, 2", lambda ws: P.dismissal_dna(ws).filter("dimension = 'route'"))
add("K13_spells_list", "bowler_id rank:i match_id innings_no:i death_wkts:i", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bowler_id ORDER BY death_wkts DESC, death_runs, match_id, innings_no) AS rank FROM bowl_innings WHERE death_balls > 0) WHERE rank <= 3""",
    lambda ws: P.ranked(ws["bowl_innings"].filter("death_balls > 0"), ["bowler_id"], [P.F.desc("death_wkts"), P.F.asc("death_runs"), P.F.asc("match_id"), P.F.asc("innings_no")], 3))
add("K05_matchup", "batter_id bowler_id balls:i strike_rate:f", "SELECT batter_id, bowler_id, sum(faced::INT) AS balls, 100e0 * sum(runs_batter) / sum(faced::INT) AS strike_rate FROM balls GROUP BY 1, 2 HAVING sum(faced::INT) >= 12", E.battle_edges)
