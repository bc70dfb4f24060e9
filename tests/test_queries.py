"""Every query with SQL must give the same rows in Spark and in DuckDB."""
import pytest

import inswing.catalog  # noqa: F401
from inswing.catalog.registry import QUERIES
from tests.conftest import SF

SAMPLE = ["D01_running_score", "D03_partnership_before", "D13_dismissal_route", "D18_recent_window", "D19_streaks", "D24_bat_innings", "D26_battles", "L04_strike_rate",
          "L22_pair_dismissals", "F12_state", "R05_pair_runs", "P11_situations", "P14_battle_breakdown", "B26_best_pairs_runs", "E08_rivalry"]


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("-" if v is None or v != v else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    q = QUERIES[name]
    got = q.run(spark, SF).toArrow()
    want = duck.sql(q.oracle()).to_arrow_table()
    assert _rows(got.to_pandas()) == _rows(want.to_pandas())


def test_names_and_columns():
    assert all(q.columns for q in QUERIES.values())
