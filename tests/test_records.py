"""Queries that go through whole tables: every definition of the record book, every opponent of a batter."""
import datetime

import duckdb
import pytest

from inswing.catalog.registry import QUERIES
from inswing.operators import evidence as E
from inswing.operators import recordbook as rb
from inswing.plans.workspace import Workspace
from tests.test_queries import _rows
from tests.test_scale import LINE


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Lines of a dozen matches; 42 balls a match."""
    day = datetime.date(2020, 1, 1)
    rows = [(60 * m + 10 * (k % 6), 1 + (m * 7 + k) % 90, k % 50, 1 + k // 6, float(1 + (k * 11 + m * 5) % 50), float(k), day) for m in range(3, 15) for k in range(42)]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["R11_containing", "R11_siblings"])
def test_all_definitions_of_the_book_take_part(spark, lines, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{lines}/lineitem.parquet/*.parquet')")
    got = QUERIES[name].run(spark, lines).toArrow()
    assert _rows(got.to_pandas()) == _rows(con.sql(QUERIES[name].oracle()).to_arrow_table().to_pandas())
    found = set(got.column("def_id").to_pylist())
    assert {"highest-score", "most-runs", "best-figures", "most-wickets", "season-runs"} <= found
    assert found <= {r.id for r in rb.RECORDS}


def test_no_opponent_is_left_out(spark, tmp_path):
    keys = "batter_id string, format_group string, gender string"
    sums = ", ".join(f"{side}_{f} long" for side in ("t", "in") for f in E.FIELDS)
    splits = [f"opp:t{i:02d}" for i in range(12)]
    part = [100, 120, 300, 12, 40, 5]
    own = [("a", "T20", "male", s, 1200, 1500, 4000, 150, 480, 60, *[x + i for x in part]) for i, s in enumerate(splits)]
    league = [("T20", "male", "top", s, *r[4:]) for s, r in zip(splits, own)]
    half = [(*r[:3], late, *r[3:]) for r in own for late in (False, True)]
    ws = Workspace(spark, str(tmp_path), given={
        "balls": spark.createDataFrame([("a", "T20", "male", True, 1)], f"{keys}, faced boolean, batter_position int"),
        "split_own": spark.createDataFrame(own, f"{keys}, split string, {sums}"),
        "split_half": spark.createDataFrame(half, f"{keys}, late boolean, split string, {sums}"),
        "split_league": spark.createDataFrame(league, f"format_group string, gender string, band string, split string, {sums}")})
    got = QUERIES["T13_diff_in_diff"].fn(ws).toArrow()
    assert sorted(got.column("split").to_pylist()) == splits
