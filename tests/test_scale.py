"""How the working tables are dealt to tasks: partitions by rows and overlong innings."""
import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter

import inswing.catalog  # noqa: F401
from inswing.plans import workspace
from inswing.sources import fixture

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate date"


@pytest.fixture(scope="module")
def long_innings(spark, tmp_path_factory):
    """One match whose first innings has 2,000 lines, one with 40 in each, and a line without a key."""
    day = datetime.date(2020, 1, 1)
    rows = [(60 * 7 + k % 30, k % 9, k % 50, 1 + k % 7, float(1 + k * 7 % 47), float(k), day) for k in range(2000)]
    rows += [(60 * m + k, k % 9, k % 50, 1 + k % 7, float(1 + k * 11 % 50), float(k), day) for m in (7, 8) for k in range(30 * (m == 7), 60)]
    rows.append((None, 1, 1, 1, 20.0, 1.0, day))
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, LINE).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_a_large_table_is_dealt_by_its_rows(spark, ws, monkeypatch):
    few = ws.spread(ws["deliveries"], "match_id")
    monkeypatch.setattr(workspace, "ROWS_PER_TASK", 300)
    many = ws.spread(ws["deliveries"], "match_id")
    assert many.rdd.getNumPartitions() == -(-ws["deliveries"].count() // 300) > 4
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0


def test_only_overlong_innings_are_cut_and_the_balls_are_the_same(spark, long_innings, monkeypatch):
    rows = {}
    for times in (4, 10 ** 6):
        monkeypatch.setattr(fixture, "OVERLONG", times)
        ws = workspace.Workspace(spark, long_innings)
        rows[times] = (ws["ball_facts"], ws["left_over_lines"])
        assert ws["overlong_innings"].count() == (times < 10)
        assert fixture.reconciliation(ws).filter("what = 'missing'").first()["n"] == 0
    for a, b in zip(rows[4], rows[10 ** 6]):
        assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_lines_that_need_no_cut_are_shuffled_once_and_narrow(spark, ws):
    plan = fixture._played(ws)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_deliveries_are_not_written_again(ws):
    assert all("/ball_facts/" in f for f in ws["deliveries"].inputFiles())


def test_relations_are_written_without_methods_that_the_jvm_interprets(spark, ws, monkeypatch):
    name, limit = workspace.METHOD_LIMIT
    before, seen = spark.conf.get(name), []
    whole = workspace.Workspace(spark, ws.inputs)
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(name)) or parquet(self, path))
    whole.prepare(["innings", "wickets"])
    whole.stage(whole["innings"], "copy")
    assert len(seen) > 3 and set(seen) == {limit} and spark.conf.get(name) == before


def test_relations_are_joined_by_the_size_of_their_rows(spark, tmp_path, monkeypatch):
    """Many rows in a small file, as equal ones are, must not be broadcast."""
    from inswing.plans.workspace import BUILDERS, Workspace

    monkeypatch.setitem(BUILDERS, "many", (lambda ws: spark.range(40_000).selectExpr("id", "repeat('x', 50) AS same"), ()))
    monkeypatch.setitem(BUILDERS, "joined", (lambda ws: ws["many"].join(ws["many"].withColumnRenamed("same", "other"), "id"), ()))
    plans = []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(self._df._jdf.sparkSession().sessionState().executePlan(
        self._df._jdf.queryExecution().logical(), self._df._jdf.queryExecution().mode()).executedPlan().toString()) or parquet(self, path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 << 20))
    try:
        ws = Workspace(spark, str(tmp_path))
        ws["many"], ws["joined"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plans[-1] and "SortMergeJoin" in plans[-1]
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


def test_documents_are_written_in_small_row_groups(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    rows = [(60 * m + 30 * i, 1, 1, 1 + k, 20.0, 1.0, day) for m in range(1, 401) for i in (0, 1) for k in (0, 1)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = workspace.Workspace(spark, str(tmp_path))["match_documents"]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in docs.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == docs.count() == 400 and max(groups) <= 64 < max(f.num_rows for f in files)
