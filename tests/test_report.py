"""The quality report: one check at a time."""
from pyspark.sql import functions as F

from inswing.catalog.q_quality import faulty
from inswing.operators import quality


def test_report_keeps_one_row_for_each_check_and_no_plan_of_them(ws):
    staged = []

    def stage(df, name):
        staged.append(name)
        return ws.stage(df, name)
    out = quality.report(faulty(ws), stage)
    assert len(staged) == len(quality.CHECKS) == out.count()
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter(F.col("status") != "PASS").count() > 20
