"""Cases worked out by hand, apart from any SQL of ours."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inswing.functions import stats
from inswing.functions.special import beta_i, gamma_p
from inswing.models import chase
from inswing.operators import replay


def test_the_flagship_is_not_empty(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("rate", [0.1, 3.0, 40.0, 800.0, 1e3, 1e6])
def test_poisson_tails(rate):
    k = np.array([1.0, max(1.0, np.floor(rate)), np.floor(rate + 3 * math.sqrt(rate)) + 1])
    got = gamma_p(k, np.full(3, rate))
    assert got[0] == pytest.approx(-math.expm1(-rate))
    if rate > 30:  # about the median, and three deviations above it
        assert 0.48 < got[1] < 0.56 and 0.0005 < got[2] < 0.003
    # the term at k is the difference of two tails
    term = math.exp(k[1] * math.log(rate) - rate - math.lgamma(k[1] + 1))
    assert got[1] - gamma_p(k[1:2] + 1, np.array([rate]))[0] == pytest.approx(term, rel=1e-4)


def test_binomial_tails():
    assert beta_i(np.array([3.0]), np.array([8.0]), np.array([0.2]))[0] == pytest.approx(1 - sum(math.comb(10, i) * 0.2**i * 0.8**(10 - i) for i in range(3)))
    assert beta_i(np.array([5.0]), np.array([999_996.0]), np.array([1e-6]))[0] == pytest.approx(0.00365984, rel=1e-4)


def test_tails_as_columns(spark):
    df = spark.createDataFrame([(0, 5.0), (3, 2.0), (2000, 800.0), (None, 1.0), (2, 0.0)], "k int, rate double")
    got = [r[0] for r in df.select(stats.poisson_tail("k", "rate")).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(1 - 5 * math.exp(-2)) and 0 < got[2] < 1e-100 and got[4] == pytest.approx(1e-300)


BALL = "n_wickets int, wides int, noballs int, byes int, legbyes int, runs_batter int, runs_extras int, runs_total int, is_four boolean, is_six boolean"


def test_symbols(spark):
    rows = [(1, 0, 0, 0, 0, 4, 0, 4, True, False), (0, 5, 0, 0, 0, 0, 5, 5, False, False), (0, 0, 1, 0, 0, 0, 1, 1, False, False), (0, 0, 1, 0, 0, 2, 1, 3, False, False),
            (0, 0, 0, 0, 0, 6, 0, 6, False, True), (0, 0, 0, 0, 0, 4, 0, 4, True, False), (0, 0, 0, 0, 0, 0, 0, 0, False, False), (0, 0, 0, 4, 0, 0, 4, 4, False, False),
            (0, 0, 0, 0, 2, 0, 2, 2, False, False), (0, 0, 0, 0, 0, 3, 0, 3, False, False)]
    got = [r[0] for r in spark.createDataFrame(rows, BALL).select(replay.symbol()).collect()]
    assert got == ["W", "5wd", "nb", "2nb", "6", "4", "•", "4b", "2lb", "3"]


def test_result_lines(spark):
    rows = [("A", None, 1, None, None), ("A", None, 12, None, "D/L"), ("B", None, None, 1, None), ("B", None, None, 7, None), ("C", None, None, None, "Awarded"), (None, "tie", None, None, None),
            (None, "no result", None, None, None), (None, "draw", None, None, None), (None, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "winner string, result string, win_by_runs int, win_by_wickets int, method string").select(replay.result_line()).collect()]
    assert got == ["A won by 1 run", "A won by 12 runs (D/L)", "B won by 1 wicket", "B won by 7 wickets", "C won (Awarded)", "Match tied", "No result", "Draw", None]


def test_failure_curve_is_monotone_and_carried_over(spark):
    def balls(demand, fails, holds):
        return [("T20", "male", demand, i < fails, True, None, 5) for i in range(fails + holds)]
    rows = balls(0.1, 1, 9) + balls(0.3, 4, 6) + balls(0.5, 2, 8) + balls(1.0, 9, 1) + balls(7.0, 5, 5)
    df = spark.createDataFrame(rows, "format_group string, gender string, demand double, failed boolean, legal boolean, method string, runs_required int").withColumn("start_date", F.to_date(F.lit("2020-01-01")))
    got = [r.p_fail for r in chase.failure_curve(df).orderBy("bin").collect()]
    assert len(got) == len(chase.DEMAND_EDGES) - 1 and got == sorted(got)
    # 0.4 and 0.2 pool to 0.3, 0.9 and 0.5 to 0.7; bins without balls carry on the last value
    assert got[0] == got[5] == pytest.approx(0.1) and got[6] == got[10] == got[19] == pytest.approx(0.3) and got[20] == got[-1] == pytest.approx(0.7)


def test_every_line_is_accounted_for(ws, spark):
    from inswing.sources.fixture import reconciliation

    n = {r["what"]: r.n for r in reconciliation(ws).collect()}
    assert n["missing"] == 0 and n["lines"] == sum(v for k, v in n.items() if k not in ("lines", "missing"))
