"""Difficulty of a chase: remaining-run resources, demand, probability of failing, and match eligibility."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.plans.workspace import Workspace

SCOPE = ["format_group", "gender"]
GRID = [1.06 ** k for k in range(110)]  # fixed values: candidate decay constants, in overs
MIN_CELL = 25
CUTOFF = "2025-01-01"
# fixed values: edges of the demand bins, twenty to a unit up to 3, then wider; the last is open
DEMAND_EDGES = [round(0.05 * i, 2) for i in range(61)] + [3.5, 4.5, 6.0, 1e9]


def cells(ws: Workspace, before: str = CUTOFF) -> DataFrame:
    """Mean runs still to come by overs left and wickets down, in full-length first innings before the cut-off."""
    total = ws["innings"].filter("innings_no = 1 and not super_over").select("match_id", "total_runs")
    b = ws["balls"].filter("innings_no = 1 and legal and method is null and innings_balls_limit = if(format_group = 'T20', 120, 300) and format_group in ('T20', 'ODI')").filter(
        F.col("start_date") < F.lit(before).cast("date")).join(total, "match_id")
    overs = F.ceil((F.col("innings_balls_limit") - F.col("legal_balls_before")) / 6.0).cast("int")
    return b.groupBy(*SCOPE, overs.alias("overs_left"), F.col("wickets_before").alias("wickets")).agg(
        F.avg(F.col("total_runs") - F.col("score_before")).alias("r"), F.count("*").alias("n"))


def fit(rows: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """z0 * (1 - exp(-overs / c)) per wicket: least squares in closed form for every c of a fixed grid, smallest error wins."""
    pts = rows.filter((F.col("n") >= min_cell) & (F.col("wickets") < 10) & (F.col("overs_left") >= 1))
    keys = [*SCOPE, "wickets"]
    enough = pts.groupBy(*keys).agg(F.count("*").alias("cells")).filter("cells >= 3")
    g = pts.join(enough, keys).withColumn("c", F.explode(F.array(*[F.lit(x) for x in GRID]))).withColumn("g", 1 - F.exp(-F.col("overs_left") / F.col("c")))
    n, r, x = F.col("n"), F.col("r"), F.col("g")
    s = g.groupBy(*keys, "cells", "c").agg(F.sum(n * x * x).alias("gg"), F.sum(n * r * x).alias("rg"), F.sum(n * r * r).alias("rr"))
    s = s.withColumns({"z0": F.col("rg") / F.col("gg"), "sse": F.col("rr") - F.col("rg") * F.col("rg") / F.col("gg")})
    return s.groupBy(*keys, "cells").agg(F.min(F.struct("sse", "c", "z0")).alias("b")).select(*keys, "cells", "b.z0", "b.c")


def table(params: DataFrame) -> DataFrame:
    """Resource table by overs left and wickets: a wicket too rare to fit takes 0.6 of the one before, and more wickets never mean more runs."""
    per = params.groupBy(*SCOPE).agg(F.map_from_entries(F.collect_list(F.struct("wickets", F.struct("z0", "c")))).alias("p"))  # at most ten entries
    overs = F.when(F.col("format_group") == "T20", 20).otherwise(50)
    rows = per.select(*SCOPE, "p", F.explode(F.sequence(F.lit(0), overs)).alias("overs_left"))

    def nxt(acc, w):
        fitted = F.col("p")[w]["z0"] * (1 - F.exp(-F.col("overs_left") / F.col("p")[w]["c"]))
        last = F.element_at(acc, -1)
        v = F.when(F.col("overs_left") == 0, 0.0).otherwise(F.coalesce(fitted, last * 0.6, F.lit(0.0)))
        return F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(F.least(v, F.coalesce(last, v)))))
    return rows.select(*SCOPE, "overs_left", F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.expr("cast(array() as array<double>)"), nxt)).alias("wickets", "runs"))


def demand(ws: Workspace, resources: DataFrame) -> DataFrame:
    """Runs required over the runs the remaining resources would bring, for every ball of a chase."""
    b = ws["balls"].filter("chasing and innings_no = 2 and balls_left > 0").withColumns({"lo": F.expr("balls_left div 6"), "part": F.col("balls_left") % 6})
    b = b.withColumn("hi", F.least(F.col("lo") + 1, F.expr("innings_balls_limit div 6")))
    a = resources.select(*SCOPE, F.col("wickets").alias("wickets_before"), F.col("overs_left").alias("lo"), F.col("runs").alias("e_lo"))
    z = resources.select(*SCOPE, F.col("wickets").alias("wickets_before"), F.col("overs_left").alias("hi"), F.col("runs").alias("e_hi"))
    j = b.join(a, [*SCOPE, "wickets_before", "lo"]).join(z, [*SCOPE, "wickets_before", "hi"])
    e = F.col("e_lo") + (F.col("e_hi") - F.col("e_lo")) * F.col("part") / 6.0
    need = F.col("runs_required")
    return j.withColumn("expected", e).withColumn("demand", F.when(need <= 0, 0.0).when(F.col("expected") > 0.5, need / F.col("expected")).otherwise(99.0)).select(
        "delivery_id", "match_id", "seq", *SCOPE, "start_date", "legal", "method", "runs_required", "expected", "demand", (F.col("winner") != F.col("batting_team")).alias("failed"))


def demand_bin() -> Column:
    return F.least(F.size(F.filter(F.array(*map(F.lit, DEMAND_EDGES)), lambda e: e <= F.col("demand"))) - 1, F.lit(len(DEMAND_EDGES) - 2))


def failure_curve(rows: DataFrame, before: str = CUTOFF) -> DataFrame:
    """P(the chase fails) by bin of demand for every format and gender, made monotone; empty bins carry on the last value.

    Trained on legal balls of decided chases without a method, before the cut-off. The monotone fit is the max-min formula over
    at most 64 bins of a cohort: the largest over starts at or below a bin of the smallest mean over ends at or above it."""
    train = rows.filter("legal and method is null and failed is not null and runs_required > 0").filter(F.col("start_date") < F.lit(before).cast("date"))
    d = train.groupBy(*SCOPE, demand_bin().alias("bin")).agg(F.sum(F.col("failed").cast("long")).alias("f"), F.count("*").alias("n"))
    upto = Window.partitionBy(*SCOPE).orderBy("bin")
    d = d.withColumns({"sf": F.sum("f").over(upto), "sn": F.sum("n").over(upto)})
    first = d.select(*SCOPE, F.col("bin").alias("a"), (F.col("sf") - F.col("f")).alias("f0"), (F.col("sn") - F.col("n")).alias("n0"))
    last = d.select(*SCOPE, F.col("bin").alias("b"), "sf", "sn")
    span = first.join(last, SCOPE).filter("a <= b").withColumn("mean", (F.col("sf") - F.col("f0")) / (F.col("sn") - F.col("n0")))
    low = span.withColumn("low", F.min("mean").over(Window.partitionBy(*SCOPE, "a").orderBy(F.desc("b"))))
    fitted = low.groupBy(*SCOPE, F.col("b").alias("bin")).agg(F.max("low").alias("p"))
    bins = d.select(*SCOPE).distinct().select(*SCOPE, F.explode(F.sequence(F.lit(0), F.lit(len(DEMAND_EDGES) - 2))).alias("bin"))
    all_ = bins.join(fitted, [*SCOPE, "bin"], "left").join(d.select(*SCOPE, "bin", "n", (F.col("f") / F.col("n")).alias("rate")), [*SCOPE, "bin"], "left")
    p = F.coalesce(F.last("p", ignorenulls=True).over(upto), F.min("p").over(Window.partitionBy(*SCOPE)))
    return all_.select(*SCOPE, "bin", F.coalesce("n", F.lit(0)).alias("n"), "rate", p.alias("p_fail"))


def swings(rows: DataFrame, curve: DataFrame, k: int = 5) -> DataFrame:
    """Difficulty 0-100 of every chase ball and the largest changes from one ball to the next."""
    s = rows.withColumn("bin", demand_bin()).join(curve.select(*SCOPE, "bin", "p_fail"), [*SCOPE, "bin"], "left")
    w = Window.partitionBy("match_id").orderBy("seq")
    s = s.withColumn("sdx", 100 * F.col("p_fail")).withColumn("change", F.round(F.lead("sdx").over(w) - F.col("sdx"), 9))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc_nulls_last(F.abs("change")), "seq"))).filter(F.col("rank") <= k)


def eligibility(ws: Workspace) -> DataFrame:
    """Why a match can or cannot train a win-probability model; the first rule that applies decides."""
    def at(no: int, col: str):
        return F.max(F.when(F.col("innings_no") == no, F.col(col)))
    i = ws["innings"].filter("not super_over").groupBy("match_id").agg(*[at(n, c).alias(f"{a}{n}") for n in (1, 2) for c, a in (
        ("batting_team", "bt"), ("total_runs", "t"), ("total_wickets", "w"), ("legal_balls", "lb"), ("target_runs", "tg"))])
    lim = ws["balls"].groupBy("match_id").agg(F.min("innings_balls_limit").alias("lmin"), F.max("innings_balls_limit").alias("lmax"), F.bool_or(F.coalesce("limit_uncertain", F.lit(False))).alias("unc"))
    m = ws["matches"].filter("format_group in ('T20', 'ODI')").join(i, "match_id", "left").join(lim, "match_id", "left").withColumn("full", F.when(F.col("format_group") == "T20", 120).otherwise(300))
    e = F.expr
    rules = [("no_result", "result = 'no result'"), ("method_dl", "method = 'D/L'"), ("method_other", "method is not null"), ("no_first_innings", "bt1 is null"), ("no_second_innings", "bt2 is null"),
             ("limit_uncertain", "unc"), ("nonstandard_or_unequal_limit", "lmin <> full or lmax <> full"), ("more_legal_balls_than_limit", "lb1 > full or lb2 > full"),
             ("target_mismatch", "tg2 is null or tg2 <> t1 + 1"), ("incomplete_first_innings", "not (lb1 = full or w1 >= 10)"), ("no_winner_recorded", "result is null and winner is null"),
             ("inconsistent_second_innings", "result is null and ((winner = bt2 and t2 < tg2) or (winner = bt1 and (t2 >= tg2 or not (lb2 = full or w2 >= 10))))")]
    status = F.when(e(rules[0][1]), rules[0][0])
    for name, test in rules[1:]:
        status = status.when(e(test), name)
    return m.withColumns({"status": status.otherwise("eligible"), "label": F.when(F.col("result") == "tie", 0.5).when(F.col("winner") == F.col("bt1"), 1.0).otherwise(0.0)})
