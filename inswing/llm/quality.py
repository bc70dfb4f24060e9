"""Quality rules with risk-controlled thresholds.

A document is scored by five rules; a higher score is worse, and a rule rejects what scores above its cutoff. For each
stratum (language) the cutoffs of all rules are chosen together on labelled documents, along one fixed path of cutoffs from
lenient to strict (PATH): a step is accepted while the exact binomial test rejects "more than risk of the good documents
score above one of its cutoffs" at level delta / strata. Bonferroni covers the strata; along a path the order is fixed and
the count of false rejections only grows, so testing stops at the first failure and needs no further correction. With
probability 1 - delta no stratum loses more than `risk` of its good documents, whichever of the accepted steps is used; of
those, the most lenient is taken that still catches `catch` of the bad documents that the strictest does. A stratum needs
log(strata / delta) / -log(1 - risk) good labels that pass the base rules before any test can succeed: 217 for four strata.

`certify` is the other split of the risk, rule by rule: each rule has its own cutoff, tested at risk / rules and delta / (rules *
strata). It needs five times the labels and more, and is for callers who ask for it.

Defined results. A null text has no words and fails the base rules; a null stratum is a stratum of its own. A stratum
without labels, or with too few to certify any cutoff, keeps all that passes the base rules. Labels without a document,
with a null id or a null quality are ignored; if a document is labelled several times, one good label makes it good.
Rows that share a doc_id are judged one by one; each counts as a labelled document. An empty table gives an empty
result. Columns of the input stay as they are; a column named like one of ours is replaced only in the narrow result.

Three-word windows are compared by a 64-bit hash. Up to LONG words its low bits give way to the position, above it stands
whole beside the position; two different windows of one document of up to 5 million words meet with a probability below 1e-6.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.llm.common import stage, text_of, words

RISK = 0.02
DELTA = 0.05
CATCH = 0.99
MIN_WORDS = 50
REPEAT_PERCENT = 50
LONG = 20_000  # words from which windows are compared by the whole hash

#: Rule -> cutoffs from lenient to strict. The grid is fixed before any label is seen.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "duplicate_line_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.36, 0.34, 0.30, 0.25, 0.20),
    "repeated_window_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15),
    "upper_case_share": (0.90, 0.70, 0.60, 0.50, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10),
    "repeated_word_share": (0.98, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50),
}
_GRID = list(CUTOFFS.values())
#: Order in which PATH tightens, (rule, place in its grid): all grids side by side, the share of repeated words after them, as it grows with length.
STEPS = sorted(((r, i) for r, grid in enumerate(_GRID) for i in range(1, len(grid))), key=lambda x: (_GRID[x[0]] is CUTOFFS["repeated_word_share"], x[1] / len(_GRID[x[0]]), x[0]))
#: Joint cutoffs from lenient to strict, one rule tightened at a time.
PATH = [[grid[max([i for q, i in STEPS[:n] if q == r], default=0)] for r, grid in enumerate(_GRID)] for n in range(len(STEPS) + 1)]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two structs for each document: `row`, the input, and `q`, the base counts, base_failed and the scores in the order of CUTOFFS."""
    long = lambda c: c.cast("long")
    has_word = lambda line: F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""
    # the input stands in one struct, so that no name of ours can meet one of its own
    a = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of(docs[text]).alias("_t"))
    b = a.withColumn("_w", words(F.col("_t"))).withColumn("_l", F.filter(F.split("_t", "\n"), has_word))
    w, n = F.col("_w"), F.size("_w")
    c = (
        b.withColumn("_n", n).withColumn("_c", F.length(F.array_join("_w", "")))
        # low bits of a window's key hold its place, so that sorting plain longs brings equal windows together
        .withColumn("_bits", F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int"))
        .withColumn("_low", F.expr("shiftleft(1L, _bits) - 1L"))
        .withColumn("_k", F.when((F.col("_n") >= 3) & (F.col("_n") <= LONG), F.sort_array(F.transform(
            F.sequence(F.lit(0), F.col("_n") - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")),
        ))).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_s", F.when(F.col("_n") > LONG, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.col("_n") - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("i")),
        ))).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>"))))
    k, low = F.col("_k"), F.bitwise_not(F.col("_low"))
    same = lambda x, other: F.coalesce(x.bitwiseAND(low) == other.bitwiseAND(low), F.lit(False))
    short = F.transform(F.filter(k, lambda x, i: same(x, F.get(k, i - 1)) | same(x, F.get(k, i + 1))), lambda x: x.bitwiseAND(F.col("_low")))
    z = F.col("_s")
    equal = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    long_ = F.transform(F.filter(z, lambda x, i: equal(x, F.get(z, i - 1)) | equal(x, F.get(z, i + 1))), lambda x: x["i"])
    d = c.withColumn("_p", F.sort_array(F.when(F.col("_n") > LONG, long_).otherwise(short)))
    p = F.col("_p")
    repeated = F.when(F.size(p) == 0, 0).otherwise(
        F.aggregate(p, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")),
                    lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(x - s["last"], F.lit(3))).alias("sum")),
                    lambda s: s["sum"]))
    e = d.withColumn("_b", F.struct(
        long(F.col("_n")).alias("n_words"), long(F.col("_c")).alias("word_chars"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"), long(repeated).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"), long(F.size(F.array_distinct("_w"))).alias("n_distinct"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).alias("n_upper")))
    share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(0.0)
    return e.select("row", F.struct(
        *[F.col(f"_b.{x}").alias(x) for x in BASE],
        ((F.col("_b.n_words") < MIN_WORDS) | (100 * F.col("_b.n_repeat_words") > REPEAT_PERCENT * F.col("_b.n_words"))).alias("base_failed"),
        F.array(
            share("_b.n_symbols", "_b.word_chars"), share("_b.n_dup_lines", "_b.n_lines"), share("_b.n_repeat_words", "_b.n_words"),
            share("_b.n_upper", "_b.word_chars"), 1 - F.when(F.col("_b.n_words") > 0, F.col("_b.n_distinct") / F.col("_b.n_words")).otherwise(1.0),
        ).alias("scores")).alias("q"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed from the largest term down, in logarithms where it may underflow.

    At k >= n p it is at least one half, which no level accepts; 1 stands for it, so that no long sum is formed."""
    zero, one = F.lit(0.0), F.lit(1.0)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    log_term = F.aggregate(steps, zero, lambda s, i: s + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))
    log_term = log_term + k * math.log(p) + (n - k) * math.log1p(-p)
    series = F.aggregate(
        steps, F.struct(one.alias("t"), one.alias("s")),
        lambda s, j: F.struct((s["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("t"),
                              (s["s"] + s["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("s")),
        lambda s: s["s"])
    return F.when(k >= n * p, one).otherwise(F.exp(log_term) * series)


def labelled(scored: DataFrame, labels: DataFrame, doc_id: str, stratum: str) -> DataFrame:
    """(stratum, good, x): the labelled documents that pass the base rules; x has a struct (rule, level) for each rule."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") == 1).alias("good")))
    # one row a rule, with the number of cutoffs that the score exceeds: the strictest ones, which stand last
    def level(rule: int, name: str) -> Column:
        score_ = F.get(F.col("q.scores"), F.lit(rule))
        return F.size(F.filter(F.array(*map(F.lit, CUTOFFS[name])), lambda cutoff: score_ > cutoff))

    levels = F.array(*[F.struct(F.lit(r).alias("rule"), level(r, name).alias("level")) for r, name in enumerate(CUTOFFS)])
    return (
        scored.where(~F.col("q.base_failed")).select(F.col(doc_id).alias("_id"), F.col(stratum).alias("stratum"), levels.alias("x"))
        .join(known, "_id").select("stratum", "good", "x"))


def certify(scored: DataFrame, labels: DataFrame, doc_id: str = "row.doc_id", stratum: str = "row.lang",
            risk: float = RISK, delta: float = DELTA, catch: float = CATCH) -> DataFrame:
    """Cutoffs by stratum: (stratum, cutoffs array in the order of CUTOFFS, null where none is certified)."""
    rules = list(CUTOFFS)
    held = (
        labelled(scored, labels, doc_id, stratum).select("stratum", "good", F.explode("x").alias("x")).select("stratum", "good", "x.rule", "x.level")
        .groupBy("stratum", "rule", "level").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad")))
    held = stage(held, "quality-holdout")  # a row for each stratum, rule and level
    tests = max(1, held.where("n > 0").select("stratum").distinct().count() * len(rules))
    above = lambda field: F.aggregate(
        "by", F.lit(0).cast("long"), lambda s, x: s + F.when(x["level"] + F.col("at") >= F.col("cutoffs"), x[field]).otherwise(0))
    grid = F.array(*[F.array(*map(F.lit, CUTOFFS[name])) for name in rules])
    bounds = (
        held.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", F.col("n").alias("m"), "bad")).alias("by"))
        .withColumn("grid", F.element_at(grid, F.col("rule") + 1))
        .select("stratum", "rule", "n", "by", F.size("grid").alias("cutoffs"), F.posexplode("grid").alias("at", "cutoff"))
        .withColumns({"k": above("m"), "caught": above("bad")})
        .withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk / len(rules))))
    sure = bounds.where((F.col("n") > 0) & (F.col("tail") <= delta / tests))
    most = F.max("caught").over(Window.partitionBy("stratum", "rule"))  # a grid has a fixed number of cutoffs
    chosen = sure.withColumn("most", most).where(F.col("caught") >= catch * F.col("most")).groupBy("stratum", "rule").agg(F.max("cutoff").alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.array(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))) for r in range(len(rules))]).alias("cutoffs"))


def certify_jointly(scored: DataFrame, labels: DataFrame, doc_id: str = "row.doc_id", stratum: str = "row.lang",
                    risk: float = RISK, delta: float = DELTA, catch: float = CATCH) -> DataFrame:
    """Cutoffs by stratum, all on one step of PATH: (stratum, cutoffs array in the order of CUTOFFS); no row where no step is certified."""
    # the first step of PATH that rejects a document; a level of n exceeds the n last places of the rule's grid
    first = [[len(PATH)] + [min(t for t, c in enumerate(PATH) if c[r] <= grid[-n]) for n in range(1, len(grid) + 1)] for r, grid in enumerate(_GRID)]
    step = F.array_min(F.array(*[F.get(F.array(*map(F.lit, f)), F.get("x", F.lit(r))["level"]) for r, f in enumerate(first)]))
    held = (
        labelled(scored, labels, doc_id, stratum).select("stratum", "good", step.alias("step"))
        .groupBy("stratum", "step").agg(F.count_if("good").alias("m"), F.count_if(~F.col("good")).alias("bad")))
    held = stage(held, "quality-joint")  # a row for each stratum and step
    strata = max(1, held.where("m > 0").select("stratum").distinct().count())
    rejected = lambda field: F.aggregate(
        "by", F.lit(0).cast("long"), lambda s, x: s + F.when(x["step"] <= F.col("at"), x[field]).otherwise(0))
    tested = (
        held.groupBy("stratum").agg(F.sum("m").alias("n"), F.collect_list(F.struct("step", "m", "bad")).alias("by"))
        .where("n > 0").select("stratum", "n", "by", F.posexplode(F.array(*[F.array(*map(F.lit, c)) for c in PATH])).alias("at", "cutoffs"))
        .withColumns({"k": rejected("m"), "caught": rejected("bad")}))
    # the count of false rejections only grows along the path, so these are the steps before the first failure
    sure = tested.where(binomial_tail(F.col("k"), F.col("n"), risk) <= delta / strata)
    most = F.max("caught").over(Window.partitionBy("stratum"))  # a path has a fixed number of steps
    chosen = sure.withColumn("most", most).where(F.col("caught") >= catch * F.col("most"))
    return chosen.groupBy("stratum").agg(F.min_by("cutoffs", "at").alias("cutoffs"))


def judge(scored: DataFrame, cutoffs: DataFrame, stratum: str = "row.lang") -> DataFrame:
    """`scored` with the boolean `kept`."""
    c = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    above = F.exists(F.arrays_zip(F.col("q.scores").alias("s"), F.col("_cutoffs").alias("c")), lambda x: F.coalesce(x["s"] > x["c"], F.lit(False)))
    return (
        scored.join(c, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("kept", ~F.col("q.base_failed") & ~F.coalesce(above, F.lit(False))).drop("_stratum", "_cutoffs"))


def verdicts(docs: DataFrame, labels: DataFrame, cutoffs: Callable[[DataFrame, DataFrame], DataFrame] = certify_jointly) -> DataFrame:
    """A narrow row for each document: base counts, base_failed and kept."""
    scored = stage(score(docs).select(F.struct("row.doc_id", "row.lang").alias("row"), "q"), "quality-scores")
    out = judge(scored, stage(cutoffs(scored, labels), "quality-cutoffs"))
    return out.select("row.doc_id", *[F.col(f"q.{x}").alias(x) for x in BASE], F.col("q.base_failed").alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    scored = stage(score(docs), "quality-documents")
    return judge(scored, stage(certify_jointly(scored, labels), "quality-cutoffs")).where("kept").select("row.*")
