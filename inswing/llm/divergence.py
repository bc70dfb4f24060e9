"""Source divergence audit: how far the words of one source lie from those of the others of its language.

Every language keeps the terms that stand in MIN_DOCUMENTS of its documents or more. A group, that is a source of a language or
the whole language, gives each kept term the smoothed share p = 1 + floor(SCALE * (count + 1) / (N + V)); two groups differ at a
term by f(p, q) = floor((p - q)^2 / q). All numbers are integers.

`audit` sums f over all kept terms for each ordered pair of sources without visiting the terms that neither source has. With
p0 the share of a term that a source lacks, the sum over all terms is

    V * f(p0, q0)  +  sum over terms of one source alone (f(p, q0) - f(p0, q0), and alike for the other)
                   +  sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

so only counts of terms are needed: how many have count m in a source, and how many have count m in one and n in another.
These come from a frequent-pattern tree. The row of a term is the list of its counts that are not zero, in the order of the
sources; equal rows are one with a multiplicity; rows that begin alike share the nodes of their beginning. Each node, a source
with a count, carries the number of terms below it and is combined once with each of its ancestors, the root included, however
many rows pass through it. Rows reach the tree sorted, so a node is finished when the next row leaves it: a task holds the
current branch, not the tree. Parts of the tree are built by range in separate tasks; their counts add up.

Defined results. Null text, language or source is ''. Rows that repeat, or share an id, are documents of their own; ids are not
read. A group without terms has its row with all others at p0; a language without kept terms (V = 0) has value 0 for each pair;
a language with one source has no pairs. Ties rank by the UTF-8 bytes of the item. A very long text is cut whole, in the
task that reads it. An empty table gives an empty result. Extra columns are not read.

The result holds all ordered pairs of sources of a language, so it grows with the square of their number, as does the work on a
term that all of them have; nothing else does.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.llm.common import stage, text_of

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
HELD = 200_000  # terms that a task adds up before it hands them on
COMBINATIONS = 1 << 20  # that a task adds up at once

#: Letters a to z and all bytes of characters beyond ASCII; A to Z become lower case; anything else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, added up in the task; a row without term for each group."""
    seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in seen.items():
            of = docs[lang, source]
            for some in (list(found)[i:i + HELD] for i in range(0, len(found), HELD)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array([found[t] for t in some]), pa.array([of[t] for t in some])], names=["lang", "source", "term", "n", "docs"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0]), pa.array([0])], names=["lang", "source", "term", "n", "docs"])
        seen.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = text.translate(_FOLD).split()
            seen[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, seen.values())) > HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), and one row without a term for each group."""
    named = docs.select(text_of(docs["lang"]).alias("lang"), text_of(docs["source"]).alias("source"), text_of(docs["text"]).cast("binary").alias("text"))
    return named.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and ancestor combinations of the rows, which come sorted by (lang, row): (lang, ancestor, node, terms)."""
    items: dict[tuple[str, int], int] = {}
    names: list[tuple[str | None, int]] = [(None, 0)]  # item 0 is the root
    keys: list[np.ndarray] = []
    terms: list[np.ndarray] = []
    held = 0
    lang: str | None = None
    branch: list[int] = [0]
    below: list[int] = [0]

    def close(depth: int) -> None:
        """Nodes of the branch beyond this depth are finished."""
        nonlocal held
        while len(branch) > depth + 1:
            node, n = branch.pop(), below.pop()
            keys.append(np.array(branch, dtype=np.int64) << 32 | node)
            terms.append(np.full(len(branch), n, dtype=np.int64))
            held += len(branch)
            below[-1] += n

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), dtype=np.int64)
            np.add.at(n, at, np.concatenate(terms))
            above, node = (key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(key)), "a": pa.array([names[i][0] for i in above], pa.string()), "a_n": pa.array([names[i][1] for i in above]),
                "s": pa.array([names[i][0] for i in node]), "s_n": pa.array([names[i][1] for i in node]), "terms": pa.array(n)})
        keys.clear()
        terms.clear()
        held = 0

    for batch in batches:
        entries = batch.column("row").flatten()
        sources, counts = entries.field("source").to_pylist(), entries.field("n").to_pylist()
        offsets = batch.column("row").offsets.to_pylist()
        base = offsets[0]
        for i, (of, m) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("m").to_pylist())):
            if of != lang:
                close(0)
                yield from out()
                lang = of
            lo, hi = offsets[i] - base, offsets[i + 1] - base
            row = []
            for x in zip(sources[lo:hi], counts[lo:hi]):
                if x not in items:
                    items[x] = len(names)
                    names.append(x)
                row.append(items[x])
            shared = 0
            while shared < len(row) and shared + 1 < len(branch) and branch[shared + 1] == row[shared]:
                shared += 1
            close(shared)
            for x in row[shared:]:
                branch.append(x)
                below.append(0)
            below[-1] += m
            if held > COMBINATIONS:
                yield from out()
    close(0)
    yield from out()


def _share(n: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / size); decimals, as the product leaves 64 bits beyond nine billion."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)"), size.cast("decimal(20,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance, and the terms a source has most in excess."""
    counts = stage(term_counts(docs), "divergence-counts")
    # a term has one entry for each source of its language
    rows = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    rows = stage(rows.where(F.col("docs") >= min_documents).drop("docs"), "divergence-rows")
    single = rows.select("lang", "term", F.col("n").alias("lang_n"), F.inline("row")).select("lang", "term", "lang_n", "source", "n")
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_size"))
    sizes = single.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = stage(groups.select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("size", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("d"),
        (F.coalesce("lang_size", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_d")), "divergence-groups")
    return _pairs(rows, groups).unionByName(_terms(single, groups, top))


def _terms(single: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    with_p = single.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("d")).alias("p"), _share(F.col("lang_n"), F.col("lang_d")).alias("q"))
    value = with_p.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = rows.groupBy("lang", "row").agg(F.count("*").alias("m"))
    # neighbours of the tree go to one task; the hash splits what begins alike
    ranged = folded.withColumn("head", F.slice("row", 1, 3)).withColumn("h", F.xxhash64("row"))
    ranged = ranged.repartitionByRange(parts, "lang", "head", "h").sortWithinPartitions("lang", "row").select("lang", "row", "m")
    tree = ranged.mapInArrow(_tree, "lang string, a string, a_n long, s string, s_n long, terms long")
    tree = stage(tree.groupBy("lang", "a", "a_n", "s", "s_n").agg(F.sum("terms").alias("terms")), "divergence-tree")

    some = groups.where("v > 0")
    own = some.select("lang", F.col("source").alias("s"), F.col("d").alias("s_d"))
    # below the root: how many terms a source has with each count
    alone = tree.where("a IS NULL").join(own, ["lang", "s"]).groupBy("lang", "s").agg(
        F.collect_list(F.struct(_share(F.col("s_n"), F.col("s_d")).alias("p"), "terms")).alias("alone"))
    side = some.select("lang", "source", "v", "d", _share(F.lit(0), F.col("d")).alias("p0")).join(
        alone.withColumnRenamed("s", "source"), ["lang", "source"], "left").select(
        "lang", "source", "v", "p0", F.coalesce("alone", F.array().cast("array<struct<p:bigint,terms:bigint>>")).alias("alone"))
    other = side.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("alone").alias("item_alone"))

    p0, q0 = F.col("p0"), F.col("q0")
    base = _f(p0, q0)
    zero = F.lit(0).cast("decimal(38,0)")
    ours = F.aggregate("alone", zero, lambda acc, x: (acc + _wide(x["terms"]) * _wide(_f(x["p"], q0) - base)).cast("decimal(38,0)"))
    theirs = F.aggregate("item_alone", zero, lambda acc, x: (acc + _wide(x["terms"]) * _wide(_f(p0, x["p"]) - base)).cast("decimal(38,0)"))
    apart = side.join(other, "lang").where("source <> item").select(
        "lang", "source", "item", (_wide(F.col("v")) * _wide(base) + ours + theirs).cast("decimal(38,0)").alias("value"))

    ends = own.select("lang", F.col("s").alias("a"), F.col("s_d").alias("a_d"))
    both = tree.where("a IS NOT NULL").join(own, ["lang", "s"]).join(ends, ["lang", "a"]).select(
        "lang", "a", "s", "terms", _share(F.col("a_n"), F.col("a_d")).alias("ap"), _share(F.lit(0), F.col("a_d")).alias("a0"),
        _share(F.col("s_n"), F.col("s_d")).alias("sp"), _share(F.lit(0), F.col("s_d")).alias("s0"))

    def turn(source: str, item: str, p: str, p0: str, q: str, q0: str) -> DataFrame:
        more = _f(F.col(p), F.col(q)) - _f(F.col(p), F.col(q0)) - _f(F.col(p0), F.col(q)) + _f(F.col(p0), F.col(q0))
        return both.select("lang", F.col(source).alias("source"), F.col(item).alias("item"), (_wide(F.col("terms")) * _wide(more)).alias("value"))

    together = turn("a", "s", "ap", "a0", "sp", "s0").unionByName(turn("s", "a", "sp", "s0", "ap", "a0")).groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    # a language without kept terms has pairs of value 0
    none = groups.where("v = 0").select("lang", "source")
    bare = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    full = apart.join(together, ["lang", "source", "item"], "left").select(
        "lang", "source", "item", (F.col("value") + F.coalesce("more", zero)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return full.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
