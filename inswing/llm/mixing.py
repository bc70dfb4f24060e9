"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; its documents are to be copied target / size times on average, at most twice. The
whole part of that rate is taken from every document; the fractional part is a copy probability. Probabilities are
rounded to 0 or 1 by pairing: two documents exchange mass, words for words, in a direction drawn so that every
document's expectation is kept, until one of them is integral; the other goes on to the next pair. What is left of a
group, one fractional document, meets the residuals of other groups one level up; the tree ends with one document for
each source, which is rounded by a draw. The words that a source gives thus miss its target by less than one document.

Each row is rounded by itself. Rows alike in source, id and text are interchangeable: of c such rows floor(c * p) get the
extra copy, and one document with the probability that is left stands for them in the tree. Which of the c rows they are
is settled by their number within each part of the input, so no task orders all copies of a text.

Groups are dealt by a hash of source, id and text, their number following the count of documents, so no task holds a whole source and
a hot source or id is many groups. Draws are hashes of the same, the seed and the level: reruns agree, whatever the partitions.
Only (source, id, text hash, size, probability) is shuffled.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1, repeating. Together they share `total`
times all words; a source stops at `most` times its own words and what it leaves goes to the others by weight. That is
min(cap, level * weight) for the one level that uses up the total, found by a running sum over the sources, not by rounds.

Defined results. A null or empty text has no words: size 0, taken 0, no copies. Rows that share an id but not the text are
documents of their own, with a null id too; of rows alike in source, id and text those with an extra copy may change between reruns
where other columns differ, their number does not. A null source is a source. Ties in size are ordered by hash. Very long texts count
whole; a source misses its target by less than its largest document. An empty table gives an empty result. Extra columns stay.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.llm.common import empty, stage, text_of, words

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST = 2.0
SEED = 20240101
LEAF = 1024  # documents that one group rounds
FAN = 512  # residuals that one group of a higher level rounds
UNIT = ("source", "doc_id", "key")  # key: a hash of the text; rows alike in all three are interchangeable


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.size(words(text_of(docs[text]))).cast("long")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, documents, target, rate) from (source, source_size, documents): a row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    a = by_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    # by the level at which a source is full; those before are full, the rest share what is left by weight
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = a.withColumn("all", F.sum("source_size").over(everything) * total).withColumn(
        "level", (F.col("all") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that its share does not fill fixes the level for all from there on
    c = b.withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    d = c.withColumn("level", F.max(F.when(F.col("free"), F.struct(-F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return d.withColumn("target", target).select(
        "source", "source_size", "documents", "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"))


def _draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the named columns alone."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(2**53 - 1) / float(2**53)


def pair_up(p: list[float], size: list[float], draw: list[float]) -> int:
    """Round p in place, pair by pair; the place of the one that stays fractional, or -1."""
    a = -1
    for b in range(len(p)):
        if not 0.0 < p[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        gain_a, gain_b = (1 - p[a]) * size[a], (1 - p[b]) * size[b]  # words each lacks to a whole copy
        mass_a, mass_b = p[a] * size[a], p[b] * size[b]  # words each has to give
        up, down = min(gain_a, mass_b), min(gain_b, mass_a)
        if draw[b] * (up + down) < down:  # words go from b to a
            p[a], p[b] = (1.0, p[b] - up / size[b]) if gain_a <= mass_b else (p[a] + up / size[a], 0.0)
        else:
            p[a], p[b] = (0.0, p[b] + down / size[b]) if mass_a <= gain_b else (p[a] - down / size[a], 1.0)
        for k in (a, b):  # both may have become whole, but for the last bits
            if abs(p[k] - round(p[k])) < 1e-12:
                p[k] = float(round(p[k]))
        a = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else -1
    return a


def _round_group(group: pa.Table) -> pa.Table:
    # large documents first, so that the one left over tends to be small
    group = group.sort_by([("size", "descending"), ("place", "ascending")])
    p, draw = group["p"].to_pylist(), group["draw"].to_pylist()
    left = pair_up(p, group["size"].to_pylist(), draw)
    if left >= 0 and group["groups"][0].as_py() == 1:  # the root of the source's tree
        p[left] = float(group["last"][left].as_py() < p[left])
    return group.select([*UNIT, "size", "groups"]).append_column("p", pa.array(p, pa.float64()))


def round_copies(units: DataFrame, seed: int = SEED, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(source, doc_id, key, extra), extra 0 or 1, from units (source, doc_id, key, size, p, documents) with 0 < p < 1 and size > 0."""
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = f"source {kinds['source']}, doc_id {kinds['doc_id']}, key long, size double, groups long, p double"
    level, done = 0, None
    todo = units.select(*UNIT, F.col("size").cast("double").alias("size"), "p", F.ceil(F.col("documents") / leaf).cast("long").alias("groups"))
    while True:
        dealt = todo.withColumns({
            "group": F.pmod(F.xxhash64(F.lit(seed + level), F.lit("group"), *UNIT), F.col("groups")),
            "place": F.xxhash64(F.lit(seed + level), F.lit("place"), *UNIT),
            "draw": _draw(seed + level, "doc_id", "source", "key"), "last": _draw(~(seed + level), "doc_id", "source", "key")})
        out = stage(dealt.groupBy("source", "group").applyInArrow(_round_group, schema), f"mixing-level-{level}")
        whole = out.where(F.col("p").isin(0.0, 1.0)).select(*UNIT, F.col("p").cast("int").alias("extra"))
        done = whole if done is None else done.unionByName(whole)
        todo = out.where(~F.col("p").isin(0.0, 1.0)).select(*UNIT, "size", "p", F.ceil(F.col("groups") / fan).cast("long").alias("groups"))
        if empty(todo):
            return done
        level += 1


def _alike(left: dict[str, str]) -> Column:
    """Equality of a unit's columns with their renamed ones, null equal to null."""
    (a, b), *more = left.items()
    same = F.col(a).eqNullSafe(F.col(b))
    for a, b in more:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def _renamed(units: DataFrame) -> tuple[DataFrame, Column]:
    names = {c: f"u_{c}" for c in UNIT}
    return units.withColumnsRenamed(names), _alike(names)


def plan(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, key, source_size, target, alike, whole, extras) from rows (row, source, doc_id, key, size): of `alike` rows
    each is taken `whole` times and `extras` of them once more."""
    units = rows.groupBy(*UNIT).agg(F.max("size").alias("size"), F.count("*").alias("alike"))
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum("alike").alias("documents"))
    goal = stage(targets(stage(by_source, "mixing-sources")), "mixing-targets").withColumnRenamed("source", "of")
    share = F.when(F.col("size") > 0, F.col("alike") * (F.col("rate") - F.col("whole"))).otherwise(0.0)
    planned = units.join(goal, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("int")).withColumn("share", share).withColumn("sure", F.floor("share"))
    planned = stage(planned.select(*UNIT, "size", "alike", "source_size", "documents", "target", "whole", "sure", (F.col("share") - F.col("sure")).alias("p")), "mixing-plan")
    drawn, same = _renamed(round_copies(planned.where("p > 0"), seed))
    return planned.join(drawn, same, "left").select(
        *UNIT, "source_size", "target", "alike", "whole", (F.col("sure") + F.coalesce(F.col("extra"), F.lit(0))).alias("extras"))


def _picked(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows (picked) with an extra copy where only some of the rows of a unit have one."""
    some, same = _renamed(planned.where("extras > 0 AND extras < alike").select(*UNIT, "extras"))
    part = F.shiftright("row", 33)  # the part of the input that numbered the row
    held = rows.join(some, same).select("row", part.alias("part"), *UNIT, "extras")
    # parts apart, so that the rows of one unit are never one task
    held = stage(held, "mixing-alike").repartition(*UNIT, "part")
    before = Window.partitionBy(*UNIT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts, at = _renamed(held.groupBy(*UNIT, "part").count().select(*UNIT, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")))
    numbered = held.withColumn("place", F.row_number().over(Window.partitionBy(*UNIT, "part").orderBy("row")))
    counts = counts.withColumnRenamed("part", "u_part")
    return numbered.join(counts, at & (F.col("part") == F.col("u_part"))).where(F.col("place") + F.col("before") <= F.col("extras")).select(F.col("row").alias("picked"))


def mix(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (row, doc_id, size, source_size, target, copies) from written rows (row, source, doc_id, key, size)."""
    planned = stage(plan(rows, seed), "mixing-copies")
    picked = stage(_picked(rows, planned), "mixing-picked")
    p, same = _renamed(planned)
    extra = F.when(F.col("extras") >= F.col("alike"), 1).when(F.col("picked").isNotNull(), 1).otherwise(0)
    joined = rows.join(p.hint("merge"), same).join(picked, F.col("row") == F.col("picked"), "left")
    return joined.select("row", "doc_id", "size", "source_size", "target", (F.col("whole") + extra).cast("int").alias("copies"))


def _facts(docs: DataFrame, text: str, row: Column) -> DataFrame:
    key = F.xxhash64(text_of(docs[text]), F.octet_length(text_of(docs[text])))
    return docs.select(row.alias("row"), docs["source"].alias("source"), docs["doc_id"].alias("doc_id"), key.alias("key"), sizes(docs, text).alias("size"))


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: size, source_size, target of its source, copies, and the words taken."""
    rows = stage(_facts(docs, "text", F.monotonically_increasing_id()), "mixing-rows")
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def materialise(docs: DataFrame) -> DataFrame:
    """The mix: each document as often as the plan says, with its columns."""
    # rows are numbered once, in a table, so that every later step means the same row
    held = stage(docs.select(F.monotonically_increasing_id().alias("row_number"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), "mixing-held")
    facts = held.select("row_number", "row.source", "row.doc_id", "row.text")
    rows = stage(_facts(facts, "text", F.col("row_number")), "mixing-rows")
    copies = mix(rows).where("copies > 0").select(F.col("row").alias("place"), "copies")
    # a row a document: never a side to broadcast, so the plan is the same at every size
    joined = held.join(stage(copies, "mixing-taken").hint("merge"), F.col("row_number") == F.col("place"))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
