"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a small Jaccard similarity, so plain MinHash would miss it. Here items are
partitioned by size, and each partition gets the sketch length that its largest item needs: of an item with q shingles
the m = q - ceil(threshold * q) + 1 smallest hashes (its bottom-m MinHash). A document that contains the item at the
threshold lacks fewer than m of its shingles, so at least one of the m is among the document's hashes: no containment is
missed, whatever the document's size. On the other side a document shows only the hashes that do not exceed the largest
one any sketch holds, and it meets a partition only if it has enough shingles to contain the partition's smallest item.

Candidates (document, item) are then verified on the shingles themselves, as words, not as hashes.

Shingles are five consecutive lower-cased words. An item of fewer words has one shingle, all its words, and a document
contains it where these stand in a row; documents show shingles of the lengths that items have, so they show short ones
only where short items are. The sketches grow with the benchmark only; they are written first, so that Spark broadcasts
them where their size allows it and shuffles document hashes on their values where it does not.

Documents are searched by the digest of their text, so copies are searched once, and a document needs no id to be found.

Defined results. A null or empty text neither finds nor is found. An item of one word is in every document that has the
word. Repeated items are items of their own; rows that share an item_id are one item with the shingles of all; items with
a null id are ignored. `containment` has one row for a doc_id (null too, as one id) and an item, the largest of its rows;
`remove` judges each row by its own text, whatever its id. Very long texts are shingled whole. A containment of exactly
the threshold counts. An empty table on either side gives no rows. Extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inswing.llm.common import stage, text_of, words

GRAM = 5
THRESHOLD = 0.8


def _words(text: Column) -> Column:
    return words(F.lower(text_of(text)))


def _key(text: Column) -> Column:
    return F.sha2(text_of(text), 256)


def _grams(w: Column, n: Column, k: int, make) -> Column:
    """make(words of a shingle of k words) for each of its places."""
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: make(*[F.get(w, i + j) for j in range(k)])))


def _item_grams(w: Column, n: Column, make) -> Column:
    """The shingles of an item: of GRAM words, or the one of all its words."""
    whole = F.lit(None)
    for k in range(1, GRAM):
        whole = F.when(n == k, F.array(make(*[F.get(w, F.lit(j)) for j in range(k)]))).otherwise(whole)
    return F.coalesce(_grams(w, n, GRAM, make), whole)


def _upto(hashes: Column, top: int) -> Column:
    return F.filter(hashes, lambda h: h <= top)


def _joined(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(part, q_min, item_id, h, k): for each size partition of items the bottom-m hashes of each item, of k words."""
    read = items.where(items["item_id"].isNotNull()).select(items["item_id"].alias("item_id"), _words(items["text"]).alias("w")).withColumn("n", F.size("w"))
    k = F.least(F.col("n"), F.lit(GRAM))
    grams = read.select("item_id", k.alias("k"), F.explode_outer(_item_grams(F.col("w"), F.col("n"), F.xxhash64)).alias("h")).where("h IS NOT NULL").distinct()
    # an item's shingles are as many as its words; their order is a bounded sort for each item
    lists = grams.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("h", "k"))).alias("hs")).withColumn("q", F.size("hs"))
    parts = lists.withColumn("part", F.floor(F.log2(F.col("q").cast("double"))).cast("int"))
    m = (F.col("q") - F.ceil(F.col("q") * threshold - 1e-9) + 1).cast("int")
    edge = parts.groupBy("part").agg(F.max(m).alias("m"), F.min("q").alias("q_min"))
    taken = parts.join(edge, "part").select("part", "q_min", "item_id", F.explode(F.slice("hs", F.lit(1), F.least("m", "q"))).alias("g"))
    return taken.select("part", "q_min", "item_id", "g.h", "g.k")


def lengths(items: DataFrame) -> list[int]:
    """The numbers of words that shingles of items have: GRAM, and those of short items."""
    read = items.where(items["item_id"].isNotNull()).select(F.least(F.size(_words(items["text"])), F.lit(GRAM)).alias("k"))
    return sorted(r["k"] for r in read.where("k > 0").distinct().collect())  # GRAM numbers at most


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_id), key the digest of a text, that share a sketch hash and pass the size filter."""
    sketch = stage(sketches(items, threshold), "leak-sketches")
    top = {r["k"]: r["top"] for r in sketch.groupBy("k").agg(F.max("h").alias("top")).collect()}  # GRAM numbers at most
    read = docs.select(_key(docs["text"]).alias("key"), _words(docs["text"]).alias("w")).withColumn("n", F.size("w"))
    w, n = F.col("w"), F.col("n")
    none = F.array().cast("array<bigint>")
    shown = [none, *[F.coalesce(_upto(_grams(w, n, k, F.xxhash64), top[k]), none) for k in sorted(top)]]
    # what a document shows at most: a size filter that loses nothing
    most = sum((F.greatest(n - (k - 1), F.lit(0)) for k in lengths(items)), F.lit(0))
    # the outer form keeps the optimiser from adding a filter that cuts the text into words once more
    hashes = read.select("key", most.alias("most"), F.explode_outer(F.concat(*shown)).alias("h")).where("h IS NOT NULL")
    hit = hashes.join(sketch, "h").where(F.col("most") >= F.ceil(F.col("q_min") * threshold - 1e-9))
    return hit.select("key", "item_id").distinct()


def verified(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key) that have a candidate, and (key, item_id, item_shingles, shared) at the threshold or above."""
    found = stage(candidates(docs, items, threshold), "leak-candidates")
    read = items.select(items["item_id"].alias("item_id"), _words(items["text"]).alias("w")).withColumn("n", F.size("w"))
    item_grams = read.select("item_id", F.explode_outer(_item_grams(F.col("w"), F.col("n"), _joined)).alias("g")).where("g IS NOT NULL").groupBy("item_id").agg(
        F.collect_set("g").alias("item_grams"))
    item_grams = stage(item_grams, "leak-items")
    keys = found.select("key").distinct()
    held = docs.select(docs["doc_id"].alias("doc_id"), _key(docs["text"]).alias("key"), text_of(docs["text"]).alias("text")).join(keys, "key", "left_semi")
    held = stage(held, "leak-documents")
    text = held.select("key", "text").dropDuplicates(["key"]).select("key", _words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    none = F.array().cast("array<string>")
    grams = text.select("key", F.array_distinct(F.concat(none, *[F.coalesce(_grams(F.col("w"), F.col("n"), k, _joined), none) for k in lengths(items)])).alias("grams"))
    pairs = grams.join(found, "key").join(item_grams, "item_id")
    shared = pairs.select("key", "item_id", F.size("item_grams").cast("long").alias("item_shingles"),
                          F.size(F.array_intersect("item_grams", "grams")).cast("long").alias("shared"))
    return held.select("doc_id", "key"), shared.where(F.col("shared") >= F.col("item_shingles") * threshold - 1e-9)


def containment(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of all pairs at the threshold or above."""
    held, shared = verified(docs, items, threshold)
    best = held.join(shared, "key").groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared").alias("shared"))
    return best.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with their columns."""
    _, shared = verified(docs, items)
    bad = stage(shared.select(F.col("key").alias("leaked")).distinct(), "leak-found")
    return docs.join(bad, _key(docs["text"]) == bad["leaked"], "left_anti")
