"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

1. A text becomes its set of n-grams (five lower-cased words, as 64-bit hashes). Texts with equal sets are copies of one class; the
   smallest id stands for it, and only classes go on.
2. Each class gets bands * rows MinHash values. Their numbers follow from the target recall: with r rows, a pair at the
   threshold t agrees in a band with probability t**r, so ln(1 - recall) / ln(1 - t**r) bands are needed; r is the
   largest for which the values stay within a limit.
3. Bands are shuffled on their hash. Every band with company points to its smallest member; the components of these
   edges are sets outside which no two classes share a band. A set of one block is checked whole. In a larger one each
   band is taken for itself, so that sets that hang together by chance cost no more than the bands they share; a pair
   counts in the first band that it shares.
4. What is taken together is cut into blocks by a hash, blocks meet in pairs, and each meeting is one task's group, bounded
   in members and in words. It checks every pair that shares a band on full n-gram sets. What leaves it is, for each
   member, the number of documents it links to, and one edge to the smallest member it hangs together with: a row a member, never a row a pair.
5. Links are summed, and the components of the edges are the classes of similar documents.

A large group of near copies is thus spread over many tasks; the pairs to be checked in it are as many as its links.

Defined results. A null or empty text has the empty set, and is a copy of every other empty text; texts of fewer words
than n have one n-gram of all their words. The similarity of equal sets is 1. Every row is a document; rows that repeat
are copies. Rows that share an id but not the set are one node: what one is linked to, the other is. Rows with a null id
are copies of their class, whose representative is an id; a class without any id takes no part in the search and has a null
class_id. An empty table gives an empty result; extra columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from inswing.llm.common import stage, text_of, words
from inswing.llm.graph import components

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
VALUES = 80  # MinHash values of a text at most
SEED = 7
BLOCK = 512  # members of a block, about
BLOCK_WORDS = 400_000  # words of a block, about
SLICE = 256  # documents whose n-grams a worker makes together


def banding(threshold: float = THRESHOLD, recall: float = RECALL, values: int = VALUES) -> tuple[int, int]:
    """(bands, rows): as many rows as the limit on values allows, and the bands that give the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, values + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold**rows))
        if bands * rows > values and rows > 1:
            break
        best = (bands, rows)
    return best


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_sets(flat: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document, from the word hashes of all."""
    x = flat.view(np.uint64) if flat.dtype == np.int64 else flat.astype(np.uint64)
    n = len(x) - gram + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(gram):
        if n > 0:
            rolled = _mix(rolled + x[i:i + n])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= gram:
            out.append(np.unique(rolled[a:b - gram + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = _mix(h + x[i:i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few documents at a time: what a worker holds beside its batch is the n-grams of these, not of the whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _signer(bands: int, rows: int, gram: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        salt = rng.integers(0, 2**64, k, dtype=np.uint64)[:, None]
        odd = (rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1))[:, None]
        for batch in _slices(batches):
            sets = gram_sets(*_list_parts(batch.column(1)), gram)
            keys, values = [], np.zeros((len(sets), bands), np.int64)
            for d, s in enumerate(sets):
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(s), 4096):
                        np.minimum(low, ((s[None, at:at + 4096] ^ salt) * odd).min(axis=1), out=low)
                    m = low.reshape(bands, rows)
                    h = np.zeros(bands, np.uint64)
                    for r in range(rows):
                        h = _mix(h + m[:, r])
                    values[d] = h.view(np.int64)
            bands_of = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), bands_of],
                names=["doc_id", "key", "grams", "bands"])

    return run


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, bands: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, key, grams, bands): the digest of the n-gram set, its size, and the hash of each band."""
    b, r = bands or banding()
    read = docs.select(docs[doc_id].cast("long").alias("doc_id"), word_hashes(text_of(docs[text])).alias("w"))
    return read.mapInArrow(_signer(b, r, gram), "doc_id long, key binary, grams long, bands array<long>")


def _meeting(threshold: float, gram: int):
    def run(group: pa.Table) -> pa.Table:
        """Check the pairs of two blocks, or of one with itself."""
        first = {}
        for row, of in enumerate(zip(group["side"].to_pylist(), group["node"].to_pylist(), group["key"].to_pylist())):
            first.setdefault(of, row)  # rows that repeat are in copies already
        group = group.take(pa.array(sorted(first.values()))).combine_chunks()
        band = group["band"][0].as_py()
        ids = group["node"].to_numpy()
        copies = group["copies"].to_numpy()
        side = group["side"].to_numpy()
        alone = group["i"][0].as_py() == group["j"][0].as_py()
        w = group["w"].chunk(0)
        sets = gram_sets(*_list_parts(w), gram)
        size = np.array([len(s) for s in sets], np.int64)
        bands = np.array(group["bands"].to_pylist(), np.int64)
        a = np.arange(len(ids)) if alone else np.flatnonzero(side == 0)
        b = a if alone else np.flatnonzero(side == 1)
        near = np.zeros((len(a), len(b)), bool)
        for k in range(bands.shape[1] if band < 0 else band + 1):
            same = bands[a, k][:, None] == bands[b, k][None, :]
            near = near | same if band < 0 or k < band else same & ~near  # in a band's own meeting: pairs that share no band before it
        ratio = np.minimum(size[a][:, None], size[b][None, :]) >= threshold * np.maximum(size[a][:, None], size[b][None, :]) - 1e-9
        near &= ratio & (size[a][:, None] > 0)
        if alone:
            near &= np.tri(len(a), k=-1, dtype=bool).T
        linked = np.zeros_like(near)
        if near.sum() <= 4 * (len(a) + len(b)):
            for x, y in zip(*np.nonzero(near)):
                both = len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True))
                linked[x, y] = both >= threshold * (size[a[x]] + size[b[y]] - both) - 1e-9
        else:
            both = _overlaps([sets[i] for i in a], [sets[i] for i in b])
            linked = near & (both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, linked @ copies[b])
        np.add.at(links, b, linked.T @ copies[a])
        root = _hang_together(ids, a, b, linked)
        some = np.flatnonzero(links)
        return pa.table({"node": ids[some], "links": links[some], "root": root[some]})

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by a product of incidence matrices over the n-grams that occur on both sides."""
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(shared), 8192):
        part = shared[at:at + 8192]
        m = []
        for sets in (a, b):
            x = np.zeros((len(sets), len(part)), np.float32)
            for row, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                at_ = np.searchsorted(part, s)
                x[row, at_[part[np.minimum(at_, len(part) - 1)] == s]] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def _hang_together(ids: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest id that each member is linked to, over any number of links inside this meeting."""
    root = ids.copy()
    while True:
        before = root.copy()
        big = np.iinfo(np.int64).max
        low_a = np.where(linked, root[b][None, :], big).min(axis=1, initial=big)
        np.minimum.at(root, a, low_a)
        low_b = np.where(linked, root[a][:, None], big).min(axis=0, initial=big)
        np.minimum.at(root, b, low_b)
        if (root == before).all():
            return root


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, gram: int = GRAM) -> DataFrame:
    """(doc_id, class_id, n_links): for each document its class, and the number of other documents at the threshold or above."""
    bands = banding(threshold, recall)
    signed = stage(signatures(docs, doc_id, text, gram, bands), "similar-signed")
    classes = stage(signed.groupBy("key", "grams", "bands").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "similar-classes")
    band = classes.where("node IS NOT NULL AND grams > 0").select("node", "grams", F.posexplode("bands").alias("band", "value"))
    company = stage(band.groupBy("band", "value").agg(F.min("node").alias("low"), F.count("*").alias("k"), F.sum("grams").alias("grams")).where("k > 1"), "similar-company")
    edges = band.drop("grams").join(company, ["band", "value"]).select(F.col("node").alias("u"), F.col("low").alias("v"))
    sets = stage(components(edges, "similar-sets"), "similar-sets")
    member = stage(classes.join(sets, "node").select("node", "key", "root", "copies", "grams", "bands"), "similar-members")
    blocks = lambda k, grams: F.greatest(F.ceil(k / BLOCK), F.ceil(grams / BLOCK_WORDS)).cast("int")
    sized = stage(member.groupBy("root").agg(blocks(F.count("*"), F.sum("grams")).alias("blocks")), "similar-sizes")
    sized = member.join(sized, "root")
    small = sized.where("blocks = 1").select("node", "key", "copies", "bands", F.lit(-1).alias("band"), F.col("root").alias("value"), "blocks")
    large = sized.where("blocks > 1").select("node", "key", "copies", "bands", F.posexplode("bands").alias("band", "value")).join(
        company.select("band", "value", blocks(F.col("k"), F.col("grams")).alias("blocks")), ["band", "value"]).select(*small.columns)
    place = small.unionByName(large).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    read = docs.select(docs[doc_id].cast("long").alias("node"), text_of(docs[text]).alias("text"))
    # no bound on the members is known, so the plan is the same at every size: both sides are shuffled
    known = read.join(member.select("node").distinct().hint("merge"), "node", "left_semi")
    payload = known.select("node", word_hashes(F.col("text")).alias("w")).mapInArrow(_keyed(gram), "node long, key binary, w array<long>")
    meet = payload.join(place.hint("merge"), ["node", "key"]).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", "key", "copies", "bands", "w", "band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    found = stage(meet.groupBy("band", "value", "i", "j").applyInArrow(_meeting(threshold, gram), "node long, links long, root long"), "similar-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "similar-classes-of")
    by_node = stage(links.join(roots, "node", "full").select(F.col("node").alias("n"), "links", "root"), "similar-nodes")
    rep = classes.select(F.col("key").alias("k"), F.col("node").alias("rep"), "copies")
    named = rep.join(by_node, F.col("rep") == F.col("n"), "left").select(
        "k", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = stage(named, "similar-named")
    return signed.join(named, F.col("key") == F.col("k"), "left").select("doc_id", "class_id", "n_links")


def _keyed(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Give each text the digest of its set again."""
        for batch in _slices(batches):
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in gram_sets(*_list_parts(batch.column(1)), gram)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], names=["node", "key", "w"])

    return run


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, once. Documents without an id cannot be named and stay."""
    keep = stage(join(docs).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct(), "similar-kept")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = row.join(keep.hint("merge"), F.col("row.doc_id") == F.col("kept_id")).dropDuplicates(["kept_id"]).select("row.*")
    return one.unionByName(docs.where(docs["doc_id"].isNull()))
