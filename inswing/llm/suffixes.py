"""Substring deduplication on bytes by a sorted suffix array.

A byte goes if a string of LENGTH bytes covers it that also starts earlier, in a document before or in the same one, overlaps
included. Texts are UTF-8 bytes; strings do not cross documents and are judged on the input.

Sorting every suffix of a large corpus would write it many times over, so the array is sparse. Every window of LENGTH bytes
names one anchor inside itself, the leftmost of its GRAM-byte strings with the smallest hash. Equal windows name the anchor at
the same place, so windows that start at different distances from their anchors are different, and equal ones meet under the
hash of their anchor. A text has one anchor in about 34 bytes. Around an anchor lies its context, the bytes of all windows that
name it; `place` holds where the first of them starts, how many more there are, and how far the anchor is from that start.

1. Texts are written in the order of documents with a running row number; (row, place) then tells earlier from later.
2. Anchor hashes are counted, and the anchors joined to the hashes that occur twice or more.
3. Contexts that are alike as a whole fold to the earliest; in all others each window starts earlier elsewhere.
4. What is left, different contexts of one anchor, is ordered: the bytes from the anchor on as suffixes, and those before it,
   read backwards, as suffixes too. `deep_shallow` sorts them: multikey quicksort, eight bytes as one character and all
   groups of a depth at once, down to SHALLOW bytes, then a blind trie for each group that is still alike. Neighbours in
   the two orders give the length of their common beginning, those lengths give the class of each suffix at any depth, and
   two windows are equal if and only if they start r bytes before their anchors, their left classes at depth r are one,
   and their right classes at depth LENGTH - r. The earliest of them stays.
5. Windows that start earlier become spans of bytes, joined to the texts.

A task sorts a bounded chunk: the contexts of an anchor stay together, and an anchor with more than CONTEXTS different ones is
not sorted as a group but window by window: those fold by a 128-bit digest before the shuffle, which no single hash can fill.
Joins on anchors have one side with a row for each key, so that Spark can split the other where an anchor is hot.

Defined results. A null or empty text has no bytes and nothing is removed. Documents come by id, null ids last; rows that share
an id come by a hash of their text, rows that are alike in both follow each other, and each stays a row of its own, so all
but the first of them lose every byte if there are LENGTH or more. A very long text is cut into pieces that overlap and gives what
it would give whole. Bytes may be cut inside a character, so what is kept is binary. An empty table gives an empty
result. Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from inswing.llm.common import stage, text_of, tidy

LENGTH = 100
GRAM = 32
SHALLOW = 40  # bytes that multikey quicksort looks at
CONTEXTS = 20_000  # of one anchor, sorted as a group
CHUNK = 1 << 17  # bytes that are hashed at once
PIECE = 1 << 22  # bytes of a text that are read at once
SORTED = 100_000  # contexts that are sorted at once, an anchor's more
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # odd numbers without a pattern


def _written(df: DataFrame, name: str) -> DataFrame:
    with tidy(df.sparkSession):
        return stage(df, f"suffixes-{name}")


def _anchors(texts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(which text, hash, first window, last window, anchor, all in bytes) of the anchors of a few texts."""
    wide = LENGTH - GRAM + 1  # grams in a window
    size = np.array([len(t) for _, _, t in texts])
    ends = np.cumsum(size)
    n = int(ends[-1])
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 5
    words = np.ndarray((n - 7,), "<u8", buffer=b"".join(t for _, _, t in texts), strides=(1,))
    grams = n - GRAM + 1
    h = np.zeros(grams, "u8")
    for at in range(0, GRAM, 8):
        h ^= words[at:at + grams]
        h *= _FACTORS[0]
        h ^= h >> np.uint64(31)
    h *= _FACTORS[1]
    h ^= h >> np.uint64(32)
    # the smallest hash, and of equal ones the leftmost: 40 bits of hash over 24 of place
    low = np.uint64((1 << 24) - 1)
    keys = np.full(-(-grams // wide) * wide, np.iinfo("u8").max, "u8")
    keys[:grams] = (h * _FACTORS[2]) & ~low | np.arange(grams, dtype="u8")
    blocks = keys.reshape(-1, wide)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(since[:windows], upto[wide - 1:wide - 1 + windows])
    of = np.repeat(np.arange(len(texts)), size)[:windows]
    start = np.flatnonzero(np.arange(LENGTH, n + 1) <= ends[of])  # windows that lie in one text
    if not len(start):
        return (np.empty(0, np.int64),) * 5
    anchor, of = (least[start] & low).astype(np.int64), of[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(start) - 1]])
    return of[new], h[anchor[new]].view(np.int64), start[new], start[last], anchor[new]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) of CHUNK bytes or more; long texts in pieces, each with every window that starts in it."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            raw = text.as_buffer()
            whole = raw.size
            for at in range(0, max(whole - LENGTH + 1, 0), PIECE):
                part = bytes(memoryview(raw)[at:at + PIECE + LENGTH - 1])
                held.append((row, at, part))
                size += len(part)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _groups(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_anchors(texts)[1])], names=["hash"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _groups(batches):
        of, h, first, last, anchor = _anchors(texts)
        raw = memoryview(b"".join(t for _, _, t in texts))
        size = np.array([len(t) for _, _, t in texts])
        start = first - (np.cumsum(size) - size)[of] + np.array([a for _, a, _ in texts])[of]
        digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())], dtype="u8").view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(digest), pa.array(np.array([r for r, _, _ in texts])[of]), pa.array(start << 16 | (last - first) << 8 | anchor - first)],
            names=["hash", "digest", "row", "place"])


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings of one length. A node knows the depth at which its strings part and their bytes there, no more:
    a string goes down by those bytes, is compared once with a string it meets at the bottom, and enters where they part."""
    wide = len(strings[0])
    root: list | int = 0  # a leaf is its first string; an inner node is [depth, {byte: below}, a leaf below]
    same: dict[int, list[int]] = {0: [0]}
    values = [int.from_bytes(s, "big") for s in strings]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node.__class__ is list:
            node = node[1].get(s[node[0]], node[2])
        differ = values[i] ^ values[node]
        if not differ:
            same[node].append(i)
            continue
        depth = wide - (differ.bit_length() + 7) // 8
        same[i] = [i]
        up, node = None, root
        while node.__class__ is list and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        if node.__class__ is list and node[0] == depth:
            node[1][s[depth]] = i
            continue
        leaf = node[2] if node.__class__ is list else node
        fresh = [depth, {s[depth]: i, strings[leaf][depth]: node}, leaf]
        if up is None:
            root = fresh
        else:
            up[1][s[up[0]]] = fresh
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.__class__ is list:
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(same[node])
    return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and how many bytes each has in common with the one before it in that order."""
    n, wide = rows.shape
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -wide % 8)))).view(">u8").astype("u8")
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order that are not settled
    depth = 0
    while len(open_) and depth < min(SHALLOW // 8, words.shape[1]):
        character = words[order[open_], depth]
        by = np.lexsort((character, group[open_]))
        order[open_] = order[open_][by]
        character, of = character[by], group[open_]
        starts = np.concatenate([[True], (character[1:] != character[:-1]) | (of[1:] != of[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(starts, np.arange(len(open_)), 0))]
        alone = starts & np.concatenate([starts[1:], [True]])
        open_ = open_[~alone]
        depth += 1
    if len(open_):
        of = group[open_]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() + [len(open_)]
        for a, b in zip(cuts, cuts[1:]):
            at = open_[a:b]
            tail = rows[order[at], 8 * depth:] if 8 * depth < wide else rows[order[at], :0]
            if tail.shape[1]:
                order[at] = order[at][blind_trie([t.tobytes() for t in tail])]
    common = np.zeros(n, np.int64)
    if n > 1:
        apart = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), wide)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its class among the rows that share their first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(contexts: list[bytes], windows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of each window that an earlier context has too; contexts come in the order of their places.

    Context i has windows[i] + 1 windows, one at each of its first bytes, and its anchor at anchors[i]."""
    n, before = len(contexts), LENGTH - GRAM
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, before), np.uint8)
    for i, (c, a) in enumerate(zip(contexts, anchors.tolist())):
        right[i, :len(c) - a] = np.frombuffer(c, np.uint8, len(c) - a, a)
        left[i, :a] = np.frombuffer(c, np.uint8, a)[::-1]
    by_right, by_left = deep_shallow(right), deep_shallow(left)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(before + 1):
        some = np.flatnonzero((anchors - windows <= r) & (r <= anchors))
        if len(some):
            key = _classes(*by_right, LENGTH - r)[some] * (n + 1) + _classes(*by_left, r)[some]
            _, first, at = np.unique(key, return_index=True, return_inverse=True)
            again = some[first[at] != np.arange(len(some))]
            found.append((again, anchors[again] - r))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


RANGES = "row long, start long, end long"


def _range_batch(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, start, end)], names=["row", "start", "end"])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that come sorted by hash, a chunk of whole hashes at a time: the bytes of windows that start earlier."""
    def ranges(chunk: pa.Table) -> pa.RecordBatch:
        row, place = (chunk.column(x).to_numpy() for x in ("row", "place"))
        by = np.lexsort((place, row))
        row, place = row[by], place[by]
        texts = chunk.column("context").to_pylist()
        context, window = repeated_windows([texts[i] for i in by.tolist()], place >> 8 & 255, place & 255)
        by = np.lexsort((window, context))
        context, window = context[by], window[by]
        new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1)])) if len(context) else context
        last = np.concatenate([new[1:] - 1, [len(context) - 1]]) if len(context) else context
        start = place[context] >> 16
        return _range_batch(row[context[new]], start[new] + window[new], start[last] + window[last] + LENGTH)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SORTED:
            whole = pa.Table.from_batches(held)
            h = whole.column("hash").to_numpy()
            upto = int(np.searchsorted(h, h[-1], "left"))  # the last hash may go on
            if upto:
                yield ranges(whole.slice(0, upto))
                held, size = whole.slice(upto).to_batches(), size - upto
    if size:
        yield ranges(pa.Table.from_batches(held))


def texts_in_order(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): texts as bytes, written with row numbers that follow the order of documents."""
    text = text_of(docs["text"])
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    read = read.withColumn("last", F.col("doc_id").isNull())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = read.repartitionByRange(parts, "last", "doc_id", "h").sortWithinPartitions("last", "doc_id", "h", "text")
    return _written(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")


def _with_places(texts: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """The texts that have places, each with the list of its own, which is bounded by its length."""
    lists = places.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct(*columns)).alias("places"))
    return texts.join(lists, F.col("row") == F.col("of")).select("row", "text", "places")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for row, text, places in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("places")):
            raw = memoryview(text.as_buffer())
            for h, place in zip(places.values.field("hash").to_pylist(), places.values.field("place").to_pylist()):
                start = place >> 16
                for column, value in zip(out, (h, row, place, bytes(raw[start:start + (place >> 8 & 255) + LENGTH]))):
                    column.append(value)
        for at in range(0, len(out[0]), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[at:at + 50_000], k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["hash", "row", "place", "context"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts window by window."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            out: list[list] = [[] for _ in range(3)]
            for row, place, c in zip(*(batch.column(x).slice(at, 2000).to_pylist() for x in ("row", "place", "context"))):
                for i in range((place >> 8 & 255) + 1):
                    for column, value in zip(out, (xxhash.xxh3_128_digest(c[i:i + LENGTH]), row, (place >> 16) + i)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "row", "start"])


def repeats(texts: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(row, start, end): bytes covered by windows that start earlier; ranges may touch and overlap."""
    own = texts.select("row", "text")
    twice = _written(own.mapInArrow(_hashes, "hash long").groupBy("hash").count().where("count > 1").select("hash"), "hashes")
    places = _written(own.mapInArrow(_places, "hash long, digest long, row long, place long").join(twice, "hash"), "places")
    earliest = _written(places.groupBy("hash", "digest").agg(F.min(F.struct("row", "place")).alias("of")), "earliest")
    # a context like an earlier one as a whole: each of its windows starts earlier
    later = places.join(earliest, ["hash", "digest"]).where(F.struct("row", "place") != F.col("of"))
    start = F.shiftright("place", 16)
    whole = later.select("row", start.alias("start"), (start + F.shiftright("place", 8).bitwiseAND(255) + LENGTH).alias("end"))
    # different contexts of one anchor
    several = _written(earliest.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1"), "several")
    some = earliest.select("hash", "of.row", "of.place").join(several, "hash")
    groups = _cut(own, some.where(F.col("k") <= contexts))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = groups.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(_sorted, RANGES)
    found = whole.unionByName(part)
    if several.where(F.col("k") > contexts).head(1):
        each = _written(_cut(own, some.where(F.col("k") > contexts)).mapInArrow(_single, "digest binary, row long, start long"), "windows")
        first = _written(each.groupBy("digest").agg(F.min(F.struct("row", "start")).alias("of"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
        again = each.join(first, "digest").where(F.struct("row", "start") != F.col("of"))
        found = found.unionByName(again.select("row", "start", (F.col("start") + LENGTH).alias("end")))
    return _written(found, "ranges")


def _cut(texts: DataFrame, places: DataFrame) -> DataFrame:
    return _with_places(texts, places, ["hash", "place"]).mapInArrow(_contexts, "hash long, row long, place long, context binary")


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places")):
            raw = memoryview(text.as_buffer())
            spans: list[dict] = []
            kept, at = [], 0
            if places.is_valid:
                start, end = (places.values.field(x).to_numpy() for x in ("start", "end"))
                by = np.argsort(start, kind="stable")
                start, reach = start[by], np.maximum.accumulate(end[by])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                for a, b in zip(start[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(start) - 1]])].tolist()):
                    spans.append({"start": a, "end": b})
                    kept.append(raw[at:a])
                    at = b
            kept.append(raw[at:])
            for column, value in zip(out, (doc, len(raw), sum(s["end"] - s["start"] for s in spans), spans, b"".join(kept))):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def clean(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): for each document the maximal spans that go, in bytes, and what is left."""
    texts = texts_in_order(docs)
    ranges = repeats(texts, contexts)
    lists = ranges.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("places"))
    both = texts.join(lists, F.col("row") == F.col("of"), "left").select("doc_id", "text", "places")
    return both.mapInArrow(_strip, KEPT)


def report(docs: DataFrame) -> DataFrame:
    return clean(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
