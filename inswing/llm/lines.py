"""Substring deduplication by line hashing.

A text is cut into lines. A line is normalised (lower case, each run of white space one blank, trimmed) and digested with
128 bits. Digests of lines of MIN_WORDS words or more are grouped globally; of equal lines the earliest by (id, offset)
stays, all others are removed. What is removed is kept as spans of the original text, with the document that keeps it.

The holder of a digest is a minimum, made before the shuffle, so a line that very many documents share is one row after
it. Digests that occur in one document only fall out there; the others are joined back to the lines, by a join of two
written tables, which Spark can split where a digest is hot.

`repeats` leaves shorter lines alone, however many of them follow each other, as the SQL of op9_line_dedup states it.
`passages` also finds what is wrapped into short lines: from each line that is not blank, and up to each, the shortest run of
such lines with MIN_WORDS words is digested, and of equal runs the earliest stays. A passage of MIN_WORDS words or more in
whole lines is covered by these runs, so every line of a passage that stands earlier goes, and lone short lines stay. A
run counts as earlier in its own document only if the two don't overlap. Runs that touch or overlap are one span.

`clauses` also finds what is pasted into the middle of a line: its units end behind a word with one of the marks . ! ? , ; : at
its end, or the letter r, so that equal passages are cut alike wherever they stand, also where marks are rare. From each
unit the shortest run of MIN_WORDS words is digested. Such runs are short, so what repeats is removed only where
they add up to MIN_SPAN words or more in one span; lone phrases that many documents share stay.

Defined results. A null or empty text has no lines. A span runs from a line's first character to its line break,
inclusive; the last line's to the end of the text; offsets count code points. Within a document the first of equal lines
counts. Null ids rank last; rows with a null id count as one document, and so do rows that share an id: each of them keeps
its first occurrence if the id is the holder. An empty table gives an empty result. Extra columns stay.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from inswing.llm.common import stage, text_of, tidy

MIN_WORDS = 20
MIN_SPAN = 30  # words of a span that clauses removes
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UNIT = re.compile(r"(?=[^\x20\x09-\x0D])(?s:.*?)(?:[.!?,;:rR](?=[\x20\x09-\x0D]|\Z)|\Z)")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SCHEMA = "doc_id long, key long, start long, end long, n_words long, digest binary, again boolean"


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, seen, size = 0, set(), len(text)
                for line in text.split("\n"):
                    end = min(at + len(line) + 1, size)
                    # a line of n words has 2 n - 1 characters at least
                    if len(line) >= 2 * min_words - 1 and len(w := line.lower().split()) >= min_words:
                        digest = xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass"))
                        for column, value in zip(out, (doc, key, at, end, len(w), digest, digest in seen)):
                            column.append(value)
                        seen.add(digest)
                    at = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


RUN_SCHEMA = "doc_id long, key long, start long, end long, before long, upto long, digest binary, again boolean"


def _runs(min_words: int):
    def pairs(upto: list[int]) -> set[tuple[int, int]]:
        """First and last line of the shortest run from each line and up to each; upto[i] words stand before line i."""
        out, n, j, i = set(), len(upto) - 1, 0, 0
        for a in range(n):
            while j < n and upto[j] - upto[a] < min_words:
                j += 1
            if upto[j] - upto[a] < min_words:
                break
            out.add((a, j - 1))
        for b in range(n):
            while upto[b + 1] - upto[i + 1] >= min_words:
                i += 1
            if upto[b + 1] - upto[i] >= min_words:
                out.add((i, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 6 + (pa.binary(), pa.bool_())
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, size, lines, upto = 0, len(text), [], [0]
                for line in text.split("\n"):
                    end = min(at + len(line) + 1, size)
                    if w := line.lower().split():
                        lines.append((at, end, " ".join(w)))
                        upto.append(upto[-1] + len(w))
                    at = end
                seen: dict[bytes, int] = {}
                for a, b in sorted(pairs(upto)):
                    digest = xxhash.xxh3_128_digest("\n".join(x[2] for x in lines[a : b + 1]).encode("utf-8", "surrogatepass"))
                    again = seen.setdefault(digest, b) < a
                    for column, value in zip(out, (doc, key, lines[a][0], lines[b][1], upto[a], upto[b + 1], digest, again)):
                        column.append(value)
                # a long document has as many runs as lines; they leave in pieces
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _clause_runs(min_words: int):
    """The shortest run of min_words words from each clause."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 6 + (pa.binary(), pa.bool_())
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                starts, ends, words, upto = [], [], [], [0]
                cut = _WORD.findall if _OTHER_SPACE.search(text) else str.split
                for m in _UNIT.finditer(text):
                    unit = cut(m.group().lower())
                    starts.append(m.start())
                    ends.append(m.end())
                    words.append(" ".join(unit))
                    upto.append(upto[-1] + len(unit))
                if ends:  # the last unit may run on into white space
                    ends[-1] = len(text.rstrip(" \t\n\v\f\r"))
                seen: dict[bytes, int] = {}
                n, b = len(words), 0
                for a in range(n):
                    while b < n and upto[b] - upto[a] < min_words:
                        b += 1
                    if upto[b] - upto[a] < min_words:
                        break
                    digest = xxhash.xxh3_128_digest("\n".join(words[a:b]).encode("utf-8", "surrogatepass"))
                    out.append((doc, key, starts[a], ends[b - 1], upto[a], upto[b], digest, seen.setdefault(digest, b - 1) < a))
                    if len(out) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines of min_words words or more: where they stand, their digest, and whether an equal line stands before in the document.

    key, a hash of the text, tells rows apart that share an id."""
    text = text_of(docs["text"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(_cut(min_words), SCHEMA)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, start, end, n_words, kept_doc_id): the spans to remove, once for each document."""
    lines = stage(units(docs, min_words), "lines")
    held = lines.where("NOT again").groupBy("digest").agg(F.min("doc_id").alias("holder"), F.count("*").alias("k"))
    held = stage(held.where("k > 1").select(F.col("digest").alias("d"), "holder", F.lit(True).alias("shared")), "lines-held")
    both = lines.join(held, F.col("digest") == F.col("d"), "left")
    gone = F.col("again") | (F.coalesce("shared", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("holder")))
    return both.where(gone).select("doc_id", "key", "start", "end", "n_words", F.when(F.col("shared"), F.col("holder")).otherwise(F.col("doc_id")).alias("kept_doc_id")).distinct()


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, start, end, n_words, kept_doc_id): disjoint spans of repeated passages of whole lines, once for each document.

    kept_doc_id is the earliest of the documents that keep a part of the span."""
    return _spans(_texts(docs).mapInArrow(_runs(min_words), RUN_SCHEMA))


def clauses(docs: DataFrame, min_words: int = MIN_WORDS, min_span: int = MIN_SPAN) -> DataFrame:
    """Like `passages`, of clauses instead of lines; spans of min_span words or more."""
    with tidy(docs.sparkSession):
        return _spans(_texts(docs).mapInArrow(_clause_runs(min_words), RUN_SCHEMA)).where(F.col("n_words") >= min_span)


def _texts(docs: DataFrame) -> DataFrame:
    text = text_of(docs["text"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _spans(runs: DataFrame) -> DataFrame:
    """Runs that stand earlier too, put together where they touch or overlap."""
    runs = stage(runs, "lines-runs")
    held = runs.where("NOT again").groupBy("digest").agg(F.min("doc_id").alias("holder"), F.count("*").alias("k"))
    held = stage(held.where("k > 1").select(F.col("digest").alias("d"), "holder", F.lit(True).alias("shared")), "lines-runs-held")
    both = runs.join(held, F.col("digest") == F.col("d"), "left")
    gone = F.col("again") | (F.coalesce("shared", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("holder")))
    place = ["doc_id", "key", "start", "end", "before", "upto"]
    # written, as the join's shuffle is the largest; rows that repeat have equal runs, which change no span
    once = stage(both.where(gone).select(*place, F.when(F.col("shared"), F.col("holder")).otherwise(F.col("doc_id")).alias("holder")), "lines-again")
    # the runs of one document, which leave it as spans; words, not offsets, tell neighbours, as blank lines may stand between
    order = Window.partitionBy("doc_id", "key").orderBy("before", "upto")
    fresh = F.coalesce(F.col("before") > F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = once.withColumn("fresh", fresh.cast("long")).withColumn("island", F.sum("fresh").over(order))
    return island.groupBy("doc_id", "key", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("upto") - F.min("before")).alias("n_words"), F.min("holder").alias("kept_doc_id")).drop("island")


def clean(docs: DataFrame, min_words: int = MIN_WORDS, find: Callable[[DataFrame, int], DataFrame] = repeats) -> DataFrame:
    """`docs` without the repeated lines, or passages where those are found; their other columns stay."""
    # the spans of one document, as many as it has lines
    spans = find(docs, min_words).groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = stage(spans, "lines-spans")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(text_of(docs["text"])).alias("key"))
    both = row.join(spans, F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    text = F.col("row.text")
    # what stands between the spans, in their order
    rest = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return both.select(*[(F.when(F.col("spans").isNull(), text).otherwise(rest) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
