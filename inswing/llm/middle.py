"""Fill-in-middle: a text is cut into prefix, middle and suffix at line ends and written in another order.

Everything happens on Arrow arrays, a batch at a time: texts are split into lists of units, the lists are flattened with the
index of their text, ordinals within the text say on which side of the two cuts a unit lies, units are filtered by that role,
put back into lists and joined. No loop runs over texts or units.

A unit is a line with its line break, or the rest after the last one. Both cuts and the form come from the SHA-256 of the seed
and the id, so a document is cut alike wherever and whenever it is read:

    psm   <P>prefix<S>suffix<M>middle        spm   <S>suffix<P>prefix<M>middle        plain   the text

A text that holds one of the three marks stays plain, so `restore` can cut any output at its marks again.

Defined results. A null text is an empty one; empty texts are plain with no units. A null id is hashed as no digits. Rows that
repeat, or share an id, are cut by the same hash and stay rows of their own. A very long text is one row throughout; batches
are cut so that a piece holds PIECE bytes or one text. An empty table gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from inswing.llm.common import text_of

SEED = 7
RATE = 100  # of 100 documents, those that are cut
SUFFIX_FIRST = 50  # of 100 cut documents, those whose suffix comes first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 32 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _units(text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of all texts, the index of each unit's text, its ordinal there, and the number of units of each text."""
    lines = pc.split_pattern(text, "\n")
    count = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, parent = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy()
    ordinal = np.arange(len(flat)) - (np.cumsum(count) - count)[parent]
    last = ordinal == count[parent] - 1
    units = pc.if_else(pa.array(last), flat, pc.binary_join_element_wise(flat, "\n", ""))
    real = ~last | (pc.binary_length(flat).to_numpy() > 0)  # nothing follows a closing line break
    return units.filter(pa.array(real)), parent[real], ordinal[real], np.bincount(parent[real], minlength=len(text))


def _joined(units: pa.StringArray, parent: np.ndarray, role: np.ndarray, of: int, rows: int) -> pa.StringArray:
    mask = role == of
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[mask], minlength=rows))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units.filter(pa.array(mask))), "")


def cut(doc_id: pa.Array, text: pa.StringArray, hashes: list[np.ndarray], rate: int, suffix_first: int) -> pa.RecordBatch:
    units, parent, ordinal, n = _units(text)
    one, two = hashes[0] % (n + 1), hashes[1] % (n + 1)
    role = (ordinal >= np.minimum(one, two)[parent]).astype(np.int8) + (ordinal >= np.maximum(one, two)[parent])
    prefix, middle, suffix = (_joined(units, parent, role, k, len(text)) for k in range(3))
    plain = pa.array((n == 0) | (hashes[2] % 100 >= rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, mark))
    spm = pa.array(hashes[3] % 100 < suffix_first)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    ordered = pc.if_else(
        spm, pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
        pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(n, pa.int64()), form, *chars, pc.if_else(plain, text, ordered)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of PIECE bytes of text, or one row where that is longer."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): n units; characters are null where the form is plain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                yield cut(piece.column("doc_id"), piece.column("text"), [piece.column(f"h{i}").to_numpy() for i in range(4)], rate, suffix_first)

    doc_id = docs["doc_id"].cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    return docs.select(doc_id.alias("doc_id"), text_of(docs["text"]).alias("text"), *hashes).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the first mark, the second one and the one of the middle."""
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(body))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """`transform` with digests of the output and of the text restored from it."""
    done = transform(docs)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
