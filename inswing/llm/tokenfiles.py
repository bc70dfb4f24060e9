"""Token ids in binary shards, each document compressed alone with one shared dictionary.

Texts are encoded with a given tokenizer file, an end id is appended, and the ids are written as little-endian unsigned
integers of 16 bits (32 if the vocabulary is larger). A zstandard dictionary is trained once on a bounded sample of such
arrays; every document is then a frame of its own, so that one can be read without its neighbours, and short ones still
compress.

A shard is a range of ascending ids, one file:

    magic "IDZ1", bytes per id (u1), SHA-256 of the dictionary (32 bytes), frames, index, place of the index (u8), documents (u8), "1ZDI"

with an index entry (id, whether there is an id, offset, length, number of ids) for each document. Beside the shards lie
`dictionary`, and `manifest`, a table with a row for each shard. A shard is written under a name of its own and renamed
when whole; a task that runs again, or twice, writes the same bytes. Files are reached through pyarrow's file systems.

Defined results. A null or empty text is the end id alone. Null ids come first; rows that share an id are ordered by a hash
of their text; rows that repeat are documents of their own. An empty table gives no shard and an empty result. Extra
columns are not read. Special tokens written out in a text are encoded as the tokenizer encodes them.

Sample for the dictionary: the documents whose hash of id and text falls below the share that makes SAMPLE of them on
average, twice as many at most where rows repeat, and of each a window of SAMPLE_IDS ids at a place drawn by hash. With too few to train on, frames are
written without a dictionary.
"""
from __future__ import annotations

import hashlib
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inswing.llm.common import folder, text_of

END_ID = 1
SAMPLE = 2048
SAMPLE_IDS = 4096
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
KNOWN_WORDS = 600_000  # words, and as many pieces, that a worker remembers at once
SLICE = 256  # documents encoded together
HEAD = "<4sB32s"
TAIL = "<QQ4s"
ENTRY = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u8")])
MARKS = ".,;:!?*#$%&"
MARKED = "([A-Za-z])([.,;:!?*#$%&]+)( |$)"  # the tokenizer parts a letter from the mark behind it, so a blank between them changes nothing


class Encoder:
    """Ids of whole texts. The tokenizer never joins characters across a blank, so blank-separated pieces are encoded once
    and remembered; pieces of letters are encoded many at a time and cut at the tokens that end a word. A letter that the
    tokenizer turns into a letter and a mark (some Turkish, Indic and Hebrew ones) would join what follows, so only stems that
    stay letters when composed and lower-cased are encoded apart from the marks behind them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one slot
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        if suffix:
            for token, i in self.tok.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
        self.by_words = bool(suffix)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_words:
            return [a.tobytes() for a in self.plain(texts.to_pylist())]
        for known in (self.pieces, self.words):
            if len(known) > KNOWN_WORDS:  # the older half goes
                for k in list(islice(known, len(known) // 2)):
                    del known[k]
        # pieces are cut, told apart and put together as Arrow arrays; each different one is looked up once a call
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), MARKED, r"\1 \2\3")
        cut = pc.split_pattern(spaced, " ")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.pieces.get, pieces))
        new = {p for p, ids in zip(pieces, known) if ids is None}
        if new:
            self.learn(new)
            known = [self.pieces[p] if ids is None else ids for p, ids in zip(pieces, known)]
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        offsets, data = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:], memoryview(ids.buffers()[2] or b"")
        at = offsets[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def learn(self, pieces: set[str]) -> None:
        stems, marks, rest = [], set(), []
        for p in pieces:
            stem = p.rstrip(MARKS)
            if stem.isascii() and stem.isalpha() or _stays_letters(stem):
                stems.append((p, stem.lower() if stem.isascii() else stem, p[len(stem):]))
                marks.add(p[len(stem):])
            else:
                rest.append(p)
        self.learn_words(list({s for _, s, _ in stems}.difference(self.words)))
        known = dict(zip(m := sorted(marks), [a.tobytes() for a in self.plain(m)]))
        for p, stem, mark in stems:
            self.pieces[p] = self.words[stem] + known[mark]
        self.pieces.update(zip(rest, [a.tobytes() for a in self.plain(rest)]))

    def learn_words(self, new: list[str]) -> None:
        for at in range(0, len(new), 512):
            some = new[at:at + 512]
            ids, = self.plain([" ".join(some)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            # a word of letters is one piece or more; as many ends as words means one end each
            if len(ends) == len(some) and len(ids) == ends[-1]:
                raw, w, a = ids.tobytes(), self.dtype.itemsize, 0
                for word, e in zip(some, ends.tolist()):
                    self.words[word] = raw[a * w:e * w]
                    a = e
            else:
                self.words.update(zip(some, [a.tobytes() for a in self.plain(some)]))


def _stays_letters(stem: str) -> bool:
    return stem.isalpha() and unicodedata.normalize("NFC", stem).lower().isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", stem).lower()).isalpha()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    m = re.match(r"file:/*(/.*)", path)
    return pafs.FileSystem.from_uri(m[1] if m else path)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0).to_pylist(), part.column(1)


def train(docs: DataFrame, tokenizer: str) -> bytes:
    """The dictionary; at most twice SAMPLE arrays of SAMPLE_IDS ids reach the driver, whatever the size of `docs`."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for _, texts in _slices(batches):
            out = []
            for x in e.encode(texts):
                spare = max(0, len(x) // e.dtype.itemsize - SAMPLE_IDS)
                at = zlib.crc32(x) % (spare + 1) * e.dtype.itemsize  # a window at a hashed place
                out.append(x[at:at + SAMPLE_IDS * e.dtype.itemsize])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    share = SAMPLE / max(1, docs.count())
    drawn = docs.where(F.xxhash64("doc_id", "text").bitwiseAND(2**53 - 1) < int(share * 2**53)) if share < 1 else docs
    rows = drawn.limit(2 * SAMPLE).mapInArrow(sample, "ids binary").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(bytes(r.ids) for r in rows), d=8, k=256).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def _writer(path: str, tokenizer: str, raw: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        e, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([END_ID], dtype=e.dtype).tobytes()
        d = _dictionary(raw)
        if d:
            d.precompute_compress(level=LEVEL)
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
        fs, root = _open(path)
        name, part = f"{root}/shard-{shard:06d}.ids", f"{root}/_part-{shard:06d}-{uuid.uuid4().hex}"
        at, index = struct.calcsize(HEAD), []
        with fs.open_output_stream(part) as out:
            out.write(struct.pack(HEAD, b"IDZ1", e.dtype.itemsize, hashlib.sha256(raw).digest()))
            for ids, texts in _slices(b for some in ((first,), batches) for b in some):
                frames = []
                for doc, body in zip(ids, e.encode(texts)):
                    body += end
                    frames.append(z.compress(body))
                    index.append((doc or 0, doc is not None, at, len(frames[-1]), len(body) // e.dtype.itemsize))
                    at += len(frames[-1])
                out.write(b"".join(frames))
            table = np.array(index, dtype=ENTRY)
            out.write(table.tobytes())
            out.write(struct.pack(TAIL, at, len(table), b"1ZDI"))
        fs.move(part, name)
        known = table["id"][table["has_id"] == 1]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard]), "documents": pa.array([len(table)]), "ids": pa.array([int(table["ids"].sum())]),
            "first_id": pa.array([int(known[0]) if len(known) else None], pa.int64()), "last_id": pa.array([int(known[-1]) if len(known) else None], pa.int64())})

    return write


def write(docs: DataFrame, path: str, tokenizer: str, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write shards, dictionary and manifest under `path`."""
    spark = docs.sparkSession
    read = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs[text]).alias("text"))
    fs, root = _open(path)
    fs.create_dir(root)
    raw = train(read, tokenizer)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(raw)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash of the text takes part in the range, so that many rows of one id are split too; Spark samples what it ranges
    # by to the driver, and a hash is eight bytes
    keyed = read.withColumn("text_hash", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").select("doc_id", "text")
    ranged.mapInArrow(_writer(path, tokenizer, raw), "shard long, documents long, ids long, first_id long, last_id long").write.parquet(f"{path}/manifest")


class Shard:
    """A shard file: its index, and any one document of it."""

    def __init__(self, path: str, shard: int):
        self.fs, root = _open(path)
        with self.fs.open_input_stream(f"{root}/dictionary") as f:
            raw = f.read()
        self.file = self.fs.open_input_file(f"{root}/shard-{shard:06d}.ids")
        magic, width, digest = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        size = self.file.size()
        at, n, end = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != b"IDZ1" or end != b"1ZDI" or at + n * ENTRY.itemsize + struct.calcsize(TAIL) != size:
            raise ValueError(f"shard {shard} is not whole")
        if digest != hashlib.sha256(raw).digest():
            raise ValueError(f"shard {shard} was written with another dictionary")
        self.dtype = np.dtype(f"<u{width}")
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), dtype=ENTRY)
        self.z = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()

    def ids(self, entry: np.void, frame: bytes | None = None) -> np.ndarray:
        frame = frame if frame is not None else self.file.read_at(int(entry["length"]), int(entry["offset"]))
        out = np.frombuffer(self.z.decompress(frame), dtype=self.dtype)
        if len(out) != entry["ids"]:
            raise ValueError(f"document {entry['id']} has {len(out)} ids, the index says {entry['ids']}")
        return out

    def slices(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Index entries and their ids, read in order and a few at a time."""
        for at in range(0, len(self.index), 4 * SLICE):
            part = self.index[at:at + 4 * SLICE]
            start = int(part[0]["offset"])
            raw = self.file.read_at(int(part[-1]["offset"] + part[-1]["length"]) - start, start)
            yield part, [self.ids(e, raw[int(e["offset"]) - start:int(e["offset"]) - start + int(e["length"])]) for e in part]


def fetch(path: str, shard: int, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of a shard that bear this id; only the index and their frames are read."""
    s = Shard(path, shard)
    return [s.ids(e) for e in s.index[(s.index["id"] == doc_id) & (s.index["has_id"] == 1)]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, from the files: its id, the ids before it, how many it has, their CRC-32, and where it lies."""
    manifest = spark.read.schema("shard long, documents long, ids long, first_id long, last_id long").parquet(f"{path}/manifest")
    # one row a shard: a running sum over the manifest, not over documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, docs in Shard(path, shard).slices():
                    counts = part["ids"].astype(np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part["id"], mask=part["has_id"] == 0), pa.array(starts), pa.array(counts),
                        pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                        pa.array(np.full(len(part), shard)), pa.array(part["offset"].astype(np.int64)), pa.array(part["length"].astype(np.int64))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long, length long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write `docs` and read the files back."""
    path = folder(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
