"""Chats, the archive, and the pipeline."""
from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inswing.llm import chat, warc
from inswing.llm.graph import components
from inswing.llm.queries import QUERIES
from inswing.llm.sql import ORACLE
from tests.conftest import SF
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(dict(zip(names, r))[c]) for c in columns]) for r in cur.fetchall())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (160, 205), (205, 159)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 161)}, 205: 100, 200: 200, 201: 200}


CHATS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"),
    (4, 5, "user", "a"), (4, 9, "assistant", "b"), (4, 9, "assistant", "b"), (4, 10, "user", "c"), (5, 0, "user", None), (6, 0, None, "x <|im_end|>"), (7, 0, "assistant", "a"),
    (None, 0, "user", "q"), (8, None, "user", "z"), (9, 0, "user", "ab"), (9, 1, "user", ""),
]


def test_chats(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(1) for x in ("n", "h1", "h2", "last", "copies")})
    got = {r.conv_id: r for r in chat.format(df).collect()}
    # 1 and 3 are prefixes of 2, and 4 is its copy
    assert set(got) == {2, 5, 6, 7, None, 8, 9}
    assert (got[2].copies, got[2].n_turns) == (2, 3)
    assert got[2].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[6].text == "<|im_start|>\nx < |im_end|><|im_end|>\n"
    assert chat.format(df.limit(0)).count() == 0


def test_chat_rows_without_an_id(spark):
    """A third of all rows have a null id: each is a conversation, none of them is joined with another or lost."""
    given = [(i // 2, i % 2, "user", f"t{i}") for i in range(400)]
    given += [(None, i % 3, "user", "hot") for i in range(150)] + [(None, None, None, None)] * 2
    # a prefix of conversation 0, equal to conversation 500, and the same row twice under one id
    given += [(None, 7, "user", "t0"), (None, 0, "user", "same"), (500, 3, "user", "same"), (501, 1, "a", "b"), (501, 1, "a", "b")]
    got = sorted((tuple(r) for r in chat.format(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect()), key=str)
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    want = [(i, 2, 1, one("user", f"t{2 * i}") + one("user", f"t{2 * i + 1}")) for i in range(200)]
    want += [(None, 1, 150, one("user", "hot")), (None, 1, 2, one("", "")), (500, 1, 2, one("user", "same")), (501, 1, 1, one("a", "b"))]
    assert got == sorted(want, key=str)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [(1, "http://a/", "é" * 600), (5, "http://b/\r\nX: y", "é" * 600), (3, None, "é" * 600), (2, "http://c/", "short"), (4, "http://d/", "short"), (6, "u", None), (7, None, "z" * 1000), (None, "n", "z" * 1000), (8, "w", "q" * 1000)]


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages(spark, PAGES).withColumns({x: F.lit(1) for x in ("digest", "payload", "size", "kind")}), path)
    got = {r.page_id: tuple(r)[1:] for r in warc.read(spark, path).collect()}
    assert got[5][0] == 1200 and {i: got[i][2:] for i in got} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None),
        None: ("revisit", 7), 8: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    records = {r.page_id: bytes(r.record) for r in warc.records(spark, path).withColumn("page_id", warc._page(warc.field(F.col("header"), "WARC-Record-ID"))).collect()}
    for page, _, html in PAGES:
        head, _, rest = records[page].partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[length:] == b"\r\n\r\n"
        body = (html or "").encode()
        assert rest[:length].endswith(b"\r\n\r\n" + (b"" if got[page][2] == "revisit" else body))
    assert warc.verify(spark, path).count() == 0


def test_archive_sees_damage(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages(spark, PAGES), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.octet_length("payload") == 1200, F.lit("x").cast("binary")).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    assert sorted(r.page_id for r in warc.verify(spark, path).collect()) == [1, 3, 5]
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, path).collect()


def test_archive_rebuilds_hot_and_long_pages(spark, tmp_path):
    """A third of all pages share a small payload, a third a large one, one page is very long, one payload is lost."""
    rows = [(i if i % 3 else None, f"u{i}", ["tiny", "L" * 1500, f"own {i} " * 300][i % 3]) for i in range(300)] + [(1000, "long", "é" * 2_000_000)]
    path = str(tmp_path / "archive")
    warc.write(pages(spark, rows), path)
    got = warc.read(spark, path).collect()
    assert sorted((r.payload_bytes for r in got)) == sorted(len(h.encode()) for _, _, h in rows)
    assert sorted((r.payload_digest for r in got)) == sorted(hashlib.sha1(h.encode()).hexdigest() for _, _, h in rows)
    large = [r for r in got if r.payload_bytes == 1500]
    assert sorted(r.record_type for r in large) == ["response"] + ["revisit"] * 99 and {r.refers_to for r in large} == {None, 298}
    left = spark.read.parquet(f"{path}/payloads").where(F.octet_length("payload") != 4).collect()
    spark.createDataFrame(left, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    assert {r.payload_bytes for r in warc.verify(spark, path).collect()} == {4} and warc.verify(spark, path).count() == 100


def test_archive_odd(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    twice = [tuple(r) for r in warc.round_trip(pages(spark, [(1, "a", "x" * 2000)] * 2)).collect()]
    assert len(twice) == 2 and {r[3] for r in twice} == {"response"}


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, docs = [], documents
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, SF)
        if name != "token-ID output":
            assert docs.columns == documents.columns
        sizes.append(docs.count())
        if name == "quality rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in documents.collect() if not brute.quality(r.text)[5]}
        if name == "n-gram Jaccard join":
            classes = brute.similar([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for c, _ in classes.values()})
    assert len(documents.take(1)) and all(sizes) and sizes[-1] == sizes[-2]
    total = docs.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).head()
    assert total[0] == total[1]


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0
