"""License scan by diagonal voting.

Templates are license notices and short phrases. Every text is cut into rolling word k-grams; a Spark join brings each
k-gram to the template positions that hold it. A hit votes for the diagonal (place in the text minus place in the
template). Votes are summed by document, template and diagonal; diagonals that follow each other closely are merged, so
that a few inserted or missing words do not break a copy; a merged span counts if it holds enough of the template's
k-grams. Hits carry the words of the k-gram, so that a hash that meets by chance is refused before it votes.

A phrase is a template of one k-gram: each of its places is one vote, always a whole span.

Defined results. Words are runs of letters a-z, digits and characters beyond ASCII after lower-casing. A null or empty text
has no words, no labels and a score of 0. Rows that repeat (same id and text) are scanned together and returned as often
as they came; rows that share an id but not the text stay apart; a null id is an id. An empty table gives an empty
result; extra columns are not read. A template whose span is reported twice in a text counts once as a label.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inswing.llm.common import text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
MIN_COVER = 0.6  # of a template's k-grams, for a span to count
SHIFT = 6  # words by which neighbouring diagonals may differ
GAP = 12  # words between the end of one diagonal and the start of the next

# The phrases of the contract and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Opening sentences of public license notices.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _hashes(w: Column, n: Column, k: int) -> Column:
    """The hash of every run of k words, by its first place."""
    return F.when(n >= k, F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession) -> DataFrame:
    """(k, h, gram, template, place, grams, label, base): a row for each k-gram of each template; a fixed number of rows."""
    rows = [(i, t, label, base, len(t.split()) if base else GRAM)
            for i, (t, label, base) in enumerate([(t, lb, True) for t, lb in PHRASES] + [(t, lb, False) for t, lb in NOTICES])]
    given = spark.createDataFrame(rows, "template int, text string, label string, base boolean, k int")
    parts = []
    for k in sorted({r[4] for r in rows}):
        w = given.where(F.col("k") == k).withColumn("w", license_words(F.col("text")))
        parts.append(w.select("*", F.posexplode(_hashes(F.col("w"), F.size("w"), k)).alias("place", "h"))
                     .select("k", "h", F.concat_ws(" ", F.slice("w", F.col("place") + 1, k)).alias("gram"), "template", "place",
                             (F.size("w") - k + 1).alias("grams"), "label", "base"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans and one carrier row for each distinct (id, text).

    (doc_id, key, n_words, copies, template, label, base, first, last, cover); a carrier has a null template and the number
    of rows that share the id and the text in copies."""
    spark = docs.sparkSession
    known = templates(spark)
    sizes = sorted({GRAM, *(len(p.split()) for p, _ in PHRASES)}, reverse=True)
    w, n = F.col("w"), F.col("n")
    read = (
        docs.select(docs[doc_id].alias("doc_id"), text_of(docs[text]).alias("text"))
        .select("doc_id", F.xxhash64("text").alias("key"), license_words(F.col("text")).alias("w"))
        .withColumn("n", F.size("w")))
    # the k-grams of each size one after another, then one null that carries the document through
    grams = F.concat(*[_hashes(w, n, k) for k in sizes], F.array(F.lit(None).cast("bigint")))
    # the outer form: for the inner one the optimiser adds a filter that would split the text anew for every element
    hit = (
        read.withColumn("g", grams).select("doc_id", "key", "w", "n", F.size("g").alias("total"), F.posexplode_outer("g").alias("p", "h"))
        .join(F.broadcast(known), "h", "left").where(F.col("template").isNotNull() | (F.col("p") == F.col("total") - 1)))
    before, start = F.lit(0), F.lit(None).cast("int")
    for k in sizes:
        start = F.when(F.col("k") == k, F.col("p") - before).otherwise(start)
        before = before + F.greatest(n - k + 1, F.lit(0))
    hit = (
        hit.withColumn("at", start)
        .where(F.col("template").isNull() | (F.concat_ws(" ", F.slice(w, F.col("at") + 1, F.col("k"))) == F.col("gram")))
        .select("doc_id", "key", F.col("n").cast("long").alias("n_words"), "template", "label", "base", "k", "grams", "place", F.col("at").cast("long").alias("at"))
        .repartition("doc_id", "key"))
    # one exchange by document serves all that follows; rows that repeat fold into one vote
    votes = hit.groupBy("doc_id", "key", "n_words", "template", "label", "base", "k", "grams", "place", "at").agg(F.count("*").alias("copies"))
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("doc_id", "key", "n_words", "template", "label", "base", "k", "grams", "diagonal").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("votes"), F.max("copies").alias("copies"))
    order = Window.partitionBy("doc_id", "key", "template").orderBy("first", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= SHIFT) & (F.col("first") - F.lag("last").over(order) <= GAP) & ~F.col("base")
    runs = lines.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("doc_id", "key", "n_words", "template", "label", "base", "k", "grams", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.max("copies").alias("copies"))
    cover = F.when(F.col("template").isNotNull(), F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
    return merged.withColumn("cover", cover).where(F.col("template").isNull() | (F.col("cover") >= MIN_COVER)).select(
        "doc_id", "key", "n_words", "copies", "template", "label", "base", "first", (F.col("last") + F.col("k")).alias("end"), "cover")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_words, the places of the base phrases, labels and a score."""
    base = F.col("base")
    label = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a fixed number of labels
    return (
        spans(docs, doc_id, text).groupBy("doc_id", "key", "n_words").agg(
            F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"), label(F.when(base, F.col("label"))).alias("base_labels"),
            label(F.col("label")).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy"))
