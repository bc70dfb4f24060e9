"""Chat formatting after a collapse of cumulative snapshots.

A chat that is logged after every turn leaves conversations that are prefixes of longer ones. Each turn gets a rolling hash of
the conversation up to it; a conversation whose last hash stands inside another one is a prefix of it and is dropped by an
anti-join, so that only maximal conversations are rendered. Of equal conversations the one with the smallest id stays.

The rolling hash is a running exclusive-or of hashes that carry the place of the turn, in two lanes of 64 bits, over one
sorted pass by conversation; turns count by role and text. Last hashes are grouped and inner hashes made distinct before
the anti-join, so an opening turn or a whole conversation that very many logs share is one row on either side.

Defined results. Turns are ordered by number, then role and text; null numbers come first. A null role or text is an empty
one. Rows of a conversation that repeat (same number, role and text) are one turn. Each row with a null conv_id is
a conversation of its own, of one turn, whatever its number, so such rows need no group; equal ones count as copies, and where
no conversation with an id equals them they stand as one row with a null conv_id. An empty table gives an empty result; extra columns are not read. Marks of the template that stand in a text are
broken by a blank, so that no text can open or close a turn.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.llm.common import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
HASHES = ["h1", "h2", "n"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, role, text, h1, h2, last): the turns with the hash of the conversation up to each."""
    c = conversations
    given = c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), *[F.coalesce(c[x].cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    named, alone = given.where("conv_id IS NOT NULL"), given.where("conv_id IS NULL")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    here = F.struct("turn", "role", "text")
    # rows that repeat follow each other; the first of them counts
    once = named.withColumn("before", F.lag(here).over(order)).where(F.col("before").isNull() | ~here.eqNullSafe(F.col("before"))).drop("before")
    placed = once.withColumn("n", F.row_number().over(order).cast("long"))
    lane = lambda seed: F.xxhash64(F.lit(seed), "n", "role", F.lit(0), "text")
    so_far = lambda seed: F.bit_xor(lane(seed)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rolled = placed.select("conv_id", "n", "role", "text", so_far(1).alias("h1"), so_far(2).alias("h2"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    single = alone.withColumn("n", F.lit(1).cast("long")).select("conv_id", "n", "role", "text", lane(1).alias("h1"), lane(2).alias("h2"), F.lit(True).alias("last"))
    return rolled.unionByName(single)


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, h1, h2, n_turns, copies) of the conversations that prefix no longer one; the smallest id stands for equal ones."""
    whole = rolled.where("last").groupBy(*HASHES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = rolled.where("NOT last").select(*HASHES).distinct()
    return whole.join(inner, HASHES, "left_anti").select("conv_id", "h1", "h2", F.col("n").alias("n_turns"), "copies")


def render(role: Column, text: Column) -> Column:
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def format(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, text): the maximal conversations, rendered."""
    rolled = stage(turns(conversations), "chat-turns")
    kept = stage(maximal(rolled), "chat-kept")
    turn = F.struct("n", render(F.col("role"), F.col("text")).alias("t"))
    # the turns of one conversation are one text in the end
    named = (
        rolled.join(kept.where("conv_id IS NOT NULL").drop("h1", "h2"), "conv_id").groupBy("conv_id", "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(turn)).alias("ts"))
        .select("conv_id", "n_turns", "copies", F.array_join(F.transform("ts", lambda t: t["t"]), "").alias("text")))
    # a row without an id is found by its hashes, once for all equal rows
    alone = rolled.where("conv_id IS NULL").select("conv_id", "h1", "h2", "role", "text").distinct()
    single = alone.join(kept.where("conv_id IS NULL").drop("conv_id"), ["h1", "h2"]).select("conv_id", "n_turns", "copies", render(F.col("role"), F.col("text")).alias("text"))
    return named.unionByName(single)
