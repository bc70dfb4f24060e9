"""Nearest neighbours without a pair list: blocks of rows meet in pairs and only the nearest leave each meeting."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inswing.functions.columns import ranked
from inswing.operators.evidence import COUNTED_IN_OUTS, DIM_MIN, OUTS_MIN, PEER_MIN, batting_dimensions, bowling_dimensions
from inswing.plans.workspace import Workspace

BLOCK = 4096


def nearest(queries: DataFrame, items: DataFrame, k: int, weights: list[float] | None = None, rms: bool = False, min_shared: int = 1, block: int = BLOCK) -> DataFrame:
    """Exact k nearest items (pool, id, vec) of every query in its pool, by (weighted) Euclidean or by RMS distance over shared places.

    Each pool is cut into blocks of about `block` rows. A task sees one block of queries and one of items, whatever the
    size of the pool, and returns k rows per query; the same id is never its own neighbour.
    """
    size = items.groupBy("pool").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("parts")).unionByName(
        queries.groupBy("pool").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("parts"))).groupBy("pool").agg(F.max("parts").alias("parts"))

    def cut(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        return df.select("pool", "id", "vec").join(size, "pool").select(
            F.col("pool").alias(f"{side}_pool"), F.col("id").alias(f"{side}_id"), F.col("vec").alias(f"{side}_vec"), part.alias(own),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(other))

    w = None if weights is None else np.asarray(weights)

    def candidates(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of a, row of b) that hold the k nearest of every row: squared distances by matrix products, and all within their rounding error of the kth."""
        seen_a, seen_b = ~np.isnan(a), ~np.isnan(b)
        shared = seen_a.astype(float) @ seen_b.T.astype(float)
        out = own | (shared < min_shared)
        scale = np.ones(a.shape[1]) if w is None else w
        za, zb = np.where(seen_a, a, 0.0), np.where(seen_b, b, 0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            near = (za * za * scale) @ seen_b.T + seen_a @ (zb * zb * scale).T - 2 * (za * scale) @ zb.T
            error = 1e-9 * ((za * za * np.abs(scale)).sum(1)[:, None] + (zb * zb * np.abs(scale)).sum(1).max())
        if not np.isfinite(near).all() or b.shape[0] <= k:
            return np.nonzero(~out)
        if rms:
            near = near / np.maximum(shared, 1)
        near[out] = np.inf
        kth = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
        return np.nonzero((near <= kth + error) & ~out)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"pool": [], "id": [], "other": [], "distance": []})
        a, b = (np.array([np.asarray(v, dtype=float) for v in side]) for side in (left["q_vec"], right["i_vec"]))
        ids, others = left["q_id"].to_numpy(), right["i_id"].to_numpy()
        code, _ = pd.factorize(np.concatenate([ids, others]))
        own = code[: len(ids), None] == code[None, len(ids):]
        rows, cols = candidates(a, b, own)
        total, shared = np.zeros(len(rows)), np.zeros(len(rows))
        for j in range(a.shape[1]):
            d = a[rows, j] - b[cols, j]
            ok = ~np.isnan(d)
            total += np.where(ok, d * d * (1.0 if w is None else w[j]), 0.0)
            shared += ok
        dist = np.sqrt(total / np.maximum(shared, 1)) if rms else np.sqrt(total)
        rank_of = np.argsort(np.argsort(others.astype(str), kind="stable"), kind="stable")
        order = np.lexsort((rank_of[cols], dist, rows))
        order = order[np.isfinite(dist[order])]
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        near = order[place < k]
        return pd.DataFrame({"pool": left["q_pool"].iloc[0], "id": ids[rows[near]], "other": others[cols[near]], "distance": dist[near]})

    left, right = cut(queries, "q", "qb", "ib"), cut(items, "i", "ib", "qb")
    pairs = left.groupBy("q_pool", "qb", "ib").cogroup(right.groupBy("i_pool", "qb", "ib")).applyInPandas(
        meet, "pool string, id string, other string, distance double")
    return ranked(pairs, ["pool", "id"], [F.asc("distance"), F.asc("other")], k)


def player_vectors(ws: Workspace, role: str, peer_min: dict[str, int] | None = None, dim_min: dict[str, int] | None = None, outs_min: int = OUTS_MIN, min_values: int = 20,
                   min_shared: int = 8) -> DataFrame:
    """Standardised dimensions of the players of a pool, small samples pulled to the pool mean; long form with a vector id per pool."""
    pm, dm = peer_min or PEER_MIN[role], dim_min or DIM_MIN[role]
    rows = ws.stage(batting_dimensions(ws) if role == "batting" else bowling_dimensions(ws), f"vec_{role}")
    t20 = F.col("format_group") == "T20"
    floor = F.when(F.col("dimension").isin(*COUNTED_IN_OUTS), outs_min).when(t20, dm["T20"]).otherwise(dm["ODI"])
    rows = rows.filter(~F.col("dimension").isin("bowler_conc", "route_conc")).withColumn("least", floor).filter(
        (F.col("balls") >= F.when(t20, pm["T20"]).otherwise(pm["ODI"])) & F.col("value").isNotNull() & (F.col("n") >= F.col("least")))
    pool = ["gender", "format_group"]
    stat = rows.groupBy(*pool, "dimension").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count("*").alias("k")).filter(F.col("k") >= min_values)
    z = rows.join(stat, [*pool, "dimension"])
    shrunk = (F.col("value") * F.col("n") + F.col("mu") * F.col("least")) / (F.col("n") + F.col("least"))
    z = z.withColumn("z", (shrunk - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    enough = z.groupBy(*pool, "pid").agg(F.count("*").alias("dims")).filter(F.col("dims") >= min_shared)
    return z.join(enough, [*pool, "pid"]).select(*pool, "pid", "dimension", "z", "dims")


def as_vectors(long: DataFrame, dims: list[str]) -> DataFrame:
    m = long.groupBy("gender", "format_group", "pid").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "z"))).alias("m"))
    return m.select(F.concat_ws("|", "format_group", "gender").alias("pool"), F.col("pid").alias("id"), F.array(*[F.col("m")[d] for d in dims]).alias("vec"))


SIM_WEIGHTS = [1.0, 1.0, 1.0, 0.4, 0.5, 0.5, 0.6]
K_SHRINK = 60


def battle_vectors(ws: Workspace, min_balls: int = 60) -> DataFrame:
    """Battles as standardised features: rates against both players' usual, size, phases and formats."""
    c = F.col
    tiny = lambda x: F.when(F.coalesce(x, F.lit(0.0)) == 0, 1e-6).otherwise(x)
    br, bo, wr = tiny(c("batter_rpb")), tiny(c("batter_out_rate")), tiny(c("bowler_rpb"))
    rows = ws["battles"].filter(c("balls") >= min_balls).withColumns({
        "rpb": (c("runs") + K_SHRINK * br) / (c("balls") + K_SHRINK), "out": (c("outs") + K_SHRINK * bo) / (c("balls") + K_SHRINK)})
    rows = rows.withColumns({"f0": F.ln(c("rpb") / br), "f1": F.ln(c("rpb") / wr), "f2": F.ln(c("out") / bo), "f3": F.ln("balls"), "f4": c("pp_share"), "f5": c("death_share"), "f6": c("t20_share")})
    stat = rows.groupBy("gender").agg(*[F.avg(f"f{j}").alias(f"mu{j}") for j in range(7)], *[F.stddev_pop(f"f{j}").alias(f"sd{j}") for j in range(7)])
    z = [(c(f"f{j}") - c(f"mu{j}")) / F.when(c(f"sd{j}") > 0, c(f"sd{j}")).otherwise(1.0) for j in range(7)]
    return rows.join(stat, "gender").select(c("gender").alias("pool"), F.concat_ws("|", "batter_id", "bowler_id").alias("id"), F.array(*z).alias("vec"))
