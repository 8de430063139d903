"""Approximate nearest neighbours by collision counting (query-aware hashing).

Largest inner product becomes least distance by one more coordinate, sqrt(M^2 - |x|^2), with M the
longest vector; a query's is 0. Each block of vectors is projected on PROJECTIONS random lines and
sorted along each: the index. A query's window on a line is centred on its own projection, and
virtual rehashing widens it step by step over the same sorted arrays; a vector that lies within
THRESHOLD of the windows has collided often enough and is a candidate. When a block has at least
WANTED candidates (or has given all), they are verified by the inner product itself, in double
precision, and each query keeps its best.

Scale: the projections and M come from one small aggregate; vectors are blocked by a hash of id and vector, queries
likewise into groups that bound what a task holds, and each group meets each block, the stated query
set against all rows, in blocks. A block gives at most k rows for a query. There is no cap on
collisions: ties and copies in the last window are all verified.

Recall, measured against brute force: see the README. Defined results: vectors that are null or
zero, that hold null or non-finite components, or whose length is not the commonest one take no part; rows that share
an id are separate candidates, none of them the query's own; an empty table gives no rows. Any finite component
will do: a product beyond the range of doubles scores infinite, by its sign.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROJECTIONS = 80
THRESHOLD = 0.65
#: First half-width of a window, as a share of the block's spread along a line, and how it widens.
FIRST, WIDER = 0.25, 1.12
#: Candidates wanted of a block: k, LEAST and this share of its vectors.
WANTED, LEAST = 0.20, 100
BLOCK = 8_192
#: Queries that are counted at once, so that the counters stay in a core's cache.
TOGETHER = 16
QUERY_GROUP = 2_048
#: Powers of two beyond which squares of components leave the range of doubles.
EXTREME = 300


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, longest: float, k: int, seed: int, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, score): each query's best k among the candidates of this block.

    Places are taken of vectors by scale (then longest is as well), and of queries by a power of two of their own, so that no square is out of range.
    """
    n, dim = x.shape
    whole, asked = x, q
    x, q = x / scale, q / np.exp2(np.floor(np.log2(np.abs(q).max(axis=1))))[:, None]
    lines = np.random.default_rng(seed).normal(size=(PROJECTIONS, dim + 1))
    room = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
    place = lines[:, :dim] @ x.T + lines[:, dim:] * room
    order = np.argsort(place, axis=1)
    sorted_ = np.take_along_axis(place, order, axis=1)
    # the inner product's order does not change with a query's length, so queries are stretched to M
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    centre = lines[:, :dim] @ (q * (longest / norm)[:, None]).T
    rank = np.empty(place.shape, np.uint16 if n < 1 << 16 else np.uint32)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n, dtype=rank.dtype), place.shape), axis=1)
    need, least = min(n, int(k + LEAST + WANTED * n)), int(np.ceil(THRESHOLD * PROJECTIONS))
    half = FIRST * max(float(place.std(axis=1).mean()), 1e-12)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    probes = np.arange(min(len(q), 8))
    rest = np.arange(len(probes), len(q))
    left = probes
    while len(left):
        # each query's window on each line, as places in the line's sorted array
        low = np.stack([np.searchsorted(sorted_[i], centre[i, left] - half, "left") for i in range(PROJECTIONS)])
        high = np.stack([np.searchsorted(sorted_[i], centre[i, left] + half, "right") for i in range(PROJECTIONS)])
        more = []
        for at in range(0, len(left), TOGETHER):
            js = left[at : at + TOGETHER]
            first, wide = low[:, at : at + TOGETHER], high[:, at : at + TOGETHER] - low[:, at : at + TOGETHER]
            hits = np.zeros((len(js), n), np.uint8)
            for i in range(PROJECTIONS):  # below the window's start the difference wraps to a large number
                hits += rank[i][None, :] - first[i].astype(rank.dtype)[:, None] < wide[i].astype(rank.dtype)[:, None]
            collided = hits >= least
            enough = (collided.sum(axis=1) >= need) | (wide.min(axis=0) == n)
            more.append(js[~enough])
            for r in np.flatnonzero(enough):
                j = js[r]
                found = np.flatnonzero(collided[r])
                found = found[ids[found] != qids[j]]
                s = x[found] @ q[j]
                if len(found) > k:  # those that may be among the best, whatever the rounding
                    found = found[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * max(1.0, float(np.abs(s).max()))]
                with np.errstate(over="ignore", invalid="ignore"):
                    s = (whole[found] * asked[j]).sum(axis=1)
                near = (x[found] * q[j]).sum(axis=1)
                s = np.where(np.isnan(s), np.where(near == 0, 0.0, np.copysign(np.inf, near)), s)
                best = np.lexsort((ids[found], -near if not np.isfinite(s).all() else -s))[:k]
                out.append((np.full(len(best), j), found[best], s[best]))
        left = np.concatenate(more)
        if len(rest) and len(left) <= len(probes) // 2:  # the width that served most probes is where the others start
            left, rest = np.concatenate([left, rest]), rest[:0]
        else:
            half *= WIDER
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product, ties to the smaller id."""
    v = F.col(vector).cast("array<double>")
    good = vectors.where(F.col(key).isNotNull() & usable(v)).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    facts = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.sum(F.col("is_query").cast("long")).alias("q")).orderBy(F.desc("n"), "dim").first()
    shape = "query_id long, vec_id long, score double"
    if facts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("v") == facts["dim"])
    longest, scale = float(np.sqrt(facts["m"])), 1.0
    power = int(np.floor(np.log2(facts["most"])))
    if abs(power) > EXTREME:
        scale = 2.0**power
        longest = float(np.sqrt(good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))).first()[0]))
    blocks, groups = -(-facts["n"] // BLOCK), max(1, -(-facts["q"] // QUERY_GROUP))
    rows = good.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    asked = good.where("is_query").withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(groups)).cast("int"))
    # every block meets every group of queries: the block is copied for each group, the queries for each block
    left = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("block", "part", "id", "v")
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", "part", "id", "v")

    def work(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = x.sort_values("id", kind="stable"), q.sort_values("id", kind="stable")
        ids, qids = x["id"].to_numpy(), q["id"].to_numpy()
        who, what, score = search_block(ids, np.stack(x["v"].to_numpy()), qids, np.stack(q["v"].to_numpy()), longest, k, seed, scale)
        return pd.DataFrame({"query_id": qids[who], "vec_id": ids[what], "score": score})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(work, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
