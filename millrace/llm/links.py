"""Linking near-duplicates: candidate pairs from shared keys in rounds, and connected components.

A bucket (the ids that share a key) never emits all its pairs. In each round a few pivots of every
bucket are compared with the members that are not yet in the pivot's component; what has been linked
is settled, and a bucket whose members are in one component, or have all been pivots, is done. What
is then still apart in a larger bucket is compared in cells: the members outside the bucket's largest
component meet all its members, block by block, inside tasks that emit links only. No candidate pair
between different components is left untested: the result is that of all pairs.

Scale: pivots are picked by a rank limit that Spark applies before the shuffle; buckets are joined
by key, where skewed keys are split at run time; a cell holds two blocks; every round's tables are
written to the shared folder. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.core import dropped, given_back, stored

#: Pivots of a bucket that have been compared after each round.
ROUNDS = (1, 4)
#: Members of a block of a cell, and for buckets of more than LARGE.
BLOCK, LARGE, LARGE_BLOCK = 128, 16_384, 1_024


#: Pairs of the cells that are tested together, about, and their members at most.
PAIRS, MEMBERS = 250_000, 8_192

#: test([(payloads, payloads, pairs to test as a matrix)]) gives which of those pairs are links, a matrix for each cell.
Test = Callable[[list[tuple[list, list, np.ndarray]]], list[np.ndarray]]


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (id, label): each node's smallest reachable node, by alternating stars."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "cc")
    sign = _sign(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        new = stored(small, "cc")
        dropped(e)
        e, before, sign = new, sign, _sign(new)
        if sign == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _sign(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def shared(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, id, ...) whose key is not theirs alone, as a stored table."""
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    return stored(keys.join(many, F.col("key") == F.col("k"), "left_semi"), "keys")


def link(live: DataFrame, near: Callable[[DataFrame], DataFrame], payload: DataFrame, test: Test) -> DataFrame | None:
    """shared(keys) -> (id, label) of the ids linked with a smaller one; None if there are none.

    near(pairs (a, b)) keeps the pairs that are links. test says the same of many pairs at once;
    payload (id, p) has what it needs of each id, and p.keys all keys of the id in one order. Consumes live.
    """
    labels = None
    done = 0
    for upto in (*ROUNDS, None):
        rows = live.withColumn("label", F.col("id")) if labels is None else live.join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        if labels is not None:
            split = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("apart")).where((F.col("n") > done + 1) & F.col("apart")).select("k")
            rows = stored(rows.join(split, F.col("key") == F.col("k"), "left_semi"), "open")
            dropped(live)
            if rows.isEmpty():
                break
            live = rows.select("key", "id")
            live._stored_at = rows._stored_at
        if upto is None:
            linked = stored(in_cells(rows, payload, test), "links")
        else:
            order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
            pivots = rows.withColumn("r", F.row_number().over(order)).where((F.col("r") <= upto) & (F.col("r") > done)).select(F.col("key").alias("k"), F.col("id").alias("p"), F.col("label").alias("pl"))
            pairs = rows.join(pivots, (F.col("key") == F.col("k")) & (F.col("label") != F.col("pl"))).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
            linked = stored(near(pairs), "links")
            done = upto
        edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if labels is not None:
            edges = edges.unionByName(labels.select(F.col("id").alias("u"), F.col("label").alias("v")))
        labels = components(edges)
        dropped(linked)
    return None if labels is None or labels.isEmpty() else labels


def shared_before(key: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each x and y (their keys in one order): whether they share a key before this one. Its bucket tests
    them: it was either small enough for the pivots or holds both in different components."""
    at = int(np.flatnonzero((x == key).any(axis=0))[0])
    out = np.zeros((len(x), len(y)), bool)
    for i in range(at):
        out |= x[:, i][:, None] == y[:, i][None, :]
    return out


def in_cells(rows: DataFrame, payload: DataFrame, test: Test) -> DataFrame:
    """Links (a, b) between different labels of ids that share a bucket: rows (key, id, label).

    Each bucket is compared on its own, its members outside its largest component against all of them,
    in cells of two blocks; a chain of buckets never grows into one larger group.
    """
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"))
    size = F.when(F.col("all") > LARGE, LARGE_BLOCK).otherwise(BLOCK)
    sizes = sizes.select("k", F.col("most.label").alias("main"), F.ceil(F.col("all") / size).cast("int").alias("nr"), F.ceil((F.col("all") - F.col("most.n")) / size).cast("int").alias("nl")).where("nl > 0")
    both = rows.join(sizes, F.col("key") == F.col("k")).join(payload, "id")
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = both.where("label != main").select("key", spot("nl").alias("l"), upto("nr").alias("r"), F.lit(0).alias("side"), "id", "label", F.lit(False).alias("mains"), "p")
    right = both.select("key", upto("nl").alias("l"), spot("nr").alias("r"), F.lit(1).alias("side"), "id", "label", (F.col("label") == F.col("main")).alias("mains"), "p")
    names = [f.name for f in payload.schema["p"].dataType.fields]

    def opened(f: pa.Table) -> tuple | None:
        """A cell's payloads, pairs to test, ids and labels of both sides; None without pairs."""
        side, ids, labels, mains = (f.column(c).to_numpy() for c in ("side", "id", "label", "mains"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        # of two members outside the largest component, both are on both sides: the smaller id's cell has the pair
        apart = (labels[x][:, None] != labels[y][None, :]) & (mains[y][None, :] | (ids[x][:, None] < ids[y][None, :]))
        if not apart.any():
            return None
        held = dict(zip(names, f.column("p").combine_chunks().flatten(), strict=True))
        keys = held.pop("keys").flatten().to_numpy().reshape(len(ids), -1)
        apart &= ~shared_before(f.column("key")[0].as_py(), keys[x], keys[y])
        x, y, apart = x[apart.any(axis=1)], y[apart.any(axis=0)], apart[np.ix_(apart.any(axis=1), apart.any(axis=0))]
        if not len(x):
            return None
        rows = pa.table(held)
        return (rows.take(pa.array(x)).to_pylist(), rows.take(pa.array(y)).to_pylist(), apart), ids[x], ids[y], labels[x], labels[y]

    def tested(cells: list[tuple]) -> pa.RecordBatch:
        out = [np.zeros((2, 0), np.int64)]
        for found, (_, p, q, lp, lq) in zip(test([c[0] for c in cells]), cells, strict=True):
            i, j = np.nonzero(found)
            # one link for each pair of components is enough
            _, first = np.unique(np.stack([np.minimum(lp[i], lq[j]), np.maximum(lp[i], lq[j])]), axis=1, return_index=True)
            out.append(np.stack([p[i[first]], q[j[first]]]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, pairs, members = [], 0, 0
        for f in runs(batches, ["key", "l", "r"]):
            if (c := opened(f)) is not None:
                pool.append(c)
                pairs, members = pairs + int(c[0][2].sum()), members + sum(c[0][2].shape)
            if pairs > PAIRS or members > MEMBERS:
                yield tested(pool)
                pool, pairs, members = [], 0, 0
        if pool:
            yield tested(pool)
        pool.clear()
        given_back()

    return left.unionByName(right).repartition("key", "l", "r").sortWithinPartitions("key", "l", "r").mapInArrow(work, "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, where rows are sorted by these columns of integers."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in by], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if at == to:
                continue
            now = tuple(keys[at])
            if held and now != before:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            before = now
    if held:
        yield pa.Table.from_batches(held)
