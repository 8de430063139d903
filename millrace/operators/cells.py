"""A stored vector index: k-means cells, files by shelves of cells and metadata, probes with bounds.

Centroids are trained in Spark on unit vectors, from about SAMPLE of them by a hash of the key; all vectors are
written, each onto the shelf of its nearest centroid and into the folder of its metadata, so that a probe opens the
shelves of its cells and what the filter allows, and no others. A shelf holds neighbouring cells of about SHELF vectors
in all, a larger cell has several. With each cell goes its radius, the widest angle between centroid
and member: no member is nearer to a query than the angle to the centroid less the radius. So a search can say which
cells beyond those probed could still hold one of the n best. exact=True probes these too, and gives what comparing
with all vectors gives; otherwise only queries that found fewer than n are taken further.

Scores are matrix products within tasks, for pairs of a query and a cell that it probes. Centroids, at most MOST_CELLS,
and up to MOST_BROADCAST queries are broadcast; more queries are dealt in blocks that meet the shelves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.nearest import Kinds, units
from millrace.operators.retrieve import MOST_BROADCAST, QUERY_BLOCK, metadata_matches, top, unit

#: Vectors that centroids are trained on, about, cells at most, rounds of training.
SAMPLE, MOST_CELLS, ROUNDS = 100_000, 4_096, 8
#: Vectors of a shelf, about.
SHELF = 32_768
#: Tasks that train.
TRAINERS = 32
#: Scores are compared after rounding; what could round up to the bound is probed.
SLACK = 2e-6
#: Vectors that meet the centroids at once.
AT_ONCE = 1_024


@dataclass(frozen=True)
class Cells:
    """vectors (key, vector at length one, cell, shelf, metadata), centroids (cell, centroid, radius, n, shelf, shelves)."""

    vectors: DataFrame
    centroids: DataFrame
    key: str
    by: list[str]


def _angle(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def _cosines(vectors: pa.Array, centroids: np.ndarray) -> np.ndarray:
    """Of each vector (at length one) its cosines with the centroids; one where it has none."""
    out = np.ones((len(vectors), len(centroids)))
    for width, (rows, x) in units(vectors, ready=True)[0].items():
        if len(centroids) and width == centroids.shape[1]:
            with np.errstate(all="ignore"):
                out[rows] = x @ centroids.T
    return np.clip(np.where(np.isnan(out), 1.0, out), -1.0, 1.0)


def _at_length_one(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """rows with vector in double precision at length one, as name; without those that have no direction."""
    rest = [c for c in rows.columns if c != vector]
    numbers = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    shape = T.StructType([*rows.select(rest).schema, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, (at, x) in units(batch.column(len(rest)))[0].items():
                ends = pa.array(np.arange(len(x) + 1) * width, pa.int32())
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*rest, name])

    return rows.select(*rest, numbers.alias(name)).mapInArrow(work, shape)


def _centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, centroids, radii) by cell, MOST_CELLS at most; no radii before they are known."""
    got = centroids.orderBy("cell").collect()
    radius = np.array([r["radius"] for r in got]) if "radius" in centroids.columns else np.zeros(0)
    return np.array([r["cell"] for r in got], np.int32), np.array([r["centroid"] for r in got]), radius


def nearest(rows: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """rows with cell and cos of their nearest centroid; ties go to the smaller cell."""
    sent = rows.sparkSession.sparkContext.broadcast(_centroids(centroids)[:2])
    at = rows.columns.index(vector)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = sent.value
        for batch in batches if len(cells) else ():
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                cos = _cosines(part.column(at), c)
                best = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[best]), pa.array(cos[np.arange(len(best)), best])], names=[*part.schema.names, "cell", "cos"])

    return rows.mapInArrow(work, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("cos", T.DoubleType())]))


def build(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding", by: tuple[str, ...] = ("method",), cells: int | None = None, seed: int = 42) -> Cells:
    """Trains, assigns and writes all vectors with a direction; by: metadata columns that folders are made of."""
    spark = vectors.sparkSession
    rows = _at_length_one(vectors.select(key, *by, vector), vector, "vector")
    rows.write.mode("overwrite").parquet(f"{path}/units")
    rows = spark.read.parquet(f"{path}/units")
    n = rows.count()
    k = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    sample = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)) < SAMPLE)
    sample = sample.repartition(TRAINERS, key).select(array_to_vector("vector").alias("features"))
    if k > 1:
        centres = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=ROUNDS).fit(sample).clusterCenters()
    else:
        centres = [rows.first()["vector"]] if n else []
    found = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    found = found.select("cell", unit(F.col("centroid")).alias("centroid")).where("centroid is not null")
    placed = nearest(rows, found, "vector")
    # shelves are numbered along the cells, of which a large one has several for itself
    sizes, shelves, here = sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect()), [], 0  # MOST_CELLS at most
    at = 0
    for cell, size in sizes:
        many = -(-size // SHELF)
        if here + size > SHELF and here:
            at, here = at + 1, 0
        shelves.append((cell, at, many))
        at, here = (at + many, 0) if many > 1 else (at, here + size)
    shelved = spark.createDataFrame(shelves, "cell int, first int, shelves int")
    shelf = (F.col("first") + F.pmod(F.xxhash64(key), F.col("shelves"))).cast("int").alias("shelf")
    dealt = placed.join(F.broadcast(shelved), "cell").select(*placed.columns, shelf)
    dealt.repartition("shelf").sortWithinPartitions("shelf", *by, "cell").write.mode("overwrite").partitionBy("shelf", *by).parquet(f"{path}/vectors")
    held = spark.read.schema(dealt.schema).parquet(f"{path}/vectors").groupBy(F.col("cell").alias("c")).agg(F.max(_angle(F.col("cos"))).alias("radius"), F.count("*").alias("n"))
    found.join(held, F.col("cell") == F.col("c")).join(shelved, "cell").select("cell", "centroid", "radius", "n", F.col("first").alias("shelf"), "shelves").write.mode("overwrite").parquet(f"{path}/centroids")
    return open_cells(spark, path, key, by)


def open_cells(spark: SparkSession, path: str, key: str = "chunk_id", by: tuple[str, ...] = ("method",)) -> Cells:
    shape = spark.read.parquet(f"{path}/units").schema.add("cell", "integer").add("cos", "double").add("shelf", "integer")
    return Cells(spark.read.schema(shape).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids"), key, list(by))


def probed(index: Cells, asked: DataFrame, query: str, where: dict[str, object] | None, match: dict[str, str], digits: int, n: int = 15) -> DataFrame:
    """(query, key, semantic_score) of what can be among a query's n best of the cells that it asks.

    asked: (query, _q, cell: one or an array, the columns that match names, perhaps _least: a score that n others reach).
    """
    spark = asked.sparkSession
    if not isinstance(asked.schema["cell"].dataType, T.ArrayType):
        asked = asked.withColumn("cell", F.array("cell"))
    kinds = {c: index.vectors.schema[c].dataType for c in match}
    named = lambda cols: F.xxhash64(*cols) if cols else F.lit(0).cast("long")
    least = F.col("_least") if "_least" in asked.columns else F.lit(None).cast("double")
    q = asked.dropna(subset=list(match.values())) if match else asked
    q = q.select(query, "_q", named([F.col(c).try_cast(kinds[m]) for m, c in match.items()]).alias("_k"), "cell", least.alias("_least"))
    opened = q.select(F.explode("cell").alias("cell")).distinct().join(F.broadcast(index.centroids), "cell")
    opened = opened.select(F.explode(F.sequence("shelf", F.col("shelf") + F.col("shelves") - 1)).alias("shelf")).distinct()
    members = index.vectors.where(F.col("shelf").isin([r["shelf"] for r in opened.collect()]))  # shelves are few: one for SHELF vectors or a cell
    if where:
        members = members.where(metadata_matches(where))
    x = (members.dropna(subset=list(match)) if match else members).select(index.key, "vector", named([F.col(c) for c in match]).alias("_k"), "cell", "shelf")
    names = [query, index.key, "_s"]
    shape = T.StructType([q.schema[query], x.schema[index.key], T.StructField("_s", T.DoubleType())])
    if q.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        sent = spark.sparkContext.broadcast(q.toArrow())  # MOST_BROADCAST vectors and their cells

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Kinds(sent.value, n, digits)
            for batch in batches:
                best.meet(batch)
            if best.held:
                yield from best.found(names).to_batches()

        scored = x.drop("shelf").mapInArrow(near, shape)
    else:
        blocks = -(-q.count() // QUERY_BLOCK)
        block = F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int").alias("_b")
        # a query goes to the shelves of its cells, with those cells
        of = F.broadcast(index.centroids.select(F.col("cell").alias("_cell"), F.sequence("shelf", F.col("shelf") + F.col("shelves") - 1).alias("_on")))
        at = q.select(query, F.explode("cell").alias("_cell")).join(of, "_cell").select(query, "_cell", F.explode("_on").alias("_shelf"))
        one = at.groupBy(query, "_shelf").agg(F.collect_list("_cell").alias("_cells")).join(q.drop("cell"), query)  # the cells of a shelf
        one = one.select(block, "_shelf", query, "_q", "_k", "_cells", "_least")
        two = x.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), "shelf", index.key, "vector", "_k", "cell")

        def cell(asks: pa.Table, have: pa.Table) -> pa.Table:
            best = Kinds(asks.select([2, 3, 4, 5, 6]), n, digits)
            for batch in have.select([2, 3, 4, 5]).to_batches():
                best.meet(batch)
            return best.found(names, have.schema.field(2).type)

        scored = one.groupBy("_b", "_shelf").cogroup(two.groupBy("_b", "shelf")).applyInArrow(cell, shape)
    return scored.select(query, index.key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s"))), digits).alias("semantic_score"))


def _reached(rows: DataFrame, index: Cells, probes: int, n: int, exact: bool) -> DataFrame:
    """rows (query, _q, and for a second round _n and _least) with an array cell: the nearest `probes`, or those beyond that it still needs."""
    sent = rows.sparkSession.sparkContext.broadcast(_centroids(index.centroids))
    later, at = "_n" in rows.columns, rows.columns.index("_q")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c, radius = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                angle = np.arccos(_cosines(part.column(at), c))
                order = np.argsort(angle, axis=1, kind="stable")[:, :probes]
                need = np.zeros(angle.shape, bool)
                np.put_along_axis(need, order, True, axis=1)
                if later:
                    found = part.column("_n").fill_null(0).to_numpy()
                    least = part.column("_least").fill_null(-1.0).to_numpy()
                    could = np.cos(np.maximum(0.0, angle - radius[None, :])) >= least[:, None] - SLACK
                    need = ~need & ((found < n)[:, None] | (could if exact else False))
                row, cell = np.nonzero(need)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(need)))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[cell]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "cell"])

    return rows.mapInArrow(work, T.StructType([*rows.schema, T.StructField("cell", T.ArrayType(T.IntegerType()))])).where(F.size("cell") > 0)


def search(index: Cells, queries: DataFrame, n: int = 15, probes: int = 4, query: str = "query_id", query_vector: str = "embedding", where: dict[str, object] | None = None, match: dict[str, str] | None = None, exact: bool = False, digits: int = 6, keep=lambda df: df) -> DataFrame:
    """(query, key, semantic_score, rank): each query's n best by max(0, cosine) among the vectors that meet the filter.

    where: metadata that all results must have; match: {metadata column: column of queries that it must equal}.
    keep stores a frame that is read more than once.
    """
    match = match or {}
    q = _at_length_one(queries.select(query, *dict.fromkeys(match.values()), query_vector), query_vector, "_q")
    first = keep(_reached(q, index, probes, n, exact))
    got = keep(top(probed(index, first, query, where, match, digits, n), [query], "semantic_score", index.key, n))
    reached = got.groupBy(query).agg(F.count("*").alias("_n"), F.min("semantic_score").alias("_least"))
    more = keep(_reached(first.drop("cell").join(reached, query, "left"), index, probes, n, exact))
    more = more.withColumn("_least", F.when(F.col("_n") >= n, F.col("_least")))
    rest = probed(index, more, query, where, match, digits, n)
    return top(got.drop("rank").unionByName(rest), [query], "semantic_score", index.key, n)


def probes_for(index: Cells, queries: DataFrame, n: int, least: float = 0.95, query: str = "query_id", keep=lambda df: df) -> int:
    """The fewest probes, doubling from one, that find a share `least` of these queries' n best."""
    want = keep(search(index, queries, n, query=query, exact=True, keep=keep).select(query, index.key))
    total, probes, cells = want.count(), 1, index.centroids.count()
    while probes < cells:
        got = search(index, queries, n, probes, query, keep=keep).join(want, [query, index.key], "left_semi").count()
        if got >= least * total:
            return probes
        probes *= 2
    return max(1, cells)
