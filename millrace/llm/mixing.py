"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due `target / source size` copies on average. The whole part is
allocated with certainty; for the rest, documents are ranked by random odds divided by inclusion
odds, and the ranking is taken from its start while the words fit into what the target leaves.
A document that does not fit is passed over, and up to PASSES such rounds fill the gap, so that a
source misses its target by less than its smallest remaining document, or nearly so.

Scale: text is read once, for its size. The prefix of a ranking is found without sorting a source
in one task: sums by BUCKETS slices of the ranking give the slice in which the target is met, and
only that slice's documents are ordered. Everything else is a map-side combined sum.

Defined results: a null or empty text has size 0 and is never taken; a null source is one source,
ranked last; an empty table gives an empty one; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.core import WORD, fresh, stored

BUCKETS = 1 << 16
PASSES = 4
#: Tasks over which the rows of one source are dealt in a join with its row.
SALTS = 64
MOST_COPIES = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of an MD5, so that any SQL engine gives the same."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size -> with target: weights 1, 2, 3, repeating in code-point order, null last.

    Weighted shares of all words, stopped at `most` times a source's size; what is over goes to the
    others by weight until none is above. That ends at min(cap, level * weight) for one level, which
    sums over sources ordered by cap / weight give at once. One row a source, no documents.
    """
    ranked = sizes.withColumn("weight", (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("long"))
    cap = F.col("source_size") * most
    by_room = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", cap)
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")), "level"))).over(everything)["level"])
    )
    return levels.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), F.coalesce("at", F.lit(0.0)) * F.col("weight"))).alias("target"))


def by_source(left: DataFrame, right: DataFrame, how: str = "inner", also: Column | None = None, salt: str | None = None) -> DataFrame:
    """Joins on source, where null equals null. With salt (a column of left), a source's rows of left
    are dealt over SALTS tasks and each row of right is copied to all of them."""
    on = F.col("source").eqNullSafe(F.col("_s"))
    right = right.withColumnRenamed("source", "_s")
    if salt:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
        right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("_salt") == F.col("_deal"))
    return left.join(right, on if also is None else on & also, how).drop("_s", "_salt", "_deal")


def prefix(pool: DataFrame, room: DataFrame) -> DataFrame:
    """Of pool (source, v, id, size): each source's longest start by (v, id) whose sizes sum to at most its room."""
    pool = pool.withColumn("slot", F.floor(F.col("v") * BUCKETS).cast("int"))
    run = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = pool.groupBy("source", "slot").agg(F.sum("size").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(run), F.lit(0)))
    slots = by_source(slots, room).where("before <= room").select("source", F.col("slot").alias("_slot"), "before", "room", (F.col("before") + F.col("here") <= F.col("room")).alias("whole"))
    got = by_source(pool, slots, also=F.col("slot") == F.col("_slot"))
    inside = got.where(~F.col("whole")).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source", "slot").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)))
    return got.where("whole").select("source", "id", "size").unionByName(inside.where("upto <= room").select("source", "id", "size"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix", weight: Column | None = None, most: int = MOST_COPIES) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, copies, id, nth), one for each document.

    id is a hash of doc_id and text, nth numbers the rows that share it.

    weight: a document's relative due within its source (all alike by default); a document is due
    at most `most` copies whatever its weight.
    """
    base = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"),
        F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0)).cast("double").alias("w"),
        row_id(key, text).alias("id"),
    )
    base = stored(base, "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("w") * F.col("size")).alias("weighed"))
    sizes = stored(sizes, "mix-sizes")
    goal = stored(by_source(targets(sizes), sizes.select("source", "weighed")), "mix-targets")
    due = (
        by_source(base, goal, salt="id")
        .withColumn("due", F.when(F.col("weighed") > 0, F.least(F.lit(float(most)), F.col("target") * F.col("w") / F.col("weighed"))).otherwise(0.0))
        .withColumn("whole", F.floor("due").cast("long")).withColumn("part", F.col("due") - F.col("whole"))
        .withColumn("u", uniform(F.col("doc_id"), seed))
        .withColumn("odds", F.when(F.col("part") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))))
        .withColumn("v", F.col("odds") / (1 + F.col("odds")))
    )
    due = stored(due, "mix-due")
    room = due.groupBy("source").agg(F.floor(F.first("target")).cast("long").alias("goal"), F.sum(F.col("whole") * F.col("size")).alias("sure")).select("source", (F.col("goal") - F.col("sure")).alias("room"))
    room = stored(room, "mix-room")
    pool = due.where((F.col("size") > 0) & (F.col("part") > 0)).select("source", "v", "id", "size")
    taken = None
    for _ in range(PASSES):
        left, open_ = room, pool
        if taken is not None:
            left = by_source(room, taken.groupBy("source").agg(F.sum("size").alias("used")), "left").select("source", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
            open_ = pool.join(taken.select("id"), "id", "left_anti")
        open_ = by_source(open_, left, also=F.col("size") <= F.col("room"), salt="id").select("source", "v", "id", "size")
        more = prefix(open_, left)
        taken = stored(more if taken is None else taken.unionByName(more), "mix-taken")
    chosen = taken.groupBy("id").agg(F.count("*").alias("times"))
    order = Window.partitionBy("id").orderBy("doc_id")
    return (
        due.join(chosen, "id", "left").withColumn("nth", F.row_number().over(order)).withColumn("copies", F.col("whole") + (F.col("nth") <= F.coalesce("times", F.lit(0))).cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "copies", "id", "nth")
    )


def row_id(key: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit("-"))))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """The mix itself: docs, each row as often as it is taken; columns as they were, whatever their names."""
    i, n, id_, nth, copies, x = fresh(docs, "_i", "_n", "_id", "_nth", "_copies", "_x")
    times = mix(docs, text, source, key, seed).where("copies > 0").select(F.col("id").alias(id_), F.col("nth").alias(nth), F.col("copies").alias(copies))
    numbered = docs.withColumn(i, row_id(key, text)).withColumn(n, F.row_number().over(Window.partitionBy(i).orderBy(i)))
    both = numbered.join(times, (F.col(i) == F.col(id_)) & (F.col(n) == F.col(nth)))
    return both.withColumn(x, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")
