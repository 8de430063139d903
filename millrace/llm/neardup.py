"""Near-duplicate documents by b-bit MinHash.

A document is the set of its 5-word shingles. MINIMA minima are kept two ways: hashed by bands of
ROWS, whose equality makes two documents candidates, and as their low BITS bits, packed into longs.
A candidate's similarity is estimated from equal groups of bits, corrected for the groups that are
equal by chance; estimates well below the threshold end there, and the rest are confirmed on the
full shingle sets. Documents with equal sets are one class before any of that.

At the threshold 0.85 a pair shares no band with probability (1 - 0.85^5)^25 < 1e-6; the estimate
has a standard deviation below 0.04 there, and MARGIN is six of them.

Scale: text is read twice, once for signatures and once, for candidates only, for sets. Groups of
equal sets fold in a map-side combined aggregate; buckets go through links.link; sets travel once a
round to each side of a pair. Nothing is broadcast.

Defined results: a null, empty or blank text has no shingles and links with nothing; rows that share
a doc_id are one document, which links with whatever one of them links with; a null doc_id is never linked, its component is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.core import Words, column_bytes, given_back, mix, shingles, slices, stored
from millrace.llm.links import components, link, shared

SHINGLE = 5
ROWS, BANDS = 5, 25
MINIMA = 128  # the first ROWS * BANDS make the bands, all make the signature
BITS = 2
MARGIN = 0.22

_seeds = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _seeds[:MINIMA], _seeds[MINIMA:] | np.uint64(1)
_BAND_A = np.uint64(0xD1342543DE82EF95)


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets."""
    h, at = shingles(Words(data, off), k)
    each = [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    size = np.array([len(x) for x in each], np.int64)
    return (np.concatenate(each) if each else h), np.concatenate([[0], np.cumsum(size)])


def signature(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: band keys (n, BANDS), packed low bits (n, MINIMA * BITS / 64), fingerprints (n, 2)."""
    starts, n = off[:-1], len(off) - 1
    band = np.zeros((n, BANDS), np.uint64)
    low = np.zeros((n, MINIMA), np.uint64)
    for k in range(MINIMA):
        least = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], starts)
        low[:, k] = least & np.uint64((1 << BITS) - 1)
        if k < ROWS * BANDS:
            band[:, k // ROWS] = band[:, k // ROWS] * _BAND_A + mix(least)
    band = mix(band + np.arange(BANDS, dtype=np.uint64) * _MUL[0])
    per = 64 // BITS
    shift = (np.arange(MINIMA, dtype=np.uint64) % np.uint64(per)) * np.uint64(BITS)
    packed = np.bitwise_or.reduce((low << shift).reshape(n, MINIMA // per, per), axis=2)
    marks = np.stack([np.add.reduceat(mix(h ^ _XOR[0]), starts), np.add.reduceat(mix(h ^ _XOR[1]), starts)], axis=1)
    return band, packed, marks


def signatures(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    shape = "id long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            h, at = sets_of(data, off, k)
            size = np.diff(at)
            some = np.flatnonzero(size)
            band, packed, marks = np.zeros((len(size), BANDS), np.uint64), np.zeros((len(size), MINIMA * BITS // 64), np.uint64), np.zeros((len(size), 2), np.uint64)
            if len(some):
                band[some], packed[some], marks[some] = signature(h, np.append(at[:-1][some], at[-1]))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)), lists(packed), lists(band)], names=["id", "n_shingles", "f1", "f2", "sig", "bands"])
        given_back()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(work, shape)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (id, text) -> (id, items binary): sorted distinct shingle hashes, eight bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            h, at = sets_of(data, off, k)
            raw = h.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "items"])
        given_back()

    return docs.select("id", "text").mapInArrow(work, "id long, items binary")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, x binary, y binary) the (a, b) whose sets have Jaccard similarity of percent / 100 or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xd, xo), (yd, yo) = column_bytes(batch.column(2)), column_bytes(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = xd[xo[i] : xo[i + 1]].view("<u8"), yd[yo[i] : yo[i + 1]].view("<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
        given_back()

    return pairs.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


#: Columns of a membership matrix that are held at once.
COLUMNS = 4_096


def all_pairs(xs: list[dict], ys: list[dict], apart: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs `apart` of xs and ys (items, sig) have Jaccard similarity of percent / 100 or more.

    Pairs that sizes or estimates rule out are not tested. The rest get exact intersection sizes: of few pairs one by one, of many from
    products of membership matrices over the items that both sides hold.
    """
    sizes = [np.array([len(v["items"]) // 8 for v in side]) for side in (xs, ys)]
    test = apart & (100 * np.minimum.outer(*sizes) >= percent * np.maximum.outer(*sizes))
    sig = [np.stack([np.asarray(v["sig"], np.int64).view(np.uint64) for v in side]) for side in (xs, ys)]
    test &= estimates(*sig) >= percent / 100 - MARGIN
    if not test.any():
        return test
    sets = [[np.frombuffer(v["items"], "<u8") for v in side] for side in (xs, ys)]
    where = np.argwhere(test)
    if len(where) <= 4 * (len(xs) + len(ys)):
        for i, j in where:
            common = len(np.intersect1d(sets[0][i], sets[1][j], assume_unique=True))
            test[i, j] = 100 * common >= percent * (sizes[0][i] + sizes[1][j] - common)
        return test
    held = [np.unique(np.concatenate(side)) for side in sets]
    common = np.intersect1d(*held, assume_unique=True)
    both = np.zeros((len(xs), len(ys)))
    owner = [np.repeat(np.arange(len(side)), n) for side, n in zip(sets, sizes, strict=True)]
    items = [np.concatenate(side) for side in sets]
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        m = []
        for o, x, n in zip(owner, items, sizes, strict=True):
            inside = (x >= part[0]) & (x <= part[-1])
            place = np.searchsorted(part, x[inside])
            real = part[place] == x[inside]
            matrix = np.zeros((len(n), len(part)), np.float32)
            matrix[o[inside][real], place[real]] = 1
            m.append(matrix)
        both += m[0] @ m[1].T
    return test & (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of each packed signature of x with each of y."""
    ones = np.uint64((1 << 64) // ((1 << BITS) - 1)) if BITS > 1 else ~np.uint64(0)
    equal = np.full((len(x), len(y)), MINIMA, np.int64)
    for i in range(x.shape[1]):
        d = x[:, i][:, None] ^ y[:, i][None, :]
        for s in range(1, BITS):
            d = d | (d >> np.uint64(s))
        equal -= np.bitwise_count(d & ones).astype(np.int64)
    return (equal / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def equal_groups(x: str, y: str) -> Column:
    """How many of the MINIMA groups of BITS bits are equal."""
    ones = (1 << 64) // ((1 << BITS) - 1) if BITS > 1 else (1 << 64) - 1
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    n = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        d = F.get(F.col(x), F.lit(i)).bitwiseXOR(F.get(F.col(y), F.lit(i)))
        for s in range(1, BITS):
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        n = n + F.bit_count(d.bitwiseAND(F.lit(ones)))
    return F.lit(MINIMA) - n


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: (doc_id, n_shingles, component_id, kept)."""
    known = stored(signatures(docs, text, key, k), "minhash")
    classes = known.where("n_shingles > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    member = known.select("id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left").select("id", "n_shingles", "f1", "f2", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("rep")).alias("rep"))
    member = stored(member, "members")
    # an id whose rows have several sets stands for each set that it is the first to have
    own = member.where("id = rep").select(F.col("id").alias("i"), F.col("n_shingles").alias("n"), F.col("f1").alias("g1"), F.col("f2").alias("g2")).distinct()
    reps = known.join(own, (F.col("id") == F.col("i")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left_semi")
    reps = stored(reps.dropDuplicates(["id", "f1", "f2"]).select("id", "n_shingles", "sig", "bands"), "reps")
    keys = reps.select(F.explode("bands").alias("key"), "id").distinct()
    live = shared(keys)
    candidates = live.select("id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(candidates, "id", "left_semi")
    items = stored(shingle_sets(texts, k), "sets")
    sizes = reps.select(F.col("id"), "n_shingles", "sig")

    def near(pairs: DataFrame) -> DataFrame:
        one = sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
        two = sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
        by_chance = 2.0**-BITS
        likely = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        estimate = (equal_groups("sa", "sb") / MINIMA - by_chance) / (1 - by_chance)
        likely = likely.where(estimate >= percent / 100 - MARGIN).select("a", "b")
        with_b = likely.join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        return confirmed(with_b.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a"), percent)

    payload = items.join(reps.select("id", "sig", F.col("bands").alias("keys")), "id").select("id", F.struct("items", "sig", "keys").alias("p"))
    labels = link(live, near, payload, lambda cells: [all_pairs(*c, percent) for c in cells])
    several = member.where("rep is not null").groupBy("id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    ties = stored(several.select(F.explode("reps").alias("u"), F.array_min("reps").alias("v")).where("u > v"), "ties")
    if not ties.isEmpty():
        labels = components(ties if labels is None else ties.unionByName(labels.select(F.col("id").alias("u"), F.col("label").alias("v"))))
    out = member.withColumn("component_id", F.coalesce("rep", "id"))
    if labels is not None:
        out = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
