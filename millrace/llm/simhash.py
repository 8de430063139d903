"""Near-duplicate documents by SimHash, linked through a generalised pigeonhole index.

A document's fingerprint has a bit set where over half of its 4-word shingles' hashes have it. Documents
whose fingerprints differ in at most WITHIN bits are linked; components of links are the groups.

The 64 bits are grouped into parts, bits that go together (by their correlation over all fingerprints)
into one part. Each fingerprint has thresholds t of its own, one for each part, with the sum of t + 1
equal to WITHIN + 1: were two fingerprints within WITHIN bits further apart than t in every part, their
bits would add up to more. So it probes, in each part, all values within t bits of its own (none for
t = -1), and whoever holds one of them is verified on all 64 bits. The thresholds are the cheapest by
dynamic programming over probes and estimated candidates, which are counted from histograms of all
fingerprints' parts (of two halves taken as independent, where a part is wider than PIECE bits).

Scale: equal fingerprints fold first in a map-side combined aggregate. The number of parts follows from
the number of fingerprints, so that probes and candidates of each grow slowly. A large group of near
copies fills buckets in every part: there a pivot of each bucket is compared with its members in ROUNDS
rounds, and what a bucket's largest component holds is never compared with itself. What comes to the
driver is a matrix of 64 x 64 counts and the histograms (64 / PIECE to 6 of them, of 2 ** PIECE numbers).

Defined results: a text without a word (null, empty, blank) has fingerprint zero and is linked like any
other; rows that share a doc_id are one document, which is linked with whatever one of them is linked
with; a row whose doc_id is null is linked with nothing and has no component; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.core import Words, slices, stored
from millrace.llm.links import components

SHINGLE, SEED = 4, 42
WITHIN = 4
#: Bits of a value that histograms count one by one, and the widest threshold of a part.
PIECE, WIDEST = 16, 3
#: What a probe costs, in candidates compared.
PROBE = 20.0
#: Members of a bucket that pivots are tried on, and how often.
MANY, ROUNDS = 16, 3
#: Fingerprints, and probes, that a worker holds at once.
BATCH, HELD = 32_768, 1 << 20
#: A key is a part's number above PLACE bits and the part's value below.
PLACE = 48


def shingle_hashes(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every text's k-word shingles, the words joined by a blank, and how many each text has; fewer words are one."""
    import xxhash

    size = w.end - w.start + 1
    at = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at + size - 1] = False
    joined[inside] = w.data[np.repeat(w.start - at, size)[inside] + np.flatnonzero(inside)]
    many = np.maximum(w.count - k + 1, (w.count > 0).astype(np.int64))
    begin = np.repeat(w.first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(begin + k, np.repeat(w.first[1:], many)) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], SEED) for a, b in zip(at[begin].tolist(), (at + size - 1)[last].tolist(), strict=True)], np.uint64), many


_LANE = np.uint64(0x0001000100010001)
#: Hashes that 16-bit counters, four to a number, can count.
COUNTED = 60_000


def majority(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each run of hashes: the bits that over half of them have; no hash gives zero."""
    out = np.zeros(len(many), np.uint64)
    full = np.flatnonzero(many)
    if not len(full):
        return out
    size = many[full]
    pieces = -(-size // COUNTED)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(np.cumsum(size) - size, pieces) + (np.arange(pieces.sum()) - np.repeat(first, pieces)) * COUNTED
    marks = np.zeros(len(full), np.uint64)
    for lane in range(16):
        sums = np.add.reduceat((h >> np.uint64(lane)) & _LANE, begin)
        for k in range(4):
            votes = np.add.reduceat(((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64), first)
            marks |= (2 * votes > size).astype(np.uint64) << np.uint64(lane + 16 * k)
    out[full] = marks
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, fp) of every row of docs; the 64 bits of fp as a signed number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            fp = majority(*shingle_hashes(Words(data, off)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(work, "id long, fp long")


# ---------------------------------------------------------------- the index


def masks(width: int, upto: int) -> np.ndarray:
    """All values of `width` bits with at most `upto` of them set, fewest first."""
    return np.array([sum(1 << b for b in c) for e in range(upto + 1) for c in combinations(range(width), e)], np.uint64)


def cheapest(cost: np.ndarray, units: int) -> np.ndarray:
    """cost (parts, thresholds from -1 on, n) -> (parts, n): the thresholds of least cost whose sum of t + 1 is `units`."""
    parts, kinds, n = cost.shape
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((parts, units + 1, n), np.int8)
    for p in range(parts):
        new = np.full_like(best, np.inf)
        for u in range(min(kinds - 1, units) + 1):
            for s in range(u, units + 1):
                c = best[s - u] + cost[p, u]
                less = c < new[s]
                new[s][less] = c[less]
                choice[p, s][less] = u
        best = new
    out = np.zeros((parts, n), np.int64)
    left = np.full(n, units)
    for p in reversed(range(parts)):
        u = choice[p, left, np.arange(n)].astype(np.int64)
        out[p] = u - 1
        left -= u
    return out


def widths(parts: int) -> list[int]:
    return [64 * (i + 1) // parts - 64 * i // parts for i in range(parts)]


def parts_for(n: int, within: int = WITHIN) -> int:
    """The number of parts with the least cost for n fingerprints whose bits are even and independent."""

    def cost(parts: int) -> float:
        each = [[0.0] + [len(masks(w, e)) * (PROBE + n / 2.0**w) for e in range(WIDEST + 1)] for w in widths(parts)]
        table = np.array(each)[:, :, None]
        got = cheapest(table, within + 1)[:, 0]
        return sum(each[p][t + 1] for p, t in enumerate(got))

    return min(range(2, within + 2), key=cost)


def grouped(both: np.ndarray, n: int, sizes: list[int]) -> list[list[int]]:
    """Bits by part, from how often two bits are set together: each part grows by the bit that goes best with it."""
    p = np.diag(both) / n
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        tie = np.abs(np.nan_to_num((both / n - np.outer(p, p)) / np.outer(spread, spread)))
    np.fill_diagonal(tie, 0)
    left, out = list(range(64)), []
    for size in sizes:
        part: list[int] = []
        while len(part) < size:
            sums = tie[np.ix_(left, part or left)].sum(axis=1)
            part.append(left.pop(int(np.argmax(sums.round(9)))))
        out.append(part)
    return out


def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that these bits make."""
    v = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        v |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return v


def shells(count: np.ndarray, width: int) -> np.ndarray:
    """How many hold a value exactly 0, 1, ... WIDEST bits away from each value."""
    out = [np.zeros_like(count, dtype=np.float64), count.astype(np.float64)]
    at = np.arange(len(count))
    for e in range(WIDEST):
        beside = sum(out[-1][at ^ (1 << b)] for b in range(width))
        out.append((beside - (width - e + 1) * out[-2]) / (e + 1) if e else beside)
    return np.stack(out[1:]).astype(np.float32)


class Index:
    """Parts, and what a threshold costs a fingerprint."""

    def __init__(self, parts: list[list[int]], n: int, within: int):
        self.n, self.within = n, within
        self.parts = parts
        self.pieces = [[p] if len(p) <= PIECE else [p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :]] for p in parts]
        self.shells: list[list[np.ndarray]] = []

    def learn(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """counts: how many hold each value of (part, piece)."""
        self.shells = [[shells(counts[p, q], len(bits)) for q, bits in enumerate(pieces)] for p, pieces in enumerate(self.pieces)]

    def candidates(self, fp: np.ndarray, p: int) -> np.ndarray:
        """Estimated holders of a value within 0, 1, ... WIDEST bits, (WIDEST + 1, n)."""
        parts = [s[:, gathered(fp, bits).astype(np.int64)] for s, bits in zip(self.shells[p], self.pieces[p], strict=True)]
        if len(parts) == 1:
            return np.cumsum(parts[0], axis=0)
        return np.cumsum(np.stack([sum(parts[0][a] * parts[1][e - a] for a in range(e + 1)) / self.n for e in range(WIDEST + 1)]), axis=0)

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """(parts, n)."""
        cost = np.zeros((len(self.parts), WIDEST + 2, len(fp)))
        for p, bits in enumerate(self.parts):
            probes = np.array([len(masks(len(bits), e)) for e in range(WIDEST + 1)])
            cost[p, 1:] = self.candidates(fp, p) + PROBE * probes[:, None]
        return cheapest(cost, self.within + 1)

    def held(self, fp: np.ndarray) -> np.ndarray:
        """The keys that fingerprints hold, (parts, n)."""
        return np.stack([np.uint64(p << PLACE) | gathered(fp, bits) for p, bits in enumerate(self.parts)])

    def probes(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, whose they are), some at a time."""
        keys, t = self.held(fp), self.thresholds(fp)
        for p, bits in enumerate(self.parts):
            for e in range(WIDEST + 1):
                who, m = np.flatnonzero(t[p] == e), masks(len(bits), e)
                step = max(1, HELD // len(m))
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    yield (keys[p, some][:, None] ^ m[None, :]).ravel(), np.repeat(some, len(m))


def _numbers(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def bits_together(classes: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together, over all fingerprints, and how many those are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), np.int64)
        for batch in _cut(batches):
            x = np.unpackbits(_numbers(batch, 0).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64 * 64)), pa.array(both.ravel())], names=["at", "n"])

    both = np.zeros(64 * 64, np.int64)
    for at, n in classes.select("fp").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # 4096 rows
        both[at] = n
    return both.reshape(64, 64), classes.count()


def learnt(classes: DataFrame, within: int) -> Index:
    both, n = bits_together(classes)
    index = Index(grouped(both, n, widths(parts_for(n, within))), n, within)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            fp = _numbers(batch, 0).view(np.uint64)
            for p, pieces in enumerate(index.pieces):
                for q, bits in enumerate(pieces):
                    v, many = np.unique(gathered(fp, bits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(np.full(len(v), q, np.int32)), pa.array(v.astype(np.int32)), pa.array(many)], names=["p", "q", "v", "n"])

    counts = {(p, q): np.zeros(1 << len(bits), np.int64) for p, pieces in enumerate(index.pieces) for q, bits in enumerate(pieces)}
    found = classes.select("fp").mapInArrow(work, "p int, q int, v int, n long").groupBy("p", "q", "v").agg(F.sum("n").alias("n"))
    for p, q, v, many in found.collect():  # at most 2 ** PIECE values of at most 6 pieces
        counts[p, q][v] = many
    index.learn(counts)
    return index


def members(classes: DataFrame, index: Index) -> DataFrame:
    """(fp, label) -> (key, fp, label) for each part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            for keys in index.held(_numbers(batch, 0).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0), batch.column(1)], names=["key", "fp", "label"])

    return classes.select("fp", "label").mapInArrow(work, "key long, fp long, label long")


def probes(classes: DataFrame, index: Index) -> DataFrame:
    """(fp, label) -> (key, fp, label) for each value probed."""
    sent = classes.sparkSession.sparkContext.broadcast(index)  # shells of at most 6 pieces, 4 numbers for each of 2 ** PIECE values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            fp, label = _numbers(batch, 0), _numbers(batch, 1)
            for keys, who in sent.value.probes(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[who]), pa.array(label[who])], names=["key", "fp", "label"])

    return classes.select("fp", "label").mapInArrow(work, "key long, fp long, label long")


# ---------------------------------------------------------------- links


def near(a: str, b: str, within: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= within


def link(classes: DataFrame, within: int, known: DataFrame) -> DataFrame:
    """(fp) and edges (u, v) known before -> (fp, label): the least fingerprint, as a signed number, that each reaches."""
    labels = None if known.isEmpty() else components(known)
    index = learnt(classes, within)

    def labelled() -> DataFrame:
        if labels is None:
            return classes.select("fp", F.col("fp").alias("label"))
        return classes.join(labels, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("label", "fp").alias("label"))

    def after(edges: DataFrame) -> DataFrame:
        return components(edges if labels is None else edges.unionByName(labels.select(F.col("id").alias("u"), F.col("label").alias("v"))))

    for n in range(ROUNDS):
        rows = members(labelled(), index)
        pivot = F.min_by(F.struct("fp", "label"), F.xxhash64("fp", F.lit(n)))
        open_ = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), pivot.alias("p")).where((F.col("n") > MANY) & (F.col("lo") < F.col("hi"))).select("k", F.col("p.fp").alias("pf"), F.col("p.label").alias("pl"))
        edges = rows.join(open_, F.col("key") == F.col("k")).where((F.col("label") != F.col("pl")) & near("fp", "pf", within)).select(F.col("label").alias("u"), F.col("pl").alias("v")).distinct()
        edges = stored(edges, "pivots")
        if edges.isEmpty():
            break
        labels = after(edges)
    now = stored(labelled(), "fingerprint-labels")
    rows = members(now, index)
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"))
    mains = stored(sizes.where(F.col("all") > MANY).select("k", F.col("most.label").alias("main")), "mains")
    in_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    held = rows.join(mains, F.col("key") == F.col("k"), "left").select("key", in_main.alias("side"), F.col("fp").alias("b"), F.col("label").alias("lb"))
    # what is in a bucket's main component meets what is not; the rest meets both
    sides = F.when(in_main | F.col("main").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    asked = probes(now, index).join(mains, F.col("key") == F.col("k"), "left").select("key", F.explode(sides).alias("side"), F.col("fp").alias("a"), F.col("label").alias("la"))
    pairs = asked.join(held, ["key", "side"]).where((F.col("la") != F.col("lb")) & near("a", "b", within))
    edges = stored(pairs.select(F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v")).distinct(), "links")
    if not edges.isEmpty():
        labels = after(edges)
    return labelled()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", within: int = WITHIN) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint: 16 hex digits, component_id)."""
    known = stored(fingerprints(docs, text, key), "fingerprints")
    named = known.where("id is not null")
    classes = stored(named.groupBy("fp").agg(F.min("id").alias("doc")), "fingerprint-classes")
    several = named.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select(F.col("id").alias("i"), "lo")
    ties = stored(named.join(several, F.col("id") == F.col("i")).select(F.col("fp").alias("u"), F.col("lo").alias("v")).where("u > v").distinct(), "ties")
    groups = stored(classes.join(link(classes, within, ties), "fp") if not classes.isEmpty() else classes.withColumn("label", F.col("fp")), "fingerprint-groups")
    least = groups.groupBy("label").agg(F.min("doc").alias("component_id"))
    of = groups.join(least, "label").select(F.col("fp").alias("f"), "component_id")
    out = known.join(of, F.col("fp") == F.col("f"), "left")
    mark = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias("doc_id"), mark.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
