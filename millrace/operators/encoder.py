"""A text encoder trained on the corpus: word vectors from windowed co-occurrence, frequency-weighted means for texts.

Words of the VOCABULARY commonest are counted with their neighbours up to WINDOW words on; a count becomes its positive
pointwise mutual information. The matrix stays a table of (i, j, value); its range is found by multiplying it with a
few random columns (a seed gives them, so that no task is sent them), POWER more times with what that gave, and the word
vectors are its leading eigenvectors there. Each product is one grouped job over the table. What the driver holds is
VOCABULARY x (WIDTH + OVER) numbers, the factor that goes into the next product, whatever the corpus has.

A text's vector has two parts. One is the sum of its words' vectors, each at length one by SMOOTH / (SMOOTH + the word's
share of all words), without the direction that all texts share; it is MIX long. The other is the like sum of
directions that words have of their own, from a hash, and is one long: it tells words apart that stand in like places,
and speaks for words outside the vocabulary. The whole is scaled to length one; a text without words is zero. Two runs
give the same vectors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import words
from millrace.operators.retrieve import Encoder

#: Words with a vector, times that a word stands in the corpus at least, neighbours on each side.
VOCABULARY, LEAST, WINDOW = 20_000, 3, 4
#: Numbers of a vector, columns beside them while the range is found, products after the first.
WIDTH, OVER, POWER = 96, 16, 1
SMOOTH = 1e-3
#: Numbers of a word's own direction, and how long its learnt vector is beside it.
OWN, MIX = 288, 0.5
#: Own directions that a worker keeps, a bit a number.
KNOWN = 200_000
#: Rows of the matrix that one task multiplies, and entries at once.
BLOCK, AT_ONCE = 256, 65_536
#: PCG64 counts modulo 2**128, by steps of this factor.
_128, _STEP = (1 << 128) - 1, 2549297995355413924 << 64 | 4865540595714422341


@dataclass(frozen=True)
class Model:
    words: list[str]
    share: np.ndarray  # of all words of the corpus
    vectors: np.ndarray


def lowered(docs: DataFrame, text: str) -> DataFrame:
    """The lower-cased texts as bytes, whose split() cuts at the white space of functions.text.words."""
    return docs.select(F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("text"))


def vocabulary(docs: DataFrame, text: str, keep=lambda df: df) -> tuple[list[str], np.ndarray]:
    """The commonest words and their shares of all words; ties go to the smaller word. keep stores the counts, which are read twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[bytes] = Counter()
            for t in batch.column(0):
                held.update(t.as_py().split())
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    counts = keep(lowered(docs, text).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    return [r["word"] for r in rows], np.array([r["n"] for r in rows]) / max(total, 1)


def pairs(docs: DataFrame, text: str, known: list[str]) -> DataFrame:
    """(i, j, n): how often word j stands up to WINDOW words before or behind word i, words of no number included in the distance."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # VOCABULARY words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(sent.value)}
        size, gap = max(len(number), 1), [-1] * WINDOW

        def counted(line: list[int]) -> tuple[np.ndarray, np.ndarray]:
            at, held = np.array(line, np.int64), []
            for d in range(1, WINDOW + 1):
                a, b = at[:-d], at[d:]
                both = (a >= 0) & (b >= 0)
                held.append(np.minimum(a[both], b[both]) * size + np.maximum(a[both], b[both]))
            return np.unique(np.concatenate(held), return_counts=True)

        for batch in batches:
            line: list[int] = []
            for k, t in enumerate(batch.column(0)):
                line += [number.get(w, -1) for w in t.as_py().split()]
                line += gap
                if len(line) > AT_ONCE * 16 or k == batch.num_rows - 1:
                    code, n = counted(line)
                    line = []
                    yield pa.RecordBatch.from_arrays([pa.array(code // size), pa.array(code % size), pa.array(n)], names=["i", "j", "n"])

    # a pair is counted and summed by its smaller number, and then stands both ways
    summed = lowered(docs, text).mapInArrow(work, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    way = lambda i, j, n: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), n.alias("n"))
    both = F.when(F.col("i") == F.col("j"), F.array(way("i", "j", 2 * F.col("n")))).otherwise(F.array(way("i", "j", F.col("n")), way("j", "i", F.col("n"))))
    return summed.select(F.inline(both))


def ppmi(counts: DataFrame) -> DataFrame:
    """(i, j, v) with v above zero: ln of a pair's count by what its words' counts let expect."""
    sums = counts.groupBy("i").agg(F.sum("n").alias("of"))
    total = counts.agg(F.sum("n").alias("all"))
    both = counts.join(sums, "i").join(sums.select(F.col("i").alias("j"), F.col("of").alias("other")), "j").crossJoin(F.broadcast(total))
    v = F.log(F.col("n") * F.col("all") / (F.col("of") * F.col("other")))
    return both.select("i", "j", v.alias("v")).where("v > 0")


def product(matrix: DataFrame, columns: np.ndarray | int, size: int) -> np.ndarray:
    """The matrix times columns (size x some), or times so many random ones."""
    sent = matrix.sparkSession.sparkContext.broadcast(columns)  # at most VOCABULARY x (WIDTH + OVER) numbers
    wide = columns if isinstance(columns, int) else columns.shape[1]

    def work(f: pd.DataFrame) -> pd.DataFrame:
        x = sent.value if not isinstance(sent.value, int) else np.random.default_rng(42).normal(size=(size, sent.value))
        f = f.sort_values(["i", "j"])
        i, j, v = (f[c].to_numpy() for c in ("i", "j", "v"))
        at, place = np.unique(i, return_inverse=True)
        out = np.zeros((len(at), wide))
        for k in range(0, len(i), AT_ONCE):
            some = slice(k, k + AT_ONCE)
            first = np.flatnonzero(np.append(True, np.diff(place[some])))
            out[place[some][first]] += np.add.reduceat(x[j[some]] * v[some, None], first)
        return pd.DataFrame({"i": at, "row": [r.tobytes() for r in out]})

    out = np.zeros((size, wide))
    # rows of common words, which are the longest, are dealt over all blocks; all blocks are multiplied at once
    blocks = matrix.groupBy((F.col("i") % F.lit(-(-size // BLOCK))).alias("block"))
    for r in blocks.applyInPandas(work, "i long, row binary").collect():  # VOCABULARY x (WIDTH + OVER) numbers at most
        out[r["i"]] = np.frombuffer(r["row"])
    return out


def train(docs: DataFrame, text: str = "text", keep=lambda df: df) -> Model:
    """keep stores the counts of words and the matrix, which is read POWER + 2 times."""
    known, share = vocabulary(docs, text, keep)
    size = len(known)
    wide = min(WIDTH + OVER, size)
    if not size:
        return Model([], share, np.zeros((0, WIDTH), np.float32))
    matrix = keep(ppmi(keep(pairs(docs, text, known))))
    q = np.linalg.qr(product(matrix, wide, size))[0]
    for _ in range(POWER):
        q = np.linalg.qr(product(matrix, q, size))[0]
    inner = q.T @ product(matrix, q, size)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-value, kind="stable")[:WIDTH]
    out = (q @ vector[:, best]) * np.sqrt(np.maximum(value[best], 0))
    out *= np.where(np.take_along_axis(out, np.abs(out).argmax(axis=0)[None, :], 0) < 0, -1, 1)
    return Model(known, share, np.pad(out, ((0, 0), (0, WIDTH - out.shape[1]))).astype(np.float32))


def direction(word: str, width: int) -> np.ndarray:
    """A word's own vector of length one, from a hash."""
    return np.random.default_rng(zlib.crc32(word.encode())).choice((-1.0, 1.0), width).astype(np.float32) / np.float32(width**0.5)


def signs_of(names: list[str]) -> np.ndarray:
    """The signs of direction(word, OWN) of each word, a bit each: the upper bits of the generator's own numbers.

    A generator's making costs ten times what it then draws, so that the states that numpy's SeedSequence gives to
    PCG64 are worked out for all words at once, and one generator draws from each.
    """
    const, pool = 0x43B0D7E5, []
    crc = np.array([zlib.crc32(w.encode()) for w in names], np.uint32)

    def hashed(x: np.ndarray, factor: int) -> np.ndarray:
        nonlocal const
        x = x ^ np.uint32(const)
        const = const * factor & 0xFFFFFFFF
        x = x * np.uint32(const)
        return x ^ (x >> np.uint32(16))

    for i in range(4):
        pool.append(hashed(crc if i == 0 else np.zeros_like(crc), 0x931E8875))
    for i in range(4):
        for j in range(4):
            if i != j:
                x = np.uint32(0xCA01F9DD) * pool[j] - np.uint32(0x4973F715) * hashed(pool[i], 0x931E8875)
                pool[j] = x ^ (x >> np.uint32(16))
    const = 0x8B51F9DD
    words32 = np.stack([hashed(pool[i % 4], 0x58F38DED) for i in range(8)], axis=1)
    drawn, generator = np.empty((len(names), OWN // 2), np.uint64), np.random.PCG64(0)
    state = generator.state
    for k, (a, b, c, d) in enumerate(np.ascontiguousarray(words32).view("<u8").tolist()):
        inc = ((c << 64 | d) << 1 | 1) & _128
        state["state"] = {"state": ((inc + (a << 64 | b)) * _STEP + inc) & _128, "inc": inc}
        generator.state = state
        drawn[k] = generator.random_raw(OWN // 2)
    return np.packbits(drawn.view("<u4") >> np.uint32(31), axis=1)


def encoder(model: Model, spark) -> Encoder:
    """The encoder of a model, for retrieve.embed."""
    sent = spark.sparkContext.broadcast(model)  # VOCABULARY vectors at most
    made: list[tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]] = []
    own: dict[str, bytes] = {}

    def encode(texts: list[str]) -> np.ndarray:
        m = sent.value
        if not made:
            length = np.linalg.norm(m.vectors, axis=1, keepdims=True)
            one = m.vectors / np.where(length > 0, length, 1)
            weight = (SMOOTH / (SMOOTH + m.share)).astype(np.float32)
            weighed = one * weight[:, None]
            mean = (weighed * m.share[:, None]).sum(axis=0)
            length = np.linalg.norm(mean)
            made.append(({w: i for i, w in enumerate(m.words)}, weighed, mean / length if length else mean, weight))
        number, weighed, common, weight = made[0]
        if len(own) > KNOWN:
            own.clear()
        out = np.zeros((len(texts), m.vectors.shape[1] + OWN), np.float32)
        split = [(t or "").lower().split() for t in texts]
        # the batch's distinct words: signs of their own directions, one row each
        place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        new = [w for w in place if w not in own]
        own.update(zip(new, map(bytes, signs_of(new)), strict=True))
        bits = np.frombuffer(b"".join(own[w] for w in place), np.uint8).reshape(-1, OWN // 8)
        signs = np.unpackbits(bits, axis=1, count=OWN).view(np.int8)
        signs *= 2
        signs -= 1
        ids = np.array([number.get(w, -1) for w in place], np.int64)
        heavy = np.ones(len(ids), np.float32)
        heavy[ids >= 0] = weight[ids[ids >= 0]]
        for k, ws in enumerate(split):
            if not ws:
                continue
            at = np.array([place[w] for w in ws])
            v = weighed[ids[at][ids[at] >= 0]].sum(axis=0)
            v = v - (v @ common) * common
            out[k, : len(v)] = v * (MIX / (np.linalg.norm(v) or 1))
            out[k, len(v) :] = heavy[at] @ signs[at].astype(np.float32)  # a text alone: the order of its sums is its own
            out[k, len(v) :] /= np.linalg.norm(out[k, len(v) :]) or 1
            out[k] /= np.linalg.norm(out[k]) or 1
        return out

    return encode
