"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (lower-cased A-Z); a linear softmax
over it gives the languages. Both are trained by stochastic gradient descent in numpy, on a sample
of about SAMPLE labelled rows (the commonest SAMPLE / 2 languages at most), drawn by hash with an
equal share for each language, whatever their length: executors count the n-grams of whole texts. A fifth of the
sample is kept back to fit a temperature, so that scores are probabilities, and the score below
which a prediction is rejected.

Scale: the sample's bound is fixed; prediction is one map over whole texts, without a shuffle. Since
the model is linear, a worker only needs each n-gram's contribution to each language: a table of
BUCKETS rows, whatever the corpus.

Defined results: a null text or one without a letter is `und` with score 0; with nothing to learn
from, every text is `und`; other columns pass through; rows without a label teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.core import _LOWERED, slices

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
WIDTH = 16
SAMPLE = 4_000
#: Different n-grams of a lesson, the most frequent ones; what the driver holds is bounded by rows times this.
BAG = 4_096
EPOCHS, RATE = 4, 4.0
#: Of held-back predictions that are accepted, at most this share may be wrong.
ERROR_RATE = 0.01


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, langs): what an n-gram adds to each language; the last row is zero
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        sums, count = np.zeros((len(off) - 1, len(self.langs))), np.zeros(len(off) - 1)
        full = np.flatnonzero(np.diff(off))
        if len(full):
            for n in GRAMS:
                g = grams(data, off, n)
                sums[full] += np.add.reduceat(self.table[g], off[:-1][full], axis=0, dtype=np.float64)
                count += np.maximum(np.diff(off) - n + 1, 0)
        logits = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        return softmax(logits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grams(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each byte; BUCKETS where it would leave the text."""
    low = _LOWERED[data].astype(np.uint32)
    h = np.full(len(low), n, np.uint32)
    for j in range(n):
        h[: len(low) - j] = h[: len(low) - j] * np.uint32(0x01000193) ^ low[j:]
    h = (h * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)).astype(np.int64)
    for j in range(1, n):  # the last n - 1 bytes of each text
        ends = off[1:] - j
        h[ends[ends >= off[:-1]]] = BUCKETS
    return h


Bag = tuple[np.ndarray, np.ndarray]  # buckets of n-grams, and the share of each


def bag_of(data: np.ndarray) -> Bag:
    ids, count = np.unique(np.concatenate([grams(data, np.array([0, len(data)]), n) for n in GRAMS]), return_counts=True)
    ids, count = ids[ids < BUCKETS], count[ids < BUCKETS]
    if len(ids) > BAG:
        most = np.sort(np.argsort(-count, kind="stable")[:BAG])
        ids, count = ids[most], count[most]
    return ids.astype(np.uint16), (count / max(count.sum(), 1)).astype(np.float32)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Trains on texts and their languages; the order given must not matter to the caller."""
    return fit_bags([bag_of(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts], langs, seed)


def fit_bags(bags: list[Bag], langs: list[str], seed: int = 7) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    want = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(bags))
    back = order[: len(bags) // 5]
    train = order[len(bags) // 5 :]
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            ids, share = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[want[i]] -= 1
            back_emb = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            emb[ids] -= (rate * share)[:, None] * back_emb
    table = np.zeros((BUCKETS + 1, len(names)), np.float32)
    table[:BUCKETS] = emb @ out
    model = Model(names, table, bias, 1.0, 0.0)
    if len(back):
        held = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in back])
        truth = want[back]
        cost = lambda t: -np.log(np.maximum(softmax(held / t)[np.arange(len(back)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=cost))
        p = softmax(held / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == truth
        down = np.argsort(-score, kind="stable")
        wrong = np.cumsum(~right[down]) / np.arange(1, len(down) + 1)
        ok = np.flatnonzero(wrong <= ERROR_RATE)
        model.least = float(score[down][ok[-1]]) if len(ok) else 1.0
    return model


def lessons(docs: DataFrame, text: str, lang: str, key: str, may: Column) -> tuple[list[Bag], list[str]]:
    """The bags of about SAMPLE texts and their languages: those of least hash, an equal share for each."""
    labelled = docs.where(may & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("y"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("lesson")), F.lit(1 << 30)).alias("u"), F.xxhash64(text).alias("h"))
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(SAMPLE // 2).collect()}
    if not counts:
        return [], []
    share = SAMPLE // len(counts)
    most = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, int(min(1.0, share / n) * (1 << 30)))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            bags = [bag_of(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array([b[0].tobytes() for b in bags], pa.binary()), pa.array([b[1].tobytes() for b in bags], pa.binary())], names=["y", "u", "h", "ids", "shares"])

    chosen = labelled.where(F.col("u") < F.get(F.array(F.try_element_at(most, F.col("y"))), F.lit(0)))
    rows = chosen.mapInArrow(work, "y string, u long, h long, ids binary, shares binary").orderBy("u", "h", "y").limit(2 * SAMPLE).collect()
    return [(np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in rows], [r["y"] for r in rows]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (calibrated) and accepted (false where the score is below the rejection threshold)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    shape = docs.select(rest).schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array(m.langs)
        for rows, data, off in slices(batches, text):
            p = m.probabilities(data, off)
            yield pa.RecordBatch.from_arrays([*rows.columns, names.take(pa.array(p.argmax(axis=1))), pa.array(p.max(axis=1))], names=[*rest, "lang_pred", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.select(rest).mapInArrow(work, shape)
    return out.withColumns({"lang_pred": F.when(lettered, F.col("lang_pred")).otherwise("und"), "score": F.when(lettered, F.col("score")).otherwise(0.0), "accepted": lettered & (F.col("score") >= model.least)})


def held_out(key: str = "doc_id", mod: int = 4) -> Column:
    """Whether a row's crc32 leaves 2; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == 2, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_bags(*lessons(docs, "text", "lang", "doc_id", ~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
