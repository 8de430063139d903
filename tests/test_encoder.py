"""The trained encoder's counts, products and word directions."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import encoder

SPACES = r"[ \t\n\x0b\f\r]+"
TEXTS = ["The cat\tdrinks\x0bmilk a b x y p\x1cq cat", None, "", " \n ", "İstanbul CAT cat cat the", "the cat\r\nDRINKS milk the"]


def cut(t):
    return [w for w in re.split(SPACES, t) if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def test_counts_are_made_once_and_kept(spark, docs):
    kept = []
    model = encoder.train(docs, keep=lambda df: kept.append(df.columns) or df)
    assert kept == [["word", "n"], ["i", "j", "n"], ["i", "j", "v"]]
    lower = [r.t for r in docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()]
    want = Counter(w for t in lower for w in cut(t))
    assert model.words == sorted((w for w in want if want[w] >= encoder.LEAST), key=lambda w: (-want[w], w))
    assert np.allclose(model.share, [want[w] / want.total() for w in model.words])


def test_pairs_stand_both_ways(docs, monkeypatch):
    known = ["cat", "the", "milk"]
    want = Counter()
    for t in TEXTS:
        ids = [known.index(w) if w in known else -1 for w in cut((t or "").lower())]
        for a, x in enumerate(ids):
            for y in ids[a + 1 : a + 1 + encoder.WINDOW]:
                if x >= 0 and y >= 0:
                    want[x, y] += 1
                    want[y, x] += 1
    for at_once in (encoder.AT_ONCE, 0):  # 0: each text is counted alone
        monkeypatch.setattr(encoder, "AT_ONCE", at_once)
        got = [((r.i, r.j), r.n) for r in encoder.pairs(docs, "text", known).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_products_are_dealt_evenly(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.triu(rng.random((40, 40))) + 1
    rows = [(int(i), int(j), float(x[i, j])) for i in range(40) for j in range(40) if i + j < 40]
    matrix = spark.createDataFrame(rows, "i long, j long, v double")
    monkeypatch.setattr(encoder, "BLOCK", 8)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("products", "products")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = encoder.product(matrix, np.eye(40)[:, :7], 40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = np.zeros((40, 40))
    for i, j, v in rows:
        want[i, j] = v
    assert np.allclose(got, want[:, :7])
    # the blocks are multiplied in jobs of all partitions, not partition by partition
    assert len(jobs.getJobIdsForGroup("products")) <= 3


def test_signs_are_those_of_the_generator():
    names = ["cat", "", "é", *(f"w{i}" for i in range(500))]
    got = encoder.signs_of(names)
    want = np.array([np.packbits(encoder.direction(w, encoder.OWN) > 0) for w in names])
    assert got.shape == (len(names), encoder.OWN // 8) and (got == want).all()
    assert encoder.signs_of([]).shape == (0, encoder.OWN // 8)
