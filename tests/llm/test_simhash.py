"""SimHash groups against all pairs of fingerprints, and the index's promise."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"


def mark(text):
    w = WORD.findall((text or "").translate(AZ))
    items = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, within=4):
    """Of rows with these fingerprints and ids: the least id that each reaches; an id's rows are one document."""
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    def tie(a, b):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)

    f = np.array(fps, np.uint64)
    first = {}
    for i, d in enumerate(ids):
        if d is None:
            continue
        tie(first.setdefault(d, i), i)
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= within) + i + 1:
            if ids[int(j)] is not None:
                tie(i, int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [None if d is None else least[top(i)] for i, d in enumerate(ids)]


def want(rows):
    fps = [mark(t) for _, t in rows]
    return sorted((str(d), f"{x:016x}", str(c)) for (d, _), x, c in zip(rows, fps, groups(fps, [d for d, _ in rows]), strict=True))


def got(docs):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgéñ日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = [None, "", " \t\n\v", "one", "One two", "ONE\ttwo three", "a b c d", "a b c d e", "x" * 70_000, "x " * 70_000, " ".join(text(70_000))]
    origin = text(300)
    for _ in range(60):
        ws = list(origin)
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        out.append((" " if rng.random() < 0.5 else "\n").join(ws))
    return out + [" ".join(text(rng.randint(2, 60))) for _ in range(60)] + [" ".join(origin)] * 20


def test_equals_all_pairs(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want(rows)


def test_whole_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == want([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_repeated_and_null_ids_and_clashing_columns(spark):
    some = texts()
    rows = [(i % 9 if i % 4 else None, t) for i, t in enumerate(some[:8] + some[11:60])] + [(7, some[20])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "fp", "label", "key", "f", "component_id", "doc")})
    assert got(docs) == want(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(empty) == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [("1", "0" * 16, "1"), ("2", "0" * 16, "1")]


def skewed(rng, n):
    """Fingerprints with tied bits and frequent values, near copies around a few centres among them."""
    base = rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)
    base[: n // 2] &= np.uint64(0xFFFF0000FF00FF0F)
    base |= (base >> np.uint64(32)) & np.uint64(0x00FF00FF)
    centre = base[rng.integers(0, 3, n // 3)]
    for _ in range(3):
        centre ^= (np.uint64(1) << rng.integers(0, 64, len(centre)).astype(np.uint64)) * rng.integers(0, 2, len(centre)).astype(np.uint64)
    return np.unique(np.concatenate([base, centre]))


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_probes_reach_every_pair_within_the_distance(parts):
    rng = np.random.default_rng(parts)
    fp = skewed(rng, 400)
    x = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    index = simhash.Index(simhash.grouped(x.T @ x, len(fp), simhash.widths(parts)), len(fp), 4)
    assert sorted(b for p in index.parts for b in p) == list(range(64))
    index.learn({(p, q): np.bincount(simhash.gathered(fp, bits).astype(np.int64), minlength=1 << len(bits)) for p, pieces in enumerate(index.pieces) for q, bits in enumerate(pieces)})
    t = index.thresholds(fp)
    assert ((t + 1).sum(axis=0) == 5).all() and t.min() >= -1 and len(np.unique(t, axis=1)[0]) > 1
    if parts > 3:  # one by one: counts are exact
        for p, bits in enumerate(index.parts):
            v = simhash.gathered(fp, bits)
            far = np.bitwise_count(v[:, None] ^ v[None, :])
            for e in range(3):
                assert np.allclose(index.candidates(fp, p)[e], (far <= e).sum(axis=1))
    held = [set(k) for k in index.held(fp).T.tolist()]
    mine = [set() for _ in fp]
    for keys, who in index.probes(fp):
        for k, w in zip(keys.tolist(), who.tolist(), strict=True):
            mine[w].add(k)
    for i, j in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4), strict=True):
        assert mine[i] & held[j]


def test_cheapest_is_the_least_of_all():
    rng = np.random.default_rng(1)
    cost = rng.random((3, 5, 20))
    cost[:, 0] = 0
    every = [(a, b, 5 - a - b) for a in range(5) for b in range(5) if 0 <= 5 - a - b < 5]
    for n, t in enumerate(simhash.cheapest(cost, 5).T):
        assert np.isclose(sum(cost[p, u + 1, n] for p, u in enumerate(t)), min(sum(cost[p, u, n] for p, u in enumerate(e)) for e in every))


def test_more_fingerprints_want_wider_parts():
    assert [simhash.parts_for(n) for n in (10, 10**5, 10**7, 10**10)] == [5, 5, 3, 2]


@pytest.mark.parametrize("parts", [2, 4])
def test_links_are_those_of_all_pairs(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "parts_for", lambda n, within: parts)
    fp = skewed(np.random.default_rng(9), 1_500).view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in fp], "fp long")
    no = spark.createDataFrame([], "u long, v long")
    found = dict(map(tuple, simhash.link(classes, 4, no).collect()))
    mine = [x % (1 << 64) for x in fp]
    assert [found[x] for x in fp] == groups(mine, fp)
