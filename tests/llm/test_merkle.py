"""The Merkle manifest against plain Python, and proofs against changed rows."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars long, text string"
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*(said(v) for v in (row[0], row[1], row[2], row[3], text)))


def tree(level, tracks):
    """Folds a level to one node; tracks: (position, proof so far, other node so far) of each leaf."""
    while len(level) > 1:
        for t in tracks:
            run = level[t[0] // 8 * 8 : t[0] // 8 * 8 + 8]
            before, after = run[: t[0] % 8], run[t[0] % 8 + 1 :]
            t[1] += "".join(before + after)
            t[2] = h(*before, t[2], *after)
            t[0] //= 8
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        other = r[4]
        if other is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            other = other.translate(AZ)
        groups[r[2]].append((r[0], leaf(r, r[4]), leaf(r, other)))
    out, subroots, tracks = [], [], []
    for k, g in enumerate(sorted(groups, key=lambda x: (x is not None, (x or "").encode()))):
        members = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own = [[i, "", m[2]] for i, m in enumerate(members)]
        subroots.append(tree([m[1] for m in members], own))
        for t, m in zip(own, members, strict=True):
            t[0] = k
            tracks.append(t)
            out.append([m[0], m[1], subroots[-1]])
    root = tree(subroots, tracks) if subroots else None
    return sorted((str(a), b, c, root, h(t[1]), t[2], t[2] == root) for (a, b, c), t in zip(out, tracks, strict=True))


def got(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, SHAPE).repartition(3, "doc_id")
    if extra:
        docs = docs.withColumns({c: F.lit("x") for c in ("g", "k", "leaf", "found", "salt", "root", "proof")})
    out = merkle.checked(docs, merkle.lower_az)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def rows_of(n, langs):
    return [(i * 7 % (n + 3), ["a", None, "ü"][i % 3], langs[i % len(langs)], i if i % 5 else None, [None, "", "Text É %d" % i, "low", "A" * 5000][i % 5]) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, [None]), (9, ["en"]), (65, ["en", None]), (600, ["en", "en", "en", "de", "é", "Z", None, "", "a|\"'"]), (150, [str(i) for i in range(75)])])
def test_equals_plain_python(spark, n, langs):
    rows = rows_of(n, langs)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("block, fan", [(1, 2), (5, 3), (64, 2)])
def test_any_blocks_and_sums(spark, monkeypatch, block, fan):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = rows_of(150, ["en", "en", "fr", None, *map(str, range(11))])
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = [(None, "s", "en", 1, "x"), (None, None, None, None, None), (3, "s", "en", 1, "Same"), (3, "s", "en", 1, "Same"), (3, "s", "en", 1, "Other")] * 7 + [(3, "s", "en", 1, "Same")] * 40
    assert got(spark, rows, extra=True) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_every_column_counts(spark):
    rows = rows_of(100, ["en", "de"])
    docs = spark.createDataFrame(rows, SHAPE)
    for column, value in (("source", F.lit("b")), ("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" ")))):
        changed = merkle.digest(*(value if c == column else F.col(c) for c in merkle.COLUMNS))
        m = merkle.manifest(docs, merkle.COLUMNS, found=changed)
        bad = m.where((merkle.folded(F.col("found"), F.col("proof")) != F.col("root")) != (F.col("found") != F.col("leaf")))
        assert bad.count() == 0 and m.where("found != leaf").count() >= 60


def test_a_sum_of_forests_is_associative():
    leaves = {merkle.TOP: 2, 0: 20, 1: 3}
    nodes = [((0, 0, i), h(str(i))) for i in range(20)] + [((1, 0, i), h("b%d" % i)) for i in range(3)]
    ends = set()
    for cut in ((5, 11), (1, 22), (8, 16), (20, 21)):
        parts = [dict(nodes[a:b]) for a, b in ((0, cut[0]), (cut[0], cut[1]), (cut[1], 23))]
        for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
            whole = {}
            for k in order:
                merkle.settle(parts[k], leaves)
                whole |= parts[k]
                merkle.settle(whole, leaves)
            ends.add(tuple(whole.items()))
    assert len(ends) == 1 and len(next(iter(ends))) == 1
