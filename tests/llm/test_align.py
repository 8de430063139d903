"""Alignments against the libraries' own tokens, met token by token in plain Python."""

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import align, blocks
from millrace.llm.bpe import spelling

FILES = align.files()
A = Tokenizer.from_file(FILES.a)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES.b)
BYTE = {c: b for b, c in enumerate(spelling())}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def bytes_b(i):
    m = re.fullmatch("<0x([0-9A-F]{2})>", B.id_to_piece(i))
    return bytes([int(m[1], 16)]) if m else B.id_to_piece(i).replace("▁", " ").encode()


def met(text):
    """Ids of A and B, groups, links; None where there are no tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    xa, xb = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
    if not b"".join(xa) == b"".join(xb) == (" " + text).encode():
        return None
    ea, eb = list(accumulate(map(len, xa))), list(accumulate(map(len, xb)))
    groups, links, i, j = [], [], 0, 0
    for e in sorted(set(ea) & set(eb)):
        x, y = i, j
        while i < len(a) and ea[i] <= e:
            i += 1
        while j < len(b) and eb[j] <= e:
            j += 1
        groups.append((a[x:i], b[y:j], e))
    i = j = 0
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
    return a, b, groups, links


def want(rows):
    each = [(d, met(t)) for d, t in rows]
    held = Counter(p for _, m in each if m for p in set(m[3]))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for d, m in each:
        if m is None:
            out.append((str(d), 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in m[2])
        out.append((str(d), len(m[0]), len(m[1]), len(m[2]), len(m[3]), sum(held[p] == top[p[0]] for p in m[3]), sum(held[p] for p in m[3]), sha256(said.encode()).hexdigest()))
    return sorted(out)


def got(docs):
    out = align.statistics(docs, FILES)
    assert out.columns == COLUMNS
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def texts():
    rng = random.Random(4)
    words = ["it's", "Straße", "naïve", "日本語", "x1y2", "12345", "don't", "e.g.", "👍🏽", "ab", "the", "The", "…", " ", "ﬁ", "é"]
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c", "\t\tx\n\n y", "<|endoftext|> and <s> </s> <unk>", "held ▁ here", "▁", "\x00\x01", "Ａ１", "a​b", "x" * 40_000, " " * 5_000 + "y", "the " * 30_000]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["it's the same"] * 5


def test_equals_plain_python(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(docs) == want(rows)


def test_exchanged_in_two_hops_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 300)
    monkeypatch.setattr(blocks, "WIDE", 2)
    rows = [(i, t) for i, t in enumerate(texts()) if len(t or "") < 2_000]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == want(rows)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(i % 3 if i % 4 else None, t) for i, t in enumerate(texts()) if len(t or "") < 2_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "a", "b", "block", "data", "groups", "n_a")})
    assert got(docs) == want(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "▁")]])
def test_nothing_to_align(spark, rows):
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows)


def test_chunks_give_the_models_own_pieces():
    side = align.Pieces(open(FILES.b, "rb").read())
    some = [t for t in texts() if t]
    assert side.by_chunk and side.encode(some) == B.encode(some)


def test_few_kept_chunks(monkeypatch):
    monkeypatch.setattr(align, "KNOWN", 5)
    side = align.Pieces(open(FILES.b, "rb").read())
    for t in texts():
        assert side.encode([t or ""]) == [B.encode(t or " ")] or not t


def test_alignments_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text", F.lit("x").alias("groups"))
    rows = align.alignments(docs, FILES).collect()
    assert len(rows) == 200 and set(rows[0].asDict()) == {"doc_id", "lang", "text", "a", "b", "groups"}
    for r in rows:
        a, b, groups, _ = met(r.text)
        assert (r.a, r.b) == (a, b)
        assert [(g.n_a, g.n_b, g.ends) for g in r.groups] == [(len(x), len(y), e) for x, y, e in groups]
