"""Cleaning, chunking, classification, retrieval, evaluation, markdown."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import corpus, text
from millrace.operators import classify, evals, markdown, monitor, retrieve, sequence


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_cleaning(spark):
    got = one(spark, "[00:03:45] so um the grind size matters [01:22:00] you know (3:45)  a lot\n\n\nit is fine Now go ", corpus.cleaned)
    assert "[" not in got and "grind size matters" in got and "um " not in got and "fine. Now" in got and "\n\n" not in got


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (text.duration_seconds, "PT1H2M3S", 3723), (text.duration_seconds, "P1DT1S", 86401), (text.duration_seconds, "P1W", 0), (text.duration_seconds, "P1D", 0), (text.without_reasoning, "<think>a\nb</think> c", "c"), (text.without_reasoning, "x <think>open", "x"),
        (text.html_escaped, "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"), (text.fold_accents, "déséquilibré çà", "desequilibre ca"), (lambda c: text.humanized(c, {"v60": "V60"}), "super_automatic", "Super automatic"), (lambda c: text.humanized(c, {"v60": "V60"}), "v60", "V60"),
        (lambda c: text.humanized(c, {}), None, "Unknown"), (lambda c: text.json_in(c).cast("string"), 'said ```json {"a": 1} ``` so', '{"a":1}'), (lambda c: text.json_in(c).cast("string"), "{broken", None), (lambda c: F.size(text.words(c)), "  a  b ", 2),
    ],
)
def test_text_functions(spark, expr, value, want):
    assert one(spark, value, expr) == want


def test_number_text(spark):
    assert [one(spark, v, text.number_text, "double") for v in (22.0, 92.5)] == ["22", "92.5"]


def chunks_by_hand(t, most, overlap, least):
    out, cur, n = [], [], 0
    for s in [s for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]:
        w = s.split()
        parts = [" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])] if len(w) > most else [s]
        for p in parts:
            k = len(p.split())
            if n + k > most and cur:
                out.append(" ".join(cur))
                kept, m = [], 0
                for x in reversed(cur):
                    if m + len(x.split()) > overlap:
                        break
                    kept.insert(0, x)
                    m += len(x.split())
                cur, n = kept, m
            cur.append(p)
            n += k
    if cur:
        out.append(" ".join(cur))
    return [c for c in out if len(c.split()) >= least]


def test_chunking_matches_the_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    how = corpus.Chunking(60, 15, 8)
    for r in docs.select("text", corpus.chunks(F.col("text"), how).alias("c")).collect():
        assert r.c == chunks_by_hand(r.text, 60, 15, 8)
    assert one(spark, "", corpus.chunks) == [] and one(spark, None, corpus.chunks) is None


def test_chunk_ids_are_stable(spark):
    ids = [one(spark, v, lambda c: text.chunk_id(F.lit("v"), c)) for v in ("same text", "same text ", "other")]
    assert ids[0] == ids[1] != ids[2] and re.fullmatch("v_[0-9a-f]{8}", ids[0])


def test_classification(spark):
    rows = [("a", "Fixing bitter espresso", "why it is sour and weak", ["crema"], "bitter taste"), ("b", "DeLonghi espresso", "", [], "espresso espresso"), ("c", "My holiday", "beach", [], "sea"), ("d", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, title string, description string, tags array<string>, transcript_text string")
    got = {r.id: r for r in classify.classify(df).collect()}
    assert got["a"].domain == "troubleshooting" and got["b"].method == "super_automatic"
    assert all(got[k].domain == "general" and got[k].classification_confidence == 0 for k in "cd") and all(0 <= r.classification_confidence <= 1 for r in got.values())
    assert [r.id for r in classify.ranked_by_relevance(df, "id").orderBy("rank").collect()] == ["a", "b"]


def test_fusion_prefers_what_both_found(spark):
    a = spark.createDataFrame([("q", "v_top", "x", 0.9, 1), ("q", "shared", "y", 0.8, 2)], "query_id string, chunk_id string, text string, semantic_score double, rank int")
    b = spark.createDataFrame([("q", "b_top", "z", 10.0, 0.0, 1), ("q", "shared", "y", 9.0, 0.0, 2)], "query_id string, chunk_id string, text string, bm25_score double, semantic_score double, rank int")
    got = retrieve.fuse([a, b]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["shared", "v_top", "b_top"] and (got[0].semantic_score, got[0].bm25_score) == (0.8, 9.0)
    assert round(got[0].rrf_score, 6) == 0.032258 and round(got[1].rrf_score, 6) == 0.016393


def test_cosine_blocks_equal_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)] + [(60, [0.0] * 4), (61, None)], "chunk_id int, embedding array<double>")
    q = df.where("chunk_id < 9").withColumnRenamed("chunk_id", "query_id")
    key = lambda d: sorted(map(tuple, d.collect()))
    want = key(retrieve.cosine_top(df, q, 5))
    monkeypatch.setattr(retrieve, "MOST_BROADCAST", 3)
    assert key(retrieve.cosine_top(df, q, 5)) == want


def test_bm25_fills_with_zeros(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "e f"), (4, ""), (5, None)], "chunk_id int, text string")
    q = spark.createDataFrame([("q", "d d x")], "query_id string, text string")
    got = retrieve.bm25_top(docs, q, 3, zeros=True).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3] and got[0].bm25_score > 0 == got[1].bm25_score


def test_bm25_index_equals_scan(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 9))) for i in range(60)] + [(60, None)], "chunk_id int, text string")
    q = spark.createDataFrame([("a", "w1 w2 w2 none"), ("b", "w5 w0"), ("c", None)], "query_id string, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    want = key(retrieve.bm25_top(docs, q, 5))
    assert want and key(retrieve.bm25_top(docs, q, 5, index=retrieve.build_index(docs, str(tmp_path / "i")))) == want
    monkeypatch.setattr(retrieve, "MOST_TERMS", 1)
    assert key(retrieve.bm25_top(docs, q, 5, index=retrieve.open_index(spark, str(tmp_path / "i")))) == want and key(retrieve.bm25_top(docs, q, 5)) == want
    assert retrieve.bm25_top(docs.where("false"), q, 5).count() == 0


def test_retrieval_end_to_end(spark):
    docs = [(str(i), t, m) for i, (t, m) in enumerate([("grind finer for sour shots", "espresso"), ("clean the moka pot", "moka"), ("bake bread at home", "general")])]
    corpus_ = retrieve.embed(spark.createDataFrame(docs, "chunk_id string, text string, method string"), "text")
    q = retrieve.embed(spark.createDataFrame([("q", "sour shots grind", "nespresso")], "query_id string, text string, machine_type string"), "text")
    for mode in ("vector", "hybrid"):
        got = retrieve.retrieve(corpus_, q, mode=mode).orderBy("retrieval_rank").collect()
        assert got[0].chunk_id == "0" and [r.retrieval_rank for r in got] == list(range(1, len(got) + 1))
    assert {r.chunk_id for r in retrieve.retrieve(corpus_, q).collect()} == {"0", "2"}
    assert retrieve.relevant_enough(retrieve.retrieve(corpus_, q)).count() == 1


def test_metrics_and_judges(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1)], "query_id string, chunk_id string, rank int")
    truth = spark.createDataFrame([("q1", "b"), ("q2", "z")], "query_id string, chunk_id string")
    m = evals.retrieval_metrics(evals.first_hits(ranked, truth)).first()
    assert (m.hit_rate_5, m.mrr, m.n_queries) == (0.5, 0.25, 2)
    j = evals.judge_means(spark.createDataFrame([('x {"clarity": 4}',), ("none",), ('{"clarity": 5}',)], "reply string"), "reply", ("clarity", "accuracy")).first()
    assert (j.clarity, j.accuracy, j.parse_failures) == (4.5, None, 1)


def test_stats_and_sequences(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "x")], "i int, s string, c string")
    got = {(r.measure, r.value): r.n for r in monitor.collection_stats(df, "s", "c", ["c"]).collect()}
    assert got == {("total", None): 3, ("sources", None): 2, ("channels", None): 1, ("c", "x"): 2, ("c", "unknown"): 1}
    runs = spark.createDataFrame([(1, 100), (2, 100), (3, 1), (4, 1)], "i int, cost int")
    assert [r.i for r in sequence.within_budget(runs, [], ["i"], F.col("cost"), 150).collect()] == [1]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    once = sequence.upserted(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sequence.upserted(once, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_markdown(spark):
    md = "intro\n## 1. Grind\nCurrent: 3\n**Target:** 4\ntext\n```\n# no\n```\n**How to check**\nsip\n| Parameter | Current | Target |\n|---|---|---|\n| Dose | 18 | 17 |"
    df = spark.createDataFrame([(1, md), (2, None)], "i int, t string")
    got = {r.section: (r.title, r.body) for r in markdown.sections(df, "i", "t").where("i = 1").collect()}
    assert [got[k][0] for k in sorted(got)] == [None, "1. Grind", "How to check"] and got[0][1] == "intro" and "# no" in got[1][1]
    p = markdown.parameters(df, "i", "t").collect()
    assert [(r.current, r.target) for r in p] == [("3", "4")]
    assert {r.layout for r in markdown.layouts(df, "i", "t").where("i = 1").collect()} >= {"step", "validation"}
    head = df.select(markdown.recipe_columns(F.split(F.lit("Parameter,Current,Target"), ",")).alias("c")).first().c
    assert (head.current, head.target, head.delta) == (1, 2, None)
    assert one(spark, ["Taste", "taste ", "", "Look"], markdown.distinct_tests, "array<string>") == ["Taste", "Look"]
