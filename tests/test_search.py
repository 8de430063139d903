"""Stored indexes, trained models and what is learnt from labels, against exhaustive search and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cells, encoder, evals, keyword, ranker, retrieve
from millrace.plans import catalog_search
from millrace.plans.catalog_runs import stored

SF = "/root/testdata/sf0.001"


def corpus(spark, n=400, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3_000)]
    rows = [(f"c{i}", " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))) for i in range(n)] + [("cn", None), ("cd", "same words"), ("ce", "same words")]
    asked = [(q, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for q in range(25)] + [(98, None), (99, "nowhere")]
    return spark.createDataFrame(rows, "chunk_id string, text string"), spark.createDataFrame(asked + [(97, "same same words")], "query_id int, text string")


def listed(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.bm25_score, 5)) for r in df.collect())


@pytest.mark.parametrize("n", [1, 5, 40])
def test_pruned_search_is_the_exhaustive_one(spark, tmp_path, n):
    docs, asked = corpus(spark)
    index = keyword.build(docs, str(tmp_path / "index"))
    assert listed(keyword.search(index, asked, n, keep=stored(spark))) == listed(retrieve.bm25_top(docs, asked, n))


def test_common_words_only(spark, tmp_path):
    docs = spark.createDataFrame([(f"c{i}", "a b" if i % 9 else "a b c") for i in range(30)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "a c")], "query_id int, text string")
    index = keyword.build(docs, str(tmp_path / "index"))
    assert not index.terms.where("idf < 0").isEmpty()  # bounds do not hold: all is read
    assert listed(keyword.search(index, asked, 3)) == listed(retrieve.bm25_top(docs, asked, 3))


def test_no_texts(spark, tmp_path):
    docs, asked = corpus(spark)
    index = keyword.build(docs.limit(0), str(tmp_path / "index"))
    assert keyword.search(index, asked, 5).count() == 0


def test_containing(spark, tmp_path):
    docs = spark.createDataFrame([("a", "The Quick brown fox jumps"), ("b", "quick brown foxes"), ("c", None), ("d", "x\ny z")], "chunk_id string, text string")
    items = spark.createDataFrame([(1, "Quick brown fox"), (2, "ick brown fox"), (3, "fox"), (4, "brown  fox"), (5, "x\ny"), (6, "no such words here")], "query_id int, item string")
    index = keyword.build(docs, str(tmp_path / "index"))
    got = sorted((r.query_id, r.chunk_id) for r in keyword.containing(index, docs, items).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (5, "d")]


def test_few_lookups_do_not_shuffle_the_blocks(spark, tmp_path, monkeypatch, capsys):
    docs, asked = corpus(spark)
    index = keyword.build(docs, str(tmp_path / "index"))
    terms = keyword.weighted(index, asked, "query_id", "text")
    texts = keyword.found(index, terms, "query_id").select("query_id", "key", "part")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = stored(spark)(texts)
        few = keyword.looked_up(index, texts, stored(spark)(terms), "query_id")
        few.explain()
        plan = capsys.readouterr().out
        few = {tuple(r)[:2]: (round(r.more, 9), r.hits) for r in few.collect()}
        monkeypatch.setattr(keyword, "MOST_LOOKED_UP", 0)
        many = {tuple(r)[:2]: (round(r.more, 9), r.hits) for r in keyword.looked_up(index, texts, terms, "query_id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    first = next(i for i, line in enumerate(lines) if "folder" in line and "Scan parquet" in line)
    above = [line for line in lines[:first] if "SortMergeJoin" in line]
    assert few and few == many and not above


def test_share_of_postings_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    share = keyword.share_read(keyword.build(docs, str(tmp_path / "index"), "doc_id"), asked, 15, keep=stored(spark))
    total = share.agg(F.sum("entries").alias("entries"), F.sum("read").alias("read")).first()
    assert total.read < total.entries / 3


def clustered(spark, n=1_200, width=16, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width))
    rows = [(f"c{i}", ["a", "b", None][i % 3], [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [("zero", "a", [0.0] * width), ("none", "a", None)]
    df = spark.createDataFrame(rows, "chunk_id string, method string, embedding array<double>")
    return df, df.where("chunk_id rlike '7$'").select(F.col("chunk_id").alias("query_id"), "method", "embedding")


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.semantic_score) for r in df.collect())


def test_cells(spark, tmp_path):
    rows, asked = clustered(spark)
    some = rows.where("chunk_id not in ('zero', 'none')").select("chunk_id", "embedding")
    index = cells.build(rows, str(tmp_path / "cells"), cells=12)
    want = ranked(retrieve.cosine_top(some, asked.select("query_id", "embedding"), 10))
    assert ranked(cells.search(index, asked, 10, probes=1, exact=True, keep=stored(spark))) == want
    near = ranked(cells.search(index, asked, 10, probes=2))
    assert len({(q, c) for q, _, c, _ in near} & {(q, c) for q, _, c, _ in want}) >= 0.95 * len(want)
    assert 1 <= cells.probes_for(index, asked.limit(20), 5, keep=stored(spark)) <= 4


def test_cells_with_a_filter(spark, tmp_path, capsys):
    rows, asked = clustered(spark)
    index = cells.build(rows, str(tmp_path / "cells"), cells=12)
    only = rows.where("method = 'b'").select("chunk_id", "embedding")
    want = ranked(retrieve.cosine_top(only, asked.select("query_id", "embedding"), 10))
    found = cells.search(index, asked, 10, probes=1, where={"method": "b"}, exact=True, keep=stored(spark))
    assert ranked(found) == want
    # a method of few members: what the probes lack comes from the other cells
    few = cells.search(index, asked.limit(3), 400, probes=1, where={"method": {"$in": ["b"]}})
    assert {r.n for r in few.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {400}
    cells.probed(index, asked.withColumn("_q", F.col("embedding")).withColumn("cell", F.lit(1)), "query_id", {"method": "b"}, {}, 6).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "method" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cells_in_blocks_and_shelves(spark, tmp_path, monkeypatch):
    rows, asked = clustered(spark)
    same = spark.range(300).select(F.concat(F.lit("s"), F.col("id")).alias("chunk_id"), F.lit("a").alias("method"), F.array(*[F.lit(float(i % 3)) for i in range(16)]).alias("embedding"))
    rows = rows.where("chunk_id not in ('zero', 'none')").unionByName(same)
    asked = asked.unionByName(same.where("chunk_id rlike '7$'").withColumnRenamed("chunk_id", "query_id"))
    index = cells.build(rows, str(tmp_path / "few"), cells=12)
    # folders of cells with eight files each are not made for a few rows
    assert len(list((tmp_path / "few" / "vectors").rglob("*.parquet"))) <= 3
    monkeypatch.setattr(cells, "SHELF", 90)
    index = cells.build(rows, str(tmp_path / "many"), cells=12)
    assert index.centroids.where("shelves > 1").count() and index.vectors.select("shelf").distinct().count() > 12
    want = ranked(retrieve.cosine_top(rows.select("chunk_id", "embedding"), asked.select("query_id", "embedding"), 10))
    alike = ranked(retrieve.cosine_top(rows, asked, 10, match=F.col("method") == F.col("q_method")))
    for most in (2_000, 20):
        monkeypatch.setattr(cells, "MOST_BROADCAST", most)
        monkeypatch.setattr(cells, "QUERY_BLOCK", 60)
        assert ranked(cells.search(index, asked, 10, probes=1, exact=True, keep=stored(spark))) == want
        assert ranked(cells.search(index, asked, 10, probes=1, match={"method": "method"}, exact=True, keep=stored(spark))) == alike


def test_cells_of_no_vectors(spark, tmp_path):
    rows, asked = clustered(spark)
    index = cells.build(rows.limit(0), str(tmp_path / "cells"))
    assert cells.search(index, asked, 3, exact=True).count() == 0


def test_trained_encoder_finds_more_than_hashed_words(spark):
    got = {r.encoder: r for r in catalog_search.encoder_hit_rates(spark, "/root/testdata/sf0.01").collect()}
    assert got["trained"].mrr > got["hashed"].mrr and got["trained"].hit_rate_5 > got["hashed"].hit_rate_5


def test_word_vectors(spark):
    docs = spark.createDataFrame([(f"the {a} drinks {b} {i % 7}",) for i in range(60) for a, b in (("cat", "milk"), ("dog", "milk"), ("man", "tea"))] + [(None,), ("",)], "text string")
    counts = {(r.i, r.j): r.n for r in encoder.pairs(docs.limit(1), "text", ["the", "drinks", "cat"]).collect()}
    assert counts == {(0, 2): 1, (2, 0): 1, (1, 2): 1, (2, 1): 1, (0, 1): 1, (1, 0): 1}
    model = encoder.train(docs, keep=stored(spark))
    again = encoder.train(docs.repartition(5), keep=stored(spark))
    assert model.words == again.words and np.allclose(model.vectors, again.vectors, atol=1e-4)
    unit = dict(zip(model.words, model.vectors / np.linalg.norm(model.vectors, axis=1, keepdims=True), strict=True))
    assert unit["cat"] @ unit["dog"] > unit["cat"] @ unit["man"]
    v = encoder.encoder(model, spark)([None, "", "cat", "CAT ", "unheard of"])
    assert not v[:2].any() and np.allclose(v[2], v[3]) and np.allclose(np.linalg.norm(v[2:], axis=1), 1)


def test_encoder_of_nothing(spark):
    model = encoder.train(spark.createDataFrame([], "text string"))
    assert model.words == [] and encoder.encoder(model, spark)(["a", None]).shape == (2, encoder.WIDTH + encoder.OWN)


def labelled(spark, n=40):
    """Each query has five passages with all its words; in the relevant one they stand together."""
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for q in range(n):
        asked = rng.sample(vocab, 5)
        right = rng.randrange(5)
        for k in range(5):
            rest = [rng.choice(vocab) for _ in range(40)]
            if k == right:
                at = rng.randrange(30)
                rest[at:at] = asked
            else:
                for w in asked:
                    rest.insert(rng.randrange(len(rest)), w)
            rows.append((q, f"q{q}-{k}", " ".join(asked), " ".join(rest), rng.random(), rng.random(), k == right))
    return spark.createDataFrame(rows, "query_id int, chunk_id string, query_text string, text string, semantic_score double, bm25_score double, relevant boolean")


def mrr(df, truth):
    first = evals.first_hits(df.select("query_id", "chunk_id", F.col("retrieval_rank").alias("rank")), truth)
    return evals.retrieval_metrics(first).first().mrr


def test_learnt_ranker_on_held_out_queries(spark):
    rows = ranker.featured(labelled(spark))
    model = ranker.fit(rows.where("query_id % 2 = 0"))
    held = rows.where("query_id % 2 = 1")
    truth = held.where("relevant").select("query_id", "chunk_id")
    learnt, overlap = mrr(ranker.rerank(held, model), truth), mrr(retrieve.rerank(held, "query_text", "text"), truth)
    assert learnt >= 0.95 > overlap


def test_ranker_falls_back(spark):
    rows = ranker.featured(labelled(spark, 3))
    assert ranker.fit(rows.where("relevant")) is None
    by_search = [(r.query_id, r.chunk_id) for r in rows.orderBy("query_id", F.desc("semantic_score")).collect()]
    out = ranker.rerank(rows, None).orderBy("query_id", "retrieval_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in out] == by_search and all(r.rank_score is None for r in out)
    # a passage that is missing sends its query back, one candidate passes as it is
    some = ranker.featured(labelled(spark, 3).withColumn("text", F.when(F.col("chunk_id") != "q0-1", F.col("text"))).where("query_id < 2 or chunk_id = 'q2-0'"))
    got = ranker.rerank(some, ranker.fit(rows)).groupBy("query_id").agg(F.count("rank_score").alias("n")).collect()
    assert {r.query_id: r.n for r in got} == {0: 0, 1: 5, 2: 0}


def test_a_failing_scorer_leaves_the_order_of_the_search(spark):
    rows = labelled(spark, 4).where("query_id < 3 or chunk_id = 'q3-2'")

    def fails(q, t):
        raise RuntimeError("no model")

    want = [(r.query_id, r.chunk_id) for r in rows.orderBy("query_id", F.desc("semantic_score")).collect()]
    out = retrieve.rerank(rows, "query_text", "text", scorer=fails).orderBy("query_id", "retrieval_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in out] == want
    alone = retrieve.rerank(rows, "query_text", "text").where("query_id = 3").first()
    assert alone.cross_encoder_score is None and alone.retrieval_rank == 1


# ------------------------------------------------------------------ nearest neighbours by blocks


def _plain(rows, asked, n, may=lambda a, b: True):
    """cosine_top in plain Python: components summed in order, rounded half up, ties to the smaller key."""
    from decimal import ROUND_HALF_UP, Decimal

    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        length = 0.0
        for x in v:
            length += x * x
        return [x / length**0.5 for x in v] if length > 0 else None

    out = []
    for k, label, q in asked:
        u, all_ = unit(q), []
        for key, other, x in rows:
            v, s = unit(x), 0.0
            if u and v and len(u) == len(v):
                for a, b in zip(v, u, strict=True):
                    s += a * b
            if may(other, label):
                all_.append((-Decimal(repr(max(0.0, min(1.0, s)))).quantize(Decimal("0.000001"), ROUND_HALF_UP), key))
        out += [(k, key, float(-s), r) for r, (s, key) in enumerate(sorted(all_)[:n], 1)]
    return out


@pytest.mark.parametrize("dealt", [False, True])
@pytest.mark.parametrize("matched", [False, True])
def test_cosine_by_blocks_is_plain_cosine(spark, monkeypatch, dealt, matched):
    """Null, zero, short and equal vectors included, with broadcast queries and with dealt ones, few rows at once."""
    from millrace.operators import nearest

    monkeypatch.setattr(nearest, "AT_ONCE", 7)
    if dealt:
        monkeypatch.setattr(retrieve, "MOST_BROADCAST", 3)
        monkeypatch.setattr(retrieve, "QUERY_BLOCK", 5)
        monkeypatch.setattr(retrieve, "CORPUS_PART", 40)
    rng = np.random.default_rng(5)
    some = [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [-1.0, -1.0, -1.0, -1.0]]
    rows = [(f"k{i:03}", i % 3, some[i] if i < len(some) else [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    asked = [(i, i % 3, some[i] if i < len(some) else [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(12)]
    x = spark.createDataFrame(rows, "chunk_id string, label int, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, label int, embedding array<double>")
    got = retrieve.cosine_top(x, q, 6, match=F.col("label") == F.col("q_label") if matched else None)
    want = _plain(rows, asked, 6, (lambda a, b: a == b) if matched else (lambda a, b: True))
    assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "semantic_score", "rank").collect()) == sorted(want)


def test_no_pair_of_vectors_is_multiplied_by_expressions(spark):
    """A search that multiplies pair by pair in expressions took hours at size: the plan has none."""
    x = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "chunk_id long, embedding array<double>")
    plan = retrieve.cosine_top(x, x.withColumnRenamed("chunk_id", "query_id"), 2)._jdf.queryExecution().toString()
    assert "zip_with" not in plan.lower() and "zipwith" not in plan.lower()


# ------------------------------------------------------------------ keywords in one scan


def test_bm25_in_one_scan_is_the_search_of_the_index(spark, tmp_path, monkeypatch):
    """Small batches, equal texts and terms asked twice: the rows of the stored index, and of joined postings."""
    from millrace.operators import nearest

    docs, asked = corpus(spark)
    docs = docs.unionByName(docs.where("chunk_id < 'c2'").withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id"))).repartition(3)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "bm25_score", "rank").collect())
    monkeypatch.setattr(nearest, "AT_ONCE", 32)
    got = rows(retrieve.bm25_top(docs, asked, 7))
    monkeypatch.setattr(retrieve, "MOST_WEIGHTS", 0)
    assert got and got == rows(retrieve.bm25_top(docs, asked, 7))
    assert got == rows(keyword.search(keyword.build(docs, str(tmp_path / "index")), asked, 7, keep=stored(spark)))


def test_bm25_topk_shuffles_no_postings(spark, monkeypatch):
    """bm25_topk and hit_rate_mrr built an index of all postings before they asked it."""
    monkeypatch.setattr(keyword, "build", None)
    assert catalog_search.bm25_topk(spark, SF).count() > 0
    assert catalog_search.hit_rate_mrr(spark, SF).first()["n_queries"] > 0


def test_items_are_found_in_one_scan(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "two"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two"), (2, "e two t"), (3, None), (4, ""), (5, "four")], "query_id int, item string")
    got = sorted((r.query_id, r.doc_id) for r in keyword.holding(docs, items, "doc_id").collect())
    assert got == [(1, 1), (1, 3), (2, 1), (4, 1), (4, 3), (4, 4)]


def test_passages_meet_only_texts_with_their_longest_word(spark):
    """All items met all texts in a nested loop before."""
    docs, _ = corpus(spark)
    texts = {r.chunk_id: r.text for r in docs.collect()}
    rng = random.Random(5)
    items = [(i, t[a : a + rng.randint(1, 40)]) for i, t in enumerate(rng.sample([t for t in texts.values() if t], 60)) for a in [rng.randint(0, max(0, len(t) - 5))]] + [(90, "a\tb  c"), (91, None), (92, " ")]
    found = keyword.holding(docs, spark.createDataFrame(items, "query_id int, item string"))
    got = sorted((r.query_id, r.chunk_id) for r in found.collect())
    assert got == sorted((q, k) for q, i in items for k, t in texts.items() if i is not None and t is not None and i in t)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_own_directions_are_drawn_once(spark, monkeypatch):
    """Beyond 20,000 words all that a worker had drawn was thrown away again and again."""
    texts = [" ".join(f"w{i}x{j}" for j in range(1_000)) for i in range(22)]
    encode = encoder.encoder(encoder.Model([], np.zeros(0), np.zeros((0, encoder.WIDTH), np.float32)), spark)
    drawn, crc = [], encoder.zlib.crc32
    monkeypatch.setattr(encoder.zlib, "crc32", lambda b: (drawn.append(1), crc(b))[1])
    first = [encode([t]) for t in texts]
    assert all(np.array_equal(encode([t]), f) for t, f in zip(texts, first, strict=True)) and len(drawn) == 22_000
    assert not encode([None, " "]).any()
    want = sum(encoder.direction(w, encoder.OWN) for w in texts[0].split())
    assert np.allclose(first[0][0, encoder.WIDTH :], want / np.linalg.norm(want), atol=1e-5)


def test_queries_meet_rows_of_their_kind_only(monkeypatch):
    """The same candidates as with all products, of which those of other kinds are never made."""
    import pyarrow as pa

    from millrace.operators import nearest

    rng = np.random.default_rng(3)
    unit = lambda n: list((x := rng.normal(size=(n, 8))) / np.linalg.norm(x, axis=1)[:, None])
    asks = pa.table({"q": np.arange(60), "v": unit(60), "kind": rng.integers(-70, 70, 60), "cells": pa.array([[0, 2]] * 60, pa.list_(pa.int32())), "least": pa.array([None] * 60, pa.float64())})
    rows = pa.record_batch({"k": np.arange(3000), "v": unit(3000), "kind": rng.integers(-70, 70, 3000), "cell": rng.integers(0, 3, 3000).astype(np.int32)})
    most = []
    monkeypatch.setattr(nearest.Probes, "_forbid", lambda self, score, part, f=nearest.Probes._forbid: most.append(score.size) or f(self, score, part))
    found = []
    for kind in (nearest.Probes, nearest.Kinds):
        best = kind(asks, 5, 6)
        best.meet(rows)
        found.append((sorted(zip(*(c.to_pylist() for c in best.found(["q", "k", "s"]).columns), strict=True)), sum(most)))
        most.clear()
    assert found[0][0] == found[1][0] and found[0][0] and found[1][1] < found[0][1] // 20
    assert nearest.Kinds(asks, 5, 6).found(["q", "k", "s"], pa.int64()).num_rows == 0
    assert nearest.Kinds(asks.slice(0, 0), 5, 6).found(["q", "k", "s"], pa.int64()).num_rows == 0
