"""Learnt sentence boundaries, against plain Python over the same tables."""

import math
import re
from collections import Counter

from millrace.operators import sentences
from millrace.plans.catalog_runs import stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MARKS = sentences.MARKS
SPACE = r"[ \t\n\x0b\f\r]+"


def tokens(t):
    return [w for w in re.split(SPACE, t or "") if w]


def type_of(w):
    return re.sub(rf"[{MARKS}]+\.$", ".", re.sub(rf"^[{MARKS}]+|[{MARKS}]+$", "", w.lower()))


def bare(k):
    return k[:-1] if k.endswith(".") else k


def ll(k, n, p):
    return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)


def brute(texts):
    dotted, plain = Counter(), Counter()
    for t in texts:
        for w in tokens(t):
            k = type_of(w)
            if any(c.isalnum() for c in k):
                (dotted if k.endswith(".") else plain)[bare(k)] += 1
    total, d = sum(dotted.values()) + sum(plain.values()), sum(dotted.values())
    known = set()
    for t, a in dotted.items():
        if t[:1].isalpha():
            n, size = plain[t], len(t.replace(".", ""))
            score = -2 * (ll(a, a + n, d / total) - ll(a, a + n, 0.99)) * math.exp(-size) * (len(t) - size + 1) * float(size) ** -n
            if score >= 0.3:
                known.add(t)

    def ends(ws, i, starters):
        w, k = ws[i], bare(type_of(ws[i]))
        if not re.search(r"[.!?][\"')\]}»”’*_]*$", w):
            return False
        if not re.search(r"\.[\"')\]}»”’*_]*$", w) or not (k in known or (len(k) == 1 and k.isalpha())):
            return True
        then = ws[i + 1] if i + 1 < len(ws) else ""
        first = re.sub(r"^[\"'(\[{«“‘„*_]*", "", then)[:1]
        return first.isupper() and bare(type_of(then)) in starters

    starts, breaks = Counter(), 0
    for t in texts:
        ws = tokens(t)
        for i in range(len(ws) - 1):
            if ends(ws, i, set()):
                breaks += 1
                k = bare(type_of(ws[i + 1]))
                if k[:1].isalpha():
                    starts[k] += 1
    starters = set()
    for t, both in starts.items():
        b = dotted[t] + plain[t]
        if total / breaks > b / both:
            p, p1, p2 = b / total, both / breaks, (b - both) / (total - breaks)
            if -2 * (ll(both, breaks, p) + ll(b - both, total - breaks, p) - ll(both, breaks, p1) - ll(b - both, total - breaks, p2)) >= 30:
                starters.add(t)
    out = []
    for t in texts:
        ws, parts, now = tokens(t), [], []
        for i, w in enumerate(ws):
            now.append(w)
            if ends(ws, i, starters) or i == len(ws) - 1:
                parts.append(" ".join(now))
                now = []
        out.append(parts)
    return known, starters, out


STORY = ["Dr. Smith met Mr. Jones at 5 p.m. on Monday. He was late. The train, etc. was old! Was it? It was. J. Brown left."] * 8 + ["The cat sat there. He saw a house (big). They were big. He ran."] * 30 + [None, "", " \n "]


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    known, starters, want = brute(texts)
    counted = sentences.types(docs, "text")
    abbreviations = sentences.abbreviations(counted)
    assert {r.type for r in abbreviations.collect()} == known
    assert {r.type for r in sentences.sentence_starters(docs, "text", counted, abbreviations).collect()} == starters
    got = {r.doc_id: r.sentences for r in sentences.split(docs, sentences.learn(docs, keep=stored(spark))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    return known, starters, want


def test_equals_plain_python(spark):
    known, starters, want = check(spark, STORY)
    assert {"dr", "mr", "p.m", "etc"} <= known and starters
    assert want[0][0] == "Dr. Smith met Mr. Jones at 5 p.m. on Monday." and "J. Brown left." in want[0] and want[-2:] == [[], []]


def test_whole_smallest_table(spark):
    check(spark, [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()])


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert sentences.split(docs, sentences.learn(docs)).count() == 0


def test_chunks_end_where_sentences_do(spark):
    text = " ".join(["Dr. Smith met dr. Jones at 5 p.m. daily and they spoke of many things until it was dark outside."] * 40)
    docs = spark.createDataFrame([("s", text)], "source_id string, text string")
    learnt = sentences.learn(spark.createDataFrame([(t,) for t in STORY], "text string"))
    rows = sentences.chunk_documents(docs, learnt, "text", "source_id").orderBy("chunk_no").collect()
    assert len(rows) > 2 and all(r.chunk_text.startswith("Dr. Smith") and r.chunk_text.endswith("outside.") for r in rows)


def test_texts_are_read_twice_to_learn(spark):
    """Once for the types, once for what follows sure ends; before, the starters' frame was computed twice, and twice within."""
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    docs = spark.createDataFrame([(t,) for t in STORY], "text string").select(F.udf(seen, "string")("text").alias("text"))
    sentences.learn(docs, keep=stored(spark))
    assert read.value <= 2 * len(STORY)
