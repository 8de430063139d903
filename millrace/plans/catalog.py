"""Named queries over the driver's tables, and the SQL that gives the same rows.

The driver's texts are invented, so rule vocabularies come from here (LEXICON and the lists below);
operators take them as parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import corpus, text
from millrace.operators import classify, evals, gates, markdown, monitor, retrieve, sequence
from millrace.operators.diagnose import diagnose, retrieval_query
from millrace.operators.extract import extract, scope
from millrace.operators.generate import coaching_prompt, template_text
from millrace.plans import report_sql
from millrace.plans.coach import coach
from millrace.plans.rules import EXPLANATION, SPECIFIC, VALIDATION
from millrace.sources.logs import ingestion_report, markdown_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LEXICON = {"first": ["the", "that"], "second": ["with", "this"], "third": ["and", "of"], "fourth": ["was"]}
SIGNALS = ["the", "with", "tion", "that", "ing ", "zu"]
VOCABULARY = ["the", "with", "café", "that"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ search

_COS = "round(greatest(0, least(1, list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
_KNN = "SELECT query_id, vec_id, semantic_score, rank FROM (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, {c} AS semantic_score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {c} DESC, x.vec_id) AS rank FROM embeddings x, embeddings q WHERE q.vec_id % 50 = 0{m}) WHERE rank <= 10"


@query("knn_batch", _KNN.format(c=_COS, m=""))
def knn_batch(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = x.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieve.cosine_top(x, q, 10, "vec_id")


@query("knn_filtered", _KNN.format(c=_COS, m=" AND x.label = q.label"))
def knn_filtered(spark, sf):
    x = table(spark, sf, "embeddings")
    q = x.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieve.cosine_top(x, q, 10, "vec_id", match=F.col("label") == F.col("q_label"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_batch(spark, sf_dir)


_BM25 = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents), n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
t AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM d), p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM t GROUP BY term, doc_id),
r AS (SELECT term, ln((n.n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p, n GROUP BY term, n.n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id AS query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score FROM p JOIN q USING (term) JOIN idf USING (term), n GROUP BY item_id, doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS rank FROM s) WHERE rank <= 15)"""


@query("bm25_postings", r"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM documents) GROUP BY term, doc_id) GROUP BY term")
def bm25_postings(spark, sf):
    return retrieve.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


_LISTS = """WITH e AS (SELECT ts::DATE::VARCHAR AS day, user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value), 2) AS spent FROM events GROUP BY 1, 2),
a AS (SELECT * FROM (SELECT day, user_id, row_number() OVER (PARTITION BY day ORDER BY clicks DESC, user_id) AS rank FROM e) WHERE rank <= 10),
b AS (SELECT * FROM (SELECT day, user_id, row_number() OVER (PARTITION BY day ORDER BY spent DESC, user_id) AS rank FROM e) WHERE rank <= 10),
f AS (SELECT day, user_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score, min(k) AS k FROM (SELECT *, rank AS k FROM a UNION ALL SELECT *, rank + 1000 AS k FROM b) GROUP BY day, user_id)"""


@query("rrf_hybrid", _LISTS + " SELECT day, user_id, rrf_score, row_number() OVER (PARTITION BY day ORDER BY rrf_score DESC, k, user_id) AS rank FROM f")
def rrf_hybrid(spark, sf):
    e = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.sum("value"), 2).alias("spent"))
    a, b = (retrieve.top(e, ["day"], c, "user_id", 10).select("day", "user_id", "rank") for c in ("clicks", "spent"))
    return retrieve.fuse([a, b], "day", "user_id").select("day", "user_id", "rrf_score", "rank")


_HITS = _BM25 + ", tr AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), fh AS (SELECT t.query_id, min(bm.rank) AS first_hit FROM (SELECT DISTINCT query_id FROM tr) t LEFT JOIN (SELECT bm.* FROM bm SEMI JOIN tr USING (query_id, doc_id)) bm USING (query_id) GROUP BY t.query_id)"


@query("experiment_winner", "WITH m AS (SELECT event_type, round(avg(value), 3) AS a, count(*) AS b FROM events GROUP BY event_type) SELECT event_type AS winner, a, b, CASE WHEN a >= 0.55 AND b >= 0.45 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m ORDER BY a DESC, b DESC LIMIT 1")
def experiment_winner(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("a"), F.count("*").alias("b")).withColumn("seq", F.lit(0))
    return evals.winner(m, "event_type", "a", "b", "seq")


@query("retrieve_hybrid")
def retrieve_hybrid(spark, sf):
    """Chunks of all documents, hashed embeddings, both searches, fusion, re-ranking by overlap."""
    from millrace.plans.catalog_runs import stored  # that module reads this one

    keep = stored(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text", F.col("lang").alias("method"))
    # cut, de-duplicated and encoded once: the searches read it eight times
    chunks = keep(corpus.chunk_documents(docs, "text", "source_id").dropDuplicates(["chunk_id"]).select("chunk_id", "method", F.col("chunk_text").alias("text")))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("unknown").alias("machine_type"))
    store = keep(retrieve.embed(chunks, "text").withColumn("method", F.lit("general")))
    return retrieve.retrieve(store, retrieve.embed(q, "text"), mode="hybrid").select("query_id", "chunk_id", "semantic_score", "bm25_score", "rrf_score", "cross_encoder_score", "retrieval_rank")


# ------------------------------------------------------------------ texts


@query("collection_stats", """SELECT 'total' AS measure, NULL::VARCHAR AS value, count(*) AS n FROM documents UNION ALL SELECT 'sources', NULL, count(DISTINCT source) FROM documents UNION ALL SELECT 'channels', NULL, count(DISTINCT lang) FROM documents
UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2""")
def collection_stats(spark, sf):
    return monitor.collection_stats(table(spark, sf, "documents"), "source", "lang", ["lang", "source"])


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[\d{1,2}:\d{2}(?::\d{2})?\]|<\d{1,2}:\d{2}(?::\d{2})?>|\(\d{1,2}:\d{2}(?::\d{2})?\)|\d{1,2}:\d{2}:\d{2}\s*', ' ', 'g'), '(?i)\buh\b|\bum\b|\byou know\b|\blike i said\b|\bkind of\b|\bsort of\b|\bi mean\b|\bright\?\s*|\bokay so\b', ' ', 'g'), '([a-z,]{3,})\s+([A-Z][a-z])', '\1. \2', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


#: In this SQL a word ends at an accented letter; between marks of capital letters it does not.
_MARKED = "regexp_replace(text, '([^\\P{L}a-zA-Z])', 'ZQZ\\1ZQZ', 'g')"
_CLEAN_ALL = "regexp_replace(" + _CLEAN.replace("(text,", f"({_MARKED},") + ", 'ZQZ(.)ZQZ', '\\1', 'g')"


@query("clean_text", f"SELECT doc_id, {_CLEAN_ALL} AS clean FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", corpus.cleaned(F.col("text")).alias("clean"))


@query("clean_text_all")
def clean_text_all(spark, sf):
    """All languages; no SQL, since word boundaries at accented letters differ there."""
    return table(spark, sf, "documents").select("doc_id", corpus.cleaned(F.col("text")).alias("clean"))


_SENTENCES = f"""WITH RECURSIVE c AS (SELECT doc_id, {_CLEAN_ALL} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS ts FROM c),
w AS (SELECT doc_id, flatten(list_transform(ts, lambda x: CASE WHEN len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) > 300 THEN [array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')[1:len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) // 2], ' '),
  array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')[len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) // 2 + 1:], ' ')] ELSE [x] END)) AS ts FROM s),
n AS (SELECT doc_id, ts, list_transform(ts, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''))) AS ns FROM w WHERE len(ts) > 0),
p AS (SELECT doc_id, ts, list_transform(range(0, len(ns) + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)::INT) AS p FROM n),
k(doc_id, nth, a, b, p) AS (SELECT doc_id, 0, 0, coalesce(list_filter(range(1, len(p) - 1), lambda j: p[j + 2] > 300)[1], len(p) - 1)::INT, p FROM p
UNION ALL SELECT doc_id, nth + 1, s, coalesce(list_filter(range(b + 1, len(p) - 1), lambda j: p[j + 2] - p[s + 1] > 300)[1], len(p) - 1)::INT, p FROM (SELECT *, coalesce(list_filter(range(a, b), lambda q: p[b + 1] - p[q + 1] <= 60)[1], b)::INT AS s FROM k WHERE b < len(p) - 1)),
o AS (SELECT k.doc_id, nth, array_to_string(p.ts[a + 1:b], ' ') AS chunk FROM k JOIN p USING (doc_id) WHERE k.p[b + 1] - k.p[a + 1] >= 40)"""


@query("chunk_documents", _SENTENCES + """ SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1)::INT AS chunk_no, concat(doc_id::VARCHAR, '_', substr(sha256(regexp_replace(substr(chunk, 1, 200), '^\\s+|\\s+$', '', 'g')), 1, 8)) AS chunk_id, length(chunk)::INT AS n_chars FROM o""")
def chunk_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.chunk_documents(docs, "text", "doc_id").select("doc_id", "chunk_no", "chunk_id", F.length("chunk_text").alias("n_chars"))


@query("chunk_ids", r"SELECT doc_id, concat(doc_id::VARCHAR, '_', substr(sha256(regexp_replace(substr(text, 1, 200), '^\s+|\s+$', '', 'g')), 1, 8)) AS chunk_id FROM documents")
def chunk_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.chunk_id(F.col("doc_id").cast("string"), F.col("text")).alias("chunk_id"))


@query("informative_filter", "SELECT doc_id FROM documents WHERE " + " + ".join(f"contains(lower(text), '{s}')::INT" for s in SIGNALS) + " >= 2")
def informative_filter(spark, sf):
    return table(spark, sf, "documents").where(corpus.informative(F.col("text"), SIGNALS)).select("doc_id")


def _score_sql(words: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(t, '(?i)\\b{w}\\b'))" for w in words)


_CLASSES = "WITH d AS (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 1000), '[^\\P{L}a-zA-Z]', 'Q', 'g') AS t FROM documents), s AS (SELECT doc_id, " + ", ".join(f"({_score_sql(ws)})::DOUBLE AS {c}" for c, ws in LEXICON.items()) + " FROM d), m AS (SELECT *, greatest(first, second, third, fourth) AS top, first + second + third + fourth AS total FROM s)"


@query("classify_domain", _CLASSES + " SELECT m.doc_id, CASE WHEN total = 0 THEN 'general' WHEN first = top THEN 'first' WHEN second = top THEN 'second' WHEN third = top THEN 'third' ELSE 'fourth' END AS domain, CASE WHEN total = 0 THEN 0 ELSE round(top / total, 6) END AS classification_confidence, CASE WHEN regexp_matches(lower(t), '\\bwas\\b') THEN 'advanced' WHEN regexp_matches(lower(t), '\\bthis\\b') THEN 'beginner' ELSE 'intermediate' END AS difficulty FROM m JOIN d USING (doc_id)")
def classify_domain(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    out = classify.classify(docs, LEXICON, LEXICON, ["was"], ["this"])
    return out.select("doc_id", "domain", F.round("classification_confidence", 6).alias("classification_confidence"), "difficulty")


@query("relevance_rank", _CLASSES + " SELECT doc_id, total AS relevance, row_number() OVER (ORDER BY total DESC, doc_id) AS rank FROM m WHERE total > 0")
def relevance_rank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return classify.ranked_by_relevance(docs, "doc_id", domains=LEXICON, methods={"none": []}).select("doc_id", "relevance", "rank")


@query("classify_domain_all")
def classify_domain_all(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    out = classify.classify(docs, LEXICON, LEXICON, ["was"], ["this"])
    return out.select("doc_id", "domain", F.round("classification_confidence", 6).alias("classification_confidence"), "difficulty")


@query("relevance_rank_all")
def relevance_rank_all(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return classify.ranked_by_relevance(docs, "doc_id", domains=LEXICON, methods={"none": []}).select("doc_id", "relevance", "rank")


@query("dedup_docs", "SELECT sha256(text) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_docs(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("tag_union", "SELECT doc_id, CASE WHEN lang = 'en' THEN concat_ws(',', lang, source) ELSE concat_ws(',', lang, source, 'en') END AS tags FROM documents")
def tag_union(spark, sf):
    both = text.ordered_union(F.array("lang", "source"), F.array("source", F.lit("en")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(both, ",").alias("tags"))


# ------------------------------------------------------------------ conversations

_SCOPE = r"""WITH h AS (SELECT *, len(list_intersect(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-z0-9]+'), ['the', 'with', 'cafe', 'that'])) > 0 AS hit FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) > 1500 THEN 'too_long' WHEN hit OR coalesce(max(CASE WHEN hit AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'ok' ELSE 'off_topic' END AS reason FROM h"""


@query("scope_guard", _SCOPE)
def scope_guard(spark, sf):
    return scope(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", VOCABULARY).select("conv_id", "turn", "reason")


@query("last6_turns", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id, count(*) FILTER (WHERE r <= 6) AS n_recent, coalesce(string_agg(role || ': ' || substr(text, 1, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END, chr(10) ORDER BY turn) FILTER (WHERE r > 6), '') AS summary FROM t GROUP BY conv_id""")
def last6_turns(spark, sf):
    return sequence.history(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.size("recent").cast("long").alias("n_recent"), "summary")


@query("merged_turns", """WITH c AS (SELECT *, CASE WHEN role = 'user' THEN 'user' ELSE role || turn END AS k FROM conversations), i AS (SELECT *, sum(CASE WHEN k IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c))
SELECT conv_id, island, min(turn) AS turn, count(*) AS n FROM i GROUP BY conv_id, island""")
def merged_turns(spark, sf):
    kind = F.when(F.col("role") == "user", "user").otherwise(F.concat("role", F.col("turn").cast("string")))
    return sequence.islands(table(spark, sf, "conversations"), ["conv_id"], ["turn"], kind).groupBy("conv_id", "island").agg(F.min("turn").alias("turn"), F.count("*").alias("n"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_CHECKS = r"WITH c AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) BETWEEN 120 AND 700 AS a, " + " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in SPECIFIC) + f" >= 2 AS b, {_any(VALIDATION)} AS c, {_any(EXPLANATION)} AS d, contains(text, chr(10)) OR len(regexp_extract_all(text, '\\. ')) >= 3 AS e FROM conversations WHERE role = 'assistant'), n AS (SELECT *, (a::INT + b::INT + c::INT + d::INT + 1 + e::INT) AS ok FROM c)"


def _gated(spark, sf):
    return gates.post_gate(table(spark, sf, "conversations").where("role = 'assistant'"), "text")


@query("gates_post", _CHECKS + " SELECT conv_id, turn, round(ok / 6.0::DOUBLE, 2) AS overall_score, CASE WHEN NOT (a AND b AND c) THEN 'fail' WHEN ok >= 5 THEN 'pass' ELSE 'warn' END AS verdict FROM n")
def gates_post(spark, sf):
    return _gated(spark, sf).select("conv_id", "turn", "post.overall_score", "post.verdict")


@query("failed_checks", _CHECKS + """ SELECT k AS "check", count(*) AS n_failed FROM (SELECT unnest([CASE WHEN NOT a THEN 'appropriate_length' END, CASE WHEN NOT b THEN 'specific_enough' END, CASE WHEN NOT c THEN 'has_validation_test' END, CASE WHEN NOT d THEN 'explains_root_cause' END, CASE WHEN NOT e THEN 'has_structure' END]) AS k FROM n) WHERE k IS NOT NULL GROUP BY k""")
def failed_checks(spark, sf):
    return evals.failed_checks(_gated(spark, sf).select(F.lit(1).alias("one"), "post.checks"), "one").select("check", "n_failed")


@query("style_metrics", _CHECKS + ", v AS (SELECT conv_id % 3 AS style, round(ok / 6.0::DOUBLE, 2) AS s, CASE WHEN NOT (a AND b AND c) THEN 'fail' WHEN ok >= 5 THEN 'pass' ELSE 'warn' END AS v, turn > 5 AS bad FROM n) SELECT style, printf('%.3f', count(*) FILTER (WHERE v = 'pass' AND NOT bad) / greatest(count(*) FILTER (WHERE NOT bad), 1)::DOUBLE)::DOUBLE AS pass_rate, printf('%.3f', coalesce(avg(s) FILTER (WHERE NOT bad), 0))::DOUBLE AS mean_score, count(*) FILTER (WHERE bad) AS errors, 0::BIGINT AS unscored, count(*) FILTER (WHERE NOT bad) AS n_scored FROM v GROUP BY style")
def style_metrics(spark, sf):
    rows = _gated(spark, sf).select((F.col("conv_id") % 3).alias("style"), "post.overall_score", "post.verdict", (F.col("turn") > 5).alias("error"))
    return evals.style_metrics(rows)


# ------------------------------------------------------------------ analytics on events


@query("headline", "SELECT count(*) AS sessions, round(avg((event_type = 'purchase')::INT), 4) AS pass_rate, round(avg((event_type = 'error')::INT), 4) AS out_of_scope_rate FROM events")
def headline(spark, sf):
    return monitor.headline(table(spark, sf, "events"), F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("sessions_per_day", "SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def sessions_per_day(spark, sf):
    return monitor.per_day(table(spark, sf, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("verdict_hist", "SELECT coalesce(event_type, 'n/a') AS value, count(*) AS n FROM events GROUP BY 1")
def verdict_hist(spark, sf):
    return monitor.histogram(table(spark, sf, "events"), "event_type", default="n/a")


@query("symptom_hist", "SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '[a-z]+')) AS value FROM events) GROUP BY value")
def symptom_hist(spark, sf):
    e = table(spark, sf, "events").select(F.explode(F.regexp_extract_all("props", F.lit("([a-z]+)"), F.lit(1))).alias("v"))
    return monitor.histogram(e, "v", drop_null=True)


_PIVOT = "SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY 1"


@query("pivot_feedback", _PIVOT)
def pivot_feedback(spark, sf):
    return monitor.pivoted(table(spark, sf, "events").where(F.col("event_type").isin("click", "error")), F.to_date("ts").cast("string"), "event_type", ["click", "error"])


@query("unpivot", f"WITH p AS ({_PIVOT}) SELECT day, 'click' AS series, click AS n FROM p UNION ALL SELECT day, 'error', error FROM p")
def unpivot(spark, sf):
    return monitor.unpivoted(pivot_feedback(spark, sf), ["day"], ["click", "error"])


@query("recent_k", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_k(spark, sf):
    return monitor.recent(table(spark, sf, "events"), "ts", 10, "event_id").select("event_id", "event_type")


@query("last7days", "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events WHERE ts::DATE > (SELECT max(ts::DATE) FROM events) - 7 GROUP BY 1, 2")
def last7days(spark, sf):
    return monitor.last_days(table(spark, sf, "events"), "ts", 7).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("session_feedback_join", "SELECT s.user_id, s.n, f.errors FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) s LEFT JOIN (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 50 GROUP BY 1) f USING (user_id)")
def session_feedback_join(spark, sf):
    e = table(spark, sf, "events")
    s = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return monitor.with_feedback(s, e.where("event_type = 'error' and value > 50").groupBy("user_id").agg(F.count("*").alias("errors")), "user_id")


@query("quota_cutoff", "SELECT user_id, event_id, used FROM (SELECT *, max((used > 500)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM (SELECT user_id, event_id, sum(ceil(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS used FROM events)) WHERE o = 0")
def quota_cutoff(spark, sf):
    return sequence.within_budget(table(spark, sf, "events"), ["user_id"], ["event_id"], F.ceil("value"), 500).select("user_id", "event_id", "used")


@query("run_cap_resume", "WITH d AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth <= 12) SELECT user_id, min(event_id) AS resume_key, count(*) AS \"left\" FROM events ANTI JOIN d USING (event_id) GROUP BY user_id")
def run_cap_resume(spark, sf):
    e = table(spark, sf, "events")
    return sequence.resume_points(e, sequence.capped(e, ["user_id"], ["event_id"], 12), ["user_id"], "event_id", "event_id")


@query("daily_budget", "SELECT event_id, day_nth, session_nth, day_nth <= 25 AND session_nth <= 9 AS served FROM (SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS day_nth, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_nth FROM events)")
def daily_budget(spark, sf):
    return sequence.budget_left(table(spark, sf, "events"), "ts", "event_id", 25, 9, "user_id").select("event_id", "day_nth", "session_nth", "served")


@query("anti_processed", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def anti_processed(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("upsert_latest", "SELECT doc_id, CASE WHEN quality = 0 THEN 9 ELSE quality END AS quality, toxic FROM labels UNION ALL SELECT doc_id + 1000000, 9, toxic FROM labels WHERE quality = 0")
def upsert_latest(spark, sf):
    old = table(spark, sf, "labels")
    new = old.where("quality = 0").withColumn("quality", F.lit(9))
    return sequence.upserted(old, new.unionByName(new.withColumn("doc_id", F.col("doc_id") + 1000000)), "doc_id")


@query("keep_max_dedupe", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def keep_max_dedupe(spark, sf):
    return sequence.keep_heaviest(table(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("plan_topk", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 4")
def plan_topk(spark, sf):
    return retrieve.top(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 4).select("o_custkey", "o_orderkey", "rank")


@query("labels_shown", "SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS label, CASE WHEN value = floor(value) THEN floor(value)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', value), '0'), '.') END AS amount FROM events")
def labels_shown(spark, sf):
    return table(spark, sf, "events").select("event_id", text.humanized(F.col("event_type"), {}).alias("label"), text.number_text(F.col("value")).alias("amount"))


# ------------------------------------------------------------------ markdown

_MD = "'intro ' || source || chr(10) || '# One' || chr(10) || text || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '**Two:**' || chr(10) || '| a | ' || lang || ' |'"


def _marked(spark, sf):
    t = F.concat(F.lit("intro "), "source", F.lit("\n# One\n"), "text", F.lit("\n```\n# code\n```\n**Two:**\n| a | "), "lang", F.lit(" |"))
    return table(spark, sf, "documents").select("doc_id", "lang", t.alias("md"))


@query("markdown_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS i FROM (SELECT doc_id, """ + _MD + r""" AS md FROM documents)),
f AS (SELECT *, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fence FROM l),
h AS (SELECT *, CASE WHEN NOT fence AND regexp_matches(line, '^\s{0,3}(#{1,6})\s+(.*\S)\s*$') THEN trim(regexp_extract(line, '^\s{0,3}(#{1,6})\s+(.*\S)\s*$', 2)) WHEN NOT fence AND line = '**Two:**' THEN 'Two' END AS heading FROM f),
s AS (SELECT *, sum((heading IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i)::INT AS section FROM h) SELECT doc_id, section, max(heading) AS title, count(*) FILTER (WHERE heading IS NULL) AS n_lines FROM s GROUP BY doc_id, section""")
def markdown_sections(spark, sf):
    return markdown.sections(_marked(spark, sf), "doc_id", "md").select("doc_id", "section", "title", "n_lines")


@query("table_rows", "SELECT doc_id, 'a' AS first, lang AS second FROM documents")
def table_rows(spark, sf):
    rows = markdown.lines(_marked(spark, sf), "doc_id", "md").where(F.col("line").startswith("| a |")).withColumn("cells", markdown.table_cells(F.col("line")))
    return rows.select("doc_id", F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"))


# ------------------------------------------------------------------ rules and generation


#: What users of these tables never say: an ending for each turn, by its place, so that all rules meet whole texts.
ENDINGS = [
    "", "My DeLonghi Dinamica makes bitter espresso, 28 second extraction, roasted 5 weeks ago", "My moka pot makes burnt bitter coffee, it is harsh", "My Nespresso Vertuo is bitter and sour", "my Gaggia Classic is sour, 18 seconds, 19g dose", "V60, Ethiopian light roast, tastes too sour, 22s extraction, 15g dose",
    "I want to learn how to make it better", "18g, 90 celsius, light roast on a Breville Bambino, 40 seconds", "Which grinder should I get?", "aeropress is weak, beans 60 days old", "error E4 on my Jura E8", "lever shot with channeling and no crema, dark roast, 96 degrees C, ratio 1:2.5, setting 12", "french press tastes flat and too strong",
    "give me a recipe", "kalita runs too fast, 300 seconds", "moka pot, 90 seconds, overwhelming and dry", "gushing espresso, different every time, no flow", "my rancilio silvia: 12g, 20 seconds, dark roast, 96 celsius, roasted 30 days ago",
]


def _turns(spark, sf):
    """Reports from all turns of users: their whole text and an ending."""
    said = F.concat_ws(" ", "text", F.get(F.array(*map(F.lit, ENDINGS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ENDINGS))).cast("int")))
    return table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), said.alias("raw_problem"))


_TURNS = f"SELECT conv_id || '-' || turn AS query_id, concat_ws(' ', text, list_extract([{', '.join(map(report_sql.text, ENDINGS))}], ((conv_id + turn) % {len(ENDINGS)} + 1)::INT)) AS raw_problem FROM conversations WHERE role = 'user'"


@query("extract_features", report_sql.extract_sql(_TURNS))
def extract_features(spark, sf):
    return extract(_turns(spark, sf)).drop("raw_problem").withColumn("symptoms", F.array_join("symptoms", ","))


def _listed(plan: str = "plan"):
    show = lambda s: F.concat_ws(" ", s["step"].cast("string"), F.coalesce(s["parameter"], F.lit("-")), F.coalesce(s["direction"], F.lit("-")), F.coalesce(s["magnitude"], F.lit("-")), F.concat(s["priority"], F.lit(":")), s["action"])
    return F.array_join(F.transform(plan, show), "; ")


@query("diagnose_reports", report_sql.diagnose_sql(_TURNS))
def diagnose_reports(spark, sf):
    d = diagnose(extract(_turns(spark, sf)))
    causes = F.array_join(F.transform("root_causes", lambda c: F.format_string("%s=%.2f/%s", c["hypothesis"], c["probability"], F.coalesce(c["parameter_affected"], F.lit("-")))), ",")
    return d.select("query_id", "route", F.array_join("symptoms", ",").alias("symptoms"), causes.alias("causes"), _listed().alias("plan"), "diagnostic_confidence", F.array_join("warnings", " ").alias("warnings"), retrieval_query().alias("retrieval_query"))


@query("gates_pre", report_sql.gate_sql(_TURNS))
def gates_pre(spark, sf):
    g = gates.pre_gate(diagnose(extract(_turns(spark, sf))))
    names = ["symptoms_detected", "root_causes_present", "intervention_plan_present", "confidence_sufficient", "machine_identified", "interventions_feasible"]
    return g.select("query_id", *[F.col("pre.checks")[n].alias(n) for n in names], "pre.overall_score", "pre.verdict")


@query("prompt_reports")
def prompt_reports(spark, sf):
    d = diagnose(extract(_turns(spark, sf)))
    return d.select("query_id", template_text().alias("demo_text"), coaching_prompt("concise", F.lit(None).cast("string")).alias("prompt"))


@query("coach_reports")
def coach_reports(spark, sf):
    return coach(_turns(spark, sf)).select("query_id", "status", "reason", "coaching_text", "verdict", F.col("pre.verdict").alias("pre_verdict"))


@query("ingestion_report")
def ingestion(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("domain"), F.lit(None).cast("string").alias("method"), F.col("source").alias("channel"))
    return ingestion_report(docs, kind="fixture")


@query("metrics_markdown", "SELECT '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) AS markdown FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def metrics_markdown(spark, sf):
    return markdown_table(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), ["event_type", "n"], "event_type")
