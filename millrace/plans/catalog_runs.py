"""Named queries over ingestion runs, the agent's tools and sessions, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import evals, generate, monitor, retrieve, tools
from millrace.plans import ingestion, report_sql, rules
from millrace.plans.catalog import _TURNS, _turns, query, table
from millrace.plans.catalog_forms import shared_folder
from millrace.plans.coach import coach, envelopes


def stored(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A keeper of frames: written to the shared folder and read back."""

    def keep(df: DataFrame) -> DataFrame:
        at = shared_folder(spark)
        df.write.parquet(at)
        return spark.read.parquet(at)

    return keep


# ------------------------------------------------------------------ ingestion

_RUN = """WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS p, doc_id % 10 = 0 AS done, coalesce(length(text), 0) > 300 AS has, (doc_id % 7) / 10.0 AS sure, {blocked} AS no FROM documents),
u AS (SELECT *, CASE WHEN NOT done THEN row_number() OVER (PARTITION BY done ORDER BY p) END AS nth FROM d), e AS (SELECT least(min(p) FILTER (WHERE nth = {cap} + 1), min(p) FILTER (WHERE no AND NOT done)) AS stop, min(p) FILTER (WHERE nth = {cap} + 1) AS full_at FROM u),
o AS (SELECT doc_id, source, CASE WHEN p > stop THEN 'not_reached' WHEN done THEN 'processed' WHEN p = full_at THEN 'capped' WHEN p = stop THEN 'blocked' WHEN NOT has THEN 'no_transcript' WHEN sure < 0.4 THEN 'low_confidence' ELSE 'ok' END AS outcome FROM u, e)"""


def _outcomes(spark, sf, cap, blocked):
    d = table(spark, sf, "documents").select("doc_id", "source", (F.coalesce(F.length("text"), F.lit(0)) > 300).alias("has"))
    return ingestion.outcomes(d, d.where("doc_id % 10 = 0"), ["source", "doc_id"], "doc_id", F.col("has"), blocked, F.col("doc_id") % 7 / 10, cap)


@query("ingest_outcomes", _RUN.format(cap=150, blocked="false") + " SELECT doc_id, outcome, outcome IN ('ok', 'no_transcript', 'low_confidence') AS mark FROM o")
def ingest_outcomes(spark, sf):
    return _outcomes(spark, sf, 150, None).select("doc_id", "outcome", "mark")


@query("ingest_stop", _RUN.format(cap=100000, blocked="doc_id % 23 = 7") + " SELECT CASE outcome WHEN 'blocked' THEN 'ip_blocked' ELSE 'max_videos_per_run' END AS reason, source, doc_id AS resume_id FROM o WHERE outcome IN ('blocked', 'capped')")
def ingest_stop(spark, sf):
    return ingestion.stop_reason(_outcomes(spark, sf, 100_000, F.col("doc_id") % 23 == 7), "source", "doc_id")


@query("quota_plan", """WITH s AS (SELECT CASE WHEN length(source) % 2 = 0 THEN 'channels' ELSE 'playlists' END AS kind, source AS id, count(*) AS cost FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM s WHERE kind = 'channels'), c1 AS (SELECT *, bool_and(used_before + 100 <= 250) OVER (ORDER BY id) AS fetched FROM c),
l AS (SELECT *, ((SELECT coalesce(sum(cost), 0) FROM c1 WHERE fetched) + coalesce(sum(cost) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS used_before FROM s WHERE kind = 'playlists'), l1 AS (SELECT *, bool_and(used_before + 1 <= 250) OVER (ORDER BY id) AS fetched FROM l)
SELECT id, used_before, fetched FROM c1 UNION ALL SELECT id, used_before, fetched FROM l1""")
def quota_plan(spark, sf):
    s = table(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("cost")).withColumn("kind", F.when(F.length("id") % 2 == 0, "channels").otherwise("playlists"))
    return ingestion.within_quota(s, "cost", "id", 250).select("id", "used_before", "fetched")


@query("metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('web', 'news', (SELECT min(source) FROM documents))")
def metadata_filter(spark, sf):
    d = table(spark, sf, "documents")
    least = d.agg(F.min("source")).first()[0]
    return d.where(retrieve.metadata_matches({"lang": "en", "source": {"$in": ["web", "news", least]}})).select("doc_id")


# ------------------------------------------------------------------ the agent's tools

_CAN = f"can2(machine, words) AS (VALUES {report_sql.values([(m, ', '.join(ps)) for m, ps in rules.AGENT_ADJUSTABLE.items()])})"


@query("tool_extract", f"WITH {report_sql.diagnosis(_TURNS)}, {_CAN} SELECT query_id, machine_type, array_to_string(s, ',') AS symptoms, hypothesis AS first_cause, confidence AS diagnostic_confidence, can2.words AS adjustable FROM d JOIN can2 ON can2.machine = machine_type")
def tool_extract(spark, sf):
    said = F.from_json("tool_result", "machine_type string, symptoms array<string>, root_causes array<struct<hypothesis:string>>, diagnostic_confidence double, adjustable_parameters array<string>")
    out = tools.extract_symptoms(_turns(spark, sf)).select("query_id", said.alias("r"))
    return out.select("query_id", "r.machine_type", F.array_join("r.symptoms", ",").alias("symptoms"), F.get("r.root_causes", F.lit(0))["hypothesis"].alias("first_cause"), "r.diagnostic_confidence", F.array_join("r.adjustable_parameters", ", ").alias("adjustable"))


_PASSAGES = "SELECT user_id AS query_id, least(1.0, value / 100) AS semantic_score, event_type AS title, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS retrieval_rank FROM events"


@query("tool_knowledge", f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank) AS r FROM ({_PASSAGES}) WHERE semantic_score >= 0.3), p AS (SELECT query_id, count(*) AS n, avg(semantic_score) AS mean, string_agg(title, ',' ORDER BY r) FILTER (WHERE r <= 5) AS titles FROM f WHERE r <= 10 GROUP BY query_id)
SELECT q.query_id, coalesce(n, 0) AS chunks_retrieved, round(coalesce(mean, 0), 6) AS avg_relevance, CASE WHEN n >= 5 THEN 'good' ELSE 'poor' END AS quality, coalesce(titles, '') AS titles FROM (SELECT DISTINCT user_id AS query_id FROM events) q LEFT JOIN p USING (query_id)""")
def tool_knowledge(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id", "value", F.least(F.lit(1.0), F.col("value") / 100).alias("semantic_score"), F.col("event_type").alias("title"), F.lit("made up").alias("channel"), F.col("props").alias("text"))
    found = retrieve.top(e, ["query_id"], "value", "event_id", 1 << 30, "retrieval_rank")
    out = tools.retrieve_knowledge(e.select("query_id").distinct().withColumn("diagnostic_confidence", F.lit(0.5)), found)
    titles = F.array_join(F.transform("top_passages", lambda p: p["title"]), ",")
    return out.select("query_id", "chunks_retrieved", F.round("avg_relevance", 6).alias("avg_relevance"), F.split_part("knowledge_quality", F.lit(":"), F.lit(1)).alias("quality"), F.coalesce(titles, F.lit("")).alias("titles"))


_KIND = f"CASE WHEN regexp_matches(low, {report_sql.text(rules.ERROR_CODE)}) THEN 'error_code' WHEN {report_sql.has('low', rules.PURCHASE + rules.SELECTION)} THEN 'purchase_advice' WHEN {report_sql.has('low', rules.SCIENCE)} THEN 'coffee_science' WHEN {report_sql.has('low', rules.RECIPE)} THEN 'recipe_request' ELSE 'general' END"
_BEFORE = "CASE question_type " + " ".join(f"WHEN {report_sql.text(k)} THEN {report_sql.text(v)}" for k, v in rules.QUESTION_TYPES.items()) + " END"


def echoed(prompts: list[str]) -> list[str]:
    return prompts


@query("tool_general", f"WITH q AS (SELECT query_id, coalesce(raw_problem, '') AS raw, lower(coalesce(raw_problem, '')) AS low FROM ({_TURNS})), k AS (SELECT query_id, raw, {_KIND} AS question_type FROM q) SELECT query_id, question_type, {_BEFORE} || 'Question: ' || raw AS answer FROM k")
def tool_general(spark, sf):
    rows = _turns(spark, sf).withColumn("question_type", tools.question_type(F.col("raw_problem")))
    return tools.answer_general_question(rows, echoed).select("query_id", "question_type", F.col("coaching_text").alias("answer"))


@query("agent_sessions", f"""WITH {report_sql.diagnosis(_TURNS)}, k AS (SELECT query_id, goal, confidence < 0.25 AND (len(s) = 0 OR machine_type = 'unknown') AS vague, machine_type, len(s) AS n FROM d)
SELECT query_id, CASE WHEN goal <> 'general' AND vague THEN 'clarification_needed' ELSE 'done' END AS status, CASE WHEN goal = 'general' THEN 'extract_symptoms,answer_general_question' WHEN vague THEN 'extract_symptoms' ELSE 'extract_symptoms,retrieve_knowledge,generate_coaching,validate_coaching' END AS calls,
CASE WHEN goal = 'general' THEN 3 WHEN vague THEN 2 ELSE 5 END AS iterations, CASE WHEN goal <> 'general' AND vague THEN CASE WHEN machine_type = 'unknown' THEN 'Which machine or brewer do you use?' ELSE 'What is wrong with the taste: bitter, sour, weak, or something else?' END END AS question FROM k""")
def agent_sessions(spark, sf):
    out = generate.Agent(tools.registry(), tools.by_rule, stored(spark)).run(_turns(spark, sf))
    asked = F.when(F.col("status") == "clarification_needed", tools.clarifying(F.col("machine_type"), F.col("symptoms")))
    return out.select("query_id", "status", F.array_join("calls", ",").alias("calls"), "iterations", asked.alias("question"))


# ------------------------------------------------------------------ sessions and evaluation


@query("session_envelopes")
def session_envelopes(spark, sf):
    return envelopes(coach(_turns(spark, sf))).drop("session_id", "symptoms")


@query("satisfaction", "SELECT count(rating) AS ratings, round(avg((rating = 'up')::INT), 4) AS satisfaction FROM (SELECT CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' END AS rating FROM events)")
def satisfaction(spark, sf):
    rating = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "view", "down")
    return monitor.satisfaction(table(spark, sf, "events").select(rating.alias("rating")))


@query("judge_first", "SELECT conv_id, turn, substr(text, 1, 3000) AS judged FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn LIMIT 15")
def judge_first(spark, sf):
    return evals.judge_sample(table(spark, sf, "conversations").where("role = 'assistant'"), ["conv_id", "turn"]).select("conv_id", "turn", F.substring("text", 1, 3000).alias("judged"))


@query("synthetic_queries", "SELECT 'q-' || doc_id AS query_id, trim('Ask, as a user would, one question that this passage answers:' || chr(10) || substr(text, 1, 1000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS synthetic_query FROM documents WHERE text IS NOT NULL")
def synthetic_queries(spark, sf):
    return evals.synthetic_queries(table(spark, sf, "documents").where("text is not null"), echoed, "doc_id").select("query_id", "synthetic_query")


@query("iso_times", "SELECT event_id, floor(epoch(ts))::BIGINT - 7200 AS seconds FROM events")
def iso_times(spark, sf):
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, sf, "events").select("event_id", F.unix_seconds(text.iso_timestamp(said)).alias("seconds"))


@query("rounded_values", "SELECT event_id, printf('%.1f', value)::DOUBLE AS tenths, printf('%.2f', event_id / 200)::DOUBLE AS halves FROM events")
def rounded_values(spark, sf):
    return table(spark, sf, "events").select("event_id", text.round_binary(F.col("value"), 1).alias("tenths"), text.round_binary(F.col("event_id") / 200, 2).alias("halves"))

