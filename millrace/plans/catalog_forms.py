"""Named queries over text forms, markdown, logs, stores and evaluation, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import present, text
from millrace.operators import evals, generate, markdown, monitor, retrieve
from millrace.operators.diagnose import diagnose
from millrace.operators.extract import extract
from millrace.plans import experiments, report_sql, rules
from millrace.plans.coach import coach
from millrace.plans.catalog import _TURNS, _turns, query, table
from millrace.sources import logs
from millrace.sources.listing import document_rows
from millrace.sources.store import ChunkStore


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="millrace-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/demo-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ text, numbers, times


@query("number_forms", """SELECT event_id, CASE WHEN value = floor(value) THEN floor(value)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', value), '0'), '.') END AS amount, (user_id % 101)::INT || '%' AS share, greatest(10.0, least(50.0, value))::DOUBLE AS clamped,
strftime(ts, '%d %b %H:%M') AS short_time, coalesce(CASE WHEN event_id % 7 = 0 THEN 3.0 END, pow(2.0, event_id % 5) + 0.25)::DOUBLE AS wait, ((event_id % 2) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 50)::INT AS seconds, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS title,
CASE WHEN event_id % 20 < 4 THEN 180 WHEN event_id % 20 > 6 THEN 260 ELSE 70 + event_id % 20 * 28 END::INT AS height FROM events""")
def number_forms(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    whole = lambda n: F.pmod(i, F.lit(n)).cast("int").cast("string")
    length = F.concat(F.lit("P"), whole(2), F.lit("DT"), whole(24), F.lit("H"), whole(60), F.lit("M"), whole(50), F.lit("S"))
    return e.select(
        "event_id", text.number_text(F.col("value")).alias("amount"), text.percent_text(F.pmod(F.col("user_id"), F.lit(101)) / 100).alias("share"), text.clamp(F.col("value"), 10.0, 50.0).alias("clamped"), text.short_time(F.col("ts")).alias("short_time"),
        text.retry_delay(F.pmod(i, F.lit(5)).cast("double"), F.when(i % 7 == 0, 3.0), F.lit(0.25)).alias("wait"), text.duration_seconds(length).cast("int").alias("seconds"), text.title_case(F.col("event_type")).alias("title"), monitor.chart_height(F.pmod(i, F.lit(20)).cast("int")).cast("int").alias("height"),
    )


@query("reply_forms", r"""SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, 'answer ' || source AS answer, (doc_id % 9)::INT AS mark,
list_distinct_ordered AS tags FROM (SELECT *, array_to_string(list_filter([source, lang, 'x'], lambda v, i: v IS NOT NULL AND list_position([source, lang, 'x'], v) = i), ',') AS list_distinct_ordered FROM documents)""")
def reply_forms(spark, sf):
    d = table(spark, sf, "documents")
    reply = F.concat(F.lit("<think>"), F.coalesce(F.col("text"), F.lit("")), F.lit("</think> \n answer "), "source")
    said = F.concat(F.lit('Here it is: {"mark": '), F.pmod("doc_id", F.lit(9)).cast("string"), F.lit("} as you asked"))
    tags = text.ordered_union(F.array_compact(F.array("source", "lang")), F.array_compact(F.array(F.lit("x"), "source")))
    return d.select("doc_id", text.html_escaped(F.coalesce("text", F.lit(""))).alias("html"), text.without_reasoning(reply).alias("answer"), F.try_variant_get(text.json_in(said), "$.mark", "int").alias("mark"), F.array_join(tags, ",").alias("tags"))


_HYPOTHESES = [h for h, in sorted({(row[0],) for rows in rules.CAUSES.values() for row in rows})]


def _label_sql(column: str) -> str:
    shown = f"trim(regexp_replace(translate({column}, '_-', '  '), '\\s+', ' ', 'g'))"
    known = " ".join(f"WHEN {report_sql.text(k)} THEN {report_sql.text(v)}" for k, v in rules.LABELS.items())
    return f"CASE lower({shown}) {known} ELSE upper(substr({shown}, 1, 1)) || substr({shown}, 2) END"


@query("claims", f"""WITH h AS (SELECT query_id, split_part(causes, '=', 1) AS hypothesis FROM ({report_sql.diagnose_sql(_TURNS)}) WHERE causes <> ''), l AS (SELECT query_id, hypothesis, {_label_sql('hypothesis')} AS label FROM h)
SELECT query_id, hypothesis, CASE WHEN regexp_matches(label, '(?i)^.+?\\s+too\\s+.+$') AND NOT regexp_matches(label, '(?i)^too\\b') THEN 'Your ' || lower(trim(regexp_extract(label, '(?i)^(.+?)\\s+too\\s+(.+)$', 1))) || ' is probably too ' || lower(trim(regexp_extract(label, '(?i)^(.+?)\\s+too\\s+(.+)$', 2))) || '.' ELSE 'Most likely cause: ' || lower(label) || '.' END AS claim FROM l""")
def claims(spark, sf):
    found = diagnose(extract(_turns(spark, sf))).select("query_id", F.get("root_causes", F.lit(0))["hypothesis"].alias("hypothesis")).where("hypothesis is not null")
    return found.select("query_id", "hypothesis", present.claim(F.col("hypothesis")).alias("claim"))


@query("measured_values", f"""WITH {report_sql.features(_TURNS)}, n AS (SELECT query_id, grind_size, t, temp, dose FROM f), amount AS (SELECT *, CASE WHEN temp = floor(temp) THEN floor(temp)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', temp), '0'), '.') END || '°C' AS water_temp,
CASE WHEN dose = floor(dose) THEN floor(dose)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', dose), '0'), '.') END || ' g' AS dose_text FROM n) SELECT query_id, grind_size, water_temp, dose_text AS dose, t || ' s' AS time, '1 notch finer' AS change FROM amount""")
def measured_values(spark, sf):
    f = extract(_turns(spark, sf))
    return f.select("query_id", *[present.current_value(F.lit(p)).alias(p) for p in ("grind_size", "water_temp", "dose", "time")], present.target_phrase(F.lit("finer"), F.lit("1 notch")).alias("change"))


# ------------------------------------------------------------------ markdown


def _guides(spark, sf) -> DataFrame:
    """A guide for each document: text before any heading, steps, a science section, a test, a recipe and parameter lines."""
    head = F.concat(F.lit("intro\n## Step 1: "), F.coalesce("lang", F.lit("-")), F.lit("\nCurrent: "), "source", F.lit("\nTarget: **"), F.coalesce("lang", F.lit("none")), F.lit("**\n| Parameter | Now | Goal |\n|---|---|---|\n| dose | 1 | 2 |\n"))
    rest = F.concat(F.lit("## 2. Why it works\n"), F.repeat(F.lit("word "), F.pmod("doc_id", F.lit(80)).cast("int")), F.lit("\n## How to verify\nMeasure TDS with a refractometer\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(head, F.when(F.col("doc_id") % 3 > 0, rest).otherwise("")).alias("md"))


@query("guide_layouts", """SELECT doc_id, s.section, s.title, CASE WHEN s.section = 2 AND doc_id % 80 < 40 THEN 'step' ELSE s.layout END AS layout FROM (SELECT doc_id, lang, unnest([{'section': 0, 'title': NULL::VARCHAR, 'layout': 'text'}, {'section': 1, 'title': 'Step 1: ' || coalesce(lang, '-'), 'layout': 'step'},
{'section': 2, 'title': '2. Why it works', 'layout': 'science'}, {'section': 3, 'title': 'How to verify', 'layout': 'validation'}]) AS s FROM documents) WHERE s.section < 2 OR doc_id % 3 > 0""")
def guide_layouts(spark, sf):
    return markdown.layouts(_guides(spark, sf), "doc_id", "md")


@query("guide_steps", """SELECT doc_id, n AS number, t AS title FROM (SELECT doc_id, 1 AS n, coalesce(lang, '-') AS t FROM documents UNION ALL SELECT doc_id, 2, 'Why it works' FROM documents WHERE doc_id % 3 > 0)""")
def guide_steps(spark, sf):
    s = markdown.sections(_guides(spark, sf), "doc_id", "md").where("title is not null")
    return s.select("doc_id", markdown.step_number(F.col("title")).alias("number"), markdown.step_title(F.col("title")).alias("title")).where("number is not null")


@query("guide_parameters", "SELECT doc_id, source AS current, coalesce(lang, 'none') AS target, NULL::VARCHAR AS delta FROM documents WHERE source IS NOT NULL")
def guide_parameters(spark, sf):
    return markdown.parameters(_guides(spark, sf), "doc_id", "md").select("doc_id", "current", "target", "delta")


@query("guide_blocks", """SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 3 > 0 THEN ['text', 'parameters', 'table', 'text'] ELSE ['text', 'parameters', 'table', 'text'] END) AS kind FROM documents WHERE source IS NOT NULL) GROUP BY ALL""")
def guide_blocks(spark, sf):
    return markdown.blocks(_guides(spark, sf), "doc_id", "md").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("guide_recipes", "SELECT doc_id, 1 AS current, 2 AS target, NULL::INT AS delta, doc_id % 3 > 0 AS has_validation, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END::BIGINT AS n_advanced FROM documents WHERE source IS NOT NULL")
def guide_recipes(spark, sf):
    g = _guides(spark, sf).where("md is not null")
    rows = markdown.lines(g, "doc_id", "md")
    header = rows.where(F.col("line").startswith("| Parameter")).select("doc_id", markdown.recipe_columns(markdown.table_cells(F.col("line"))).alias("c")).select("doc_id", "c.*")
    advanced = rows.groupBy("doc_id").agg(F.count_if(markdown.is_advanced(F.col("line"))).alias("n_advanced"))
    return header.join(markdown.has_validation(g, "doc_id", "md"), "doc_id").join(advanced, "doc_id")


@query("distinct_tests", "SELECT doc_id, array_to_string(CASE WHEN lower(source) = lower(coalesce(lang, '')) THEN [source] ELSE list_filter([source, lang], lambda x: trim(x) <> '') END, '|') AS tests FROM documents WHERE source IS NOT NULL")
def distinct_tests(spark, sf):
    said = F.array_compact(F.array("source", F.upper("source"), F.lit(" "), "lang", "source"))
    return table(spark, sf, "documents").where("source is not null").select("doc_id", F.array_join(markdown.distinct_tests(said), "|").alias("tests"))


# ------------------------------------------------------------------ logs, stores, listings


_SESSIONS = "conv_id || '-' || turn AS session_id, text AS raw_problem, role AS status, 'moka' AS machine_type"


@query("session_log", f"SELECT session_id, substr(raw_problem, 1, 200) AS raw_problem, status, machine_type, 1 AS iterations FROM (SELECT {_SESSIONS} FROM conversations)")
def session_log(spark, sf):
    """Results written as a session log and read back."""
    c = table(spark, sf, "conversations")
    results = c.select(F.concat_ws("-", "conv_id", "turn").alias("session_id"), F.col("text").alias("raw_problem"), F.col("role").alias("status"), F.lit("moka").alias("machine_type"), F.array().cast("array<string>").alias("symptoms"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("iterations"))
    path = shared_folder(spark)
    logs.append_jsonl(logs.session_rows(results), path)
    back = logs.first_filled(logs.read_jsonl(spark, path + "-absent", logs.SESSIONS), logs.read_jsonl(spark, path, logs.SESSIONS))
    return back.select("session_id", "raw_problem", "status", "machine_type", "iterations")


@query("feedback_log", "SELECT event_id::VARCHAR AS session_id, CASE WHEN event_id % 3 = 0 THEN 'up' ELSE 'down' END AS rating, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, '') AS comment FROM events WHERE event_id % 3 < 2")
def feedback_log(spark, sf):
    e, m = table(spark, sf, "events"), F.pmod("event_id", F.lit(3))
    given = e.select(F.col("event_id").cast("string").alias("session_id"), F.when(m == 0, "up").when(m == 1, "down").otherwise("maybe").alias("rating"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("comment"))
    path = shared_folder(spark)
    logs.append_jsonl(logs.feedback_rows(given), path)
    return logs.read_jsonl(spark, path, logs.FEEDBACK).select("session_id", "rating", "comment")


@query("store_upserts", """SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'new ' || coalesce(source, '') ELSE coalesce(source, '') END AS text, CASE WHEN doc_id % 2 = 0 THEN 'moka' ELSE 'v60' END AS method FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'n' || doc_id, 'added', 'moka' FROM documents WHERE doc_id % 5 = 1""")
def store_upserts(spark, sf):
    """A store written, revised, exported, dropped and restored; then one method of it."""
    d = table(spark, sf, "documents")
    method = F.when(F.col("doc_id") % 2 == 0, "moka").otherwise("v60")
    rows = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("text"), "doc_id", method.alias("method"))
    revised = rows.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    added = rows.where("doc_id % 5 = 1").select(F.concat(F.lit("n"), "chunk_id").alias("chunk_id"), F.lit("added").alias("text"), "doc_id", F.lit("moka").alias("method"))
    path = shared_folder(spark)
    store = ChunkStore(spark, path, "chunk_id string, text string, method string")
    for part in (rows, revised, added, added):
        store.upsert(part.drop("doc_id"))
    store.export(path + "-copy")
    store.drop()
    store.restore(path + "-copy")
    return store.where_method(["moka"]).select("chunk_id", "text", "method")


@query("store_replaced_sources", "SELECT doc_id::VARCHAR AS chunk_id, coalesce(source, '-') AS source_id FROM documents WHERE coalesce(source, '-') NOT IN (SELECT coalesce(source, '-') FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)) UNION ALL SELECT 'only', coalesce(source, '-') FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def store_replaced_sources(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("source", F.lit("-")).alias("source_id"), "doc_id")
    store = ChunkStore(spark, shared_folder(spark), "chunk_id string, source_id string", partition=None)
    store.upsert(rows.drop("doc_id"))
    store.upsert(rows.agg(F.min_by("source_id", "doc_id").alias("source_id")).select(F.lit("only").alias("chunk_id"), "source_id"), replace_sources=True)
    return store.read()


@query("cache_split", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents")
def cache_split(spark, sf):
    sources = table(spark, sf, "documents").select("doc_id")
    known, lacking = experiments.cached(sources, table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
    return known.select("doc_id", F.lit(True).alias("known")).unionByName(lacking.select("doc_id", F.lit(False).alias("known")))


@query("listed_documents", "SELECT doc_id::VARCHAR AS source_id, 'https://www.youtube.com/watch?v=' || doc_id AS url, array_to_string(CASE WHEN source = lang THEN [source] ELSE list_filter([lang, source], lambda x: x IS NOT NULL) END, ',') AS tags FROM documents")
def listed_documents(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit("t").alias("title"), F.lit("c").alias("channel"), F.lit("d").alias("description"), F.array_compact(F.array("lang")).alias("tags"), F.array_compact(F.array("source", "lang")).alias("more"), F.lit(1).alias("duration_seconds"))
    return document_rows(d, "more").select("source_id", "url", F.array_join("tags", ",").alias("tags"))


# ------------------------------------------------------------------ evaluation, messages, views


@query("judge_means", "SELECT event_type, printf('%.2f', avg(CASE WHEN event_id % 4 > 0 THEN event_id % 5 + 1 END))::DOUBLE AS specificity, printf('%.2f', avg(CASE WHEN event_id % 4 > 0 THEN 3 END))::DOUBLE AS clarity, NULL::DOUBLE AS accuracy, count(*) FILTER (WHERE event_id % 4 = 0) AS parse_failures FROM events GROUP BY event_type")
def judge_means(spark, sf):
    e = table(spark, sf, "events")
    good = F.concat(F.lit('Sure: {"specificity": '), (F.pmod("event_id", F.lit(5)) + 1).cast("string"), F.lit(', "clarity": 3}'))
    return evals.judge_means(e.withColumn("reply", F.when(F.col("event_id") % 4 > 0, good).otherwise("no {json")), "reply", ("specificity", "clarity", "accuracy"), "event_type")


@query("ground_truth", "SELECT 'q-' || source AS query_id, array_to_string(list_sort(list(doc_id)), ',') AS relevant FROM documents WHERE source IS NOT NULL GROUP BY source")
def ground_truth(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id")).where("source_id is not null")
    items = d.select("source_id").distinct().withColumn("query_id", F.concat(F.lit("q-"), "source_id"))
    return evals.ground_truth(d, items).select("query_id", F.array_join(F.col("relevant_chunk_ids").cast("array<string>"), ",").alias("relevant"))


@query("coachable", f"WITH {report_sql.diagnosis(_TURNS)} SELECT query_id, route FROM d WHERE NOT (confidence < 0.15 AND goal = 'troubleshoot')")
def coachable(spark, sf):
    d = diagnose(extract(_turns(spark, sf)))
    return d.where(evals.coaching_items(d)).select("query_id", "route")


@query("allowed_rows", f"WITH {report_sql.features(_TURNS)}, may(machine, method) AS (VALUES {report_sql.values([(m, x) for m, xs in rules.MACHINE_METHODS.items() for x in xs])}) SELECT query_id, count(*) AS n, string_agg(method, ',' ORDER BY method) AS methods FROM f JOIN may ON may.machine = f.machine_type GROUP BY query_id")
def allowed_rows(spark, sf):
    f = extract(_turns(spark, sf)).withColumn("m", retrieve.allowed_methods(F.col("machine_type")))
    return f.select("query_id", F.size("m").cast("long").alias("n"), F.array_join(F.array_sort("m"), ",").alias("methods"))


@query("lang_hist", "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def lang_hist(spark, sf):
    return monitor.histogram(table(spark, sf, "documents"), "lang", "lang", default="unknown")


@query("known_lang_hist", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def known_lang_hist(spark, sf):
    return monitor.histogram(table(spark, sf, "documents"), "lang", "lang", drop_null=True)


@query("recent_view", "SELECT strftime(ts, '%d %b %H:%M') AS time, substr(event_type || repeat('-', 80), 1, 70) AS problem, user_id::VARCHAR AS label FROM events ORDER BY ts DESC LIMIT 10")
def recent_view(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.concat("event_type", F.lit("-" * 80)))
    return monitor.recent_view(e, "ts", "p", F.col("user_id").cast("string"))


@query("tool_turns", """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'tool' END AS role, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, 'tool', 'late' FROM conversations WHERE role = 'user'),
i AS (SELECT *, CASE WHEN role = 'tool' THEN 'tool' ELSE 'turn ' || turn END AS k FROM m), j AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM j) SELECT conv_id, min(turn) AS turn, 'user' AS role, count(*) FILTER (WHERE text IS NOT NULL) AS n FROM g GROUP BY conv_id, island""")
def tool_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("tool").alias("role"), "text")
    late = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("tool").alias("role"), F.lit("late").alias("text"))
    merged = generate.anthropic_messages(c.unionByName(late))
    return merged.select("conv_id", "turn", "role", F.size(F.filter("contents", lambda x: x.isNotNull())).cast("long").alias("n"))


@query("chat_messages", "SELECT conv_id, turn, role, text AS content, CASE WHEN role = 'tool' THEN turn::VARCHAR END AS tool_call_id FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'tool' ELSE role END AS role, text FROM conversations)")
def chat_messages(spark, sf):
    c = table(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role")))
    one = generate.openai_messages(F.array(F.struct("role", F.col("text").alias("content"), F.col("turn").cast("string").alias("tool_id"))))
    return c.select("conv_id", "turn", one[0].alias("m")).select("conv_id", "turn", "m.*")


@query("adjustable_forms", f"WITH {report_sql.features(_TURNS)}, can(machine, words) AS (VALUES {report_sql.values([(m, ', '.join(ps)) for m, ps in rules.ADJUSTABLE.items()])}) SELECT query_id, words AS adjustable, 'Rate from 1 to 5 as JSON with specificity, accuracy, clarity, actionability:' || chr(10) || substr(raw_problem, 1, 3000) AS judged FROM f JOIN can ON can.machine = f.machine_type")
def adjustable_forms(spark, sf):
    f = extract(_turns(spark, sf))
    return f.select("query_id", generate.adjustable_text(F.col("machine_type")).alias("adjustable"), generate.judge_prompt(F.col("raw_problem")).alias("judged"))


@query("demo_texts", f"""WITH {report_sql.diagnosis(_TURNS)}, one AS (SELECT query_id, action FROM o2 WHERE step = 1) SELECT query_id, '[DEMO] Your ' || machine_type || ' problem (' || coalesce(s[1], 'coffee issue') || ') is most likely due to ' || coalesce(hypothesis, 'an unclear cause') || '.' || chr(10) || chr(10) || 'First step: ' || coalesce(action, 'check your setup') AS demo_text FROM d LEFT JOIN one USING (query_id)""")
def demo_texts(spark, sf):
    return diagnose(extract(_turns(spark, sf))).select("query_id", generate.template_text().alias("demo_text"))



_FOLDED = ", ".join(f"strip_accents({report_sql.text(w)})" for w in rules.SCOPE_WORDS)


@query("coach_status", f"""WITH {report_sql.diagnosis(_TURNS)}, v AS ({report_sql.gate_sql(_TURNS, found=False).replace(chr(10), " ")}),
z1 AS (SELECT d.*, trim(raw_problem, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, len(list_intersect(regexp_extract_all(strip_accents(lower(coalesce(raw_problem, ''))), '[a-z0-9]+'), [{_FOLDED}])) > 0 AS hit FROM d),
z2 AS (SELECT *, CASE WHEN said = '' THEN 'empty' WHEN length(said) > {rules.LONGEST_QUESTION} THEN 'too_long' WHEN hit THEN 'ok' ELSE 'off_topic' END AS reason FROM z1)
SELECT query_id, reason, CASE WHEN reason = 'empty' THEN 'error' WHEN reason <> 'ok' THEN 'out_of_scope' WHEN len(s) > 0 AND confidence >= 0.15 THEN CASE v.verdict WHEN 'blocked' THEN 'error' ELSE 'coaching' END WHEN goal = 'troubleshoot' THEN 'error' ELSE 'coaching' END AS status, v.verdict AS pre_verdict FROM z2 JOIN v USING (query_id)""")
def coach_status(spark, sf):
    return coach(_turns(spark, sf)).select("query_id", "reason", "status", F.col("pre.verdict").alias("pre_verdict"))
