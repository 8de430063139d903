"""The question pipeline over many reports: scope, features, diagnosis, retrieval, gates, text, envelope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import session_id
from millrace.operators.diagnose import diagnosable, diagnose
from millrace.operators.extract import extract, has_word
from millrace.operators.gates import post_gate, pre_gate
from millrace.operators.generate import coaching_prompt, completed, general_text, knowledge_of, template_text
from millrace.operators.retrieve import embed, retrieve
from millrace.plans import rules
from millrace.sources.logs import append_jsonl, session_rows


def coach(reports: DataFrame, corpus: DataFrame | None = None, style: str = "concise", generator=None, vocabulary: list[str] | None = None) -> DataFrame:
    """reports (query_id, raw_problem) -> one row each: status, coaching_text, verdict and what led to them.

    Status: error (nothing asked, a request for help that cannot be diagnosed, or one that the first gate
    blocks), out_of_scope, coaching. The mean score of what is retrieved goes into that gate, 0 where nothing
    is. Without a generator the demo texts are given and nothing is retrieved.
    """
    raw = F.regexp_replace(F.coalesce("raw_problem", F.lit("")), r"^\s+|\s+$", "")
    rows = reports.withColumn("raw_problem", raw)
    reason = F.when(F.col("raw_problem") == "", "empty").when(F.length("raw_problem") > rules.LONGEST_QUESTION, "too_long").when(has_word(F.col("raw_problem"), vocabulary or rules.SCOPE_WORDS), "ok").otherwise("off_topic")
    rows = diagnose(extract(rows)).withColumn("reason", reason)
    route = F.when(F.col("reason") == "empty", "error").when(F.col("reason") != "ok", "out_of_scope").when(diagnosable(), "coach").when(F.col("goal") == "troubleshoot", "error").otherwise("general")
    rows = rows.withColumn("answer", route)
    live = generator is not None and corpus is not None
    if live:
        asked = rows.where(F.col("answer") == "coach").select("query_id", F.col("raw_problem").alias("text"), "machine_type")
        found = retrieve(corpus, embed(asked, "text"))
        rows = rows.join(mean_score(found), "query_id", "left").join(knowledge_of(found), "query_id", "left").withColumn("avg_semantic_score", F.coalesce("avg_semantic_score", F.lit(0.0)))
    else:
        rows = rows.withColumn("avg_semantic_score", F.lit(0.0))
    rows = pre_gate(rows, "avg_semantic_score")
    rows = rows.withColumn("answer", F.when((F.col("answer") == "coach") & (F.col("pre.verdict") == "blocked"), "blocked").otherwise(F.col("answer")))
    if live:
        ready = rows.withColumn("prompt", F.when(F.col("answer") == "coach", coaching_prompt(style, F.col("knowledge"))).when(F.col("answer") == "general", F.col("raw_problem")))
        rows = completed(ready.where("prompt is not null"), "prompt", generator, "coaching_text").unionByName(ready.where("prompt is null"), allowMissingColumns=True).drop("prompt", "knowledge")
    else:
        rows = rows.withColumn("coaching_text", F.when(F.col("answer") == "coach", template_text()).when(F.col("answer") == "general", general_text()))
    rows = post_gate(rows, hypothesis=F.get("root_causes", F.lit(0))["hypothesis"])
    status = F.when(F.col("answer").isin("coach", "general"), "coaching").when(F.col("answer") == "blocked", "error").otherwise(F.col("answer"))
    return rows.withColumn("status", status).withColumn("verdict", F.when(F.col("answer") == "coach", F.col("post.verdict")))


def mean_score(found: DataFrame, query: str = "query_id") -> DataFrame:
    return found.groupBy(query).agg(F.avg("semantic_score").alias("avg_semantic_score"))


#: What is said instead of a text, by reason or answer.
MESSAGES = {
    "empty": "Say what is wrong with your coffee.", "too_long": f"Please keep it under {rules.LONGEST_QUESTION} characters.", "off_topic": "Only questions on making coffee can be answered here.",
    "blocked": "Too little is known to give advice.", "error": "Say what tastes wrong, or give your parameters.",
}


def envelopes(coached: DataFrame) -> DataFrame:
    """One answer a report, with a new session id: the text, or why there is none; iterations 1 for texts, else 0.

    Ids are drawn anew by each evaluation: store the result before it is logged and returned.
    """
    table = F.create_map(*[F.lit(v) for pair in MESSAGES.items() for v in pair])
    texted = F.col("status") == "coaching"
    why = F.when(F.col("reason") != "ok", F.try_element_at(table, F.col("reason"))).otherwise(F.try_element_at(table, F.col("answer")))
    return coached.select(
        "query_id", "raw_problem", session_id().alias("session_id"), "status", F.when(texted, F.coalesce("coaching_text", F.lit(""))).otherwise("").alias("coaching_text"), F.when(texted, "").otherwise(F.coalesce(why, F.lit(""))).alias("clarification_question"),
        "machine_type", "symptoms", "verdict", texted.cast("int").alias("iterations"),
    )


def coach_and_log(reports: DataFrame, log: str, keep: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """Envelopes of all reports, stored by keep, with a row each appended to the session log."""
    out = keep(envelopes(coach(reports, **how)))
    append_jsonl(session_rows(out), log)
    return out
