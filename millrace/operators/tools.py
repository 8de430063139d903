"""The agent's six tools: what a model is told of them, and what each does to many sessions at once.

A tool takes the sessions it is called for (query_id, raw_problem and what earlier tools left) and returns
them with its columns and tool_result, the JSON that goes back to the model.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import n_words
from millrace.operators.diagnose import diagnose
from millrace.operators.extract import extract
from millrace.operators.gates import post_gate
from millrace.operators.generate import STYLES, Generator, Tool, coaching_prompt, completed, template
from millrace.operators.retrieve import relevant_enough
from millrace.plans import rules

LEAST_RELEVANCE, MOST_PASSAGES, GOOD = 0.30, 10, 5

# Names of tools and their arguments, which a model's calls hold.
ARGUMENTS: dict[str, dict[str, dict]] = {
    "extract_symptoms": {"user_description": {"type": "string"}},
    "ask_clarification": {"question": {"type": "string"}, "reason": {"type": "string"}},
    "retrieve_knowledge": {"query": {"type": "string"}, "machine_type": {"type": "string"}, "min_relevance": {"type": "number", "default": LEAST_RELEVANCE}},
    "generate_coaching": {"style": {"type": "string", "enum": list(STYLES), "default": "technical"}},
    "validate_coaching": {"coaching_text": {"type": "string"}},
    "answer_general_question": {"question_type": {"type": "string", "enum": list(rules.QUESTION_TYPES)}, "user_question": {"type": "string"}, "machine_context": {"type": "string"}},
}
OPTIONAL = ("min_relevance", "style", "machine_context")
PURPOSES = {
    "extract_symptoms": "Features and rule diagnosis of a report. Comes first.",
    "ask_clarification": "One question back to the user where too little is known; ends the round.",
    "retrieve_knowledge": "Passages for a query of the model's own, with their scores.",
    "generate_coaching": "The advice, from what the other tools found.",
    "validate_coaching": "The deterministic checks of an advice: pass, warn or fail.",
    "answer_general_question": "Answers outside diagnosis: error codes, purchases, science, recipes, anything else.",
}


def schemas() -> list[dict]:
    """The tools as a model's interface takes them: name, description, input_schema."""
    return [{"name": n, "description": PURPOSES[n], "input_schema": {"type": "object", "properties": dict(a), "required": [k for k in a if k not in OPTIONAL]}} for n, a in ARGUMENTS.items()]


def agent_adjustable(machine: Column) -> Column:
    """What the agent may tell users to change: its own map, which names some controls otherwise than the planner's."""
    table = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in rules.AGENT_ADJUSTABLE.items() for v in pair])
    return F.coalesce(F.try_element_at(table, machine), F.array(*map(F.lit, rules.AGENT_ADJUSTABLE["unknown"])))


def failed(message: str) -> Column:
    return F.to_json(F.struct(F.lit(message).alias("error")))


def extract_symptoms(sessions: DataFrame, key: str = "query_id") -> DataFrame:
    """Features and diagnosis joined to the sessions; the result names at most three causes."""
    found = diagnose(extract(sessions.select(key, "raw_problem")), key).drop("raw_problem")
    rows = sessions.drop(*[c for c in found.columns if c != key]).join(found, key)
    causes = F.transform(F.slice("root_causes", 1, 3), lambda c: F.struct(c["hypothesis"].alias("hypothesis"), c["probability"].alias("heuristic_weight")))
    plan = F.transform("plan", lambda s: F.struct(*[s[k].alias(k) for k in ("step", "action", "parameter", "direction", "magnitude")]))
    said = F.struct("machine_type", "machine_model", "symptoms", "method_detected", causes.alias("root_causes"), plan.alias("intervention_plan"), "diagnostic_confidence", "warnings", agent_adjustable(F.col("machine_type")).alias("adjustable_parameters"))
    return rows.withColumn("tool_result", F.to_json(said))


def retrieve_knowledge(sessions: DataFrame, found: DataFrame, key: str = "query_id", least: float = LEAST_RELEVANCE) -> DataFrame:
    """sessions with chunks_retrieved, avg_relevance, knowledge_quality and top_passages.

    found: (key, retrieval_rank, title, channel, text, semantic_score), as retrieve gives them. At most
    MOST_PASSAGES of at least the least score count, five are shown. A session without a diagnosis gets an error.
    """
    shown = F.struct(F.col("retrieval_rank").alias("at"), F.struct("title", "channel", F.round("semantic_score", 3).alias("relevance"), F.concat(F.substring("text", 1, 200), F.lit("...")).alias("excerpt")).alias("x"))
    per = relevant_enough(found, least, MOST_PASSAGES, key).groupBy(key).agg(F.count("*").alias("_n"), F.avg("semantic_score").alias("_mean"), F.transform(F.slice(F.sort_array(F.collect_list(shown)), 1, 5), lambda s: s["x"]).alias("top_passages"))
    n = F.coalesce("_n", F.lit(0))
    rows = sessions.join(per, key, "left").withColumns({"chunks_retrieved": n, "avg_relevance": F.coalesce("_mean", F.lit(0.0)), "knowledge_quality": F.when(n >= GOOD, "good").otherwise("poor: ask again in other words")}).drop("_n", "_mean")
    said = F.to_json(F.struct("chunks_retrieved", "avg_relevance", "top_passages", F.col("knowledge_quality").alias("quality")))
    known = "diagnostic_confidence" in sessions.columns
    return rows.withColumn("tool_result", F.when(F.col("diagnostic_confidence").isNull(), failed("extract_symptoms comes first")).otherwise(said) if known else failed("extract_symptoms comes first"))


def generate_coaching(sessions: DataFrame, generator: Generator = template, style: str = "technical") -> DataFrame:
    """sessions with coaching_text from their facts, plan and passages; an error without a diagnosis."""
    if "diagnostic_confidence" not in sessions.columns:
        return sessions.withColumns({"coaching_text": F.lit(None).cast("string"), "tool_result": failed("extract_symptoms comes first")})
    passages = F.array_join(F.transform("top_passages", lambda p: p["excerpt"]), "\n\n") if "top_passages" in sessions.columns else F.lit(None).cast("string")
    rows = completed(sessions.withColumn("_prompt", coaching_prompt(style, passages)), "_prompt", generator, "coaching_text").drop("_prompt")
    return rows.withColumn("tool_result", F.to_json(F.struct("coaching_text", n_words(F.col("coaching_text")).alias("word_count"))))


def validate_coaching(sessions: DataFrame) -> DataFrame:
    cause = F.get("root_causes", F.lit(0))["hypothesis"] if "root_causes" in sessions.columns else None
    return post_gate(sessions, hypothesis=cause).withColumn("tool_result", F.to_json(F.col("post")))


def question_type(raw: Column) -> Column:
    """The kind of a question by the rules' own word lists, for choosers without a model."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    has = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return F.when(low.rlike(rules.ERROR_CODE), "error_code").when(has(rules.PURCHASE + rules.SELECTION), "purchase_advice").when(has(rules.SCIENCE), "coffee_science").when(has(rules.RECIPE), "recipe_request").otherwise("general")


def preamble(kind: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in rules.QUESTION_TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(""))


def answer_general_question(sessions: DataFrame, generator: Generator = template, kind: str = "question_type", question: str = "raw_problem", machine: str | None = None) -> DataFrame:
    """sessions with coaching_text, the generator's answer behind its kind's preamble (none for other kinds)."""
    known = F.lit(None).cast("string") if machine is None else F.when(F.col(machine) != "", F.concat(F.lit("Machine: "), F.col(machine), F.lit("\n\n")))
    rows = completed(sessions.withColumn("_prompt", F.concat(F.coalesce(known, F.lit("")), F.lit("Question: "), F.coalesce(F.col(question), F.lit("")))), "_prompt", generator, "_answer").drop("_prompt")
    said = rows.withColumn("coaching_text", F.concat(preamble(F.col(kind)), F.coalesce("_answer", F.lit("")))).drop("_answer")
    note = F.when(preamble(F.col(kind)) == "", "Answered directly.").otherwise(preamble(F.col(kind)))
    return said.withColumn("tool_result", F.to_json(F.struct(F.col("coaching_text").alias("answer"), F.col(kind).alias("question_type"), n_words(F.col("coaching_text")).alias("word_count"), note.alias("scope_note"))))


def clarifying(machine: Column, symptoms: Column) -> Column:
    """One question: for the machine where it is not known, else for the taste."""
    return F.when(machine == "unknown", "Which machine or brewer do you use?").when(F.size(symptoms) == 0, "What is wrong with the taste: bitter, sour, weak, or something else?").otherwise("How long does the extraction take?")


def registry(found: DataFrame | None = None, generator: Generator = template, style: str = "technical") -> dict[str, Tool]:
    """The tools by name for an Agent, which asks (ask_clarification) by itself. Without passages to search, `found` is empty."""

    def search(sessions: DataFrame) -> DataFrame:
        none = sessions.select("query_id", F.lit(0).alias("retrieval_rank"), *[F.lit("").alias(c) for c in ("title", "channel", "text")], F.lit(0.0).alias("semantic_score")).where("false")
        return retrieve_knowledge(sessions, none if found is None else found)

    general = lambda s: answer_general_question(s.withColumn("question_type", question_type(F.col("raw_problem"))), generator)
    return {"extract_symptoms": extract_symptoms, "retrieve_knowledge": search, "generate_coaching": partial(generate_coaching, generator=generator, style=style), "validate_coaching": validate_coaching, "answer_general_question": general}


def by_rule(state: DataFrame) -> Column:
    """The next tool without a model: extract, ask where nothing is sure, answer what is general, else search, write, check."""
    called = lambda name: F.array_contains("calls", name)
    if "diagnostic_confidence" not in state.columns:
        return F.lit("extract_symptoms")
    vague = (F.col("diagnostic_confidence") < 0.25) & ((F.size("symptoms") == 0) | (F.col("machine_type") == "unknown"))
    return (
        F.when(~called("extract_symptoms"), "extract_symptoms").when(called("answer_general_question") | called("validate_coaching"), "stop").when(F.col("goal") == "general", "answer_general_question")
        .when(vague, "ask").when(~called("retrieve_knowledge"), "retrieve_knowledge").when(~called("generate_coaching"), "generate_coaching").otherwise("validate_coaching")
    )
