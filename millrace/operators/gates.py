"""Deterministic quality gates before and after generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import contains_any, let, n_words
from millrace.operators.diagnose import adjustable, capability
from millrace.plans import rules

LEAST_CONFIDENCE, RELAXED_CONFIDENCE, LEAST_RETRIEVAL = 0.20, 0.05, 0.25
WORDS = (120, 700)
LEAST_SPECIFIC = 2
CRITICAL = ("appropriate_length", "specific_enough", "has_validation_test")


def feasible(plan: Column, machine: Column) -> Column:
    can = adjustable(machine)
    return F.forall(plan, lambda s: s["parameter"].isNull() | F.array_contains(can, capability(s["parameter"])) | capability(s["parameter"]).isin("freshness", "machine_cleaning"))


def overall(checks: Column) -> Column:
    """The share of checks that hold, to two places."""
    values = F.map_values(checks)
    return F.round(F.size(F.filter(values, lambda x: x)) / F.size(values), 2)


def failing(checks: Column) -> Column:
    return F.size(F.filter(F.map_values(checks), lambda x: ~x))


def pre_gate(diagnostics: DataFrame, retrieval_score: str | None = None) -> DataFrame:
    """diagnostics with pre, a struct of checks, overall_score, warnings and verdict (ready, review, blocked)."""
    relaxed = F.col("goal").isin("learn", "optimize", "explore", "general")
    good = F.lit(True) if retrieval_score is None else F.coalesce(F.col(retrieval_score) >= LEAST_RETRIEVAL, F.lit(True))
    checks = F.create_map(
        F.lit("symptoms_detected"), relaxed | (F.size("symptoms") >= 1), F.lit("root_causes_present"), relaxed | (F.size("root_causes") >= 1), F.lit("intervention_plan_present"), F.size("plan") >= 1,
        F.lit("confidence_sufficient"), F.col("diagnostic_confidence") >= F.when(relaxed, RELAXED_CONFIDENCE).otherwise(LEAST_CONFIDENCE), F.lit("machine_identified"), F.col("machine_type") != "unknown",
        F.lit("interventions_feasible"), feasible(F.col("plan"), F.col("machine_type")), F.lit("retrieval_quality_ok"), good,
    )

    def verdict(c: Column) -> Column:
        n = failing(c)
        return F.when(~c["intervention_plan_present"] | ~c["confidence_sufficient"], "blocked").when(n == 0, "ready").when(n <= 2, "review").otherwise("blocked")

    said = lambda c: F.array_compact(F.array(F.when(~c["machine_identified"], "Machine not identified: coaching is generic."), F.when(~c["interventions_feasible"], "Some steps may not be possible on this machine."), F.when(~c["retrieval_quality_ok"], "Retrieval quality is low.")))
    return diagnostics.withColumn("pre", let(checks, lambda c: F.struct(c.alias("checks"), overall(c).alias("overall_score"), said(c).alias("warnings"), verdict(c).alias("verdict"))))


def mentions(hypothesis: Column, lower: Column) -> Column:
    """Whether the text has the phrase, or three fifths of its telling words, as words."""
    telling = F.filter(F.regexp_extract_all(F.lower(hypothesis), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(rules.STOPWORDS))
    present = let(F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), F.lit(1)), lambda ts: F.size(F.filter(telling, lambda t: F.array_contains(ts, t))))
    return F.contains(lower, hypothesis) | F.when(F.size(telling) > 0, present / F.size(telling) >= 0.6).otherwise(False)


def post_gate(texts: DataFrame, text: str = "coaching_text", hypothesis: Column | None = None) -> DataFrame:
    """texts with post, a struct of checks, overall_score, warnings and verdict (pass, warn, fail)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    low, n = F.lower(raw), n_words(raw)
    hits = sum((raw.rlike("(?i)" + p).cast("int") for p in rules.SPECIFIC), F.lit(0))
    named = F.lit(True) if hypothesis is None else F.coalesce(mentions(F.translate(hypothesis, "-_", "  "), low), F.lit(True))
    checks = F.create_map(
        F.lit("appropriate_length"), n.between(*WORDS), F.lit("specific_enough"), hits >= LEAST_SPECIFIC, F.lit("has_validation_test"), contains_any(low, rules.VALIDATION),
        F.lit("explains_root_cause"), contains_any(low, rules.EXPLANATION), F.lit("mentions_root_cause"), named, F.lit("has_structure"), F.contains(raw, F.lit("\n")) | (F.regexp_count(raw, F.lit(r"\. ")) >= 3),
    )

    def verdict(c: Column) -> Column:
        lost = ~c[CRITICAL[0]] | ~c[CRITICAL[1]] | ~c[CRITICAL[2]]
        return F.when(lost, "fail").when(failing(c) <= 1, "pass").otherwise("warn")

    texts_of = {"appropriate_length": "Too short or too long.", "specific_enough": "Too few measurements.", "has_validation_test": "No test of whether it worked.", "explains_root_cause": "Does not say why.", "mentions_root_cause": "Does not name the cause.", "has_structure": "One block of text."}
    said = lambda c: F.array_compact(F.array(*[F.when(~c[k], v) for k, v in texts_of.items()]))
    return texts.withColumn("post", let(checks, lambda c: F.struct(c.alias("checks"), overall(c).alias("overall_score"), said(c).alias("warnings"), verdict(c).alias("verdict"))))


def experiment_verdict(first: Column, second: Column, least_first: float, least_second: float) -> Column:
    return F.when((first >= least_first) & (second >= least_second), "PASS").otherwise("FAIL")
