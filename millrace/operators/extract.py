"""Scope check and feature extraction from free-form problem reports: one select each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import all_of, contains_any, first_of, fold_accents, found, once, title_case, tokens
from millrace.plans import rules


def has_word(text: Column, vocabulary: list[str]) -> Column:
    """Whether a token of text, accents folded, is in the vocabulary, folded as well."""
    folded = F.array(*[fold_accents(F.lit(w.lower())) for w in vocabulary])
    return F.coalesce(F.arrays_overlap(tokens(text), folded), F.lit(False))


def scope(turns: DataFrame, conversation: str, turn: str, role: str, text: str, vocabulary: list[str] | None = None, longest: int = rules.LONGEST_QUESTION) -> DataFrame:
    """turns with reason and in_scope: too_long, ok (a word of the vocabulary here, or in an earlier user turn), off_topic."""
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    out = turns.withColumn("_hit", has_word(F.coalesce(F.col(text), F.lit("")), vocabulary or rules.SCOPE_WORDS))
    earlier = F.coalesce(F.max(F.col("_hit") & (F.col(role) == "user")).over(before), F.lit(False))
    reason = F.when(F.length(text) > longest, "too_long").when(F.col("_hit") | earlier, "ok").otherwise("off_topic")
    return out.withColumn("reason", reason).withColumn("in_scope", F.col("reason") == "ok").drop("_hit")


def goal(lower: Column, symptoms: Column) -> Column:
    none = F.size(symptoms) == 0
    general = lower.rlike(rules.ERROR_CODE) | contains_any(lower, rules.PURCHASE) | contains_any(lower, rules.SELECTION) | contains_any(lower, rules.SCIENCE) | (contains_any(lower, rules.RECIPE) & none)
    return F.when(general, "general").when(contains_any(lower, rules.LEARN), "learn").when(contains_any(lower, rules.EXPLORE), "explore").when(contains_any(lower, rules.OPTIMIZE), "optimize").otherwise("troubleshoot")


def freshness(text: Column, weeks_count: bool = True) -> Column:
    """Days since roasting. 'roasted 3 weeks ago' is 21 days; 3 with weeks_count=False."""
    days, roasted, weeks = (found(text, rules.FRESHNESS, g).cast("int") for g in (1, 2, 3))
    by = F.when(text.rlike(rules.ROASTED_WEEKS), 7).otherwise(1) if weeks_count else F.lit(1)
    return F.coalesce(days, roasted * by, weeks * 7)


def extract(reports: DataFrame, text: str = "raw_problem", fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """reports with the features of each: machine, symptoms, measurements, bean, goal.

    fallback(rows whose machine is unknown, or which have no symptom and ask for help) may fill in
    machine_type and symptoms (from a generator); without it the rules decide alone.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    out = reports.withColumn("_l", F.lower(raw))
    low = F.col("_l")
    model = F.coalesce(*[found(raw, p) for p in rules.MODELS])
    out = once(
        out,
        {
            "machine_type": first_of(low, rules.MACHINES, "unknown"), "machine_model": model, "symptoms": all_of(low, rules.SYMPTOMS),
            "extraction_time_seconds": F.floor(found(raw, rules.TIME).cast("double")).cast("int"), "dose_grams": found(raw, rules.DOSE).cast("double"), "water_temp_celsius": found(raw, rules.TEMPERATURE).cast("double"),
            "grind_size": found(low, rules.GRIND, 0), "bean_origin": title_case(first_of(low, {o: [o] for o in rules.ORIGINS})), "roast_level": first_of(low, rules.ROASTS),
            "bean_freshness_days": freshness(raw), "water_ratio": F.concat(F.lit("1:"), found(raw, rules.RATIO)),
        },
    )
    # a measurement of zero counts as none
    specs = (F.coalesce(F.col("extraction_time_seconds"), F.lit(0)) != 0) | (F.coalesce(F.col("dose_grams"), F.lit(0)) != 0) | (F.coalesce(F.col("water_temp_celsius"), F.lit(0)) != 0) | F.col("grind_size").isNotNull() | F.col("water_ratio").isNotNull()
    out = once(out, {"_g": goal(low, F.col("symptoms"))})
    out = out.withColumn("goal", F.when((F.size("symptoms") == 0) & specs & ~F.col("_g").isin("learn", "explore"), "optimize").otherwise(F.col("_g")))
    out = out.withColumn("needs_fallback", (F.col("machine_type") == "unknown") | ((F.size("symptoms") == 0) & (F.col("goal") == "troubleshoot"))).drop("_l", "_g")
    if fallback is None:
        return out
    return out.where(~F.col("needs_fallback")).unionByName(fallback(out.where("needs_fallback")).select(*out.columns))
