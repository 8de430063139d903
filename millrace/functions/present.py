"""Display columns of diagnoses and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import found, humanized, number_text, percent_text
from millrace.plans import rules

TOO = r"(?i)^(?!too\b)(.+?)\s+too\s+(.+)$"


def parameter_label(parameter: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in rules.PARAMETER_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(parameter))), humanized(parameter, rules.LABELS, "Adjustment"))


def claim(hypothesis: Column) -> Column:
    """grind_too_fine as a sentence; any other cause as it is named."""
    label = humanized(hypothesis, rules.LABELS, "")
    subject, quality = F.lower(F.trim(found(label, TOO, 1))), F.lower(F.trim(found(label, TOO, 2)))
    return F.when(label == "", "Most likely cause identified below.").when(subject.isNotNull(), F.concat(F.lit("Your "), subject, F.lit(" is probably too "), quality, F.lit("."))).otherwise(F.concat(F.lit("Most likely cause: "), F.lower(label), F.lit(".")))


def current_value(parameter: Column) -> Column:
    """What the report says of a parameter, with its unit; null where it says nothing."""
    return (
        F.when(parameter == "grind_size", F.col("grind_size")).when(parameter == "water_temp", F.concat(number_text(F.col("water_temp_celsius")), F.lit("°C"))).when(parameter == "dose", F.concat(number_text(F.col("dose_grams")), F.lit(" g")))
        .when(parameter == "time", F.concat(F.col("extraction_time_seconds").cast("string"), F.lit(" s")))
    )


def target_phrase(direction: Column, magnitude: Column) -> Column:
    """The change asked for, in words."""
    return F.when(direction.isNotNull() & magnitude.isNotNull(), F.concat(magnitude, F.lit(" "), direction)).when(direction.isNotNull(), humanized(direction, {}, "")).otherwise(magnitude)


def verdict_label(verdict: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in rules.VERDICT_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.lower(verdict)), humanized(verdict, {}))


def session_meta() -> Column:
    """array of (label, value): machine, confidence where there is a cause, quality check where there is a verdict."""
    card = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    check = F.concat(F.when(F.lower("verdict") == "pass", "✓ ").otherwise(""), verdict_label(F.col("verdict")))
    return F.array_compact(
        F.array(card("Machine", humanized(F.col("machine_type"), rules.LABELS)), F.when(F.size("root_causes") > 0, card("Confidence", percent_text(F.col("diagnostic_confidence")))), F.when(F.col("verdict").isNotNull(), card("Quality check", check)))
    )
