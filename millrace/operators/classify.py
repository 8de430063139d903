"""Keyword classification of documents: weighted scores, domain, method, difficulty, relevance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import count_whole, let, whole_word
from millrace.plans import rules

Table = dict[str, list[str]]


def fields(docs: DataFrame, title: str = "title", description: str = "description", tags: str = "tags", transcript: str = "transcript_text", content: str = "content") -> DataFrame:
    """Adds _f, a struct of the four texts that are scored; missing columns count as empty."""
    have = set(docs.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    tag_text = F.lit("")
    if tags in have:
        tag_text = F.coalesce(F.array_join(F.col(tags), " "), F.lit("")) if docs.schema[tags].dataType.typeName() == "array" else text(tags)
    body = F.coalesce(F.nullif(text(transcript), F.lit("")), text(content))
    return docs.withColumn("_f", F.struct(text(title).alias("title"), text(description).alias("description"), tag_text.alias("tags"), F.substring(body, 1, 1000).alias("transcript")))


def score(table: Table, weights: dict[str, int] | None = None) -> Column:
    """map category -> weighted number of whole-word signals over the fields of _f."""
    weights = weights or rules.FIELD_WEIGHTS
    pairs = []
    for category, signals in table.items():
        total = F.lit(0)
        for field, weight in weights.items():
            for signal in signals:
                total = total + count_whole(F.col(f"_f.{field}"), signal) * weight
        pairs += [F.lit(category), total.cast("double")]
    return F.create_map(*pairs)


def total(scores: Column) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)


def best(scores: Column, table: Table) -> Column:
    """The category of highest score; on ties the one named first."""
    names = list(table)
    ranked = F.array(*[F.struct(F.element_at(scores, F.lit(n)).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    return F.array_max(ranked)["n"]


def difficulty(advanced: list[str], beginner: list[str]) -> Column:
    text = F.concat_ws(" ", *[F.col(f"_f.{f}") for f in rules.FIELD_WEIGHTS])
    any_of = lambda t, signals: F.lit(False) if not signals else t.rlike("|".join(whole_word(s) for s in signals))
    return let(F.lower(text), lambda t: F.when(any_of(t, [s.lower() for s in advanced]), "advanced").when(any_of(t, [s.lower() for s in beginner]), "beginner").otherwise("intermediate"))


def classify(
    docs: DataFrame, domains: Table | None = None, methods: Table | None = None, advanced: list[str] | None = None, beginner: list[str] | None = None,
    fallback: Callable[[DataFrame], DataFrame] | None = None, prefer: tuple[str, str] = ("super_automatic", "espresso"), **columns: str,
) -> DataFrame:
    """docs with domain, method, difficulty and classification_confidence.

    Confidence is the best domain's share of all domain scores, 0 and `general` without any. A
    method named first in `prefer` wins wherever both score. fallback(rows of confidence under 0.3)
    may return (…, domain, method) for those rows; their confidence stays.
    """
    domains, methods = domains or rules.DOMAINS, methods or rules.METHODS
    out = fields(docs, **columns).withColumn("_d", score(domains)).withColumn("_m", score(methods))
    sum_d, sum_m = total(F.col("_d")), total(F.col("_m"))
    method = F.when(sum_m == 0, "general").otherwise(best(F.col("_m"), methods))
    if all(p in methods for p in prefer):
        both = (F.element_at("_m", F.lit(prefer[0])) > 0) & (F.element_at("_m", F.lit(prefer[1])) > 0)
        method = F.when(both, prefer[0]).otherwise(method)
    out = out.withColumns(
        {
            "domain": F.when(sum_d == 0, "general").otherwise(best(F.col("_d"), domains)),
            "method": method,
            "difficulty": difficulty(rules.ADVANCED if advanced is None else advanced, rules.BEGINNER if beginner is None else beginner),
            "classification_confidence": F.when(sum_d == 0, 0.0).otherwise(F.array_max(F.map_values("_d")) / F.when(sum_d == 0, 1.0).otherwise(sum_d)),
        }
    ).drop("_f", "_d", "_m")
    if fallback is None:
        return out
    unsure = F.col("classification_confidence") < 0.3
    return out.where(~unsure).unionByName(fallback(out.where(unsure)).select(*out.columns))


def relevance(docs: DataFrame, domains: Table | None = None, methods: Table | None = None, **columns: str) -> DataFrame:
    """docs with relevance: all domain and method scores."""
    out = fields(docs, **columns)
    return out.withColumn("relevance", total(score(domains or rules.DOMAINS)) + total(score(methods or rules.METHODS))).drop("_f")


def ranked_by_relevance(docs: DataFrame, seq: str, **options) -> DataFrame:
    """Relevant documents with their rank by falling relevance, ties by seq."""
    out = relevance(docs, **options).where("relevance > 0")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), seq)))


def confident(docs: DataFrame, least: float = 0.4) -> DataFrame:
    return docs.where(F.col("classification_confidence") >= least)
