"""Evaluation: hit rate, reciprocal rank, pass rates, judges, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import json_in, round_binary, strip
from millrace.operators.gates import experiment_verdict
from millrace.operators.generate import Generator, completed

RETRIEVAL_LEAST, STYLE_LEAST = (0.55, 0.45), (0.70, 0.65)


def first_hits(ranked: DataFrame, truth: DataFrame, query: str = "query_id", key: str = "chunk_id", rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query, first_hit): the rank of each query's first relevant row, null for none."""
    hits = ranked.join(truth.select(query, key).distinct(), [query, key], "left_semi").groupBy(*by, query).agg(F.min(rank).alias("first_hit"))
    asked = truth.select(query).distinct()
    if by:
        asked = asked.join(F.broadcast(ranked.select(*by).distinct()))
    return asked.join(hits, [*by, query], "left")


def retrieval_metrics(first: DataFrame, by: tuple[str, ...] = (), cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Hit rates at the cuts and mean reciprocal rank, to three places, and the number of queries."""
    rate = lambda k: round_binary(F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0)), 3).alias(f"hit_rate_{k}")
    return first.groupBy(*by).agg(*[rate(k) for k in cuts], round_binary(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 3).alias("mrr"), F.count("*").alias("n_queries"))


def winner(metrics: DataFrame, name: str, first: str, second: str, seq: str, least: tuple[float, float] = RETRIEVAL_LEAST) -> DataFrame:
    """(winner, first, second, verdict): the best by first, then second, then place."""
    best = F.max(F.struct(F.col(first).alias("a"), F.col(second).alias("b"), (-F.col(seq)).alias("c"), F.col(name).alias("n")))
    return metrics.agg(best.alias("w")).select(F.col("w.n").alias("winner"), F.col("w.a").alias(first), F.col("w.b").alias(second), experiment_verdict(F.col("w.a"), F.col("w.b"), *least).alias("verdict"))


def style_metrics(scored: DataFrame, style: str = "style", verdict: str = "verdict", score: str = "overall_score", error: str = "error") -> DataFrame:
    """Pass rate among the scored, mean score, errors and unscored of each style."""
    is_error, has = F.coalesce(F.col(error), F.lit(False)), F.col(verdict).isNotNull()
    n = F.count_if(has & ~is_error)
    return scored.groupBy(style).agg(
        round_binary(F.count_if((F.col(verdict) == "pass") & ~is_error) / F.greatest(n, F.lit(1)), 3).alias("pass_rate"), round_binary(F.coalesce(F.avg(F.when(has & ~is_error, F.col(score))), F.lit(0.0)), 3).alias("mean_score"),
        F.count_if(is_error).alias("errors"), F.count_if(~has & ~is_error).alias("unscored"), n.alias("n_scored"),
    )


def failed_checks(scored: DataFrame, by: str, checks: str = "checks") -> DataFrame:
    """How often each check fails."""
    return scored.select(by, F.explode(checks).alias("check", "ok")).where(~F.col("ok")).groupBy(by, "check").agg(F.count("*").alias("n_failed"))


def judge_means(replies: DataFrame, reply: str, criteria: tuple[str, ...], by: str | None = None) -> DataFrame:
    """Mean of each criterion over replies that hold JSON, to two places (null for none), and how many do not."""
    v = replies.withColumn("_v", json_in(F.col(reply)))
    mark = lambda c: round_binary(F.avg(F.try_variant_get("_v", f"$.{c}", "double")), 2).alias(c)
    return v.groupBy(*([by] if by else [])).agg(*[mark(c) for c in criteria], F.count_if(F.col("_v").isNull()).alias("parse_failures"))


def ground_truth(chunks: DataFrame, items: DataFrame, source: str = "source_id", key: str = "chunk_id") -> DataFrame:
    """Every chunk of an item's source is relevant to it."""
    return items.join(chunks.select(source, key), source).groupBy("query_id").agg(F.sort_array(F.collect_list(key)).alias("relevant_chunk_ids"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of key and seed: the same on every run, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def judge_sample(rows: DataFrame, order: list[str], n: int = 15) -> DataFrame:
    """The first n texts, which a judge reads."""
    return rows.orderBy(*order).limit(n)


def synthetic_queries(chunks: DataFrame, generator: Generator, key: str = "chunk_id", text: str = "text", cut: int = 1000, n: int | None = None) -> DataFrame:
    """chunks with query_id and synthetic_query, a user's question that the generator makes of each text; blank ones go.

    n: so many chunks by a hash of their key, all without.
    """
    some = chunks if n is None else sampled(chunks, key, n)
    asked = some.withColumn("_prompt", F.concat(F.lit("Ask, as a user would, one question that this passage answers:\n"), F.substring(text, 1, cut)))
    made = completed(asked, "_prompt", generator, "synthetic_query").drop("_prompt").withColumn("synthetic_query", strip(F.col("synthetic_query")))
    return made.where("synthetic_query <> ''").withColumn("query_id", F.concat(F.lit("q-"), F.col(key).cast("string")))


def coaching_items(contexts: DataFrame) -> Column:
    """Keeps what can be diagnosed or is no request for help."""
    return ~((F.col("diagnostic_confidence") < 0.15) & (F.col("goal") == "troubleshoot"))
