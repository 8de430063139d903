"""The retrieval experiment, the demo store, and the metadata cache of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.corpus import chunk_documents
from millrace.operators.classify import classify
from millrace.operators.diagnose import diagnose, retrieval_query
from millrace.operators.evals import first_hits, retrieval_metrics, winner
from millrace.operators.extract import extract
from millrace.operators.retrieve import embed, overlap_scorer, retrieve
from millrace.operators.sequence import within_budget
from millrace.sources.store import ChunkStore

#: name -> (re-ranked, search mode, rewritten query): fixed values of the grid.
CONFIGS = {"C1_vector_only": (False, "vector", True), "C2_vector_ce": (True, "vector", True), "C3_hybrid_ce": (True, "hybrid", True), "C4_raw_query_ce": (True, "vector", False)}


def build_store(store: ChunkStore, docs: DataFrame, text: str = "transcript_text", source_id: str = "source_id", signals: list[str] | None = None) -> ChunkStore:
    """Classified, chunked and embedded documents, upserted."""
    chunks = chunk_documents(classify(docs).select(source_id, "title", "channel", "url", "domain", "method", "difficulty", text), text, source_id, signals)
    rows = embed(chunks.withColumn("text", F.col("chunk_text")).dropDuplicates(["chunk_id"]), "text")
    store.upsert(rows)
    return store


def open_store(store: ChunkStore) -> DataFrame:
    rows = store.read()
    if rows.isEmpty():
        raise ValueError(f"{store.path} is empty")
    return rows


def contexts(items: DataFrame) -> DataFrame:
    """Items (query_id, synthetic_query) with features, diagnosis and the rewritten query, by rules alone."""
    return diagnose(extract(items.withColumnRenamed("synthetic_query", "raw_problem"))).withColumn("rewritten", retrieval_query())


def run_configs(corpus: DataFrame, items: DataFrame, configs: dict[str, tuple[bool, str, bool]] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(config, query_id, chunk_id, rank) of every configuration, each over all queries at once."""
    asked = keep(contexts(items))
    out = None
    for name, (reranked, mode, rewritten) in (configs or CONFIGS).items():
        q = embed(asked.select("query_id", F.col("rewritten" if rewritten else "raw_problem").alias("text"), "machine_type"), "text")
        found = retrieve(corpus, q, mode=mode, scorer=overlap_scorer if reranked else None).select(F.lit(name).alias("config"), "query_id", "chunk_id", F.col("retrieval_rank").alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


def experiment(ranked: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of each configuration, and the winner with its verdict."""
    truth = items.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    metrics = retrieval_metrics(first_hits(ranked, truth, by=("config",)), ("config",))
    # ties go to the first of the grid, other names behind it
    place = F.coalesce(F.array_position(F.array(*map(F.lit, CONFIGS)), F.col("config")), F.lit(0))
    place = F.when(place > 0, place).otherwise(len(CONFIGS) + 1)
    return metrics, winner(metrics.withColumn("seq", place), "config", "hit_rate_5", "mrr", "seq")


def cached(sources: DataFrame, cache: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(rows of the cache for these sources, the sources that it lacks)."""
    return cache.join(sources.select(key), key, "left_semi"), sources.join(cache.select(key).distinct(), key, "left_anti")


def write_cache(rows: DataFrame, path: str, key: str = "source_id") -> None:
    """Replaces the folders of these sources only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def affordable(sources: DataFrame, cost: str, order: str, budget: int) -> DataFrame:
    """Sources in order until the next would pass the budget; the pages of one count before it is begun."""
    return within_budget(sources, [], [order], F.col(cost), budget)
