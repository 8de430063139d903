"""The training-corpus pipeline over `documents`: five stages, each on all that the one before kept.

quality      documents that the line-first rules reject go; failed lines of the others go
line_dedup   repeated lines go, all but the first of each group; a document left without a word goes
near_dedup   one document of each near-duplicate group stays
mixing       documents are taken as often as their source's target asks
bpe          texts become token ids

Defined results: null, empty and blank texts fail the quality rules and go; an empty table gives an empty
one. Rows that share a doc_id are one document: of rows with its text as well one stays (the least), rows
of other texts stay beside it. A row without a doc_id loses no lines and is no copy of another. Repeated
rows are documents of their own in mixing and BPE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, lines, mixing, neardup, quality
from millrace.llm.core import dropped, fresh, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (gone,) = fresh(docs, "_gone")
    out = lines.without_repeats(docs, gone=gone)
    emptied = F.col(gone).isNotNull() & ~quality.has_word(F.col("text"))
    out = out.where(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n, kept, id_ = fresh(docs, "_n", "_kept", "_id")
    marks = neardup.near_duplicates(docs).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(id_)).agg(F.min("kept").alias(kept), F.count("*").alias(n))
    marked = docs.join(marks.where(~F.col(kept) | (F.col(n) > 1)), F.col("doc_id") == F.col(id_), "left")
    once = marked.where(F.col(kept).isNull()).select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = marked.where(F.col(kept)).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias(n)).select("doc_id", "text", f"{n}.*")
    return once.unionByName(again.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.word_bpe())
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", bpe_encode),
]

#: SimHash lines, MinHash groups and BPE are not expressible in SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
