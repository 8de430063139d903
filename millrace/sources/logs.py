"""JSON sources and sinks: logs, evaluation sets, reports, registries."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.store import exists

SESSIONS = "session_id string, timestamp timestamp, raw_problem string, status string, machine_type string, symptoms array<string>, verdict string, iterations int"
FEEDBACK = "session_id string, timestamp timestamp, rating string, comment string"
EVAL_ITEMS = "query_id string, synthetic_query string, relevant_chunk_ids array<string>, machine_type string, domain string"
SOURCES = "kind string, id string, name string, tags array<string>, priority string, max_videos int"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped; an empty frame where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def first_filled(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows, or the last."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def session_rows(results: DataFrame) -> DataFrame:
    """Results as session-log rows: 200 characters of the problem, all statuses, errors as well."""
    return results.select(
        "session_id", F.current_timestamp().alias("timestamp"), F.substring("raw_problem", 1, 200).alias("raw_problem"), "status", "machine_type", "symptoms", "verdict", F.coalesce("iterations", F.lit(1)).alias("iterations")
    )


def feedback_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("rating").isin("up", "down")).select("session_id", F.current_timestamp().alias("timestamp"), "rating", F.coalesce("comment", F.lit("")).alias("comment"))


def write_eval_items(df: DataFrame, path: str) -> None:
    """An evaluation set as JSON lines, in the columns of EVAL_ITEMS; read_jsonl reads it."""
    names = [c.split()[0] for c in EVAL_ITEMS.split(", ")]
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]).write.mode("overwrite").json(path)


def read_registry(spark: SparkSession, text: str) -> DataFrame:
    """A YAML registry of channels and playlists as rows, in its order."""
    import yaml

    said = yaml.safe_load(text) or {}
    rows = [(kind, s.get("id"), s.get("name"), s.get("tags") or [], s.get("priority"), s.get("max_videos")) for kind in ("channels", "playlists") for s in said.get(kind) or []]
    return spark.createDataFrame(rows, SOURCES)


def write_result(df: DataFrame, path: str, name: str) -> str:
    """Writes a result under its name and the time, and returns the place."""
    at = f"{path.rstrip('/')}/{name}_{datetime.now(UTC):%Y%m%dT%H%M%SZ}"
    df.coalesce(1).write.mode("overwrite").json(at)
    return at


def ingestion_report(chunks: DataFrame, **facts: object) -> DataFrame:
    """One row: chunks, sources, and counts by domain, method and channel as maps, with the facts given."""
    spark = chunks.sparkSession
    one = chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("source_id").alias("total_sources"))
    for c in ("domain", "method", "channel"):
        value = F.coalesce(c, F.lit("unknown")) if c in chunks.columns else F.lit("unknown")
        by = chunks.groupBy(value.alias("k")).agg(F.count("*").alias("n"))
        one = one.join(F.broadcast(by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(f"by_{c}"))))
    return one.join(F.broadcast(spark.range(1).select(F.lit(json.dumps(facts, sort_keys=True, default=str)).alias("facts"))))


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row with the rows as a markdown table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))), lambda s: s["x"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("markdown"))
