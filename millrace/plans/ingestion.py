"""One ingestion run: sources within a quota, outcomes by item, reasons to stop, marks of what is done.

Where a run stops is one row (the first refused item, or the first past the cap); every item's outcome
follows from comparing places with it, so that no window over all items is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.corpus import chunk_documents
from millrace.sources.listing import LIST_COST, SEARCH_COST, Blocked, Client
from millrace.sources.logs import ingestion_report
from millrace.sources.store import ChunkStore, delete, exists

LEAST_CONFIDENCE = 0.4
RUN_CAP = 100
DONE = ("ok", "no_transcript", "low_confidence")


def within_quota(sources: DataFrame, cost: str, order: str, budget: int, kind: str = "kind") -> DataFrame:
    """Registry rows (kind channels or playlists) with used_before and fetched.

    Of each kind, in order, sources are fetched while what was used and one more page fit the budget;
    playlists go on from what the fetched channels used. A source whose listing failed has a null cost
    and uses nothing. A registry is small by nature: its window is by kind.
    """
    up_to = Window.partitionBy(kind).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(kind).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    page = F.when(F.col(kind) == "channels", SEARCH_COST).otherwise(LIST_COST)
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0))
    stops = lambda used: F.max((used + page > budget).cast("int")).over(up_to) == 0
    channels = sources.where(F.col(kind) == "channels").withColumn("used_before", spent).withColumn("fetched", stops(F.col("used_before")))
    used = channels.agg(F.coalesce(F.sum(F.when(F.col("fetched"), F.col(cost))), F.lit(0)).alias("_used"))  # one row
    lists = sources.where(F.col(kind) != "channels").join(F.broadcast(used)).withColumn("used_before", F.col("_used") + spent).withColumn("fetched", stops(F.col("used_before"))).drop("_used")
    return channels.unionByName(lists)


def only_channel(sources: DataFrame, channel: str | None, kind: str = "kind", key: str = "id") -> DataFrame:
    """All sources, or one channel alone: playlists are passed over then."""
    return sources if channel is None else sources.where((F.col(kind) == "channels") & (F.col(key) == channel))


def metadata(sources: DataFrame, list_one: Callable[[str, str, int], tuple[list[dict], int]]) -> DataFrame:
    """(kind, id, video_id, title, quota, error): list_one(kind, id, most) for each source; a failure is a row, not the end."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", "id", "video_id", "title", "quota", "error"]
        for f in frames:
            rows = []
            for s in f.itertuples():
                try:
                    videos, quota = list_one(s.kind, s.id, 50 if pd.isna(s.max_videos) else int(s.max_videos))
                    rows += [(s.kind, s.id, v["source_id"], v.get("title"), quota if i == 0 else 0, None) for i, v in enumerate(videos)] or [(s.kind, s.id, None, None, quota, None)]
                except Exception as e:  # whatever one source raises stays its own
                    rows.append((s.kind, s.id, None, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return sources.select("kind", "id", "max_videos").mapInPandas(work, "kind string, id string, video_id string, title string, quota int, error string")


def fetched_transcripts(videos: DataFrame, client: Client, order: list[str], key: str = "source_id", language: str = "en") -> DataFrame:
    """videos (at most a run's cap) with transcript_text and blocked, fetched in order by one task.

    One task, since a refusal must end all calls: rows after it have neither text nor refusal.
    """
    schema = videos.schema.add("transcript_text", "string").add("blocked", "boolean")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for f in frames:
            texts, refused = [], []
            for v in f[key]:
                parts, no = None, False
                if not stopped:
                    try:
                        parts = client.transcript(v, language, False) or client.transcript(v, language, True)
                    except Blocked:
                        stopped = no = True
                texts.append(" ".join(parts) if parts else None)
                refused.append(no)
            yield f.assign(transcript_text=texts, blocked=refused)

    return videos.repartition(1).sortWithinPartitions(*order).mapInPandas(work, schema)


def outcomes(items: DataFrame, processed: DataFrame, order: list[str], key: str = "source_id", available: Column | None = None, blocked: Column | None = None, confidence: Column | None = None, cap: int = RUN_CAP) -> DataFrame:
    """items with outcome and mark (whether a later run passes it over).

    In order: processed (before this run), no_transcript, low_confidence or ok; at the place where the run
    stops blocked or capped; not_reached beyond it. Only items that are not processed count for the cap.
    order must be total. The place is found by a top of cap + 1 rows and a minimum.
    """
    at = F.struct(*order)
    yes = lambda c, default: F.lit(default) if c is None else F.coalesce(c, F.lit(default))
    done = processed.select(key).distinct().withColumn("_done", F.lit(True))
    rows = items.join(done, key, "left").withColumns({"_at": at, "_blocked": yes(blocked, False), "_has": F.lit(True) if available is None else F.coalesce(available, F.lit(False)), "_sure": F.lit(1.0) if confidence is None else F.coalesce(confidence, F.lit(0.0))})
    due = rows.where("_done is null")
    full = due.select("_at").orderBy("_at").limit(cap + 1).agg(F.when(F.count("*") > cap, F.max("_at")).alias("_full"))  # one row
    refused = due.where("_blocked").agg(F.min("_at").alias("_refused"))  # one row
    rows = rows.join(F.broadcast(full)).join(F.broadcast(refused))
    late = lambda c: F.coalesce(F.col("_at") > F.col(c), F.lit(False))
    here = lambda c: F.coalesce(F.col("_at") == F.col(c), F.lit(False))
    outcome = (
        F.when(late("_full") | late("_refused"), "not_reached").when(F.col("_done"), "processed").when(here("_full"), "capped").when(here("_refused"), "blocked")
        .when(~F.col("_has"), "no_transcript").when(F.col("_sure") < LEAST_CONFIDENCE, "low_confidence").otherwise("ok")
    )
    out = rows.withColumn("outcome", outcome).drop("_done", "_at", "_blocked", "_has", "_sure", "_full", "_refused")
    return out.withColumn("mark", F.col("outcome").isin(*DONE))


def stop_reason(results: DataFrame, source: str, key: str = "source_id") -> DataFrame:
    """(reason, source, resume_id): one row where a run stopped early, none after a full pass."""
    names = F.when(F.col("outcome") == "blocked", "ip_blocked").otherwise("max_videos_per_run")
    return results.where(F.col("outcome").isin("blocked", "capped")).select(names.alias("reason"), F.col(source).alias("source"), F.col(key).alias("resume_id"))


class Progress:
    """Marks of what is done, appended as parquet: a mark that is written twice counts once."""

    def __init__(self, spark: SparkSession, path: str, key: str = "source_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{key} string, outcome string, at timestamp"

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)
        return rows.groupBy(self.key).agg(F.min_by("outcome", "at").alias("outcome"), F.min("at").alias("at"))

    def mark(self, results: DataFrame) -> None:
        results.where("mark").select(F.col(self.key).cast("string").alias(self.key), "outcome", F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)

    def reset(self) -> None:
        if exists(self.spark, self.path):
            delete(self.spark, self.path)


def run(items: DataFrame, store: ChunkStore, progress: Progress, fetch: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame],
        order: list[str], source: str = "channel", cap: int = RUN_CAP, dry_run: bool = False, reset: bool = False, signals: list[str] | None = None, key: str = "source_id") -> dict:
    """A whole run over items; returns counts by outcome, the stop (or None), chunks and the report's row.

    fetch gives the first `cap` items that are due transcript_text and blocked; classify adds
    classification_confidence; keep stores a frame (so that nothing is fetched twice) and reads it back.
    A dry run writes neither chunks nor marks. Chunks are stored before marks: a run lost between the
    two is repeated, and its upsert changes nothing.
    """
    if reset:
        progress.reset()
    due = items.join(progress.read().select(key), key, "left_anti").orderBy(*order).limit(cap)
    got = keep(classify(fetch(due)))
    facts = got.select(key, "transcript_text", "blocked", *[c for c in got.columns if c not in items.columns and c not in ("transcript_text", "blocked")])
    results = keep(outcomes(items.join(facts, key, "left"), progress.read(), order, key, F.length("transcript_text") > 0, F.col("blocked"), F.col("classification_confidence"), cap))
    counts = {r["outcome"]: r["count"] for r in results.groupBy("outcome").count().collect()}  # at most seven names
    stop = stop_reason(results, source, key).first()
    chunks = chunk_documents(results.where("outcome = 'ok'"), "transcript_text", key, signals).withColumn("text", F.col("chunk_text")).dropDuplicates(["chunk_id"])
    chunks = keep(embed(chunks))
    n = chunks.count()
    if not dry_run:
        store.upsert(chunks)
        progress.mark(results)
    report = ingestion_report(chunks if dry_run else store.read(), dry_run=dry_run, outcomes=counts, new_chunks=n)
    return {"outcomes": counts, "stop": stop.asDict() if stop else None, "new_chunks": n, "report": report.first().asDict()}
