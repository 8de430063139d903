"""Remote listings as Spark sources: pages of a channel or playlist, details and transcripts in batches.

The remote side is a Client that the caller gives; nothing here opens a connection of its own. What
is fetched is written down before it is used, since a task may run twice.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.text import ordered_union

PAGE, DETAILS = 50, 50
SEARCH_COST, LIST_COST = 100, 1
VIDEO = "source_id string, title string, description string, tags array<string>, channel string, duration_seconds int"


class Blocked(Exception):
    """The remote side refuses further calls: the run stops, and nothing is marked as done."""


class Client(Protocol):
    def page(self, kind: str, source: str, token: str | None, size: int) -> tuple[list[str], str | None]: ...
    def details(self, ids: list[str]) -> list[dict]: ...
    def transcript(self, video: str, language: str, generated: bool) -> list[str] | None: ...


class ListingSource(DataSource):
    """spark.read.format("millrace_listing"): options kind (channel, playlist), sources (comma-separated),
    max_results, client (module:attribute of a Client). One partition a source; columns source, video_id, position, quota."""

    @classmethod
    def name(cls) -> str:
        return "millrace_listing"

    def schema(self) -> str:
        return "source string, video_id string, position int, quota int"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options["sources"].split(",") if s]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, attribute = self.options["client"].partition(":")
        yield from listed(getattr(importlib.import_module(module), attribute), self.options.get("kind", "channel"), partition.value, int(self.options.get("max_results", PAGE)))


def listed(client: Client, kind: str, source: str, most: int) -> Iterator[tuple[str, str, int, int]]:
    """(source, video, position, quota of its page) page by page until `most` or no further page."""
    token, n = None, 0
    cost = SEARCH_COST if kind == "channel" else LIST_COST
    while n < most:
        ids, token = client.page(kind, source, token, min(PAGE, most - n))
        for i, v in enumerate(ids[: most - n]):
            yield source, v, n + i, cost if i == 0 else 0
        n += len(ids)
        if not token or not ids:
            return


def with_details(videos: DataFrame, client: Client, video: str = "video_id") -> DataFrame:
    """Details of each video, fetched in batches of DETAILS."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f[video].tolist()
            rows = [d for i in range(0, len(ids), DETAILS) for d in client.details(ids[i : i + DETAILS])]
            yield pd.DataFrame(rows, columns=["source_id", "title", "description", "tags", "channel", "duration_seconds"])

    return videos.select(video).mapInPandas(work, VIDEO)


def document_rows(details: DataFrame, source_tags: str | None = None) -> DataFrame:
    """Details as documents: an address, and the source's tags after the video's own, each once."""
    tags = ordered_union(F.col("tags"), F.col(source_tags)) if source_tags else F.coalesce("tags", F.array().cast("array<string>"))
    return details.select("source_id", "title", "channel", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("source_id")).alias("url"), "description", tags.alias("tags"), "duration_seconds")


def with_transcripts(videos: DataFrame, client: Client, video: str = "source_id", language: str = "en", least: float = 0.0, most: float = 0.0) -> DataFrame:
    """(video, transcript_text): written ones before generated ones; videos without one go; Blocked stops the run.

    least and most: seconds between two fetches of a task, drawn evenly.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f[video]:
                parts = client.transcript(v, language, False) or client.transcript(v, language, True)
                if parts:
                    out.append((v, " ".join(parts)))
                if most > 0:
                    time.sleep(pacing(least, most))
            yield pd.DataFrame(out, columns=[video, "transcript_text"])

    return videos.select(video).mapInPandas(work, f"{video} string, transcript_text string")


def pacing(least: float, most: float) -> float:
    return random.uniform(least, max(least, most))
