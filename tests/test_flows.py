"""Stores, logs, listings and streams."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import listing, logs
from millrace.sources.store import ChunkStore
from millrace.streaming import flows

SCHEMA = "chunk_id string, text string, source_id string, method string"


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), SCHEMA)
    assert store.count() == 0
    rows = spark.createDataFrame([("a", "x", "s1", "moka"), ("b", "y", "s1", "v60")], SCHEMA)
    store.upsert(rows)
    store.upsert(rows)
    assert store.count() == 2
    store.export(str(tmp_path / "snap"))
    store.upsert(spark.createDataFrame([("c", "z", "s1", "moka")], SCHEMA), replace_sources=True)
    assert [r.chunk_id for r in store.read().collect()] == ["c"]
    store.restore(str(tmp_path / "snap"))
    assert store.where_method(["moka"]).count() == 1
    store.drop()
    assert store.count() == 0


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps({"session_id": "a", "timestamp": "2026-01-01T00:00:00Z", "symptoms": ["bitter"], "iterations": 1}) + "\n\n")
    assert logs.read_jsonl(spark, str(tmp_path / "none"), logs.SESSIONS).count() == 0
    real = logs.read_jsonl(spark, str(path), logs.SESSIONS)
    assert logs.first_filled(spark.createDataFrame([], logs.SESSIONS), real).first().symptoms == ["bitter"]
    reg = logs.read_registry(spark, "channels:\n - {id: A, name: x, tags: [a], max_videos: 3}\nplaylists:\n - {id: B}\n").collect()
    assert [(r.kind, r.id, r.tags) for r in reg] == [("channels", "A", ["a"]), ("playlists", "B", [])]


def fake():
    """A client whose class is local, so that workers get it by value."""

    class Fake:
        def page(self, kind, source, token, size):
            start = int(token or 0)
            ids = [f"{source}{i}" for i in range(start, min(start + size, 70))]
            return ids, str(start + size) if start + size < 70 else None

        def details(self, ids):
            return [(i, f"t {i}", "d", ["grind", "filter"], "ch", 60) for i in ids]

        def transcript(self, video, language, generated):
            return None if video.endswith("1") else (["made", "up"] if generated else None)

    return Fake()


def test_listing(spark):
    got = list(listing.listed(fake(), "channel", "c", 60))
    assert len(got) == 60 and sum(g[3] for g in got) == 200 and got[-1][:3] == ("c", "c59", 59)
    videos = spark.createDataFrame([("c0",), ("c1",)], "video_id string")
    docs = listing.document_rows(listing.with_details(videos, fake()).withColumn("more", F.array(F.lit("espresso"), F.lit("grind"))), "more")
    assert docs.orderBy("source_id").first().tags == ["grind", "filter", "espresso"]
    assert [tuple(r) for r in listing.with_transcripts(docs, fake()).collect()] == [("c0", "made up")]
    assert all(1 <= listing.pacing(1, 2) <= 2 for _ in range(20))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, n = tmp_path / "in", "word " * 50
    src.mkdir()
    (src / "a.json").write_text("".join(json.dumps({"source_id": f"s{i}", "text": f"{n}number {i}."}) + "\n" for i in range(3)))
    store = ChunkStore(spark, str(tmp_path / "store"), SCHEMA, partition=None)
    for k in range(2):
        stream = flows.json_stream(spark, str(src), "source_id string, text string, method string")
        flows.ingest(stream, store, str(tmp_path / f"cp{k}")).awaitTermination()
        assert store.count() == 3


@pytest.fixture
def sessions(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    rows = [{"session_id": f"s{i}", "timestamp": f"2026-01-0{1 + i // 4}T0{i % 9}:00:00Z", "status": "coaching" if i % 2 else "error"} for i in range(8)]
    (src / "x.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return flows.json_stream(spark, str(src), logs.SESSIONS)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_dashboard_stream(sessions):
    got = drained(flows.dashboard(sessions), "dash", "complete")
    assert sorted((str(r.day), r.status, r.n) for r in got) == [("2026-01-01", "coaching", 2), ("2026-01-01", "error", 2), ("2026-01-02", "coaching", 2), ("2026-01-02", "error", 2)]


def test_budget_stream(sessions):
    events = sessions.withColumn("event_id", F.substring("session_id", 2, 9).cast("long"))
    got = drained(flows.daily_budget(events, "timestamp", "event_id", 3), "budget")
    assert sorted((str(r.day), r.event_id, r.nth, r.served) for r in got) == [("2026-01-01", i, i + 1, i < 3) for i in range(4)] + [("2026-01-02", 4 + i, i + 1, i < 3) for i in range(4)]


def test_conversations_and_dedup_streams(sessions):
    assert len(drained(flows.deduplicated(sessions, "session_id", "timestamp"), "dedup")) == 8
    assert sum(r.turns for r in drained(flows.conversations(sessions, "status", "timestamp", "10 hours"), "conv", "complete")) == 8
