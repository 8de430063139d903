"""Ingestion runs, the agent's tools, envelopes, and functions that have no SQL form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import evals, monitor, retrieve, tools
from millrace.operators.generate import Agent
from millrace.plans import ingestion
from millrace.plans.coach import coach, coach_and_log
from millrace.sources import logs
from millrace.sources.listing import Blocked
from millrace.sources.store import ChunkStore

ORDER = ["channel", "source_id"]


def test_round_binary(spark):
    rng = random.Random(1)
    xs = [k / 1000 for k in range(-3000, 3001)] + [k / 16 for k in range(-64, 65)] + [rng.uniform(-9, 9) for _ in range(500)] + [1e300, 2.675, 1.005, 0.0]
    for digits in (0, 1, 2, 3):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.round_binary(F.col("x"), digits).alias("r")).collect()
        assert all(r.r == round(r.x, digits) for r in got)
    assert spark.range(1).select(text.round_binary(F.lit(None).cast("double"), 2)).first()[0] is None


def test_forms(spark):
    words = ["o'brien half-life", "ABC 2nd", "", "éa b"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.title_case(F.col("w")).alias("t")).collect()
    assert all(r.t == r.w.title() for r in got)
    t = spark.createDataFrame([("2026-01-02T23:30:00+00:00",), ("no",), (None,)], "t string").select(text.iso_timestamp(F.col("t")).alias("t"))
    assert [str(r[0]) for r in t.select(text.midnight(F.col("t")).cast("string")).collect()] == ["2026-01-02 00:00:00", "None", "None"]
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x"), ("a", None)], "k string, v string")
    assert rows.where(retrieve.metadata_matches({"k": {"$in": ["a", "b"]}, "v": "x"})).count() == 2 and rows.where(retrieve.metadata_matches({})).count() == 4
    assert tuple(monitor.satisfaction(spark.createDataFrame([], "rating string")).first()) == (0, None)


def items(spark, n=8):
    return spark.createDataFrame([(f"v{i}", "a" if i < 4 else "b", "word " * 60 + ".") for i in range(n)], "source_id string, channel string, body string")


@pytest.mark.parametrize(
    ("cap", "blocked", "want", "stop"),
    [
        (9, None, ["processed", "ok", "no_transcript", "low_confidence", "ok", "ok", "ok", "ok"], None),
        (3, None, ["processed", "ok", "no_transcript", "low_confidence", "capped"] + ["not_reached"] * 3, ("max_videos_per_run", "b", "v4")),
        (9, "v3", ["processed", "ok", "no_transcript", "blocked"] + ["not_reached"] * 4, ("ip_blocked", "a", "v3")),
        (2, "v3", ["processed", "ok", "no_transcript", "capped"] + ["not_reached"] * 4, ("max_videos_per_run", "a", "v3")),
        (0, None, ["processed", "capped"] + ["not_reached"] * 6, ("max_videos_per_run", "a", "v1")),
    ],
)
def test_outcomes(spark, cap, blocked, want, stop):
    rows = items(spark)
    got = ingestion.outcomes(rows, rows.where("source_id = 'v0'"), ORDER, available=F.col("source_id") != "v2", blocked=F.col("source_id") == F.lit(blocked), confidence=F.when(F.col("source_id") == "v3", 0.1).otherwise(0.9), cap=cap)
    assert [r.outcome for r in got.orderBy("source_id").collect()] == want
    row = ingestion.stop_reason(got, "channel").first()
    assert (tuple(row) if row else None) == stop
    empty = ingestion.outcomes(rows.where("false"), rows, ORDER, cap=cap)
    assert empty.count() == 0


def client():
    class Fake:
        def transcript(self, video, language, generated):
            if video == "v6":
                raise Blocked
            return None if video == "v1" else [f"{video} says", "word " * 60 + "."]

    return Fake()


def test_run(spark, tmp_path):
    places = iter(range(1000))

    def keep(df):
        at = str(tmp_path / f"k{next(places)}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    store, progress = ChunkStore(spark, str(tmp_path / "s"), "chunk_id string, text string, source_id string, channel string", partition=None), ingestion.Progress(spark, str(tmp_path / "p"))
    rows = items(spark)
    remote = client()
    go = lambda **how: ingestion.run(rows, store, progress, lambda due: ingestion.fetched_transcripts(due, remote, ORDER), lambda df: df.withColumn("classification_confidence", F.lit(0.9)), lambda c: c, keep, ORDER, **how)
    dry = go(cap=3, dry_run=True)
    assert dry["outcomes"] == {"ok": 2, "no_transcript": 1, "capped": 1, "not_reached": 4} and dry["new_chunks"] == 2 and store.count() == 0 and progress.read().count() == 0
    one = go(cap=3)
    assert one["stop"] == {"reason": "max_videos_per_run", "source": "a", "resume_id": "v3"} and store.count() == 2
    two = go(cap=9)
    assert two["stop"]["reason"] == "ip_blocked" and two["stop"]["resume_id"] == "v6" and two["outcomes"] == {"processed": 3, "ok": 3, "blocked": 1, "not_reached": 1}
    assert store.count() == 5 and two["report"]["total_chunks"] == 5 and progress.read().count() == 6
    again = go(cap=1, reset=True)
    assert again["outcomes"]["ok"] == 1 and "processed" not in again["outcomes"] and store.count() == 5


def test_quota_and_metadata(spark):
    rows = [("channels", "c1", 150, 1), ("channels", "c2", None, 2), ("channels", "c3", 120, 3), ("playlists", "p1", 40, 4), ("playlists", "p2", 1, 5)]
    s = spark.createDataFrame(rows, "kind string, id string, cost int, seq int")
    got = {r.id: (r.used_before, r.fetched) for r in ingestion.within_quota(s, "cost", "seq", 250).collect()}
    assert got == {"c1": (0, True), "c2": (150, True), "c3": (150, True), "p1": (270, False), "p2": (310, False)}
    assert [r.id for r in ingestion.only_channel(s, "c1").collect()] == ["c1"] and ingestion.only_channel(s, "p1").count() == 0 and ingestion.only_channel(s, None).count() == 5

    def one(kind, id, most):
        if id == "c2":
            raise ValueError("no such channel")
        return [{"source_id": f"{id}-{i}", "title": "t"} for i in range(2 if id == "c1" else 0)], 101

    listed = ingestion.metadata(s.withColumn("max_videos", F.lit(None).cast("int")), one).collect()
    assert sorted((r.id, r.video_id or "", r.quota, r.error or "") for r in listed)[:3] == [("c1", "c1-0", 101, ""), ("c1", "c1-1", 0, ""), ("c2", "", 0, "ValueError: no such channel")]


def test_tools(spark, tmp_path):
    said = tools.schemas()
    assert [t["name"] for t in said] == ["extract_symptoms", "ask_clarification", "retrieve_knowledge", "generate_coaching", "validate_coaching", "answer_general_question"]
    assert json.dumps(said) and [t["input_schema"]["required"] for t in said] == [["user_description"], ["question", "reason"], ["query", "machine_type"], [], ["coaching_text"], ["question_type", "user_question"]]
    asked = spark.createDataFrame([("a", "My DeLonghi Dinamica makes bitter espresso, 28 second extraction"), ("b", "hello"), ("c", "error E4 on my Jura E8"), ("d", None)], "query_id string, raw_problem string")
    early = tools.retrieve_knowledge(asked, spark.createDataFrame([], "query_id string, retrieval_rank int, title string, channel string, text string, semantic_score double"))
    assert all("extract_symptoms comes first" in r.tool_result for r in early.collect()) and "error" in tools.generate_coaching(asked).first().tool_result
    places = iter(range(100))

    def keep(df):
        at = str(tmp_path / f"a{next(places)}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    found = spark.createDataFrame([("a", i, "t", "ch", "grind coarser", 0.9 - i / 10) for i in range(8)], "query_id string, retrieval_rank int, title string, channel string, text string, semantic_score double")
    out = {r.query_id: r for r in Agent(tools.registry(found), tools.by_rule, keep).run(asked).collect()}
    assert out["a"].calls[-1] == "validate_coaching" and out["a"].knowledge_quality == "good" and out["a"].chunks_retrieved == 7 and len(out["a"].top_passages) == 5
    assert out["b"].status == "clarification_needed" and out["c"].calls == ["extract_symptoms", "answer_general_question"] and out["c"].coaching_text.startswith("Machine faults")
    assert out["d"].status == "clarification_needed"


def test_coach(spark, tmp_path):
    asked = spark.createDataFrame([("a", "My DeLonghi Dinamica makes bitter espresso, 28 second extraction"), ("b", ""), ("c", "who won the match"), ("d", "how does coffee extraction science work")], "query_id string, raw_problem string")
    chunks = spark.createDataFrame([("k1", "bitter espresso over-extraction grind coarser", "general")], "chunk_id string, text string, method string")

    def keep(df):
        df.write.parquet(str(tmp_path / "out"))
        return spark.read.parquet(str(tmp_path / "out"))

    out = {r.query_id: r for r in coach_and_log(asked, str(tmp_path / "log"), keep).collect()}
    assert out["a"].status == "coaching" and out["a"].coaching_text and out["b"].status == "error" and out["b"].clarification_question and out["c"].iterations == 0
    logged = logs.read_jsonl(spark, str(tmp_path / "log"), logs.SESSIONS)
    assert logged.count() == 4 and {r.session_id for r in logged.collect()} == {r.session_id for r in out.values()}
    live = {r.query_id: r for r in coach(asked, retrieve.embed(chunks, "text"), generator=lambda ps: ["text " + p[:9] for p in ps]).collect()}
    assert live["a"].coaching_text.startswith("text") and live["a"].avg_semantic_score > 0 and live["b"].coaching_text is None


def test_eval_items(spark, tmp_path):
    made = evals.synthetic_queries(spark.createDataFrame([("k1", "x"), ("k2", "y")], "chunk_id string, text string"), lambda ps: [" why? " if p.endswith("x") else "  " for p in ps])
    assert [(r.query_id, r.synthetic_query) for r in made.collect()] == [("q-k1", "why?")]
    logs.write_eval_items(made.withColumn("relevant_chunk_ids", F.array("chunk_id")), str(tmp_path / "e"))
    assert logs.read_jsonl(spark, str(tmp_path / "e"), logs.EVAL_ITEMS).first().relevant_chunk_ids == ["k1"]
    store = ChunkStore(spark, str(tmp_path / "s"), "chunk_id string, text string", partition=None)
    store.upsert(made.select("chunk_id", "text"))
    assert 0 < store.export(str(tmp_path / "x")) < 1
