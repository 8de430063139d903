"""Structured Streaming: incremental ingestion, the live dashboard, daily budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.corpus import chunk_documents
from millrace.operators.sequence import capped
from millrace.sources.store import ChunkStore


def json_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def ingest(documents: DataFrame, store: ChunkStore, checkpoint: str, text: str = "text", source_id: str = "source_id", signals: list[str] | None = None) -> StreamingQuery:
    """New documents into the store: a batch that is replayed upserts the same rows. Ends when all is read."""

    def batch(docs: DataFrame, _: int) -> None:
        once = docs.dropDuplicates([source_id])
        chunks = chunk_documents(once, text, source_id, signals).withColumn("text", F.col("chunk_text")).dropDuplicates(["chunk_id"])
        store.upsert(chunks)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(documents: DataFrame, processed: DataFrame, key: str, order: list[str], by: list[str], cap: int) -> DataFrame:
    """The next documents of a run: those not processed, at most `cap` of each group."""
    return capped(documents.join(processed.select(key), key, "left_anti"), by, order, cap)


def dashboard(sessions: DataFrame, ts: str = "timestamp", late: str = "2 days") -> DataFrame:
    """Sessions by UTC day and status, as they come; events later than `late` are left out."""
    return sessions.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), "status").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "status", "n")


def deduplicated(rows: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def conversations(turns: DataFrame, conversation: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Turns by session: a gap without a turn ends one."""
    return turns.withWatermark(ts, gap).groupBy(conversation, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("turns")).select(conversation, F.col("w.start").alias("start"), "turns")


BUDGET = "day date, event_id long, nth long, served boolean"


def daily_budget(events: DataFrame, ts: str, key: str, daily: int) -> DataFrame:
    """(day, event_id, nth, served): a counter for each UTC day that starts anew on the next.

    Events of one batch count in order of time and id; a day's state is dropped two days later.
    """

    def step(day: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        nth = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        state.setTimeoutTimestamp(int(pd.Timestamp(day[0]).timestamp() * 1000) + 3 * 86_400_000)
        yield pd.DataFrame({"day": rows["day"], "event_id": rows["event_id"], "nth": list(nth), "served": [x <= daily for x in nth]})

    rows = events.select(F.col(ts).alias("ts"), F.col(key).cast("long").alias("event_id")).withWatermark("ts", "2 days").withColumn("day", F.to_date("ts"))
    return rows.groupBy("day").applyInPandasWithState(step, BUDGET, "n long", "append", GroupStateTimeout.EventTimeTimeout)


BUDGETS = "day date, event_id long, session string, day_nth long, session_nth long, mode string"


def budgeted(events: DataFrame, ts: str, key: str, session: str, daily: int, per_session: int) -> DataFrame:
    """(day, event_id, session, day_nth, session_nth, mode): live while the UTC day's budget and the session's share of it hold, else demo.

    A day's counter is a value, its sessions' counters are a map; a timer drops both two days after the day. Events of
    one batch count in order of time and id. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Budget(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.used = handle.getValueState("used", "n long")
            self.sessions = handle.getMapState("sessions", "session string", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            f = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            n = self.used.get()[0] if self.used.exists() else 0
            held: dict[str, int] = {}
            out = []
            for event, who in zip(f["event_id"], f["session"], strict=True):
                n += 1
                if who not in held:
                    held[who] = self.sessions.getValue((who,))[0] if self.sessions.containsKey((who,)) else 0
                held[who] += 1
                out.append((event, who, n, held[who], "live" if n <= daily and held[who] <= per_session else "demo"))
            self.used.update((n,))
            for who, many in held.items():
                self.sessions.updateValue((who,), (many,))
            self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + 3 * 86_400_000)
            made = pd.DataFrame(out, columns=["event_id", "session", "day_nth", "session_nth", "mode"])
            made.insert(0, "day", key[0])
            yield made

        def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
            self.used.clear()
            self.sessions.clear()
            yield pd.DataFrame(columns=["day", "event_id", "session", "day_nth", "session_nth", "mode"])

        def close(self) -> None:
            pass

    rows = events.select(F.col(ts).alias("ts"), F.col(key).cast("long").alias("event_id"), F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"))
    rows = rows.withWatermark("ts", "2 days").withColumn("day", F.to_date("ts"))
    return rows.groupBy("day").transformWithStateInPandas(Budget(), BUDGETS, "append", "eventTime")


def with_feedback(sessions: DataFrame, feedback: DataFrame, key: str = "session_id", ts: str = "timestamp", late: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Sessions with their feedback (rating, given), null for none: a left outer join of two streams.

    Feedback counts if it comes within `within` of its session; a session without any is given once that time and
    `late` have passed by the watermarks, and the state of both sides goes with it. Feedback sent twice counts once.
    """
    s = sessions.withWatermark(ts, late)
    f = feedback.select(F.col(key).alias("_key"), F.col(ts).alias("given"), "rating").withWatermark("given", late).dropDuplicatesWithinWatermark(["_key"])
    on = F.expr(f"`{key}` = _key AND given >= `{ts}` AND given <= `{ts}` + INTERVAL {within}")
    return s.join(f, on, "leftOuter").drop("_key")
