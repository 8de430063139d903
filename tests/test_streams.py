"""Streams with state of their own: budgets across restarts, feedback joined to sessions."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.streaming import flows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def at(day, hour, minute=0):
    return dt.datetime(2026, 3, day, hour, minute)


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.set(PROVIDER, old)


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_budget_across_a_restart(spark, tmp_path, rocks):
    rows = [(i, at(1 + i // 20, 8 + i % 12, i % 60), f"s{i % 3}" if i % 5 else None) for i in range(60)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    shape = "event_id long, ts timestamp, session string"
    # the first run ends in the middle of the second day
    for part in (rows[:13], rows[13:31], rows[31:34], rows[34:]):
        spark.createDataFrame(sorted(part, key=lambda r: r[1]), shape).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        run(flows.budgeted(events, "ts", "event_id", "session", 12, 4), out, checkpoint)
    got = {r.event_id: (r.day, r.day_nth, r.session_nth, r["mode"]) for r in spark.read.parquet(out).collect()}
    assert len(got) == 60 and spark.read.parquet(out).count() == 60

    # the same in plain Python: what a run gets counts by time, runs one after the other
    want, used, per = {}, {}, {}
    for part in (rows[:13], rows[13:31], rows[31:34], rows[34:]):
        for i, ts, who in sorted(part, key=lambda r: (r[1], r[0])):
            day, who = ts.date(), who or ""
            used[day] = used.get(day, 0) + 1
            per[day, who] = per.get((day, who), 0) + 1
            want[i] = (day, used[day], per[day, who], "live" if used[day] <= 12 and per[day, who] <= 4 else "demo")
    assert got == want and {m for *_, m in want.values()} == {"live", "demo"}


def test_budget_in_order_equals_the_batch(spark, tmp_path, rocks):
    shape = "event_id long, ts timestamp, session string"
    rows = [(i, at(1, 0) + dt.timedelta(minutes=37 * i), f"s{i % 4}") for i in range(90)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
        run(flows.budgeted(spark.readStream.schema(shape).parquet(source), "ts", "event_id", "session", 20, 6), out, str(tmp_path / "c"))
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    own = Window.partitionBy(F.to_date("ts"), "session").orderBy("ts", "event_id")
    batch = spark.createDataFrame(rows, shape).select("event_id", F.row_number().over(day).alias("d"), F.row_number().over(own).alias("s"))
    want = {r.event_id: (r.d, r.s, "live" if r.d <= 20 and r.s <= 6 else "demo") for r in batch.collect()}
    assert {r.event_id: (r.day_nth, r.session_nth, r["mode"]) for r in spark.read.parquet(out).collect()} == want


def test_feedback_joins_sessions(spark, tmp_path):
    s_shape, f_shape = "session_id string, timestamp timestamp, verdict string", "session_id string, timestamp timestamp, rating string"
    sessions = [[("a", at(1, 8), "pass"), ("b", at(1, 8, 5), "warn"), ("c", at(1, 8, 10), "fail")], [("d", at(1, 9), "pass")], [("z", at(9, 9), "pass")], [("y", at(12, 9), "pass")]]
    feedback = [[("a", at(1, 8, 30), "up"), ("a", at(1, 8, 31), "up")], [("b", at(1, 20), "down"), ("nobody", at(1, 20), "up")], [("c", at(4, 8), "up"), ("z", at(9, 10), "up")], [("y", at(12, 10), "down")]]
    paths = [str(tmp_path / x) for x in ("s", "f", "out", "c")]
    for one, two in zip(sessions, feedback, strict=True):
        spark.createDataFrame(one, s_shape).coalesce(1).write.mode("append").parquet(paths[0])
        spark.createDataFrame(two, f_shape).coalesce(1).write.mode("append").parquet(paths[1])
        s, f = (spark.readStream.schema(x).parquet(p) for x, p in ((s_shape, paths[0]), (f_shape, paths[1])))
        run(flows.with_feedback(s, f), paths[2], paths[3])
    got = sorted((r.session_id, r.rating) for r in spark.read.parquet(paths[2]).collect())
    # c's feedback came too late, twice given feedback counts once, d had none
    assert got == [("a", "up"), ("b", "down"), ("c", None), ("d", None), ("y", "down"), ("z", "up")]
    joined = spark.read.schema(s_shape).parquet(paths[0]).alias("s").join(spark.read.schema(f_shape).parquet(paths[1]).alias("f"), F.expr("s.session_id = f.session_id and f.timestamp between s.timestamp and s.timestamp + interval 1 day"), "left")
    assert sorted({(r[0], r[5]) for r in joined.collect()}, key=str) == sorted(set(got), key=str)
