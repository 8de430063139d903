"""Display columns, the experiment grid, caches."""

from pyspark.sql import functions as F

from millrace.functions import present
from millrace.operators import evals, monitor
from millrace.plans import experiments
from millrace.sources.store import ChunkStore


def test_present(spark):
    df = spark.createDataFrame([("grind_too_fine", "finer", "1 notch", 92.5), ("stale_beans", None, "2°C", 93.0), (None, "coarser", None, None)], "h string, d string, m string, water_temp_celsius double")
    df = df.withColumns({"grind_size": F.lit("fine"), "dose_grams": F.lit(18.0), "extraction_time_seconds": F.lit(28)})
    got = df.select(present.claim(F.col("h")).alias("c"), present.target_phrase(F.col("d"), F.col("m")).alias("t"), present.current_value(F.lit("water_temp")).alias("w"), present.parameter_label(F.lit("water_temp")).alias("p")).collect()
    assert [r.c for r in got] == ["Your grind is probably too fine.", "Most likely cause: stale beans.", "Most likely cause identified below."]
    assert [r.t for r in got] == ["1 notch finer", "2°C", "Coarser"] and [r.w for r in got] == ["92.5°C", "93°C", None] and got[0].p == "Water temperature"


def test_experiment(spark, tmp_path):
    body = "This espresso is sour because the grind is coarse and the water is cold. " * 5
    docs = spark.createDataFrame([("a", "Sour espresso", "c", "u", body), ("b", "Moka pot heat", "c", "u", body.replace("sour", "burnt").replace("espresso", "moka"))], "source_id string, title string, channel string, url string, transcript_text string")
    store = experiments.build_store(ChunkStore(spark, str(tmp_path / "s")), docs)
    chunks = experiments.open_store(store)
    wanted = [r.chunk_id for r in chunks.where("source_id = 'a'").collect()]
    items = spark.createDataFrame([("q", "my espresso is sour", wanted)], "query_id string, synthetic_query string, relevant_chunk_ids array<string>")
    metrics, best = experiments.experiment(experiments.run_configs(chunks, items, keep=lambda d: spark.createDataFrame(d.collect(), d.schema)), items)
    assert {r.config: r.hit_rate_5 for r in metrics.collect()} == {c: 1.0 for c in experiments.CONFIGS} and best.first().verdict == "PASS" and best.first().winner == "C1_vector_only"


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    experiments.write_cache(spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int"), path)
    experiments.write_cache(spark.createDataFrame([("b", 3)], "source_id string, v int"), path)
    have, lack = experiments.cached(spark.createDataFrame([("b",), ("c",)], "source_id string"), spark.read.parquet(path))
    assert [r.v for r in have.collect()] == [3] and [r.source_id for r in lack.collect()] == ["c"]
    costs = spark.createDataFrame([(1, 100), (2, 100), (3, 1)], "i int, cost int")
    assert [r.i for r in experiments.affordable(costs, "cost", "i", 150).collect()] == [1]


def test_figures_round_by_the_binary_value(spark):
    rows = spark.createDataFrame([("s", "pass" if i == 0 else "fail", 0.5, False) for i in range(16)], "style string, verdict string, overall_score double, error boolean")
    assert evals.style_metrics(rows).first().pass_rate == round(1 / 16, 3) == 0.062
    marks = [1, 1, 1, 1, 1, 1, 1, 2]
    replies = spark.createDataFrame([(f'{{"a": {m}}}',) for m in marks], "reply string")
    assert evals.judge_means(replies, "reply", ("a",)).first().a == round(sum(marks) / 8, 2) == 1.12


def test_chart_heights(spark):
    got = spark.range(12).select(monitor.chart_height(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [180, 180, 180, 180, 182, 210, 238, 260, 260, 260, 260, 260]
