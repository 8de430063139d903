"""Goldens of the rule path: features, diagnosis, gates, coaching."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.diagnose import diagnose, merged_symptoms, retrieval_query
from millrace.operators.extract import extract, freshness, scope
from millrace.operators.gates import post_gate, pre_gate
from millrace.operators.generate import Agent, RateLimited, resolved_provider, retrying
from millrace.plans.coach import coach


def reports(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, raw_problem string")


@pytest.fixture(scope="module")
def cases(spark):
    texts = ["My DeLonghi Dinamica makes bitter espresso, 28 second extraction", "My moka pot makes burnt bitter coffee", "My Nespresso makes bitter coffee", "my Gaggia makes sour espresso", "I want to learn how to make better espresso", "Gaggia, 18g, 91°C, light roast, 40 seconds", "which grinder should I get", "my espresso is both bitter and sour"]
    return {r.query_id: r for r in pre_gate(diagnose(extract(reports(spark, *texts)))).withColumn("rq", retrieval_query()).collect()}


def test_features(cases):
    c = cases["q0"]
    assert (c.machine_type, c.machine_model, c.extraction_time_seconds, "bitter" in c.symptoms) == ("super_automatic", "DeLonghi Dinamica", 28, True)
    c = cases["q5"]
    assert (c.dose_grams, c.water_temp_celsius, c.roast_level, c.extraction_time_seconds, c.goal) == (18.0, 91.0, "light", 40, "optimize")


@pytest.mark.parametrize(
    ("q", "causes", "confidence", "plan"),
    [
        ("q0", [("grind_too_fine", 0.70), ("temperature_setting_high", 0.55), ("coffee_strength_high", 0.45)], 0.70, ["freshness", "grind_size", "time"]),
        ("q1", [("heat_too_high", 0.95), ("too_long_on_flame", 0.75), ("grind_too_fine", 0.60)], 0.76, ["freshness", "grind_size", "time"]),
        ("q2", [("capsule_type", 0.80), ("machine_dirty", 0.55)], 0.64, ["freshness"]),
        ("q3", [("under-extraction", 0.75), ("grind_too_coarse", 0.70), ("too_short_extraction", 0.60)], 0.60, ["grind_size", "water_temp", "time"]),
    ],
)
def test_diagnosis_goldens(cases, q, causes, confidence, plan):
    c = cases[q]
    assert [(x.hypothesis, round(x.probability, 10)) for x in c.root_causes] == causes
    assert (c.diagnostic_confidence, [s.parameter for s in c.plan], [s.step for s in c.plan]) == (confidence, plan, list(range(1, len(plan) + 1)))


def test_routes(cases):
    assert [cases[q].route for q in ("q4", "q5", "q6", "q7")] == ["learn", "optimize", "general", "rules"]
    assert cases["q7"].symptoms == ["bitter_and_sour"]
    assert [s.parameter for s in cases["q5"].plan] == ["grind_size", "water_temp"]
    assert cases["q3"].rq == "semi automatic sour under extraction semi automatic coffee extraction"


def test_no_impossible_steps(cases):
    assert not {"tamping", "distribution"} & {s.parameter for s in cases["q0"].plan}
    assert cases["q2"].pre.checks["interventions_feasible"] is False and cases["q0"].pre.verdict == "ready"


@pytest.mark.parametrize(("text", "symptom"), [("too strong and overpowering", "too_strong"), ("leaves my mouth dry", "astringent"), ("there is no aroma", "flat_no_aroma"), ("shots are inconsistent", "inconsistent"), ("machine choked, no flow", "too_slow_extraction"), ("it runs too fast", "too_fast_extraction")])
def test_symptoms(spark, text, symptom):
    assert symptom in extract(reports(spark, text)).first().symptoms


def test_freshness_counts_weeks(spark):
    df = reports(spark, "roasted 3 weeks ago", "5 days old", "2 weeks old", "fresh").select("query_id", freshness(F.col("raw_problem")).alias("d"), freshness(F.col("raw_problem"), False).alias("raw"))
    assert [(r.d, r.raw) for r in df.orderBy("query_id").collect()] == [(21, 3), (5, 5), (14, 14), (None, None)]


def test_merged_symptoms(spark):
    df = spark.createDataFrame([(["sour", "channeling", "bitter"],), (["sour"],)], "s array<string>")
    assert [r.m for r in df.select(merged_symptoms(F.col("s")).alias("m")).collect()] == [["bitter_and_sour", "channeling"], ["sour"]]


def test_scope(spark):
    rows = [(1, 1, "user", "my espresso is bitter"), (1, 2, "assistant", "how long?"), (1, 3, "user", "yes, 20 seconds"), (2, 1, "user", "yes, 20 seconds"), (3, 1, "user", "x" * 2000), (4, 1, "user", "mon CAFE est amer"), (5, 1, "user", None)]
    got = {(r.c, r.t): r.reason for r in scope(spark.createDataFrame(rows, "c int, t int, r string, x string"), "c", "t", "r", "x").collect()}
    assert got == {(1, 1): "ok", (1, 2): "ok", (1, 3): "ok", (2, 1): "off_topic", (3, 1): "too_long", (4, 1): "ok", (5, 1): "off_topic"}


def test_post_gate(spark):
    good = "Your grind is too fine because water stays long.\n1. Go 1 notch coarser.\n2. Use 18 g.\nYou should notice less bitterness. " + "word " * 120
    rows = [(1, good, "grind_too_fine"), (2, "short", "grind_too_fine"), (3, good.replace("because", "as").replace("grind", "thing"), "grind_too_fine"), (4, None, None)]
    got = {r.i: r.post for r in post_gate(spark.createDataFrame(rows, "i int, coaching_text string, h string"), hypothesis=F.col("h")).collect()}
    assert (got[1].verdict, got[2].verdict, got[3].verdict, got[4].verdict) == ("pass", "fail", "warn", "fail") and got[1].overall_score == 1.0


def test_coach_statuses(spark):
    got = {r.query_id: (r.status, r.reason) for r in coach(reports(spark, "my Gaggia makes sour espresso", "what is the capital of France", "", None, "x" * 1501, "which coffee bean is best")).collect()}
    assert got == {"q0": ("coaching", "ok"), "q1": ("out_of_scope", "off_topic"), "q2": ("error", "empty"), "q3": ("error", "empty"), "q4": ("out_of_scope", "too_long"), "q5": ("coaching", "ok")}


def test_agent_loop(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    tools = {"mark": lambda d: d.withColumn("x", F.concat("x", F.lit("!")))}
    choose = lambda s: F.when((F.col("id") == 2) & (F.size("calls") == 1), "ask").when(F.size("calls") < 2, "mark").otherwise("stop")
    n = iter(range(100))

    def keep(df):
        path = str(tmp_path / f"s{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = {r.id: (r.x, r.calls, r.status, r.iterations) for r in Agent(tools, choose, keep).run(rows).collect()}
    assert got == {1: ("a!!", ["mark", "mark"], "done", 3), 2: ("b!", ["mark"], "clarification_needed", 2)}


def test_retry_and_provider():
    slept, calls = [], iter([RateLimited(3.0), RateLimited(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert retrying(call, sleep=slept.append) == "ok" and slept[0] == 3.0 and 2 <= slept[1] <= 2.5
    assert resolved_provider({"ANTHROPIC_API_KEY": "k"}) == ("anthropic", "k") and resolved_provider({"LLM_PROVIDER": "groq"}) == ("groq", None)
