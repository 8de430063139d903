"""Rule diagnosis: rule tables joined to the symptoms of many reports at once.

Causes and steps are small dimension tables, broadcast; everything else is by report. No weight or
step number is carried from one report to another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import once, round_binary
from millrace.plans import rules

STEP = "struct<step:int,action:string,parameter:string,direction:string,magnitude:string,priority:string>"
CAUSE = "array<struct<hypothesis:string,probability:double,parameter_affected:string>>"


def cause_table(spark: SparkSession, causes: dict | None = None) -> DataFrame:
    """(symptom, method, c_seq, hypothesis, weight, parameter): method null is the default."""
    rows = [(*(k.split("/") + [None])[:2], i, *row) for k, table in (causes or rules.CAUSES).items() for i, row in enumerate(table)]
    return spark.createDataFrame(rows, "symptom string, method string, c_seq int, hypothesis string, weight double, parameter string")


def step_table(spark: SparkSession, steps: dict | None = None) -> DataFrame:
    rows = [(s, i, *row) for s, table in (steps or rules.STEPS).items() for i, row in enumerate(table)]
    return spark.createDataFrame(rows, "symptom string, s_seq int, parameter string, direction string, magnitude string, priority string, action string")


def adjustable(machine: Column) -> Column:
    table = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in rules.ADJUSTABLE.items() for v in pair])
    return F.coalesce(F.try_element_at(table, machine), F.array(*map(F.lit, rules.ADJUSTABLE["unknown"])))


def capability(parameter: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in rules.CAPABILITY.items() for v in pair])
    return F.coalesce(F.try_element_at(table, parameter), parameter)


def merged_symptoms(symptoms: Column) -> Column:
    """bitter with sour is one symptom of its own, first in the list and once."""
    both = F.array_contains(symptoms, "bitter") & F.array_contains(symptoms, "sour")
    rest = F.filter(symptoms, lambda s: ~s.isin("bitter", "sour", "bitter_and_sour"))
    return F.when(both, F.concat(F.array(F.lit("bitter_and_sour")), rest)).otherwise(symptoms)


def boosted(weight: Column, hypothesis: Column) -> Column:
    """The weight after what was measured speaks for the hypothesis, at most 0.95."""
    t, fresh = F.coalesce(F.col("extraction_time_seconds"), F.lit(0)), F.coalesce(F.col("bean_freshness_days"), F.lit(0))
    more = (
        F.when((t > 0) & (t < 20) & (hypothesis == "under-extraction"), 0.20).when((t > 32) & (hypothesis == "over-extraction"), 0.20).when((fresh > 30) & F.contains(hypothesis, F.lit("stale")), 0.20)
        .when((F.col("machine_type") == "moka") & (hypothesis == "heat_too_high"), 0.15).otherwise(0.0)
    )
    return F.when(more > 0, F.least(F.lit(0.95), F.round(weight + more, 10))).otherwise(weight)


def causes_of(contexts: DataFrame, key: str, table: DataFrame, top: int = 3) -> DataFrame:
    """(key, root_causes): of each hypothesis the heaviest, first on ties, boosted, heaviest first."""
    asked = contexts.select(key, "machine_type", "extraction_time_seconds", "bean_freshness_days", F.posexplode("_s").alias("s_pos", "symptom"))
    own = F.broadcast(table.where("method is not null").select("symptom", "method").distinct().withColumnsRenamed({"symptom": "o_s", "method": "o_m"}))
    asked = asked.join(own, (F.col("symptom") == F.col("o_s")) & (F.col("machine_type") == F.col("o_m")), "left")
    hit = asked.join(F.broadcast(table.withColumnRenamed("symptom", "t_s")), (F.col("symptom") == F.col("t_s")) & F.col("o_m").eqNullSafe(F.col("method")))
    same = Window.partitionBy(key, "hypothesis")
    seq = F.struct("s_pos", "c_seq")
    hit = hit.withColumn("place", F.min(seq).over(same)).withColumn("r", F.row_number().over(same.orderBy(F.desc("weight"), "s_pos", "c_seq"))).where("r = 1")
    hit = hit.withColumn("probability", boosted(F.col("weight"), F.col("hypothesis")))
    item = F.struct((-F.col("probability")).alias("a"), (-F.col("weight")).alias("b"), "place", F.struct("hypothesis", "probability", F.col("parameter").alias("parameter_affected")).alias("cause"))
    return hit.groupBy(key).agg(F.transform(F.slice(F.sort_array(F.collect_list(item)), 1, top), lambda x: x["cause"]).alias("root_causes"))


def plan_of(steps: DataFrame, key: str, top: int = 4) -> DataFrame:
    """(key, plan) from steps (key, machine_type, seq, parameter, direction, magnitude, priority, action).

    Steps that the machine does not allow go; critical ones come first; a parameter comes once, but
    steps without one are never merged. At most `top`, numbered from 1.
    """
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).otherwise(2)
    free = F.col("parameter").isNull() | F.col("parameter").isin(rules.UNIVERSAL)
    ok = steps.where(free | F.array_contains(adjustable(F.col("machine_type")), capability(F.col("parameter")))).withColumn("rank", rank)
    once = F.row_number().over(Window.partitionBy(key, "parameter").orderBy("rank", "seq"))
    ok = ok.withColumn("n", F.when(F.col("parameter").isNull(), 1).otherwise(once)).where("n = 1")
    item = F.struct("rank", "seq", F.struct(F.lit(0).alias("step"), "action", "parameter", "direction", "magnitude", "priority").alias("s"))
    numbered = lambda x, i: x["s"].withField("step", i + 1)
    return ok.groupBy(key).agg(F.transform(F.slice(F.sort_array(F.collect_list(item)), 1, top), numbered).alias("plan"))


def optimize_steps() -> Column:
    """Steps for measurements out of range, in the order in which they are looked at."""
    t, d, temp, fresh = (F.col(c) for c in ("extraction_time_seconds", "dose_grams", "water_temp_celsius", "bean_freshness_days"))
    m, roast = F.col("machine_type"), F.col("roast_level")

    def step(when: Column, parameter: str | None, direction: Column | str | None, magnitude: str | None, priority: str, action: Column) -> Column:
        d = direction if isinstance(direction, Column) else F.lit(direction)
        return F.when(when, F.struct(F.lit(parameter).alias("parameter"), d.cast("string").alias("direction"), F.lit(magnitude).cast("string").alias("magnitude"), F.lit(priority).alias("priority"), action.alias("action")))

    espresso = m.isin("super_automatic", "semi_automatic", "manual_lever")
    return F.array_compact(
        F.array(
            step(espresso & (t < 22), "grind_size", "finer", "1 notch", "high", F.lit("Extraction under 22 s: grind one notch finer")),
            step(espresso & (t > 35), "grind_size", "coarser", "1 notch", "high", F.lit("Extraction over 35 s: grind one notch coarser")),
            step((m == "v60") & ((t < 120) | (t > 240)), "grind_size", F.when(t < 120, "finer").otherwise("coarser"), "0.5 notch", "medium", F.concat(F.lit("Brew time of "), t.cast("string"), F.lit(" s is outside 2-4 minutes: adjust the grind"))),
            step(m.isin("super_automatic", "semi_automatic") & ((d < 14) | (d > 22)), "dose", None, None, "medium", F.concat(F.lit("Dose of "), d.cast("string"), F.lit(" g is outside the espresso range: check the basket's size"))),
            step((roast == "light") & (temp < 92), "water_temp", "higher", "2-3°C", "medium", F.concat(temp.cast("string"), F.lit("°C may be too cool for a light roast: try 93-96°C"))),
            step((roast == "dark") & (temp > 94), "water_temp", "lower", "2-3°C", "medium", F.concat(temp.cast("string"), F.lit("°C may be too hot for a dark roast: try 88-92°C"))),
            step(fresh > 21, "freshness", None, None, "critical", F.concat(F.lit("Beans are "), fresh.cast("string"), F.lit(" days old: best within 7-21 days"))),
        )
    )


def confidence(causes: Column) -> Column:
    known = F.when(F.coalesce(F.col("extraction_time_seconds"), F.lit(0)) == 0, 0.8).otherwise(1.0) * F.when(F.col("machine_type") == "unknown", 0.7).otherwise(1.0)
    return F.when(F.size(causes) > 0, round_binary(F.get(causes, F.lit(0))["probability"] * known, 2)).otherwise(0.0)


def warnings_of() -> Column:
    fresh, m = F.coalesce(F.col("bean_freshness_days"), F.lit(0)), F.col("machine_type")
    return F.array_compact(
        F.array(
            F.when(fresh > 45, "Beans are probably stale (over 45 days): try fresh ones first."),
            F.when(m == "unknown", "Machine not identified: advice is generic."),
            F.when(m == "nespresso", "Extraction is fixed on this machine: choose other capsules and keep it clean."),
        )
    )


def diagnose(contexts: DataFrame, key: str = "query_id", causes: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """contexts (as extract gives them) with route, symptoms, root_causes, plan, diagnostic_confidence, method_detected and warnings.

    Routes: general; learn (learn or explore without symptoms); optimize (without symptoms);
    no_symptoms; rules. A symptom without rules is passed over.
    """
    spark = contexts.sparkSession
    causes, steps = causes or cause_table(spark), steps or step_table(spark)
    none = F.size("symptoms") == 0
    route = F.when(F.col("goal") == "general", "general").when(F.col("goal").isin("learn", "explore") & none, "learn").when((F.col("goal") == "optimize") & none, "optimize").when(none, "no_symptoms").otherwise("rules")
    c = once(contexts.withColumn("symptoms", F.coalesce("symptoms", F.array().cast("array<string>"))), {"route": route})
    c = once(c, {"_s": F.when(F.col("route") == "rules", merged_symptoms(F.col("symptoms"))).otherwise(F.array().cast("array<string>"))})
    item = "array<struct<parameter:string,direction:string,magnitude:string,priority:string,action:string>>"
    fixed = lambda rows: F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("parameter", "direction", "magnitude", "priority", "action"), row, strict=True)]) for row in rows])
    tuned = optimize_steps()
    set_steps = (
        F.when(F.col("route") == "learn", fixed(rules.LEARN_STEPS))
        .when(F.col("route") == "optimize", F.when(F.size(tuned) > 0, tuned).otherwise(fixed([(None, None, None, "high", "Share dose, time and temperature for a closer look")])))
        .when(F.col("route") == "general", fixed([(None, None, None, "medium", "Answer from general knowledge: this is not a taste problem")]))
        .when(F.col("route") == "no_symptoms", fixed([(None, None, None, "high", "Say what tastes wrong, or share your parameters")]))
        .otherwise(F.array().cast(item))
    )
    direct = c.select(key, "machine_type", F.posexplode(set_steps.cast(item)).alias("seq", "x")).select(key, "machine_type", F.struct(F.lit(0).alias("i"), "seq").alias("seq"), "x.*")
    by_rule = c.select(key, "machine_type", F.posexplode("_s").alias("i", "symptom")).join(F.broadcast(steps), "symptom").select(key, "machine_type", F.struct("i", F.col("s_seq").alias("seq")).alias("seq"), "parameter", "direction", "magnitude", "priority", "action")
    plan = plan_of(direct.unionByName(by_rule), key)
    out = c.join(causes_of(c, key, causes), key, "left").join(plan, key, "left")
    out = out.withColumn("root_causes", F.coalesce("root_causes", F.array().cast(CAUSE))).withColumn("plan", F.coalesce("plan", F.array().cast(f"array<{STEP}>")))
    stale = F.when((F.col("route") == "optimize") & (F.coalesce(F.col("bean_freshness_days"), F.lit(0)) > 21), F.array(F.concat(F.lit("Beans are "), F.col("bean_freshness_days").cast("string"), F.lit(" days old."))))
    said = (
        F.when(F.col("route") == "rules", warnings_of()).when(F.col("route") == "learn", F.array(F.lit("Learning: principles, not a fix."))).when(F.col("route") == "optimize", F.coalesce(stale, F.array(F.lit("Optimising: share parameters for a closer look."))))
        .when(F.col("route") == "general", F.array(F.lit("General question: answered from general knowledge."))).otherwise(F.array(F.lit("Describe a symptom or share parameters.")))
    )
    sure = F.when(F.col("route") == "general", 0.15).when(F.col("route") == "learn", 0.50).when(F.col("route") == "optimize", 0.55).when(F.col("route") == "no_symptoms", 0.10).otherwise(confidence(F.col("root_causes")))
    return out.withColumns({"diagnostic_confidence": sure, "method_detected": F.col("machine_type"), "warnings": said, "symptoms": F.col("_s")}).drop("_s")


def diagnosable(least: float = 0.15) -> Column:
    return (F.size("symptoms") > 0) & (F.col("diagnostic_confidence") >= least)


def retrieval_query() -> Column:
    """The query built from a diagnosis: machine, first symptom, first cause, method, origin, roast."""
    plain = lambda c: F.translate(c, "_-", "  ")
    method = F.when(F.col("method_detected") != "unknown", F.concat(F.translate("method_detected", "_", " "), F.lit(" coffee extraction")))
    return F.concat_ws(" ", F.translate("machine_type", "_", " "), F.translate(F.get("symptoms", F.lit(0)), "_", " "), plain(F.get("root_causes", F.lit(0))["hypothesis"]), method, F.col("bean_origin"), F.concat(F.col("roast_level"), F.lit(" roast")))
