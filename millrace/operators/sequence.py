"""Order-dependent operators: cut-offs by running sums, caps, de-duplication, histories, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, by: list[str], order: list[str], cost: Column, budget: float) -> DataFrame:
    """Rows up to the first whose cost would pass the budget, and none after it: with used, the sum so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = rows.withColumn("used", upto).withColumn("_o", F.max((F.col("used") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return over.where("_o = 0").drop("_o")


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)


def resume_points(rows: DataFrame, done: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """(by, resume_key, left): the first row of each group that is not done, and how many are not."""
    return rows.join(done.select(key), key, "left_anti").groupBy(*by).agg(F.min_by(key, order).alias("resume_key"), F.count("*").alias("left"))


def budget_left(events: DataFrame, ts: str, key: str, daily: int, per_session: int | None = None, session: str | None = None) -> DataFrame:
    """events with served: whether a day's budget (by UTC day) and the session's cap still hold for each, in order."""
    day = Window.partitionBy(F.to_date(ts)).orderBy(ts, key)
    out = events.withColumn("day_nth", F.row_number().over(day))
    served = F.col("day_nth") <= daily
    if per_session is not None:
        out = out.withColumn("session_nth", F.row_number().over(Window.partitionBy(session).orderBy(ts, key)))
        served = served & (F.col("session_nth") <= per_session)
    return out.withColumn("served", served)


def keep_heaviest(rows: DataFrame, by: list[str], weight: str, order: list[str]) -> DataFrame:
    """One row for each group: the heaviest, the first on ties; with place, where the group begins."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("place", F.min(F.struct(*order)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(weight), *order)))
    return out.where("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new by key; of rows of new with one key, the last by version wins."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.desc("_age"), *([F.desc("version")] if "version" in both.columns else []))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_age")


def history(turns: DataFrame, conversation: str, turn: str, role: str, text: str, last: int = 6, cut: int = 120) -> DataFrame:
    """(conversation, recent, summary): the last turns as they are, and the starts of those before.

    Turns that are null or blank do not count.
    """
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    out = turns.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("_r", F.row_number().over(w))
    short = F.concat(F.col(role), F.lit(": "), F.substring(text, 1, cut), F.when(F.length(text) > cut, "...").otherwise(""))
    pick = lambda when, item: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(F.col(turn).alias("t"), item.alias("x"))))), lambda s: s["x"])
    return out.groupBy(conversation).agg(pick(F.col("_r") <= last, F.struct(F.col(role).alias("role"), F.col(text).alias("text"))).alias("recent"), F.array_join(pick(F.col("_r") > last, short), "\n").alias("summary"))


def islands(rows: DataFrame, by: list[str], order: list[str], same: Column) -> DataFrame:
    """rows with island: the number of the run of neighbours for which `same` keeps its value."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((~same.eqNullSafe(F.lag(same).over(w))).cast("int"), F.lit(1))
    return rows.withColumn("island", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged_tool_results(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Consecutive tool messages as one user turn; others as they are."""
    kind = F.when(F.col(role) == "tool", "tool").otherwise(F.concat(F.lit("turn "), F.col(turn).cast("string")))
    out = islands(messages.withColumn("_k", kind), [conversation], [turn], F.col("_k"))
    part = F.struct(F.col(turn).alias("t"), F.col(text).alias("x"))
    return out.groupBy(conversation, "island").agg(F.min(turn).alias(turn), F.when(F.first(role) == "tool", "user").otherwise(F.first(role)).alias(role), F.transform(F.sort_array(F.collect_list(part)), lambda s: s["x"]).alias("contents"))
