"""Session analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headline(sessions: DataFrame, passed: Column, out_of_scope: Column) -> DataFrame:
    """Sessions, and shares of all sessions, to four places."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    return sessions.agg(F.count("*").alias("sessions"), rate(passed).alias("pass_rate"), rate(out_of_scope).alias("out_of_scope_rate"))


def satisfaction(feedback: DataFrame, rating: str = "rating") -> DataFrame:
    """(ratings, satisfaction): how many, and the share of `up` to four places, null without ratings."""
    return feedback.agg(F.count(rating).alias("ratings"), F.round(F.avg((F.col(rating) == "up").cast("int")), 4).alias("satisfaction"))


def histogram(rows: DataFrame, value: Column | str, name: str = "value", default: str | None = None, drop_null: bool = False) -> DataFrame:
    """(name, n): rows by value; nulls as default, or dropped."""
    v = F.col(value) if isinstance(value, str) else value
    out = rows.select((v if default is None else F.coalesce(v, F.lit(default))).alias(name))
    return (out.where(F.col(name).isNotNull()) if drop_null else out).groupBy(name).agg(F.count("*").alias("n"))


def per_day(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, ts: str, n: int = 10, tie: str | None = None) -> DataFrame:
    return rows.orderBy(F.desc(ts), *([tie] if tie else [])).limit(n)


def last_days(rows: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """Rows of the last days that the data has, its latest day included."""
    latest = rows.agg(F.max(F.to_date(ts)).alias("_latest"))  # one row
    return rows.join(F.broadcast(latest), F.to_date(ts) > F.date_sub("_latest", days)).drop("_latest")


def pivoted(rows: DataFrame, day: Column, column: str, values: list[str]) -> DataFrame:
    """Counts by day with a column for each value, 0 where there is none."""
    return rows.groupBy(day.alias("day")).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def unpivoted(wide: DataFrame, ids: list[str], values: list[str], name: str = "series", value: str = "n") -> DataFrame:
    return wide.unpivot(ids, values, name, value)


def with_feedback(sessions: DataFrame, feedback: DataFrame, key: str = "session_id") -> DataFrame:
    return sessions.join(feedback, key, "left")


def collection_stats(chunks: DataFrame, source: str, channel: str, categories: list[str], sample_limit: int | None = None) -> DataFrame:
    """(measure, value, n): the total, exact distinct sources and channels, and rows by each category.

    sample_limit: take distributions from so many rows only, as small stores do; exact without.
    """
    some = chunks if sample_limit is None else chunks.limit(sample_limit)
    one = chunks.agg(F.count("*").alias("total"), F.count_distinct(source).alias("sources"), F.count_distinct(channel).alias("channels"))
    out = one.unpivot([], ["total", "sources", "channels"], "measure", "n").select("measure", F.lit(None).cast("string").alias("value"), "n")
    filled = some.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in categories])
    long = filled.unpivot([], categories, "measure", "value").groupBy("measure", "value").agg(F.count("*").alias("n"))
    return out.unionByName(long)


def recent_view(rows: DataFrame, ts: str, text: str, label: Column, n: int = 10) -> DataFrame:
    """The most recent rows as they are shown: short time, 70 characters, a label."""
    return recent(rows, ts, n).select(F.date_format(ts, "dd MMM HH:mm").alias("time"), F.substring(text, 1, 70).alias("problem"), label.alias("label"))


def chart_height(points: Column) -> Column:
    return F.least(F.lit(260), F.greatest(F.lit(180), F.lit(70) + F.greatest(points, F.lit(1)) * 28))


def running(rows: DataFrame, by: list[str], order: list[str], amount: Column) -> Column:
    return F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
