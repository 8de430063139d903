"""Markdown structure as rows: sections, steps, tables, parameter lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import found, n_words

# Patterns of markdown structure.
FENCE = r"^\s*(```|~~~)"
HEADING = r"^\s{0,3}(#{1,6})\s+(.*\S)\s*$"
BOLD = r"^\s*\*\*(.{2,80}?)\*\*\s*:?\s*$"
STEP = r"(?i)^(?:step\s*)?(\d{1,2})\s*[.)\-–:]\s+(.+)$"
SCIENCE = r"(?i)\b(why|science|scientific|chemistry|theory|mechanism|background|deep dive|technical (analysis|detail|note)|the science)\b"
VALIDATING = r"(?i)\b(validation|validate|verify|verification|how to (check|test))\b"
ADVANCED = r"(?i)\b(tds|refractomet\w*|extraction yield|brix|vst|atago|digital scale to 0\.1|puck screen)\b"
SEPARATOR = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"
PARAMETER = r"(?i)^\s*[-*+]?\s*\**(current|now|before|target|goal|after|change|delta|adjust(?:ment)?)\**\s*[:：]\s*\**(.+?)\**\s*$"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, in_fence, heading): heading is the title that a line opens, else null."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line"))
    out = out.withColumn("in_fence", F.sum(F.col("line").rlike(FENCE).cast("int")).over(w) % 2 == 1)
    bold = found(F.col("line"), BOLD)
    title = F.coalesce(F.trim(found(F.col("line"), HEADING, 2)), F.when(~F.rtrim(bold).rlike(r"[.!?]$"), F.regexp_replace(F.trim(bold), ":+$", "")))
    return out.withColumn("heading", F.when(~F.col("in_fence"), title))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, title, body, n_lines): section 0 is what stands before the first heading."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = lines(docs, key, text).withColumn("section", F.sum(F.col("heading").isNotNull().cast("int")).over(w).cast("int"))
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("heading").isNull(), F.struct("line_no", "line")))), lambda x: x["line"])
    return out.groupBy(key, "section").agg(F.max("heading").alias("title"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("body"), F.count_if(F.col("heading").isNull()).alias("n_lines"))


def step_number(title: Column) -> Column:
    return found(F.trim(title), STEP, 1).cast("int")


def step_title(title: Column) -> Column:
    return F.coalesce(F.trim(found(F.trim(title), STEP, 2)), F.trim(title))


def is_advanced(line: Column) -> Column:
    return line.rlike(ADVANCED)


def table_cells(line: Column) -> Column:
    """The cells of a pipe-table row; null for its separator."""
    inner = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
    return F.when(~line.rlike(SEPARATOR), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)))


def column_of(header: Column, *keys: str) -> Column:
    """Place (from 0) of the first header cell that holds one of keys; null for none."""
    at = F.transform(header, lambda c, i: F.when(F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(F.lower(c), k)), i))
    return F.get(F.array_compact(at), F.lit(0))


def recipe_columns(header: Column) -> Column:
    """struct(current, target, delta) of a table that is a recipe change; null for any other."""
    s = F.struct(column_of(header, "current", "now", "before", "from").alias("current"), column_of(header, "target", "goal", "after", "recommend", "to ").alias("target"), column_of(header, "change", "delta", "diff").alias("delta"))
    return F.when((F.size(header) >= 2) & s["current"].isNotNull() & s["target"].isNotNull() & (s["current"] != s["target"]), s)


def parameters(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, island, current, target, delta) of each run of `Current:` / `Target:` lines that has a target."""
    from millrace.operators.sequence import islands

    rows = lines(docs, key, text).withColumn("name", F.lower(found(F.col("line"), PARAMETER, 1))).withColumn("value", F.trim(F.regexp_replace(found(F.col("line"), PARAMETER, 2), r"\*+", "")))
    rows = islands(rows, [key], ["line_no"], F.col("name").isNotNull()).where("name is not null")
    pick = lambda *names: F.coalesce(*[F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("line_no"))) for n in names])
    return rows.groupBy(key, "island").agg(pick("current", "now", "before").alias("current"), pick("target", "goal", "after").alias("target"), pick("change", "delta", "adjustment", "adjust").alias("delta")).where("target is not null")


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, island, kind, body): runs of table rows, parameter lines and other text, in order."""
    from millrace.operators.sequence import islands

    kind = F.when(F.ltrim("line").startswith("|"), "table").when(F.col("line").rlike(PARAMETER), "parameters").otherwise("text")
    rows = islands(lines(docs, key, text).withColumn("kind", kind), [key], ["line_no"], F.col("kind"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "island").agg(F.first("kind").alias("kind"), F.array_join(body, "\n").alias("body"))


def layouts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, title, layout): validation; science (by its title, among several sections, 40 words or more); else step, text before any heading."""
    s = sections(docs, key, text)
    many = F.count_if(F.col("section") > 0).over(Window.partitionBy(key)) > 1
    layout = F.when(F.col("section") == 0, "text").when(F.col("title").rlike(VALIDATING), "validation").when(F.col("title").rlike(SCIENCE) & many & (n_words(F.col("body")) >= 40), "science").otherwise("step")
    return s.select(key, "section", "title", layout.alias("layout"))


def has_validation(docs: DataFrame, key: str, text: str) -> DataFrame:
    return sections(docs, key, text).groupBy(key).agg(F.coalesce(F.bool_or(F.col("title").rlike(VALIDATING)), F.lit(False)).alias("has_validation"))


def distinct_tests(tests: Column) -> Column:
    """Non-blank texts, each once whatever its case, as first written."""
    clean = F.filter(tests, lambda t: F.trim(t) != "")
    return F.filter(clean, lambda t, i: F.array_position(F.transform(clean, lambda x: F.lower(F.trim(x))), F.lower(F.trim(t))) == i + 1)
