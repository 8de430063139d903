"""Line-first quality rules, all in SQL functions.

Each line with a word is judged on its own: boilerplate phrases (whole words), cues in short lines,
code, navigation bars, symbol noise and short lines without closing punctuation fail and are removed. A document then goes if too much of its text
went with them, or if a base rule on the whole text fails (too few words, or too many words in
repeated 5-word windows).

Scale: one map without a shuffle; every step is linear or a sort within a document. Expressions
that a lambda reads again are bound once by `let`, never evaluated for each element.

Defined results: a null text has no words and fails; an empty one likewise; other columns pass
through `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.core import SPACE_CLASS, fresh

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
#: A line of fewer words than this needs closing punctuation.
SHORT_LINE = 8
CLOSING = r"[.!?:;…\"'”’»)\]]$"
#: A line is navigation if at least a fifth of its words are separators, and there are two or more.
SEPARATOR = r"^([|>»›·•/\\]+|::|--+)$"
NAV_PERCENT = 20
#: Phrases of site furniture, in lower case and as whole words, that fail a line of any length.
BOILERPLATE = (
    "lorem ipsum", "privacy policy", "terms of use", "terms of service", "all rights reserved", "use cookies", "uses cookies", "accept cookies", "accept all cookies", "cookie policy", "cookie settings", "enable javascript", "javascript is disabled",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "tous droits réservés", "politique de confidentialité", "utilise des cookies", "todos los derechos reservados", "política de privacidad", "utiliza cookies",
)
#: Phrases that fail a line of fewer words than SHORT_CUE; in longer ones they may be prose.
CUES = (
    "javascript", "cookie", "cookies", "click here", "sign in", "sign up", "log in", "subscribe", "read more", "share this",
    "hier klicken", "anmelden", "mehr lesen", "weiterlesen", "cliquez ici", "se connecter", "lire la suite", "haga clic", "iniciar sesión", "leer más",
)
SHORT_CUE = 12
#: A line with more than this many symbols for each hundred words is noise.
MOST_SYMBOLS_PERCENT = 50
#: A document goes if its failed lines hold more than this share of its words.
MOST_LOST_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in k-word windows found twice or more: windows by hash, sorted with their places."""
    n_windows = F.size(words) - k + 1
    hashes = let(words, lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])))

    def places(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(sorted_, lambda s: F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])))
        return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda at, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - at, F.lit(k)))), F.lit(0), lambda a, x: a + x)

    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(places(h), covered)))
    return F.when(n_windows >= 2, count).otherwise(0).cast("long")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """Of a line with a word: whether one of the rules removes it."""
    boilerplate = let(F.lower(line), lambda low: says(low, BOILERPLATE))
    cue = let(F.lower(line), lambda low: says(low, CUES))
    code = line.rlike("[{}]") & F.rtrim(line).rlike("[{};]$")
    n_symbols = F.regexp_count(line, F.lit(SYMBOLS))

    def by_words(ws: Column) -> Column:
        bars = let(F.size(F.filter(ws, lambda w: w.rlike(SEPARATOR))), lambda n: (n >= 2) & (n * 100 >= F.size(ws) * NAV_PERCENT))
        short = (F.size(ws) < SHORT_LINE) & ~F.rtrim(line).rlike(CLOSING)
        return short | (F.size(ws) < SHORT_CUE) & cue | (n_symbols * 100 > F.size(ws) * MOST_SYMBOLS_PERCENT) | F.when(maybe_bar(line), bars).otherwise(False)

    return boilerplate | code | let(word_list(line), by_words)


def says(low: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands in a lower-case line as whole words; most lines hold none even as parts of words."""
    return F.when(reduce(or_, [F.contains(low, F.lit(x)) for x in phrases]), low.rlike(whole_words(phrases))).otherwise(False)


def whole_words(phrases: tuple[str, ...]) -> str:
    return r"(^|[^\p{L}\p{N}])(" + "|".join(phrases) + r")($|[^\p{L}\p{N}])"


def maybe_bar(line: Column) -> Column:
    """Whether a separator can be among the words; cheap."""
    return line.rlike(r"[|>»›·•/\\]|--|::")


def measured(docs: DataFrame, text: str = "text", into: str = "_q") -> DataFrame:
    """docs with a struct column `into` (one of that name is replaced): counts, verdicts and the text without the lines that fail."""
    w, l = fresh(docs, "_w", "_l")  # noqa: E741
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    count = lambda ls: F.aggregate(ls, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    judged = let(
        F.filter(lines, has_word),
        lambda full: let(
            F.filter(lines, lambda x: ~has_word(x) | ~line_fails(x)),
            lambda kept: F.struct(
                F.size(full).alias("n_lines"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                (F.size(lines) - F.size(kept)).alias("n_failed_lines"),
                F.when(F.size(lines) == F.size(kept), F.lit(None).cast("int")).otherwise(count(kept)).alias("kept_words"),
                F.when(F.size(lines) == F.size(kept), body).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
            ),
        ),
    )
    words = let(word_list(body), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_words(ws).alias("n_repeat_words")))
    out = docs.withColumn(w, words).withColumn(l, judged)
    n_words, n_repeat = F.col(f"{w}.n_words"), F.col(f"{w}.n_repeat_words")
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MOST_REPEATED_PERCENT * n_words)
    lost = 100 * (n_words - F.coalesce(F.col(f"{l}.kept_words").cast("long"), n_words)) > MOST_LOST_PERCENT * n_words
    return out.withColumn(
        into,
        F.struct(
            f"{w}.n_words", f"{w}.word_chars", F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            f"{l}.n_dup_lines", f"{w}.n_repeat_words", base.alias("base_failed"), (~base & ~lost).alias("kept"), f"{l}.n_lines", f"{l}.n_failed_lines", f"{l}.clean_text",
        ),
    ).drop(w, l)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, with their failed lines removed; columns as they were, n_chars renewed."""
    (q,) = fresh(docs, "_q")
    kept = measured(docs, text, q).where(F.col(f"{q}.kept"))
    out = kept.withColumn(text, F.col(f"{q}.clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.drop(q)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measured(docs).select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")])
