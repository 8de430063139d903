"""Cleaning, sentence-aware chunking and informativeness of texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import chunk_id, count_contained, let, n_words, strip, words

# Spoken fillers and time marks of transcripts.
FILLERS = (r"\buh\b", r"\bum\b", r"\byou know\b", r"\blike i said\b", r"\bkind of\b", r"\bsort of\b", r"\bi mean\b", r"\bright\?\s*", r"\bokay so\b")
TIME_MARKS = (r"\[\d{1,2}:\d{2}(?::\d{2})?\]", r"<\d{1,2}:\d{2}(?::\d{2})?>", r"\(\d{1,2}:\d{2}(?::\d{2})?\)", r"\d{1,2}:\d{2}:\d{2}\s*")
BOUNDARY = r"([a-z,]{3,})\s+([A-Z][a-z])"


def without_time_marks(text: Column) -> Column:
    return F.regexp_replace(text, "|".join(TIME_MARKS), " ")


def without_fillers(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + "|".join(FILLERS), " ")


def repaired_boundaries(text: Column) -> Column:
    """A full stop where a lower-case word runs into a capitalised one."""
    return F.regexp_replace(text, BOUNDARY, "$1. $2")


def cleaned(text: Column, fillers: bool = True) -> Column:
    """Time marks, fillers, sentence boundaries, white space: in that order."""
    text = without_time_marks(text)
    text = repaired_boundaries(without_fillers(text) if fillers else text)
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{2,}", "\n"))


def informative(text: Column, signals: list[str], least: int = 2) -> Column:
    """Whether at least `least` different signals are substrings of the lower-cased text."""
    return count_contained(F.lower(text), signals) >= least


def sentences(text: Column) -> Column:
    """Split after closing punctuation and white space; punctuation stays."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: strip(s) != "")


@dataclass(frozen=True)
class Chunking:
    """Word budgets: 400 and 80 tokens at three words to four tokens."""

    most: int = 300
    overlap: int = 60
    least: int = 40


def chunks(text: Column, how: Chunking = Chunking(), of: Column | None = None) -> Column:
    """Sentence-aware chunks, of the sentences `of` where they are given: one fold over the sentences' lengths gives where each chunk begins and ends.

    A sentence over the budget is halved once. A chunk ends before the sentence that would exceed
    the budget; the next begins with the last sentences that fit the overlap. Short chunks go.
    The fold carries places and sums, never texts, so that its cost is linear in the text.
    """
    sized = lambda t: F.struct(t.alias("t"), n_words(t).alias("n"))
    half = lambda ws, a, n: F.array_join(F.slice(ws, a, n), " ")
    cut = lambda s, i, n: F.struct(s.alias("a"), i.alias("b"), n.alias("n"))

    def parts(s: Column) -> Column:
        n, mid = n_words(s), F.floor(n_words(s) / 2).cast("int")
        return F.when(n > how.most, F.array(sized(half(words(s), F.lit(1), mid)), sized(half(words(s), mid + 1, n - mid)))).otherwise(F.array(sized(s)))

    def tail(sizes: Column, a: Column) -> Column:
        """Of the sentences of a chunk that ends: how many of the last fit the overlap, and their words."""
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("more"))
        fits = lambda t, c: t["more"] & (t["n"] + c <= how.overlap)
        step = lambda t, c: F.when(fits(t, c), F.struct((t["k"] + 1).alias("k"), (t["n"] + c).alias("n"), F.lit(True).alias("more"))).otherwise(F.struct(t["k"].alias("k"), t["n"].alias("n"), F.lit(False).alias("more")))
        return F.aggregate(F.reverse(F.slice(sizes, a["s"] + 1, a["i"] - a["s"])), start, step)

    def places(sizes: Column) -> Column:
        def state(s: Column, i: Column, n: Column, out: Column) -> Column:
            return F.struct(s.alias("s"), i.alias("i"), n.alias("n"), out.alias("out"))

        def step(a: Column, c: Column) -> Column:
            ended = let(tail(sizes, a), lambda t: state(a["i"] - t["k"], a["i"] + 1, t["n"] + c, F.concat(a["out"], F.array(cut(a["s"], a["i"], a["n"])))))
            return F.when((a["n"] + c > how.most) & (a["i"] > a["s"]), ended).otherwise(state(a["s"], a["i"] + 1, a["n"] + c, a["out"]))

        zero = F.lit(0)
        start = state(zero, zero, zero, F.array().cast("array<struct<a:int,b:int,n:int>>"))
        return F.aggregate(sizes, start, step, lambda a: F.when(a["i"] > a["s"], F.concat(a["out"], F.array(cut(a["s"], a["i"], a["n"])))).otherwise(a["out"]))

    def written(ps: Column) -> Column:
        kept = F.filter(places(F.transform(ps, lambda x: x["n"])), lambda c: c["n"] >= how.least)
        return F.transform(kept, lambda c: F.array_join(F.transform(F.slice(ps, c["a"] + 1, c["b"] - c["a"]), lambda x: x["t"]), " "))

    return F.when(text.isNotNull(), let(F.flatten(F.transform(sentences(text) if of is None else of, parts)), written))


def chunk_documents(docs: DataFrame, text: str, source_id: str, signals: list[str] | None = None, how: Chunking = Chunking()) -> DataFrame:
    """docs with (chunk_no, chunk_id, chunk_text) in place of their text: cleaned, informative if signals are given."""
    out = docs.withColumn("_clean", cleaned(F.col(text)))
    if signals:
        out = out.where(informative(F.col(text), signals) & informative(F.col("_clean"), signals))
    out = out.select(*[c for c in docs.columns if c != text], F.posexplode(chunks(F.col("_clean"), how)).alias("chunk_no", "chunk_text"))
    return out.withColumn("chunk_id", chunk_id(F.col(source_id).cast("string"), F.col("chunk_text")))
