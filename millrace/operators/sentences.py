"""Sentence boundaries learnt without labels: abbreviations and sentence starters by log-likelihood.

A type is a token in lower case without marks at its ends. Counts over all texts say how often each type carries a final
period. It is an abbreviation where a period belongs to it far more than to words in general: a log-likelihood
ratio, scaled down by length and by each time it stands without, up by inner periods. Types that follow sure
ends of sentences much more than chance are starters. A period ends a sentence unless it is an abbreviation's or an
initial's; then only a starter in upper case behind it says so. `!` and `?` always end one.

Scale: counts are map-side combined aggregates over tokens, and types are made of distinct tokens; abbreviations and starters, a few hundred types, travel as
one row that is broadcast and is refused beyond MOST types. Cutting a text is an expression over its tokens.

Defined results: null and blank texts have no sentences; white space between tokens counts as one blank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.corpus import Chunking, chunks, cleaned
from millrace.functions.text import chunk_id, let, words

#: Fixed values of the published method: least scores of abbreviations and starters, and how sure an abbreviation's period is.
ABBREVIATION, STARTER, SURE = 0.3, 30.0, 0.99
MOST = 100_000
#: Marks that are no part of a type.
MARKS = "\"'()\\[\\]{}«»“”‘’„,;:!?…*_"
END = f"[.!?][\"')\\]}}»”’*_]*$"


def type_of(token: Column) -> Column:
    """The token's type with its final period, if it has one."""
    outer = F.regexp_replace(F.lower(token), f"^[{MARKS}]+|[{MARKS}]+$", "")
    return F.regexp_replace(outer, rf"[{MARKS}]+\.$", ".")


def bare(kind: Column) -> Column:
    return F.regexp_replace(kind, r"\.$", "")


def types(docs: DataFrame, text: str) -> DataFrame:
    """(type, dotted, plain): how often each type with a letter or digit stands with a final period, and without."""
    tokens = docs.select(F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kind = tokens.select(type_of(F.col("token")).alias("kind"), "n").where(F.col("kind").rlike(r"[\p{L}\p{N}]"))
    dotted = F.col("kind").endswith(".")
    times = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return kind.groupBy(bare(F.col("kind")).alias("type")).agg(times(dotted).alias("dotted"), times(~dotted).alias("plain"))


def abbreviations(counted: DataFrame) -> DataFrame:
    """(type, dotted, plain, score) of the types of at least the score; numbers and types that begin with one are none."""
    all_ = counted.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n"), F.sum("dotted").alias("d"))
    p = F.col("d") / F.col("n")
    own, other = F.col("dotted"), F.col("plain")
    chance = own * F.log(p) + other * F.log(1 - p)
    sure = own * F.log(F.lit(SURE)) + other * F.log(F.lit(1 - SURE))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters + 1
    score = -2 * (chance - sure) * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -other.cast("double"))
    rows = counted.where((F.col("dotted") > 0) & F.col("type").rlike(r"^\p{L}")).crossJoin(F.broadcast(all_)).where("d < n")
    return rows.select("type", "dotted", "plain", score.alias("score")).where(F.col("score") >= ABBREVIATION)


@dataclass(frozen=True)
class Learnt:
    """One row: abbreviations and starters, as maps from type to true."""

    row: DataFrame


def _as_map(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.map_from_arrays(F.sort_array(F.collect_set("type")), F.transform(F.sort_array(F.collect_set("type")), lambda _: F.lit(True))).alias(name))


def _checked(rows: DataFrame) -> DataFrame:
    if rows.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} types")
    return rows


def _cuts(tokens: Column, known: Column, starters: Column | None) -> Column:
    """Of each token: whether a sentence ends behind it. The last token always ends one."""

    def ends(t: Column, i: Column) -> Column:
        kind = bare(type_of(t))
        dotted = t.rlike(r"\.[\"')\]}»”’*_]*$")
        short = F.coalesce(F.try_element_at(known, kind), F.lit(False)) | kind.rlike(r"^\p{L}$")
        then = F.get(tokens, i + 1)
        begins = F.lit(False) if starters is None else then.rlike(r"^[\"'(\[{«“‘„*_]*\p{Lu}") & F.coalesce(F.try_element_at(starters, bare(type_of(then))), F.lit(False))
        return t.rlike(END) & (~dotted | ~short | begins)

    return F.transform(tokens, ends)


def followers(docs: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(token, n): how often each token follows a sure end of a sentence."""
    row = _as_map(known, "known")
    said = docs.select(words(F.coalesce(F.col(text), F.lit(""))).alias("ws")).crossJoin(F.broadcast(row))
    # each token beside the cut before it; only those behind a cut leave the row
    behind = F.zip_with(F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), _cuts(F.col("ws"), F.col("known"), None), lambda t, c: F.when(c, t))
    return said.select(F.explode(F.filter(behind, lambda t: t.isNotNull())).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def sentence_starters(docs: DataFrame, text: str, counted: DataFrame, known: DataFrame, keep=lambda df: df) -> DataFrame:
    """(type, starts, n, score) of the types that follow sure ends of sentences far more than chance. keep stores a frame that is read twice."""
    follow = keep(followers(docs, text, known))
    starts = follow.select(bare(type_of(F.col("token"))).alias("type"), F.col("n").alias("times")).where(F.col("type").rlike(r"^\p{L}"))
    starts = starts.groupBy("type").agg(F.sum("times").alias("starts"))
    totals = counted.agg(F.sum(F.col("dotted") + F.col("plain")).cast("double").alias("total")).crossJoin(F.broadcast(follow.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("breaks"))))
    rows = starts.join(counted.select("type", (F.col("dotted") + F.col("plain")).alias("n")), "type").crossJoin(F.broadcast(totals))
    both, b, a, total = F.col("starts"), F.col("n"), F.col("breaks"), F.col("total")
    part = lambda k, of, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(of > k, (of - k) * F.log(1 - p)).otherwise(0.0)
    p, p1, p2 = b / total, both / a, (b - both) / (total - a)
    score = -2 * (part(both, a, p) + part(b - both, total - a, p) - part(both, a, p1) - part(b - both, total - a, p2))
    return rows.where((total / a > b / both) & (total > a)).select("type", "starts", "n", score.alias("score")).where(F.col("score") >= STARTER)


def learn(docs: DataFrame, text: str = "text", keep=lambda df: df) -> Learnt:
    """keep stores frames that are read more than once."""
    counted = keep(types(docs, text))
    known = _checked(keep(abbreviations(counted)))
    starters = _checked(keep(sentence_starters(docs, text, counted, known, keep)))
    return Learnt(_as_map(known, "_known").crossJoin(F.broadcast(_as_map(starters, "_starters"))))


def split(docs: DataFrame, learnt: Learnt, text: str = "text", out: str = "sentences") -> DataFrame:
    """docs with the sentences of each text."""
    ws = words(F.coalesce(F.col(text), F.lit("")))
    both = docs.crossJoin(F.broadcast(learnt.row)).withColumn("_ws", ws).withColumn("_cut", _cuts(F.col("_ws"), F.col("_known"), F.col("_starters")))
    # a break goes in behind each token that ends a sentence; one cut of the joined text gives them
    joined = F.array_join(F.zip_with("_ws", "_cut", lambda w, c: F.concat(w, F.when(c, F.lit("\n")).otherwise(F.lit(" ")))), "")
    parts = let(joined, lambda t: F.filter(F.transform(F.split(t, "\n"), lambda s: F.trim(s)), lambda s: s != ""))
    return both.withColumn(out, parts).drop("_known", "_starters", "_ws", "_cut")


def chunk_documents(docs: DataFrame, learnt: Learnt, text: str, source_id: str, how: Chunking = Chunking()) -> DataFrame:
    """docs with (chunk_no, chunk_id, chunk_text) in place of their text: cleaned, cut at the learnt boundaries."""
    clean = split(docs.withColumn("_clean", cleaned(F.col(text))), learnt, "_clean", "_of")
    out = clean.select(*[c for c in docs.columns if c != text], F.posexplode(chunks(F.col("_clean"), how, F.col("_of"))).alias("chunk_no", "chunk_text"))
    return out.withColumn("chunk_id", chunk_id(F.col(source_id).cast("string"), F.col("chunk_text")))
