"""BM25 over a stored index, with postings in blocks that carry their highest impact, and pruned search.

The index holds, for each term and page (texts dealt by a hash of their key, about PAGE to a page), one row
with the keys, the impact of the term on each (its BM25 weight without the idf) and the highest of them.
A search never multiplies common words with all texts:

1. A query's rarest terms give a first ranking; the n-th best of its first texts, scored in full, is a bound that
   the n-th best text of all reaches.
2. Terms are read rarest first, until what the others could add is below CUTS[0] of the bound: a text that
   holds only those others is never touched. What the read terms find gives a second, better bound.
3. The other terms are looked up by (term, page), a stage for each further cut, for those texts only that
   what is left could still lift to the bound.

The result is that of the exhaustive search. Where an idf is below zero (a corpus in which most terms are in
most texts) bounds do not hold, and the exhaustive search over the same blocks is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import words
from millrace.operators.retrieve import K1, MOST_BROADCAST, MOST_TERMS, B, idf_of, postings, top

#: Texts of a page, about; folders that terms are dealt over.
PAGE, FOLDERS = 64, 32
#: Postings of the rarest terms that are read for the first bound, and texts tried for it, as multiples of n.
SEEDS, TRIED = 64, 4
#: Shares of the bound, 1 at most: a stage ends where what later terms could add is below it.
CUTS = (1.0, 0.9, 0.8, 0.7, 0.5)
#: Lookups (query, text, term) that are broadcast to the blocks; with more, the blocks of their terms are shuffled.
MOST_LOOKED_UP = 500_000
#: Scores are compared after rounding; what could round up to the bound stays.
SLACK = 2e-6


@dataclass(frozen=True)
class Blocks:
    """blocks (term, page, keys, impacts, most), terms (term, df, idf, most), the number of pages and of texts."""

    blocks: DataFrame
    terms: DataFrame
    pages: int
    n_docs: int


def build(docs: DataFrame, path: str, key: str = "chunk_id", text: str = "text") -> Blocks:
    """Writes the index of docs (key unique) under path."""
    spark = docs.sparkSession
    rows = postings(docs, key, text)
    rows.write.mode("overwrite").parquet(f"{path}/postings")
    rows = spark.read.parquet(f"{path}/postings")
    sizes = docs.select(F.count("*").alias("n"), F.avg(F.size(words(F.lower(F.coalesce(F.col(text), F.lit("")))))).alias("avgdl"))
    sizes.write.mode("overwrite").parquet(f"{path}/figures")
    n_docs, avgdl = spark.read.parquet(f"{path}/figures").first()
    pages = max(1, -(-n_docs // PAGE))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (avgdl or 1.0)))
    entry = F.struct(F.col(key).alias("key"), impact.alias("impact"))
    page = F.pmod(F.xxhash64(key), F.lit(pages)).cast("int")
    folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")
    # dealt as they are written, so that postings are shuffled once for their blocks
    dealt = rows.select("term", page.alias("page"), folder.alias("folder"), entry.alias("e")).repartition("folder", "page")
    blocks = dealt.groupBy("folder", "page", "term").agg(F.sort_array(F.collect_list("e")).alias("e"))  # a page of texts at most
    blocks = blocks.select("term", "page", F.col("e.key").alias("keys"), F.col("e.impact").alias("impacts"), F.array_max("e.impact").alias("most"), "folder")
    blocks.sortWithinPartitions("folder", "term", "page").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    held = rows.groupBy("term").agg(F.count("*").alias("df"), F.max(impact).alias("most"))
    idf_of(held.select("term", "df"), n_docs).join(held, "term").write.mode("overwrite").parquet(f"{path}/terms")
    return open_blocks(spark, path)


def open_blocks(spark: SparkSession, path: str) -> Blocks:
    n_docs = spark.read.parquet(f"{path}/figures").first()["n"]
    key = spark.read.parquet(f"{path}/postings").schema.fields[1].dataType.simpleString()
    shape = f"term string, page int, keys array<{key}>, impacts array<double>, most double, folder int"
    return Blocks(spark.read.schema(shape).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), max(1, -(-n_docs // PAGE)), n_docs)


def weighted(index: Blocks, queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, term, df, w, most): a query's terms that the corpus has, w its times in the query by its idf, most its highest contribution."""
    asked = queries.select(query, F.explode(words(F.lower(F.coalesce(F.col(query_text), F.lit(""))))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
    return asked.join(index.terms, "term").select(query, "term", "df", (F.col("times") * F.col("idf")).alias("w"), (F.col("times") * F.col("idf") * F.col("most")).alias("most"))


def _read(index: Blocks, terms: DataFrame) -> DataFrame:
    """The blocks of some (query, term, w): (term, folder) picks the folders that are opened."""
    some = terms.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        some = F.broadcast(some)
    return index.blocks.join(some, ["folder", "term"])


def found(index: Blocks, terms: DataFrame, query: str) -> DataFrame:
    """(query, key, part): what these terms give each text that holds one of them."""
    entry = F.explode(F.arrays_zip("keys", "impacts")).alias("e")
    return _read(index, terms).select(query, "w", entry).groupBy(query, F.col("e.keys").alias("key")).agg(F.sum(F.col("w") * F.col("e.impacts")).alias("part"))


def looked_up(index: Blocks, texts: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """(query, key, more, hits): what these terms give the texts (query, key), read from the blocks of their pages, and how many do."""
    page = F.pmod(F.xxhash64("key"), F.lit(index.pages)).cast("int")
    asked = texts.select(query, "key", page.alias("page")).join(terms.select(query, "term", "w"), query)
    at = F.array_position("keys", F.col("key"))
    # only blocks of these terms can be asked, and few questions go to the blocks
    wanted = terms.select("term").distinct()
    if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        wanted = F.broadcast(wanted)
    if asked.limit(MOST_LOOKED_UP + 1).count() <= MOST_LOOKED_UP:
        asked = F.broadcast(asked)
    hit = index.blocks.join(wanted, "term", "left_semi").join(asked, ["term", "page"]).where(at > 0)
    return hit.select(query, "key", (F.col("w") * F.element_at("impacts", at.cast("int"))).alias("x")).groupBy(query, "key").agg(F.sum("x").alias("more"), F.count("*").alias("hits"))


@dataclass(frozen=True)
class Found:
    """scored (query, key, part): a superset of the result with full scores; read: (query, n) postings read, a frame for each step."""

    scored: DataFrame
    read: list[DataFrame]


def _bound(index: Blocks, texts: DataFrame, terms: DataFrame, n: int, query: str) -> tuple[DataFrame, DataFrame]:
    """(query, bound): the n-th best full score of some texts (query, key, part) of each query, 0 for fewer; and the terms' entries found."""
    more = looked_up(index, texts, terms, query)
    exact = texts.join(more, [query, "key"], "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0.0)))
    nth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(n - 1))  # of TRIED * n at most
    return exact.groupBy(query).agg(F.coalesce(nth, F.lit(0.0)).alias("bound")), more.select(query, F.col("hits").alias("n"))


def pruned(index: Blocks, queries: DataFrame, n: int, query: str = "query_id", query_text: str = "text", keep=lambda df: df) -> Found:
    """Steps 1 to 3. keep stores a frame that is read more than once."""
    terms = weighted(index, queries, query, query_text)
    order = Window.partitionBy(query).orderBy("df", "term")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    terms = keep(terms.withColumn("first", F.coalesce(F.sum("df").over(before), F.lit(0)) < SEEDS * n).withColumn("left", F.sum("most").over(on)))
    seeds = keep(top(found(index, terms.where("first"), query), [query], "part", "key", TRIED * n).select(query, "key", "part"))
    bound, hits = _bound(index, seeds, terms.where("not first"), n, query)
    read = [terms.where("first").select(query, F.col("df").alias("n")), hits]
    terms = keep(terms.join(bound, query).withColumn("listed", F.col("left") >= CUTS[0] * F.col("bound") - SLACK))
    read.append(terms.where("listed and not first").select(query, F.col("df").alias("n")))
    rest = terms.groupBy(query).agg(F.max("bound").alias("bound"), F.coalesce(F.max(F.when(~F.col("listed"), F.col("left"))), F.lit(0.0)).alias("rest"))
    some = found(index, terms.where("listed"), query).join(rest, query).where(F.col("part") + F.col("rest") >= F.col("bound") - SLACK).select(query, "key", "part")
    some, terms = keep(some), terms.where("not listed")
    best = keep(top(some, [query], "part", "key", n).select(query, "key", "part"))
    better, hits = _bound(index, best, terms, n, query)
    read.append(hits)
    terms = terms.join(better.withColumnRenamed("bound", "b"), query).withColumn("bound", F.greatest("bound", "b")).drop("b")
    stage = sum(((F.col("left") < c * F.col("bound")).cast("int") for c in CUTS[1:]), F.lit(0))
    terms = keep(terms.withColumn("stage", stage))
    for at in range(len(CUTS)):
        more = keep(looked_up(index, some, terms.where(F.col("stage") == at), query))
        read.append(more.select(query, F.col("hits").alias("n")))
        rest = terms.groupBy(query).agg(F.max("bound").alias("bound"), F.max(F.when(F.col("stage") > at, F.col("left"))).alias("rest"))
        lifted = some.join(more, [query, "key"], "left").withColumn("part", F.col("part") + F.coalesce("more", F.lit(0.0))).join(rest, query, "left")
        some = keep(lifted.where(F.col("bound").isNull() | (F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("bound") - SLACK)).select(query, "key", "part"))
    return Found(some, read)


def search(index: Blocks, queries: DataFrame, n: int = 15, key: str = "chunk_id", query: str = "query_id", query_text: str = "text", digits: int = 6, keep=lambda df: df) -> DataFrame:
    """(query, key, bm25_score, rank): each query's n best of the whole corpus, ties to the smaller key."""
    if index.terms.where("idf < 0").isEmpty():
        scored = pruned(index, queries, n, query, query_text, keep).scored
    else:
        scored = found(index, weighted(index, queries, query, query_text), query)
    scored = scored.select(query, F.col("key").alias(key), F.round("part", digits).alias("bm25_score"))
    return top(scored, [query], "bm25_score", key, n)


def share_read(index: Blocks, queries: DataFrame, n: int, query: str = "query_id", query_text: str = "text", keep=lambda df: df) -> DataFrame:
    """(query, entries, read): the postings of each query's terms, and those that the pruned search reads, some of them twice."""
    reads = pruned(index, queries, n, query, query_text, keep).read
    every = reads[0]
    for r in reads[1:]:
        every = every.unionByName(r)
    listed = weighted(index, queries, query, query_text).groupBy(query).agg(F.sum("df").alias("entries"))
    return listed.join(every.groupBy(query).agg(F.sum("n").alias("read")), query)


def containing(index: Blocks, docs: DataFrame, items: DataFrame, key: str = "chunk_id", text: str = "text", item: str = "item") -> DataFrame:
    """items joined with the (key) of the texts that contain the column item, letter by letter.

    Whole words of an item, all but its first and last, are words of such a text: texts are looked up by the
    rarest of them. Items of fewer words are compared with all texts.
    """
    ws = words(F.lower(F.coalesce(F.col(item), F.lit(""))))
    named = items.withColumn("_item", F.monotonically_increasing_id()).withColumn("_ws", F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0))))
    inner = named.select("_item", F.explode(F.array_distinct("_ws")).alias("term")).join(index.terms.select("term", "df"), "term", "left")
    rarest = inner.groupBy("_item").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    held = index.blocks.join(rarest, "term").select("_item", F.explode("keys").alias("_key"))
    body = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    long = named.join(held, "_item").join(body, "_key").where(F.expr(f"contains(_text, `{item}`)"))
    short = named.where(F.size("_ws") == 0).join(body, F.expr(f"contains(_text, `{item}`)"))
    return long.select(*items.columns, F.col("_key").alias(key)).unionByName(short.select(*items.columns, F.col("_key").alias(key)))


def holding(docs: DataFrame, items: DataFrame, key: str = "chunk_id", text: str = "text", item: str = "item") -> DataFrame:
    """The rows of `containing` without an index: items, MOST_BROADCAST at most, go to the texts, which are read once and not shuffled."""
    if items.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} items: use containing")
    # whole words of an item, all but its first and last, are words of a text that contains it: its longest says which texts to compare
    ws = words(F.col(item))
    inner = F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("minus"), w.alias("word")))), 1)["word"]
    named = items.withColumn("_word", F.when(F.size(inner) > 0, longest))
    asked = named.agg(F.collect_set("_word").alias("_asked"))  # MOST_BROADCAST words at most
    body = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    some = body.crossJoin(F.broadcast(asked)).withColumn("_have", F.array_intersect(words(F.col("_text")), "_asked")).drop("_asked")
    texts = some.where(F.size("_have") > 0).select("_key", "_text", F.explode("_have").alias("_word"))
    inside = F.expr(f"contains(_text, `{item}`)")
    long = texts.join(F.broadcast(named.where("_word is not null")), "_word").where(inside)
    short = body.join(F.broadcast(named.where(F.col("_word").isNull())), inside)
    return long.select(*items.columns, F.col("_key").alias(key)).unionByName(short.select(*items.columns, F.col("_key").alias(key)))
