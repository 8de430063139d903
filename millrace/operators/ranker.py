"""A learnt re-ranker: pairwise logistic ranking over features of (query, passage), all of them built-in expressions.

Each labelled query's relevant candidates are set against its others; the model is a logistic regression on the
differences of their features, without an intercept, fitted by Spark. A search gives a query few candidates, so that
its pairs are few. Queries that have no relevant or no other candidate teach nothing.

A query with one candidate keeps it as it is, without a score. Where a model is missing, or a feature of one of a
query's candidates is, that query falls back to the order of the search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let, words

FEATURES = ["semantic", "keyword", "overlap", "pairs", "near", "length"]


@dataclass(frozen=True)
class Ranker:
    weights: list[float]


def _pairs(ws: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def _share(asked: Column, have: Column) -> Column:
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, have)) / F.size(asked)).otherwise(0.0)


def featured(candidates: DataFrame, query: str = "query_id", query_text: str = "query_text", text: str = "text", semantic: str = "semantic_score", keyword: str | None = "bm25_score") -> DataFrame:
    """candidates with `features`: both scores by the best of the query, shares of the query's words and neighbouring
    words in the passage, how close the first places of its words lie, and the passage's length."""
    own = Window.partitionBy(query)
    asked, have = (words(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in (query_text, text))
    places = lambda q, t: F.filter(F.transform(F.array_distinct(q), lambda w: F.array_position(t, w)), lambda p: p > 0)
    near = let(F.struct(asked.alias("q"), have.alias("t")), lambda x: let(places(x["q"], x["t"]), lambda ps: F.when(F.size(ps) > 1, F.size(ps) / (F.array_max(ps) - F.array_min(ps) + 1)).otherwise(0.0)))
    by_best = lambda c: F.when(F.max(c).over(own) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.max(c).over(own)).otherwise(0.0)
    parts = [by_best(semantic), by_best(keyword) if keyword else F.lit(0.0), _share(F.array_distinct(asked), F.array_distinct(have)), let(asked, lambda q: let(have, lambda t: _share(_pairs(q), _pairs(t)))), near, F.log1p(F.size(have).cast("double"))]
    return candidates.withColumn("features", F.when(F.col(text).isNotNull() & F.col(query_text).isNotNull(), F.array(*[p.cast("double") for p in parts])))


def fit(rows: DataFrame, query: str = "query_id", label: str = "relevant") -> Ranker | None:
    """rows (query, features, label boolean) -> a model, or None where nothing can be learnt."""
    rows = rows.where("features is not null").select(query, "features", label)
    good, bad = rows.where(F.col(label)).select(query, F.col("features").alias("g")), rows.where(~F.col(label)).select(query, F.col("features").alias("b"))
    step = F.zip_with("g", "b", lambda x, y: x - y)
    both = good.join(bad, query).select(F.explode(F.array(F.struct(step.alias("x"), F.lit(1.0).alias("label")), F.struct(F.transform(step, lambda x: -x).alias("x"), F.lit(0.0).alias("label")))).alias("r"))
    data = both.select(array_to_vector("r.x").alias("features"), "r.label")
    if data.isEmpty():
        return None
    model = LogisticRegression(fitIntercept=False, regParam=0.01, maxIter=50, standardization=True).fit(data)
    return Ranker([float(w) for w in model.coefficients])


def rerank(candidates: DataFrame, model: Ranker | None, n: int = 10, query: str = "query_id", key: str = "chunk_id", order_by: str = "semantic_score") -> DataFrame:
    """featured candidates -> each query's n best with rank_score and retrieval_rank; see above for what has no score."""
    own = Window.partitionBy(query)
    score = F.lit(None).cast("double") if model is None else F.aggregate(F.zip_with("features", F.array(*map(F.lit, model.weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    rows = candidates.withColumn("rank_score", score)
    whole = (F.count("rank_score").over(own) == F.count("*").over(own)) & (F.count("*").over(own) > 1)
    rows = rows.withColumn("rank_score", F.when(whole, F.col("rank_score")))
    order = own.orderBy(F.desc("rank_score"), F.desc(order_by), key)
    return rows.withColumn("retrieval_rank", F.row_number().over(order)).where(F.col("retrieval_rank") <= n)
