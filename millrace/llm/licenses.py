"""License scans, all in SQL functions: which notices a text holds, and where.

A template is the shingles of its normalised words (five words each; a shorter notice is one shingle
of its own length). A text is cut into overlapping windows of a template's length, one for each
start. MinHash bands of one row retrieve templates: a window whose shingles have Jaccard similarity
J with a template's shares none of the BANDS bands with probability (1 - J)^BANDS, 2.3e-8 at the least
J that a match of these notices can have (20 of 25 shingles, 0.667). Retrieved templates
are verified by exact containment of their shingles in the window.

A window without any template shingle can neither collide nor match, so windows are laid only around
the places where one stands; that test is exact.

Scale: one map over the documents and a broadcast join with the templates' bands, whose number
MOST_TEMPLATES bounds (checked); only hits are shuffled.

Defined results: null and empty texts hold nothing; a template without words is refused; rows that
share a doc_id are one document, whose windows are counted together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.quality import let

#: Notices as they are commonly written.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}
SHINGLE = 5
BANDS = 16
PERCENT = 80
MOST_TEMPLATES = 1_000
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def shingle_hashes(words: Column, q: int) -> Column:
    """Hashes of all q-word runs; empty if there are fewer words."""
    of = lambda h: F.when(F.size(h) >= q, F.transform(F.sequence(F.lit(0), F.size(h) - q), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(q)]))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def band_keys(items: Column) -> Column:
    """A key for each band: the least of the items' hashes under the band's seed."""
    seeded = lambda j: lambda x: F.xxhash64(x, F.lit(j))
    return F.array(*[F.xxhash64(F.lit(j), F.array_min(F.transform(items, seeded(j)))) for j in range(BANDS)])


def templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """(template, q, s, items, keys) of each notice: shingle length, number of shingles, hashes, bands."""
    if len(notices) > MOST_TEMPLATES:
        raise ValueError(f"{len(notices)} templates; at most {MOST_TEMPLATES} are broadcast")
    rows = spark.createDataFrame(sorted(notices.items()), "template string, notice string").withColumn("words", normal_words(F.col("notice"))).withColumn("q", F.least(F.lit(SHINGLE), F.size("words")))
    if rows.where("q = 0").count():
        raise ValueError("a template has no words")
    items = reduce(lambda other, q: F.when(F.col("q") == q, shingle_hashes(F.col("words"), q)).otherwise(other), range(1, SHINGLE + 1), F.lit(None).cast("array<bigint>"))
    return rows.withColumn("items", items).withColumn("s", F.size("items")).withColumn("items", F.array_distinct("items")).select("template", "q", "s", "items", band_keys(F.col("items")).alias("keys"))


def windows(h: Column, known: Callable[[Column], Column], s: int) -> Column:
    """Starts of the s-shingle windows that hold a template's shingle."""

    def starts(at: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), p - (s - 1)), F.least(p, F.size(h) - s)))))

    places = F.filter(F.transform(h, lambda x, i: F.when(known(x), i)), lambda p: p.isNotNull() & (p - (s - 1) <= F.size(h) - s))
    return F.when(F.size(h) >= s, let(places, starts)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, template, containment, first_word, n_windows): best containment of the template, the word at which
    its first best window starts, from 0, and how many windows hold `percent` of its shingles or more."""
    spark = docs.sparkSession
    known = templates(spark, notices or NOTICES)
    each = known.collect()  # at most MOST_TEMPLATES rows
    sizes = sorted({(r["q"], r["s"]) for r in each})
    member: dict[int, list[int]] = {q: sorted({x for r in each if r["q"] == q for x in r["items"]}) for q, _ in sizes}
    out = docs.select(F.col(key).alias("doc_id"), normal_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    out = out.select("doc_id", *[shingle_hashes(F.col("w"), q).alias(f"h{q}") for q in member])
    among = lambda q: lambda x: x.isin(member[q])
    out = out.where(reduce(or_, [F.exists(f"h{q}", among(q)) for q in member]))

    def laid(q: int, s: int) -> Column:
        hashes = F.col(f"h{q}")
        window = lambda i: F.struct(F.lit(q).alias("q"), F.lit(s).alias("s"), i.alias("start"), F.array_distinct(F.slice(hashes, i + 1, s)).alias("held"))
        return F.transform(windows(hashes, among(q), s), window)

    found = out.select("doc_id", F.explode(F.concat(*[laid(q, s) for q, s in sizes])).alias("x")).select("doc_id", "x.*")
    found = found.withColumn("key", F.explode(band_keys(F.col("held"))))
    bands = known.select("template", F.col("q").alias("tq"), F.col("s").alias("ts"), "items", F.explode("keys").alias("band"))
    hits = found.join(F.broadcast(bands), (F.col("key") == F.col("band")) & (F.col("q") == F.col("tq")) & (F.col("s") == F.col("ts")))
    hits = hits.withColumn("part", F.size(F.array_intersect("held", "items"))).where(F.col("part") * 100 >= F.size("items") * percent)
    hits = hits.groupBy("doc_id", "template", "start").agg(F.max(F.col("part") / F.size("items")).alias("containment"))
    return hits.groupBy("doc_id", "template").agg(
        F.max("containment").alias("containment"), (-F.max(F.struct("containment", (-F.col("start")).alias("back")))["back"]).cast("long").alias("first_word"), F.count("*").alias("n_windows")
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
