"""Cleaning, classification and ranking over all languages, against brute force."""

import re

from millrace.plans.catalog import LEXICON, QUERIES

SF = "/root/testdata/sf0.001"
SP = r"[ \t\n\x0b\f\r]"


def clean(t):
    t = re.sub(rf"\[[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\]|<[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?>|\([0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\)|[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}{SP}*", " ", t)
    t = re.sub(rf"(?i)\buh\b|\bum\b|\byou know\b|\blike i said\b|\bkind of\b|\bsort of\b|\bi mean\b|\bright\?{SP}*|\bokay so\b", " ", t)
    t = re.sub(rf"([a-z,]{{3,}}){SP}+([A-Z][a-z])", r"\1. \2", t)
    return re.sub(rf"\A{SP}+|{SP}+\Z", "", re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]{2,}", " ", t)))


def test_all_languages(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.clean for r in QUERIES["clean_text_all"](spark, SF).collect()}
    assert got == {i: None if t is None else clean(t) for i, t in texts.items()}

    count = lambda w, t: len(re.findall(rf"(?i)\b{w}\b", t))
    want, totals = {}, {}
    for i, t in texts.items():
        t = (t or "")[:1000]
        n = {c: sum(count(w, t) for w in ws) for c, ws in LEXICON.items()}
        totals[i], top = sum(n.values()), max(n, key=n.get)
        level = "advanced" if count("was", t) else "beginner" if count("this", t) else "intermediate"
        want[i] = (top, round(n[top] / totals[i], 6), level) if totals[i] else ("general", 0.0, level)
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["classify_domain_all"](spark, SF).collect()} == want
    ranked = sorted((i for i in totals if totals[i]), key=lambda i: (-totals[i], i))
    assert [(r.doc_id, r.relevance, r.rank) for r in sorted(QUERIES["relevance_rank_all"](spark, SF).collect(), key=lambda r: r.rank)] == [(i, totals[i], k) for k, i in enumerate(ranked, 1)]
