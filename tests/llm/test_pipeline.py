"""The corpus pipeline, stage by stage, on the smallest tables."""

import pytest

import corpus_pipeline
from millrace.llm import lines, mixing, neardup, quality
from millrace.llm.core import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return out


def test_stage_columns(stages):
    first = stages[0][1]
    for name, df in stages[1:-1]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in first.schema], name


def test_each_stage_decides_on_its_input(stages):
    tables = [df for _, df in stages]
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in tables]
    assert ids[1] == sorted(r.doc_id for r in quality.measured(tables[0]).where("_q.kept").select("doc_id").collect())
    lost = {r.doc_id: r for r in lines.without_repeats(tables[1]).collect()}
    for r in tables[2].collect():
        assert r.text == lost[r.doc_id].text
    assert all(lost[i]._gone and not lost[i].text.strip() for i in set(ids[1]) - set(ids[2]))
    assert ids[3] == sorted(r.doc_id for r in neardup.near_duplicates(tables[2]).where("kept").select("doc_id").collect())
    taken = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect()}
    assert ids[4] == sorted(i for i, n in taken.items() for _ in range(n)) == ids[5]


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()
