"""The registered queries on the smallest tables: shapes, and the SQL where there is one."""

import duckdb
import pytest

from millrace.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ann": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
    "op4_mixing": ["doc_id bigint", "size bigint", "source_size bigint", "target double", "taken bigint"],
    "op5_langid": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op6_quality": ["doc_id bigint", "n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint", "base_failed boolean", "kept boolean"],
    "op7_katz": ["doc_id bigint", "held_out boolean", "n_tokens bigint", "n_known bigint", "train_tokens bigint", "base_score double", "score double"],
    "op8_neardup": ["doc_id bigint", "n_shingles bigint", "component_id bigint", "kept boolean"],
    "op9_passages": ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"],
    "op10_bpe": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
    "op11_merkle": ["doc_id bigint", "leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean"],
    "op12_simhash": ["doc_id bigint", "fingerprint string", "component_id bigint"],
    "op13_align": ["doc_id bigint", "n_a bigint", "n_b bigint", "n_groups bigint", "n_links bigint", "n_best bigint", "count_sum bigint", "groups_sha256 string"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    have = [f"{c} {t}" for c, t in df.dtypes]
    assert set(COLUMNS.get(name, [])) <= set(have)
    rows = [r.asDict() for r in df.collect()]
    if name in COLUMNS and name != "op1_ann":
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ORACLE:
        c = duckdb.connect()
        c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
        want = c.sql(ORACLE[name])
        columns = sorted(want.columns)
        cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
        normal = lambda rs: sorted(tuple(cell(r[c]) for c in columns) for r in rs)
        assert normal(rows) == normal([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
