"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm.align import op13_align
from millrace.llm.ann import op1_ann
from millrace.llm.bpe import op10_bpe
from millrace.llm.katz import op7_katz
from millrace.llm.langid import op5_langid
from millrace.llm.licenses import op2_licenses
from millrace.llm.lines import op3_lines
from millrace.llm.merkle import op11_merkle
from millrace.llm.mixing import op4_mixing
from millrace.llm.neardup import op8_neardup
from millrace.llm.oracles import ORACLE
from millrace.llm.quality import op6_quality
from millrace.llm.repeats import op9_passages
from millrace.llm.simhash import op12_simhash

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_ann": op1_ann,
    "op2_licenses": op2_licenses,
    "op3_lines": op3_lines,
    "op4_mixing": op4_mixing,
    "op5_langid": op5_langid,
    "op6_quality": op6_quality,
    "op7_katz": op7_katz,
    "op8_neardup": op8_neardup,
    "op9_passages": op9_passages,
    "op10_bpe": op10_bpe,
    "op11_merkle": op11_merkle,
    "op12_simhash": op12_simhash,
    "op13_align": op13_align,
    "pipeline": corpus_pipeline.run,
}
