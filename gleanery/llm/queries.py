"""The queries opN_* of the training-data operators and their SQL."""

from __future__ import annotations

from gleanery.llm.archives import OP7_SQL, op7_warc
from gleanery.llm.decontamination import OP9_SQL, op9_decontamination
from gleanery.llm.extraction import op8_extraction
from gleanery.llm.language import op4_language
from gleanery.llm.licenses import op2_licenses
from gleanery.llm.line_dedup import op1_line_dedup
from gleanery.llm.mixing import OP10_SQL, op10_mixing
from gleanery.llm.ngram_join import op3_ngram_join
from gleanery.llm.suffix_tree import op6_suffix_tree
from gleanery.llm.winnowing import op5_fingerprints

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_licenses": op2_licenses,
    "op3_ngram_join": op3_ngram_join,
    "op4_language": op4_language,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_warc": op7_warc,
    "op8_extraction": op8_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op7_warc": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_mixing": OP10_SQL,
}
