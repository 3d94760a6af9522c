"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import classifier, decontaminate, packing, passages, pii, quality_rules, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_warc": warc.op2_warc,
    "op3_suffix_dedup": substrings.op3_suffix_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_quality_classifier": classifier.op5_quality_classifier,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_passages": passages.op9_passages,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {"op2_warc": warc.SQL, "op6_decontaminate": decontaminate.SQL}
