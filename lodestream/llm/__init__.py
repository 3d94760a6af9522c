"""Training-data operators: PII, WARC, dedup, quality, toxicity, decontamination, packing.

Nothing outside this subpackage imports it.
"""
