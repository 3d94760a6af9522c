"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import cut, table
from lodestream.llm.decontaminate import keep_clean
from lodestream.llm.packing import packed
from lodestream.llm.pii import redact
from lodestream.llm.quality_rules import keep_good
from lodestream.llm.simhash import keep_one

STAGES = [
    ("quality_rules", keep_good),
    ("simhash_dedup", keep_one),
    ("decontamination", keep_clean),
    ("pii", redact),
    ("packing", packed),
]

#: Fitting the rules, fingerprints and packing are not expressible in SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
