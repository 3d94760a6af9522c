"""An index as four Parquet tables; postings are sorted by term, so that a lookup reads the
row groups of its terms only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.postings import of_blocks, text_blocks
from lodestream.operators.indexing import DOCUMENTS, META, POSTINGS, TERMS, TOTALS, SearchIndex, index_texts, meta_of, repeated_ids, terms_of, totals_of
from lodestream.sources.scratch import written


#: Tokens of the documents a task that sorts postings.
TOKENS = 2_000_000


def _save_documents(index: SearchIndex, path: str, mode: str) -> int:
    index.documents.write.mode(mode).parquet(f"{path}/documents")
    totals_of(_read(index.spark, path, "documents", DOCUMENTS)).write.mode(mode).parquet(f"{path}/totals")
    return _read(index.spark, path, "totals", TOTALS).first().tokens or 0


def _save_postings(rows: DataFrame, by: list, path: str, mode: str, tokens: int, made=lambda rows: rows) -> None:
    # by term and document, so that a common term's postings are spread over tasks and files; into
    # more of them the more there are, so that none has to spill
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, tokens // TOKENS)
    made(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)).write.mode(mode).parquet(f"{path}/postings")


def _save_counts(index: SearchIndex, path: str, mode: str) -> None:
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
    index.meta.coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def save(index: SearchIndex, path: str, mode: str = "errorifexists") -> str:
    tokens = _save_documents(index, path, mode)
    _save_postings(index.postings, ["term", "document_id"], path, mode, tokens)
    _save_counts(index, path, mode)
    return path


def build(docs: DataFrame, path: str) -> str:
    """Indexes and saves docs(document_id, url, text). What counts documents or postings reads
    the files of them, so that texts are split for the lengths once and for the postings once;
    blocks of postings are sorted, by term and first document."""
    spark, mode = docs.sparkSession, "errorifexists"
    index = index_texts(docs)
    tokens = _save_documents(index, path, mode)
    # written out, as the range partitioner reads them twice
    if repeated_ids(docs):
        _save_postings(written(index.postings, "postings"), ["term", "document_id"], path, mode, tokens)
    else:
        _save_postings(written(text_blocks(docs), "blocks"), ["term", F.get("documents", F.lit(0))], path, mode, tokens, of_blocks)
    terms = terms_of(_read(spark, path, "postings", POSTINGS))
    _save_counts(replace(index, terms=terms, meta=meta_of(_read(spark, path, "documents", DOCUMENTS))), path, mode)
    return path


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> SearchIndex:
    read = lambda name, schema: _read(spark, path, name, schema)
    return SearchIndex(read("documents", DOCUMENTS), read("postings", POSTINGS), read("terms", TERMS), read("meta", META), read("totals", TOTALS))
