"""The positional inverted index, held as ordinary tables.

documents (document_id, url, length, text, content_hash), postings (term, document_id, tf,
positions), terms (term, df), and two counts. Postings of texts are gathered a text at a time;
they are shuffled, by term and document, only where several texts have one id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.postings import text_counts, text_postings
from lodestream.functions.text import base_tokens, content_hash, html_to_text, token_rows
from lodestream.sources.scratch import written

DOCUMENTS = "document_id string, url string, length int, text string, content_hash string"
POSTINGS = "term string, document_id string, tf int, positions array<int>"
TERMS = "term string, df bigint"
META = "page_count bigint, token_count bigint"
TOTALS = "documents bigint, tokens bigint"


@dataclass(frozen=True)
class SearchIndex:
    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    meta: DataFrame
    #: (documents, tokens) of the documents, one row; counted anew where they are not stored
    totals: DataFrame | None = None

    @property
    def corpus(self) -> DataFrame:
        return self.totals if self.totals is not None else totals_of(self.documents)

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession


def empty_index(spark: SparkSession) -> SearchIndex:
    return SearchIndex(
        spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], POSTINGS), spark.createDataFrame([], TERMS),
        spark.createDataFrame([(0, 0)], META))


def postings_of(rows: DataFrame) -> DataFrame:
    """rows(document_id, term, pos) to postings. Repeated positions are kept."""
    grouped = rows.groupBy("term", "document_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", "document_id", F.size("positions").cast("int").alias("tf"), F.col("positions"))


def repeated_ids(documents: DataFrame) -> bool:
    return bool(documents.groupBy("document_id").count().filter("count > 1").head(1))


def merged(postings: DataFrame) -> DataFrame:
    """One row a term and document."""
    grouped = postings.groupBy("term", "document_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return grouped.select("term", "document_id", F.size("positions").cast("int").alias("tf"), F.col("positions"))


def postings_of_texts(docs: DataFrame) -> DataFrame:
    """docs(document_id, text) to postings; the texts of one id are one document's."""
    rows = text_postings(docs)
    return merged(rows) if repeated_ids(docs) else rows


def terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def meta_of(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("page_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("token_count"))


def totals_of(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.sum("length").cast("bigint").alias("tokens"))


def length_of(text: Column) -> Column:
    """Tokens of a text, parts of hyphenated ones included."""
    parts = lambda t: F.when(F.contains(t, F.lit("-")), F.size(F.split(t, "-"))).otherwise(0)
    return F.aggregate(base_tokens(text), F.lit(0), lambda n, t: n + 1 + parts(t))


def check_unique(documents: DataFrame) -> None:
    twice = documents.groupBy("document_id").count().filter("count > 1").select("document_id").head(1)
    if twice:
        raise ValueError(f"Document '{twice[0].document_id}' is already indexed")


def index_texts(docs: DataFrame, only: Sequence[str] | None = None, validate: bool = False) -> SearchIndex:
    """docs(document_id, url, text[, content_hash]). With only, postings and df of those terms
    alone are built: enough to answer a query over texts that have no index yet."""
    hashed = F.col("content_hash") if "content_hash" in docs.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    documents = docs.select("document_id", "url", length_of(text).alias("length"), text.alias("text"), hashed.alias("content_hash"))
    if validate:
        check_unique(documents)
    postings = postings_of_texts(docs) if only is None else postings_of(token_rows(docs.select("document_id", "text"), ["document_id"], only=only))
    return SearchIndex(documents, postings, terms_of(postings), meta_of(documents))


def index_tokens(docs: DataFrame) -> SearchIndex:
    """docs(document_id, url, tokens, text): a token's position is its place in the list."""
    postings = postings_of(docs.select("document_id", F.posexplode("tokens").alias("pos", "term")))
    documents = docs.select("document_id", "url", F.size("tokens").cast("int").alias("length"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("content_hash"))
    return SearchIndex(documents, postings, terms_of(postings), meta_of(documents))


def numbered(ordered: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Adds the place of each row of a sorted table. Places come from counts of the sorted
    partitions, so that no task holds all rows; the sorted rows are written out first, since a
    second sort might deal them out otherwise."""
    spark = ordered.sparkSession
    rows = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    base, total = [], start
    for p in sorted(sizes):
        base.append((int(p), total))
        total += sizes[p]
    starts = spark.createDataFrame(base or [(0, start)], "__part bigint, __base bigint")
    number = F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), part == F.col("__part")).select(*ordered.columns, number.alias(name))


def with_ids(pages: DataFrame, order: str, start: int = 1) -> DataFrame:
    """Adds document_id, doc1, doc2, ... by the order column."""
    rows = numbered(pages.orderBy(order), "__number", start)
    return rows.select(F.concat(F.lit("doc"), F.col("__number").cast("string")).alias("document_id"), *pages.columns)


def index_pages(pages: DataFrame, order: str = "page_order", validate: bool = True) -> SearchIndex:
    """pages(url, html, order) as crawled."""
    parsed = with_ids(pages, order).select("document_id", "url", html_to_text(F.col("html")).alias("text"), content_hash(F.col("html")).alias("content_hash"))
    return index_texts(parsed, validate=validate)


def rebuild(index: SearchIndex) -> SearchIndex:
    """The index anew: from stored texts, or from postings for documents without one."""
    texts = index.documents.filter(F.col("text") != "")
    bare = index.documents.filter(F.col("text") == "")
    held = index.postings.filter(F.size("positions") > 0)
    held = held.select("term", "document_id", F.size("positions").cast("int").alias("tf"), F.sort_array("positions").alias("positions"))
    # only the ids are hashed, and the postings not sorted
    kept = held.join(bare.select("document_id").hint("shuffle_hash"), "document_id", "left_semi")
    postings = text_postings(texts).unionByName(kept)
    # counted without positions, and those of texts before anything leaves Python
    terms = text_counts(texts).select("term", "df").unionByName(terms_of(kept)).groupBy("term").agg(F.sum("df").alias("df"))
    if repeated_ids(index.documents):
        postings = merged(postings)
        terms = terms_of(postings)
    documents = texts.withColumn("length", length_of(F.col("text"))).unionByName(bare)
    return SearchIndex(documents, postings, terms, meta_of(documents))
