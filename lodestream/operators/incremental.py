"""Refresh of an index from a new crawl: unchanged pages keep their postings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import content_hash, html_to_text
from lodestream.sources.scratch import written

from .indexing import SearchIndex, length_of, meta_of, postings_of_texts, terms_of, with_ids


@dataclass(frozen=True)
class RefreshCounts:
    reused: int = 0
    reindexed: int = 0
    new: int = 0


def classify(pages: DataFrame, documents: DataFrame, keys: Sequence[str] = ("url",), every: bool = False) -> DataFrame:
    """pages with content_hash, document_id (null: new) and status reused, reindexed or new.
    Pages match by url, or by other columns of both tables that tell pages apart where urls
    repeat; of several documents with one key the last by id counts, or each gives a row."""
    old = documents.select(*keys, "document_id", F.col("content_hash").alias("old"))
    if not every:
        old = old.groupBy(*keys).agg(F.max_by(F.struct("document_id", "old"), "document_id").alias("o")).select(*keys, "o.document_id", "o.old")
    status = (
        F.when(F.col("document_id").isNull(), "new")
        .when((F.col("old") != "") & (F.col("old") == F.col("content_hash")), "reused").otherwise("reindexed")
    )
    return pages.withColumn("content_hash", content_hash(F.col("html"))).join(old, list(keys), "left").withColumn("status", status).drop("old")


def next_number(documents: DataFrame) -> int:
    got = documents.agg(F.max(F.expr("try_cast(regexp_extract(document_id, '^doc([0-9]+)$', 1) as bigint)")).alias("m")).first().m
    return (got or 0) + 1


def _whole(seen: DataFrame) -> DataFrame:
    """A document is reused with all its pages or not at all, so one of several pages is
    reindexed."""
    several = seen.filter("document_id is not null").groupBy("document_id").count().filter("count > 1").select("document_id", F.lit("reindexed").alias("__anew"))
    return seen.join(several, "document_id", "left").withColumn("status", F.coalesce("__anew", "status")).drop("__anew")


def refresh(index: SearchIndex, pages: DataFrame, order: str = "page_order", repeats: bool = False) -> tuple[SearchIndex, RefreshCounts]:
    """pages(url, html, order) is the whole new crawl: documents it lacks are gone. A url that
    repeats in it is an error, or with repeats pages and documents of one url are joined: a page
    is then held by each of the documents, a document has a row for each of its pages, and a
    page without a document is a new one."""
    if not repeats:
        twice = pages.groupBy("url").count().filter("count > 1").select("url").head(1)
        if twice:
            raise ValueError(f"Page '{twice[0].url}' is already indexed")
    seen = classify(pages, index.documents, every=repeats)
    seen = written(_whole(seen) if repeats else seen, "seen")
    counts = {r.status: r["count"] for r in seen.groupBy("status").count().collect()}
    fresh = with_ids(seen.filter("status = 'new'").drop("document_id"), order, next_number(index.documents))
    todo = seen.filter("status = 'reindexed'").select("document_id", "url", "html", "content_hash").unionByName(
        fresh.select("document_id", "url", "html", "content_hash"))
    parsed = todo.select("document_id", "url", html_to_text(F.col("html")).alias("text"), "content_hash")
    reused = seen.filter("status = 'reused'").select("document_id")
    documents = index.documents.join(reused, "document_id", "left_semi").unionByName(
        parsed.select("document_id", "url", length_of(F.col("text")).alias("length"), "text", "content_hash"))
    postings = index.postings.join(reused, "document_id", "left_semi").unionByName(
        postings_of_texts(parsed.select("document_id", "text")))
    out = SearchIndex(documents, postings, terms_of(postings), meta_of(documents))
    return out, RefreshCounts(*(counts.get(k, 0) for k in ("reused", "reindexed", "new")))
