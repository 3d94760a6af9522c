"""Crawl, index, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lodestream.operators.incremental import RefreshCounts, refresh
from lodestream.operators.indexing import SearchIndex, index_pages
from lodestream.operators.links import CrawlReport
from lodestream.sources.fetch import PoliteRequester, crawl_site

PAGES = "page_order bigint, url string, html string, status_code int"


@dataclass(frozen=True)
class BuildSummary:
    crawl: CrawlReport
    counts: RefreshCounts
    unique_terms: int
    token_count: int
    duration_seconds: float

    def text(self) -> str:
        rows = (
            ("Pages crawled", self.crawl.pages_crawled), ("Pages failed", self.crawl.pages_failed),
            ("URLs discovered", self.crawl.urls_discovered), ("URLs visited", self.crawl.urls_visited),
            ("Crawl success rate", f"{self.crawl.success_rate:.1%}"), ("Documents reused", self.counts.reused),
            ("Documents reindexed", self.counts.reindexed), ("Documents new", self.counts.new),
            ("Unique terms", self.unique_terms), ("Total tokens", self.token_count), ("Duration", f"{self.duration_seconds:.2f}s"),
        )
        return "\n".join(["Build complete.", *(f"{k}: {v}" for k, v in rows)])


def build(spark: SparkSession, start_url: str, domain: str, requester: PoliteRequester | None = None, max_pages: int | None = None,
          existing: SearchIndex | None = None, incremental: bool = False, progress: Callable[[str], None] = lambda m: None,
          **options) -> tuple[SearchIndex, BuildSummary]:
    began = time.monotonic()
    progress("Build: crawling pages...")
    rows, report = crawl_site(start_url, domain, requester, max_pages, progress, **options)
    pages = spark.createDataFrame(rows, PAGES)
    if incremental and existing is not None:
        progress("Build: indexing crawled pages (incremental mode)...")
        index, counts = refresh(existing, pages)
    else:
        progress("Build: indexing crawled pages...")
        index, counts = index_pages(pages), RefreshCounts(0, len(rows), 0)
    meta, unique = index.meta.first(), index.terms.count()
    progress("Build: complete.")
    return index, BuildSummary(report, counts, unique, meta.token_count, time.monotonic() - began)
