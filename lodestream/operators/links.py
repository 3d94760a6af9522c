"""Links of pages, and breadth-first crawls over a table of pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.sources.scratch import written


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = next((v for k, v in attrs if k == "href" and v), None)
            if href:
                self.found.append(href)


def hrefs(html: str | None) -> list[str]:
    p = _Anchors()
    p.feed(html or "")
    p.close()
    return p.found


def normal_url(base: str, href: str) -> str:
    """Resolved, without the fragment; query, case and trailing slash stay."""
    return urldefrag(urljoin(base, href)).url


def is_internal(url: str, domain: str) -> bool:
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return False
    domain = domain.lower()
    return parts.scheme in ("http", "https") and (host == domain or host.endswith("." + domain))


def internal_links(html: str | None, base: str, domain: str) -> list[str]:
    """First occurrences, in document order."""
    out: dict[str, None] = {}
    for h in hrefs(html):
        try:
            url = normal_url(base, h)
        except ValueError:
            continue
        if is_internal(url, domain):
            out.setdefault(url)
    return list(out)


def link_rows(pages: DataFrame, domain: str | None = None) -> DataFrame:
    """(src_url, pos, url) of the internal links of pages(url, html); without a domain, each
    page's own host counts as one. Resolving a reference has no built-in counterpart, so this
    runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, html in zip(b["url"], b["html"]):
                own = domain or (urlsplit(url).hostname or "")
                rows += [(url, i, x) for i, x in enumerate(internal_links(html, url, own))]
            yield pd.DataFrame(rows, columns=["src_url", "pos", "url"])

    return pages.select("url", "html").mapInPandas(run, "src_url string, pos int, url string")


#: Simple anchors, by expression alone.
HREF_PATTERN = r"""<a\s[^>]*href="([^"]+)\""""


def href_rows(pages: DataFrame) -> DataFrame:
    """(url, pos, href) of double-quoted references, without leaving the JVM."""
    return pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF_PATTERN), F.lit(1))).alias("pos", "href"))


@dataclass(frozen=True)
class CrawlReport:
    urls_discovered: int
    urls_visited: int
    pages_crawled: int
    pages_failed: int

    @property
    def success_rate(self) -> float:
        return self.pages_crawled / self.urls_visited if self.urls_visited else 0.0


def crawl_table(pages: DataFrame, start_url: str, domain: str, max_pages: int | None = None) -> tuple[DataFrame, CrawlReport]:
    """Breadth-first over pages(url, html[, status_code]): each level is one join of the
    frontier with the pages, written out, so that plans do not grow with the depth. A url that the table lacks is a failed fetch. Order within a
    level is that of the parents, then of the links. Returns pages with page_order."""
    spark = pages.sparkSession
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    store = pages.select("url", "html", F.coalesce(status, F.lit(200)).cast("int").alias("status_code"))
    frontier = spark.createDataFrame([(start_url, 0)], "url string, ord bigint")
    seen, crawled = frontier.select("url"), None
    discovered, visited, done, failed, base = 1, 0, 0, 0, 0
    while max_pages is None or done < max_pages:
        level = written(frontier.join(store, "url", "left"), "level")
        good = level.filter("html is not null")
        if max_pages is not None:
            last = good.select("ord").orderBy("ord").limit(max_pages - done).agg(F.max("ord").alias("m"), F.count("*").alias("n")).first()
            if last.n == max_pages - done:  # the crawl ends with the last page it may take
                level = level.filter(F.col("ord") <= (last.m if last.n else -1))
                good = level.filter("html is not null")
        n = level.agg(F.count("*").alias("all"), F.count("html").alias("ok")).first()
        if not n["all"]:
            break
        visited, done, failed = visited + n["all"], done + n.ok, failed + n["all"] - n.ok
        part = good.select((F.col("ord") + base).alias("page_order"), "url", "html", "status_code")
        crawled = part if crawled is None else crawled.unionByName(part)
        base += 1 << 50
        links = link_rows(good, domain).join(good.select(F.col("url").alias("src_url"), "ord"), "src_url")
        fresh = links.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("k")).join(seen, "url", "left_anti")
        frontier = written(fresh.orderBy("k").select("url", F.monotonically_increasing_id().alias("ord")), "frontier")
        found = frontier.count()
        if not found:
            break
        discovered += found
        seen = written(seen.unionByName(frontier.select("url")), "seen")
    if crawled is None:
        crawled = store.limit(0).select(F.lit(0).cast("bigint").alias("page_order"), "url", "html", "status_code")
    return crawled, CrawlReport(discovered, visited, done, failed)
