"""Queries against their SQL over small tables whose keys repeat."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestream.operators.incremental import refresh
from lodestream.operators.indexing import index_pages

PAGES = "page_id bigint, url string, html string"


def differing(spark, folder, name):
    """Rows of the query that its SQL lacks, and the other way, counted with repeats."""
    entry.queries()[name](spark, str(folder)).write.parquet(f"{folder}/out/{name}")
    con = duckdb.connect()
    for table in folder.glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from read_parquet('{table}/*.parquet')")
    con.execute(f"create table want as {entry.oracle_sql()[name]}")
    columns = ", ".join(c[0] for c in con.execute("describe want").fetchall())
    got = f"select {columns} from read_parquet('{folder}/out/{name}/*.parquet')"
    return [con.execute(q).fetchall() for q in (f"{got} except all select {columns} from want", f"select {columns} from want except all {got}")]


@pytest.fixture
def pages(spark, tmp_path):
    """Page 1 is in both crawls, and its url is that of pages 2, 5 (changed) and 7 (new); that
    of 3 and 11 is new to both."""
    url = {2: "u1", 5: "u1", 7: "u1", 11: "u3", 10: "u6"}
    rows = [(i, url.get(i, f"u{i}"), f"<p>page {i % 7} well-known" + " word" * i + "</p>") for i in range(16)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    return tmp_path


def test_refresh_where_urls_repeat(spark, pages):
    assert differing(spark, pages, "refreshed_documents") == [[], []]
    crawl = spark.read.parquet(str(pages / "pages.parquet")).withColumnRenamed("page_id", "page_order")
    with pytest.raises(ValueError, match="already indexed"):
        refresh(index_pages(crawl), crawl)


def test_terms_of_a_refresh_where_urls_repeat(spark, pages):
    assert differing(spark, pages, "refreshed_terms") == [[], []]


def test_status_where_urls_repeat(spark, pages):
    assert differing(spark, pages, "incremental_status") == [[], []]
