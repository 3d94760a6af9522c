"""Behaviour of the search engine on literal inputs; scores follow from the formulas."""

import html
import math

import pytest
from pyspark.sql import functions as F

from lodestream.benchmarking import benchmark, mean_seconds
from lodestream.building import BuildSummary
from lodestream.functions.text import html_to_text, token_positions, tokens, unescaped, with_snippet
from lodestream.operators.incremental import RefreshCounts, refresh
from lodestream.operators.indexing import index_pages, index_texts, index_tokens, numbered, rebuild
from lodestream.operators.links import CrawlReport, crawl_table, internal_links
from lodestream.operators.ranking import least_distance, with_bonus
from lodestream.operators.retrieval import find, lookup
from lodestream.operators.suggest import suggest_query, suggest_term
from lodestream.plans.query import parse_query
from lodestream.shell import Shell, parse_find, parse_runs
from lodestream.sources import json_index, parquet_index
from lodestream.sources.fetch import FetchResult, PoliteRequester, crawl_site
from lodestream.streaming.refresh import refresh_from_stream


def one(spark, expr, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


def corpus(spark, **docs):
    rows = [(k, f"http://h/{k}", t.split(), t) for k, t in docs.items()]
    return index_tokens(spark.createDataFrame(rows, "document_id string, url string, tokens array<string>, text string"))


def test_tokens(spark):
    text = "Don't panic. It's okay. 'Friends,' friends'"
    assert one(spark, lambda c: tokens(c, False), text) == ["don't", "panic", "it's", "okay", "friends", "friends"]
    assert one(spark, tokens, "well-known state-of-the-art ---test---") == ["well-known", "well", "known", "state-of-the-art", "state", "of", "the", "art", "test"]
    got = one(spark, token_positions, "well-known author well-well")
    assert [tuple(r) for r in got] == [("well-known", 0), ("well", 0), ("known", 0), ("author", 1), ("well-well", 2), ("well", 2), ("well", 2)]
    assert one(spark, tokens, None) == []


def test_html_to_text(spark):
    html = "<style>a{}</style><p>Hello</p><!-- x > y --><script>var b='<p>';</script><noscript>no</noscript> <b> World &amp; co&copy </b>"
    assert one(spark, html_to_text, html) == "Hello World & co©"


def test_character_references(spark):
    """As the standard library decodes them."""
    for text in ("a &#8217; b &eacute; &eacute &notit; &notin; &amp;lt; &zzz; &; & x", "&#x1F600;&#0;&#xD800;&#128;&#99999999999;&copy2&AMP", "none"):
        assert one(spark, unescaped, text) == html.unescape(text)
    assert one(spark, html_to_text, "<p>it&#8217;s caf&eacute; &amp;lt;</p>") == "it’s café &lt;"


def test_query_language():
    q = parse_query('foo"bar baz" "A b" "a B" don\'t ""')
    assert q.terms == ("foo", "bar", "baz", "don't") and q.phrases == (("a", "b"),)
    assert q.scoring_terms == ("foo", "bar", "baz", "don't", "a", "b") and q.display == 'foo bar baz "a b" don\'t'
    assert parse_query("-- ??").empty and parse_query('"open end').terms == ("open", "end")


def test_scores(spark):
    a = corpus(spark, doc1="truth and good", doc2="good friends make good times")
    got = {r.document_id: r.relevance_score for r in find(a, "good").collect()}
    assert got["doc2"] == pytest.approx(2.0) and got["doc1"] == pytest.approx(1.0)
    got = {r.document_id: r.relevance_score for r in find(a, "good", "bm25").collect()}
    assert got["doc2"] == pytest.approx(0.24108635609117962) and got["doc1"] == pytest.approx(0.2054327400495263)
    both = find(a, "good friends").first()
    assert both.relevance_score == pytest.approx(3 + math.log(1.5)) and both.term_frequencies == {"good": 2, "friends": 1}
    assert find(a, "good friends", proximity_bonus=True).first().relevance_score == pytest.approx(4.001421502027093)
    assert find(a, "good missing").count() == 0 and find(a, "?").count() == 0
    with pytest.raises(ValueError):
        find(a, "good", "other")


def test_phrases_and_order(spark):
    a = corpus(spark, doc10="the the end", doc2="the end the", doc3="good", doc4="good")
    assert [r.document_id for r in find(a, '"the the"').collect()] == ["doc10"]
    assert [r.document_id for r in find(a, "good").collect()] == ["doc3", "doc4"]
    assert [r.document_id for r in find(a, 'end "end the"').collect()] == ["doc2"]
    assert [r.document_id for r in lookup(a, "THE!").collect()] == ["doc10", "doc2"]


def test_distance_and_bonus(spark):
    df = spark.createDataFrame([([1, 5, 10], [3, 7]), ([2, 5], [1, 5, 9]), ([], [1])], "a array<int>, b array<int>")
    assert [r.d for r in df.select(least_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 0, None]
    assert one(spark, lambda c: with_bonus(c, F.lit(2.0), 0.5), 10.0, "double") == 15.0


def test_snippets(spark):
    df = spark.createDataFrame([("zero one two three four five six seven eight",), ("  ",)], "text string")
    got = [r.snippet for r in with_snippet(df, ["five"], window=3).collect()]
    assert got == ["... four [five] six ...", ""]


def test_suggestions(spark):
    a = corpus(spark, doc1="cut cat good friends")
    assert suggest_term(a, "cit") == "cat" and suggest_term(a, "cat") is None and suggest_term(a, "zzzzzz") is None
    assert suggest_query(a, '"godo friends"') == {"godo": "good"}


PAGES = "page_order bigint, url string, html string"


def test_build_refresh_and_storage(spark, tmp_path):
    pages = spark.createDataFrame([(0, "u1", "<p>good friends</p>"), (1, "u2", "<p>well-known</p>")], PAGES)
    index = index_pages(pages)
    assert {r.document_id: r.length for r in index.documents.collect()} == {"doc1": 2, "doc2": 3}
    path = json_index.save(index, tmp_path / "d" / "index.json")
    index = json_index.load(spark, path)
    new, counts = refresh(index, spark.createDataFrame([(0, "u1", "<p>good friends</p>"), (1, "u2", "<p>other</p>"), (2, "u3", "new")], PAGES))
    assert (counts.reused, counts.reindexed, counts.new) == (1, 1, 1)
    assert {r.url: r.document_id for r in new.documents.collect()} == {"u1": "doc1", "u2": "doc2", "u3": "doc3"}
    assert {r.term for r in new.terms.collect()} == {"good", "friends", "other", "new"}
    parquet_index.save(new, str(tmp_path / "p"))
    again = rebuild(parquet_index.load(spark, str(tmp_path / "p")))
    assert sorted((r.term, r.df) for r in again.terms.collect()) == sorted((r.term, r.df) for r in new.terms.collect())
    with pytest.raises(json_index.StorageError, match="missing required key: 'terms'"):
        json_index.parse({"meta": {}, "documents": {}})
    with pytest.raises(json_index.StorageError, match=r"positions\[0\]. must be an integer"):
        json_index.parse({"meta": {}, "documents": {}, "terms": {"a": {"postings": {"d": {"positions": ["x"]}}}}})
    with pytest.raises(json_index.StorageError, match="not found"):
        json_index.load(spark, tmp_path / "none.json")


def test_places_in_sorted_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int").repartition(7)
    assert [(r.v, r.n) for r in numbered(rows.orderBy("v"), "n").orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(rows.limit(0).orderBy("v"), "n").count() == 0


def test_storage_takes_whole_numbers_only(spark, tmp_path):
    for bad in (3.7, True, "5", None, float("inf")):
        with pytest.raises(json_index.StorageError, match="meta.page_count' must be an integer"):
            json_index.parse({"meta": {"page_count": bad}, "documents": {}, "terms": {}})
    (tmp_path / "bad.json").write_bytes(b"\xff{")
    with pytest.raises(json_index.StorageError, match="not valid JSON"):
        json_index.load(spark, tmp_path / "bad.json")
    with pytest.raises(json_index.StorageError, match="is a directory"):
        json_index.load(spark, tmp_path)
    with pytest.raises(ValueError, match="already indexed"):
        index_texts(spark.createDataFrame([("a", "u", "x"), ("a", "v", "y")], "document_id string, url string, text string"), validate=True)


def test_stored_index_answers_as_the_one_in_memory(spark, tmp_path):
    a = corpus(spark, doc1="good friends make good times", doc2="the good end", doc3="friends of the good", doc4="none")
    parquet_index.save(a, str(tmp_path / "p"))
    b = parquet_index.load(spark, str(tmp_path / "p"))
    assert b.corpus.first() == a.corpus.first() == (4, 13)
    for query, options in (("good", {}), ("good friends", {"ranking_mode": "bm25"}), ('"the good"', {}), ("good friends", {"proximity_bonus": True})):
        assert find(b, query, **options).collect() == find(a, query, **options).collect()


def test_stream_of_crawls(spark, tmp_path):
    crawls = [[(0, "u1", "<p>good</p>"), (1, "u2", "<p>old</p>")], [(0, "u2", "<p>new</p>"), (1, "u1", "<p>good</p>"), (2, "u3", "<p>more</p>")]]
    for i, rows in enumerate(crawls):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        pages = spark.readStream.schema(PAGES).parquet(str(tmp_path / "in/*"))
        refresh_from_stream(pages, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination()
    got = parquet_index.load(spark, str(tmp_path / "index/v1"))
    assert {r.url: (r.document_id, r.text) for r in got.documents.collect()} == {"u1": ("doc1", "good"), "u2": ("doc2", "new"), "u3": ("doc3", "more")}
    assert {r.term for r in got.terms.collect()} == {"good", "new", "more"}


def test_benchmark_and_summary(spark):
    ticks = iter(range(1000))
    got = benchmark(corpus(spark, doc1="good friends", doc2="good"), 1, timer=lambda: float(next(ticks)))
    assert list(got.queries) == ["tfidf_and", "bm25_and", "phrase_query", "proximity_query"] and got.page_count == 2 and got.token_count == 3
    assert got.build_seconds == got.load_seconds == 1.0 and "- Unique terms: 2" in got.text() and "ratio (bm25/tfidf): 1.000x" in got.text()
    with pytest.raises(ValueError, match="positive integer"):
        mean_seconds(lambda: None, 0)
    text = BuildSummary(CrawlReport(5, 4, 3, 1), RefreshCounts(1, 2, 0), 7, 9, 1.5).text()
    assert text.startswith("Build complete.\nPages crawled: 3\n") and "Crawl success rate: 75.0%" in text and text.endswith("Duration: 1.50s")


SITE = {
    "http://h/": '<a href="/page/2/">2</a><a href="/page/2/#top">2</a><a href="http://other/">x</a><a href="mailto:a@b">m</a><a href="http://sub.h/">s</a>',
    "http://h/page/2/": '<a href="/">back</a><a href="/missing">m</a>', "http://sub.h/": "sub",
}


def test_crawls_agree(spark):
    assert internal_links(SITE["http://h/"], "http://h/", "h") == ["http://h/page/2/", "http://sub.h/"]
    rows, report = crawl_site("http://h/", "h", PoliteRequester(0, lambda u, **k: FetchResult(u, u in SITE, 200, SITE.get(u, ""))))
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    for most in (None, 0, 1, 2):
        rows, report = crawl_site("http://h/", "h", PoliteRequester(0, lambda u, **k: FetchResult(u, u in SITE, 200, SITE.get(u, ""))), most)
        found, got = crawl_table(pages, "http://h/", "h", most)
        assert [r.url for r in found.orderBy("page_order").collect()] == [r[1] for r in rows]
        assert got.pages_crawled == report.pages_crawled and (most is not None or got == report)


def test_politeness():
    times, slept = iter([0.0, 2.0, 3.0]), []
    p = PoliteRequester(6.0, lambda u: FetchResult(u, True, 200, ""), lambda: next(times), slept.append)
    p.fetch("a")
    p.fetch("b")
    assert slept == [4.0]


def test_shell(spark, tmp_path):
    shell = Shell(spark, "http://h/", "h", str(tmp_path / "i.json"), requester=PoliteRequester(0, lambda u, **k: FetchResult(u, u in SITE, 200, SITE.get(u, ""))), out=lambda m: None)
    with pytest.raises(ValueError, match="no index loaded"):
        shell.run("find x")
    assert "Pages crawled: 3" in shell.run("build")[0]
    assert shell.run("load")[0].startswith("Index loaded")
    assert "Word: back" in shell.run("print back")[0] and "Did you mean: back?" in shell.run("print bakk")[0]
    assert "Matches: 1" in shell.run("find --rank bm25 --snippets=on back")[0] and "[back]" in shell.run("find back --snippets on")[0]
    assert shell.run("exit") == ("Exiting search shell.", True)
    assert parse_runs(["--runs=3"]) == 3 and parse_find(["--rank=BM25", "a"]).ranking_mode == "bm25"
    for line in ("", "  "):
        with pytest.raises(ValueError, match="^Error: command cannot be empty$"):
            shell.run(line)
    said, lines = [], iter(["", "boom", "exit"])
    looped = Shell(spark, out=said.append)
    run = looped.run
    looped.run = lambda line: 1 / 0 if line == "boom" else run(line)
    looped.loop(lambda prompt: next(lines))
    assert said[2:] == ["Error: command cannot be empty", "Error: unexpected failure: division by zero", "Exiting search shell."]
    for bad in ("find", "find --rank", "find --rank x a", "benchmark --runs 0", "build now", "help me", "what"):
        with pytest.raises(ValueError, match="Error"):
            shell.run(bad)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
