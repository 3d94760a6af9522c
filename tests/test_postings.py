"""Postings gathered a text at a time, against one token after the other."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestream.functions import postings
from lodestream.functions.text import TOKEN_PATTERN
from lodestream.operators.indexing import index_texts, postings_of_texts, rebuild
from lodestream.sources import parquet_index
from test_odd_tables import differing

DOCUMENTS = "doc_id bigint, text string"
TEXTS = ["", None, "-", "well-well known", "a--b 'c' d'-e -f- it's", "The the-THE\n\x00the é-x", "x" * 300 + " y-z" * 50]


def expected(text):
    out = defaultdict(list)
    for i, t in enumerate(re.findall(TOKEN_PATTERN, text)):
        for p in [t, *(t.split("-") if "-" in t else [])]:
            out[p].append(i)
    return dict(out)


def test_places_of_random_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1'- é\n") for _ in range(rng.randrange(90))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(400)]), pa.array([t.encode() for t in texts], pa.binary())], ["document_id", "text"])
    got = defaultdict(dict)
    for b in postings.chunks([batch], postings.gathered, 50):
        for r in b.to_pylist():
            assert r["tf"] == len(r["positions"]) and r["term"] not in got[int(r["document_id"])]
            got[int(r["document_id"])][r["term"]] = r["positions"]
    want = [expected(t) for t in texts]
    assert [got[i] for i in range(400)] == want
    got, df, cf = defaultdict(dict), Counter(), Counter()
    for b in postings.chunks([batch], postings.blocked, 50):
        for r in b.to_pylist():
            got[r["term"]].update(zip(r["documents"], r["positions"], strict=True))
    assert got == {t: {str(i): w[t] for i, w in enumerate(want) if t in w} for t in {t for w in want for t in w}}
    for b in postings.chunks([batch], postings.counted, 50):
        for r in b.to_pylist():
            df[r["term"]] += r["df"]
            cf[r["term"]] += r["cf"]
    assert df == {t: len(p) for t, p in got.items()} and cf == {t: sum(map(len, p.values())) for t, p in got.items()}


def stages(plan):
    return plan._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_postings_of_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "document_id string, text string")
    assert stages(postings_of_texts(docs)) == 0
    twice = docs.withColumn("document_id", F.lit("1"))
    assert len(postings_of_texts(twice).filter("term = 'the'").collect()) == 1


def test_queries_where_ids_repeat(spark, tmp_path):
    """One document's texts count together."""
    rows = [(i % 5, t) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("token_positions", "postings", "term_stats"):
        assert differing(spark, tmp_path, name) == [[], []], name


def test_queries_over_odd_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("token_positions", "postings", "term_stats", "stored_postings", "doc_length"):
        assert differing(spark, tmp_path, name) == [[], []], name


def test_token_positions_shuffle_a_row_a_document(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame(list(enumerate(TEXTS)), DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    plan = entry.queries()["token_positions"](spark, str(tmp_path))
    assert stages(plan) == 1 and "Expand" not in plan._jdf.queryExecution().executedPlan().toString()


def test_rebuild_keeps_postings_without_grouping_positions(spark):
    full = index_texts(spark.createDataFrame([("a", "u", "one two-three two"), ("b", "v", "two four")], "document_id string, url string, text string"))
    bare = full.documents.withColumn("text", F.when(F.col("document_id") == "a", F.col("text")).otherwise(""))
    again = rebuild(type(full)(bare, full.postings, full.terms, full.meta))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, full.postings.collect()))
    assert "Generate" not in again.postings._jdf.queryExecution().executedPlan().toString()


def test_index_is_stored_without_a_row_a_posting_shuffled(spark, tmp_path):
    """Sorted by term in each file, of which a term has few."""
    texts = [(str(i), f"u{i}", f"the w{i} w{i % 7} it's well-known") for i in range(300)]
    docs = spark.createDataFrame(texts, "document_id string, url string, text string")
    for name, rows in (("once", docs), ("twice", docs.withColumn("document_id", F.concat(F.lit("d"), F.col("document_id").cast("int") % 100)))):
        index = parquet_index.load(spark, parquet_index.build(rows, str(tmp_path / name)))
        full = index_texts(rows)
        for table in ("documents", "postings", "terms", "meta"):
            assert sorted(map(tuple, getattr(index, table).collect())) == sorted(map(tuple, getattr(full, table).collect())), table
    for file in (tmp_path / "once/postings").glob("*.parquet"):
        terms = pq.read_table(file)["term"].to_pylist()
        assert terms == sorted(terms)


def test_rebuilt_terms_leave_python_counted(spark):
    """Neither a row a token nor a row a posting of the texts; and the same where an id repeats."""
    full = index_texts(spark.createDataFrame([("a", "u", "one two-three two"), ("b", "v", "two four")], "document_id string, url string, text string"))
    again = rebuild(full)
    assert sorted(map(tuple, again.terms.collect())) == [("four", 1), ("one", 1), ("three", 1), ("two", 2), ("two-three", 1)]
    assert "cf" in again.terms._jdf.queryExecution().analyzed().toString()
    twice = full.documents.unionByName(full.documents.withColumn("text", F.lit("")))
    again = rebuild(type(full)(twice, full.postings, full.terms, full.meta))
    assert sorted(map(tuple, again.terms.collect())) == [("four", 1), ("one", 1), ("three", 1), ("two", 2), ("two-three", 1)]
