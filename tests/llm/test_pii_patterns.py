"""Discovered identifiers in quotes and brackets, long ones and short ones."""

from lodestream.llm import pii


def test_enclosed_long_and_short_identifiers(spark):
    forms = ['badge "B-100{}"', "badge: [B-200{}]", "badge='B-300{}'", 'badge = "4{}' + "ab12" * 20 + '"', "badge 71{}3"]
    texts = [f.format(i) for f in forms for i in range(3)]
    seeds = [f'badge "10.0.0.{i}" here' for i in range(20)]
    other = [f'word "C-500{i}" here' for i in range(5)]
    rows = list(enumerate([*texts, *seeds, *other]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(spark, docs, "").collect()}
    assert [out[3 * i] for i in range(5)] == ['badge "<ID>"', "badge: [<ID>]", "badge='<ID>'", 'badge = "<ID>"', "badge <ID>"]
    assert all("<ID>" in out[i] for i in range(15)) and out[15] == 'badge "<IP>" here' and out[35] == other[0]


def test_scores_by_a_plain_graph(spark):
    """Confidences against the same rounds in plain Python over hand-listed patterns."""
    import math

    from pyspark.sql import functions as F

    seeds = [(f"key 10.0.0.{i}", f"10.0.0.{i}", 1) for i in range(5)]
    found = [(f"key K-700{i}", f"K-700{i}", 0) for i in range(5)]
    lent = [(f"code K-700{i}", f"K-700{i}", 0) for i in range(5)] + [("code Z-9000", "Z-9000", 0)]
    noise = [(f"page P-100{i}", f"P-100{i}", 0) for i in range(6)]
    plain = ["page"]
    docs = spark.createDataFrame(list(enumerate([t for t, _, _ in seeds + found + lent + noise] + plain)), "doc_id long, text string")
    how = pii.Bootstrap()
    rows = pii.with_candidates(pii.with_base_spans(docs)).select("__p_cand", "__p_seed")
    got = {r.p: r.confidence for r in pii.learn_patterns(docs, pii.cut(rows, "t"), how).collect()}
    edges = {}
    for t, m, s in seeds + found + lent + noise:
        edges.setdefault("w" + t.split()[0], []).append((m, s))
    total = {"wkey": 10, "wcode": 6, "wpage": 7}
    score, conf = {m: s for e in edges.values() for m, s in e}, {}
    for _ in range(how.rounds):
        conf = {p: min(1.0, sum(score[m] for m, _ in e) / total[p]) for p, e in edges.items() if sum(score[m] for m, _ in e) >= how.min_support}
        for m in score:
            if not any(s for e in edges.values() for x, s in e if x == m):
                score[m] = 1 - math.prod(1 - conf.get(p, 0) for p, e in edges.items() for x, _ in e if x == m)
    assert got == {p: __import__("pytest").approx(c, abs=1e-6) for p, c in conf.items() if c >= how.min_confidence} and set(got) == {"wkey", "wcode"}
    assert rows.select(F.explode("__p_cand").alias("x")).filter("x.m = 'Z-9000'").first().x.p[0] == "wcode"


def test_secret_shapes_are_seeds(spark):
    texts = [f'secret = "{"0a1b2c3d" * 4}{i:04x}ab" end' for i in range(4)] + ['secret = "short-77182" end', 'other "short-77183" end']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(spark, docs, "").collect()}
    assert [out[i] for i in range(5)] == ['secret = "<ID>" end'] * 5 and out[5] == texts[5]


def test_counts_do_not_depend_on_the_tables_of_bits(spark):
    """Whatever shares a bit with a wanted pattern passes, but no wanted occurrence is lost."""
    texts = ['key = "a" key = "b"', "The key, the KEY; (key)", "\U0001f511 key été key", "", None, "x " * 500 + "key end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([("wkey",), ("wx",), ("wthe",), ("lkey\u0001 = \"",), ("wabsent",)], "p string")

    def counts(bits):
        rows = pii.corpus_patterns(docs, wanted, bits).groupBy("p").count().join(wanted, "p").collect()
        return {r.p: r["count"] for r in rows}

    expected = {"wkey": 8, "wx": 500, "wthe": 2, 'lkey\u0001 = "': 2}
    assert counts(1 << 24) == counts(64) == expected
    empty = pii.corpus_patterns(docs, wanted.limit(0), 64)
    assert empty.count() == 0
