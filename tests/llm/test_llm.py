"""Training-data operators against brute force on small inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", " \t\n", "a", "A b", "word " * 300, words(3000, 1), "x" * 5000, "é ü 中文   ok", words(3000, 1)]


def test_quality_counts(spark):
    from lodestream.llm.quality_rules import quality_verdicts

    texts = [*ODD, "# a b\nb c\n\nb c\n \nb c", "a b c a b c x", "the the the the"]
    got = {r.doc_id: r for r in quality_verdicts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k for j, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in (j, j + 1, j + 2)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(hit)), i
        assert not (r.kept and r.base_failed)
    assert quality_verdicts(docs(spark, ["x"]).limit(0)).count() == 0


def test_simhash_links(spark):
    from lodestream.llm.simhash import fingerprint, fingerprint_components, keep_one

    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(40)} | {0}
    for f in list(fps)[:20]:
        for _ in range(4):
            g = f
            for b in r.sample(range(64), r.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {x.fp: x.component_id for x in fingerprint_components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[f] for _, f in rows] == label
    assert fingerprint(None) == 0 and fingerprint("A b") == fingerprint("a B")
    kept = keep_one(spark, docs(spark, [words(80, 1), words(80, 2), words(80, 1), None, ""]), "")
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 3]


def _brute_hits(text, items, window=13):
    """Words, words in any window of the items, ids of items hit, longest common run of words."""
    def cut_up(t):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    w, hit, ids, longest = cut_up(text), set(), set(), 0
    for item, t in items:
        x = cut_up(t)
        n = min(window, len(x))
        for i in range(len(w)):
            k = max((len(x) and next((k for k in range(min(len(w) - i, len(x) - j), -1, -1) if w[i: i + k] == x[j: j + k]), 0)) for j in range(len(x))) if x else 0
            if n and any(w[i: i + n] == x[j: j + n] for j in range(len(x) - n + 1)):
                hit |= set(range(i, i + n))
                ids |= {str(item)} if item is not None else set()
                longest = max(longest, k)
    return len(w), len(hit), sorted(ids), longest


def test_decontamination(spark, tmp_path, monkeypatch):
    from lodestream.llm import decontaminate as d

    a, b, c = words(30, 7), words(5, 8), words(20, 77)
    long = words(900, 31) + " " + " ".join(a.split()[5:19]) + " " + words(500, 32)
    texts = [*(t for t in ODD if len(t or "") < 2000), "zz " + a.upper() + " yy", b, " ".join(a.split()[:12]), " ".join(a.split()[:14]) + " q " + b, c, long,
             words(400, 33) + " " + b, b + " " + words(90, 35)]
    items = [(1, a), (2, b), (3, None), (4, "..."), (None, c), (5, a)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    brute = {i: _brute_hits(t, items) for i, t in enumerate(texts)}
    table = docs(spark, texts)

    def found():
        return {r.doc_id: (r.n_words, r.n_hit, list(r.items), r.longest_match) for r in d.contamination(table, bench).collect()}

    def kept():
        return {r.doc_id for r in d.keep_clean(spark, table, str(tmp_path)).collect()}

    clean = {i for i, (n, h, _, k) in brute.items() if not (k >= 13 or h and 20 * h >= n)}
    assert len(texts) - 3 not in clean and len(texts) - 2 in clean and len(texts) - 1 not in clean
    assert found() == brute and kept() == clean
    longest = {(r.doc_id, r.item_id, r.start_word): r.n_words for r in d.matches(table, bench).collect()}
    assert longest[texts.index("zz " + a.upper() + " yy"), "1", 1] == 30
    monkeypatch.setattr(d, "BLOCK_WORDS", 25)  # several blocks
    assert len(list(d._blocks(bench, 13))) == 3
    assert found() == brute and kept() == clean


def test_rules_are_fitted_as_by_a_plain_loop(spark):
    from lodestream.llm.quality_rules import Fit, fit_rules, posterior

    r = np.random.default_rng(1)
    for share in (0.3, 0.9):
        good = r.random(4000) < share
        votes = []
        for g in good:
            right = r.random(4) < (0.85, 0.7, 0.9, 0.8)
            votes.append("".join("-" if r.random() < 0.3 else "gb"[int(x != g)] for x in right))
        count = collections.Counter(votes)
        fit = fit_rules(spark.createDataFrame(sorted(count.items()), "votes string, n long"), 4)
        prior, acc = 0.8, np.full((2, 4), 0.9)
        keys = sorted(count)
        v, n = np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in k] for k in keys]), np.array([count[k] for k in keys], float)
        for _ in range(40):
            w = np.where(v == 1, np.log(acc[0] / (1 - acc[1])), np.where(v == -1, np.log((1 - acc[0]) / acc[1]), 0)).sum(1)
            p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + w)))
            prior = min(0.98, max(0.02, (n * p).sum() / n.sum()))
            for k, weight in enumerate((n * p, n * (1 - p))):
                acc[k] = np.clip((1.8 + (weight[:, None] * (v == (1, -1)[k])).sum(0)) / (2 + (weight[:, None] * (v != 0)).sum(0)), 0.6, 0.97)
        assert np.allclose([fit.prior, *fit.good, *fit.bad], [prior, *acc[0], *acc[1]], atol=1e-6)
        assert abs(fit.prior - share) < 0.06
        got = {x.votes: x.p for x in spark.createDataFrame([(k,) for k in keys], "votes string").select("votes", posterior(F.col("votes"), fit).alias("p")).collect()}
        assert np.mean([(got[k] >= 0.5) == g for k, g in zip(votes, good)]) > 0.9
    assert fit_rules(spark.createDataFrame([], "votes string, n long"), 2) == Fit(0.8, (0.9, 0.9), (0.9, 0.9))


def test_fingerprints_by_the_definition(spark):
    import xxhash
    from lodestream.llm.simhash import fingerprint, keep_one

    for t in [*ODD, "A  b\tC d É", "one two", "one two three", "x " * 70_000]:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        grams = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    a, b = words(80, 1), words(80, 2)
    rows = [(5, a), (5, b), (7, a), (None, b), (None, words(80, 3)), (9, words(80, 4)), (9, words(80, 4))]
    kept = keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([rows[0], rows[1], rows[4], rows[5]], key=repr)


def test_pii(spark):
    from lodestream.llm.pii import Bootstrap, op1_pii, redact  # noqa: F401
    from lodestream.llm import pii

    t = "mail a.b@c.d_e@f.gh 999.1.1.1 10.0.0.1 to 4111 1111 1111 1111 call +1 (555) 555-1234."
    df = pii.with_base_spans(docs(spark, [t, None, "x" * 20000 + "@", "1" * 5000]))
    spans = [[(x.k, x.s, x.e) for x in r["__p_base"]] for r in df.orderBy("doc_id").collect()]
    assert [(k, t[s:e]) for k, s, e in spans[0]] == [
        (0, "a.b@c.d"), (0, "_e@f.gh"), (1, "10.0.0.1"), (2, "4111 1111 1111 1111"), (3, "+1 (555) 555-1234")]
    assert spans[1:] == [[], [], []]
    ids = [f"badge B-{1000 + i} and text" for i in range(5)] + [f"badge 10.0.0.{i} here" for i in range(9)] + ["badge"]
    out = {r.doc_id: r.text for r in redact(spark, docs(spark, [*ids, None]), "").collect()}
    assert out[0] == "badge <ID> and text" and out[6] == "badge <IP> here" and out[14] == "badge" and out[15] is None


def test_pii_in_long_texts(spark):
    """Segments change nothing: base spans are those of the plain expressions on whole texts."""
    from lodestream.llm import pii

    r = random.Random(3)
    parts = ["a@b.co", "x.y", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.1", "999.1.1.1", ",", "\n", "é", "id", "AB-1234", "12", " ", "1", "-", "+", "word", "@"]
    texts = ["".join(r.choice(parts) + (" " if r.random() < 0.5 else "") for _ in range(n)) for n in (3000, 6000, 9000)]
    texts.append(" ".join(f"a{i}@b{i}.com" for i in range(5000)))

    def luhn(m):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(re.sub("[^0-9]", "", m)[::-1])) % 10 == 0

    def digits(m):
        return len(re.sub("[^0-9]", "", m))

    plain = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= digits(m) <= 19 and luhn(m)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= digits(m) <= 15),
    ]
    df = pii.with_base_spans(docs(spark, texts))
    for row in df.select("doc_id", "__p_base", F.size("__p_seg").alias("parts")).collect():
        t = texts[row.doc_id]
        assert row.parts > 1
        assert [tuple(x) for x in row["__p_base"]] == [(k, m.start(), m.end()) for k, (p, ok) in enumerate(plain) for m in re.finditer(p, t) if ok(m.group())]
    same = df.select("text", pii._redacted(F.col("__p_t"), F.col("__p_seg"), F.col("__p_base")).alias("new")).collect()
    assert all("a@b.co" not in x.new and x.new.count("<EMAIL>") >= 5 for x in same)


def test_packing_covers_every_id(spark):
    from lodestream.llm import packing as p

    texts = [*ODD, "A. b! c? D, e... 'tis İX ẘ <|startoftext|> W̊", *[words(400, i) + "." for i in range(40)]]
    tok = p._tokenizer(p.default_tokenizer())
    plain = tok.tokenizer
    expected = {i: [*plain.encode(t or "", add_special_tokens=False).ids, p.END] for i, t in enumerate(texts)}
    rows = p.pack(docs(spark, texts)).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    import zlib

    for r in rows:
        part = expected[r.doc_id][r.start: r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(expected[r.doc_id])
        by[r.doc_id].append((r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
    for spans, total in [*((v, len(expected[k])) for k, v in by.items()), *((v, None) for v in seq.values())]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == total if total else at <= p.LENGTH
    assert set(by) == set(expected)


def test_cuts_are_cheapest():
    from lodestream.llm.packing import choose_cuts, padding

    r = random.Random(3)
    for _ in range(30):
        x = np.cumsum([0, *[r.randint(1, 9) for _ in range(14)]])
        pen = np.array([0.0, *[r.choice([0.0, 2.0]) for _ in range(14)]])
        best = [0.0] + [1e9] * 14
        for j in range(1, 15):
            best[j] = min(best[i] + padding(int(x[j] - x[i]), 16) for i in range(j) if x[j] - x[i] <= 16) + pen[j]
        cuts = choose_cuts(x, pen, 16, final=True)
        at = {v: i for i, v in enumerate(x.tolist())}
        cost = sum(padding(b - a, 16) + pen[at[b]] for a, b in zip(cuts, cuts[1:]))
        assert cost == pytest.approx(best[-1])


def test_warc_round_trip(spark, tmp_path):
    from lodestream.llm import warc

    html = [None, "", "x" * 99, "x" * 99, "é" * 400, "é" * 400, "y" * 3_000_000, "é" * 400]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    rows = {}
    chunks = warc.read_archives(warc.write_archives(pages, folder), folder)
    for r in chunks.orderBy("page_id", "chunk").collect():
        rows.setdefault(r.page_id, []).append(r)
    for i, h in enumerate(html):
        last, data = rows[i][-1], b"".join(r.data for r in rows[i])
        assert last.digest == hashlib.sha256((h or "").encode()).hexdigest() and last.bytes_so_far == len((h or "").encode())
        assert last.refers_to == (4 if i in (5, 7) else None) and (last.refers_to is not None or data == (h or "").encode())
    assert len(rows[6]) == 3
    archives = spark.createDataFrame([(x.name,) for x in (tmp_path / "w").iterdir() if x.name.endswith(".warc.gz")], "archive string")
    bare = warc.read_archives(archives, folder, with_bytes=False).orderBy("page_id", "chunk").collect()
    assert [r.asDict() for r in bare] == [{**r.asDict(), "data": None} for i in sorted(rows) for r in rows[i]]


def test_repeated_strings(spark):
    from lodestream.llm import substrings as s

    v = s.PERIOD
    assert len({(a - b) % v for a in s.COVER for b in s.COVER if a != b}) == v - 1
    p, q = words(200, 11), words(90, 12)
    texts = [*ODD, p, "zz" + p[:700], p[:399], p[100:500] + q, q + p[101:501], "ab" * 900, q * 3, words(60, 5)]
    got = {r.doc_id: r for r in s.remove_repeats(docs(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i: i + 400] for t in raw for i in range(len(t) - 399))
    for i, t in enumerate(raw):
        gone = [False] * len(t)
        for k in range(len(t) - 399):
            if count[t[k: k + 400]] > 1:
                gone[k: k + 400] = [True] * 400
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i


def test_passages(spark):
    from lodestream.llm import passages as p

    r = np.random.default_rng(2)
    v = r.integers(1, 2**63, 500, dtype=np.uint64)
    assert sorted(c for _, c, _ in p.compact_windows(v)) == p.window_minima(v, np.ones(500 - p.LEAST + 1, bool)).tolist()
    shared = words(60, 21).split()
    near = shared.copy()
    near[30] = "changed"
    texts = [*ODD, f"{words(80, 22)} {' '.join(shared)} {words(50, 23)}", f"{words(40, 24)} {' '.join(shared).upper()}",
             f"{' '.join(near)} {words(70, 25)}", words(200, 26), " ".join(shared[:30]) + words(90, 27)]
    rows = p.near_passages(docs(spark, texts)).collect()
    n = len(ODD)
    cls = {x.doc_id: x.class_id for x in rows} | {x.other_doc_id: x.class_id for x in rows}
    assert cls == {6: 6, 9: 6, n: n, n + 1: n, n + 2: n}
    assert all(x.jaccard >= 0.8 for x in rows)


def test_edited_passages_are_linked(spark):
    """Passages with a word changed here and there, of similarity 0.8 or more."""
    from lodestream.llm import passages as p

    r, texts = random.Random(1), []
    for i in range(60):
        a = words(80 + i, 1000 + i).split()
        b = list(a)
        b[r.randrange(len(b))] = "changed"
        texts += [f"{words(r.randint(5, 99), 2000 + i)} {' '.join(x)} {words(r.randint(5, 99), 3000 + i)}" for x in (a, b)]
    cls = {}
    for x in p.near_passages(docs(spark, texts).repartition(4)).collect():
        cls[x.doc_id] = cls[x.other_doc_id] = x.class_id
    assert cls == {i: i - i % 2 for i in range(120)}


def test_scores_on_separable_labels(spark):
    from lodestream.llm import classifier, toxicity

    good = [words(120, i) for i in range(60)]
    bad = [words(60, i).upper().replace(" ", "!! ") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(120)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*good, *bad, None, ""])
    net = classifier.train(d, labels)
    s = {r.doc_id: r.score for r in classifier.quality(d, net).collect()}
    assert len(s) == 122 and sum((s[i] >= 0.5) == (i < 60) for i in range(120)) >= 110
    assert s[120] == s[121] and 0 <= s[120] <= 1
    mean = [words(50, i) + " you idiot. " + words(20, i) for i in range(60)]
    fair = [words(50, i) + " nothing here. " + words(20, i) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    d = docs(spark, [*mean, *fair, None])
    s = {r.doc_id: r.score for r in toxicity.toxicity(d, toxicity.train(d, labels)).collect()}
    assert all((s[i] >= 0.5) == (i < 60) for i in range(120)) and s[120] < 0.5
    m = toxicity.grammar()
    assert m.run(list("tiw")) == ["i@"] and m.run(list("nwi")) == ["i-"] and m.run(list("rwwi")) == ['i"']


def test_convolution_by_the_definition():
    from lodestream.llm.classifier import CHUNK, FILTERS, PAD, WIDTH, ByteNet, chunk_starts, chunks_of

    net = ByteNet.new(3)
    net.shift[0] = 0.2
    texts = [b"", b"abc", words(40, 1).encode(), words(900, 2).encode()]
    for t, score in zip(texts, net.score_many(texts)):
        seen = []
        for s in chunk_starts(len(t)).tolist():
            symbols = [*t[s: s + CHUNK], *[PAD] * (CHUNK - len(t[s: s + CHUNK]))]
            e = net.embed[symbols]
            seen.append([max(0.0, max(float(e[i: i + WIDTH].ravel() @ net.filters[:, f]) + net.bias[f] for i in range(CHUNK - WIDTH + 1))) for f in range(0, FILTERS, 7)])
        seen = np.array(seen)
        assert np.allclose(net.respond(chunks_of(t))[:, ::7], seen, atol=1e-4) and np.allclose(net.pooled(chunks_of(t))[0][:, ::7], seen, atol=1e-4)
        p = net.respond(chunks_of(t))
        assert abs(score - 1 / (1 + np.exp(-(np.concatenate([p.mean(0), p.max(0)]) @ net.out + 0.2)))) < 1e-5


def test_chunks_cover_all():
    from lodestream.llm.classifier import CHUNK, chunk_starts

    for n in (0, 1, CHUNK, CHUNK + 1, 5000):
        covered = np.zeros(n, bool)
        for s in chunk_starts(n):
            covered[s: s + CHUNK] = True
        assert covered.all()


def test_components_of_a_path_and_a_star(spark):
    from lodestream.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = docs(spark, [words(120, i) + ".\n" + words(50, i + 500) + "." for i in range(20)] + [words(120, 0), "short", None])
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        assert out.count() <= d.count()
    assert corpus_pipeline.STAGES[-1][1](spark, d.withColumn("votes", F.lit(1)), sf).count() >= 23
