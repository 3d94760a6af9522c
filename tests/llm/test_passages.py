"""Passages that are hard to link: repeated openings, differing ends, shared phrases."""

import time

import numpy as np

from lodestream.llm import passages as p


def shingles(words):
    text = " ".join(words).encode()
    return p._shingles(text, np.array([0, len(text)]))[0]


def made_up(n, seed):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n)]


def verified(a, b):
    found = list(p.similar_passages(shingles(a), shingles(b)))
    for s, e, t, u, j in found:
        x, y = set(shingles(a)[s:e].tolist()), set(shingles(b)[t:u].tolist())
        assert min(e - s, u - t) >= p.LEAST and j >= 0.8 and abs(j - len(x & y) / len(x | y)) < 1e-9
    return found


def test_repeated_opening_or_end():
    """Words of the passage that also stand earlier or later in the other text."""
    for n in (50, 60, 90):
        for k in (5, 15, 30, 45):
            shared = made_up(n, n + k)
            a = made_up(30, 1) + shared + made_up(30, 2)
            for part in (shared[:k], shared[-k:]):
                b = made_up(20, 3) + part + made_up(70, 4) + shared + made_up(20, 5) + part
                for x, y in ((a, b), (b, a)):
                    assert any(e - s >= n - 4 for s, e, _, _, _ in verified(x, y)), (n, k)
    same = ["word"] * 3000
    assert verified(same, same) and verified(made_up(60, 6) + same, same + made_up(60, 7))


def test_one_edit_anywhere_in_short_passages():
    """Passages from 50 words up, with a word changed, put in or left out at any place."""
    for n in range(50, 61, 2):
        for at in range(n):
            a = made_up(n, 100 * n + at)
            for b in (a[:at] + ["changed"] + a[at + 1:], a[:at] + ["changed"] + a[at:], a[:at] + a[at + 1:]):
                x, y = set(shingles(a).tolist()), set(shingles(b).tolist())
                if len(b) >= 50 and len(x & y) >= 0.8 * len(x | y):
                    assert verified(made_up(40, 1) + a + made_up(40, 2), made_up(70, 3) + b + made_up(30, 4)), (n, at)


def linked(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    found = p.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return {d: x.class_id for x in found for d in (x.doc_id, x.other_doc_id)}


PHRASE = 43


def around_phrases(edited, pairs=60):
    """Pairs of texts that share a passage of 50 to 53 words (edited: one word is changed in one)
    around a phrase of 43 words, which five other pairs and some shorter texts hold too."""
    r, texts, passages, short = np.random.default_rng(5), [], [], []
    for i in range(pairs):
        phrase = made_up(PHRASE, i // 6)
        n = 50 + i % 4 - PHRASE
        k = int(r.integers(0, n + 1))
        own = made_up(n, 50 + i)
        a = own[:k] + phrase + own[k:]
        b = list(a)
        if edited:
            b[int(r.choice([x for x in range(len(a)) if x < k or x >= k + PHRASE]))] = "changed"
        texts += [" ".join(made_up(50 + i, 1000 + 2 * i + s) + x + made_up(20, 3000 + 2 * i + s)) for s, x in enumerate((a, b))]
        passages.append((a, b))
        short.append(" ".join(made_up(5, 9000 + i) + phrase + made_up(5, 9500 + i)))
    return texts + short, passages


def test_shared_phrase_does_not_hide_a_passage(spark):
    texts, _ = around_phrases(False)
    assert linked(spark, texts) == {i: i - i % 2 for i in range(120)}


def test_phrase_and_a_changed_word_do_not_hide_a_passage(spark):
    """Linked whatever the representatives are: all pairs of a phrase's texts are looked at."""
    texts, passages = around_phrases(True)
    found = linked(spark, texts)
    for i, (a, b) in enumerate(passages):
        x, y = set(shingles(a).tolist()), set(shingles(b).tolist())
        if len(x & y) >= 0.8 * len(x | y):
            assert found.get(2 * i) == found.get(2 * i + 1) == 2 * i, i


def test_words_changed_in_the_middle_of_a_longer_passage():
    """No window of 50 words is similar, the whole passage is."""
    for n, gap in ((38, 4), (40, 4), (41, 5)):
        left, right = made_up(n, n), made_up(n, 100 + n)
        a, b = (made_up(30, s) + left + made_up(gap, s + 10) + right + made_up(30, s + 20) for s in (1, 2))
        assert verified(a, b) and verified(b, a)
    assert not verified(made_up(30, 1) + made_up(40, 5) + made_up(60, 2), made_up(30, 3) + made_up(40, 5) + made_up(60, 4))


def repeated_lines(lines, n, seed):
    r = np.random.default_rng(seed)
    return [w for i in r.integers(0, len(lines), n) for w in lines[i]]


def test_sums_of_kinds():
    x = np.random.default_rng(3).integers(0, 30, 200).astype(np.uint64)
    names = x * np.uint64(1000003)
    sums = p.sums_of_kinds(p._place_before(x), names, 46)
    assert sums.tolist() == [int(sum(set(names[i: i + 46].tolist()))) for i in range(155)]


def test_texts_of_repeated_lines_are_soon_compared():
    """Many equal runs and no similar passage: the windows between them are of few different sets."""
    shared = [made_up(7, i) for i in range(5)]
    a = shingles(repeated_lines([*shared, made_up(9, 10)], 150, 1))
    b = shingles(repeated_lines([*shared, made_up(6, 20), made_up(6, 21)], 40, 2))
    start = time.process_time()
    for _ in range(5):
        assert not list(p.spanning_passage(a, b, p.LEAST, 0.8, np.argsort(b, kind="stable")))
    assert time.process_time() - start < 3


def test_a_phrase_of_many_texts_does_not_pair_them_all(spark, monkeypatch):
    """80 texts quote a phrase of 30 words; of those, 10 pairs share an edited passage around it."""
    r, phrase, texts = np.random.default_rng(8), made_up(30, 1), []
    for i in range(80):
        texts.append(made_up(60, 100 + i) + phrase + made_up(60, 300 + i))
    for i in range(0, 20, 2):
        passage = made_up(15, 500 + i) + phrase + made_up(15, 600 + i)
        for k in (i, i + 1):
            texts[k] = made_up(40, 700 + k) + passage + made_up(40, 800 + k)
        texts[i][40 + int(r.integers(0, 10))] = "changed"
    for i in (20, 30):  # a text of two crowds, whose shingles are common ones and rare ones
        texts[i] = texts[i][:90] + made_up(40, 77) + texts[i][90:]
    counts, real = [], p.open_links

    def counted(*args):
        out = real(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(p, "open_links", counted)
    # minima link nothing, so more is left to the pairs
    monkeypatch.setattr(p, "candidate_links", lambda windows: windows.select("doc", windows["doc"].alias("other")).limit(0))
    found = linked(spark, [" ".join(t) for t in texts])
    for i in range(0, 20, 2):
        assert found[i] == found[i + 1] == i, i
    assert found[20] == found[30] == 20 and len(found) == 22
    assert counts[0] <= 200, counts


def test_bounds_of_common_shingles_against_brute_force():
    """Whatever windows are similar by common kinds alone are within the bounds of both texts."""
    least, hits = 5, 0
    for seed in range(400):
        r = np.random.default_rng(seed)
        base = r.integers(0, r.integers(6, 30), 16).astype(np.uint64)
        sides = []
        for side in (1, 2):
            x = base[r.integers(0, 4): 16 - r.integers(0, 4)].copy()
            edit = r.random(len(x)) < 0.15
            x[edit] = (r.integers(0, 3, int(edit.sum())) + 1000 * side).astype(np.uint64)  # rare kinds of its own, repeated ones too
            sides.append((x, x < 1000))
        (a, common_a), (b, common_b) = sides
        windows = [[(set(x[s:e].tolist())) for s in range(len(x)) for e in range(s + least, len(x) + 1)] for x, _ in sides]
        if not any(len(u & v) >= 0.8 * len(u | v) for u in windows[0] for v in windows[1]):
            continue
        hits += 1
        assert p.rare_share(a, common_a, least) + p.rare_share(b, common_b, least) <= p.RARE, seed
        assert p.gain(a, common_a, least) >= p.fewest_kinds(b, least), seed
        assert p.gain(b, common_b, least) >= p.fewest_kinds(a, least), seed
    assert hits > 50


def test_texts_without_repeats_are_compared_as_others():
    """The short ways for texts that repeat no shingle give what the ways for all texts give."""
    found = 0
    for seed in range(300):
        r = np.random.default_rng(seed)
        base = made_up(int(r.integers(55, 200)), seed)
        sides = []
        for side in (1, 2):
            lo, hi = r.integers(0, 30, 2)
            words = base[lo: len(base) - hi // 2]
            if seed % 3 == 0:
                cut = int(r.integers(0, len(words)))
                words = words[cut:] + words[:cut]
            words = [f"x{side}-{i}" if r.random() < r.choice([0.01, 0.02, 0.04]) else w for i, w in enumerate(words)]
            sides.append(shingles(made_up(20, 1000 * side + seed) + words))
        a, b = sides
        order = np.argsort(b, kind="stable")
        assert list(p.dense_passages(a, b, p.LEAST, 0.8, order, True)) == list(p.dense_passages(a, b, p.LEAST, 0.8, order))
        every = [list(p.dense_passages(a, b, p.LEAST, 0.8, order)), list(p.dense_passages(b, a, p.LEAST, 0.8, np.argsort(a, kind="stable"))),
                 list(p.spanning_passage(a, b, p.LEAST, 0.8, order))]
        assert any(every) == any(p.similar_passages(a, b))
        found += any(every)
    assert 50 < found < 300
