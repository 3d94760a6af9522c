"""The packing operator's tokenizer."""

import collections

from lodestream.llm import packing

TEXTS = ["The cat sat, the cat ran. A dog's 3.5 bones!", "", "THE CAT sat. café naïve café", "the <|endoftext|> cat", "a b  the\n\tcat, ran."]


class Counted(dict):
    """A cache that counts how often each word is looked up."""

    def __init__(self):
        self.seen = collections.Counter()

    def __contains__(self, w):
        self.seen[w] += 1
        return super().__contains__(w)

    def __getitem__(self, w):
        self.seen[w] += 1
        return super().__getitem__(w)

    def get(self, w):
        self.seen[w] += 1
        return super().get(w)


def test_known_words_are_looked_up_once():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    tok.encode(TEXTS)
    known, tok.cache = tok.cache, Counted()
    tok.cache.update(known)
    tok.encode(["the cat sat", "the cat"])
    assert tok.cache.seen == {b"the": 2, b"cat": 2, b"sat": 1}


def test_ids_with_and_without_memory(monkeypatch):
    tok = packing.WordTokenizer(packing.default_tokenizer())
    expected = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for _ in range(2):
        assert [x.tolist() for x in tok.encode(TEXTS)] == expected
    monkeypatch.setattr(packing, "CACHE", 4)  # the memory is emptied while some words of the texts are known
    for _ in range(2):
        assert [x.tolist() for x in tok.encode(TEXTS)] == expected
        assert [x.tolist() for x in tok.encode(TEXTS[:1] + ["unheard words, the cat."])] == [
            tok.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS[:1] + ["unheard words, the cat."]]
