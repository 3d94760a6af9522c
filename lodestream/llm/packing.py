"""Order-preserving packing by dynamic programming (operator 10).

The token stream of a partition, in the order of its rows, is cut into sequences of at most
4096 tokens. Possible cuts are the ends of documents and of sentences (and, in a stretch of
more than GAP tokens without one, every GAP tokens). The cuts chosen minimise padding plus
penalties for cutting inside documents and sentences. With c(j) the least cost of a stream
that ends at cut j,

    c(j) = penalty(j) + min over i of c(i) + padding(x(j) - x(i)),

where padding is 4096 minus the length, or nothing at a power of two. The first kind needs the
least c(i) + x(i) in a window that slides with j, which a monotone queue keeps in constant
amortised time; the second has at most 13 fixed distances. Each task packs its own rows in
buffers of BUFFER tokens and carries what is left of the last sequence; the end of a
partition's stream is cut into powers of two. There is no shuffle, and the result depends on
the rows of a partition only, so a task that is run again gives the same pieces.

Cases: a null or empty text is its end token alone; repeated rows are packed as often as they
occur; a document may be cut into any number of pieces; an empty table gives no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH = 4096
END = 2
GAP = 256
BUFFER = 1 << 18
SENTENCE_CUT = 8.0  # cost, in tokens of padding, of a cut inside a document
FORCED_CUT = 32.0  # of a cut inside a sentence
CACHE = 1_200_000  # words whose ids a worker remembers

_MARK = regex.compile(r"\p{M}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts, word by word with memory.

    The vocabulary drops white space and splits there, so a text's ids are those of its words
    one after the other; the ids of a word do not depend on its neighbours, and A-Z count as
    lower case. A full stop or comma that follows a letter is a token of its own. New words of
    letters alone are encoded many at a time: each ends with exactly one end-of-word token,
    which tells them apart. Texts with combining marks (whose composition may depend on case)
    are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}  # ids as little-endian unsigned 32-bit numbers
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.tails = {x.encode(): np.array(one(x), "<u4").tobytes() for x in (".", ",")}
        self.stops = np.array([i for x in (".", "!", "?") for i in one(x)], np.uint32)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode_each(self, words: list[bytes], texts: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = e.ids
            self.cache[w] = pack_ids(f"<{len(ids)}I", *ids)

    def _encode_together(self, words: list[bytes], texts: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._encode_each(words, texts)
            return
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist()):
            self.cache[w] = data[at:end]
            at = end

    def _learn(self, words: set[bytes]) -> None:
        tails, cache = self.tails, self.cache
        cores, tailed = set(), []
        for w in words:
            if w[-1:] in tails and w[:-1].isalpha():  # ASCII letters, then one mark
                tailed.append(w)
                cores.add(w[:-1])
            else:
                cores.add(w)
        letters, other = ([], []), ([], [])
        for c in cores:
            if c not in cache:
                t = c.decode("utf-8", "surrogatepass")
                to = letters if t.isalpha() else other
                to[0].append(c)
                to[1].append(t)
        for at in range(0, len(letters[0]), 1024):
            self._encode_together(letters[0][at: at + 1024], letters[1][at: at + 1024])
        if other[0]:
            self._encode_each(*other)
        for w in tailed:
            cache[w] = cache[w[:-1]] + tails[w[-1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split: list[list[bytes] | None] = []
        for t in texts:
            plain = t.isascii() or not _MARK.search(t)
            # a special token's own text is case sensitive and must stay as it is
            split.append(t.encode("utf-8", "surrogatepass").lower().split() if plain and "<|" not in t else None)
        cache = self.cache
        # every word is looked up once; only those not found, a second time
        known = [list(map(cache.get, words or ())) for words in split]
        missing = [[i for i, x in enumerate(ids) if x is None] for ids in known]
        new = {words[i] for words, at in zip(split, missing) for i in at}
        if len(cache) + len(new) > CACHE:
            cache.clear()
        if new:
            self._learn(new)
        out = []
        for t, words, ids, at in zip(texts, split, known, missing):
            if words is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
                continue
            for i in at:
                ids[i] = cache[words[i]]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def padding(n: int, length: int = LENGTH) -> int:
    return 0 if power_of_two(n) else length - n


def choose_cuts(x: np.ndarray, penalty: np.ndarray, length: int = LENGTH, final: bool = False) -> list[int]:
    """x: cut positions in ascending order, the first being the start (0), neighbours at most
    `length` apart. Returns the positions chosen, from 0 on; with final the last of x is among
    them, else the chain ends at the cheapest cut of the last window, and the rest is left for
    the next buffer."""
    n = len(x)
    xs, pen = x.tolist(), penalty.tolist()
    # pairs of cuts whose distance is a power of two
    jump: dict[int, list[int]] = {}
    k = 1
    while k < length:
        i = np.searchsorted(x, x - k)
        hit = np.flatnonzero((x >= k) & (x[np.minimum(i, n - 1)] == x - k))
        for j, a in zip(hit.tolist(), i[hit].tolist()):
            jump.setdefault(j, []).append(a)
        k *= 2
    cost, back = [0.0] * n, [-1] * n
    queue: deque[int] = deque([0])  # cuts in the window, c(i) + x(i) ascending
    key = [0.0] * n
    for j in range(1, n):
        xj = xs[j]
        while xs[queue[0]] < xj - length:
            queue.popleft()
        i = queue[0]
        best = key[i] + length - xj
        for a in jump.get(j, ()):
            if cost[a] < best:
                best, i = cost[a], a
        cost[j] = best + pen[j]
        back[j] = i
        kj = key[j] = cost[j] + xj
        while queue and key[queue[-1]] >= kj:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not final:
        last = int(np.searchsorted(x, x[-1] - length))
        if last > 0:
            # cost for each token so far decides between ends that differ in length
            j = min(range(last, n), key=lambda a: cost[a] + (xs[-1] - xs[a]) * cost[-1] / max(1, xs[-1]))
    out = []
    while j >= 0:
        out.append(xs[j])
        j = back[j]
    return out[::-1]


def cut_positions(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, from 0 to its length, and what each cut costs."""
    n = len(ids)
    sentence = np.flatnonzero(np.isin(ids, stops)) + 1
    x = np.union1d(np.concatenate([[0, n], ends]).astype(np.int64), sentence)
    wide = np.flatnonzero(np.diff(x) > gap)
    forced = np.concatenate([np.arange(x[i] + gap, x[i + 1], gap) for i in wide]) if len(wide) else np.zeros(0, np.int64)
    pen = np.where(np.isin(x, ends), 0.0, SENTENCE_CUT)
    x, order = np.unique(np.concatenate([x, forced]), return_index=True)
    pen = np.concatenate([pen, np.full(len(forced), FORCED_CUT)])[order]
    return x, pen


class _Packer:
    """Packs one partition's stream."""

    def __init__(self, stops: np.ndarray, base: int):
        self.stops, self.sequence = stops, base
        self.ids: list[np.ndarray] = []  # documents of the buffer, the first from `skip` on
        self.names: list[int | None] = []
        self.skip = self.size = 0
        self.rows: list[tuple] = []

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.names.append(name)
        self.size += len(ids)
        if self.size - self.skip >= BUFFER:
            self.flush(False)

    def flush(self, final: bool) -> None:
        if not self.ids:
            return
        stream = np.concatenate(self.ids)
        begin = np.cumsum([0, *map(len, self.ids)])
        live, ends = stream[self.skip:], begin[1:] - self.skip
        x, pen = cut_positions(live, ends, self.stops)
        cuts = choose_cuts(x, pen, final=final)
        if final:
            cuts = self._fine_end(cuts)
        for a, b in zip(cuts, cuts[1:]):
            self._emit(stream, begin, a + self.skip, b + self.skip)
        done = cuts[-1] + self.skip
        first = int(np.searchsorted(begin, done, side="right")) - 1
        if first >= len(self.ids):
            self.ids, self.names, self.skip, self.size = [], [], 0, 0
            return
        self.ids, self.names = self.ids[first:], self.names[first:]
        self.skip = done - int(begin[first])
        self.size = sum(map(len, self.ids))

    def _fine_end(self, cuts: list[int]) -> list[int]:
        """The last sequence of the stream, unless it is nearly full, becomes powers of two."""
        a, b = cuts[-2], cuts[-1]
        n = b - a
        if padding(n) <= FORCED_CUT * bin(n).count("1"):
            return cuts
        out = cuts[:-1]
        for k in range(n.bit_length() - 1, -1, -1):
            if n >> k & 1:
                out.append(out[-1] + (1 << k))
        return out

    def _emit(self, stream: np.ndarray, begin: np.ndarray, a: int, b: int) -> None:
        k = int(np.searchsorted(begin, a, side="right")) - 1
        at = a
        while at < b:
            to = min(b, int(begin[k + 1]))
            ids = stream[at:to]
            self.rows.append((
                self.names[k], at - int(begin[k]), to - at, zlib.crc32(ids.astype("<u4").tobytes()),
                int(begin[k + 1] - begin[k]), self.sequence, at - a,
            ))
            at, k = to, k + 1
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        packer = _Packer(tok.stops, TaskContext.get().partitionId() << 40)
        for b in batches:
            names = b.column(0).to_pylist()
            for lo in range(0, b.num_rows, 256):
                texts = [x.as_py() or "" for x in b.column(1)[lo: lo + 256]]
                for name, ids in zip(names[lo: lo + 256], tok.encode(texts)):
                    packer.add(name, np.append(ids, np.uint32(END)))
            if packer.rows:
                yield packer.take()
        packer.flush(True)
        yield packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece; sequences of different partitions have different ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pack(tokenizer or default_tokenizer()), ", ".join(f"`{n}` long" for n in _NAMES))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one."""
    return pack(docs)
