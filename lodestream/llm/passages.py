"""Near-duplicate passages by compact windows (operator 9).

A document is the sequence of its five-word shingles. Under a hash function, the subsequences
of at least LEAST shingles that share one minimum form compact windows (l, c, r): all [i, j]
with l <= i <= c <= j <= r have the minimum at c. They are the nodes of the Cartesian tree over
the hashes that are wide enough, about 2n / LEAST of them. Two documents with a near-duplicate
passage have, under each of HASHES functions, windows of equal minimum with a chance equal to
the passages' similarity, and with certainty where the passage is the same.

Texts stay in shard files in the shared folder. Exact copies of whole texts are set aside first
and join their text's class in the end. Minima that only one window has are dropped in a round
that moves names alone. Windows of equal minimum that also agree on the CONTEXT shingles around
it are joined to a representative, the shortest document: within a shard first, where the links
are verified at once, and the shards' representatives to the shortest of theirs. These are
joined to the shortest document of all with that minimum. So a group of any size gives as many
links as it has members, and a group moves one row a shard. A link of the last kind is a
candidate when two hash functions have it. Candidates between shards are verified where the
linked document lies, to which the representative's text is sent once. Verified passages have at
least LEAST shingles each and a Jaccard similarity of at least SIMILARITY.

A representative that shares no more than a phrase with a document does not verify it, and the
document may share a passage with another one of the group. So the documents are also linked to
representatives by keys of CERTAIN equal shingles, which make a link by themselves, and of any
two of the four minima of LEAST shingles whose minima other windows have. A shard sends a key
once, with its shortest document.

These links are the quick way to most classes; the rest are looked for without chance. Two
passages of a link share a run of RUN equal shingles: each place where they part (words changed,
put in or left out) costs them at least four shingles of those that only one has, or as many
fewer as words repeat there, and those are at most a quarter of the common ones. So each shared
run of RUN shingles names all documents that have it (a sample of the run, the least name of its
parts of GRAM shingles, tells beforehand which runs can be shared), and once the classes of the
verified links are known, all pairs of a run's documents that are not of one class are verified
too.

Of a run that more than CROWD documents have (a phrase that many texts quote), not all pairs are
compared, but none that could verify is left out. The shingles that more than CROWD of these
crowded documents have are common ones, the others rare. Two passages of a link either have a
rare shingle in common, and each rare shingle names at most CROWD documents; or all they have in
common are common shingles, and then the rare kinds of each, as a share of its common kinds, are
together at most 1 / SIMILARITY - 1: as what they share is at least SIMILARITY of all, and neither's
rare kinds are the other's. The least such share of a text is bounded from below by its windows of
LEAST to 2 * LEAST - 1 shingles, which any longer passage is made of. For the same reason the common
kinds of each, divided by SIMILARITY, are at least its rare kinds and all kinds of the other.

The argument about runs fails for passages in which shingles themselves repeat or parts of which
stand in another order between the same four words; those are only found by the minima.

Rows: one for each verified passage of a link (doc_id, other_doc_id, their word ranges,
jaccard) and one for each copy of a text (jaccard 1, the whole text), with class_id, the
smallest doc_id reachable over links. Documents without a link have no row.

Cases: null and empty texts, and texts of fewer than LEAST shingles, have no windows (equal ones
count as copies only if they have LEAST shingles); rows without doc_id are left out; repeated
rows of one doc_id count once if their text is equal, and as parts of one document otherwise; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, pieces, remove, table, tidy, whole_text
from .components import connected_components
from .substrings import BUCKET, MESSAGE, REPLY, Shard, Store, ask, by_shard, compare, found_in, mix, once, triple, write_shards

SHINGLE = 5
LEAST = 46  # shingles, of 50 words
HASHES = 4
CONTEXT = 6  # shingles on either side of a minimum
RUN = 12  # shingles in a row that a linked pair has in common, at least (see above)
GRAM = 4  # shingles of a sample of a run
CERTAIN = 41  # equal shingles in a row that make a link
CROWD = 16  # documents of a run, or of a shingle, that are all compared with each other
SIMILARITY = 0.8
PIECE = 1 << 20  # bytes of texts hashed together
SPLIT = 32  # tasks that the copies of one text are dealt out to

_U = np.uint64
_R = np.random.default_rng(90210)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SEEDS = _R.integers(1, 2**63, HASHES, dtype=np.uint64)
_BASE = _U(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = _BYTE.copy()  # A-Z as a-z
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]
LONG = 64  # bytes of a word that are summed for all words at a time


def word_starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and where words start, in documents that lie one after the
    other (split at ASCII white space)."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = ends[(ends > 0) & (ends < len(data))]
    starts[edge] = inside[edge]
    return inside, np.flatnonzero(starts)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z in lower case), and the number of words before each document."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside, at = word_starts(data, ends)
    before = np.searchsorted(at, ends)
    if not len(at):
        return np.zeros(0, np.uint64), before
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = at[1:][inside[at[1:] - 1]]  # words that follow another one's last byte, in the next document
    last[begins - 1] = True
    size = np.flatnonzero(last) + 1 - at
    h = np.zeros(len(at), np.uint64)
    # byte k of every word that has one, longest words first; the few long words one by one
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    longer = np.cumsum(np.bincount(np.minimum(size, LONG + 1), minlength=LONG + 2)[::-1])[::-1]
    starts, sums, power = at[order], np.zeros(len(at), np.uint64), np.cumprod(np.full(LONG, _BASE, np.uint64))
    for k in range(LONG):
        n = int(longer[k + 1])
        if not n:
            break
        sums[:n] += _FOLDED[data[starts[:n] + k]] * power[k]
    h[order] = sums
    for i in np.flatnonzero(size > LONG).tolist():
        power = np.cumprod(np.full(int(size[i]), _BASE, np.uint64))
        h[i] = (_FOLDED[data[at[i]: at[i] + size[i]]] * power).sum()
    return mix(h + size.astype(np.uint64)), before


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, b, c, d, e = (words[i: i + n] for i in range(SHINGLE))
    return triple(triple(a, b, c), d, e)


def compact_windows(values: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(l, c, r), ends inclusive, of every Cartesian tree node at least `least` wide; of equal
    values the first is the minimum."""
    out, todo = [], [(0, len(values) - 1)] if len(values) >= least else []
    while todo:
        lo, hi = todo.pop()
        c = lo + int(values[lo: hi + 1].argmin())
        out.append((lo, c, hi))
        if c - lo >= least:
            todo.append((lo, c - 1))
        if hi - c >= least:
            todo.append((c + 1, hi))
    return out


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every run of `width` values."""
    n, w = len(x) - width + 1, 1
    while 2 * w <= width:
        x = best(x[:-w], x[w:])
        w *= 2
    return best(x[:n], x[width - w: width - w + n])


def run_names(x: np.ndarray, width: int) -> np.ndarray:
    """Names of all runs of `width` values."""
    n, y, w = len(x) - width + 1, x, 1
    while 2 * w <= width:
        y = triple(y[:-w], y[w:], np.full(1, w, np.uint64))
        w *= 2
    return triple(y[:n], y[width - w: width - w + n], np.full(1, width, np.uint64))


def window_minima(values: np.ndarray, valid: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Centres c of all compact windows of many documents at once: a tree node is `least` wide
    exactly if its value is the minimum of some run of `least` values. valid tells for every
    run's start whether the run lies in one document."""
    m = np.where(valid, _sliding(values, least, np.minimum), _U(0))
    padded = np.zeros(len(values) + least - 1, np.uint64)
    padded[least - 1: least - 1 + len(m)] = m
    # no run that holds c has a greater minimum than c's own value
    return np.flatnonzero((_sliding(padded, least, np.maximum) == values) & (values > 0))


AWAY = -1  # the round of a reply that names the rows set aside
CROWDED = -2  # that names the documents of crowded runs
COMMON = -3  # that names the common shingles


class PassageShard(Shard):
    """A shard's windows, by their centres."""

    def set_aside(self, replies) -> None:
        """Leave out the rows that are copies of another text."""
        keep = np.ones(len(self.ids), bool)
        keep[replies.get(AWAY, np.zeros(0, np.uint64)).byteswap().astype(np.int64)] = False
        if not keep.all():
            self.only(keep)

    def only(self, keep: np.ndarray) -> None:
        """Leave out the other rows."""
        size = np.diff(self.ends)
        self.data = self.data[np.repeat(keep, size)]
        self.ends, self.ids = np.cumsum([0, *size[keep]]), self.ids[keep]

    def windows(self):
        """Signature, (document, hash function, centre, words of the document), the shard's
        words and the number of words before each document."""
        words, before = word_hashes(self.data, self.ends)
        x = shingle_hashes(words)
        rows = np.zeros((0, 4), np.int64)
        if len(x) < LEAST:
            return np.zeros(0, np.uint64), rows, words, before
        doc = np.repeat(np.arange(len(self.ids)), np.diff(before))
        valid = doc[: len(x) - LEAST + 1] == doc[LEAST + SHINGLE - 2:]
        sig, rows = [], []
        for j in range(HASHES):
            v = mix(x ^ _SEEDS[j])
            c = window_minima(v, valid)
            k = doc[c]
            rows.append(np.stack([k, np.full(len(c), j), c, np.diff(before)[k]], axis=1))
            sig.append(v[c] ^ _U(j * 0x9E3779B9 + 1))
        return np.concatenate(sig), np.concatenate(rows), words, before

    def run_samples(self, words: np.ndarray, before: np.ndarray):
        """The shingles; for every run of RUN shingles its sample (the least of the names of its
        parts of GRAM shingles), whether it lies in one document and is not sampled as the run
        before it."""
        x = shingle_hashes(words)
        n = len(x) - RUN + 1
        if n <= 0:
            return x, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(before))
        valid = doc[:n] == doc[RUN + SHINGLE - 2:]
        m = _sliding(run_names(x, GRAM), RUN - GRAM + 1, np.minimum)
        new = valid & np.concatenate([[True], (m[1:] != m[:-1]) | ~valid[:-1]])
        return x, m, valid, new

    def run_keys(self, words: np.ndarray, before: np.ndarray, multi: np.ndarray):
        """Keys of the runs of RUN shingles whose samples are among those of multi, the documents
        they lie in and their samples; and the same of the runs of CERTAIN shingles made of them."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        x, m, valid, new = self.run_samples(words, before)
        at = np.flatnonzero(new)
        if not len(at):
            return none, none
        doc = np.repeat(np.arange(len(self.ids)), np.diff(before))
        known = np.repeat(found_in(m[at], multi), np.diff(np.append(at, len(m)))) & valid[at[0]:]
        known = np.concatenate([np.zeros(at[0], bool), known])
        places = np.flatnonzero(known)
        short = run_names(x, RUN)[places], doc[places], m[places]
        if len(x) < CERTAIN:
            return short, none
        n = len(x) - CERTAIN + 1
        places = np.flatnonzero(known[:n] & known[CERTAIN - RUN:] & (doc[:n] == doc[CERTAIN + SHINGLE - 2:]))
        return short, (run_names(x, CERTAIN)[places], doc[places], m[places])

    def window_keys(self, words: np.ndarray, before: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of two of the minima of the runs of LEAST shingles that are among the signatures of
        multi, the documents they lie in, and the minimum that each is dealt out by: that of a run's
        neighbours too, so that few buckets hear of the same two documents."""
        x = shingle_hashes(words)
        n = len(x) - LEAST + 1
        if n <= 0 or not len(multi):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(before))
        valid = doc[:n] == doc[LEAST + SHINGLE - 2:]
        least, new, known = [], [], []
        for j in range(HASHES):
            m = _sliding(mix(x ^ _SEEDS[j]), LEAST, np.minimum)
            new.append(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:n] != doc[: n - 1])]))
            at = np.flatnonzero(new[j])
            known.append(np.repeat(found_in(m[at] ^ _U(j * 0x9E3779B9 + 1), multi), np.diff(np.append(at, n))) & valid)
            # a minimum is first known where its first run in the document begins
            new[j][1:] |= valid[1:] & ~valid[:-1]
            least.append(m)
        keys, at, by = [], [], []
        for i, j in combinations(range(HASHES), 2):
            at.append(np.flatnonzero(known[i] & known[j] & (new[i] | new[j])))
            keys.append(triple(least[i][at[-1]], least[j][at[-1]], np.full(1, HASHES * i + j, np.uint64)))
            by.append(least[i][at[-1]])
        return np.concatenate(keys), doc[np.concatenate(at)], np.concatenate(by)

    def round1(self, replies):
        self.set_aside(replies)
        sig, _, words, before = self.windows()
        _, m, _, new = self.run_samples(words, before)
        return np.unique(np.concatenate([sig, m[new]])), np.zeros(0, np.uint64)


def _members(shard: PassageShard, replies) -> Iterator[pa.RecordBatch]:
    raw, ends = shard.data.tobytes(), shard.ends.tolist()
    n = np.diff(np.searchsorted(word_starts(shard.data, shard.ends)[1], shard.ends))
    h = [hashlib.md5(raw[a:b]).digest() for a, b in zip(ends, ends[1:])]
    yield pa.RecordBatch.from_arrays(
        [pa.array(shard.ids), pa.array(h, pa.binary()), pa.array(n.astype(np.int64)), pa.array([shard.name] * len(h), pa.string()),
         pa.array(np.arange(len(h), dtype=np.int64))], ["doc", "h", "n", "shard", "k"])


_PASSAGE = "doc_id long, other_doc_id long, start_word long, end_word long, other_start_word long, other_end_word long, jaccard double"
_NAMES = [x.split()[0] for x in _PASSAGE.split(", ")]
_WINDOW = "sig long, context long, j int, words long"
_KEYS = "bucket long, keys binary, who binary, runs binary, run_docs binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
_SHARED = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in f"{_WINDOW}, {_PASSAGE}, {_KEYS}".split(", ")])
_WHO = np.dtype([("words", "<i4"), ("doc", "<i8")])


def _row(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) if x.name in columns else pa.nulls(n, x.type) for x in _SHARED], schema=_SHARED)


def _shared_windows(buckets: int):
    return lambda shard, replies: _shared(shard, replies, buckets)


def _shared(shard: PassageShard, replies, buckets: int) -> Iterator[pa.RecordBatch]:
    """The verified passages of the shard's own links, one window (doc_id its document) for
    each shared minimum and context, and by bucket the keys of the shard's shared windows, each
    with its representative, and of its shared runs, with all documents that have them."""
    shard.set_aside(replies)
    sig, rows, words, before = shard.windows()
    if not len(sig):
        return
    _, m, _, new = shard.run_samples(words, before)
    u, _, multi = once(np.concatenate([sig, m[new]]))
    multi = np.union1d(u[multi], replies.get(1, np.zeros(0, np.uint64)))
    runs, certain = shard.run_keys(words, before, multi)
    yield from _runs_by_bucket(shard, runs, buckets)
    hit = found_in(sig, multi)
    sig, rows = sig[hit], rows[hit]
    k, c = rows[:, 0], rows[:, 2]
    # the words around the minimum, as far as the document goes
    lo = np.maximum(before[k], c - CONTEXT)
    hi = np.minimum(before[k + 1], c + CONTEXT + SHINGLE)
    context = np.zeros(len(sig), np.uint64)
    for i in range(2 * CONTEXT + SHINGLE):
        at = lo + i
        context = np.where(at < hi, triple(context, words[np.minimum(at, len(words) - 1)], context), context)
    order = np.lexsort((shard.ids[k], rows[:, 3], context, sig))
    sig, context, rows, k = sig[order], context[order], rows[order], k[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(sig), 1), bool), (sig[1:] != sig[:-1]) | (context[1:] != context[:-1])]))
    rep = np.repeat(k[first], np.diff(np.append(first, len(k))))
    # the same by the keys of whole windows
    size = np.diff(before)
    rank = np.empty(len(size), np.int64)
    rank[np.lexsort((shard.ids, size))] = np.arange(len(size))
    key, own, by = (np.concatenate(c) for c in zip(shard.window_keys(words, before, multi), certain))
    order = np.lexsort((rank[own], key))
    key, own, by = key[order], own[order], by[order]
    top = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own_rep = np.repeat(own[top], np.diff(np.append(top, len(key))))
    pairs = np.stack([np.concatenate([rep, own_rep]), np.concatenate([k, own])], axis=1)
    pairs = np.unique(pairs[shard.ids[pairs[:, 0]] != shard.ids[pairs[:, 1]]], axis=0)
    found, last = [], -1
    x = _by_document(shingle_hashes(words), before)
    kinds = _Kinds(x)
    for r, d in pairs.tolist():
        if r != last:
            last, by_hash = r, np.argsort(x[r], kind="stable")
        found += _passages(int(shard.ids[d]), x[d], int(shard.ids[r]), x[r], by_hash, (kinds[d], kinds[r]))
    if found:
        yield _row(len(found), **dict(zip(_NAMES, zip(*found))))
    if len(first):
        yield _row(
            len(first), sig=sig[first].view(np.int64), context=context[first].view(np.int64), j=rows[first, 1].astype(np.int32),
            words=rows[first, 3], doc_id=shard.ids[k[first]])
    key, own = key[top], own[top]
    to = (by[top] % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    key, own = key[order], own[order]
    who = np.empty(len(own), _WHO)
    who["words"], who["doc"] = size[own], shard.ids[own]
    used, start = np.unique(to[order], return_index=True)
    ends = list(zip(start.tolist(), np.append(start[1:], len(key)).tolist()))
    yield _row(len(used), bucket=used, keys=[key[a:b].tobytes() for a, b in ends], who=[who[a:b].tobytes() for a, b in ends])


def _runs_by_bucket(shard: PassageShard, runs, buckets: int) -> Iterator[pa.RecordBatch]:
    key, own, by = runs
    if not len(key):
        return
    order = np.lexsort((own, key))
    key, own, by = key[order], own[order], by[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    key, own, to = key[new], own[new], (by[new] % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    key, doc, to = key[order], shard.ids[own[order]].astype(np.int64), to[order]
    used, start = np.unique(to, return_index=True)
    ends = list(zip(start.tolist(), np.append(start[1:], len(key)).tolist()))
    yield _row(len(used), bucket=used, runs=[key[a:b].tobytes() for a, b in ends], run_docs=[doc[a:b].tobytes() for a, b in ends])


def _run_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, runs, run_docs) by bucket: (part, doc) of all documents that have a run in
    common; runs of the same documents give one group, named by a hash of them."""
    rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
    for _, group in groupby(rows, key=lambda x: x[0]):
        runs, docs = zip(*((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)) for _, a, b in group))
        key, doc = np.concatenate(runs), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        name = np.add.reduceat(mix(doc.view(np.uint64) * _BASE + _SEEDS[0]), first)
        _, kept = np.unique(np.where(size > 1, name, _U(0)), return_index=True)
        kept = kept[size[kept] > 1]
        member = np.zeros(len(first), bool)
        member[kept] = True
        member = np.repeat(member, size)
        part = np.repeat(name, size)[member].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(doc[member])], ["part", "doc"])


def open_links(groups: DataFrame, labels: DataFrame, tried: DataFrame, among) -> DataFrame:
    """(doc, other): all documents of a group that are not known to be of one class; of the groups
    of more than CROWD documents those pairs that among finds."""
    named = groups.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("part", "doc", F.coalesce("component", "doc").alias("class"))
    named = cut(named, "passage-named")
    mixed = named.groupBy("part").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"))
    mixed = mixed.filter("lo < hi").select(F.bitwise_not("part").alias("p"), "n")
    rows = named.withColumn("p", F.bitwise_not("part")).join(mixed, "p").select("p", "doc", "class", "n")
    rows = cut(rows, "passage-open")
    few = rows.filter(F.col("n") <= CROWD)
    pairs = few.alias("a").join(few.alias("b"), "p").filter("a.class < b.class")
    pairs = pairs.select(F.greatest("a.doc", "b.doc").alias("doc"), F.least("a.doc", "b.doc").alias("other"))
    pairs = pairs.union(among(rows.filter(F.col("n") > CROWD))).distinct()
    tried = tried.select(F.greatest("doc", "other").alias("doc"), F.least("doc", "other").alias("other")).distinct()
    return pairs.join(tried, ["doc", "other"], "left_anti")


def crowd_links(rows: DataFrame, place: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(doc, other): of rows (p, doc, class), the documents with a group in common that are not of
    one class and may have similar passages (see above). place has the documents' shards."""
    members = cut(rows.groupBy("doc").agg(F.first("class").alias("class"), F.collect_set("p").alias("parts")), "passage-crowd")
    docs = F.transform(F.collect_set("doc"), lambda d: F.lpad(F.hex(d), 16, "0"))
    known = members.join(place, "doc").groupBy("shard").agg(F.unhex(F.array_join(docs, "")).alias("h1"))
    known = cut(known.select("shard", F.lit(CROWDED).alias("round"), "h1"), "passage-crowded")

    def on_shards(work, schema: str) -> DataFrame:
        return known.repartition(buckets, "shard").sortWithinPartitions("shard", "round").mapInArrow(by_shard(folder, work, PassageShard), schema)

    sent = on_shards(_crowd_shingles(buckets), MESSAGE)
    told = cut(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_crowd_pairs, f"{REPLY}, doc long, other long"), "passage-rare")
    known = known.union(told.filter("h1 is not null").select("shard", "round", "h1"))
    bounds = on_shards(_bounds, "doc long, share double, gain double, fewest long")
    bounds = bounds.groupBy("doc").agg(F.min("share").alias("share"), F.max("gain").alias("gain"), F.min("fewest").alias("fewest"))

    def side(name: str) -> DataFrame:
        return members.select(*(F.col(c).alias(c if c == name else f"{name}_{c}") if c != "doc" else F.col(c).alias(name) for c in members.columns))

    rare = told.filter("h1 is null").select("doc", "other").distinct().join(side("doc"), "doc").join(side("other"), "other")
    rare = rare.filter("doc_class <> other_class").filter(F.arrays_overlap("doc_parts", "other_parts")).select("doc", "other")
    full = cut(rows.select("p", "doc", "class").join(bounds, "doc"), "passage-common")
    pairs = full.alias("a").join(full.alias("b"), "p").filter("a.class < b.class")
    pairs = pairs.filter(F.col("a.share") + F.col("b.share") <= RARE).filter("a.gain >= b.fewest and b.gain >= a.fewest")
    return rare.union(pairs.select(F.greatest("a.doc", "b.doc").alias("doc"), F.least("a.doc", "b.doc").alias("other")))


RARE = 1 / SIMILARITY - 1 + 1e-9


def _crowded(shard: PassageShard, replies) -> list[np.ndarray]:
    """Leaves the shard's crowded documents, and gives their shingles."""
    shard.only(np.isin(shard.ids, replies[CROWDED].byteswap().view(np.int64)))
    return _shingles(shard.data, shard.ends)


def _crowd_shingles(buckets: int):
    """The shingles of the shard's crowded documents by bucket, with the documents."""

    def work(shard: PassageShard, replies) -> Iterator[pa.RecordBatch]:
        kinds = [np.unique(x) for x in _crowded(shard, replies)]
        key, doc = np.concatenate(kinds), np.repeat(shard.ids, [len(x) for x in kinds])
        if not len(key):
            return
        to = (key % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, doc = key[order], doc[order]
        used, start = np.unique(to[order], return_index=True)
        ends = list(zip(start.tolist(), np.append(start[1:], len(key)).tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([shard.name] * len(used)), *(pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in (key, doc))],
            ["bucket", "shard", "h1", "h2"])

    return work


def _crowd_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MESSAGE by bucket: (doc, other) of the documents that have a rare shingle in common,
    and to each shard its common ones."""
    schema = pa.schema([("shard", pa.string()), ("round", pa.int32()), ("h1", pa.binary()), ("doc", pa.int64()), ("other", pa.int64())])
    rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
    for _, group in groupby(rows, key=lambda x: x[0]):
        shards, keys, docs = zip(*((s, np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)) for _, s, a, b in group))
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        common = key[first[size > CROWD]]
        rare = np.repeat((size > 1) & (size <= CROWD), size)
        key, doc = key[rare], doc[rare]
        pairs = [np.zeros((0, 2), np.int64)]
        for by in range(1, CROWD):
            same = key[by:] == key[:-by]
            pairs.append(np.unique(np.stack([doc[by:][same], doc[:-by][same]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        n = len(pairs)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, t) for t in schema.types[:3]), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
        told = [(s, x[found_in(x, common)].tobytes()) for s, x in zip(shards, keys)]
        told = [x for x in told if x[1]]
        n = len(told)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in told], pa.string()), pa.array([COMMON] * n, pa.int32()), pa.array([x for _, x in told], pa.binary()),
             pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)


def rare_share(x: np.ndarray, common: np.ndarray, least: int = LEAST) -> float:
    """A lower bound of the rare kinds of any window of `least` values or more, as a share of its
    common kinds: the least of the windows shorter than 2 * least, which longer ones are made of.
    A rare kind of the text counts as one in all, wherever its places are."""
    if len(x) < least or not common.any():
        return np.inf
    _, kind, count = np.unique(x, return_inverse=True, return_counts=True)
    rare = np.concatenate([[0], np.cumsum(np.where(common, 0, 1 / count[kind]))])
    places = np.concatenate([[0], np.cumsum(common)])
    widths = range(least, min(2 * least, len(x) + 1))
    # no window has more common kinds than places of them
    if not any((rare[w:] - rare[:-w] <= RARE * (places[w:] - places[:-w])).any() for w in widths):
        return np.inf
    before = _place_before(x)
    out = np.inf
    for w in widths:
        kinds = sums_of_kinds(before, common.astype(np.int64), w)
        some = kinds > 0
        if some.any():
            out = min(out, float(((rare[w:] - rare[:-w])[some] / kinds[some]).min()))
    return max(out, 0.0)


def gain(x: np.ndarray, common: np.ndarray, least: int = LEAST) -> float:
    """An upper bound of the common kinds, divided by SIMILARITY, less the rare kinds of any window
    of `least` values or more: no passage that all its shared kinds are common in is similar to
    one of more kinds."""
    _, kind, count = np.unique(x, return_inverse=True, return_counts=True)
    so_far = np.concatenate([[0], np.cumsum(np.where(common, 1 / SIMILARITY, -1 / count[kind]))])
    return float((so_far[least:] - np.minimum.accumulate(so_far[:-least])).max()) + 1e-6


def _bounds(shard: PassageShard, replies) -> Iterator[pa.RecordBatch]:
    """(doc, share, gain, fewest kinds of a window) of the shard's crowded documents that may have
    passages of common shingles."""
    if COMMON not in replies:
        return
    rows = []
    xs = _crowded(shard, replies)
    for doc, x in zip(shard.ids.tolist(), xs):
        common = found_in(x, replies[COMMON])
        if (share := rare_share(x, common)) <= RARE:
            rows.append((doc, share, gain(x, common), fewest_kinds(x, LEAST)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc", "share", "gain", "fewest"])


def _keyed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, who) by bucket: (doc, other) of the shards' representatives of a key
    and the shortest of them."""
    rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
    for _, group in groupby(rows, key=lambda x: x[0]):
        keys, who = zip(*((np.frombuffer(a, np.uint64), np.frombuffer(b, _WHO)) for _, a, b in group))
        key, who = np.concatenate(keys), np.concatenate(who)
        order = np.lexsort((who["doc"], who["words"], key))
        key, doc = key[order], who["doc"][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        other = np.repeat(doc[first], np.diff(np.append(first, len(key))))
        apart = doc != other
        pairs = np.unique(np.stack([doc[apart], other[apart]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc", "other"])


def candidate_links(windows: DataFrame) -> DataFrame:
    """(doc, other): the shards' representatives to the representatives of all shards."""
    own = F.struct("words", "doc")
    # a group by minimum and context has one row a shard; it is summed up first and joined by
    # another expression of its key, so that the join's sides are dealt out anew and can be split
    least = windows.groupBy("sig", "context").agg(F.min(own)["doc"].alias("other")).select(F.bitwise_not("sig").alias("s"), F.bitwise_not("context").alias("c"), "other")
    reps = windows.select("sig", "j", "words", "doc", F.bitwise_not("sig").alias("s"), F.bitwise_not("context").alias("c")).join(least, ["s", "c"]).drop("s", "c")
    reps = cut(reps, "passage-classes")
    first = reps.filter("doc <> other").select("doc", "other", F.lit(True).alias("sure"), F.lit(0).alias("by"))
    tight = reps.filter("doc = other").drop("other")
    loose = tight.groupBy("sig").agg(F.min(own).alias("top"), F.count("*").alias("n")).filter("n > 1").select(F.bitwise_not("sig").alias("s"), F.col("top.doc").alias("other"))
    second = tight.withColumn("s", F.bitwise_not("sig")).join(loose, "s").filter("doc <> other").select("doc", "other", F.lit(False).alias("sure"), F.expr("shiftleft(1, j)").alias("by"))
    votes = first.union(second).groupBy("doc", "other").agg(F.max("sure").alias("sure"), F.bit_or("by").alias("by"))
    return votes.filter(F.col("sure") | (F.bit_count("by") > 1)).select("doc", "other")


DRIFT = 8  # words by which inserted and left out words may shift a passage's parts
CHUNK = 256  # windows that are compared with the other text at a time
SPAN = 4
PLACES = 1 << 20  # pairs of places with the same shingle that are looked at together


def _place_before(x: np.ndarray) -> np.ndarray:
    """Where each value last stood before, or -1."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def _firsts(x: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values, which of them are the first of their kind in it."""
    before = _place_before(x)
    return np.lib.stride_tricks.sliding_window_view(before, width) < np.arange(len(x) - width + 1)[:, None]


def _edges(x: np.ndarray, width: int) -> np.ndarray:
    """Runs of `width` values that begin or end where the values change. Any other run lies
    between two of those and its kinds are among theirs or the same: where one value is
    repeated over and over, only these need be looked at."""
    change = np.concatenate([[True], x[1:] != x[:-1], [True]])
    return change[: len(x) - width + 1] | change[width:]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sums_of_kinds(before: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` places, the sum of `values` over the first places of its kinds."""
    at = np.arange(len(before))
    # the value at a place is the first of its kind in the runs that start after the one before
    change = np.zeros(len(before) + 1, values.dtype)
    np.add.at(change, np.maximum(np.maximum(before + 1, at - width + 1), 0), values)
    change[1:] -= values
    return np.cumsum(change)[: len(before) - width + 1]


def fewest_kinds(x: np.ndarray, width: int) -> int:
    """The least number of distinct values in a run of `width` values."""
    before = _place_before(x)
    return width if before.max() < 0 else int(sums_of_kinds(before, np.ones(len(x), np.int64), width).min())


def kinds_of(x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, int]:
    """The distinct values, and the least number of them in a run of `least`."""
    u = np.unique(x)
    if len(x) < least or len(u) == len(x):
        return u, least if len(x) >= least else 0
    return u, fewest_kinds(x, least)


def similar_passages(
        a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY, order: np.ndarray | None = None, kinds=None):
    """(start, end, start, end, jaccard) in shingles, ends exclusive, of passages of a that
    have a near-duplicate in b: those around windows of a, else of b, that are dense with the
    other's shingles, else the longest one between two equal runs. order sorts b; kinds: what
    kinds_of says of a and of b."""
    if len(a) < least or len(b) < least:
        return
    (in_a, fewest_a), (in_b, fewest_b) = kinds or (kinds_of(a, least), kinds_of(b, least))
    plain = len(in_a) == len(a) and len(in_b) == len(b)
    if len(in_a) > len(in_b):
        in_a, in_b = in_b, in_a
    # no pair of passages has fewer kinds of shingles than its poorest windows
    if np.count_nonzero(found_in(in_a, in_b)) < similarity * max(fewest_a, fewest_b):
        return
    if order is None:
        order = np.argsort(b, kind="stable")
    found = False
    for got in dense_passages(a, b, least, similarity, order, plain):
        found = True
        yield got
    if found:
        return
    order_a = np.argsort(a, kind="stable")
    if plain and not (0 < _room(a, b, order, least, similarity) and 0 < _room(b, a, order_a, least, similarity)):
        return
    for s, e, t, u, jaccard in dense_passages(b, a, least, similarity, order_a, plain):
        found = True
        yield t, u, s, e, jaccard
    if not found:
        yield from spanning_passage(a, b, least, similarity, order)


def _places(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """b in order, where in it each value of a is or would be, the same within bounds, and whether
    it is there."""
    ordered = b[order]
    left = np.searchsorted(ordered, a)
    at = np.where(left == len(b), 0, left)
    return ordered, left, at, ordered[at] == a


def _room(a: np.ndarray, b: np.ndarray, order: np.ndarray, least: int, similarity: float) -> float:
    """Above 0 unless no window of a can be similar to one of b, where no value is repeated in
    either: the values that a window has in common with b, divided by similarity, are at least
    its others and the `least` of b's."""
    common = _places(a, b, order)[3]
    so_far = np.concatenate([[0], np.cumsum(np.where(common, 1 / similarity, -1))])
    return float((so_far[least:] - np.minimum.accumulate(so_far[:-least])).max()) - least + 1e-6


def equal_runs(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, start, length) of all runs of values that are the same in a and b and cannot be
    made longer. order sorts b."""
    ordered = b[order]
    left, right = np.searchsorted(ordered, a), np.searchsorted(ordered, a, side="right")
    upto = np.concatenate([[0], np.cumsum(right - left)])
    starts, ends, lo = [], [], 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PLACES, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), right[lo:hi] - left[lo:hi])
        j = order[left[i] + np.arange(len(i)) - (upto[i] - upto[lo])]
        before = (i > 0) & (j > 0) & (a[i - 1] == b[j - 1])
        x, y = np.minimum(i + 1, len(a) - 1), np.minimum(j + 1, len(b) - 1)
        after = (x > i) & (y > j) & (a[x] == b[y])
        starts.append(np.stack([i[~before], j[~before]]))
        ends.append(np.stack([i[~after], j[~after]]))
        lo = hi
    (s, t), (e, u) = np.concatenate(starts, axis=1), np.concatenate(ends, axis=1)
    one, two = np.lexsort((s, t - s)), np.lexsort((e, u - e))
    s, t, size = s[one], t[one], e[two] - s[one] + 1
    by = np.lexsort((t, s))
    return s[by], t[by], size[by]


def spanning_passage(a: np.ndarray, b: np.ndarray, least: int, similarity: float, order: np.ndarray):
    """The longest passage of at most SPAN times the least length that begins with one equal run
    and ends with the same or another. Of a longer one, cut in two within an equal run, one part
    is at least as similar."""
    s, t, size = equal_runs(a, b, order)
    if not len(s):
        return
    # a set of kinds is told by the sum of their names
    sides = [(_place_before(x), found_in(x, np.unique(y)), mix(x ^ _SEEDS[0])) for x, y in ((a, b), (b, a))]
    reach = SPAN * least + int(size.max())

    def counts(side: int, start: np.ndarray, which: np.ndarray, hi: np.ndarray):
        """Kinds from start[which] to hi, the most of them that the other side can have once the
        passage is made `least` long, and the sum of their names."""
        before, common, name = sides[side]
        lo, which_lo = np.unique(start, return_inverse=True)
        place = lo[:, None] + np.arange(reach)
        over = place >= len(before)
        place[over] = 0
        new = (before[place] < lo[:, None]) & ~over
        at = which_lo[which], hi - start[which] - 1
        return (np.cumsum(new, axis=1)[at], np.cumsum(new & common[place], axis=1)[at] + np.maximum(0, least - (hi - start[which])),
                np.cumsum(np.where(new, name[place], _U(0)), axis=1)[at])

    rows, sums = [], []
    until = np.searchsorted(s, s + SPAN * least)
    # of starts that what follows is the same for, in both texts, one will do
    tail = np.arange(SPAN * least, dtype=np.uint64)
    follow_a, follow_b = (run_names(np.concatenate([x, tail]), len(tail) + 1) for x in (a, b))
    starts = np.sort(np.unique(triple(follow_a[s], follow_b[t], _U(1)), return_index=True)[1])
    upto = np.concatenate([[0], np.cumsum(until[starts] - starts + reach)])
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PLACES, side="right")) - 1)
        some = starts[begin:end]
        times = until[some] - some
        which = np.repeat(np.arange(len(some)), times)
        near = some[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        on = t[near] - t[some][which]
        close = (on >= 0) & (on <= SPAN * least)
        which, near = which[close], near[close]
        e, u = s[near] + size[near], t[near] + size[near]
        n, m = e - s[some][which], u - t[some][which]
        (x, in_b, kinds_a), (y, in_a, kinds_b) = counts(0, s[some], which, e), counts(1, t[some], which, u)
        both = np.minimum(in_a, in_b)
        # windows of the least length on both sides are what dense_passages compares
        fit = np.flatnonzero((both >= similarity * (x + y - both) - 1e-6) & (np.maximum(n, m) > least))
        # as many kinds from the same start are the same kinds
        same = triple(*(v[fit].astype(np.uint64) for v in (which, x, y)))
        same = triple(same, *(np.minimum(v[fit], least).astype(np.uint64) for v in (n, m)))
        fit = fit[np.unique(same, return_index=True)[1]]
        rows.append(np.stack([n + m, s[some][which], e, t[some][which], u])[:, fit])
        sums.append(np.stack([kinds_a, kinds_b, x, y, in_b, in_a]).astype(np.uint64)[:, fit])
        begin = end
    rows, sums = np.concatenate(rows, axis=1), np.concatenate(sums, axis=1)
    longest = np.lexsort(rows[::-1])[::-1]
    rows, sums = rows[:, longest], sums[:, longest]
    # the same of the windows of the least length
    least_a, least_b = (
        [sums_of_kinds(before, v.astype(np.uint64), least) for v in (name, np.ones(len(name)), common)] for before, common, name in sides)

    seen = set()
    for at in range(0, rows.shape[1], CHUNK):
        _, lo, hi, first, last = rows[:, at: at + CHUNK]
        short, other = np.maximum(0, least - (hi - lo)), np.maximum(0, least - (last - first))
        # where they are too short, they are widened on both sides alike, to the least length
        times = np.maximum(short, other) + 1
        i = np.repeat(np.arange(len(lo)), times)
        k = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        x, v = lo[i] - np.minimum(k, short[i]), first[i] - np.minimum(k, other[i])
        y, w = np.maximum(hi[i], x + least), np.maximum(last[i], v + least)
        inside = (x >= 0) & (v >= 0) & (y <= len(a)) & (w <= len(b))
        i, x, y, v, w = i[inside], x[inside], y[inside], v[inside], w[inside]
        (kinds_a, n, in_b), (kinds_b, m, in_a) = (
            [np.where(few[i] > 0, z[np.minimum(start, len(z) - 1)], own) for z, own in zip(windows, sums[side::2][:, at + i])]
            for side, (few, windows, start) in enumerate(((short, least_a, x), (other, least_b, v))))
        both = np.minimum(in_a, in_b).astype(np.int64)
        fit = both >= similarity * (n.astype(np.int64) + m.astype(np.int64) - both) - 1e-6
        sets, x, y, v, w = triple(kinds_a, kinds_b, _U(1))[fit], x[fit], y[fit], v[fit], w[fit]
        for j in np.sort(np.unique(sets, return_index=True)[1]).tolist():
            if (pair := int(sets[j])) in seen:
                continue
            seen.add(pair)
            if (jaccard := _jaccard(a[x[j]: y[j]], b[v[j]: w[j]])) >= similarity:
                yield int(x[j]), int(y[j]), int(v[j]), int(w[j]), jaccard
                return


def dense_passages(a: np.ndarray, b: np.ndarray, least: int, similarity: float, order: np.ndarray, plain: bool = False):
    """(start, end, start, end, jaccard) of passages of a around dense windows. A window of `least` shingles qualifies when enough of them
    occur in b; windows that overlap are one stretch. A stretch is matched along the diagonal
    that most of its shingles lie on; where that fails, each of its windows is compared with
    every window of b, by products of their incidence matrices. order sorts b; plain: no value is
    repeated in a, nor in b."""
    ordered, left, at, common = _places(a, b, order)
    need = int(np.ceil(least * 2 * similarity / (1 + similarity)))
    so_far = np.concatenate([[0], np.cumsum(common)])
    dense = so_far[least:] - so_far[:-least] >= need
    if not dense.any():
        return
    first = order[at]
    windows = np.lib.stride_tricks.sliding_window_view
    late: dict[str, np.ndarray] = {}  # made when a stretch needs them

    def alike(s: int, e: int, t: int, u: int):
        if e - s < least or u - t < least:
            return None
        if plain:
            both = int(np.count_nonzero(common[s:e] & (first[s:e] >= t) & (first[s:e] < u)))
            jaccard = both / (e - s + u - t - both)
        else:
            jaccard = _jaccard(a[s:e], b[t:u])
        return (s, e, t, u, jaccard) if jaccard >= similarity else None

    def commonest(s: int, e: int):
        """The whole stretch along the median diagonal of its shingles' first places."""
        idx = s + np.flatnonzero(common[s:e])
        shift = first[idx] - idx
        near = idx[np.abs(shift - int(np.median(shift))) <= max(DRIFT, (e - s) // 8)]
        if not len(near):
            return None
        x, y, t, u = int(near[0]), int(near[-1]) + 1, int(first[near].min()), int(first[near].max()) + 1
        # equal shingles at the ends whose first place in b is another one
        while x > s and t and a[x - 1] == b[t - 1]:
            x, t = x - 1, t - 1
        while y < e and u < len(b) and a[y] == b[u]:
            y, u = y + 1, u + 1
        return alike(x, y, t, u)

    def grown(got, s: int, e: int):
        """The passage with as much on either side as stays similar, within a[s:e]."""
        for side in (0, 1):
            step = least
            while step:
                x, y, t, u = got[:4]
                room = min(x - s, t) if side == 0 else min(e - y, len(b) - u)
                by = min(step, room)
                more = alike(x - by, y, t - by, u) if side == 0 else alike(x, y + by, t, u + by)
                if by and more:
                    got, step = more, 2 * step
                else:
                    step = min(step, by + 1) // 2
        return got

    def exhaustive(s: int, e: int):
        if not late:
            late["id"], late["place"] = np.searchsorted(ordered, b), np.where(common, at, -1)
            if plain:
                late["kinds_a"], late["kinds_b"] = (np.full(len(x) - least + 1, least) for x in (a, b))
                late["edge_a"], late["edge_b"] = (np.ones(len(x) - least + 1, bool) for x in (a, b))
            else:
                late["kinds_a"], late["firsts"] = _firsts(a, least).sum(axis=1), _firsts(b, least)
                late["kinds_b"] = late["firsts"].sum(axis=1)
                late["edge_a"], late["edge_b"] = _edges(a, least), _edges(b, least)
        covered = np.zeros(e - s, bool)
        todo = s + np.flatnonzero((dense & late["edge_a"])[s: e - least + 1])
        for lo in range(0, len(todo), CHUNK):
            w = todo[lo: lo + CHUNK]
            ids = np.unique(late["place"][w[0]: w[-1] + least])
            ids = ids[ids >= 0]
            column = np.full(len(b) + 1, len(ids))  # of the values that the chunk has, the last for all others
            column[ids] = np.arange(len(ids))
            col = column[late["id"]]
            if plain:
                hits = np.concatenate([[0], np.cumsum(col < len(ids))])
                inside = hits[least:] - hits[:-least]
            else:
                inside = (late["firsts"] & (windows(col, least) < len(ids))).sum(axis=1)
            t = np.flatnonzero((inside >= similarity * late["kinds_b"]) & late["edge_b"])
            if not len(t):
                continue
            x = np.zeros((len(w), len(ids) + 1), np.float32)
            x[np.arange(len(w))[:, None], column[windows(late["place"], least)[w]]] = 1
            y = np.zeros((len(t), len(ids) + 1), np.float32)
            y[np.arange(len(t))[:, None], windows(col, least)[t]] = 1
            both = x[:, :-1] @ y[:, :-1].T
            jaccard = both / (late["kinds_a"][w][:, None] + late["kinds_b"][t] - both)
            best = jaccard.argmax(axis=1)
            top = jaccard[np.arange(len(w)), best]
            ranked = np.argsort(-top, kind="stable")
            for i in ranked[top[ranked] >= similarity - 1e-6].tolist():
                k = int(w[i])
                if covered[k - s: k - s + least].sum() > least // 2:
                    continue
                got = alike(k, k + least, int(t[best[i]]), int(t[best[i]]) + least)
                if got:
                    got = grown(got, s, e)
                    covered[got[0] - s: got[1] - s] = True
                    yield got

    edge = np.diff(np.concatenate([[0], dense.astype(np.int8), [0]]))
    todo = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + least).tolist()))
    while todo:
        s, e = todo.pop()
        if got := commonest(s, e):
            yield got
            # what is left on either side may lie along other diagonals
            todo += [(x, y) for x, y in ((s, got[0]), (got[1], e)) if y - x >= least and dense[x: y - least + 1].any()]
        else:
            yield from exhaustive(s, e)


def _passages(doc: int, x: np.ndarray, other: int, y: np.ndarray, order: np.ndarray, kinds) -> list[tuple]:
    found = similar_passages(x, y, order=order, kinds=kinds)
    return [(doc, other, s, e + SHINGLE - 1, s2, e2 + SHINGLE - 1, j) for s, e, s2, e2, j in found]


class _Kinds(dict):
    """What kinds_of says of each of the texts, when first asked for."""

    def __init__(self, texts: list[np.ndarray]):
        self.texts = texts

    def __missing__(self, k: int):
        self[k] = kinds_of(self.texts[k])
        return self[k]


_TEXTS = "shard string, other long, text binary, docs array<long>"


def _fetch(folder: str):
    """Rows (home, shard, other, docs) by home, the shard of `other`: adds its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = Store(folder), None
        for b in batches:
            for home, shard, other, docs in zip(*(c.to_pylist() for c in b.columns)):
                if home != name:
                    name, own = home, Shard(store, home)
                    places: dict[int, list[int]] = {}
                    for k, i in enumerate(own.ids.tolist()):
                        places.setdefault(i, []).append(k)
                for k in places[other]:
                    text = own.data[own.ends[k]: own.ends[k + 1]].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard]), pa.array([other]), pa.array([text], pa.binary()), pa.array([docs], pa.list_(pa.int64()))],
                        ["shard", "other", "text", "docs"])

    return run


def _verify(folder: str):
    """Rows of _TEXTS by shard: the representative's text against those of the shard's
    documents that are linked to it, which are read from the shard's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = Store(folder), None
        for b in batches:
            rows = []
            shards, others, texts, docs = (c.to_pylist() for c in b.columns)
            for start, end in pieces(texts, PIECE):
                ys = _shingles(b"".join(texts[start:end]), np.cumsum([0, *map(len, texts[start:end])]))
                for i, y in zip(range(start, end), ys):
                    if shards[i] != name:
                        name, own = shards[i], PassageShard(store, shards[i])
                        xs = _shingles(own.data, own.ends)
                        kinds = _Kinds(xs)
                        places: dict[int, list[int]] = {}
                        for k, doc in enumerate(own.ids.tolist()):
                            places.setdefault(doc, []).append(k)
                    order, kinds_y = np.argsort(y, kind="stable"), kinds_of(y)
                    for doc in docs[i]:
                        for k in places[doc]:
                            rows += _passages(doc, xs[k], others[i], y, order, (kinds[k], kinds_y))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], _NAMES)

    return run


def _by_document(x: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The shingles that lie in one document, of each; before counts words."""
    return [x[a: max(a, b - SHINGLE + 1)] for a, b in zip(before.tolist(), before[1:].tolist())]


def _shingles(data, ends: np.ndarray) -> list[np.ndarray]:
    """Shingle hashes of each of the documents that lie one after the other."""
    words, before = word_hashes(np.frombuffer(data, np.uint8), ends)
    return _by_document(shingle_hashes(words), before)


def near_passages(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).filter("doc_id is not null")
    # a text of so many words has as many characters and as many gaps
    rows = rows.filter(F.octet_length("text") >= 2 * (LEAST + SHINGLE - 1) - 1)
    folder = new_path(spark, "passages")
    shards = cut(rows.mapInArrow(write_shards(folder), "shard string, bytes long"), "passage-shards")
    row = shards.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    buckets, parts = max(12, row.bytes // BUCKET), max(1, min(row.n, 100_000))
    known = shards.select("shard", F.lit(0).alias("round"), F.lit(None).cast("binary").alias("h1"))

    def on_shards(work, schema: str) -> DataFrame:
        return known.repartition(parts, "shard").sortWithinPartitions("shard", "round").mapInArrow(by_shard(folder, work, PassageShard), schema)

    members = cut(on_shards(_members, "doc long, h binary, n long, shard string, k long"), "passage-members")
    first = members.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    # a text with very many copies is dealt out to SPLIT tasks; first has repeated texts only
    split = members.withColumn("part", F.pmod(F.xxhash64("shard", "k"), F.lit(SPLIT)).cast("int"))
    first = first.select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("part"))
    copies = cut(split.join(first, ["h", "part"]).filter("doc <> first").select("doc", "first", "n", "shard", "k"), "passage-copies")
    # row numbers as 64-bit words; a shard has a bounded number of rows
    away = copies.groupBy("shard").agg(F.unhex(F.array_join(F.transform(F.collect_list("k"), lambda k: F.lpad(F.hex(k), 16, "0")), "")).alias("h1"))
    known = known.union(cut(away.select("shard", F.lit(AWAY).alias("round"), "h1"), "passage-away"))

    sent = on_shards(ask(1, buckets), MESSAGE)
    known = known.union(cut(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare(1), REPLY), "passage-replies"))
    del sent
    tidy(spark)
    shared = cut(on_shards(_shared_windows(buckets), f"{_WINDOW}, {_PASSAGE}, {_KEYS}"), "passage-windows")
    keys = shared.filter("keys is not null").select("bucket", "keys", "who")
    keyed = keys.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_keyed_links, "doc long, other long")
    links = candidate_links(shared.filter("sig is not null").select("sig", "context", "j", "words", F.col("doc_id").alias("doc")))
    links = cut(links.union(keyed).distinct(), "passage-links")
    runs = shared.filter("runs is not null").select("bucket", "runs", "run_docs")
    groups = cut(runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_run_groups, "part long, doc long").distinct(), "passage-groups")
    del keys, keyed, runs
    tidy(spark)
    place = members.select("doc", "shard").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(place, "doc").groupBy("shard", "other").agg(F.collect_set("doc").alias("docs"))
        asked = cut(asked.join(place.select(F.col("doc").alias("other"), F.col("shard").alias("home")), "other").select("home", "shard", "other", "docs"), "passage-asked")
        # by ranges, so that many tasks share a representative that many shards ask for
        texts = asked.repartitionByRange(parts, "home", "shard").sortWithinPartitions("home").mapInArrow(_fetch(folder), _TEXTS)
        return cut(texts.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_verify(folder), _PASSAGE), "passages")

    verified = verify(links)
    tidy(spark)
    whole = copies.filter(F.col("n") >= LEAST + SHINGLE - 1).select("doc", "first", "n").distinct().select(
        F.col("doc").alias("doc_id"), F.col("first").alias("other_doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"),
        F.lit(0).cast("long").alias("other_start_word"), F.col("n").alias("other_end_word"), F.lit(1.0).alias("jaccard"))
    found = shared.filter("jaccard is not null").select(*_NAMES).union(verified)
    # copies have no windows, so their links cannot bring two groups' members together
    labels = connected_components(found.select(F.col("doc_id").alias("u"), F.col("other_doc_id").alias("v")))
    late = verify(open_links(groups, labels, links, lambda rows: crowd_links(rows, place, folder, buckets)))
    remove(spark, folder)
    tidy(spark)
    found = found.union(late).union(whole)
    edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    for more in (late, whole):
        edges = edges.union(more.select(F.col("doc_id").alias("u"), F.col("other_doc_id").alias("v")))
    labels = connected_components(edges)
    return found.join(labels, found.doc_id == labels.node).select(*_NAMES, F.col("component").alias("class_id"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(table(spark, sf_dir, "documents"))
