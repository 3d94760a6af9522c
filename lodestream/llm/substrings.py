"""Removal of repeated byte strings by a distributed difference cover (operator 3).

A byte is removed when a string of LENGTH (400) bytes that covers it also starts anywhere else,
in the same document or another one. With a perfect difference cover D of period v (every
difference modulo v occurs between members of D), any two positions p and q have a k < v with
p + k and q + k both among the sampled positions {i : i mod v in D}, wherever the documents
lie. So equal strings at p and q show as sampled suffixes that share what lies between k and
LENGTH, and only one position in 17 has to be compared first.

Names: the bytes of a block get a name, three names in a row get a name, and so on (3, 9, 27,
81, 243 bytes). Names are 64-bit hashes, which all executors derive alike, where the textbook
sorts to rank them: only the equality of prefixes is needed, not their order. Rounds:

1. sampled suffixes: which names (81 bytes) occur twice or more;
2. of those, which occur with their whole surroundings (all strings of LENGTH bytes whose
   offset to the sample is below v): all those strings are repeated, and long copies are done;
   and, for bins of offsets, which occur with all the bytes that the bin's strings share;
3. which repeated bins have a member that is not done: the bin's members, done or not, must be
   compared string by string;
4. the remaining suffixes: merged as (bytes up to the sample, name from the sample on), that
   is, by the 128-bit name of the whole string, for the positions of round 3 only.

Comparison sorts names within a bucket and looks at neighbours. Buckets are by hash, their
number follows the input. Each shard sends a name once however often it has it (and knows by
itself that it is repeated then), so a text that fills a third of the corpus sends one name a
shard. Only names travel; texts stay in shard files in the shared folder.

Cases: a null or empty text has no bytes; documents shorter than LENGTH lose nothing; repeated
rows are copies of each other; an empty table gives an empty result; extra columns are
ignored. A document is held whole by the task that works on it (about 60 bytes for each of its
bytes).
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, new_path, remove, table, tidy

LENGTH = 400
SHARD = 4 << 20
BUCKET = 16 << 20  # bytes of text for which there is one bucket


def difference_cover(q: int = 17) -> np.ndarray:
    """Singer's perfect difference set of q + 1 numbers modulo q*q + q + 1 (q prime, the
    modulus prime too): the powers of a generator of GF(q^3) that lie in a plane."""
    v = q * q + q + 1
    poly = next(
        (a, b, c) for a in range(q) for b in range(q) for c in range(1, q)
        if all((x**3 - a * x * x - b * x - c) % q for x in range(q))
    )  # x^3 = a x^2 + b x + c without a root is irreducible
    x, out = (1, 0, 0), []  # coefficients of 1, x, x^2
    for i in range(v):
        if x[2] == 0:
            out.append(i)
        lo, mid, hi = x
        x = (hi * poly[2] % q, (lo + hi * poly[1]) % q, (mid + hi * poly[0]) % q)
    return np.array(out)


COVER = difference_cover()
PERIOD = 307
SAMPLE_NAME = 81  # PERIOD - 1 + SAMPLE_NAME <= LENGTH
BLOCK = 243
BIN = 52
_NONE = np.zeros(0, np.uint64)
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[COVER] = True

_U = np.uint64
_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_M1, _M2, _M3, _M4 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(y: np.ndarray) -> np.ndarray:
    y ^= y >> _U(32)
    y *= _M4
    y ^= y >> _U(29)
    return y


def triple(a, b, c) -> np.ndarray:
    y = a * _M1
    y += b * _M2
    y ^= y >> _U(31)
    y *= _M4
    y += c * _M3
    return mix(y)


_STRIDE = 1 << 14  # positions named at a time, so that the work stays in the processor's cache


def names_at(data: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """Names of the blocks of `size` bytes (a power of three) at ascending positions. Stretches
    without a position are skipped."""
    out = np.empty(len(pos), np.uint64)
    i = 0
    while i < len(pos):
        at = int(pos[i])
        j = int(np.searchsorted(pos, at + _STRIDE))
        x, width = _BYTE[data[at: int(pos[j - 1]) + size]], 1
        while width < size:
            n = len(x) - 2 * width
            x = triple(x[:n], x[width: width + n], x[2 * width: 2 * width + n])
            width *= 3
        out[i:j] = x[pos[i:j] - at]
        i = j
    return out


def block_array(data: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Names of the blocks of BLOCK bytes by position, filled in around the positions needed."""
    n = len(data) - BLOCK + 1
    out = np.empty(max(n, 0), np.uint64)
    for k in np.flatnonzero(np.bincount(needed // _STRIDE)) if len(needed) else ():
        here = np.arange(k * _STRIDE, min((k + 1) * _STRIDE, n))
        if len(here):
            out[here] = names_at(data, here, BLOCK)
    return out


def _pair(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of what three overlapping blocks and the length say."""
    s = np.asarray(size).astype(np.uint64)
    return triple(a, b, c + s * _M1), triple(c ^ _M2, a + s * _M3, b)


# --- shard files -----------------------------------------------------------------------


class Store:
    """Files in the shared folder, each written once under a name of its own or, for a
    shard's state, again with the same content."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)

    def save(self, file: str, **arrays: np.ndarray) -> None:
        buf = io.BytesIO()
        np.savez(buf, **arrays)
        data = pa.compress(buf.getvalue(), "zstd", asbytes=True)
        self.fs.create_dir(f"{self.root}/{file}".rpartition("/")[0], recursive=True)
        part = f"{self.root}/{file}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part, compression=None) as f:
            f.write(len(buf.getvalue()).to_bytes(8, "little"))
            f.write(data)
        self.fs.move(part, f"{self.root}/{file}")

    def load(self, name: str) -> dict[str, np.ndarray]:
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
            size = int.from_bytes(f.read(8), "little")
            raw = pa.decompress(f.read(), size, "zstd", asbytes=True)
        with np.load(io.BytesIO(raw)) as z:
            return dict(z)


def write_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, ids, texts, size = Store(folder), [], [], 0
        store.fs.create_dir(store.root, recursive=True)

        def flush():
            nonlocal ids, texts, size
            name = uuid.uuid4().hex
            store.save(
                name, data=np.frombuffer(b"".join(texts), np.uint8), ends=np.cumsum([0, *map(len, texts)]),
                ids=np.array([0 if i is None else i for i in ids], np.int64), known=np.array([i is not None for i in ids]))
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["shard", "bytes"])
            ids, texts, size = [], [], 0
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > SHARD:
                    yield flush()
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield flush()

    return run


# --- what each round sends and learns -----------------------------------------------------


def once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each first is, and whether it occurs more than once."""
    u, first, count = np.unique(h, return_index=True, return_counts=True)
    return u, first, count > 1


def found_in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    at = np.searchsorted(sorted_set, h)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == h


def spread(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions in any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


class Shard:
    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        z = store.load(name)
        self.data, self.ends, self.ids, self.known = z["data"], z["ends"], z["ids"], z["known"]
        self.n = len(self.data)

    def bounds(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the documents that hold the positions."""
        k = np.searchsorted(self.ends, pos, side="right") - 1
        return self.ends[k], self.ends[k + 1]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions whose document has a string of LENGTH bytes around them, and names."""
        pos = np.flatnonzero(np.resize(_IN_COVER, self.n))
        lo, hi = self.bounds(pos)
        pos = pos[(hi - lo >= LENGTH) & (pos + SAMPLE_NAME <= hi)]
        return pos, names_at(self.data, pos, SAMPLE_NAME)

    def round1(self, _):
        _, names = self.samples()
        return np.unique(names), _NONE

    def round2(self, replies):
        pos, names = self.samples()
        u, _, multi = once(names)
        pos = pos[found_in(names, np.union1d(u[multi], replies.get(1, _NONE)))]
        lo, hi = self.bounds(pos)
        pos = pos[np.minimum(hi, pos + LENGTH) - np.maximum(lo, pos - PERIOD + 1) >= LENGTH]  # else no string around it fits
        a, b, bins = self._around(pos)
        tail = LENGTH - BIN + 1 - BLOCK
        blocks = block_array(self.data, np.concatenate(
            [a, np.minimum(a + BLOCK, b - BLOCK), b - BLOCK, *(y for x in bins for y in (x[3], x[3] + tail))]))
        at = blocks.take
        # one to three overlapping blocks cover all of the surroundings
        c1, c2 = _pair(at(a), at(np.minimum(a + BLOCK, b - BLOCK)), at(b - BLOCK), (b - a) * 1024 + (pos - a))
        name = np.concatenate([_pair(at(x), at(x + tail), np.zeros(len(x), np.uint64), least + 7)[0] for least, _, _, x in bins])
        self.store.save(f"alive/{self.name}", pos=pos.astype(np.int32), c1=c1, name=name)
        first, u = once(c1)[1], np.unique(name)
        return np.append(c1[first], u), np.append(c2[first], np.zeros(len(u), np.uint64))

    def _around(self, pos: np.ndarray):
        """Start and end of the surroundings of samples; and their bins. A bin holds the
        strings whose offset to the sample is in a range of BIN: they share LENGTH - BIN + 1
        bytes, which are the bin's name. Of each bin: its least offset, where its strings
        start (from, to), where the shared bytes start."""
        lo, hi = self.bounds(pos)
        a, b = np.maximum(lo, pos - PERIOD + 1), np.minimum(hi, pos + LENGTH)
        bins = []
        for least in range(0, PERIOD, BIN):
            s = np.maximum(a, pos - min(least + BIN, PERIOD) + 1)
            e = np.minimum(b - LENGTH, pos - least) + 1
            live = np.flatnonzero(s < e)
            bins.append((least, s[live], e[live], pos[live] - least))
        return a, b, bins

    def _state(self, replies):
        z = self.store.load(f"alive/{self.name}")
        a, b, bins = self._around(z["pos"].astype(np.int64))
        z["start"], z["end"] = np.concatenate([x[1] for x in bins]), np.concatenate([x[2] for x in bins])
        two = replies.get(2, _NONE)
        u, _, multi = once(z["c1"])
        done = found_in(z["c1"], np.union1d(u[multi], two))
        z["full"] = spread(self.n, a[done], b[done] - LENGTH + 1)
        u, _, multi = once(z["name"])
        twice = found_in(z["name"], np.union1d(u[multi], two))
        z |= {k: z[k][twice] for k in ("start", "end", "name")}
        undone = np.concatenate([[0], np.cumsum(~z["full"])])
        z["open"] = undone[z["end"]] > undone[z["start"]]
        return z

    def round3(self, replies):
        """Names of bins that occur twice, and which have a string not known to be repeated."""
        z = self._state(replies)
        self.store.save(
            f"open/{self.name}", full=np.packbits(z["full"]), start=z["start"].astype(np.int32), end=z["end"].astype(np.int32),
            name=z["name"], open=z["open"])
        u = np.unique(z["name"])
        return u, np.isin(u, z["name"][z["open"]]).astype(np.uint64)

    def round4(self, replies):
        z = self.store.load(f"open/{self.name}")
        todo = z["open"] | found_in(z["name"], replies.get(3, _NONE))
        p = np.flatnonzero(spread(self.n, z["start"][todo], z["end"][todo]))
        blocks = block_array(self.data, np.concatenate([p, p + LENGTH - BLOCK]))
        h1, h2 = blocks[p], blocks[p + LENGTH - BLOCK]
        w1, w2 = _pair(h1, h2, h1 ^ h2, LENGTH)
        self.store.save(f"{self.name}.strings", p=p.astype(np.int32), w1=w1)
        first = once(w1)[1]
        return w1[first], w2[first]

    def repeated(self, replies) -> np.ndarray:
        """Mask of the positions whose string also starts elsewhere."""
        out = np.unpackbits(self.store.load(f"open/{self.name}")["full"], count=self.n).astype(bool)
        s = self.store.load(f"{self.name}.strings")
        u, _, multi = once(s["w1"])
        out[s["p"][found_in(s["w1"], np.union1d(u[multi], replies.get(4, _NONE)))]] = True
        return out


def _results(shard: Shard, replies) -> pa.RecordBatch:
    start = np.flatnonzero(shard.repeated(replies))
    gone = spread(shard.n, start, start + LENGTH)
    rows = []
    for k in range(len(shard.ids)):
        a, b = int(shard.ends[k]), int(shard.ends[k + 1])
        g = gone[a:b]
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], g]).astype(np.int8)) == 1))
        kept = shard.data[a:b][~g].tobytes()
        rows.append((int(shard.ids[k]) if shard.known[k] else None, b - a, int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


# --- sending and comparing -----------------------------------------------------------------

MESSAGE = "bucket long, shard string, h1 binary, h2 binary"
REPLY = "shard string, round int, h1 binary"


def by_shard(folder: str, work, kind=None):
    """Rows (shard, round, h1) sorted by shard: round 0 names the shard, others are replies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        rows = ((s.as_py(), r.as_py(), h) for b in batches for s, r, h in zip(b.column(0), b.column(1), b.column(2)))
        for name, group in groupby(rows, key=lambda x: x[0]):
            replies: dict[int, list] = {}
            for _, r, h in group:
                if r:
                    replies.setdefault(r, []).append(np.frombuffer(h.as_py(), np.uint64))
            yield from work((kind or Shard)(store, name), {r: np.unique(np.concatenate(x)) for r, x in replies.items()})

    return run


def ask(number: int, buckets: int):
    def work(shard: Shard, replies) -> Iterator[pa.RecordBatch]:
        h1, h2 = getattr(shard, f"round{number}")(replies)
        if not len(h1):
            return
        if len(h2) != len(h1):
            h2 = np.zeros(len(h1), np.uint64)
        to = (h1 % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, h1, h2 = to[order], h1[order], h2[order]
        used, first = np.unique(to, return_index=True)
        last = np.append(first[1:], len(to))
        cols = [[x[a:b].tobytes() for a, b in zip(first, last)] for x in (h1, h2 if h2.any() else _NONE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([shard.name] * len(used)), *(pa.array(c, pa.binary()) for c in cols)],
            ["bucket", "shard", "h1", "h2"])

    return work


def compare(number: int):
    """Tells each shard which of its names other shards have too. In round 3, h2 says that a
    name has an open member; there the shards that have the name are told so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i] for c in b.columns) for b in batches for i in range(b.num_rows))
        for _, group in groupby(rows, key=lambda x: x[0].as_py()):
            names, h1, h2 = [], [], []
            for _, s, a, b in group:
                names.append(s.as_py())
                h1.append(np.frombuffer(a.as_py(), np.uint64))
                two = np.frombuffer(b.as_py(), np.uint64)
                h2.append(two if len(two) else np.zeros(len(h1[-1]), np.uint64))
            who = np.repeat(np.arange(len(names)), [len(x) for x in h1])
            a, b = np.concatenate(h1), np.concatenate(h2)
            order = np.lexsort((who, b, a)) if number != 3 else np.argsort(a, kind="stable")
            a, b, who = a[order], b[order], who[order]
            same = a[1:] == a[:-1]
            if number != 3:
                same &= b[1:] == b[:-1]
                hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            else:
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                open_ = np.maximum.reduceat(b, first) > 0
                hit = np.repeat(open_, np.diff(np.append(first, len(a))))
            a, who = a[hit], who[hit]
            order = np.argsort(who, kind="stable")
            a, who = a[order], who[order]
            used, first = np.unique(who, return_index=True)
            last = np.append(first[1:], len(who))
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[u] for u in used]), pa.array([number] * len(used), pa.int32()), pa.array([a[x:y].tobytes() for x, y in zip(first, last)], pa.binary())],
                    ["shard", "round", "h1"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    folder = new_path(spark, "shards")
    shards = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write_shards(folder), "shard string, bytes long"), "shard-list")
    row = shards.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    buckets, parts = max(12, row.bytes // BUCKET), max(1, min(row.n, 100_000))
    names = shards.select("shard", F.lit(0).alias("round"), F.lit(None).cast("binary").alias("h1"))
    known, reply = names, None

    def on_shards(work, schema: str) -> DataFrame:
        return known.repartition(parts, "shard").sortWithinPartitions("shard", "round").mapInArrow(by_shard(folder, work), schema)

    for number in (1, 2, 3, 4):
        sent = on_shards(ask(number, buckets), MESSAGE)
        replies = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare(number), REPLY)
        previous = reply
        reply = cut(replies, f"replies{number}")
        if previous is not None:
            drop(previous)
        known = names.union(reply)  # what earlier replies said is in the shards' state
        if number == 3:
            remove(spark, f"{folder}/alive")
        del sent, replies
        tidy(spark)
    return on_shards(lambda s, r: iter([_results(s, r)]), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
