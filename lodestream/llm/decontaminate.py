"""Benchmark decontamination with training suffix arrays (operator 6).

The documents are cut into shards of whole documents. Each shard gets a word-level suffix
array over the suffixes that can begin a test window (those whose first words all occur in the
test vocabulary), sorted to the depth of the longest window. Every test suffix is
binary-searched in every shard, all at once; the range found gives the verbatim matches and
their places, and matches are extended to their full length. Shards need no shuffle: one pass
over the documents, in any partitioning.

The test windows are sent to the executors in blocks of a fixed number of words; a larger test
set takes more passes, whose hits are united, one block in an executor's memory at a time.
Cases: a null text has no words, an empty one neither; an item without words has no window; the
windows of an item without item_id are hit like others, only its id is left out of the list;
repeated rows are judged alike; with no items nothing is contaminated; extra columns are
ignored. Matches never cross documents or items.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, table

WINDOW = 13
BLOCK_WORDS = 1_000_000  # of test items in one block
SHARD_CHARS = 8 << 20  # of documents in one suffix array

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, then runs of digits, letters and non-ASCII characters (in UTF-8 the
    bytes of the latter are those from 0x80 on)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


@dataclass
class TestBlock:
    """Windows of some test items: word numbers (1 and up, 0 pads), length and item of each."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: np.ndarray | None = None
    lengths: np.ndarray | None = None
    items: list[str | None] = field(default_factory=list)
    item_of: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> TestBlock:
        out, wins, lens, owner = cls(), [], [], []
        for item, text in rows:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            out.items.append(item)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                wins.append(ids[i: i + n] + [0] * (window - n))
                lens.append(n)
                owner.append(len(out.items) - 1)
        out.windows = np.array(wins, np.int32).reshape(-1, window)
        out.lengths = np.array(lens, np.int32)
        out.item_of = np.array(owner, np.int64)
        return out


def suffix_array(ids: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that begin with `least` non-zero words, sorted by their first
    `depth` words, and those words as rows. A zero ends a suffix."""
    n = len(ids)
    zero = np.flatnonzero(np.concatenate([ids == 0, [True]]))
    run = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
    pos = np.flatnonzero(run >= least)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    keys = padded[pos[:, None] + np.arange(depth)]
    keys[np.arange(depth) >= run[pos][:, None]] = 0
    order = np.lexsort(keys.T[::-1])
    return pos[order], keys[order]


def _bound(keys: np.ndarray, queries: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """For each query, how many rows of keys are below it (after: or begin with it)."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(keys), np.int64)
    mask = np.arange(keys.shape[1]) < lengths[:, None]
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        row = keys[np.minimum(mid, len(keys) - 1)]
        diff = np.where(mask, row.astype(np.int64) - queries, 0)
        at = (diff != 0).argmax(axis=1)
        sign = np.sign(diff[np.arange(len(diff)), at])
        below = (sign < 0) | (after & (sign == 0))
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def search(ids: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """(position, window number) of every occurrence of the block's windows."""
    none = np.zeros(0, np.int64)
    if not len(block.windows) or not len(ids):
        return none, none
    pos, keys = suffix_array(ids, int(block.lengths.min()), block.windows.shape[1])
    if not len(pos):
        return none, none
    lo = _bound(keys, block.windows, block.lengths, False)
    hi = _bound(keys, block.windows, block.lengths, True)
    count = hi - lo
    window = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return pos[at], window


def _shards(texts: list[str | None], vocabulary: dict[bytes, int]):
    """(first, number of words of each, starts, word numbers with a zero after each document)."""
    known = vocabulary.get
    for lo, hi in pieces([t or "" for t in texts], SHARD_CHARS):
        parts, sizes = [], []
        for t in texts[lo:hi]:
            w = words_of(t)
            sizes.append(len(w))
            parts.append(np.fromiter((known(x, 0) for x in w), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))
        sizes = np.array(sizes, np.int64)
        yield lo, sizes, np.cumsum(sizes + 1) - sizes - 1, np.concatenate(parts)


def maximal(block: TestBlock, pos: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, words, window number of the first window) of the longest verbatim matches:
    windows of an item that follow each other in a document are one match."""
    if not len(pos):
        return pos, pos, win
    order = np.lexsort((pos, pos - win, block.item_of[win]))
    pos, win = pos[order], win[order]
    item = block.item_of[win]
    first = np.ones(len(pos), bool)
    first[1:] = (item[1:] != item[:-1]) | (pos[1:] != pos[:-1] + 1) | (win[1:] != win[:-1] + 1)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(pos)))
    return pos[at], size - 1 + block.lengths[win[at]], win[at]


def _hits(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: TestBlock, pos: np.ndarray, win: np.ndarray):
    """Of each document: how many words any window covers, the longest match."""
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, pos, 1)
    np.add.at(covered, pos + block.lengths[win], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    at, length, _ = maximal(block, pos, win)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, np.searchsorted(starts, at, side="right") - 1, length)
    return hit[starts + sizes] - hit[starts], longest


def _matcher(block_var, detailed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: TestBlock = block_var.value
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = b.column(0).to_pylist()
            for first, sizes, starts, words in _shards(texts, block.vocabulary):
                pos, win = search(words, block)
                if detailed:
                    at, length, win = maximal(block, pos, win)
                    doc = np.searchsorted(starts, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[first + d] for d in doc.tolist()], pa.int64()), pa.array(at - starts[doc]),
                         pa.array([block.items[i] for i in block.item_of[win].tolist()], pa.string()), pa.array(length.astype(np.int64))],
                        ["doc_id", "start_word", "item_id", "n_words"])
                    continue
                n_hit, longest = _hits(words, starts, sizes, block, pos, win)
                doc = np.searchsorted(starts, pos, side="right") - 1
                pairs = np.unique(np.stack([doc, block.item_of[win]], axis=1), axis=0) if len(pos) else np.zeros((0, 2), np.int64)
                at = np.searchsorted(pairs[:, 0], np.arange(len(sizes) + 1))
                items = [[block.items[i] for i in pairs[at[k]: at[k + 1], 1] if block.items[i] is not None] for k in range(len(sizes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first: first + len(sizes)], pa.int64()), pa.array(sizes), pa.array(n_hit.astype(np.int64)),
                     pa.array(items, pa.list_(pa.string())), pa.array(longest)],
                    ["doc_id", "n_words", "n_hit", "items", "longest_match"],
                )

    return run


def _blocks(benchmark: DataFrame, window: int) -> Iterator[TestBlock]:
    """The test items in blocks of at most BLOCK_WORDS words (one item at least)."""
    rows, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(words_of(text))
        if rows and size + n > BLOCK_WORDS:
            yield TestBlock.of(rows, window)
            rows, size = [], 0
        rows.append((item, text))
        size += n
    yield TestBlock.of(rows, window)


def _passes(docs: DataFrame, blocks: Iterable[TestBlock], work, schema: str, label: str) -> DataFrame:
    """One pass over docs a block, each written out before the next block is sent, so that no
    executor holds more than one."""
    out = None
    for block in blocks:
        var = docs.sparkSession.sparkContext.broadcast(block)
        part = cut(docs.mapInArrow(work(var), schema), label)
        var.destroy()
        out = part if out is None else out.union(part)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start_word, item_id, n_words of the longest verbatim matches of at least one
    window: each as far as it goes in both texts."""
    return _passes(
        docs.select(F.col("doc_id").cast("long"), "text"), _blocks(benchmark, window), lambda var: _matcher(var, True),
        "doc_id long, start_word long, item_id string, n_words long", "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), longest_match of every row."""
    spark, blocks = docs.sparkSession, _blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _matcher(spark.sparkContext.broadcast(first), False), "doc_id long, n_words long, n_hit long, items array<string>, longest_match long",
        ).withColumn("items", F.array_sort(F.array_distinct("items")))
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return _united(keyed, chain((first, second), blocks)).drop("h")


def _united(keyed: DataFrame, blocks: Iterable[TestBlock]) -> DataFrame:
    """Several blocks: their matches are united for each row. Rows (doc_id, h, text) are told
    apart by doc_id and the text's hash (rows equal in both have equal results)."""
    hits = _passes(
        keyed.select(F.struct("doc_id", "h").alias("key"), "text"), blocks, _interval_rows, "doc_id long, h long, s long, e long, item string", "hits")
    merged = hits.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"),
        F.max(F.col("e") - F.col("s")).alias("longest"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(
        F.greatest(a["to"], x["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n")))["n"]
    sizes = keyed.mapInArrow(_word_counts, "doc_id long, h long, n_words long")
    m = merged.withColumn("n_hit", n_hit).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "items", "longest")
    return sizes.join(m, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left").select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest_match"))


def _word_counts(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(words_of(t.as_py())) for t in b.column(2)], pa.int64())], ["doc_id", "h", "n_words"])


def _interval_rows(block_var):
    def run(batches):
        block = block_var.value
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, _, starts, words in _shards(texts, block.vocabulary):
                at, length, win = maximal(block, *search(words, block))
                doc = np.searchsorted(starts, at, side="right") - 1
                own = [keys[first + d] for d in doc.tolist()]
                s = at - starts[doc] if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k["doc_id"] for k in own], pa.int64()), pa.array([k["h"] for k in own], pa.int64()), pa.array(s),
                     pa.array(s + length).cast(pa.int64()), pa.array([block.items[i] for i in block.item_of[win].tolist()], pa.string())],
                    ["doc_id", "h", "s", "e", "item"])

    return run


def judged(found: DataFrame) -> DataFrame:
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_match",
    )


def affected(n_hit, n_words, longest, window: int = WINDOW):
    """Whether a document goes: it holds a verbatim match of a whole window, however long it is,
    or its words are hit to a twentieth (which is all that shorter items can do)."""
    return (longest >= window) | ((n_hit > 0) & (20 * n_hit >= n_words))


def _keep_clean(block_var, at: int):
    def run(batches):
        block: TestBlock = block_var.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for first, sizes, starts, words in _shards(b.column(at).to_pylist(), block.vocabulary):
                n_hit, longest = _hits(words, starts, sizes, block, *search(words, block))
                keep[first: first + len(sizes)] = ~affected(n_hit, sizes, longest)
            yield b.filter(pa.array(keep))

    return run


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: affected documents go. One block of test windows decides where the text
    is, without a shuffle; several are searched one after the other and their matches united."""
    blocks = _blocks(table(spark, sf_dir, "benchmark"), WINDOW)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_keep_clean(spark.sparkContext.broadcast(first), docs.columns.index("text")), docs.schema)
    # the row travels as one struct, so none of its columns can clash with the stage's own
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    found = _united(rows.select("doc_id", "h", "text"), chain((first, second), blocks))
    gone = found.filter(affected(F.col("n_hit"), F.col("n_words"), F.col("longest_match"))).select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct()
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left_anti").select("__doc.*")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with i as (select row_number() over () as own, cast(item_id as varchar) as item, {_SQL_WORDS} as w from benchmark),
iw as (select own, item, q, least(13, len(w)) as n, w[q:q + least(13, len(w)) - 1] as win
       from (select own, item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as q from i where len(w) > 0)),
d as (select doc_id, {_SQL_WORDS} as w from documents),
dp as (select doc_id, w, unnest(generate_series(1, len(w))) as p from d),
m as (select doc_id, p, dw.n, item, own, q from (select doc_id, p, n, w[p:p + n - 1] as win from dp cross join (select distinct n from iw)) dw join iw on dw.n = iw.n and dw.win = iw.win),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(generate_series(p, p + n - 1)) as q from m) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id),
run as (select doc_id, n, p - row_number() over (partition by doc_id, own, p - q order by p) as island, own, p - q as diagonal from m),
lg as (select doc_id, max(words) as longest from (select doc_id, any_value(n) + count(*) - 1 as words from run group by doc_id, own, diagonal, island) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       cast(coalesce(longest, 0) as bigint) as longest_match
from d left join hit using (doc_id) left join it using (doc_id) left join lg using (doc_id)
"""
