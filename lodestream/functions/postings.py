"""Postings of texts, gathered a text at a time, so that tokens are not shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTINGS = "term string, document_id string, tf int, positions array<int>"
#: Tokens gathered at once, for postings and for blocks or counts; a longer text is gathered by itself.
CHUNK, BLOCK_CHUNK = 300_000, 1_000_000
BLOCKS = "term string, documents array<string>, positions array<array<int>>"
COUNTS = "term string, df bigint, cf bigint"

_IN_TOKENS = b"abcdefghijklmnopqrstuvwxyz0123456789'-"
_BLANKED = bytes(c if c in _IN_TOKENS else 32 for c in range(256))
#: An apostrophe or hyphen without a letter or digit on both sides.
_LOOSE = re.compile(rb"['-](?:(?![a-z0-9])|(?<![a-z0-9]['-]))")


def split_tokens(text: bytes) -> list[bytes]:
    """Matches of TOKEN_PATTERN in a text in lower case."""
    return _LOOSE.sub(b" ", text.translate(_BLANKED)).split()


def _parts(numbers: dict[bytes, int], term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in term of hyphenated ones, once for each part, and the parts' numbers; numbers gets
    those that it lacks."""
    kinds = [(n, [numbers.setdefault(p, len(numbers)) for p in t.split(b"-")]) for t, n in list(numbers.items()) if b"-" in t]
    if not kinds:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    count = np.zeros(len(numbers), np.int64)
    start = np.zeros(len(numbers), np.int64)
    sizes = [len(p) for _, p in kinds]
    which = [n for n, _ in kinds]
    count[which] = sizes
    start[which] = np.cumsum(sizes) - sizes
    at = np.flatnonzero(count[term])
    n = count[term[at]]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), np.concatenate([p for _, p in kinds])[np.repeat(start[term[at]], n) + within]


def _numbered(sizes: list[int], words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms; and for each token or part its text's place in sizes, its term's number and its position."""
    numbers = dict(zip(dict.fromkeys(words), range(len(words))))
    term = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, part = _parts(numbers, term)
    return list(numbers), np.concatenate([row, row[at]]), np.concatenate([term, part]), np.concatenate([pos, pos[at]])


def _names(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


def _lists(begin: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, n).astype(np.int32)), values)


def _begins(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _sorted(major: np.ndarray, minor: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """The different pairs in their order, and the ascending positions of each. All three are sorted
    as one number: they come from a chunk's tokens, or from one text's."""
    most, longest = int(minor.max()) + 1, int(pos.max()) + 1
    keys = np.sort((major * most + minor) * longest + pos)
    group = keys // longest
    begin = _begins(group)
    return group[begin] // most, group[begin] % most, _lists(begin, len(keys), pa.array((keys - group * longest).astype(np.int32)))


def gathered(ids: pa.Array, sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
    """Postings of the texts of ids; words are their tokens, sizes how many each has."""
    terms, row, term, pos = _numbered(sizes, words)
    row, term, positions = _sorted(row, term, pos)
    return pa.RecordBatch.from_arrays(
        [_names(terms).take(pa.array(term)), ids.take(pa.array(row)), positions.value_lengths(), positions], ["term", "document_id", "tf", "positions"])


def blocked(ids: pa.Array, sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
    """The same postings, a row a term."""
    terms, row, term, pos = _numbered(sizes, words)
    term, row, positions = _sorted(term, row, pos)
    begin = _begins(term)
    return pa.RecordBatch.from_arrays(
        [_names(terms).take(pa.array(term[begin])), _lists(begin, len(term), ids.take(pa.array(row))), _lists(begin, len(term), positions)],
        ["term", "documents", "positions"])


def counted(ids: pa.Array, sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
    """How many of the texts have a term, and how often they have it."""
    terms, row, term, _ = _numbered(sizes, words)
    n = len(terms)
    return pa.RecordBatch.from_arrays(
        [_names(terms), pa.array(np.bincount(np.unique(row * n + term) % n, minlength=n)), pa.array(np.bincount(term, minlength=n))], ["term", "df", "cf"])


def chunks(batches: Iterator[pa.RecordBatch], made: Callable, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        rows, sizes, words = [], [], []
        for i in range(b.num_rows):
            found = split_tokens(texts[i].as_py())
            if words and len(words) + len(found) > most:
                yield made(ids.take(pa.array(rows)), sizes, words)
                rows, sizes, words = [], [], []
            if found:
                rows.append(i)
                sizes.append(len(found))
                words += found
        if words:
            yield made(ids.take(pa.array(rows)), sizes, words)


def _mapped(docs: DataFrame, made: Callable, most: int, schema: str) -> DataFrame:
    lower = F.lower(F.coalesce("text", F.lit(""))).cast("binary")
    return docs.select(F.col("document_id").cast("string"), lower.alias("text")).mapInArrow(lambda batches: chunks(batches, made, most), schema)


def text_postings(docs: DataFrame) -> DataFrame:
    """docs(document_id, text) to postings (term, document_id, tf, positions) of each row by
    itself: rows of one document are not put together."""
    return _mapped(docs, gathered, CHUNK, POSTINGS)


def text_blocks(docs: DataFrame) -> DataFrame:
    """The same postings as rows (term, documents, positions), several for a term: fewer and shorter
    to sort."""
    return _mapped(docs, blocked, BLOCK_CHUNK, BLOCKS)


def of_blocks(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("term", F.inline(F.arrays_zip(F.col("documents").alias("document_id"), F.col("positions").alias("positions"))))
    return rows.toDF("term", "document_id", "positions").select("term", "document_id", F.size("positions").cast("int").alias("tf"), "positions")


def text_counts(docs: DataFrame) -> DataFrame:
    """docs(document_id, text) to (term, df, cf), each row being another document."""
    return _mapped(docs, counted, BLOCK_CHUNK, COUNTS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
