"""Quality by a byte-level convolutional network in numpy (operator 5).

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded,
learned filters slide over each chunk, and each filter's greatest response in the chunk is
kept. The chunks' responses are combined (their mean and their maximum, by filter) into one
logistic unit. Trained by Adam on whole texts: at most SAMPLE labelled rows of the training part
(those of smallest hash of doc_id), and no more of them than have TRAIN_BYTES in all. Scoring
covers every byte of every text, in one pass without a shuffle; a bounded number of chunks is
convolved at a time.

Cases: a null or empty text is one chunk of padding and gets that chunk's score; repeated rows
get the same score; null labels are left out; without labels of both kinds all scores are 0.5
shifted to the labels' share; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table
from .toxicity import held_out, training_rows

SAMPLE = 6_000
TRAIN_BYTES = 64 << 20  # of the texts that are fitted, which the driver holds
CHUNK = 512
STEP = 448  # chunks overlap by 64 bytes
WIDTH = 8
EMBED = 6
FILTERS = 20
EPOCHS = 8
BATCH = 64
SCORE_CHUNKS = 256  # chunks convolved at a time
PAD = 256  # the symbol behind a text's last byte


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks that cover n bytes (one chunk at least)."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    k = -(-(n - CHUNK) // STEP)
    return np.append(np.arange(k) * STEP, n - CHUNK)


def chunks_of(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) symbols."""
    a = np.frombuffer(data, np.uint8)
    starts = chunk_starts(len(a))
    if len(a) < CHUNK:
        out = np.full((1, CHUNK), PAD, np.int16)
        out[0, : len(a)] = a
        return out
    return a[starts[:, None] + np.arange(CHUNK)].astype(np.int16)


@dataclass
class ByteNet:
    embed: np.ndarray  # (257, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS,)
    shift: np.ndarray  # (1,)

    @classmethod
    def new(cls, seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(
            r.normal(0, 0.5, (257, EMBED)).astype(f), r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f),
            np.zeros(FILTERS, f), r.normal(0, 0.1, 2 * FILTERS).astype(f), np.zeros(1, f))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED)"""
        e = self.embed[symbols].reshape(len(symbols), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)
        return view[:, ::EMBED]

    def pooled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest response in each chunk, after a rectifier, and where it was;
        SCORE_CHUNKS chunks are convolved at a time."""
        best, where = [], []
        for lo in range(0, len(symbols), SCORE_CHUNKS):
            x = np.ascontiguousarray(self.windows(symbols[lo: lo + SCORE_CHUNKS]))
            y = (x.reshape(-1, x.shape[-1]) @ self.filters).reshape(len(x), -1, FILTERS)
            at = y.argmax(axis=1)
            best.append(np.take_along_axis(y, at[:, None], axis=1)[:, 0] + self.bias)
            where.append(at)
        return np.maximum(np.concatenate(best), 0), np.concatenate(where)

    def respond(self, symbols: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(self.windows(symbols))
        y = (x.reshape(-1, x.shape[-1]) @ self.filters).reshape(len(symbols), -1, FILTERS)
        return np.maximum(y.max(axis=1) + self.bias, 0)

    def score_many(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; chunks of all texts are convolved in batches of SCORE_CHUNKS."""
        total = np.zeros((len(texts), FILTERS))
        top = np.zeros((len(texts), FILTERS))
        count = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal held, owner, size
            if not size:
                return
            p, who = self.respond(np.concatenate(held)), np.concatenate(owner)
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            ids = who[first]
            total[ids] += np.add.reduceat(p, first, axis=0)
            top[ids] = np.maximum(top[ids], np.maximum.reduceat(p, first, axis=0))
            count[ids] += np.diff(np.append(first, len(who)))
            held, owner, size = [], [], 0

        for i, t in enumerate(texts):
            a, starts = np.frombuffer(t, np.uint8), chunk_starts(len(t))
            for lo in range(0, len(starts), SCORE_CHUNKS):
                part = starts[lo: lo + SCORE_CHUNKS]
                c = chunks_of(t) if len(a) < CHUNK else a[part[:, None] + np.arange(CHUNK)].astype(np.int16)
                held.append(c)
                owner.append(np.full(len(c), i))
                size += len(c)
                if size >= SCORE_CHUNKS:
                    flush()
        flush()
        z = np.concatenate([total / np.maximum(count, 1)[:, None], top], axis=1) @ self.out + self.shift[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_net(data: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3, seed: int = 7) -> ByteNet:
    net, r = ByteNet.new(seed), np.random.default_rng(seed)
    params = net.params()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    # both labels weigh the same at half strength, so that a rare one is not drowned
    share = y.mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for lo in range(0, len(order), BATCH):
            pick = order[lo: lo + BATCH]
            sizes = np.array([len(data[i]) for i in pick])
            first = np.cumsum(sizes) - sizes
            symbols = np.concatenate([data[i] for i in pick])
            p, at = net.pooled(symbols)
            mean = np.add.reduceat(p, first, axis=0) / sizes[:, None]
            top = np.maximum.reduceat(p, first, axis=0)
            h = np.concatenate([mean, top], axis=1)
            z = h @ net.out + net.shift[0]
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            grad_h = err[:, None] * net.out
            who = np.repeat(np.arange(len(pick)), sizes)
            is_top = p == top[who]
            gp = grad_h[who, :FILTERS] / sizes[who][:, None] + grad_h[who, FILTERS:] * is_top
            gp = np.where(p > 0, gp, 0).astype(np.float32)
            # only the place of the maximum gets a gradient
            sym = symbols[np.arange(len(symbols))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            chosen = net.embed[sym].reshape(len(symbols), FILTERS, WIDTH * EMBED)
            g_filters = np.einsum("cfk,cf->kf", chosen, gp)
            g_x = gp[:, :, None] * net.filters.T[None]
            g_embed = np.zeros_like(net.embed)
            flat = g_x.reshape(-1, EMBED)
            for d in range(EMBED):
                g_embed[:, d] = np.bincount(sym.ravel(), flat[:, d], minlength=257)
            grads = [g_embed, g_filters, gp.sum(0), h.T @ err + 1e-4 * net.out, np.array([err.sum()])]
            step += 1
            now = rate * (1 - 0.9 * epoch / max(1, epochs))
            for k, g in enumerate(grads):
                g = g.astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                params[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, bound: int = SAMPLE, most_bytes: int = TRAIN_BYTES) -> ByteNet:
    """Whole texts of at most `bound` rows and `most_bytes` bytes reach the driver."""
    chosen = cut(training_rows(docs, labels, "quality", mod, held, bound).select(
        F.xxhash64("doc_id").alias("h"), "y", F.encode("text", "utf-8").alias("data")), "quality-sample")
    so_far = F.sum(F.octet_length("data")).over(Window.orderBy("h", "data"))  # of a bounded number of rows
    rows = chosen.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).select("y", "data").collect()
    drop(chosen)
    rows.sort(key=lambda r: (r.data, r.y))  # the same net whatever order the rows came in
    y = np.array([r.y for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        net = ByteNet.new()
        net.out[:] = 0
        net.shift[0] = 0.0 if len(y) == 0 else (3.0 if y.max() else -3.0)
        return net
    return train_net([chunks_of(bytes(r.data)) for r in rows], y)


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteNet = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)[lo: lo + 200]]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo: lo + 200], pa.array(net.score_many(texts))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score_rows(shared), "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
