"""SimHash near-duplicates by anchor-point covering (operator 7).

Fingerprints have 64 bits. The anchors are the words of a covering code: the direct sum of
nine perfect Hamming [7,4] codes (every 7-bit block is within one bit of exactly one code
word) and one free bit. Two fingerprints within two bits share a midpoint that is within one
bit of both; the midpoint's nearest anchor lies within covering radius plus one bit of each of
them. So every fingerprint is replicated to the anchors that are nearest to some word in its
ball of radius one (about 25 of 2^37) and anchors are compared one by one; there, members that
share a midpoint are linked. A midpoint has 65 words around it, so linking each of its members
to the smallest is linear in the anchor's members, and no pair within two bits is lost.

Equal fingerprints are collapsed before anything is replicated, whatever their number.
Component labels come from distributed star contraction. Cases: a null or empty text has
fingerprint zero, which links like any other; repeated doc_ids count as one node; null doc_ids
get the component of their fingerprint's other documents (null if there are none); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table
from .components import connected_components

SHINGLE = 3
SEED = 42
BITS = 64
_SLICE = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; bytes.lower and bytes.split touch exactly
    A-Z and the six ASCII white-space characters."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts = (end - size)[: len(words) - shingle + 1].tolist()
        ends = end[shingle - 1:].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(norm[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at: at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, which stands last, becomes its fingerprint."""
    for b in batches:
        fp = np.fromiter((fingerprint(x.as_py()) for x in b.columns[-1]), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*b.schema.names[:-1], "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """decode[w]: the code word nearest to the 7-bit word w. step[w, i]: how that changes when
    bit i of w is flipped. Bit i stands for column i + 1 of the parity check matrix."""
    decode = np.zeros(128, np.uint64)
    for w in range(128):
        syndrome = 0
        for i in range(7):
            if w >> i & 1:
                syndrome ^= i + 1
        decode[w] = w ^ (1 << (syndrome - 1)) if syndrome else w
    step = np.zeros((128, 7), np.uint64)
    for w in range(128):
        for i in range(7):
            step[w, i] = decode[w] ^ decode[w ^ (1 << i)]
    return decode, step


_DECODE, _STEP = _hamming_tables()
_BLOCKS = 9


def _anchor_steps(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of each fingerprint, and for each of its 64 bits how the nearest
    anchor changes when that bit is flipped."""
    home = fps & np.uint64(1 << 63)
    steps = np.empty((len(fps), BITS), np.uint64)
    for k in range(_BLOCKS):
        at = np.uint64(7 * k)
        block = (fps >> at & np.uint64(127)).astype(np.intp)
        home |= _DECODE[block] << at
        steps[:, 7 * k: 7 * k + 7] = _STEP[block] << at
    steps[:, 63] = np.uint64(1 << 63)
    return home, steps


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, rep) to one row for each anchor."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        reps = b.column(1).to_numpy(zero_copy_only=False)
        for lo in range(0, len(fps), 4096):
            x, r = fps[lo: lo + 4096], reps[lo: lo + 4096]
            home, steps = _anchor_steps(x)
            steps.sort(axis=1)
            fresh = np.ones(steps.shape, bool)
            fresh[:, 1:] = steps[:, 1:] != steps[:, :-1]
            fresh &= steps != 0
            row, col = np.nonzero(fresh)
            anchor = np.concatenate([home, home[row] ^ steps[row, col]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(np.concatenate([x, x[row]]).view(np.int64)), pa.array(np.concatenate([r, r[row]]))],
                ["anchor", "fp", "rep"],
            )


def _link_members(anchor: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, smallest rep with the same midpoint) among the members of whole anchors."""
    us, vs = [], []
    same = np.flatnonzero(np.diff(anchor)) + 1
    size = np.diff(np.concatenate([[0], same, [len(anchor)]]))
    shared = np.repeat(size > 1, size)  # an anchor's only member has nobody to link to
    anchor, fps, reps = anchor[shared], fps[shared], reps[shared]
    if not len(anchor):
        return reps, reps
    home, steps = _anchor_steps(fps)
    keys, mids, who = [anchor[home == anchor]], [fps[home == anchor]], [reps[home == anchor]]
    for i in range(BITS):
        hit = (home ^ steps[:, i]) == anchor
        keys.append(anchor[hit])
        mids.append(fps[hit] ^ np.uint64(1 << i))
        who.append(reps[hit])
    mid, rep = np.concatenate(mids), np.concatenate(who)  # a midpoint has one nearest anchor
    order = np.lexsort((rep, mid))
    mid, rep = mid[order], rep[order]
    first = np.ones(len(mid), bool)
    first[1:] = mid[1:] != mid[:-1]
    least = rep[np.flatnonzero(first)[np.cumsum(first) - 1]]
    edge = rep != least
    us.append(rep[edge])
    vs.append(least[edge])
    return np.concatenate(us), np.concatenate(vs)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; an anchor that a batch ends in is carried to the next one."""
    rest: tuple[np.ndarray, ...] | None = None

    def out(part):
        u, v = _link_members(*part)
        if len(u):
            pairs = np.unique(np.stack([u, v], axis=1), axis=0)
            u, v = pairs[:, 0], pairs[:, 1]
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        part = [cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2]]
        if rest is not None:
            part = [np.concatenate([a, p]) for a, p in zip(rest, part)]
        cutat = int(np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1]]))[-1])
        rest = tuple(p[cutat:] for p in part)
        if cutat:
            yield out([p[:cutat] for p in part])
    if rest is not None:
        yield out(rest)


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp) to (fp, component_id): linked at two or fewer differing bits."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    sent = nodes.filter("rep is not null").select("fp", "rep").mapInArrow(_replicate, "anchor long, fp long, rep long")
    edges = sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "u long, v long")
    # two fingerprints may have one smallest doc_id when a doc_id repeats: they are one node
    labels = connected_components(edges)
    return nodes.join(labels, nodes.rep == labels.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = cut(with_fingerprints(docs), "simhash-prints")
    return prints.join(fingerprint_components(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_NO_ID = (1 << 63) - 1


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of linked fingerprints the row with the smallest doc_id
    stays (of those that share it, the one with the smallest hash of its text; rows without
    doc_id come last). Rows that repeat a doc_id with texts that are not near-duplicates are
    documents of their own and stay."""
    own = {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__h": F.xxhash64("text")}
    key = [c.alias(n) for n, c in own.items()]
    prints = cut(docs.select(*key, "text").mapInArrow(_fingerprints, "__id long, __h long, fp long"), "simhash-prints")
    best = prints.groupBy("fp").agg(F.min(F.struct("__id", "__h")).alias("best"))
    groups = fingerprint_components(prints.select(F.col("fp").alias("doc_id"), "fp"))
    stay = cut(best.join(groups, "fp").groupBy("component_id").agg(F.min("best").alias("best")).select("best.*"), "simhash-stay")
    # the row travels as one struct, so none of its columns can clash with the stage's own
    kept = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")).join(stay, ["__id", "__h"], "left_semi")
    if prints.count() > prints.select("__id", "__h").distinct().count():  # rows that are equal in both: one of them
        kept = kept.dropDuplicates(["__id", "__h"])
    drop(prints)
    return kept.select("__doc.*")
