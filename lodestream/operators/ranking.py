"""Scores as Column expressions over an array of a document's hits, in query order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed constants of the formulas.
K1, B, PROXIMITY_WEIGHT = 1.5, 0.75, 0.35


def idf(n: Column, df: Column) -> Column:
    return F.when((n <= 0) | (df < 0), 0.0).otherwise(F.log((n + 1) / (df + 1)) + 1.0)


def bm25_idf(n: Column, df: Column) -> Column:
    return F.when((n <= 0) | (df < 0), 0.0).otherwise(F.log(1.0 + (n - df + 0.5) / (df + 0.5)))


def _sum(hits: Column, value) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda a, h: a + value(h))


def tfidf(hits: Column, n: Column) -> Column:
    return _sum(hits, lambda h: h["tf"] * idf(n, h["df"]))


def bm25(hits: Column, n: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    norm = k1 * (1.0 - b + b * (length / average))

    def one(h):
        bottom = h["tf"] + norm
        return F.when(bottom > 0, bm25_idf(n, h["df"]) * (h["tf"] * (k1 + 1.0)) / bottom).otherwise(0.0)

    return F.when((n > 0) & (average > 0), _sum(hits, one)).otherwise(0.0)


def least_distance(left: Column, right: Column) -> Column:
    """Smallest distance between two ascending position lists, null if one is empty. One merge
    over both lists sorted together: neighbours of different sides hold the minimum."""
    both = F.sort_array(F.concat(
        F.transform(left, lambda p: F.struct(p.alias("p"), F.lit(0).alias("s"))),
        F.transform(right, lambda p: F.struct(p.alias("p"), F.lit(1).alias("s")))))
    start = F.struct(F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("r"), F.lit(None).cast("int").alias("best"))
    return F.aggregate(both, start, lambda a, x: F.struct(
        F.when(x["s"] == 0, x["p"]).otherwise(a["l"]).alias("l"),
        F.when(x["s"] == 1, x["p"]).otherwise(a["r"]).alias("r"),
        F.least(a["best"], F.when(x["s"] == 0, x["p"] - a["r"]).otherwise(x["p"] - a["l"])).alias("best"),
    ))["best"]


def proximity(hits: Column, terms: int) -> Column:
    """Mean of 1 / (1 + least distance) over the pairs of query terms that the document has."""
    pairs = [(i, j) for i in range(terms) for j in range(i + 1, terms)]
    if not pairs:
        return F.lit(0.0)
    scores = F.filter(F.array(*[
        1.0 / (1.0 + least_distance(F.get(hits, F.lit(i))["positions"], F.get(hits, F.lit(j))["positions"])) for i, j in pairs
    ]), lambda x: x.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)


def with_bonus(score: Column, near: Column, weight: float = PROXIMITY_WEIGHT) -> Column:
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), near))
    return F.when(score <= 0, score).otherwise(score * (1.0 + max(0.0, weight) * bounded))
