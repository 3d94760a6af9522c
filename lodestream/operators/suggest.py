"""Spelling suggestions: the closest indexed term within two edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.plans.query import normal_term, parse_query

from .indexing import SearchIndex

MAX_DISTANCE = 2


def closest(terms: DataFrame, missing: Sequence[str], max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(raw, suggestion) for each missing term that has a close one; of equally close ones the
    smallest. The few missing terms are broadcast; the vocabulary is scanned once, and an edit
    distance is computed only where lengths allow it."""
    spark = terms.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(missing) if t], "raw string")
    near = terms.select("term").join(F.broadcast(asked), F.abs(F.length("term") - F.length("raw")) <= max_distance)
    near = near.withColumn("d", F.levenshtein("raw", "term", max_distance)).filter("d >= 0")
    best = near.groupBy("raw").agg(F.min(F.struct("d", "term")).alias("b"))
    return best.filter("b.d > 0").select("raw", F.col("b.term").alias("suggestion"))  # indexed terms need none


def suggest_term(index: SearchIndex, raw: str) -> str | None:
    got = closest(index.terms, [normal_term(raw)]).head(1)
    return got[0].suggestion if got else None


def suggest_query(index: SearchIndex, words: Sequence[str] | str) -> dict[str, str]:
    """Missing term to suggestion, in query order."""
    asked = parse_query(words).scoring_terms
    if not asked:
        return {}
    found = {r.raw: r.suggestion for r in closest(index.terms, asked).collect()}
    return {t: found[t] for t in asked if t in found}
