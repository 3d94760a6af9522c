"""Retrieval: AND of terms and phrases, ranked; and lookup of one term.

Only the postings of the query's terms are read (a pushed filter on files sorted by term), and
positions only when a phrase or the proximity bonus needs them. Postings meet per document in
one aggregation of at most as many rows as the query has terms; documents that pass are then
joined to their url, length and text. df and the two corpus counts are a few rows and are
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import with_snippet
from lodestream.plans.query import RANKING_MODES, Query, normal_term, parse_query

from . import ranking
from .indexing import SearchIndex


def _contains_phrase(hits: Column, places: Sequence[int]) -> Column:
    """The words whose hits are at these places occur one after the other."""
    at = [F.get(hits, F.lit(i))["positions"] for i in places]
    if len(at) == 1:
        return F.size(at[0]) > 0

    def begins(k: int) -> Column:
        """Where the phrase would begin by its k-th word."""
        return F.transform(at[k], lambda p: p - k)

    starts = at[0]
    for k in range(1, len(at)):
        starts = F.array_intersect(starts, begins(k))
    return F.size(starts) > 0


def matching(index: SearchIndex, query: Query, positions: bool) -> DataFrame:
    """document_id and hits (ord, term, tf, df, positions) in query order, of the documents
    that satisfy every term and phrase."""
    terms = list(query.scoring_terms)
    order = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))])
    use_positions = positions or any(len(p) > 1 for p in query.phrases)
    place = F.col("positions") if use_positions else F.lit(None).cast("array<int>")
    rows = index.postings.filter(F.col("term").isin(terms)).select("term", "document_id", "tf", place.alias("positions"))
    df = F.broadcast(index.terms.filter(F.col("term").isin(terms)))  # at most one row a query term
    hits = rows.join(df, "term").groupBy("document_id").agg(F.sort_array(F.collect_list(
        F.struct(F.element_at(order, F.col("term")).alias("ord"), "term", "tf", "df", "positions"))).alias("hits"))
    out = hits.filter(F.size("hits") == len(terms))  # phrase words are required too
    at = {t: i for i, t in enumerate(terms)}
    for phrase in query.phrases:
        if len(phrase) > 1:
            out = out.filter(_contains_phrase(F.col("hits"), [at[t] for t in phrase]))
    return out


def find(index: SearchIndex, words: Sequence[str] | str, ranking_mode: str = "tfidf", proximity_bonus: bool = False,
         snippets: bool = False, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """document_id, url, term_frequencies, relevance_score, snippet; best first, ties by url and
    id. There is no limit unless one is asked for."""
    if ranking_mode not in RANKING_MODES:
        raise ValueError(f"Unsupported ranking mode: {ranking_mode}")
    query = parse_query(words)
    if query.empty:
        return index.spark.createDataFrame([], "document_id string, url string, term_frequencies map<string,int>, relevance_score double, snippet string")
    hits = matching(index, query, proximity_bonus)
    counts = index.corpus.crossJoin(index.meta.select("page_count"))  # one row each
    counts = counts.select(F.greatest("documents", "page_count").alias("__n"), F.try_divide("tokens", "documents").alias("__avg"))
    cols = ["document_id", "url", "length"] + ["text"] * snippets
    found = hits.join(index.documents.select(*cols), "document_id").crossJoin(F.broadcast(counts))  # one row
    h, n = F.col("hits"), F.col("__n")
    score = ranking.tfidf(h, n) if ranking_mode == "tfidf" else ranking.bm25(h, n, F.col("length"), F.coalesce("__avg", F.lit(0.0)))
    if proximity_bonus:
        score = ranking.with_bonus(score, ranking.proximity(h, len(query.scoring_terms)))
    if snippets:
        found = with_snippet(found, query.scoring_terms)
    else:
        found = found.withColumn("snippet", F.lit(""))
    out = found.select(
        "document_id", "url", F.map_from_entries(F.transform(h, lambda x: F.struct(x["term"], x["tf"]))).alias("term_frequencies"),
        score.alias("relevance_score"), "snippet")
    if ordered or limit is not None:
        out = out.orderBy(F.desc("relevance_score"), "url", "document_id")
    return out.limit(limit) if limit is not None else out


def lookup(index: SearchIndex, raw: str) -> DataFrame:
    """term, df, document_id, url, tf, positions by document_id; no rows if it is not indexed."""
    term = normal_term(raw)
    rows = index.postings.filter(F.col("term") == term)
    df = F.broadcast(index.terms.filter(F.col("term") == term))  # one row
    return rows.join(df, "term").join(index.documents.select("document_id", "url"), "document_id", "left").select(
        "term", "df", "document_id", F.coalesce("url", F.lit("")).alias("url"), "tf", "positions").orderBy("document_id")
