"""Searches over words and vectors together, and over rewritten queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieve as V
from .index import Index

#: Vector hits fetched beyond the asked number, of which some may be gone from the store.
SLACK = 16


def hybrid(queries: DataFrame, index: Index, vectors: DataFrame, passages: DataFrame, k: int, weights: list[float] | None = None) -> DataFrame:
    """Both lists twice as long as asked, fused by reciprocal rank; the score is one over the place. A query without a
    vector is answered by words alone."""
    lists = [V.bm25(queries, index, 2 * k), V.dense(vectors, passages, 2 * k)]
    f = V.fused_lists(lists, k, weights)
    return f.select("query_id", "rank", "doc_id", F.round(1.0 / F.col("rank"), 6).alias("score"))


def hybrid_lifted(queries: DataFrame, index: Index, vectors: DataFrame, passages: DataFrame, lift: DataFrame, k: int) -> DataFrame:
    """Vector hits are weighed by `lift` (doc_id, lift) and ranked again before fusion; hits without a row there are gone
    from the store. k and some more are returned, for filters that follow."""
    near = V.dense(vectors, passages, k + SLACK).join(lift, "doc_id")
    near = V.top(near.select("query_id", "doc_id", F.round(F.col("score") * F.col("lift"), 6).alias("score")), k + SLACK)
    return V.fused_lists([V.bm25(queries, index, k), near], k + SLACK)


def with_paraphrases(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """queries: query_id, query, paraphrases. Every variant is a query of its own; lists are fused per query_id."""
    texts = F.concat(F.array("query"), F.coalesce("paraphrases", F.array().cast("array<string>")))
    v = queries.select("query_id", F.posexplode(texts).alias("_v", "query"))
    key = F.struct("query_id", "_v")
    named = v.withColumn("_key", F.xxhash64(key))
    hits = V.bm25(named.select(F.col("_key").alias("query_id"), "query"), index, k)
    lists = hits.withColumnRenamed("query_id", "_key").join(named.select("_key", "query_id"), "_key")
    return V.fused(lists, k)


def with_passage(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Adds a passage (query_id, passage) to each query that has one."""
    return queries.join(passages, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "passage").alias("query"))


def with_rewrites(queries: DataFrame) -> DataFrame:
    """Adds the keyword rewrites of a question about an entity to it; other queries stay as they are."""
    return queries.select("query_id", F.concat_ws(" ", "query", F.array_join(T.entity_rewrites(F.col("query")), " ")).alias("query"))
