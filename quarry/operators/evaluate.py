"""Retrieval metrics for all queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """recall, mrr and ndcg at k per query. relevant: query_id, doc_id."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return summed(n, ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"]), k)


def summed(n: DataFrame, hit: DataFrame, k: int) -> DataFrame:
    got = hit.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = n.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", zero(F.col("found") / F.col("n_relevant")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / best).alias("ndcg"))


def metrics_by_label(ranked: DataFrame, queries: DataFrame, passages: DataFrame, k: int = 10) -> DataFrame:
    """The same where what shares a query's label is relevant, the query's own row left out. queries: query_id, label;
    passages: doc_id, label. Relevant rows are counted per label and never paired with queries; only hits are."""
    size = passages.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("_n"))
    own = queries.join(passages.select(F.col("doc_id").alias("query_id"), F.col("label").alias("_own")), "query_id", "left")
    n = own.join(size, F.col("label") == F.col("_l")).select("query_id", "label", (F.col("_n") - F.when(F.col("_own") == F.col("label"), 1).otherwise(0)).alias("n_relevant")).where("n_relevant > 0")
    hit = ranked.where(F.col("rank") <= k).join(n.select("query_id", "label"), "query_id").join(passages, ["doc_id", "label"]).where("query_id <> doc_id")
    return summed(n.select("query_id", "n_relevant"), hit, k)


def mean(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = mean(a), mean(b)
    return x.select(*[F.col(c).alias(f"_{c}") for c in ("recall", "mrr", "ndcg")]).crossJoin(y).select(*[F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"d_{c}") for c in ("recall", "mrr", "ndcg")])
