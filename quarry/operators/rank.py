"""What happens to ranked rows: calibration, date order, diversification, pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibrated(ranked: DataFrame) -> DataFrame:
    """Scores over the query's largest; unchanged where that is not positive."""
    m = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("score", F.when(m > 0, F.round(F.col("score") / m, 6)).otherwise(F.col("score")))


def by_date(rows: DataFrame, date: str, newest: bool, by: list[str], tie: str) -> DataFrame:
    """Place by date, undated rows last either way."""
    order = F.desc_nulls_last(date) if newest else F.asc_nulls_last(date)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))


def in_window(date: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """Both ends included; an unknown date fails any bound."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & (date >= since)
    if until is not None:
        ok = ok & (date <= until)
    return F.coalesce(ok, F.lit(False))


def author_matches(author: Column, include: list[str], exclude: list[str]) -> Column:
    """Substrings without case; an unknown author fails an inclusion and passes an exclusion."""
    a = F.lower(F.coalesce(author, F.lit("")))
    wanted = F.lit(not include)
    for x in include:
        wanted = wanted | a.contains(x.lower())
    for x in exclude:
        wanted = wanted & ~a.contains(x.lower())
    return wanted


def by_author(hits: DataFrame, metas: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Hits whose document (doc_id, author) clears the lists; a hit without a row of metadata stays."""
    m = metas.select("doc_id", author_matches(F.col("author"), include, exclude).alias("_ok"))
    return hits.join(m, "doc_id", "left").where(F.coalesce("_ok", F.lit(True))).drop("_ok")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of an order, with the total."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def after_key(rows: DataFrame, keys: list[str], last: tuple, limit: int) -> DataFrame:
    """Keyset pagination: the rows after a key, in order."""
    later = F.struct(*keys) > F.struct(*[F.lit(x) for x in last])
    return rows.where(later).orderBy(*keys).limit(limit)


def diversified(candidates: DataFrame, weight: float, k: int) -> DataFrame:
    """Maximal marginal relevance per query. candidates: query_id, doc_id, score, vector; more than k each, which a top-k
    before it bounds. With k candidates at most, or a weight of one, their order stays. A candidate unlike all chosen
    ones gains nothing by it: likeness counts from zero. Weights go from zero to one; ties go to the better candidate."""
    weight = min(max(weight, 0.0), 1.0)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        if len(pdf) <= k or weight == 1.0:
            chosen = list(range(min(k, len(pdf))))
        else:
            v = np.stack(pdf["vector"].to_numpy()).astype(float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            score, left, near, chosen = pdf["score"].to_numpy(float), np.ones(len(pdf), bool), np.zeros(len(pdf)), []
            while len(chosen) < k:
                i = int(np.argmax(np.where(left, weight * score - (1 - weight) * near, -np.inf)))
                chosen.append(i)
                left[i] = False
                near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(greedy, "query_id long, doc_id long, rank int")


def pool_size(k: int, asked: int = 0) -> int:
    """Candidates that diversification chooses from."""
    return max(asked if asked > 0 else max(5 * k, 50), k)
