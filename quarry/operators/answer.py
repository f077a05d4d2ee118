"""Answering and research as jobs over tables of questions, with everything a model does behind small interfaces.

Nothing here calls a model by itself. Retrievers, rerankers, embedders and writers are given; deterministic ones stand
in where none is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as P
from ..functions import scoring as S
from ..functions import text as T
from ..storage import written
from . import retrieve as V
from .index import Index
from .rank import diversified, in_window


class Retriever(Protocol):
    """Ranked hits (query_id, rank, doc_id, score) of a table of queries (query_id, query)."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class Scorer(Protocol):
    """Scores of texts for a question, in their order."""

    def score(self, question: str, texts: list[str]) -> list[float]: ...


class Embedder(Protocol):
    """Unit vectors of texts, in their order."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Writer(Protocol):
    """A model's reply to a prompt."""

    def reply(self, prompt: str) -> str: ...


class Words:
    """Retrieval by words from a stored index."""

    def __init__(self, index: Index, **options):
        self.index, self.options = index, options

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return V.bm25(queries, self.index, k, **self.options)


class Vectors:
    """Retrieval by vectors of queries that are given with them."""

    def __init__(self, passages: DataFrame, vectors: DataFrame):
        self.passages, self.vectors = passages, vectors

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return V.dense(self.vectors.join(queries.select("query_id"), "query_id", "left_semi"), self.passages, k)


class SharedWords:
    """Share of a question's words that a text holds: a scorer that needs no model."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        words = set(question.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


class HashedWords:
    """Unit vectors of word counts hashed to a number of components: an embedder that needs no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embedded(rows: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """Adds `embedding` of the column text; texts go to the embedder in batches of a bounded size."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].fillna("").tolist()
            parts = [embedder.embed(texts[a : a + batch]) for a in range(0, len(texts), batch)]
            f["embedding"] = [v.astype(np.float32) for p in parts for v in p]
            yield f

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.select(*names).mapInPandas(run, schema + ", embedding array<float>")


def with_scores(hits: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds `judged`, the scorer's score of each hit's text. A question's hits are few, so they are one group. A scorer
    that fails leaves null."""
    rows = hits.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        try:
            pdf["judged"] = [float(x) for x in scorer.score(pdf["query"].iloc[0], pdf["text"].fillna("").tolist())]
        except Exception:  # noqa: BLE001 - whatever a scorer raises, the old order stays
            pdf["judged"] = np.nan
        return pdf[["query_id", "rank", "doc_id", "score", "judged"]]

    got = rows.select("query_id", "query", "rank", "doc_id", "score", "text").groupBy("query_id").applyInPandas(run, "query_id long, rank int, doc_id long, score double, judged double")
    return got.withColumn("judged", F.when(~F.isnan("judged"), F.round("judged", 6)))


def reranked(judged: DataFrame, k: int) -> DataFrame:
    """Hits by the judged score; hits without one keep their order behind the others."""
    w = V.Window.partitionBy("query_id").orderBy(F.desc_nulls_last("judged"), "rank")
    return judged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reordered(hits: DataFrame, replies: DataFrame, k: int) -> DataFrame:
    """Hits in the order of a listwise model's replies (query_id, reply); see replies.places."""
    n = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("_n")).join(replies, "query_id", "left")
    order = n.select("query_id", F.posexplode(P.places(F.coalesce("reply", F.lit("")), F.col("_n"))).alias("_new", "_old"))
    j = hits.withColumn("_old", F.col("rank") - 1).join(order, ["query_id", "_old"])
    return j.select("query_id", (F.col("_new") + 1).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def gated(judged: DataFrame, least: float) -> DataFrame:
    """Hits whose judged score is high enough, numbered anew."""
    w = V.Window.partitionBy("query_id").orderBy("rank")
    return judged.where(F.col("judged") >= least).withColumn("rank", F.row_number().over(w))


def decayed(hits: DataFrame, docs: DataFrame, now: Column, half_life: float = 180.0) -> DataFrame:
    """Scores weighed by the age of documents (doc_id, published_at), ranked anew."""
    j = hits.join(docs.select("doc_id", "published_at"), "doc_id", "left")
    age = (F.unix_timestamp(now) - F.unix_timestamp("published_at")) / 86400.0
    w = V.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return j.select("query_id", "doc_id", F.round(F.col("score") * S.decay(age, half_life), 6).alias("score")).withColumn("rank", F.row_number().over(w))


def over_fetch(k: int, domains: bool = False, dates: bool = False, site: bool = False) -> int:
    """How many hits to fetch where a filter can only come after the cut; filters here come before it."""
    n = 300 if site else k * 10 if dates else k * 5 if domains else k
    return min(max(n, k), 500)


def answer_sources(queries: DataFrame, retriever: Retriever, docs: DataFrame, k: int = 8, pool: int = 30, now: Column | None = None, since: Column | None = None, scorer: Scorer | None = None, least: float = 0.3, vectors: DataFrame | None = None, weight: float = 0.7) -> DataFrame:
    """What an answer may cite: retrieve, filter by date, decay, rerank, judge, diversify, cut. query_id, source (the
    number to cite), doc_id, excerpt. docs: doc_id, text, title, published_at; vectors: doc_id, vector."""
    hits = retriever.search(queries, pool)
    if since is not None:
        kept = docs.where(in_window(F.col("published_at"), since)).select("doc_id")
        hits = hits.join(kept, "doc_id", "left_semi")
    if now is not None:
        hits = decayed(hits, docs, now)
    if scorer is not None:
        hits = gated(reranked(with_scores(hits, queries, docs, scorer), pool), least)
    if vectors is not None:
        c = hits.join(vectors, "doc_id").select("query_id", "doc_id", "score", "vector")
        hits = diversified(c, weight, k)
    w = V.Window.partitionBy("query_id").orderBy("rank", "doc_id")
    top = hits.withColumn("source", F.row_number().over(w)).where(F.col("source") <= k).select("query_id", "source", "doc_id")
    return top.join(docs.select("doc_id", F.substring("text", 1, 300).alias("excerpt")), "doc_id").select("query_id", "source", "doc_id", "excerpt")


def prompts(queries: DataFrame, sources: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and the text a writer gets: the question and each source's share of the context, numbered."""
    n = sources.groupBy("query_id").agg(F.count("*").alias("_n"))
    j = sources.join(n, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    limit = F.least(F.lit(10_000), F.floor(30_000 / F.col("_n"))).cast("int")
    part = F.concat(F.lit("["), F.col("source").cast("string"), F.lit("] "), F.when(F.octet_length("text") <= limit, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), limit - 3), F.lit("…"))))
    lists = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", part.alias("p")))).alias("_s"))
    return queries.join(lists, "query_id").select("query_id", F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.col("query")), F.array_join(F.transform("_s", lambda x: x["p"]), "\n\n")).alias("prompt"))


def replied(prompts_: DataFrame, writer: Writer) -> DataFrame:
    """query_id and the writer's reply; empty where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f["prompt"]:
                try:
                    out.append(writer.reply(p))
                except Exception:  # noqa: BLE001 - an answer that cannot be had is an empty one
                    out.append("")
            yield pd.DataFrame({"query_id": f["query_id"], "reply": out})

    return prompts_.select("query_id", "prompt").mapInPandas(run, "query_id long, reply string")


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that an answer (query_id, reply) names by number."""
    ids = answers.select("query_id", F.explode(T.cited_ids(T.without_thinking(F.col("reply")))).alias("source"))
    return sources.join(ids, ["query_id", "source"], "left_semi")


# --- research


def merged(hits: DataFrame) -> DataFrame:
    """The best score of a document over all sub-queries of a question: question_id, doc_id, score."""
    return hits.groupBy("question_id", "doc_id").agg(F.max("score").alias("score"))


def sub_hits(plan: DataFrame, retriever: Retriever, k: int) -> DataFrame:
    """Hits of every sub-query (question_id, place, query), with their question."""
    keyed = plan.withColumn("query_id", F.xxhash64("question_id", "place"))
    hits = retriever.search(keyed.select("query_id", "query"), k)
    return hits.join(keyed.select("query_id", "question_id", "place"), "query_id")


def research(plan: DataFrame, retriever: Retriever, k: int, per_query: int = 20) -> DataFrame:
    """Sources of a question from all its sub-queries, each document once by its best score: question_id, source, doc_id, score."""
    best = merged(sub_hits(plan, retriever, per_query))
    w = V.Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("source", F.row_number().over(w)).where(F.col("source") <= k).select("question_id", "source", "doc_id", "score")


def passes(asked: int | None, site: bool = False, default: int = 3, most: int = 10) -> int:
    """How many passes a research takes: one in a site, the default where nothing useful is asked for, ten at most."""
    return 1 if site else default if asked is None or asked < 1 else min(asked, most)


def research_passes(plan: DataFrame, retriever: Retriever, refine: Callable[[int, DataFrame], DataFrame | None], k: int, max_passes: int | None = None, per_query: int = 20) -> DataFrame:
    """Passes over refined plans: each finds k documents that none before it used and numbers them on. `refine` gets the
    number of the pass that is done and its sources and returns the next plan, or None to stop. Sources of every pass
    are a written table, so a pass does not compute those before it again."""
    found = None
    for n in range(1, passes(max_passes) + 1):
        best = merged(sub_hits(plan, retriever, per_query))
        if found is not None:
            best = best.join(found.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
            last = found.groupBy("question_id").agg(F.max("source").alias("_last"))
            best = best.join(last, "question_id", "left")
        else:
            best = best.withColumn("_last", F.lit(None).cast("int"))
        w = V.Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
        new = best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
        new = new.select("question_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("source"), "doc_id", "score", F.lit(n).alias("pass"))
        new = written(new, "pass")
        found = new if found is None else found.unionByName(new)
        plan = refine(n, new)
        if plan is None:
            break
    return found


def appended(sources: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """Sources of a question and, behind them, new hits (question_id, doc_id, rank) it does not have, up to a limit."""
    new = more.join(sources.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
    last = sources.groupBy("question_id").agg(F.max("source").alias("_last"))
    w = V.Window.partitionBy("question_id").orderBy("rank", "doc_id")
    new = new.withColumn("_n", F.row_number().over(w)).join(last, "question_id", "left")
    new = new.select("question_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("source"), "doc_id")
    return sources.select("question_id", "source", "doc_id").unionByName(new).where(F.col("source") <= limit)


def planned(replies_: DataFrame) -> DataFrame:
    """Plans of questions (question_id, question, reply) as rows of sub-queries: question_id, place, query, retriever."""
    p = replies_.select("question_id", P.plan(F.col("reply"), F.col("question")).alias("_p"))
    return p.select("question_id", F.posexplode("_p.queries").alias("place", "query"), F.col("_p.retriever").alias("retriever"))


def planned_search(plan: DataFrame, retriever: Retriever, k: int, boosts: DataFrame | None = None, fetch: int = 30) -> DataFrame:
    """Documents by the best place that any sub-query gave them, times a boost (doc_id, boost)."""
    hits = sub_hits(plan, retriever, fetch)
    s = hits.groupBy(F.col("question_id").alias("query_id"), "doc_id").agg(F.max(S.best_rank(F.col("rank"))).alias("score"))
    if boosts is not None:
        s = s.join(boosts.select("doc_id", "boost"), "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0)))
    return V.top(s.select("query_id", "doc_id", F.round("score", 9).alias("score")), k).select("query_id", "rank", "doc_id", "score")


# --- shards


def peer_k(k: int) -> int:
    """Hits that every shard is asked for."""
    return max(2 * k, 20)


def scattered(queries: DataFrame, shards: list[Retriever], k: int, fetch: int | None = None) -> DataFrame:
    """Every shard's list, fused by place: scores of shards with statistics of their own do not compare. `fetch` is
    peer_k(k) for searches, 2 k where an answer is written from the hits."""
    n = peer_k(k) if fetch is None else fetch
    return V.fused_lists([s.search(queries, n) for s in shards], k)


def v1_search(queries: DataFrame, retriever: Retriever, docs: DataFrame, k: int = 10) -> DataFrame:
    """The plain interface: a valid query, hits without expansion or decay, ranks, and the documents' address and title;
    hits whose document is gone are left out, with their ranks closed up."""
    good = queries.where(P.query_problem(F.col("query")) == "")
    hits = retriever.search(good, k).join(docs.select("doc_id", "url", "title"), "doc_id")
    w = V.Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "doc_id", "url", "title", "score")


def first_titles(lists: DataFrame) -> DataFrame:
    """The title under which a document was first seen: list and place decide. lists: query_id, list, rank, doc_id, title."""
    return lists.groupBy("query_id", "doc_id").agg(F.min_by("title", F.struct("list", "rank")).alias("title"))


def site_titles(docs: DataFrame, most: int = 10) -> DataFrame:
    """Up to so many different titles per host, in the order of ids: what a planner learns of a site."""
    named = docs.where("title <> ''").groupBy("host", "title").agg(F.min("doc_id").alias("doc_id"))
    w = V.Window.partitionBy("host").orderBy("doc_id")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("host", "place", "title")


def found_resources(rows: DataFrame, most: int = 24) -> DataFrame:
    """Results of several catalogues (source, url, title, popularity) as one list: by popularity, an address once."""
    w = V.Window.partitionBy("url").orderBy(F.desc("popularity"), "source")
    once = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.orderBy(F.desc("popularity"), "url").limit(most)


def distractors(n: int, first_id: int, vocabulary: list[str], words: int = 50, seed: int = 42) -> Callable:
    """Made-up documents that an evaluation adds to its corpus: a function of a session. Words follow from the id."""

    def make(spark) -> DataFrame:
        ids = spark.range(first_id, first_id + n).select(F.col("id").alias("doc_id"))
        word = lambda i: F.element_at(F.array(*[F.lit(w) for w in vocabulary]), (F.pmod(F.xxhash64("doc_id", i, F.lit(seed)), F.lit(len(vocabulary))) + 1).cast("int"))
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ")
        return ids.select("doc_id", F.concat(F.lit("Distractor "), F.col("doc_id").cast("string")).alias("title"), text.alias("text"))

    return make
