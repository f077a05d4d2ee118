"""Retrieval for whole tables of queries at once. Rankings break ties by the smaller document.

Queries go to the documents: a table of queries within the bounds below is sent to every task, which scores its
documents against all queries at once and passes on no more than k of them per query and batch. Larger query tables
take the shuffled way: query terms are joined with postings, scores are summed by (query, document).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..storage import written
from .index import Index, exploded, ranked_terms

#: Query terms (of all queries) and components of query vectors that may be sent to every task.
TERM_BOUND, VECTOR_BOUND = 2_000_000, 4_000_000
#: Cells of the score table that a task holds at once.
CELLS = 4_000_000
HITS = "query_id long, doc_id long, score double"


def top(rows: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows per query with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))


def weighted(queries: DataFrame, index: Index, idf_floor: float | None = None) -> DataFrame:
    """Terms of queries that occur: query_id, term, idf, mean_len."""
    terms = query_terms(queries).join(index.terms, "term").crossJoin(F.broadcast(index.stats))
    terms = terms.select("query_id", "term", S.idf(F.col("n_docs"), F.col("df")).alias("idf"), "mean_len")
    if idf_floor is not None:  # a query whose terms are all common keeps its rarest
        most = F.max("idf").over(Window.partitionBy("query_id"))
        terms = terms.withColumn("_m", most).where((F.col("idf") >= idf_floor) | ((F.col("_m") < idf_floor) & (F.col("idf") == F.col("_m")))).drop("_m")
    return terms


def scored(queries: DataFrame, index: Index, idf_floor: float | None = None, where: Column | None = None) -> DataFrame:
    """BM25 of every document that shares a term with a query, by shuffle. `where` limits documents (host, lang,
    doc_id, doc_len), not statistics."""
    rows = index.rows if where is None else index.rows.where(where)
    hits = weighted(queries, index, idf_floor).join(exploded(rows), "term")
    part = F.col("idf") * S.saturation(F.col("tf"), F.col("doc_len"), F.col("mean_len"))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best positive cells of each row, ties by id; ids go up with columns."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        above, equal = scores > least, scores == least
        take = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    else:
        take = np.ones(scores.shape, bool)
    return np.nonzero(take & np.isfinite(scores))


def hits_batch(q: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])


def bm25_hits(queries: DataFrame, index: Index, k: int, idf_floor: float | None = None, where: Column | None = None, factor: Column | None = None) -> DataFrame:
    """At least the k best documents of every query with their scores, by (query_id, doc_id); `factor` (of a forward
    row) multiplies a document's score."""
    terms = weighted(queries, index, idf_floor)
    got = terms.limit(TERM_BOUND + 1).toArrow()
    rows = index.rows if where is None else index.rows.where(where)
    if got.num_rows > TERM_BOUND:
        s = scored(queries, index, idf_floor, where)
        if factor is None:
            return s
        return s.join(rows.select("doc_id", factor.cast("double").alias("_f")), "doc_id").select("query_id", "doc_id", F.round(F.col("score") * F.col("_f"), 6).alias("score"))
    names, which = np.unique(np.array(got.column("query_id").to_pylist(), np.int64), return_inverse=True)
    words = pc.unique(got.column("term"))
    word = pc.index_in(got.column("term"), words).to_numpy()
    order = np.argsort(word, kind="stable")
    # Queries of each word, one word after another.
    of, first = which[order].astype(np.int64), np.searchsorted(word[order], np.arange(len(words) + 1))
    idf = np.zeros(len(words))
    idf[word] = got.column("idf").to_numpy()
    mean = float(got.column("mean_len")[0].as_py()) if got.num_rows else 1.0
    lifted = factor is not None
    sent = rows.sparkSession.sparkContext.broadcast((names, words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words, of, first, idf))
    read = rows.select("doc_id", "doc_len", "terms", "tfs", (F.lit(1.0) if factor is None else factor.cast("double")).alias("_f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, of, first, idf = sent.value
        for b in batches:
            step = max(1, CELLS // max(1, len(names)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                order = np.argsort(part.column(0).to_numpy(), kind="stable")
                ids = part.column(0).to_numpy()[order]
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                terms = part.column(2)
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(terms).fill_null(0).to_numpy())
                known = pc.index_in(terms.flatten(), words).fill_null(-1).to_numpy()
                tf, hit = part.column(3).flatten().to_numpy(), known >= 0
                doc, known, tf = doc[hit], known[hit], tf[hit].astype(float)
                length = part.column(1).to_numpy()[doc]
                w = idf[known] * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length / mean))
                n = first[known + 1] - first[known]
                # Every posting once per query that asks for its word, so many postings at a time that they fit.
                table, size = np.zeros(len(names) * part.num_rows), len(names) * part.num_rows
                cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), CELLS))
                for a, z in zip(cuts, [*cuts[1:], len(n)]):
                    m = n[a:z]
                    posting = np.repeat(np.arange(a, z), m)
                    asks = of[np.repeat(first[known[a:z]], m) + np.arange(len(posting)) - np.repeat(np.cumsum(m) - m, m)]
                    table += np.bincount(asks * part.num_rows + place[doc[posting]], w[posting], size)
                table = np.round(table.reshape(len(names), part.num_rows), 6)
                if lifted:
                    table = np.round(table * part.column(4).to_numpy()[order][None], 6)
                table[table <= 0] = -np.inf
                r, c = best_of(ids, table, k)
                yield hits_batch(names[r], ids[c], table[r, c])

    return read.mapInArrow(run, HITS)


def bm25(queries: DataFrame, index: Index, k: int = 10, **options) -> DataFrame:
    return top(bm25_hits(queries, index, k, **options), k).select("query_id", "rank", "doc_id", "score")


#: Boosted ids up to which documents without a query word are seeded, and their score before the boost.
SEED_IDS, SEED_SCORE = 256, 0.001


def boosted(queries: DataFrame, index: Index, boosts: DataFrame, k: int) -> DataFrame:
    """Scores of boosted documents (doc_id, boost) are multiplied; a small set of them is seeded for every query."""
    few = boosts.limit(SEED_IDS + 1).count() <= SEED_IDS
    b = boosts.select(F.col("doc_id").alias("_d"), "boost")
    s = scored(queries, index).join(b, F.col("doc_id") == F.col("_d"), "left")
    s = written(s.select("query_id", "doc_id", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 6).alias("score")), "hits")
    if few:
        ids = [(r[0], r[1]) for r in b.collect()]
        pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(float(x)).alias("boost")) for i, x in ids])) if ids else None
        if pairs is not None:
            every = queries.select("query_id", pairs.alias("_x")).select("query_id", "_x.doc_id", F.round(F.lit(SEED_SCORE) * F.col("_x.boost"), 6).alias("score"))
            s = s.union(every.join(s, ["query_id", "doc_id"], "left_anti"))
    return top(s, k).select("query_id", "rank", "doc_id", "score")


def best_spans(queries: DataFrame, passages: DataFrame, key: Column, k: int) -> DataFrame:
    """The k best documents by their best passage, with that passage's byte_offset and byte_length. passages: vec_id,
    embedding and the spans; key: the passage's document. The scan itself carries each document's best passage, so no
    vector is shuffled."""
    hits = dense_hits(queries, passages, k, key=key, spans=True)
    best = hits.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("c"), "vec_id", "byte_offset", "byte_length")).alias("_b"))
    return top(best.withColumn("score", -F.col("_b.c")), k).select("query_id", "rank", "doc_id", "score", "_b.byte_offset", "_b.byte_length")


def bounds(queries: DataFrame, index: Index) -> DataFrame:
    """Per query and term, rarest first: the most that the term can add to a score, and the most that it and all
    commoner terms can add together; terms whose rest cannot lift a document over the k-th score need no new candidates."""
    terms = weighted(queries, index).select("query_id", "term", (F.col("idf") * (S.K1 + 1)).alias("bound"))
    rest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term").rowsBetween(0, Window.unboundedFollowing)
    return terms.select("query_id", "term", F.round("bound", 6).alias("bound"), F.round(F.sum("bound").over(rest), 6).alias("rest"))


def pruned(queries: DataFrame, index: Index, k: int = 10, first: int = 2) -> DataFrame:
    """The same k best documents with fewer postings scored. The `first` rarest terms of a query give a score that k
    documents reach; a term belongs to the essential ones as long as it and all commoner terms could lift a document to
    it. Only documents with an essential term are scored, by all terms."""
    order = [F.desc("idf"), F.asc("term")]
    rest = F.sum(F.col("idf") * (S.K1 + 1)).over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    terms = weighted(queries, index).withColumns({"_rest": rest, "_place": F.row_number().over(Window.partitionBy("query_id").orderBy(*order))})
    terms = written(terms, "query-terms")
    part = F.sum(F.col("idf") * S.saturation(F.col("tf"), F.col("doc_len"), F.col("mean_len")))
    post = index.postings
    rare = terms.where(F.col("_place") <= first).join(post, "term").groupBy("query_id", "doc_id").agg(part.alias("score"))
    reached = kth(rare, k).select("query_id", F.col("kth").alias("_kth"))
    essential = terms.join(reached, "query_id", "left").where(F.col("_rest") >= F.coalesce("_kth", F.lit(0.0)) - 1e-6).select("query_id", "term")
    candidates = essential.join(post.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct()
    scores = terms.join(post, "term").join(candidates, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(F.round(part, 6).alias("score"))
    return top(scores, k).select("query_id", "rank", "doc_id", "score")


def kth(hits: DataFrame, k: int) -> DataFrame:
    """The k-th largest score of every query that has as many hits."""
    return top(hits, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length one, and which of them are whole: of the dimension, finite, not zero."""
    out, good = np.zeros((len(column), dim)), np.zeros(len(column), bool)
    if column.null_count == 0 and len(column) and (pc.list_value_length(column).to_numpy() == dim).all() and column.flatten().null_count == 0:
        out = column.flatten().to_numpy().astype(float).reshape(-1, dim)
    else:
        for i, x in enumerate(column.to_pylist()):
            if x is not None and len(x) == dim and None not in x:
                out[i] = x
    norm = np.sqrt((out * out).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return out / np.where(good, norm, 1)[:, None], good


def dense_hits(queries: DataFrame, passages: DataFrame, k: int, key: Column | None = None, others_only: bool = False, spans: bool = False) -> DataFrame:
    """At least the k best passages of every query by cosine, by (query_id, doc_id). queries: query_id, embedding;
    passages: vec_id, embedding. With `key` a document is known by it and its best passage counts (all pass on);
    with spans a block's k best documents pass on with that passage's vec_id, byte_offset and byte_length, not yet one
    row a document: a document among the k best of all is so in the block that holds its best passage.
    With others_only a query's own id is no hit. Query vectors beyond VECTOR_BOUND go in several rounds."""
    extra = ["byte_offset", "byte_length"] if spans else []
    shape = ", ".join([HITS, "vec_id long", *(f"{c} {passages.schema[c].dataType.simpleString()}" for c in extra)]) if spans else HITS
    p = passages.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", (F.col("vec_id") if key is None else key).cast("long").alias("_key"), *extra)
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    size = q.where("embedding IS NOT NULL").agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not size[0]:
        return queries.sparkSession.createDataFrame([], shape)
    dim, rounds = int(size[1]), -(-int(size[0]) * int(size[1]) // VECTOR_BOUND)
    out = None
    for n in range(rounds):
        part = q if rounds == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == n)
        got = part.toArrow()
        x, good = unit_rows(got.column("embedding").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())), dim)
        names = np.array(got.column("query_id").to_pylist(), np.int64)[good]
        more = p.mapInArrow(dense_run(p.sparkSession.sparkContext.broadcast((names, x[good])), dim, k, key is not None, others_only, spans), shape)
        out = more if out is None else out.union(more)
    return out if key is None or spans else out.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def dense_run(sent, dim: int, k: int, keyed: bool, others_only: bool, spans: bool = False) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for b in batches:
            step = max(1, CELLS // max(1, len(names)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                if spans:  # a document's passages one after another, those that win ties first
                    ties = [(part.schema.names[n], "ascending") for n in (2, 0, 3, 4)]
                    part = part.take(pc.sort_indices(part, sort_keys=ties, null_placement="at_start"))
                x, good = unit_rows(part.column(1), dim)
                ids, keys = part.column(0).to_numpy()[good], part.column(2).to_numpy()[good]
                order = np.argsort(keys if keyed else ids, kind="stable")
                ids, keys, x = ids[order], keys[order], x[good][order]
                s = np.round(q @ x.T, 6)
                if others_only:
                    s[names[:, None] == ids[None]] = -np.inf
                if keyed and len(keys):
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    every, s, keys = s, np.maximum.reduceat(s, first, axis=1), keys[first]
                    if spans:
                        r, c = best_of(keys, s, k)
                        size = np.diff(np.append(first, len(ids)))
                        at_best = np.where(every == np.repeat(s, size, axis=1), np.arange(len(ids)), len(ids))
                        won = np.minimum.reduceat(at_best, first, axis=1)[r, c]
                        rest = part.take(pa.array(np.flatnonzero(good)[order][won]))
                        hits = hits_batch(names[r], keys[c], s[r, c])
                        yield pa.RecordBatch.from_arrays([*hits.columns, rest.column(0), rest.column(3), rest.column(4)], [*hits.schema.names, "vec_id", "byte_offset", "byte_length"])
                        continue
                    r, c = np.nonzero(np.isfinite(s))
                else:
                    r, c = best_of(ids, s, k)
                if not spans:
                    yield hits_batch(names[r], keys[c], s[r, c])

    return run


def dense(queries: DataFrame, passages: DataFrame, k: int = 10, **options) -> DataFrame:
    return top(dense_hits(queries, passages, k, **options), k).select("query_id", "rank", "doc_id", "score")


def fused(lists: DataFrame, k: int, weight: Column | float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists."""
    s = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(S.rrf(F.col("rank"), weight)), 9).alias("score"))
    return top(s, k).select("query_id", "rank", "doc_id", "score")


def fused_lists(lists: list[DataFrame], k: int, weights: list[float] | None = None) -> DataFrame:
    """The same for separate lists with a weight each; weights that are missing, too few or not positive all count as one."""
    if weights is None or len(weights) != len(lists) or min(weights) <= 0:
        weights = [1.0] * len(lists)
    rows = [x.select("query_id", "doc_id", "rank", F.lit(float(w)).alias("_w")) for x, w in zip(lists, weights)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return fused(every, k, F.col("_w"))


def best_ranked(lists: DataFrame, k: int) -> DataFrame:
    """The variant that keeps the best place of any list."""
    s = lists.groupBy("query_id", "doc_id").agg(F.round(F.max(S.best_rank(F.col("rank"))), 9).alias("score"))
    return top(s, k).select("query_id", "rank", "doc_id", "score")


def like_terms(index: Index, sources: DataFrame, n: int = 10) -> DataFrame:
    """The n most telling terms of each source document: tf (ln N - ln df), common terms left out."""
    mine = exploded(index.rows.join(sources.select("doc_id").distinct(), "doc_id", "left_semi"))
    s = mine.join(index.terms, "term").crossJoin(F.broadcast(index.stats)).withColumn("_i", F.log("n_docs") - F.log("df")).where("_i > 0")
    return ranked_terms(s.select(F.col("doc_id").alias("query_id"), "term", F.round(F.col("tf") * F.col("_i"), 6).alias("score")), n)


def feedback_terms(hits: DataFrame, docs: DataFrame, queries: DataFrame, top_docs: int = 10, chars: int = 2000, floor: int = 2, n: int = 5, least_hits: int = 3) -> DataFrame:
    """Terms that several of a query's first documents hold and the query does not; none for a query with fewer than
    least_hits hits."""
    hits = written(hits, "hits")  # read twice
    enough = hits.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_hits).select("query_id")
    wanted = hits.where(F.col("rank") <= top_docs).join(enough, "query_id", "left_semi").select("query_id", "doc_id")
    heads = docs.select("doc_id", F.substring("text", 1, chars).alias("_h")).join(wanted.select("doc_id").distinct(), "doc_id")
    words = heads.select("doc_id", F.array_distinct(T.tokens(F.col("_h"))).alias("_t"))
    rows = wanted.join(words, "doc_id").select("query_id", F.explode("_t").alias("term"))
    counted = rows.groupBy("query_id", "term").agg(F.count("*").alias("score")).where(F.col("score") >= floor)
    new = counted.join(query_terms(queries), ["query_id", "term"], "left_anti")
    return top(new, n, tie="term").select("query_id", "rank", "term", F.col("score").alias("n_docs"))
