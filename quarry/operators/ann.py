"""Approximate neighbours: proximity graphs per shard, product quantisation. The exact way is retrieve.dense.

Graphs are built and searched inside a task over one shard of passages; every query visits every shard and the shards'
hits are merged, so recall does not depend on the number of shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import CELLS, HITS, VECTOR_BOUND, hits_batch, top, unit_rows

#: Passages of a shard.
SHARD_ROWS = 4096


@dataclass(frozen=True)
class GraphSettings:
    """Links of a node above the ground layer and on it, and how many candidates building and searching keep."""

    links: int = 16
    ground_links: int = 32
    build_width: int = 200
    search_width: int = 50
    seed: int = 42


class Graph:
    """A layered proximity graph over unit vectors; nearness is the inner product."""

    def __init__(self, dim: int, settings: GraphSettings = GraphSettings()):
        self.s, self.x = settings, np.zeros((16, dim))
        self.levels: list[int] = []
        self.near: list[list[np.ndarray]] = []  # per node and layer its neighbours
        self.entry, self.alive = -1, np.zeros(16, bool)
        self.rng = np.random.default_rng(settings.seed)

    def __len__(self) -> int:
        return len(self.levels)

    def walk(self, q: np.ndarray, entries: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The `width` nearest nodes that a best-first walk finds, best first."""
        seen = np.zeros(len(self.levels), bool)
        seen[entries] = True
        scores = self.x[entries] @ q
        open_ = [(-float(s), n) for s, n in zip(scores, entries)]
        heapq.heapify(open_)
        best = [(float(s), n) for s, n in zip(scores, entries)]
        heapq.heapify(best)
        while open_:
            gap, n = heapq.heappop(open_)
            if len(best) >= width and -gap < best[0][0]:
                break
            new = self.near[n][layer]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for s, m in zip((self.x[new] @ q).tolist(), new.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, m))
                    heapq.heappush(open_, (-s, m))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, m))
                    heapq.heappush(open_, (-s, m))
        return sorted(best, reverse=True)

    def chosen(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours nearer to the node than to one already taken; the nearest of the rest fill up."""
        take: list[int] = []
        rest: list[int] = []
        for s, n in found:
            if len(take) >= most:
                break
            if take and float((self.x[take] @ self.x[n]).max()) > s:
                rest.append(n)
            else:
                take.append(n)
        return np.array([*take, *rest[: most - len(take)]], np.int64)

    def add(self, v: np.ndarray) -> None:
        n, s = len(self.levels), self.s
        if n == len(self.x):
            self.x = np.vstack([self.x, np.zeros_like(self.x)])
            self.alive = np.concatenate([self.alive, np.zeros(n, bool)])
        self.x[n], self.alive[n] = v, True
        level = int(-np.log(max(self.rng.random(), 1e-12)) / np.log(s.links))
        self.levels.append(level)
        self.near.append([np.zeros(0, np.int64) for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = n
            return
        entries = [self.entry]
        for layer in range(self.levels[self.entry], -1, -1):
            if layer > level:
                entries = [self.walk(v, entries, layer, 1)[0][1]]
                continue
            found = [f for f in self.walk(v, entries, layer, s.build_width) if f[1] != n]
            most = s.links if layer else s.ground_links
            self.near[n][layer] = self.chosen(found, s.links)
            for m in self.near[n][layer].tolist():
                links = np.append(self.near[m][layer], n)
                if len(links) > most:
                    order = np.argsort(-(self.x[links] @ self.x[m]), kind="stable")
                    links = self.chosen([(float(self.x[i] @ self.x[m]), int(i)) for i in links[order]], most)
                self.near[m][layer] = links
            entries = [f[1] for f in found] or entries
        if level > self.levels[self.entry]:
            self.entry = n

    def remove(self, n: int) -> None:
        """A removed node still leads the way but is no hit."""
        self.alive[n] = False

    def compacted(self) -> Graph:
        """The graph built anew from the nodes that are left."""
        g = Graph(self.x.shape[1], self.s)
        for n in np.flatnonzero(self.alive[: len(self)]):
            g.add(self.x[n])
        return g

    def search(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        entries = [self.entry]
        for layer in range(self.levels[self.entry], 0, -1):
            entries = [self.walk(q, entries, layer, 1)[0][1]]
        return [f for f in self.walk(q, entries, 0, max(self.s.search_width, k)) if self.alive[f[1]]][:k]


def sent_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a bounded query table."""
    got = queries.select(F.col("query_id").cast("long"), "embedding").where("embedding IS NOT NULL").limit(VECTOR_BOUND).toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    dim = max(map(len, got.column(1).to_pylist()))
    if got.num_rows * dim > VECTOR_BOUND:
        raise ValueError("too many query vectors at once: search them in parts, or with retrieve.dense")
    x, good = unit_rows(got.column(1).combine_chunks(), dim)
    return got.column(0).to_numpy()[good], x[good]


def graph_search(queries: DataFrame, passages: DataFrame, k: int = 10, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """query_id, rank, doc_id, score of the hits of all shards' graphs. passages: vec_id, embedding."""
    names, q = sent_queries(queries)
    sent = passages.sparkSession.sparkContext.broadcast((names, q))
    shards = max(1, -(-passages.count() // SHARD_ROWS))
    dealt = passages.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("_shard"))

    def run(t: pa.Table) -> pa.Table:
        names, q = sent.value
        x, good = unit_rows(t.column("embedding").combine_chunks(), q.shape[1])
        ids, x = t.column("vec_id").to_numpy()[good], x[good]
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        g = Graph(q.shape[1], settings)
        for v in x:
            g.add(v)
        out = [(n, ids[i], round(s, 6)) for n, v in zip(names.tolist(), q) for s, i in g.search(v, k)]
        return pa.Table.from_batches([hits_batch(*([r[c] for r in out] for c in range(3)))])

    hits = dealt.groupBy("_shard").applyInArrow(run, HITS)
    return top(hits, k).select("query_id", "rank", "doc_id", "score")


# --- product quantisation


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids: means of the nearest rows, an empty one moves to the row farthest from its own."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = squared_distances(x, centres)
        own = d.argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for e in np.flatnonzero(n == 0):
            new[e] = x[int(d[np.arange(len(x)), own].argmax())]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


@dataclass
class Codebook:
    """Centroids of every part of a vector."""

    centres: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centres[0].shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        w = self.width
        return np.stack([squared_distances(x[:, m * w : (m + 1) * w], c).argmin(axis=1) for m, c in enumerate(self.centres)], axis=1).astype(np.uint16)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([c[codes[:, m]] for m, c in enumerate(self.centres)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of every part of a query to every centroid."""
        w = self.width
        return np.stack([squared_distances(q[None, m * w : (m + 1) * w], c)[0] for m, c in enumerate(self.centres)])

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.tables(q)[np.arange(codes.shape[1])[None], codes].sum(axis=1)


#: Rows that a codebook is trained on at most.
TRAIN_ROWS = 20_000


def train_codebook(passages: DataFrame, parts: int = 8, centroids: int = 64, rounds: int = 15, rows: int = TRAIN_ROWS, seed: int = 42) -> Codebook:
    """A codebook trained on a bounded sample, the `rows` smallest hashes of ids. The dimension must divide by parts."""
    got = passages.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toArrow()
    if not got.num_rows:
        raise ValueError("no vector to train on")
    dim = len(got.column(0)[0].as_py())
    if dim % parts:
        raise ValueError(f"{dim} components do not divide into {parts} parts")
    x, good = unit_rows(got.column(0).combine_chunks(), dim)
    rng = np.random.default_rng(seed)
    w = dim // parts
    return Codebook([k_means(x[good][:, m * w : (m + 1) * w], centroids, rounds, rng) for m in range(parts)])


def fine_codes(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What codes leave of vectors as a signed byte per component, the step of a vector's bytes, and a bound of the length
    of what these leave in turn."""
    step = np.abs(rest).max(axis=1, initial=0) / 127
    fine = np.rint(rest / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
    return fine, step, np.linalg.norm(rest - fine * step[:, None], axis=1) + 1e-9


def twins_before(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many equal vectors with a smaller id each one has."""
    _, of = np.unique(x, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.lexsort((ids, of))
    n = np.arange(len(ids))
    new = np.concatenate([[True], of[order][1:] != of[order][:-1]])[: len(ids)]
    out = np.empty(len(ids), np.int64)
    out[order] = n - np.maximum.accumulate(np.where(new, n, 0))
    return out


def encoded(passages: DataFrame, book: Codebook) -> DataFrame:
    """vec_id and code (array of small numbers) of every whole vector; fine, step and gap by fine_codes; twins, equal
    vectors with a smaller id in its batch."""
    dim = book.width * len(book.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = unit_rows(b.column(1), dim)
            ids, x = b.column(0).filter(pa.array(good)), x[good]
            codes = book.encode(x)
            fine, step, gap = fine_codes(x - book.decoded(codes))
            columns = [ids, pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([f.tobytes() for f in fine], pa.binary()), pa.array(step), pa.array(gap)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(twins_before(ids.to_numpy(), x), pa.int64())], ["vec_id", "code", "fine", "step", "gap", "twins"])

    return passages.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, code array<int>, fine binary, step double, gap double, twins long")


#: Scores are rounded to six digits; bounds that differ by less than this may belong to a tie.
SLACK = 2e-6


def near_codes(sent, book: Codebook, codes: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id of all passages that can be among the k best of a query. A passage's score is its codes' inner
    product with the query, give or take gap, as query vectors have length one; a passage falls out only if k others
    surely score higher, or if k equal ones have smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for b in batches if len(names) else ():
            size = max(1, CELLS // max(1, len(names)))
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids, step, gap = (part.column(n).to_numpy() for n in (0, 3, 4))
                fine = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int8).reshape(len(ids), -1)
                s = q @ (book.decoded(np.array(part.column(1).to_pylist(), np.int64)) + fine * step[:, None]).T
                r, c = np.arange(len(names)).repeat(len(ids)), np.tile(np.arange(len(ids)), len(names))
                if len(ids) > k:
                    least = np.partition(s - gap, len(ids) - k, axis=1)[:, len(ids) - k]
                    r, c = np.nonzero(s + gap + SLACK >= least[:, None])
                hits = hits_batch(names[r], ids[c], s[r, c])
                yield pa.RecordBatch.from_arrays([*hits.columns, pa.array(gap[c])], [*hits.schema.names, "gap"])

    rows = codes.where(F.col("twins") < k).select("vec_id", "code", "fine", "step", "gap").mapInArrow(run, f"{HITS}, gap double")
    low = F.col("score") - F.col("gap")
    every = Window.partitionBy("query_id").orderBy(low.desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.nth_value(low, k).over(every)  # null: fewer than k
    return rows.withColumn("_l", least).where(F.col("_l").isNull() | (F.col("score") + F.col("gap") + SLACK >= F.col("_l"))).select("query_id", "doc_id")


def code_search(queries: DataFrame, codes: DataFrame, book: Codebook, passages: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The k nearest codes of every query; with passages, all that can be among the k best by their codes and the codes'
    errors are ranked again by their vectors, so none of the k best is missed."""
    names, q = sent_queries(queries)
    sent = codes.sparkSession.sparkContext.broadcast((names, q))
    if passages is not None:
        return ranked_again(queries, near_codes(sent, book, codes, k), passages, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, c = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), np.int64)
            out: list[list[np.ndarray]] = [[], [], []]
            for n, v in zip(names, q):
                d = np.round(-book.distances(v, c), 6)
                best = np.lexsort((ids, -d))[:k]
                for col, part in zip(out, (np.full(len(best), n), ids[best], d[best])):
                    col.append(part)
            if out[0]:
                yield hits_batch(*(np.concatenate(x) for x in out))

    return top(codes.select("vec_id", "code").mapInArrow(run, HITS), k).select("query_id", "rank", "doc_id", "score")


def ranked_again(queries: DataFrame, near: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """The k best of near (query_id, doc_id) by the vectors themselves."""
    p = passages.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("_p"))
    both = near.join(p, "doc_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
        return pd.Series(np.round((x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)), 6))

    return top(both.select("query_id", "doc_id", cosine("_q", "_p").alias("score")), k).select("query_id", "rank", "doc_id", "score")


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Share of a query's true hits that were found: query_id, recall."""
    n = truth.groupBy("query_id").agg(F.count("*").alias("_n"))
    hit = truth.select("query_id", "doc_id").join(found.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("_hit"))
    return n.join(hit, "query_id", "left").select("query_id", F.round(F.coalesce("_hit", F.lit(0)) / F.col("_n"), 6).alias("recall"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """Rows, mean, population deviation, and the values at places floor(n p) for p of a half and 0.95."""
    from .ops import value_at

    c = F.col(column)
    base = rows.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("deviation"))
    at = value_at(rows.select(c.alias("_v")), "_v", [0.5, 0.95], lambda n, p: F.least(F.floor(n * p), n - 1))
    return base.crossJoin(at.select(F.col("p50"), F.col("p95")))


def stale_entries(graph: DataFrame, live: DataFrame) -> DataFrame:
    """Passages of a graph whose document is gone: what reconciling removes."""
    return graph.join(live.select("doc_id").distinct(), "doc_id", "left_anti")
