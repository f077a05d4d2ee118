"""Exact top-k by inner product as a Voronoi kNN join.

A largest inner product is a smallest distance once data vectors get one more component that makes their norms equal:
|q - x|^2 = |q|^2 + M^2 - 2 q.x. So pivots split the data into Voronoi cells; one summary per cell (count, the least
and greatest distance to the pivot, the k + 1 least distances) bounds how far the k-th neighbour of any query of a
query cell can be; a data vector goes only to those groups of query cells for which the triangle inequality cannot
rule it out, and each group is solved locally, again skipping cells that the bounds rule out per query. Bounds are
widened by a relative 1e-9, so rounding never prunes; scores are whole numbers computed exactly.

Query cells are gathered into groups of at most GROUP_QUERIES queries (larger cells are split), and what a group receives is dealt to blocks of about
BLOCK_ROWS rows by a salt, so neither a hot cell nor one very common vector makes a large task; a block holds its
rows and its group's queries alone.

Pivots are a sample (rows by hash) that grows with the square root of the data, up to PIVOTS. Vectors that are null or
hold null or non-finite components, or have a null id, take no part; shorter vectors count as padded with zeros.
Products are taken in float64 as long as they are sure to be whole there (squared norms under 2^53), else in int64; a
squared norm of 2^63 or more, for which scores might not fit a long, raises ValueError. Ties go to the smaller id. With fewer than k
candidates all are returned. A query's own id is never its candidate; rows that repeat an id count each. Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, prepare, table, written

PIVOTS = 2048
GROUP_QUERIES = 4096
BLOCK_ROWS = 4096
SLACK = 1e-9
#: Squared norms below the first are whole in float64, below the second in int64.
EXACT, LONG = 1 << 53, 1 << 63


def whole_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * component) of the vectors that take part, packed: a byte that tells the width of an
    integer, then little-endian integers of the least width that holds them."""

    def run(b: pa.RecordBatch) -> dict:
        ids, vecs, norms, dims = [], [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            w = np.floor(scale * x)
            norm2 = float(w @ w)
            norm2 = int(norm2) if norm2 < EXACT else sum(int(c) ** 2 for c in w.tolist())
            if norm2 >= LONG:
                raise ValueError("components too large: scores might not fit a long")
            most = float(np.abs(w).max(initial=0))
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            ids.append(i)
            vecs.append(bytes([width]) + w.astype(f"<i{width}").tobytes())
            norms.append(norm2)
            dims.append(len(w))
        return {"vec_id": ids, "v": vecs, "norm2": norms, "dim": dims}

    return per_batch(rows.select(F.col("vec_id").cast("long"), "embedding"), run, "vec_id long, v binary, norm2 long, dim int")


def unpacked(cells: list[bytes], dim: int, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(cells), dim), kind)
    for k, c in enumerate(cells):
        x = np.frombuffer(c, f"<i{c[0]}", offset=1)
        out[k, : len(x)] = x
    return out


def to_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each augmented vector, and its distance."""
    full = np.hstack([x, extra[:, None]])
    d2 = (full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * full @ pivots.T
    cell = d2.argmin(axis=1)
    return cell, np.sqrt(np.maximum(((full - pivots[cell]) ** 2).sum(axis=1), 0))


def top_k(data: DataFrame, is_query, k: int, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products. data: rows of whole_vectors, read several times."""
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    stats = data.agg(F.count("*"), F.max("norm2"), F.max("dim")).first()
    if not stats[0]:
        return spark.createDataFrame([], schema)
    m2, dim = int(stats[1]), int(stats[2])
    kind = np.float64 if m2 < EXACT else np.int64
    none = -np.inf if m2 < EXACT else np.iinfo(np.int64).min  # no score is as small: its square is at most m2 squared
    n_pivots = int(max(1, min(pivots, stats[0] ** 0.5)))
    chosen = data.orderBy(F.xxhash64("v"), "vec_id").select("v", "norm2").limit(n_pivots).collect()
    px = unpacked([bytes(r["v"]) for r in chosen], dim)
    p = np.unique(np.hstack([px, np.sqrt(np.maximum(m2 - (px**2).sum(axis=1), 0))[:, None]]), axis=0)
    n = len(p)

    def assign(b: pa.RecordBatch, query: bool) -> tuple[np.ndarray, np.ndarray]:
        x = unpacked(b.column("v").to_pylist(), dim)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(m2 - b.column("norm2").to_numpy(), 0))
        return to_pivots(x, extra, p)

    def data_cells(b: pa.RecordBatch) -> dict:
        cell, dist = assign(b, False)
        return {"vec_id": b.column("vec_id"), "v": b.column("v"), "cell": cell.astype(np.int32), "dist": dist}

    def query_cells(b: pa.RecordBatch) -> dict:
        cell, dist = assign(b, True)
        return {"vec_id": b.column("vec_id"), "v": b.column("v"), "cell": cell.astype(np.int32), "dist": dist}

    form = "vec_id long, v binary, cell int, dist double"
    s = written(per_batch(data, data_cells, form), "voronoi")
    r = written(per_batch(data.where(is_query), query_cells, form), "voronoi-queries")

    def nearest(batches):
        """Per task and cell: count, extremes and the k + 1 least distances."""
        held: dict[int, list] = {}
        for b in batches:
            cell, dist = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell):
                d = dist[cell == c]
                h = held.setdefault(int(c), [0, 0.0, np.zeros(0)])
                h[0] += len(d)
                h[1] = max(h[1], float(d.max()))
                h[2] = np.sort(np.concatenate([h[2], d]))[: k + 1]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1] for h in held.values()]), pa.array([h[2].tolist() for h in held.values()], pa.list_(pa.float64()))], ["cell", "n", "far", "near"]
            )

    partial = s.select("cell", "dist").mapInArrow(nearest, "cell int, n long, far double, near array<double>")
    summary = partial.groupBy("cell").agg(F.sum("n"), F.max("far"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1)).collect()
    n_data, s_far = np.zeros(n, np.int64), np.zeros(n)
    near: list[tuple[int, np.ndarray]] = []
    for c, count, far, least in summary:
        n_data[c], s_far[c] = count, far
        near.append((c, np.array(least)))
    q_rows = r.groupBy("cell").agg(F.count("*"), F.max("dist")).collect()
    if not q_rows:
        return spark.createDataFrame([], schema)
    n_query, q_far = np.zeros(n, np.int64), np.zeros(n)
    for c, count, far in q_rows:
        n_query[c], q_far[c] = count, far
    between = np.stack([np.sqrt(((p - x) ** 2).sum(axis=1)) for x in p])
    wide = SLACK * (1 + float(np.sqrt(m2)))
    # The k-th neighbour (and the query itself) of any query of cell i lies within theta[i].
    theta = np.full(n, np.inf)
    for i in np.flatnonzero(n_query):
        upper = np.sort(np.concatenate([q_far[i] + between[i, c] + least for c, least in near]))
        if len(upper) > k:
            theta[i] = upper[k] + wide
    # Query cells in groups, neighbours by pivot order; a cell of more queries than a group is split.
    groups: list[list[int]] = []
    parts = np.maximum(1, -(-n_query // GROUP_QUERIES))
    first_group = np.full(n, -1)
    open_count = GROUP_QUERIES + 1
    for i in sorted(np.flatnonzero(n_query), key=lambda c: (between[0, c], c)):
        if parts[i] > 1:
            first_group[i] = len(groups)
            groups += [[i]] * int(parts[i])
            open_count = GROUP_QUERIES + 1
        else:
            if open_count + n_query[i] > GROUP_QUERIES:
                groups.append([])
                open_count = 0
            groups[-1].append(i)
            first_group[i] = len(groups) - 1
            open_count += int(n_query[i])
    # Least distance to its pivot at which a vector of cell j is needed by a group.
    needs = np.stack([np.min([between[i] - q_far[i] - theta[i] for i in g], axis=0) - wide for g in groups])
    expected = np.where(needs <= s_far[None], n_data[None], 0).sum(axis=1)
    blocks = np.maximum(1, -(-expected // BLOCK_ROWS))

    def dealt(b: pa.RecordBatch) -> dict:
        ids, cell, dist = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        g, row = np.nonzero(dist[None] >= needs[:, cell])
        return {"g": g.astype(np.int32), "block": (salt[row] % blocks[g].astype(np.uint64)).astype(np.int32)} | {c: b.column(c).take(pa.array(row)) for c in ("vec_id", "v", "cell", "dist")}

    def asked(b: pa.RecordBatch) -> dict:
        ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        g = first_group[cell] + (salt % parts[cell].astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), blocks[g])
        block = np.concatenate([np.arange(x) for x in blocks[g]]) if len(g) else np.zeros(0, np.int64)
        return {"g": g[row].astype(np.int32), "block": block.astype(np.int32)} | {c: b.column(c).take(pa.array(row)) for c in ("vec_id", "v", "cell", "dist")}

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
            x, ids, cell = unpacked(right.column("v").to_pylist(), dim, kind)[order], right.column("vec_id").to_numpy()[order], right.column("cell").to_numpy()[order]
            dist = right.column("dist").to_numpy()[order]
            q, q_ids, q_cell = unpacked(left.column("v").to_pylist(), dim, kind), left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            for c in np.unique(q_cell):
                keep = np.flatnonzero(dist >= between[c, cell] - q_far[c] - theta[c] - wide)
                if not len(keep):
                    continue
                mine = np.flatnonzero(q_cell == c)
                for a in range(0, len(mine), 256):
                    rows = mine[a : a + 256]
                    score = q[rows] @ x[keep].T
                    score[q_ids[rows][:, None] == ids[keep][None]] = none
                    top = min(k, score.shape[1])
                    # All scores above the k-th, then those equal to it from the smallest id on: columns go by id.
                    least = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top][:, None]
                    above, equal = score > least, score == least
                    line, best = np.nonzero((above | equal & (np.cumsum(equal, axis=1) <= top - above.sum(axis=1, keepdims=True))) & (score != none))
                    out[0].append(q_ids[rows][line])
                    out[1].append(ids[keep][best])
                    out[2].append(score[line, best].astype(np.int64))
        cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(cols, ["query_id", "vec_id", "score"])

    keyed = "g int, block int, " + form
    local = per_batch(r, asked, keyed).groupBy("g", "block").cogroup(per_batch(s, dealt, keyed).groupBy("g", "block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    data = written(whole_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(data, F.col("vec_id") % 20 == 0, 20)
