"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over chunks of CHUNK places that cover the whole document, each overlapping the next
by half; each filter is max-pooled in a chunk, and the largest and the mean chunk response of every filter are combined
into one probability. A filter over one-hot bytes is a table of one weight per offset and byte, so inference is a sum of
WIDTH table look-ups, and a chunk's maximum is the greater of its halves' maxima.

Nulls: a null text is an empty one; empty texts get the probability of an all-zero pooled vector, a constant of the
model; a text of fewer than WIDTH bytes is padded with zero bytes. Without labelled rows, or with one class only, the score is that class's share (0.5 without any). Very long texts are scored chunk
by chunk. Empty tables give empty results; repeated rows are scored one by one; extra columns are ignored by `score`
and kept by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_schema, held_out, labelled_sample, per_batch, prepare, strings, table

WIDTH, FILTERS, CHUNK = 5, 12, 512
HALF = CHUNK // 2
#: Bounded sample of labelled rows for fitting.
SAMPLE_ROWS = 2500
QUALITY_THRESHOLD = 0.3


def of_chunks(halves: np.ndarray) -> np.ndarray:
    """Responses of chunks, each two neighbouring halves; a text of one half is one chunk."""
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


@dataclass
class ByteConvNet:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (2 * FILTERS,)
    offset: float

    def chunks(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, pooled responses per half chunk, and the responses with their first places."""
        data = text.encode("utf-8", "surrogatepass")
        x = np.frombuffer(data.ljust(WIDTH, b"\0") if data else data, np.uint8)
        n = len(x) - WIDTH + 1
        if n <= 0:
            return x, np.zeros((0, FILTERS), np.float32), []
        parts, places = [], []
        for start in range(0, n, CHUNK * 64):  # bounded memory for very long texts
            stop = min(n, start + CHUNK * 64)
            r = self.taps[0].take(x[start:stop], axis=0)
            for k in range(1, WIDTH):
                r += self.taps[k].take(x[start + k : stop + k], axis=0)
            full = (stop - start) // HALF
            if full:
                v = r[: full * HALF].reshape(full, HALF, FILTERS)
                parts.append(v.max(axis=1))
                places.append((v, start))
            if (stop - start) % HALF:
                v = r[full * HALF :][None]
                parts.append(v.max(axis=1))
                places.append((v, start + full * HALF))
        return x, np.concatenate(parts), places

    def pooled(self, halves: np.ndarray) -> np.ndarray:
        if not len(halves):
            return np.zeros(2 * FILTERS, np.float32)
        act = np.maximum(of_chunks(halves) + self.bias, 0)
        return np.concatenate([act.max(axis=0), act.mean(axis=0)])

    def probability(self, text: str) -> float:
        z = float(self.pooled(self.chunks(text)[1]) @ self.dense) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[str, int]], epochs: int = 6, rate: float = 0.02, seed: int = 7) -> ByteConvNet:
    """Adam on the log loss; the gradient of a max-pool goes to the place of the maximum alone."""
    rng = np.random.default_rng(seed)
    net = ByteConvNet(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)
    share = float(np.mean([y for _, y in rows])) if rows else 0.5
    net.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if share in (0.0, 1.0) or not rows:
        net.dense[:] = 0
        return net
    params = [net.taps, net.bias, net.dense, np.array([net.offset], np.float32)]
    moment, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 16):
            grads = [np.zeros_like(p) for p in params]
            for i in order[at : at + 16]:
                text, y = rows[i]
                x, halves, places = net.chunks(text)
                top = of_chunks(halves)
                act = np.maximum(top + net.bias, 0) if len(top) else top
                v = net.pooled(halves)
                z = float(v @ net.dense) + float(params[3][0])
                d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                grads[3][0] += d
                grads[2] += d * v
                if not len(top):
                    continue
                g = np.repeat((d * net.dense[FILTERS:] / len(top))[None], len(top), axis=0)
                g[act.argmax(axis=0), np.arange(FILTERS)] += d * net.dense[:FILTERS]
                g = g * (act > 0)
                grads[1] += g.sum(axis=0)
                if len(halves) > 1:  # to the half that holds the maximum
                    late = halves[1:] > halves[:-1]
                    g = np.vstack([np.where(late, 0, g), np.zeros(FILTERS)]) + np.vstack([np.zeros(FILTERS), np.where(late, g, 0)])
                row = 0
                for block, start in places:
                    p = block.argmax(axis=1) + start + (np.arange(len(block)) * HALF)[:, None]
                    gb = g[row : row + len(block)]
                    row += len(block)
                    f = np.broadcast_to(np.arange(FILTERS), p.shape)
                    for k in range(WIDTH):
                        np.add.at(grads[0][k], (x[p + k], f), gb)
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for j, (p, g) in enumerate(zip(params, grads)):
                g = g / 16
                moment[j] += 0.1 * (g - moment[j])
                second[j] += 0.01 * (g * g - second[j])
                p -= lr * (moment[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-6)
    net.offset = float(params[3][0])
    return net


def score(docs: DataFrame, net: ByteConvNet, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        s = [net.probability(t) for t in strings(b.column(1))]
        return {"doc_id": b.column(0), "held_out": b.column(2), "score": s, "predicted": [int(v >= threshold) for v in s]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id"))), run, "doc_id long, held_out boolean, score double, predicted int")


def filter_documents(docs: DataFrame, net: ByteConvNet, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    """The rows scored at least the threshold, with the columns of docs."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array([net.probability(t) >= threshold for t in strings(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, documents_schema(docs))


def trained(docs: DataFrame, labels: DataFrame) -> ByteConvNet:
    return fit(labelled_sample(docs, labels, "quality", SAMPLE_ROWS))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))
