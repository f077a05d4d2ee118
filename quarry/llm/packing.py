"""Best-fit packing under several capacities (vector best fit).

A sequence has room for tokens, for documents and for attention cost (the sum of squared lengths). A piece goes to the
open sequence that it fits under every constraint and that it leaves with the smallest weighted norm of what remains
(or, with rule="dot", the largest weighted dot product of its needs with what remains); pieces come longest first.

Only lengths matter to the choice, and lengths are whole numbers up to the capacity, so the decisions are made for
the histogram of lengths: equal open sequences are one class with a count, and equal pieces are placed many at a time
exactly as one by one. The histogram has at most `tokens` rows and the classes at most a few per length, whatever the
size of the corpus. By the norm rule a sequence that took a piece stays the best for the next of its length, so it is
filled at once; by the dot rule it falls back, so every sequence of the best class takes one piece. Every piece then finds its place from its rank among the pieces of its length. Ranks come from a
count per (length, bucket) and a row number inside each; buckets are salted by document, so a very common length is
spread over many tasks.

Nulls: a null text is empty: one end-of-text id. A null doc_id is packed like others. Only documents longer than a
sequence are cut. Repeated rows are packed each. Ties: pieces of one length take ranks by doc_id, piece and content; among equally good sequences
the one with the least room (tokens, then documents, then attention) is taken. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import functools
import json
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import per_batch, prepare, strings, table, written

TOKENS = 2048
END_ID = 0
CACHE_ENTRIES = 450_000


@dataclass(frozen=True)
class Capacity:
    """Room of a sequence and the weight of each dimension. The defaults of documents and attention never bind:
    every piece has a token, and squares of parts sum to no more than the square of the sum."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file: white space separates words, whose ids do not depend on others.

    Plain words (ASCII and precomposed Latin letters) are merged by a rank table in which the end of a word is one more
    byte that joins the last letter before all else; everything else goes through the file's own tokenizer.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {}
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(byte[x] for x in token.removesuffix("</w>")) + b"\xff" * end] = i
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x21-\x7eÀ-įı-ňŊ-ž]+").fullmatch
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if self.plain(word):
            low = word.lower()
            ids: list[int] = []
            for p in (low,) if low.isalpha() else self.split(low):
                ids += self.core.encode_single_piece(p.encode() + b"\xff")
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to str.split alone
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, word = self.cache.get, self.word
        out = []
        for w in text.split():
            ids = get(w)
            out.append(word(w) if ids is None else ids)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, most: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than most."""

    def run(b: pa.RecordBatch) -> dict:
        t = word_tokenizer(path)
        out: dict = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        end = np.array([END_ID], "<u4").tobytes()
        for i, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
            ids = memoryview(t.encode(text) + end)
            for k, at in enumerate(range(0, len(ids), 4 * most)):
                part = ids[at : at + 4 * most]
                out["doc_id"].append(i)
                out["piece"].append(k)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
        return out

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def badness(left: np.ndarray, need: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """How badly sequences with `left` suit a piece: the norm of what would remain, or minus the dot product."""
    if rule == "dot":
        return -((left * weights) * (need * weights)).sum(axis=1)
    return (((left - need) * weights) ** 2).sum(axis=1)


def best_fit(counts: dict[int, int], cap: Capacity = Capacity()) -> np.ndarray:
    """Places for every rank of every length: rows (length, first rank, ranks, per sequence, first sequence, offset).

    A class of equal open sequences is [count, tokens left, documents left, attention left, items], an item being
    (length, pieces per sequence, first rank, offset).
    """
    classes: list[list] = []
    room = np.zeros((0, 3), np.int64)  # what remains in each class
    weights = np.array(cap.weights) / np.array([cap.tokens, cap.documents, cap.attention], float)

    def most(left: np.ndarray, length: int) -> int:
        """Pieces of a length that fit what is left."""
        return int(min(left[0] // length, left[1], left[2] // (length * length)))

    def add(count: int, left: np.ndarray, items: list) -> None:
        nonlocal room
        if count:
            classes.append([count, items])
            room = np.vstack([room, left[None]])

    full = np.array([cap.tokens, cap.documents, cap.attention], np.int64)
    done: list[tuple[int, list]] = []
    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if most(full, length) < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = np.flatnonzero((room >= need).all(axis=1))
            if len(fits):
                left = room[fits]
                cost = badness(left, need, weights, cap.rule)
                ties = fits[cost == cost.min()]
                best = int(ties[np.lexsort(room[ties].T[::-1])[0]])
                count, items = classes[best]
                left = room[best].copy()
            else:
                best, count, items, left = -1, -1, [], full
            per = 1 if best >= 0 and cap.rule == "dot" else most(left, length)
            offset = cap.tokens - int(left[0])
            if best < 0:
                count = -(-todo // per)
            n = min(count, todo // per)
            rest = todo - n * per if n < count else 0
            if best >= 0:
                del classes[best]
                room = np.delete(room, best, axis=0)
            if n:
                add(n, left - per * need, [*items, (length, per, rank, offset)])
            if rest:
                moved = [(a, q, r + n * q, o) for a, q, r, o in items]
                add(1, left - rest * need, [*moved, (length, rest, rank + n * per, offset)])
            used = n + bool(rest)
            if best >= 0:
                add(count - used, left, [(a, q, r + used * q, o) for a, q, r, o in items])
            rank += n * per + rest
            todo -= n * per + rest
        # Sequences without room for the shortest piece that is still to come are closed.
        shut = np.flatnonzero((room[:, 0] < min(counts)) | (room[:, 1] < 1))
        for k in sorted(shut, reverse=True):
            done.append((classes[k][0], classes[k][1]))
            del classes[k]
        room = np.delete(room, shut, axis=0)
    done += [(c, items) for c, items in classes]
    rows, base = [], 0
    for count, items in done:
        rows += [(length, first, count * per, per, base, offset) for length, per, first, offset in items]
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, cap: Capacity = Capacity(), buckets: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length, ids_crc32.

    cut is read twice and should be a written table.
    """
    spark = cut.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = buckets or int(min(65536, max(64, sum(counts.values()) // 1_000_000)))
    salted = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per_bucket = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_bucket.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    here = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(here)).join(offsets, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_row") - 1).cast("long").alias("_rank"))
    places = spark.sparkContext.broadcast(best_fit(counts, cap))
    at, names = {c: k for k, c in enumerate(ranked.columns)}, cut.columns

    def run(b: pa.RecordBatch) -> dict:
        p = places.value
        length, rank = b.column(at["length"]).to_numpy(), b.column(at["_rank"]).to_numpy()
        base = int((p[:, 1] + p[:, 2]).max()) + 1
        k = np.searchsorted(p[:, 0].astype(object) * base + p[:, 1] if base > 1 << 50 else p[:, 0] * base + p[:, 1], length * base + rank, side="right") - 1
        row = p[k]
        within = rank - row[:, 1]
        return {c: b.column(at[c]) for c in names} | {"sequence_id": row[:, 4] + within // row[:, 3], "offset": row[:, 5] + within % row[:, 3] * length}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return per_batch(ranked, run, schema + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, cap: Capacity = Capacity()) -> DataFrame:
    return pack(written(pieces(docs, path, cap.tokens), "pieces"), cap)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
