"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encodings of text pieces form a monoid: the element of a byte string is its token sequence, and two neighbours are
joined by re-encoding a window around the seam that grows until the tokens outside it provably stabilise. The proof
rests on one fact about BPE: a token sequence is the encoding of its bytes exactly when every two neighbours in it are,
so a join is right once the pairs at both ends of the window are (and pairs away from the seam already were).
A pre-token is split in halves down to single bytes, whatever its length; the window alone is merged by definition.
Small inner nodes and windows, which recur, are kept in bounded caches.

Above pre-tokens the tree goes on: a long text is halved where a single space stands between two other characters, for
there a pre-token always begins, and the halves' ids are concatenated; decoding concatenates up a tree of halves of ids.
Within a block, words are looked up in a bounded cache; a block with other white space around a cut is split by the
pattern as a whole.

Nulls: a null text is empty; the empty text has no ids, and its hashes are those of the empty string. Very long texts
and pre-tokens take memory in proportion to themselves. Repeated rows are encoded one by one; extra columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import sys
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, prepare, strings, table

#: Entries kept in each of a worker's caches before it starts afresh.
CACHE_ENTRIES = 450_000
#: Entries and longest keys of the caches of inner nodes and windows.
NODE_ENTRIES, NODE_BYTES = 100_000, 16
#: Texts longer than this, and more ids than this, are halved.
BLOCK = 4096

#: Above every rank.
NEVER = 1 << 30

#: A single space between two other characters, looked for from either side.
SEAM, SEAM_BACKWARDS = regex.compile(r"\S \S"), regex.compile(r"(?r)\S \S")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Cache(dict):
    """A function's values by string, in two generations: a full young one becomes the old one, from which strings
    that are still in use come back. Long strings are not kept."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES // 2, longest: int = 64):
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key: str):
        found = self.old[key] if key in self.old else self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class BPE:
    """Vocabulary, with encoding by tree reduction and bounded caches."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.findall = regex.compile(pattern).findall
        self.stable: dict[tuple[int, int], bool] = {}
        self.nodes = Cache(self.reduced, NODE_ENTRIES, NODE_BYTES)
        self.windows = Cache(self.merged, NODE_ENTRIES, NODE_BYTES)
        self.pretokens, self.words, self.firsts = Cache(self.pretoken), Cache(self.word), Cache(self.pieces)
        self.segments = Cache(self.segment)
        #: Joins made and bytes encoded again in their windows.
        self.joins = self.joined = 0

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The encoding by definition: the neighbours of the lowest rank join first, the left-most of equals."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pair = [ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == NEVER:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return tuple([ranks[p] for p in parts])

    def settled(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) >= CACHE_ENTRIES:
                self.stable.clear()
            found = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the two's bytes together: a window around the seam, doubled on a side as long as the pair at
        its end there is not settled."""
        self.joins += 1
        if self.settled(left[-1], right[0]):
            return left + right
        i, j, of = 1, 1, self.bytes_of
        while True:
            around = b"".join([of[t] for t in (*left[len(left) - i :], *right[:j])])
            self.joined += len(around)
            window = self.windows[around]
            good_left = i == len(left) or self.settled(left[-i - 1], window[0])
            good_right = j == len(right) or self.settled(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            if not good_left:
                i = min(len(left), i * 2)
            if not good_right:
                j = min(len(right), j * 2)

    def reduced(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a byte string: single bytes are the leaves, every inner node joins its halves."""
        if len(data) == 1:
            return (self.ranks[data],)
        mid = len(data) >> 1
        nodes = self.nodes
        return self.join(nodes[data[:mid]], nodes[data[mid:]])

    def pretoken(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)  # the library, too, takes a pre-token that is a token as it is
        return self.reduced(data) if whole is None else (whole,)

    def pieces(self, text: str) -> bytes:
        """Ids of a text split by the pattern, as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for p in (text,) if text.isalpha() or text[:1] == " " and text[1:].isalpha() else self.findall(text):
            ids += self.pretokens[p]
        return packed(ids)

    def word(self, word: str) -> bytes | None:
        """Ids of a space and a word; None if white space at its ends forbids to cut here."""
        return None if not word or word[0].isspace() or word[-1].isspace() else self.pieces(" " + word)

    def segment(self, word: str) -> tuple[int, int]:
        """Bytes and tokens of a space and a word."""
        return self.measured(" " + word)

    def measured(self, text: str) -> tuple[int, int]:
        return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")), len(self.pieces(text)) // 4

    def word_list(self, text: str) -> list[bytes]:
        """Ids of a text in parts that concatenate to the whole."""
        if not text:
            return []
        words = text.split(" ")
        first = words[0]
        if first and (first[0].isspace() or first[-1].isspace()):
            return [self.pieces(text)]
        out = [*([self.firsts[first]] if first else []), *map(self.words.__getitem__, words[1:])]
        return [self.pieces(text)] if None in out else out

    def halves(self, text: str) -> tuple[str, str] | None:
        """The text cut before a single space between two other characters: the first such place after its middle, or
        else the last one before it."""
        mid = len(text) >> 1
        if after := SEAM.search(text, mid):
            at = after.start() + 1
        elif before := SEAM_BACKWARDS.search(text, 0, mid + 2):
            at = before.start() + 1
        else:
            return None
        return text[:at], text[at:]

    def encoded(self, text: str) -> bytes:
        """Ids of a text: its halves' ids joined. Nothing needs to be encoded again at a seam where a pre-token
        begins whatever stands on either side."""
        if len(text) > BLOCK and (parts := self.halves(text)):
            return self.encoded(parts[0]) + self.encoded(parts[1])
        return b"".join(self.word_list(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoded(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, concatenated up the tree of halves."""
        if len(ids) > BLOCK:
            mid = len(ids) >> 1
            return self.decode(ids[:mid]) + self.decode(ids[mid:])
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> BPE:
    """Read once per worker; every machine has the tokenizer files."""
    return BPE(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array of every whole text."""

    def run(b: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        return {"doc_id": b.column(0), "ids": [v.encode(t).astype(np.int32) for t in strings(b.column(1))]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""

    def run(b: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        return {"doc_id": b.column(0), "text": [v.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]}

    return per_batch(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of every text's ids and of the bytes that these decode to."""

    def run(b: pa.RecordBatch) -> dict:
        v, n, ids_sha, text_sha = vocabulary(path), [], [], []
        for t in strings(b.column(1)):
            ids = v.encode(t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
        return {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
