"""Edit-aware token counts: a segment tree over each document's pre-tokens, kept in a table.

A segment is the smallest run of pre-tokens whose split does not depend on what stands around it: a word with the space
before it, mostly. The leaves of a document's tree are runs of at most RUN segments, every node holds the sums of bytes
and tokens below it, and the tree is height-balanced. An edit replaces a byte range: the segments that it touches and
one on either side are cut out of the tree, split and encoded again, and put back; only sums on the paths to them
change. Finding, cutting and joining take a number of steps in proportion to the tree's height.

`build_trees` writes a row per document: its bytes, the bytes and tokens of every segment, and the sums of every leaf.
`updated_trees` and `counted` start from such a table, new or of an earlier run, and encode again no more than the edits
ask for; counts of a document without edits are read off its root. Each edit refers to the text that its predecessors
(in order of `seq`) left. Edits of a document are applied as they stream by, so their number is not bounded by memory.

Nulls: a null text is empty; an edit with null position or id changes nothing, and neither does one for an id that is
not there; a null replacement is empty, null removed bytes are 0. Positions beyond the end are moved to the end; inside
a character, back to its start. Ties in seq are broken by position, removed bytes, replacement. Rows with an equal doc_id
all get the edits of that id. Empty tables give empty results; extra columns are ignored, whatever their names; very
long texts take memory in proportion to themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BPE, vocabulary
from .common import per_batch, prepare, rows_batch, strings, table, written

#: Segments in a leaf at most.
RUN = 64
TREE = "doc_id long, n_bytes long, n_tokens long, data binary, width int, segment_bytes binary, segment_tokens binary, leaf_sums binary"
COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_bytes_after long, n_bytes_encoded_again long"

# A node is (bytes, tokens, height, left, right); a leaf is (bytes, tokens, 0, data, segment bytes, segment tokens).


def node(left: tuple, right: tuple) -> tuple:
    return left[0] + right[0], left[1] + right[1], max(left[2], right[2]) + 1, left, right


def leaf(data: bytes, sizes: list[int], tokens: list[int]) -> tuple:
    return len(data), sum(tokens), 0, data, sizes, tokens


def balanced(left: tuple, right: tuple) -> tuple:
    """A node over two trees whose heights differ by two at most."""
    if left[2] > right[2] + 1:
        a, b = left[3], left[4]
        return node(a, node(b, right)) if a[2] >= b[2] else node(node(a, b[3]), node(b[4], right))
    if right[2] > left[2] + 1:
        a, b = right[3], right[4]
        return node(node(left, a), b) if b[2] >= a[2] else node(node(left, a[3]), node(a[4], b))
    return node(left, right)


def joined(left: tuple | None, right: tuple | None) -> tuple | None:
    """One tree of two that follow each other."""
    if left is None or right is None:
        return right if left is None else left
    if left[2] > right[2] + 1:
        return balanced(left[3], joined(left[4], right))
    if right[2] > left[2] + 1:
        return balanced(joined(left, right[3]), right[4])
    if not left[2] and not right[2] and len(left[4]) + len(right[4]) <= RUN:
        return leaf(bytes(left[3]) + bytes(right[3]), [*left[4], *right[4]], [*left[5], *right[5]])
    return node(left, right)


def over(leaves: list[tuple]) -> tuple | None:
    """A balanced tree over leaves."""
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    mid = len(leaves) // 2
    return node(over(leaves[:mid]), over(leaves[mid:]))


def cut(tree: tuple | None, at: int) -> tuple[tuple | None, tuple | None]:
    """The trees before and from byte `at` on, where a segment begins."""
    if tree is None or at <= 0:
        return None, tree
    if at >= tree[0]:
        return tree, None
    if tree[2]:
        left, right = tree[3], tree[4]
        if at <= left[0]:
            a, b = cut(left, at)
            return a, joined(b, right)
        a, b = cut(right, at - left[0])
        return joined(left, a), b
    n, size = 0, 0
    while size < at:
        size += tree[4][n]
        n += 1
    return leaf(tree[3][:at], tree[4][:n], tree[5][:n]), leaf(tree[3][at:], tree[4][n:], tree[5][n:])


def segment_at(tree: tuple, at: int) -> tuple[int, int]:
    """First byte and size of the segment that holds byte `at`; the last one at the end."""
    start = 0
    while tree[2]:
        if at < start + tree[3][0]:
            tree = tree[3]
        else:
            start += tree[3][0]
            tree = tree[4]
    last = len(tree[4]) - 1
    for k, n in enumerate(tree[4]):
        if at < start + n or k == last:
            return start, int(n)
        start += n
    return start, 0


def leaves_of(tree: tuple | None) -> Iterator[tuple]:
    stack = [tree] if tree is not None else []
    while stack:
        t = stack.pop()
        if t[2]:
            stack += [t[4], t[3]]
        else:
            yield t


class CountedText:
    """A text whose token count follows its edits. `encoded` counts the bytes that were encoded again."""

    def __init__(self, v: BPE, tree: tuple | None):
        self.v, self.tree, self.encoded = v, tree, 0

    @classmethod
    def of(cls, v: BPE, text: str) -> CountedText:
        return cls(v, over(runs(text.encode("utf-8", "surrogatepass"), *segments(v, text))))

    def tokens(self) -> int:
        return self.tree[1] if self.tree else 0

    def n_bytes(self) -> int:
        return self.tree[0] if self.tree else 0

    def edit(self, at: int, removed: int, inserted: str) -> None:
        total = self.n_bytes()
        at = min(max(at, 0), total)
        end = min(at + max(removed, 0), total)
        left = right = None
        data, first = b"", 0
        if total:
            # One more segment on either side: an edit can join pre-tokens with what stands next to it.
            first = segment_at(self.tree, at)[0]
            if first:
                first = segment_at(self.tree, first - 1)[0]
            stop = sum(segment_at(self.tree, end))
            if stop < total:
                stop = sum(segment_at(self.tree, stop))
            left, rest = cut(self.tree, first)
            middle, right = cut(rest, stop - first)
            data = b"".join([x[3] for x in leaves_of(middle)])
        a, z = at - first, end - first
        while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        while a < z < len(data) and data[z] & 0xC0 == 0x80:
            z -= 1
        data = data[:a] + inserted.encode("utf-8", "surrogatepass") + data[max(a, z) :]
        self.encoded += len(data)
        new = over(runs(data, *segments(self.v, data.decode("utf-8", "surrogatepass"))))
        self.tree = joined(joined(left, new), right)

    def text(self) -> str:
        return b"".join([x[3] for x in leaves_of(self.tree)]).decode("utf-8", "surrogatepass")


def segments(v: BPE, text: str) -> tuple[list[int], list[int]]:
    """Bytes and tokens of the segments of a text. Cuts stand before a single space between two other characters."""
    if not text:
        return [], []
    parts, known = text.split(" "), v.segments
    if "" not in parts[1:] and list(map(str.strip, parts)) == parts:
        sized = [v.measured(parts[0])] if parts[0] else []
        sized += map(known.__getitem__, parts[1:])
    else:
        found, held = [], parts[0]
        ends_white = not held or held[-1].isspace()
        for w in parts[1:]:
            if ends_white or not w or w[0].isspace():
                held += " " + w
            else:
                found.append(held)
                held = " " + w
            ends_white = not w or w[-1].isspace()
        found.append(held)
        sized = [known[s[1:]] if s[0] == " " else v.measured(s) for s in found]
    return [x[0] for x in sized], [x[1] for x in sized]


def runs(data: bytes, sizes: list[int], tokens: list[int]) -> list[tuple]:
    """Leaves of RUN segments."""
    out, at = [], 0
    for k in range(0, len(sizes), RUN):
        part = sizes[k : k + RUN]
        end = at + sum(part)
        out.append(leaf(data[at:end], part, tokens[k : k + RUN]))
        at = end
    return out


def width_of(most: int) -> int:
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def stored(doc_id, data: bytes, sizes: list[int], tokens: list[int]) -> tuple:
    """A row of TREE."""
    width = width_of(max(sizes, default=0))
    kind = f"<u{width}"
    s, t = np.array(sizes, np.int64), np.array(tokens, np.int64)
    at = np.arange(0, len(s), RUN)
    sums = np.stack([np.add.reduceat(s, at), np.add.reduceat(t, at)], axis=1) if len(s) else np.zeros((0, 2), np.int64)
    return doc_id, len(data), int(t.sum()), data, width, s.astype(kind).tobytes(), t.astype(kind).tobytes(), sums.astype("<i8").tobytes()


def loaded(data: bytes, width: int, sizes: bytes, tokens: bytes, sums: bytes) -> tuple | None:
    """The tree of a row of TREE: sums of leaves are read, not added up, and segments are views."""
    s, t = np.frombuffer(sizes, f"<u{width}"), np.frombuffer(tokens, f"<u{width}")
    leaves, at = [], 0
    for k, (n, m) in enumerate(np.frombuffer(sums, "<i8").reshape(-1, 2).tolist()):
        here = slice(k * RUN, (k + 1) * RUN)
        leaves.append((n, m, 0, data[at : at + n], s[here].tolist(), t[here].tolist()))
        at += n
    return over(leaves)


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """A row of TREE for every row of docs, as a written table."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v, out = vocabulary(path), []
        for i, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
            out.append(stored(i, text.encode("utf-8", "surrogatepass"), *segments(v, text)))
        return rows_batch(out, TREE)

    return written(per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, TREE), "trees", compression="zstd")


def tree_row(doc_id, t: CountedText) -> tuple:
    leaves = list(leaves_of(t.tree))
    return stored(doc_id, b"".join([x[3] for x in leaves]), [n for x in leaves for n in x[4]], [n for x in leaves for n in x[5]])


def edited(trees: DataFrame, edits: DataFrame, path: str, keep_trees: bool) -> DataFrame:
    """Rows of COUNTS, or with keep_trees the trees after their edits. Trees and edits (doc_id, seq, at, removed,
    inserted) are dealt by id and sorted, a document's trees before its edits; nothing is gathered but one document."""
    null = lambda kind: F.lit(None).cast(kind)
    e = edits.where(F.col("at").isNotNull() & F.col("doc_id").isNotNull())
    e = e.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"),
        F.coalesce(F.col("removed").cast("long"), F.lit(0)).alias("removed"), F.coalesce(F.col("inserted").cast("string"), F.lit("")).alias("inserted"),
        null("binary").alias("data"), null("int").alias("width"), null("binary").alias("segment_bytes"), null("binary").alias("segment_tokens"), null("binary").alias("leaf_sums"),
    )
    t = trees.select("doc_id", F.lit(0).alias("kind"), null("long").alias("seq"), null("long").alias("at"), null("long").alias("removed"), null("string").alias("inserted"), "data", "width", "segment_bytes", "segment_tokens", "leaf_sums")
    dealt = t.union(e).repartition("doc_id").sortWithinPartitions("doc_id", "kind", "seq", "at", "removed", "inserted")
    form = TREE if keep_trees else COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, now = vocabulary(path), [], object()  # held: [text, tokens before, edits] of every tree of one id

        def flush() -> list[tuple]:
            if keep_trees:
                return [tree_row(now, x[0]) for x in held]
            return [(now, x[1], x[2], x[0].tokens(), x[0].n_bytes(), x[0].encoded) for x in held]

        for b in batches:
            out: list[tuple] = []
            for i, kind, _, at, removed, put, *row in zip(*(c.to_pylist() for c in b.columns)):
                if i != now:
                    out += flush()
                    held, now = [], i
                if not kind:
                    x = CountedText(v, loaded(*row))
                    if i is None:  # no edit can name it
                        out.append(tree_row(i, x) if keep_trees else (i, x.tokens(), 0, x.tokens(), x.n_bytes(), 0))
                    else:
                        held.append([x, x.tokens(), 0])
                    continue
                for x in held:
                    x[0].edit(at, removed, put)
                    x[2] += 1
            if out:
                yield rows_batch(out, form)
        if held:
            yield rows_batch(flush(), form)

    return dealt.mapInArrow(run, form)


def updated_trees(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The trees after edits, as a written table from which a later run goes on."""
    return written(edited(trees, edits, path, True), "trees", compression="zstd")


def counted(docs: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Token counts before and after a document's edits."""
    return edited(build_trees(docs, path), edits, path, False)


def with_edits(rows: DataFrame, path: str) -> DataFrame:
    """Rows of COUNTS for rows of trees that carry a short array of their own edits (at, removed, inserted)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v, out = vocabulary(path), []
        for i, n, edits, *row in zip(*(c.to_pylist() for c in b.columns)):
            t = CountedText(v, loaded(*row))
            for e in edits:
                t.edit(e["at"], e["removed"], e["inserted"])
            out.append((i, n, len(edits), t.tokens(), t.n_bytes(), t.encoded))
        return rows_batch(out, COUNTS)

    return per_batch(rows.select("doc_id", "n_tokens", "edits", "data", "width", "segment_bytes", "segment_tokens", "leaf_sums"), run, COUNTS)


def own_edits(trees: DataFrame) -> DataFrame:
    """Three edits of every document that follow from its id and length alone: an insertion of two words near the
    start third, a removal of up to 40 bytes near the middle, a replacement of 7 bytes by 'édit-7' at the end."""
    n, i = F.col("n_bytes"), F.coalesce("doc_id", F.lit(0))
    one = lambda at, removed, put: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), F.lit(put).alias("inserted"))
    return trees.withColumn("edits", F.array(one(F.floor(n / 3) + F.pmod(i, F.lit(7)), 0, " added words"), one(F.floor(n / 2), 40, ""), one(F.greatest(n - 40, F.lit(0)), 7, "édit-7")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tree is built and stored; then each gets three edits, applied to the stored tree."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return with_edits(own_edits(build_trees(table(spark, sf_dir, "documents"), path)), path)
