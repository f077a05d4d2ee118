"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id go.

The suffix array is sparse. Of any SPAN-byte string the least hashed GRAM bytes mark an anchor, so equal strings hold
equal anchors, and a twentieth of all positions suffices. An anchor travels with a 64-bit hash of its neighbourhood
(every SPAN-byte string around it lies inside). Hashes only tell which suffixes are worth ordering; what is removed is
decided on bytes, in the order of suffixes. Two kinds are ordered: suffixes that start where a neighbourhood starts, of
neighbourhoods that hash alike in several documents (whole stretches of copies), and all suffixes around anchors whose
neighbourhoods agree on one side only (the ends of repeats).

The order is that of deep-shallow sorting: multikey partitioning on the first SHALLOW words of eight bytes, then, for the
remaining groups with long common prefixes, blind tries, built level by level for all groups at once, which look only at
words where a group branches. Equal neighbours in that order are the repeats; all but the smallest document's go.

A passage in a great many documents does not pile up: each batch orders its own neighbourhoods first and sends on one row
of equal ones, a neighbourhood with many rows left is dealt to lanes with its smallest document in each, and suffixes
around a common anchor are dealt by their place in the neighbourhood.

Two neighbourhoods that differ in bytes but not in 128 bits of hash are told apart, but what else their second one
shares with others may be missed.

Nulls: a null text is empty; rows with a null doc_id take no part and lose nothing. Texts under SPAN bytes lose
nothing. Strings that repeat within one document alone stay. Rows that repeat a doc_id do not count as smaller than
each other, and what is found for an id applies to each of its rows, as far as its text goes. Empty tables give empty
results; extra columns are ignored; very long texts take memory in proportion to themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, write
from .common import documents_schema, fresh, per_batch, prepare, release, strings, table, written
from .minhash import BASE, mixed

SPAN, GRAM = 50, 12
WINDOW = SPAN - GRAM + 1
BEFORE, AFTER = WINDOW - 1, SPAN
AROUND = BEFORE + AFTER
HALF_BEFORE = BEFORE // 2
HALF_AFTER = SPAN - HALF_BEFORE + 1
SHALLOW = 2
#: Rows of one anchor that are compared at once.
CHUNK_ROWS = 100_000
#: Suffix rows of one anchor beyond which it is dealt to more lanes, and rows of one neighbourhood in a lane.
LANE_ROWS, COPY_ROWS = 1000, 5000
#: Rows that are gathered before they are worked on, and rows of bytes.
GATHER_ROWS, BYTE_ROWS = 20_000, 8000
WORDS = AROUND // 8


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def words_at(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,)).copy()


def padded(data: bytes) -> np.ndarray:
    """Bytes of a text with BEFORE bytes before it and room behind it, so that every neighbourhood lies inside."""
    out = np.zeros(len(data) + BEFORE + AFTER + 8, np.uint8)
    out[BEFORE : BEFORE + len(data)] = np.frombuffer(data, np.uint8)
    return out


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, neighbourhood hash and packed place of every anchor, and the padded text; nothing for short texts."""
    n = len(data)
    if n < SPAN:
        none = np.zeros(0, np.uint64)
        return none, none, none, np.zeros(0, np.uint8)
    pad = padded(data)
    word = words_at(pad)
    at = word[BEFORE:]
    grams = n - GRAM + 1
    h = mixed(at[:grams] * BASE + at[GRAM - 8 : GRAM - 8 + grams])
    least = sliding(h, WINDOW, np.minimum)
    edge = np.zeros(len(least) + 2 * (WINDOW - 1), np.uint64)
    edge[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    place = np.flatnonzero(sliding(edge, WINDOW, np.maximum) == h)

    def folded(offsets: list[int], seed: np.ndarray) -> np.ndarray:
        out = seed
        for o in offsets:
            out = mixed(out * BASE + word[place + o])
        return out

    around = folded([*range(0, AROUND - 7, 8)], edges_of(place, n).astype(np.uint64))
    zero = np.zeros(len(place), np.uint64)
    left = folded([BEFORE - HALF_BEFORE, BEFORE - HALF_BEFORE + 8, BEFORE - 3, BEFORE + GRAM - 8], zero)
    right = folded([BEFORE, BEFORE + 8, BEFORE + 16, BEFORE + HALF_AFTER - 8], zero)
    packed = place.astype(np.uint64) << np.uint64(32) | (left >> np.uint64(48)) << np.uint64(16) | right >> np.uint64(48)
    return h[place], around, packed, pad


def edges_of(place: np.ndarray, size) -> np.ndarray:
    """How much of a neighbourhood lies in its text, before and after, as one number."""
    return np.minimum(place, BEFORE) * 64 + np.minimum(size - place, AFTER)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of that many rows at least, but for the last one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


ROW = "anchor long, around long, doc_id long, packed long"
#: Cover rows (no anchor; start and stop), rows of copies (place in start, lane in stop), rows of ends (no around).
FOUND = "anchor long, around long, doc_id long, start long, stop long"


def found(doc, start, stop, anchor=None, around=None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    cols = [none if anchor is None else pa.array(anchor, pa.int64()), none if around is None else pa.array(around, pa.int64()), *(pa.array(x, pa.int64()) for x in (doc, start, stop))]
    return pa.RecordBatch.from_arrays(cols, ["anchor", "around", "doc_id", "start", "stop"])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents joined where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # The running maximum of ends within a document: documents are lifted apart.
    lift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def starts_of(key: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin a new key."""
    new = np.zeros(len(key[0]), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def over_groups(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A value per group for each of its rows."""
    return np.repeat(values, np.diff(np.append(first, n)))


def copies_among(group: np.ndarray, edges: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have, in their group, the neighbourhood of a smaller document, by the order of their bytes."""
    order, new = deep_shallow(group, np.column_stack([edges.astype(np.uint64), words]))
    first = np.flatnonzero(new)
    least = over_groups(np.minimum.reduceat(doc[order], first), first, len(order))
    hit = np.zeros(len(doc), bool)
    hit[order] = doc[order] > least
    return hit


def scanned(docs: DataFrame) -> DataFrame:
    """Anchor rows, and cover rows (null anchor, start in `around`, end in `packed`) of what a batch orders itself."""

    def row_batch(anchor, around, doc, packed) -> pa.RecordBatch:
        a = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
        return pa.RecordBatch.from_arrays([a, pa.array(around.view(np.int64)), pa.array(doc), pa.array(packed.view(np.int64))], ["anchor", "around", "doc_id", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, ids, sizes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                data = t.encode("utf-8", "surrogatepass")
                if i is not None and len(data) >= SPAN:
                    parts.append(anchors(data))
                    ids.append(i)
                    sizes.append(len(data))
            if not parts:
                continue
            count = [len(p[0]) for p in parts]
            anchor, around, packed = (np.concatenate([p[k] for p in parts]) for k in range(3))
            doc, size = np.repeat(np.array(ids, np.int64), count), np.repeat(np.array(sizes, np.int64), count)
            base = np.repeat(np.cumsum([0] + [len(p[3]) for p in parts[:-1]]), count)
            order = np.lexsort((doc, around, anchor))
            anchor, around, packed, doc, size, base = (x[order] for x in (anchor, around, packed, doc, size, base))
            place = (packed >> np.uint64(32)).astype(np.int64)
            first = starts_of([anchor, around])
            several = over_groups(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), first, len(doc))
            settled = np.zeros(len(doc), bool)
            rows = np.flatnonzero(several)
            if len(rows):
                text = np.concatenate([p[3] for p in parts])
                eight = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
                at = base[rows] + place[rows]
                words = np.stack([eight[at + 8 * k] for k in range(WORDS)], axis=1).astype(np.uint64)
                group = over_groups(np.arange(len(first)), first, len(doc))[rows]
                settled[rows] = copies_among(group, edges_of(place[rows], size[rows]), words, doc[rows])
                d, s, e = merged(doc[settled], np.maximum(place[settled] - BEFORE, 0), np.minimum(place[settled] + AFTER, size[settled]))
                if len(d):
                    yield row_batch(None, s, d, e)
            keep = np.flatnonzero(~settled)
            for a in range(0, len(keep), 200_000):
                k = keep[a : a + 200_000]
                yield row_batch(anchor[k], around[k], doc[k], packed[k])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROW)


def compared(rows: DataFrame) -> DataFrame:
    """From anchor rows sorted by (anchor, around, doc_id), FOUND rows: what batches settled, and the places whose
    suffixes must be ordered."""

    def ends(anchor, around, doc, packed, all_of_them: bool) -> np.ndarray:
        """Rows that share an anchor and one side with a different neighbourhood in another document."""
        if all_of_them:
            return np.ones(len(doc), bool)
        out = np.zeros(len(doc), bool)
        for shift in (16, 0):
            side = (packed.view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFF)
            order = np.lexsort((side, anchor))
            a, s, d, c = anchor[order], side[order], doc[order], around[order]
            first = starts_of([a, s])
            differ = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) & (np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first))
            out[order] |= over_groups(differ, first, len(a))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, around, least doc_id, its place and the rows behind it, of the neighbourhood at the end
        held: list[tuple[np.ndarray, ...]] = []
        n_held, overflown = 0, None
        for b in gathered(batches, GATHER_ROWS):
            covers = b.filter(b.column(0).is_null())
            if covers.num_rows:
                yield found(*(covers.column(k).to_numpy() for k in (2, 1, 3)))
                b = b.filter(b.column(0).is_valid())
            if not b.num_rows:
                continue
            anchor, around, doc, packed = (b.column(k).to_numpy() for k in range(4))
            place = packed >> 32
            first = starts_of([anchor, around])
            goes_on = last is not None and anchor[0] == last[0] and around[0] == last[1]
            lead, lead_place, behind = doc[first].copy(), place[first].copy(), np.zeros(len(first), np.int64)
            if goes_on:
                lead[0], lead_place[0], behind[0] = last[2:]
            group = over_groups(np.arange(len(first)), first, len(doc))
            settled = doc > lead[group]
            rank = np.cumsum(settled)
            nth = rank - 1 - (rank[first] - settled[first])[group] + behind[group]
            k = np.flatnonzero(settled)
            if len(k):
                yield found(doc[k], place[k], nth[k] // COPY_ROWS, anchor[k], around[k])
                heads = k[nth[k] % COPY_ROWS == 0]
                yield found(lead[group[heads]], lead_place[group[heads]], nth[heads] // COPY_ROWS, anchor[heads], around[heads])
            in_last = int(settled[first[-1] :].sum()) + int(behind[-1])
            last = (anchor[-1], around[-1], lead[-1], lead_place[-1], in_last)
            held.append(tuple(x[~settled] for x in (anchor, around, doc, packed)))
            n_held += len(held[-1][0])
            if n_held >= CHUNK_ROWS:
                x = [np.concatenate([h[k] for h in held]) for k in range(4)]
                cut = int(np.searchsorted(x[0], x[0][-1]))
                whole = cut > 0
                done = [v[:cut] for v in x] if whole else x
                c = ends(*done, all_of_them=not whole) | (done[0] == overflown if overflown is not None else False)
                if c.any():
                    yield found(done[2][c], done[3][c] >> 32, np.zeros(int(c.sum()), np.int64), done[0][c])
                if not whole:
                    overflown = x[0][-1]
                held = [tuple(v[cut:] for v in x)] if whole else []
                n_held = len(held[0][0]) if held else 0
        if n_held:
            x = [np.concatenate([h[k] for h in held]) for k in range(4)]
            c = ends(*x, all_of_them=False) | (x[0] == overflown if overflown is not None else False)
            if c.any():
                yield found(x[2][c], x[3][c] >> 32, np.zeros(int(c.sum()), np.int64), x[0][c])

    dealt = rows.repartition(F.coalesce("anchor", F.xxhash64("doc_id"))).sortWithinPartitions("anchor", "around", "doc_id")
    return dealt.mapInArrow(run, FOUND)


def deep_shallow(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of big-endian words) within groups, and whether each starts a new run of equal ones."""
    n, width = words.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort([words[:, k] for k in reversed(range(min(SHALLOW, width)))] + [group])
    new = np.zeros(n, bool)
    new[0] = True
    for key in [group, *(words[:, k] for k in range(min(SHALLOW, width)))]:
        new[1:] |= key[order][1:] != key[order][:-1]
    for k in range(SHALLOW, width):
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        w = words[order, k]
        branches = np.minimum.reduceat(w, first) != np.maximum.reduceat(w, first)
        rows = np.flatnonzero(np.repeat(branches, size))
        if not len(rows):
            continue  # no node of any trie branches at this word
        run = np.repeat(np.arange(len(first)), size)[rows]
        inner = np.lexsort((w[rows], run))
        order[rows] = order[rows][inner]
        ws, rs = w[rows][inner], run[inner]
        new[rows[1:]] |= (rs[1:] == rs[:-1]) & (ws[1:] != ws[:-1])
    return order, new


BYTES = "kind int, anchor long, around long, lane int, doc_id long, place long, after int, bytes binary"
COPIES, ENDS = 0, 1


def suffix_rows(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The neighbourhood's bytes of every wanted place, padded to AROUND, and how many of them after the place are text."""
    item = F.struct("anchor", F.coalesce("around", F.lit(0)).alias("around"), F.col("around").isNull().cast("int").alias("kind"), F.col("stop").cast("int").alias("lane"), "start")
    lists = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(item).alias("_at"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = d.join(lists, d["doc_id"] == F.col("_id")).select("doc_id", "text", "_at")

    def batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, around, kind, lane, doc, place, after, data = (np.concatenate([p[k] for p in parts]) for k in range(8))
        n = len(anchor)
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * AROUND).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        cols = [pa.array(kind, pa.int32()), pa.array(anchor), pa.array(around), pa.array(lane, pa.int32()), pa.array(doc), pa.array(place), pa.array(after, pa.int32()), binary]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in BYTES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, n = [], 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), strings(b.column(1)))):
                data = t.encode("utf-8", "surrogatepass")
                at = b.column(2)[k].values
                place = at.field(4).to_numpy(zero_copy_only=False)
                here = place + GRAM <= len(data)  # an id that comes again may have a shorter text
                place = place[here]
                if len(place):
                    near = padded(data)[place[:, None] + np.arange(AROUND)]
                    fields = [at.field(f).to_numpy(zero_copy_only=False)[here] for f in range(4)]
                    parts.append((*fields, np.full(len(place), i), place, np.minimum(len(data) - place, AFTER), near))
                    n += len(place)
                if n >= GATHER_ROWS:
                    yield batch(parts)
                    parts, n = [], 0
            if n:
                yield batch(parts)

    return joined.mapInArrow(run, BYTES)


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of about BYTE_ROWS sorted rows that end where a key ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BYTE_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(starts_of([t.column(k).to_numpy() for k in keys])[-1])
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                n = t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def bytes_of(t: pa.Table) -> np.ndarray:
    """The bytes of rows, AROUND to each."""
    return np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(-1, AROUND)


SPANS = "doc_id long, start long, stop long"


def spans_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(doc, start, stop)], ["doc_id", "start", "stop"])


def ordered_copies(rows: DataFrame) -> DataFrame:
    """Cover rows of neighbourhoods that equal one of a smaller document, byte by byte."""
    keys = ["anchor", "around", "lane"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, keys):
            first = starts_of([t.column(k).to_numpy() for k in keys])
            group = over_groups(np.arange(len(first)), first, t.num_rows)
            doc, place, after = (t.column(k).to_numpy() for k in ("doc_id", "place", "after"))
            words = bytes_of(t).view(">u8").astype(np.uint64)
            hit = copies_among(group, np.minimum(place, BEFORE) * 64 + after, words, doc)
            if hit.any():
                yield spans_batch(doc[hit], np.maximum(place[hit] - BEFORE, 0), place[hit] + after[hit])

    return dealt.mapInArrow(run, SPANS)


END = "anchor long, doc_id long, place long, after int, bytes binary, _lanes int, _lane int"


def suffixes_of(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and start (bytes before the place) of every whole suffix of rows in their lanes, and the suffixes as words."""
    place, after, lane, lanes = (t.column(c).to_numpy() for c in ("place", "after", "_lane", "_lanes"))
    before, back = np.minimum(place, BEFORE), np.arange(WINDOW)[None]
    row, back = np.nonzero((back <= before[:, None]) & (after[:, None] + back >= SPAN) & (back % lanes[:, None] == lane[:, None]))
    buffer = np.zeros((t.num_rows, AROUND + 8), np.uint8)
    buffer[:, :AROUND] = bytes_of(t)
    flat = buffer.ravel()
    base = row * (AROUND + 8) + BEFORE - back
    eight = np.ndarray((len(flat) - 7,), ">u8", flat, 0, (1,))
    words = np.stack([eight[base + 8 * k] for k in range(SPAN // 8)] + [eight[base + SPAN - 8]], axis=1).astype(np.uint64)
    return row, back, words


def repeats_in(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows and starts of those suffixes that a smaller document among the rows has too."""
    row, back, words = suffixes_of(t)
    if not len(row):
        return row, back
    doc = t.column("doc_id").to_numpy()[row]
    _, g = np.unique(t.column("anchor").to_numpy(), return_inverse=True)
    order, new = deep_shallow(g[row] * WINDOW + back, words)
    first = np.flatnonzero(new)
    hit = order[doc[order] > over_groups(np.minimum.reduceat(doc[order], first), first, len(order))]
    return row[hit], back[hit]


def spans_at(t: pa.Table | pa.RecordBatch, row: np.ndarray, back: np.ndarray) -> pa.RecordBatch:
    start = t.column("place").to_numpy()[row] - back
    return spans_batch(t.column("doc_id").to_numpy()[row], start, start + SPAN)


def thinned(rows: DataFrame) -> DataFrame:
    """Rows of very common anchors, a row to each start of a suffix, without those that a task can settle itself: of equal
    suffixes in a few thousand rows the smallest document's go on. Settled spans are rows without an anchor, whose start
    and stop stand in place and _lane."""

    names = [f.split()[0] for f in END.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, GATHER_ROWS):
            row, back = repeats_in(b)
            left = np.ones(b.num_rows, bool)
            left[row] = False
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(left)).columns, names)
            if len(row):
                spans = spans_at(b, row, back)
                zero, none = pa.array(np.zeros(spans.num_rows, np.int32)), lambda kind: pa.nulls(spans.num_rows, kind)
                cols = [none(pa.int64()), spans.column(0), spans.column(1), zero, none(pa.binary()), zero, spans.column(2).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, END)


def ordered_ends(rows: DataFrame) -> DataFrame:
    """Cover rows of suffixes that equal a suffix of a smaller document."""
    # A common anchor's suffixes are dealt to lanes by their place in the neighbourhood, a very common one's are thinned first.
    lanes = rows.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("_n")).where(F.col("_n") > LANE_ROWS)
    lanes = written(lanes.select("_a", F.least(F.lit(WINDOW), F.ceil(F.col("_n") / LANE_ROWS)).cast("int").alias("_lanes")), "lanes")
    wide = rows.drop("lane").join(lanes, F.col("anchor") == F.col("_a"), "left").drop("_a").withColumn("_lanes", F.coalesce("_lanes", F.lit(1)))
    spread = wide.where(F.col("_lanes") < WINDOW).withColumn("_lane", F.explode(F.sequence(F.lit(0), F.col("_lanes") - 1)))
    very = rows.drop("lane").join(lanes.where(F.col("_lanes") == WINDOW), F.col("anchor") == F.col("_a")).drop("_a").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))))
    names = [f.split()[0] for f in END.split(", ")]
    every = spread.select(*names).union(thinned(very.select(*names)))
    dealt = every.repartition(F.coalesce("anchor", F.xxhash64("doc_id", "place")), "_lane").sortWithinPartitions("anchor", "_lane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest() -> Iterator[pa.RecordBatch]:
            for b in batches:
                settled = b.filter(b.column(0).is_null())
                if settled.num_rows:
                    done.append(pa.RecordBatch.from_arrays([settled.column(1), settled.column(2), settled.column(6).cast(pa.int64())], ["doc_id", "start", "stop"]))
                    b = b.filter(b.column(0).is_valid())
                if b.num_rows:
                    yield b

        done: list[pa.RecordBatch] = []
        for t in by_key(rest(), ["anchor", "_lane"]):
            yield from done
            done.clear()
            row, back = repeats_in(t)
            if len(row):
                yield spans_at(t, row, back)
        yield from done

    return dealt.mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Written tables of cover spans (doc_id, start, stop), overlapping and unclipped."""
    spark = docs.sparkSession
    first = written(compared(scanned(docs)), "spans")
    release(spark)
    rows, path = write(suffix_rows(first.where("anchor IS NOT NULL"), docs), "suffixes", ["kind"], compression="zstd")
    release(spark)
    copies = written(ordered_copies(rows.where(F.col("kind") == COPIES).drop("kind")), "spans")
    release(spark)
    ends = written(ordered_ends(rows.where(F.col("kind") == ENDS).drop("kind", "around")), "spans")
    release(spark)
    drop(spark, path)
    return first.where("anchor IS NULL").select("doc_id", "start", "stop").union(copies).union(ends)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with an array of its spans as one more, last column."""
    key, name = fresh(docs, "_id"), fresh(docs, "_spans")
    spans = repeated_spans(docs)
    lists = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "stop")).alias(name))
    return docs.join(lists, docs["doc_id"].cast("long") == F.col(key), "left").drop(key)


def cut(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of data, bytes removed, and maximal removed runs."""
    if not spans:
        return data, 0, 0
    start = np.array([s["start"] for s in spans], np.int64)
    stop = np.minimum(np.array([s["stop"] for s in spans], np.int64), len(data))
    good = start < stop
    _, s, e = merged(np.zeros(int(good.sum()), np.int64), start[good], stop[good])
    parts, at = [], 0
    for a, z in zip(s.tolist(), e.tolist()):
        parts.append(data[at:a])
        at = z
    parts.append(data[at:])
    return b"".join(parts), int((e - s).sum()), len(s)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the remaining bytes of every row."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for t, spans in zip(strings(b.column(1)), b.column(2).to_pylist()):
            data = t.encode("utf-8", "surrogatepass")
            kept, removed, n = cut(data, spans or [])
            out["n_bytes"].append(len(data))
            out["n_removed"].append(removed)
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text", "_spans")
    return per_batch(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of text (a character that loses a byte goes as a whole) and n_chars renewed."""
    rows = with_spans(docs)
    names, at, schema = docs.columns, docs.columns.index("text"), documents_schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(at).to_pylist()
            cuts = [t if t is None or not s else cut(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, b.column(len(names)).to_pylist())]
            cols = [b.column(k) for k in range(len(names))]
            cols[at] = pa.array(cuts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([None if t is None else len(t) for t in cuts]).cast(cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return dedup_report(table(spark, sf_dir, "documents"))
