"""b-bit MinHash near-duplicates: connected components of documents whose shingle sets are similar enough.

Every document's distinct word shingles are hashed once. Documents with equal sets become one class, whose least id
stands for it. Of BANDS x ROWS minima each class keeps one hash per band and the low BITS bits of every minimum, packed. Classes that share a band are candidates; the packed signatures
give a collision-corrected similarity by counting equal bit groups, and pairs that may reach the threshold are confirmed on
full sets. Pairs are never spelled out within a group: first each class is held against the least of its group, then
components are formed, and only groups that still hold several components are searched, members outside a group's
main component against its members, in blocks of bounded size that emit likely pairs alone, by longer signatures.

A pair of similarity 0.8 misses all bands with probability (1 - 0.8^4)^24 = 3e-6, a component through one link only.

Nulls: a null text has no words; documents without words have an empty set and are linked with nothing. Rows with a
null doc_id have no id to be linked by and come back with null component and kept. Fewer words than a shingle: the
whole sequence is one shingle. Rows that repeat a doc_id are one node, linked through any of
their texts: while links are sought, each different set of such an id goes by an id of its own. Ties cannot
arise: a component is named by its least id. An empty table gives an empty result; extra columns are ignored; very
long texts take memory in proportion to themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, per_batch, prepare, release, strings, table, written
from .components import components

WORDS, PERCENT = 4, 80
BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
#: Estimates this far below the threshold are still confirmed: five standard deviations of HASHES minima.
MARGIN = 0.2
#: Minima in the longer signatures of classes whose groups are searched, the first HASHES being the same, and the
#: margin of their estimates (four and a half standard deviations).
FINE_HASHES, FINE_MARGIN = 768, 0.07
BLOCK = 2048
#: Pairs of one document that a task may get; beyond them its text is dealt to more tasks.
HUB_PAIRS = 500

_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MULTIPLY = _rng.integers(1, 1 << 31, FINE_HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _rng.integers(0, 1 << 32, FINE_HASHES, np.uint32)


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n (wrapping)."""
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(tokens), np.uint8)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(length + 1) - 1
    start = end - length
    up, down = powers(1 << max(12, int(len(joined)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[joined] * up[: len(joined)], dtype=np.uint64)])
    span = min(words, len(tokens)) - 1
    first, last = start[: len(start) - span], end[span:]
    return np.unique(mixed((sums[last] - sums[first]) * down[first] + np.uint64(len(tokens) if len(tokens) < words else words)))


def minima(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """That many minima of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        h = x[a : a + 1024, None] ^ FLIP[:hashes]
        h *= MULTIPLY[:hashes]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(axis=0), out=best)
    return best


def band_hashes(m: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, the band's number included."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * BASE
    for k in range(ROWS):
        h = mixed(h + m.reshape(BANDS, ROWS)[:, k].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def signature(m: np.ndarray) -> bytes:
    """The low BITS bits of all minima, two to a byte."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (two minima a byte), corrected for chance collisions."""
    x = a ^ b
    equal = ((x & 15) == 0).sum(axis=-1) + ((x >> 4) == 0).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (equal / (2 * x.shape[-1]) - chance) / (1 - chance)


def stacked(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, band hashes and packed signature (null for empty sets)."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column(0), "n_shingles": [], "d1": [], "d2": [], "bands": [], "sig": []}
        for t in strings(b.column(1)):
            s = shingles(t, words)
            out["n_shingles"].append(len(s))
            if len(s):
                out["d1"].append(int(s.sum(dtype=np.uint64).view(np.int64)))
                out["d2"].append(int(mixed(s ^ BASE).sum(dtype=np.uint64).view(np.int64)))
                m = minima(s)
                out["bands"].append(band_hashes(m))
                out["sig"].append(signature(m))
            else:
                for c in ("d1", "d2", "bands", "sig"):
                    out[c].append(None)
        return out

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text, and the digest of the set of each row (null for empty sets)."""

    def run(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, words) for t in strings(b.column(1))]
        d1 = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
        d2 = [int(mixed(s ^ BASE).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
        return {"doc_id": b.column(0), "text": b.column(1), "d1": d1, "d2": d2}

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, text string, d1 long, d2 long")


def fine_signatures(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and FINE_HASHES packed minima of the documents in ids (doc_id). docs: doc_id, text."""

    def run(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, words) for t in strings(b.column(1))]
        return {"doc_id": b.column(0), "sig": [signature(minima(s, FINE_HASHES)) if len(s) else bytes(FINE_HASHES // 2) for s in sets]}

    return per_batch(docs.join(ids.distinct(), "doc_id", "left_semi"), run, "doc_id long, sig binary")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough. pairs: a written table; texts: doc_id and text of all
    that occur in it. The text of a document that is b of many pairs (the least of a large group) goes to several
    tasks, each with some of the pairs."""
    hubs = pairs.groupBy(F.col("b").alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > HUB_PAIRS)
    hubs = written(hubs.select("_h", F.ceil(F.col("_n") / HUB_PAIRS).cast("int").alias("_parts")), "hubs")
    salted = pairs.join(hubs, F.col("b") == F.col("_h"), "left").select("a", "b", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("a"), F.col("_parts"))).otherwise(0).cast("int").alias("_salt"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_x"))
    right = texts.join(hubs, F.col("doc_id") == F.col("_h"), "left")
    right = right.select(F.col("doc_id").alias("b"), F.col("text").alias("_y"), F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt"))
    both = salted.join(left, "a").join(right.hint("merge"), ["b", "_salt"]).select("a", "b", "_x", "_y")

    def run(b: pa.RecordBatch) -> dict:
        keep, held = [], {}
        for k, (x, y) in enumerate(zip(strings(b.column(2)), strings(b.column(3)))):
            s = shingles(x, words)
            t = held.get(y)
            if t is None:
                held = {y: shingles(y, words)}
                t = held[y]
            if not len(s) or not len(t):
                continue
            common = len(s) + len(t) - len(np.union1d(s, t))
            if 100 * common >= percent * (len(s) + len(t) - common):
                keep.append(k)
        return {"a": b.column(0).take(pa.array(keep, pa.int64())), "b": b.column(1).take(pa.array(keep, pa.int64()))}

    return written(per_batch(both, run, "a long, b long").distinct(), "links")


def likely(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures allow the threshold."""

    def run(b: pa.RecordBatch) -> dict:
        good = pa.array(similarity(stacked(b.column(2).to_pylist()), stacked(b.column(3).to_pylist())) >= least)
        return {"a": b.column(0).filter(good), "b": b.column(1).filter(good)}

    return per_batch(pairs.select("a", "b", "sa", "sb"), run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(sketches(rows, words), "sketch")
    sets = sketch.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("_x"), F.max(F.struct("d1", "d2")).alias("_y"))
    several = written(sets.where("_x <> _y").select("doc_id"), "several")
    if several.isEmpty():
        out = linked(rows, sketch, words, percent)
    else:
        out = linked_with_repeats(rows, sketch, several, words, percent)
    return out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def linked_with_repeats(docs: DataFrame, sketch: DataFrame, several: DataFrame, words: int, percent: int) -> DataFrame:
    """`linked` where some ids (several: doc_id) have several different sets, each of which gets an id of its own that
    nothing else has; then components that hold sets of one id are one."""
    sets = sketch.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct()
    seed = 0
    while True:
        own = written(sets.withColumn("node", F.xxhash64(F.lit(seed), "doc_id", "d1", "d2")), "nodes")
        clash = own.groupBy("node").count().where("count > 1").select("node").union(own.join(sketch.select(F.col("doc_id").alias("node")), "node", "left_semi").select("node"))
        if clash.isEmpty():
            break
        seed += 1
    keyed = ["doc_id", "d1", "d2"]
    marked = sketch.join(own, keyed, "left")
    theirs = marked.select(F.coalesce("node", "doc_id").alias("doc_id"), "n_shingles", "d1", "d2", "bands", "sig")
    texts = docs.join(several, "doc_id", "left_semi")
    again = digests(texts, words).join(own, keyed, "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "text")
    rest = docs.join(several, "doc_id", "left_anti")
    found = written(linked(rest.union(again), written(theirs, "sketch"), words, percent), "linked")
    real = own.select(F.col("doc_id").alias("_real"), F.col("node").alias("_node"))
    named = found.join(real, F.col("doc_id") == F.col("_node"), "left").select(F.coalesce("_real", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("_c"))
    named = written(named, "linked")
    theirs = named.join(several, "doc_id", "left_semi").select("doc_id", "_c").distinct()
    joined = theirs.join(theirs.groupBy("doc_id").agg(F.min("_c").alias("b")), "doc_id").select(F.col("_c").alias("a"), "b").distinct()
    over = components(joined, "repeats")
    whole = named.join(over, F.col("_c") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "_c").alias("_c"))
    whole = written(whole, "linked")
    least = whole.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    known = whole.where("_c IS NOT NULL").join(least, "_c").select("doc_id", "n_shingles", "component_id")
    return known.union(whole.where("_c IS NULL").select("doc_id", "n_shingles", F.col("_c").alias("component_id")))


def linked(docs: DataFrame, sketch: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; an id has one set of shingles at most."""
    spark = docs.sparkSession
    least = percent / 100 - MARGIN
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = full.groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).agg(F.min("doc_id").alias("_rep"), F.count("*").alias("_n")).where("_n > 1")
    shared = written(groups.select("_d1", "_d2", "_rep"), "classes")
    rep = F.coalesce("_rep", "doc_id")
    member = sketch.join(shared, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    members = written(member.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), rep).otherwise(F.col("doc_id")).alias("rep")), "members")
    first = member.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (rep == F.col("doc_id"))).select("doc_id", "bands", "sig")
    reps = written(first, "representatives")
    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    counts = rows.groupBy(F.col("band").alias("_band")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.count("*").alias("n"))
    buckets = written(counts.where("first <> _last").select("_band", "first", "n"), "buckets")
    hits = written(rows.join(buckets, F.col("band") == F.col("_band")).select("band", "doc_id", "first", "n"), "hits")
    sigs = reps.select("doc_id", "sig").dropDuplicates(["doc_id"])
    sa, sb = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    star = written(hits.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "star")
    # Whole texts are dealt once: later steps read only those that share a band with another class.
    texts = written(docs.join(hits.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    release(spark)
    links = confirmed(written(likely(star.join(sa, "a").join(sb, "b"), least), "likely"), texts, words, percent)
    release(spark)
    # Groups that still hold several components.
    label = components(links)
    of = label.select(F.col("node").alias("doc_id"), F.col("component").alias("_c"))
    seen = written(hits.join(of, "doc_id", "left").select("band", "doc_id", "first", "n", F.coalesce("_c", "doc_id").alias("comp")), "hits")
    per = seen.groupBy("band", "comp").agg(F.count("*").alias("m"))
    open_ = per.groupBy("band").agg(F.count("*").alias("_k"), F.max(F.struct("m", "comp")).alias("_main"), F.sum("m").alias("_n")).where("_k > 1")
    open_ = written(open_.select(F.col("band").alias("_b"), "_k", F.col("_main.comp").alias("main"), F.col("_main.m").alias("_mm"), "_n"), "open")
    rest = seen.join(open_, F.col("band") == F.col("_b")).where("NOT (_n = 2)")  # a pair was held against its least already
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    minor_blocks = F.ceil((F.col("_n") - F.col("_mm")) / BLOCK).cast("int")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("int")
    minor = F.col("comp") != F.col("main")
    cells = rest.select("band", "doc_id", "comp", "first", minor.alias("_minor"), (salt % blocks).alias("_i"), (salt % minor_blocks).alias("_j"), blocks.alias("_bs"), minor_blocks.alias("_ms"))
    as_any = cells.select("band", "doc_id", "comp", "first", "_i", F.explode(F.sequence(F.lit(0), F.col("_ms") - 1)).alias("_j"), F.lit(False).alias("_asks"))
    as_minor = cells.where("_minor").select("band", "doc_id", "comp", "first", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1)).alias("_i"), "_j", F.lit(True).alias("_asks"))
    fine = written(fine_signatures(texts, rest.select("doc_id"), words), "fine").dropDuplicates(["doc_id"])
    dealt = as_any.union(as_minor).join(fine.join(reps.select("doc_id", "bands").dropDuplicates(["doc_id"]), "doc_id"), "doc_id")
    coarse, fine_least = HASHES // 2, percent / 100 - FINE_MARGIN

    def search(t: pa.Table) -> pa.Table:
        asks = t.column("_asks").to_numpy(zero_copy_only=False)
        ids, comp, head = (t.column(c).to_numpy() for c in ("doc_id", "comp", "first"))
        sig = stacked(t.column("sig").to_pylist())
        bands, here = np.array(t.column("bands").to_pylist(), np.int64), t.column("band")[0].as_py()
        who, all_ = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = [], []
        for q in who:
            pick = all_[(comp[all_] != comp[q]) & (ids[all_] != head[all_])]
            if ids[q] == head[q] or not len(pick):
                continue
            pick = pick[similarity(sig[q][None, :coarse], sig[pick, :coarse]) >= least]
            pick = pick[similarity(sig[q][None], sig[pick]) >= fine_least]
            if len(pick):  # a pair is told by the first band that it shares, once
                pick = pick[bands[q][(bands[q][None] == bands[pick]).argmax(axis=1)] == here]
            a.append(np.maximum(ids[pick], ids[q]))
            b.append(np.minimum(ids[pick], ids[q]))
        return pa.table({"a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))})

    found = written(dealt.groupBy("band", "_i", "_j").applyInArrow(search, "a long, b long").distinct(), "residual")
    if not found.isEmpty():
        links = links.union(confirmed(found, texts, words, percent))
        label = components(links)
    release(spark)
    of = written(label.select(F.col("node").alias("rep"), "component"), "components")
    return members.join(of, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def filter_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns of docs; rows that repeat an id are kept once each text.

    Rows with a null doc_id are kept: nothing can be said of them.
    """
    key = fresh(docs, "_id")
    kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias(key)).distinct()
    known = docs.join(kept, docs["doc_id"].cast("long") == F.col(key), "left_semi")
    return known.union(docs.where(docs["doc_id"].isNull()))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
