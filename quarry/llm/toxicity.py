"""Toxicity with noisy-channel deobfuscation.

Words written with look-alike signs, separators, spacing or repeated letters are restored by a Viterbi search over a
lattice of characters: each sign may stand for some letters or for none, a run of one letter for one or two of it, and
letters that stand alone in a row for words whose ends the search chooses too. The channel's costs and a character
trigram model, whose counts come from every document, choose the best readings. Signs within a word may also part
words, so the parts are read beside the whole. A document is then scored by a logistic model over restored words and word
beginnings, learned from labelled rows.

Nulls: a null text is an empty one; an empty text gets the score of a text without any known word. Without labelled
rows the score is 0.5, with one class only that class's share. Very long texts and words are read and scored
as a whole. Ties between readings go to the earlier one. Empty tables give empty results; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, per_batch, prepare, strings, table

#: Bounded sample of labelled rows for fitting.
SAMPLE_ROWS = 5000
THRESHOLD = 0.5
CACHE_ENTRIES, CACHED_CHARS = 300_000, 1000
READINGS = 3

#: Look-alike signs (fixed values).
LOOKALIKE = {
    "@": "a", "4": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il", "|": "il",
    "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "aeiou", "%": "",
}
COST_SIGN, COST_WILD, COST_DROP, COST_DROP_SIGN, COST_SHORTEN = 1.0, 2.5, 0.3, 9.0, 0.7
COST_WIDE, MARGIN, REACH, SETTLE = 4.0, 5.0, 100, 4096
FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")

#: Classes of the character model: a word's edge, 26 letters, any other letter.
N_CLASSES = 28
SMOOTHING = 0.1


def class_table() -> np.ndarray:
    """Classes of code points below 2^16 as they are read: folded, in lower case. Others count as other letters."""
    t = np.full((1 << 16) + 1, N_CLASSES - 1, np.int64)
    for c in range(1 << 16):
        x = chr(c).lower()[0].translate(FOLD)
        t[c] = ord(x) - 96 if "a" <= x <= "z" else N_CLASSES - 1 if chr(c).isalpha() else 0
    return t


CLASS = class_table()


def classes(text: str) -> np.ndarray:
    """The class of every character, one symbol each, as the reader sees them."""
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 1 << 16)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of class triples over all documents: one partial table per task, then sums; at most 28^3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CLASSES**3, np.int64)
        for b in batches:
            for t in strings(b.column(0)):
                total += triples(t)
        cells = np.flatnonzero(total)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    out = np.zeros(N_CLASSES**3, np.int64)
    for cell, n in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def triples(text: str) -> np.ndarray:
    x = classes(f"  {text}  ")
    return np.bincount((x[:-2] * N_CLASSES + x[1:-1]) * N_CLASSES + x[2:], minlength=N_CLASSES**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), from triples inside words and at their edges."""
    c = counts.reshape(N_CLASSES, N_CLASSES, N_CLASSES).astype(float) + SMOOTHING
    c[:, 0, :] = c[:, 0, :].sum(axis=0)[None]  # what stands before an edge says nothing of the next word
    return np.log(c / c.sum(axis=2, keepdims=True))


class Restorer:
    """Reads obfuscated words under a character model."""

    def __init__(self, model: np.ndarray):
        self.lp = model.reshape(-1).tolist()

    def lattice(self, word: str, ends: bool = False) -> list[list[tuple[str, float]]]:
        """Per position the strings it may stand for, with their costs; with `ends`, a sign may end a word too."""
        out: list[list[tuple[str, float]]] = []
        k, n = 0, len(word)
        while k < n:
            x, run = word[k], 1
            while k + run < n and word[k + run] == x:
                run += 1
            if x.isalpha():
                if run == 1:
                    out.append([(x, 0.0)])
                elif run == 2:
                    out.append([(x + x, 0.0), (x, COST_SHORTEN + 1.5)])
                else:
                    out.append([(x, COST_SHORTEN), (x + x, COST_SHORTEN + 0.5)])
            else:
                reads = [(y, COST_WILD if x == "*" else COST_SIGN) for y in LOOKALIKE.get(x, "")]
                drop = COST_DROP if x in ".-_~'%^,;:\"&" else COST_DROP_SIGN if x != "!" or k + run < n else COST_DROP
                if run > 1:
                    out.append([*[(y, c + COST_SHORTEN) for y, c in reads], *[(y + y, c + COST_SHORTEN) for y, c in reads], ("", drop)])
                else:
                    out.append([*reads, ("", drop)])
                if ends:
                    out[-1].append((" ", COST_DROP_SIGN if x.isalnum() else COST_SIGN if x in LOOKALIKE else COST_DROP))
            k += run
        return out

    def read(self, word: str, best: int = READINGS) -> list[str]:
        """The likeliest readings, best first."""
        lp, beams = self.lp, {(0, 0): [(0.0, None)]}
        for choices in self.lattice(word):
            new: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
            for (a, b), held in beams.items():
                for put, cost in choices:
                    p, q, s = a, b, -cost
                    for ch in put:
                        c = ord(ch) - 96 if "a" <= ch <= "z" else 27
                        s += lp[(p * N_CLASSES + q) * N_CLASSES + c]
                        p, q = q, c
                    new.setdefault((p, q), []).extend((v + s, (t, put) if put else t) for v, t in held)
            beams = {k: sorted(v, key=lambda r: -r[0])[:best] for k, v in new.items()}
        end = sorted(((v + lp[(p * N_CLASSES + q) * N_CLASSES], t) for (p, q), held in beams.items() for v, t in held), key=lambda r: -r[0])
        out: dict[str, None] = {}
        for _, t in end:
            if len(out) == best:
                break
            out[spelled(t)] = None
        return list(out)

    def spaced(self, text: str) -> list[list[tuple[str, float]]]:
        """The lattice of letters that stand alone: a word may end between any two. A gap wider than the narrowest one
        speaks for an end; a run of one letter over like gaps stands for one or two of it, or for an end between them."""
        letters = LETTER.findall(text)
        gaps = [len(g) for g in GAP.findall(text)]
        narrow = min(gaps)
        wide = [g > narrow for g in gaps]
        out: list[list[tuple[str, float]]] = []
        k, n = 0, len(letters)
        while k < n:
            run = 1
            while k + run < n and letters[k + run] == letters[k] and not wide[k + run - 1]:
                run += 1
            reads = self.lattice(letters[k] * run)[0]
            if run > 1:
                reads = [*reads, *[(f"{y} {y}", c) for y, c in self.lattice(letters[k])[0] if y]]
            out.append(reads)
            k += run
            if k < n:
                out.append([("", COST_WIDE), (" ", 0.0)] if wide[k - 1] else [("", 0.0), (" ", 0.0)])
        return out

    def segments(self, lattice: list[list[tuple[str, float]]]) -> set[str]:
        """Every word of the readings that cost at most MARGIN more than the best one, where a space in a choice ends a
        word. Nothing before an end bears on what follows, so forward and backward scores of ends are enough; they are
        settled every SETTLE steps, and the work grows with the length alone. At most REACH beginnings of the word at hand are kept, the latest ones."""
        lp, ends, edges = self.lp, [0.0], []
        live: dict[tuple[int, int, int], list[tuple[float, tuple | None]]] = {(0, 0, 0): [(0.0, None)]}
        out: set[str] = set()

        def step(p: int, q: int, put: str, s: float) -> tuple[int, int, float]:
            for ch in put:
                c = ord(ch) - 96 if "a" <= ch <= "z" else 27
                s += lp[(p * N_CLASSES + q) * N_CLASSES + c]
                p, q = q, c
            return p, q, s

        def close(cost: float, first: str) -> bool:
            """A new end after `first`; whether any word can end there."""
            found = []
            for (start, p, q), held in live.items():
                p, q, s = step(p, q, first, -cost)
                s += lp[(p * N_CLASSES + q) * N_CLASSES]
                found.extend((v + s, start, (t, first) if first else t) for v, t in held if t or first)
            if not found:
                return False
            best = max(f[0] for f in found)
            edges.extend((start, len(ends), v - ends[start], t) for v, start, t in found if v >= best - MARGIN)
            ends.append(best)
            return True

        def settle(after: dict[int, float], before: int) -> list[tuple]:
            """Takes the words that end before an end; the rest is kept. after: best scores from ends onwards."""
            best = max(ends[k] + v for k, v in after.items())
            for start, end, v, t in reversed(edges):
                if end in after:
                    onwards = v + after[end]
                    after[start] = max(after.get(start, -np.inf), onwards)
                    if end < before and ends[start] + onwards >= best - MARGIN:
                        out.add(spelled(t))
            return [e for e in edges if e[1] >= before]

        for at, choices in enumerate(lattice, 1):
            new: dict[tuple[int, int, int], list[tuple[float, tuple | None]]] = {}
            for put, cost in choices:
                if " " in put:
                    first, rest = put.split(" ")
                    if close(cost, first):
                        p, q, s = step(0, 0, rest, ends[-1])
                        new[len(ends) - 1, p, q] = [(s, (None, rest) if rest else None)]
                    continue
                for (start, p, q), held in live.items():
                    p, q, s = step(p, q, put, -cost)
                    new.setdefault((start, p, q), []).extend((v + s, (t, put) if put else t) for v, t in held)
            least = max(v for held in new.values() for v, _ in held) - MARGIN
            live = {}
            for k, held in new.items():
                if held := [h for h in held if h[0] >= least]:
                    live[k] = sorted(held, key=lambda r: -r[0])[:READINGS]
            if len(starts := {k[0] for k in live}) > REACH:
                oldest = sorted(starts)[-REACH]
                live = {k: held for k, held in live.items() if k[0] >= oldest}
            if at % SETTLE == 0:
                after: dict[int, float] = {}
                for (start, _, _), held in live.items():
                    after[start] = max(after.get(start, -np.inf), held[0][0] - ends[start])
                edges = settle(after, len(ends) - 2 * REACH)
        after = {start: held[0][0] - ends[start] for (start, _, _), held in live.items() if held[0][1] is None}
        if close(0.0, ""):
            after[len(ends) - 1] = 0.0
        if after:
            settle(after, len(ends))
        return out


def spelled(chain: tuple | None) -> str:
    """The text of a chain of pieces, the last of which is outermost."""
    out = []
    while chain:
        chain, put = chain
        out.append(put)
    return "".join(reversed(out))


#: Punctuation around words; what may be a look-alike at a word's beginning, or at the end of one without letters, stays.
EDGES = ".,;:?\"'()[]{}<>&%#*!-_~^/\\|`"
BEFORE, BEHIND = ".,;:?\"'()[]{}<>&%#*-_~^/\\`", ".,;:?\"'()[]{}<>&%-_~^/\\`"
#: Letters between signs; one alone beside a sign is no word, but what a look-alike leaves of one.
PLAIN = re.compile(r"[^\W\d_]{2,}")
RUN3 = re.compile(r"([^\W\d_])\1\1")
ALONE = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ .\-_*]+(?:[^\W_]|[@$!|+])){3,}(?!\S)")
LETTER, GAP = re.compile(r"[^ .\-_*]"), re.compile(r"[ .\-_*]+")


class Reader:
    """Restored words of texts, with a bounded cache of single words."""

    def __init__(self, model: np.ndarray):
        self.restore = Restorer(model)
        self.cache: dict[str, tuple[str, ...]] = {}

    def word(self, w: str) -> tuple[str, ...]:
        """Readings of one lower-case word; none if nothing in it can be a letter."""
        core = w.strip(EDGES)
        if core.isalpha():
            if RUN3.search(core):
                found = tuple(self.restore.read(core.translate(FOLD)))
            else:
                found = (core,)
        elif not any(x.isalpha() for x in core):
            # No letter at all: a word only if every sign may stand for one.
            signs = w.rstrip(BEHIND).lstrip(BEFORE)
            found = tuple(self.restore.read(signs)) if len(signs) > 2 and all(LOOKALIKE.get(x) for x in signs) else ()
        else:
            whole = w.rstrip(EDGES).lstrip(BEFORE).translate(FOLD)
            parts = {*self.restore.segments(self.restore.lattice(whole, True)), *PLAIN.findall(core)}
            found = tuple(x for x in dict.fromkeys([*self.restore.read(whole), *sorted(parts)]) if x)
        if w[:1] in "!|" and core.isalpha():
            found += tuple(x for x in self.restore.read(w.rstrip(EDGES).translate(FOLD)) if x)[:1]
        if len(w) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[w] = found
        return found

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        get = self.cache.get
        for w in set(low.split()):
            found = get(w)
            out.update(self.word(w) if found is None else found)
        for m in ALONE.finditer(low):
            if any(x.isalpha() for x in m.group()):
                out.update(self.restore.segments(self.restore.spaced(m.group().translate(FOLD))))
        return out


def features_of(words: set[str]) -> set[str]:
    return words | {w[:4] + "-" for w in words if len(w) > 4} | {w[:5] + "-" for w in words if len(w) > 5}


class ToxicityModel:
    """Weights of known words and beginnings, and the character model."""

    def __init__(self, trigrams: np.ndarray, weights: dict[str, float], offset: float):
        self.trigrams, self.weights, self.offset = trigrams, weights, offset
        self.reader: Reader | None = None
        self.known: dict[str, frozenset[str]] = {}

    def __getstate__(self):
        return self.trigrams, self.weights, self.offset

    def __setstate__(self, state):
        self.__init__(*state)

    def probability(self, text: str) -> float:
        if self.reader is None:
            self.reader = Reader(self.trigrams)
        hits: set[str] = set()
        weights, get = self.weights, self.known.get
        for w in self.reader.words(text):
            found = get(w)
            if found is None:
                found = frozenset(f for f in features_of({w}) if f in weights)
                if len(w) <= CACHED_CHARS:
                    if len(self.known) >= CACHE_ENTRIES:
                        self.known.clear()
                    self.known[w] = found
            if found:
                hits |= found
        z = self.offset + sum(weights[h] for h in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[str, int]], trigrams: np.ndarray, steps: int = 300) -> ToxicityModel:
    """Features that speak for label 1 (seen in at least 4 of its texts, at least five times as often as elsewhere), weighted
    by a logistic regression with an L2 penalty."""
    y = np.array([v for _, v in rows], float)
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(y) or share in (0.0, 1.0):
        return ToxicityModel(trigrams, {}, prior)
    reader = Reader(trigrams)
    sets = [features_of(reader.words(t)) for t, _ in rows]
    pos, neg = Counter(), Counter()
    for s, v in zip(sets, y):
        (pos if v else neg).update(s)
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = {f: np.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (neg[f] + 0.5)) for f, a in pos.items() if a >= 4}
    names = sorted(f for f, o in odds.items() if o > 1.6)
    index = {f: k for k, f in enumerate(names)}
    found = [np.array(sorted(index[f] for f in s if f in index), np.int64) for s in sets]
    # Copies of label 1's rows with most features left out: one restored word has to tell as much as many.
    rng = np.random.default_rng(11)
    for keep in (0.5, 0.25):
        thin = [found[k][rng.random(len(found[k])) < keep] for k in np.flatnonzero(y[: len(rows)] == 1)]
        found += [t for t in thin if len(t)]
    y = np.concatenate([y, np.ones(len(found) - len(y))])
    # Features of all rows one after another; most rows hold few of them.
    cols, line = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    w, offset = np.zeros(len(names)), prior
    m, v2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(line, w[cols], len(y)) + offset
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(cols, d[line], len(names)) + 2e-5 * w, d.sum())
        m += 0.1 * (g - m)
        v2 += 0.01 * (g * g - v2)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.99**step)) + 1e-9)
        w, offset = w - move[:-1], offset - move[-1]
    return ToxicityModel(trigrams, {f: float(a) for f, a in zip(names, w) if abs(a) > 1e-3}, float(offset))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        s = [model.probability(t) for t in strings(b.column(1))]
        return {"doc_id": b.column(0), "held_out": b.column(2), "score": s, "predicted": [int(v >= THRESHOLD) for v in s]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id"))), run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    trigrams = log_model(trigram_counts(docs))
    return score(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE_ROWS), trigrams))
