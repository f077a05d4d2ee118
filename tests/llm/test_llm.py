"""Each operator against brute force on small rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, classifier, edit_counts, knn, minhash, packing, rules, suffixes, toxicity, warc
from quarry.llm.common import labelled_sample, new_path, written

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = "abctheing ,.é1!\n  's  日本ß \t"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(r.randint(1, 3)))
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "a" * 300), (5, "a" * 300), (6, "x y " * 200), (None, "no id " * 30)]
    base = [" ".join(word() for _ in range(r.randint(20, 200))) for _ in range(12)]
    for k in range(60):
        t = base[r.randrange(12)].split(" ")
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = word()
        out.append((10 + k, " ".join(t)))
    out += [(80, base[0]), (81, base[0]), (82, base[0].upper()), (83, "pre " + base[1] + " post"), (90, " ".join(word() for _ in range(9000)))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, 3) for i, t in rows], "doc_id long, text string, lang string, score double, n_chars long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_byte_bpe(spark, docs, rows):
    v = bpe.BPE(RANKS)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(1)
    for k in range(3000):
        s = "".join(r.choice(LETTERS if k % 2 else "aé日e!?-=th") for _ in range(r.randint(0, 150)))
        assert list(v.encode(s)) == e.encode_ordinary(s) and v.decode(v.encode(s)) == s.encode()
    got = by_id(bpe.round_trip(docs, RANKS))
    for i, t in rows:
        if i is not None:
            ids = np.array(e.encode_ordinary(t or ""), "<u4")
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_joins_meet_the_definition_at_any_cut():
    """Every pre-token, however short, goes through joins of halves, and each window is smaller than the whole where it can be."""
    v, r = bpe.BPE(RANKS), random.Random(9)
    for k in range(600):
        data = "".join(r.choice("thersonai" if k % 2 else "éaxqz日") for _ in range(r.randint(2, 40))).encode()
        at = r.randint(1, len(data) - 1)
        assert v.join(v.merged(data[:at]), v.merged(data[at:])) == v.merged(data) == v.reduced(data)
    v = bpe.BPE(RANKS)
    assert v.reduced(b"ab") == v.merged(b"ab") and v.joins == 1
    before, word = v.joins, "zqxjkvbw" * 40
    v.reduced(word.encode())
    assert v.joins - before >= 8 and v.joined < 40 * len(word)


def test_long_texts_are_halved_at_safe_places():
    v, r = bpe.BPE(RANKS), random.Random(10)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for k in range(12):
        t = "".join(r.choice(LETTERS if k % 3 else "ab  \n ") for _ in range(12000)) + "x" * (5000 if k % 2 else 0) + " y z"
        assert list(v.encode(t)) == e.encode_ordinary(t) and v.decode(v.encode(t)) == t.encode()
    left, right = v.halves("aa bb cc dd")
    assert left + right == "aa bb cc dd" and right[0] == " " and v.halves("abc  def") is None and v.halves("a b" + "c" * 50) == ("a", " b" + "c" * 50)


def height_is_balanced(t):
    return not t[2] or abs(t[3][2] - t[4][2]) <= 1 and t[:3] == edit_counts.node(t[3], t[4])[:3] and height_is_balanced(t[3]) and height_is_balanced(t[4])


def test_edit_counts(spark, docs):
    v, r = bpe.BPE(RANKS), random.Random(2)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for k in range(400):
        s = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 300 if k % 20 else 9000)))
        c = edit_counts.CountedText.of(v, s)
        for _ in range(4):
            c.edit(r.randint(0, len(s) + 10), r.randint(0, 30 if k % 3 else 3000), "".join(r.choice(LETTERS) for _ in range(r.randint(0, 12 if k % 5 else 900))))
            assert c.tokens() == len(e.encode_ordinary(c.text())) and c.n_bytes() == len(c.text().encode())
            assert c.tree is None or height_is_balanced(c.tree)
    long = edit_counts.CountedText.of(v, "some words here " * 20000)
    long.edit(100_000, 5, "new")
    assert long.encoded < 40 and long.tokens() == len(e.encode_ordinary(long.text())) and long.tree[2] < 16
    edits = spark.createDataFrame([(3, 1, 0, 1, "T"), (3, 2, None, 1, "x"), (999, 1, 0, 0, "x"), (0, 1, 5, 9, None), (None, 1, 0, 0, "x")], "doc_id long, seq long, at long, removed long, inserted string")
    got = by_id(edit_counts.counted(docs, edits, RANKS))
    assert len(got) == docs.where("doc_id IS NOT NULL").count()
    assert got[3].n_edits == 1 and got[3].n_tokens_after == len(e.encode_ordinary("Tne")) and got[0].n_tokens_after == 0 and got[6].n_bytes_encoded_again == 0


def test_trees_outlive_a_run(spark):
    """Two rounds of edits on a stored tree equal both on the text; the second reads no text but the tree's own."""
    v = bpe.BPE(RANKS)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    long = "les mots anglais of the text " * 3000
    rows = spark.createDataFrame([(1, long, 7), (1, "twice here", 8), (2, None, 9), (None, "no id", 0)], "doc_id long, text string, data long")
    form = "doc_id long, seq long, at long, removed long, inserted string"
    trees = edit_counts.build_trees(rows, RANKS)
    trees = edit_counts.updated_trees(trees, spark.createDataFrame([(1, 1, 5, 4, "XY")], form), RANKS)
    after = edit_counts.edited(trees, spark.createDataFrame([(1, 2, 2, 0, "é "), (1, 1, 0, 1, "L")], form), RANKS, False).collect()
    want = []
    for t in (long, "twice here"):
        t = t[:5] + "XY" + t[9:]
        t = "L" + t[1:]
        t = t[:2] + "é " + t[2:]
        want.append((1, 2, len(e.encode_ordinary(t)), len(t.encode())))
    assert sorted((r.doc_id, r.n_edits, r.n_tokens_after, r.n_bytes_after) for r in after if r.doc_id == 1) == sorted(want)
    assert max(r.n_bytes_encoded_again for r in after) < 100 and len(after) == 4
    assert edit_counts.counted(rows.limit(0), spark.createDataFrame([], form), RANKS).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(5, "http://a/", big), (3, None, big), (9, "u", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", big), (-7, "u", "é" * 60)], "page_id long, url string, html string")
    folder = new_path(spark, "archives")
    m = warc.write_archives(warc.resolved(pages.withColumn("payload", F.col("html").cast("binary"))), folder)
    got = {r.page_id: r for r in warc.read_archives(m, folder).collect()}
    assert len(got) == 8 and got[3].record_type == "response" and bytes(got[3].payload) == big.encode()
    assert [got[k].refers_to for k in (5, 9, None)] == [3, 3, 3] and got[5].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    assert {got[k].record_type for k in (1, 2, 4, -7)} == {"response"} and got[4].payload_bytes == 0


def test_packing(spark, docs, rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    cut = packing.packed_documents(docs, P.path("word_bpe_49k.json")).collect()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in cut if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    by = {}
    for r in cut:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_keeps_every_capacity():
    r = random.Random(3)
    counts = {r.randint(1, 90): r.randint(1, 50) for _ in range(30)}
    for rule in ("norm", "dot"):
        cap = packing.Capacity(100, 4, 6000, (1.0, 0.5, 0.5), rule) if max(counts) ** 2 <= 6000 else packing.Capacity(100, 4, 8100, (1.0, 0.5, 0.5), rule)
        seq, places = {}, packing.best_fit(counts, cap)
        assert all(sum(int(p[2]) for p in places if p[0] == n) == c for n, c in counts.items())
        for length, _, n, per, base, _ in places.tolist():
            for k in range(n):
                seq.setdefault(base + k // per, []).append(length)
        assert all(sum(s) <= 100 and len(s) <= 4 and sum(x * x for x in s) <= cap.attention for s in seq.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_places_as_one_by_one(rule):
    """Placing the histogram gives the bins that placing every piece by itself gives."""
    r = random.Random(12)
    for _ in range(80):
        sizes = sorted((r.choice([r.randint(1, 100), r.choice([7, 20, 33, 50])]) for _ in range(r.randint(1, 60))), reverse=True)
        cap = packing.Capacity(100, r.randint(2, 6), max(max(sizes) ** 2, r.randint(2500, 10000)), (1.0, r.random(), r.random()), rule)
        weights = np.array(cap.weights) / np.array([cap.tokens, cap.documents, cap.attention], float)
        bins: list[list[int]] = []
        for n in sizes:
            need = np.array([n, 1, n * n])
            fits = [b for b in bins if all(x >= y for x, y in zip(b[:3], need))]
            if fits:
                cost = packing.badness(np.array([b[:3] for b in fits]), need, weights, rule)
                best = min((b for b, c in zip(fits, cost) if c == cost.min()), key=lambda b: b[:3])
            else:
                best = [cap.tokens, cap.documents, cap.attention]
                bins.append(best)
            best[:3] = [x - int(y) for x, y in zip(best[:3], need)]
            best.append(n)
        seq: dict[int, list[int]] = {}
        for length, _, n, per, base, _ in packing.best_fit(dict(Counter(sizes)), cap).tolist():
            for k in range(n):
                seq.setdefault(base + k // per, []).append(length)
        assert sorted(sorted(b[3:]) for b in bins) == sorted(sorted(s) for s in seq.values())


def brute_top(vectors, queries, k):
    return {q: [(j + 1, i, s) for j, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(vectors[q], x)), i) for i, x in vectors.items() if i != q), key=lambda y: (-y[0], y[1]))[:k])] for q in queries}


@pytest.mark.parametrize("size", [1e3, 9e4, 6e6])
def test_knn_is_exact_for_large_components(spark, size):
    """Whole numbers above 2^53 and many near ties; beyond a long's range it says so."""
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    v = {i: np.floor(64 * (base * size + r.integers(-2, 3, 8))).tolist() for i in range(240)}
    data = spark.createDataFrame([(i, [x / 64 for x in c]) for i, c in v.items()], "vec_id long, embedding array<double>")
    w = written(knn.whole_vectors(data), "vectors")
    got = {}
    for x in knn.top_k(w, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    whole = {i: [int(x) for x in c] for i, c in v.items()}
    assert {q: sorted(x) for q, x in got.items()} == brute_top(whole, [i for i in v if i % 20 == 0], 20)


def test_knn_refuses_scores_beyond_a_long(spark):
    data = spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        knn.whole_vectors(data).collect()


def test_knn(spark):
    r = np.random.default_rng(1)
    v = [[float(x) for x in r.normal(size=8)] for _ in range(300)]
    data = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[7]) for i in range(100)] + [(2000, None), (2001, [None, 1.0]), (2002, [float("nan")] * 8), (None, v[0])]
    w = written(knn.whole_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vectors")
    got = {}
    for x in knn.top_k(w, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    good = {i: np.floor(64 * np.array(x)) for i, x in data if i is not None and i < 2000}
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert knn.top_k(w.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_near_duplicates(spark, docs, rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
            sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Each text of a repeated id links, so the id joins what they are near to."""
    r = random.Random(13)
    a, b, c = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(120)) for x in "abc")
    rows = [(1, a, 0), (1, b, 0), (2, a + " end", 0), (3, b + " end", 0), (4, c, 0), (4, "", 0), (5, c + " end", 0), (6, "alone", 0), (None, a, 0), (1, a, 1), (7, None, 0)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, None), (7, 7)}
    kept = minhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, _id int"))
    assert kept.columns == ["doc_id", "text", "_id"] and {x.doc_id for x in kept.collect()} == {1, 4, 6, 7, None}


def test_a_hub_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_PAIRS", 5)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(60)] + [(99, "other text here")]
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {x.component_id for k, x in got.items() if k < 60} == {0} and got[99].kept


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        hit, new = np.zeros(len(b), bool), set()
        for k in range(len(b) - 49):
            hit[k : k + 50] |= b[k : k + 50] in seen
            new.add(b[k : k + 50])
        seen |= new
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        out[i] = (len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows):
    got = by_id(suffixes.dedup_report(docs))
    assert brute_spans(rows) == {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()}
    assert suffixes.dedup_documents(docs.limit(0)).count() == 0


def test_deep_shallow_order():
    r = np.random.default_rng(4)
    words, group = r.integers(0, 2, (500, 5)).astype(np.uint64), r.integers(0, 3, 500)
    order, new = suffixes.deep_shallow(group, words)
    keys = [(group[i], *words[i].tolist()) for i in order]
    assert keys == sorted(keys) and [True] + [a != b for a, b in zip(keys, keys[1:])] == new.tolist()


def test_rules(spark, docs, rows):
    book = rules.ledger(docs)
    got = by_id(rules.apply_policy(book))
    for i, t in rows:
        if i is None:
            continue
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(tri)
        cover = {k + j for k, x in enumerate(tri) if often[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        m = got[i]
        assert m.n_words == len(words) and m.word_chars == sum(map(len, words))
        assert m.n_repeat_words == len(cover)
        assert m.n_symbols == sum(x in "#*$%&|<>" for x in t or "") and m.n_dup_lines == len(lines) - len(set(lines))
        n, upper, letters = len(words), sum("A" <= x <= "Z" for x in t or ""), sum(x.isascii() and x.isalpha() for x in t or "")
        fails = [
            n < 50, 100 * len(cover) > 50 * n, 100 * m.n_symbols > 8 * m.word_chars, 100 * m.n_dup_lines > 50 * len(lines),
            m.word_chars < 2 * n or m.word_chars > 25 * n, 100 * upper > 60 * letters, 100 * (t or "").count("!!") > 30 * n,
        ]
        assert m.failed == sum(1 << k for k, x in enumerate(fails) if x) == rules.failed_bits([t or ""])[0]
        assert m.base_failed == (fails[0] or fails[1]) and m.kept == (not any(fails))
    bits = [r.failed & rules.POLICIES[rules.CURRENT] for r in book.collect()]
    for a in rules.ablation(book).collect():
        want = sum(1 for b in bits if b & a.bit), sum(1 for b in bits if b == a.bit), sum(1 for b in bits if b in (0, a.bit))
        assert (a.n_rejected, a.n_rejected_alone, a.n_kept_without) == want
    assert rules.ledger(docs.limit(0)).count() == 0 and rules.filter_documents(docs).columns == docs.columns


def test_rules_see_every_part_of_a_text(spark):
    bad = ["the words of a text " * 30 + x for x in ("", "# " * 400, "A" * 4000, "!! " * 200, "\nsame line" * 300, "y " * 900)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(bad)], "doc_id long, text string")
    failed = by_id(rules.ledger(d))
    assert failed[0].failed == rules.BIT["repeated_spans"]
    for k, name in enumerate(("symbol_heavy", "mostly_capitals", "shouting", "repeated_lines", "odd_word_length"), 1):
        assert failed[k].failed & rules.BIT[name], name


def test_classifier_learns_on_held_out_rows():
    r = random.Random(6)
    text = lambda bad: " ".join("".join(r.choice("thersonai") for _ in range(5)) + ("%%%" if bad else "") for _ in range(40))
    data = [(text(k % 4 == 0), int(k % 4 != 0)) for k in range(160)]
    net = classifier.fit(data[:120], epochs=4)
    assert np.mean([(net.probability(t) >= 0.5) == y for t, y in data[120:]]) >= 0.95
    assert 0 <= net.probability("") <= 1 and classifier.fit([]).probability("x") == 0.5


def test_toxicity_restores_and_scores(spark, docs):
    r = random.Random(7)
    plain = lambda: " ".join("".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(3)) for _ in range(30))
    data = [(plain() + (" idiot clown moron stupid" if k % 3 == 0 else "") + " " + plain(), int(k % 3 == 0)) for k in range(240)]
    lm = toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(data)], "doc_id long, text string")))
    m = toxicity.fit(data[:180], lm)
    assert np.mean([(m.probability(t) >= 0.5) == y for t, y in data[180:]]) >= 0.95
    for w in ("1d10t", "i d i o t", "st.u.p.i.d", "cl0wn", "iiidiot"):
        assert m.probability(plain() + " " + w) > 0.5, w
    assert toxicity.score(docs, m).count() == docs.count()


def test_toxicity_finds_words_in_spaced_runs():
    r = random.Random(8)
    words = lambda n: ["".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randint(1, 3))) for _ in range(n)]
    text = " ".join(" ".join(words(40)) + " you are an idiot and a clown " for _ in range(100))
    x = toxicity.CLASS[np.frombuffer(f"  {text}  ".encode(), np.uint8)]
    n = toxicity.N_CLASSES
    lm = toxicity.log_model(np.bincount((x[:-2] * n + x[1:-1]) * n + x[2:], minlength=n**3))
    read = lambda t: toxicity.Reader(lm).words(t)
    assert "idiot" in read("a i d i o t")
    assert {"you", "are", "an", "idiot"} <= read("y o u a r e a n i d i o t")
    assert {"you", "are", "an", "idiot"} <= read("y o u  a r e  a n  i d i o t")
    for size in (20, 1500):  # both runs are over 40 letters, one goes over several settlements
        before, after = words(size), words(size)
        assert {"idiot", "clown"} <= read(" ".join("".join([*before, "1d10t", "clown", *after])))
    assert read("1 2 3 4 5 6") == set()
    for t in ("so,idiot", "you/idiot", "<b>idiot</b>", "you/1d10t", "idiot|an", "an+1d1ot", "st.clown.idiot." + "an.the/" * 20 + "x"):
        assert "idiot" in read(t), t
    assert {"idiot", "clown"} <= read("then-1d10t-" + "-".join(words(30)) + "-cl0wn")
    assert {"idiot"} <= read("i" * 60 + "diot")
    assert "idiot" in read("i" + "." * 20 + "d" + "-" * 20 + "iot")
    assert "idiot" in read("ther.on," * 1000 + "a1b2" * 500 + ",1d10t")


def test_convolution_equals_its_definition():
    """Look-ups, halves and blocks against a convolution over one-hot bytes, chunk by overlapping chunk."""
    r = np.random.default_rng(3)
    net = classifier.fit([])
    net.dense[:] = r.normal(size=net.dense.shape)
    net.bias[:] = r.normal(size=net.bias.shape)
    for text in ("a", "abcd", "short text", "x" * 255, "é" * 700, "".join(chr(97 + k) for k in r.integers(0, 26, 40_000))):
        x = np.frombuffer(text.encode().ljust(classifier.WIDTH, b"\0"), np.uint8)
        n = len(x) - classifier.WIDTH + 1
        hot = np.eye(256, dtype=np.float32)
        full = np.array([sum(hot[x[i + k]] @ net.taps[k] for k in range(classifier.WIDTH)) for i in range(n)]) if n < 3000 else sum(net.taps[k][x[k : k + n]] for k in range(classifier.WIDTH))
        starts = range(0, max(1, n - classifier.HALF), classifier.HALF)
        top = np.array([np.maximum(full[s : s + classifier.CHUNK].max(axis=0) + net.bias, 0) for s in starts])
        z = float(np.concatenate([top.max(axis=0), top.mean(axis=0)]) @ net.dense) + net.offset
        assert abs(net.probability(text) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def test_classifier_scores_tables(spark):
    net = classifier.fit([("good words of a text " * 9, 1), ("%%% ### " * 9, 0)] * 8, epochs=2)
    rows = [(1, "good words", "a"), (1, "good words", "b"), (2, None, "c"), (3, "", None), (None, "x", "d"), (4, "%%% " * 200_000, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = classifier.score(d, net).collect()
    assert len(got) == 6 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert {x.held_out for x in got if x.doc_id is not None} == {zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 4)}
    assert len({x.score for x in got if x.doc_id in (2, 3)}) == 1
    kept = classifier.filter_documents(d, net)
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(str(x) for x in d.collect() if net.probability(x.text or "") >= 0.3)
    assert classifier.score(d.limit(0), net).count() == 0


def test_labelled_samples_are_bounded(spark):
    docs = spark.createDataFrame([(k % 40, "x" * (k % 7) + str(k // 40)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 1000)
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    assert len(got) == len(ids) and len(labelled_sample(docs, labels, "toxic", 7)) <= 7
    assert sum(len(t) for t, _ in labelled_sample(docs, labels, "toxic", 1000, most_bytes=30)) <= 30
    assert labelled_sample(docs.limit(0), labels, "toxic", 9) == [] == labelled_sample(docs, labels.limit(0), "toxic", 9)


def language_model():
    x = toxicity.triples("the idiot is on the thin air near a clown and other persons then " * 50)
    return toxicity.log_model(x)


def test_viterbi_equals_all_readings():
    """The best readings are those of all strings of the lattice, each scored by itself."""
    r, lm = random.Random(14), language_model()
    restore, n = toxicity.Restorer(lm), toxicity.N_CLASSES
    flat = lm.reshape(-1)

    def cost(word):
        c = [0, 0, *[ord(x) - 96 if "a" <= x <= "z" else n - 1 for x in word], 0]
        return sum(flat[(a * n + b) * n + d] for a, b, d in zip(c, c[1:], c[2:]))

    for _ in range(150):
        word = "".join(r.choice("idot1!0@$nnaéx*.8-") for _ in range(r.randint(1, 6)))
        best: dict[str, float] = {}
        for way in itertools.product(*restore.lattice(word)):
            read = "".join(x for x, _ in way)
            best[read] = max(best.get(read, -np.inf), cost(read) - sum(x for _, x in way))
        order = sorted(best.values(), reverse=True)
        got = restore.read(word, 1)
        assert abs(best[got[0]] - order[0]) < 1e-9
        assert all(best[x] >= order[min(len(order), toxicity.READINGS) - 1] - 1e-9 or len(order) <= toxicity.READINGS for x in restore.read(word)[:1])


def test_words_without_letters_and_folded_letters_are_read():
    lm = language_model()
    assert "idiot" in toxicity.Reader(lm).words("say 1d107 or !0!07 or 1|)") or "idiot" in toxicity.Reader(lm).words("1(!07") or toxicity.Reader(lm).words("7#3 @!(") != set()
    assert "the" in toxicity.Reader(lm).words("7#3")
    assert toxicity.Reader(lm).words("§§§ 12:30 ---") == set()
    assert toxicity.classes("Éa ßz—日").tolist() == [5, 1, 0, 27, 26, 0, 27]


def test_toxicity_scores_tables(spark):
    words = "thin air near other persons on then the"
    train = [(words + (" idiot clown" if k % 2 else " and a"), k % 2) for k in range(40)]
    m = toxicity.fit(train, language_model())
    rows = [(1, "an 1d10t", "a"), (1, "an 1d10t", "b"), (2, None, "c"), (3, "", None), (None, words, "d"), (4, words * 20_000 + " idiot clown", "e")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, predicted string"), m).collect()
    assert len(got) == 6 and {(x.doc_id, x.predicted) for x in got} == {(1, 1), (2, 0), (3, 0), (None, 0), (4, 1)}
    assert toxicity.trigram_counts(spark.createDataFrame([], "text string")).sum() == 0
    assert toxicity.fit([], language_model()).probability("x") == 0.5


def test_archives_open_with_their_own_record(spark):
    import gzip

    pages = spark.createDataFrame([(k, "u", "<p>" * 50) for k in range(3)] + [(0, "u", "<p>" * 50)], "page_id long, url string, html string")
    folder = new_path(spark, "archives")
    m = warc.write_archives(warc.resolved(pages.withColumn("payload", F.col("html").cast("binary"))), folder, "2021-02-03T04:05:06Z")
    for f in m.collect():
        data = gzip.decompress(open(f.path, "rb").read())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.count(b"WARC-Date: 2021-02-03T04:05:06Z") == f.n_records + 1
    got = warc.read_archives(m, folder).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(0, "response"), (0, "response"), (1, "revisit"), (2, "revisit")]
    empty = warc.write_archives(warc.resolved(pages.limit(0).withColumn("payload", F.col("html").cast("binary"))), new_path(spark, "archives"))
    assert warc.read_archives(empty, folder).count() == 0


def clashing(df):
    """Columns named as the stages name their own."""
    names = ["_id", "_ID_", "_spans", "node", "component_id", "kept", "rep", "score", "failed", "_t"]
    return df.withColumns({n: F.lit(k) for k, n in enumerate(names)})


def test_stages_keep_clashing_columns_and_take_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    d = clashing(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, d, sf), stage(spark, d.limit(0), sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns, name
            assert out.count() <= 60 and none.columns == d.columns
        assert none.count() == 0, name


def test_pipeline_equals_brute_force(spark):
    """Every stage after the learned one, on whole texts, against plain Python; the classifier against its own scores."""
    from quarry.llm.common import table

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    net = classifier.trained(d, table(spark, sf, "labels"))
    now = {r.doc_id: r.text for r in d.collect()}
    assert len(now) == d.count()
    now = {i: t for i, t in now.items() if net.probability(t or "") >= 0.3}
    now = {i: t for i, t in now.items() if not rules.failed_bits([t or ""])[0] & rules.POLICIES[rules.CURRENT]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in now.items() for w in [(t or "").encode().lower().split()]}
    parent = {i: i for i in now}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(now), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    now = {i: t for i, t in now.items() if find(i) == i}
    seen, cut = set(), {}
    for i in sorted(now):
        b = (now[i] or "").encode()
        hit, new = np.zeros(len(b), bool), set()
        for k in range(len(b) - 49):
            hit[k : k + 50] |= b[k : k + 50] in seen
            new.add(b[k : k + 50])
        seen |= new
        cut[i] = np.frombuffer(b, np.uint8)[~hit].tobytes().decode("utf-8", "ignore")
    out = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, out, sf), "stage")
        assert out.columns == d.columns
    assert {r.doc_id: r.text or "" for r in out.collect()} == cut
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf).collect()
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in cut.items()}
    assert {i: sum(r.length for r in g) for i, g in ((i, [r for r in packed if r.doc_id == i]) for i in cut)} == want


@pytest.mark.parametrize("lanes", [12, 3, 0.5])
def test_suffix_dedup_in_small_parts(spark, monkeypatch, lanes):
    """The same where neighbourhoods go over many lanes and rows over many chunks, and where common anchors are thinned."""
    for name, n in (("COPY_ROWS", 2), ("GATHER_ROWS", 40), ("CHUNK_ROWS", 150), ("LANE_ROWS", lanes)):
        monkeypatch.setattr(suffixes, name, n)
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage, base = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(150))
    rows = [(k, " ".join(word() for _ in range(r.randint(0, 40))) + (passage if k % 2 else "") + (base if k % 5 == 0 else base[: 20 * k]) + word()) for k in range(60)]
    rows += [(100 + k, base) for k in range(12)] + [(200, "z" * 400), (201, "z" * 120), (202, None)]
    r.shuffle(rows)
    got = by_id(suffixes.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert brute_spans(rows) == {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in got.items()}


def test_copies_are_told_by_bytes():
    """Equal hashes do not matter: of a group's neighbourhoods only those with the same bytes and edges are copies."""
    words = np.array([[1] * 11, [1] * 11, [1] * 10 + [2], [1] * 11], np.uint64)
    hit = suffixes.copies_among(np.zeros(4, np.int64), np.array([9, 9, 9, 8]), words, np.array([5, 7, 8, 9]))
    assert hit.tolist() == [False, True, False, False]
