import io
import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from quarry.functions import scoring, text, urls
from quarry.operators import corpus, evaluate, index, ops, rank, retrieve
from quarry.sources.readers import robots_allowed, robots_rules, wet_records


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first()[0]


def test_tokens_titles_phrases(spark):
    assert one(spark, text.tokens(F.col("t")), t="Nine LAMPS_were lit; by a 17th-floor é door") == ["nine", "lamps", "lit", "17th", "floor", "door"]
    assert index.words_of()("Nine LAMPS_were lit; by a 17th-floor é door") == ["nine", "lamps", "lit", "17th", "floor", "door"]
    assert one(spark, text.first_line(F.col("t")), t="\n  \n Head \nbody") == "Head"
    assert one(spark, text.phrases(F.col("t")), t='find "Two Words" and "open') == ["two words"]
    assert one(spark, text.cited_ids(F.col("t")), t="a [1], b [2,3] and [1]") == [1, 2, 3]


def test_url_keys(spark):
    a, b = "http://www.Example.com:80/a/?b=2&utm_x=1&a=1#top", "https://example.com/a?a=1&b=2"
    assert one(spark, urls.dedup_key(F.col("u")), u=a) == one(spark, urls.dedup_key(F.col("u")), u=b)
    assert one(spark, urls.in_site(F.col("u"), "x.org", "/guide"), u="https://x.org/guidebook") is False
    assert one(spark, urls.in_site(F.col("u"), "x.org", "/guide/"), u="https://a.x.org/guide") is True
    assert one(spark, urls.intake_problem(F.col("u")), u="https://a:b@x.org/") == "credentials"
    assert one(spark, urls.registered(F.col("h")), h="a.b.co.uk") == "b.co.uk"


def test_scores(spark):
    assert one(spark, scoring.decay(F.col("d"), 10.0), d=10.0) == 0.5
    assert one(spark, scoring.decay(F.col("d")), d=-3.0) == 1.0
    assert one(spark, scoring.refresh_days(F.col("d"), 1.0, 30.0), d=100.0) == 30.0


def small_index(spark):
    docs = spark.createDataFrame(
        [(1, "cat", "cat sat mat", "a.org"), (2, "dog", "dog ran far", "b.org"), (3, "cat dog", "cat dog ran", "a.org"), (4, "", "", "b.org"), (5, None, None, None)],
        "doc_id long, title string, text string, host string",
    ).withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/")))
    return index.Index.of(docs)


def brute_bm25(rows, query):
    """Scores by the formula, one document at a time. rows: doc_id -> (title words, body words)."""
    tf = {i: {w: 3 * t.count(w) + b.count(w) for w in {*t, *b}} for i, (t, b) in rows.items()}
    size = {i: len(t) + len(b) for i, (t, b) in rows.items()}
    sized = [n for n in size.values() if n]
    mean, out = sum(sized) / len(sized), {}
    for i in rows:
        s = 0.0
        for w in set(query):
            df = sum(w in x for x in tf.values())
            if w in tf[i]:
                idf = math.log(1 + (len(sized) - df + 0.5) / (df + 0.5))
                s += idf * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * size[i] / mean))
        if s:
            out[i] = round(s, 6)
    return out


def test_bm25_by_blocks_by_shuffle_and_by_hand(spark, monkeypatch):
    ix = small_index(spark)
    assert tuple(ix.stats.first()) == (3, (4 + 4 + 5) / 3, 13)
    q = spark.createDataFrame([(1, "cat"), (2, "ran dog"), (3, "the"), (4, "nothing here")], "query_id long, query string")
    rows = {1: (["cat"], ["cat", "sat", "mat"]), 2: (["dog"], ["dog", "ran", "far"]), 3: (["cat", "dog"], ["cat", "dog", "ran"])}
    want = {(n, i, s) for n, words in ((1, ["cat"]), (2, ["ran", "dog"])) for i, s in brute_bm25(rows, words).items()}
    assert {(r.query_id, r.doc_id, r.score) for r in retrieve.bm25(q, ix).collect()} == want
    assert {tuple(r) for r in retrieve.scored(q, ix).collect()} == want
    monkeypatch.setattr(retrieve, "TERM_BOUND", 1)
    assert {(r.query_id, r.doc_id, r.score) for r in retrieve.bm25(q, ix).collect()} == want
    monkeypatch.setattr(retrieve, "TERM_BOUND", 100)
    monkeypatch.setattr(retrieve, "CELLS", 3)
    assert {(r.query_id, r.doc_id, r.score) for r in retrieve.bm25(q, ix).collect()} == want
    assert {(r.query_id, r.doc_id, r.score) for r in retrieve.pruned(q, ix, 1).collect()} == {x for x in want if x[2] == max(y[2] for y in want if y[0] == x[0])}
    here = retrieve.bm25(q, ix, where=F.col("host") == "a.org")
    assert {(r.query_id, r.doc_id, r.score) for r in here.collect()} == {x for x in want if x[1] != 2}
    assert retrieve.bm25(q.limit(0), ix).count() == 0


def test_stored_postings_and_reindexing(spark):
    ix = small_index(spark)
    got = {(r.term, r.doc_id, r.tf) for r in ix.scan(["cat", "far"]).collect()}
    assert got == {("cat", 1, 4), ("cat", 3, 4), ("far", 2, 1)} and ix.scan([]).count() == 0
    assert {r.doc_id for r in ix.scan(["dog"], "a.org").collect()} == {3}
    plan = ix.scan(["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    new = spark.createDataFrame([(1, "", "bird"), (9, "", "bird ran")], "doc_id long, title string, text string")
    again = ix.reindexed(new, spark.createDataFrame([(2,)], "doc_id long"))
    assert {(r.term, r.doc_id) for r in again.postings.select("term", "doc_id").collect()} == {("bird", 1), ("bird", 9), ("ran", 9), ("cat", 3), ("dog", 3), ("ran", 3)}
    assert {r.term for r in index.orphaned_terms(ix.terms, again.postings).collect()} == {"sat", "mat", "far"}


def test_dense_hits_in_rounds_and_with_broken_vectors(spark, monkeypatch):
    v = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 2.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [float("nan"), 1.0])]
    p = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    q = p.where("vec_id IN (1, 3, 5)").select(F.col("vec_id").alias("query_id"), "embedding")
    want = [(1, 1, 1), (1, 2, 2), (3, 1, 3), (3, 2, 2)]
    for bound in (100, 2):
        monkeypatch.setattr(retrieve, "VECTOR_BOUND", bound)
        assert sorted((r.query_id, r["rank"], r.doc_id) for r in retrieve.dense(q, p, 2).collect()) == want
    assert retrieve.dense(q.limit(0), p, 2).count() == 0


def test_best_spans_come_out_of_the_scan(spark, monkeypatch):
    x = np.random.default_rng(6).integers(-2, 3, (240, 3)).astype(float)  # many ties
    x[:, 0] += 0.5
    rows = [(n, [float(y) for y in v] if n % 31 else None, n % 7, n * 10, 5 + n % 3) for n, v in enumerate(x)]
    p = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, byte_offset long, byte_length int").repartition(5)
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = set()
    for a, v, *_ in rows[::20]:
        best = {}
        for n, w, label, at, size in rows:
            if v and w:
                s = round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 6)
                best[label] = min(best.get(label, (9.0,)), (-s, n, at, size))
        for rank, (label, (s, _, at, size)) in enumerate(sorted(best.items(), key=lambda i: (i[1][0], i[0]))[:2], 1):
            want.add((a, rank, label, -s, at, size))
    for cells in (4_000_000, 60):
        monkeypatch.setattr(retrieve, "CELLS", cells)
        got = retrieve.best_spans(q, p, F.col("label"), 2)
        assert {tuple(r) for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert retrieve.best_spans(q.limit(0), p, F.col("label"), 2).count() == 0


def test_weights_that_are_no_weights_count_as_one(spark):
    l = [spark.createDataFrame([(1, k, d) for k, d in enumerate(x, 1)], "query_id long, rank int, doc_id long") for x in ((7, 8), (8, 9))]
    even = [tuple(r) for r in retrieve.fused_lists(l, 5).collect()]
    assert [tuple(r) for r in retrieve.fused_lists(l, 5, [1.0]).collect()] == even == [tuple(r) for r in retrieve.fused_lists(l, 5, [2.0, 0.0]).collect()]
    assert retrieve.fused_lists(l, 1, [9.0, 1.0]).first().doc_id == 8 and retrieve.fused_lists([l[0], l[1]], 3, [9.0, 1.0]).collect()[1].doc_id == 7


def test_metrics_and_upsert(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank int, doc_id long")
    rel = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, doc_id long")
    got = {r.query_id: (r.recall, r.mrr) for r in evaluate.metrics(ranked, rel).collect()}
    assert got == {1: (1.0, 0.5), 2: (0.0, 0.0)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in corpus.upserted(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_diversified_with_full_weight_keeps_order(spark):
    c = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [1.0, 0.1]), (1, 3, 0.7, [0.0, 1.0])], "query_id long, doc_id long, score double, vector array<double>")
    assert [r.doc_id for r in rank.diversified(c, 1.0, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.doc_id for r in rank.diversified(c, 0.3, 2).orderBy("rank").collect()] == [1, 3]
    # What points the other way is no better than what is unlike; few candidates keep their order.
    far = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.5, [0.0, 1.0]), (1, 3, 0.4, [-1.0, 0.0])], "query_id long, doc_id long, score double, vector array<double>")
    assert [r.doc_id for r in rank.diversified(far, 0.5, 2).orderBy("rank").collect()] == [1, 2]
    assert [r.doc_id for r in rank.diversified(far, 0.0, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_robots():
    rules = robots_rules("User-agent: *\nDisallow: /private\nAllow: /private/open\nUser-agent: bot\nDisallow: /*.pdf$\n")
    assert not robots_allowed(rules, "other", "/private/x") and robots_allowed(rules, "other", "/private/open/1")
    assert robots_allowed(rules, "MyBot/1", "/private") and not robots_allowed(rules, "mybot", "/a.pdf")


def test_wet_records():
    body = "Titel é\ntext".encode()
    data = b"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    assert list(wet_records(io.BytesIO(data * 2))) == [("conversion", "http://x/", body)] * 2


def test_lane_shares(spark):
    rows = [(f"u{i}", i % 4, 1.0, i, "queued") for i in range(400)]
    f = spark.createDataFrame(rows, "url string, lane int, priority double, enqueued_at long, status string")
    first = ops.lane_order(f).orderBy("slot", "url").limit(100).groupBy("lane").count().collect()
    assert {r["lane"]: r["count"] for r in first} == {0: 50, 1: 30, 2: 15, 3: 5}


def test_registered_queries_have_unique_sql():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_entity_rewrites_know_every_form(spark):
    asked = {
        "Who created the Linux kernel?": ["linux kernel creator inventor founder", "linux kernel history origin", "linux kernel developer designer"],
        "who wrote 1984?": ["1984 author writer", "1984 book novel publication"],
        "who discovered radium": ["radium discoverer", "radium discovery history"],
        "who is the pope?": ["pope biography", "pope about"],
        "when was Bitcoin invented?": ["bitcoin date year", "bitcoin history origin"],
        "where is Oslo?": ["oslo location address country"],
        "How tall is Mount Everest?": ["mount everest height meters feet", "mount everest tall"],
        "how long is the nile?": ["nile size dimensions", "nile length width"],
        "What is the capital of Australia?": ["australia capital city"],
        "what is the longest river in the world!": ["river in the world superlative record"],
        "what is the population of Peru ?": ["peru population inhabitants census"],
        "why is the sky blue?": [],
    }
    rows = spark.createDataFrame([(q,) for q in asked], ["q"]).select("q", text.entity_rewrites(F.col("q")).alias("x")).collect()
    assert {r["q"]: r["x"] for r in rows} == asked


def test_fetched_returns_whole_texts(spark):
    wanted = spark.createDataFrame([(1, 7), (2, 9)], "position int, doc_id long")
    docs = spark.createDataFrame([(7, "ab " * 500)], "doc_id long, text string")
    assert [tuple(r) for r in corpus.fetched(wanted, docs).orderBy("position").collect()] == [(1, 7, True, "ab " * 500), (2, 9, False, None)]
    assert corpus.fetched(wanted, docs, 5).orderBy("position").first()["text"] == "ab ab"
