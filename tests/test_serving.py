"""Approximate neighbours, answers, research, the queue, the store's versions: what SQL cannot tell."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, answer, articles, ops, queue, rank, store
from quarry.operators import retrieve as V
from quarry.storage import Versions


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(1).normal(size=(600, 16))
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_graphs_find_and_forget():
    x = np.random.default_rng(2).normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = ann.Graph(64)
    for v in x:
        g.add(v)
    found = 0
    for q in x[:30]:
        truth = set(np.argsort(-(x @ q))[:10].tolist())
        found += len(truth & {n for _, n in g.search(q, 10)})
    assert found >= 0.85 * 300
    g.remove(0)
    assert 0 not in {n for _, n in g.search(x[0], 10)} and len(g.compacted()) == 499
    assert all(len(l) <= (g.s.ground_links if layer == 0 else g.s.links) for node in g.near for layer, l in enumerate(node))
    assert ann.Graph(4).search(np.ones(4), 3) == []


def test_graph_search_over_shards(spark, vectors, monkeypatch):
    q = vectors.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    truth = V.dense(q, vectors, 10)
    for rows in (4096, 200):
        monkeypatch.setattr(ann, "SHARD_ROWS", rows)
        r = ann.recall(truth, ann.graph_search(q, vectors, 10))
        assert r.count() == 40 and r.agg(F.avg("recall")).first()[0] >= 0.9


def test_codes(spark, vectors):
    book = ann.train_codebook(vectors, parts=4, centroids=32)
    x = np.random.default_rng(3).normal(size=(50, 16))
    codes = book.encode(x)
    for q in x[:5]:
        plain = [sum(float(((q[m * 4 : m * 4 + 4] - book.centres[m][c[m]]) ** 2).sum()) for m in range(4)) for c in codes]
        assert np.allclose(book.distances(q, codes), plain)
    q = vectors.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    e = ann.encoded(vectors, book)
    near = ann.recall(V.dense(q, vectors, 10), ann.code_search(q, e, book, vectors, 10)).agg(F.avg("recall")).first()[0]
    assert near >= 0.9 and ann.code_search(q, e, book, None, 3).count() == 60
    with pytest.raises(ValueError):
        ann.train_codebook(vectors, parts=5)


def test_coarse_codes_miss_none_of_the_best(spark, vectors):
    twin = vectors.where("vec_id = 7").select("embedding").first()[0]
    copies = spark.createDataFrame([(1000 - i, twin) for i in range(60)], vectors.schema)
    every = vectors.union(copies).union(spark.createDataFrame([(2000, None), (2001, [0.0] * 16)], vectors.schema)).repartition(3)
    q = vectors.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    book = ann.train_codebook(every, parts=2, centroids=2)
    e = ann.encoded(every, book)
    want = {tuple(r) for r in V.dense(q, every, 10).select("query_id", "rank", "doc_id").collect()}
    found = ann.code_search(q, e, book, every, 10)
    assert {tuple(r) for r in found.select("query_id", "rank", "doc_id").collect()} == want
    assert ann.code_search(q, e, book, every, 1000).count() == 40 * 660
    assert ann.code_search(q.limit(0), e, book, every, 10).count() == 0
    near = ann.near_codes(spark.sparkContext.broadcast(ann.sent_queries(q)), book, e, 10)
    assert ann.twins_before(np.array([5, 2, 9, 1]), np.array([[1.0], [1.0], [1.0], [2.0]])).tolist() == [1, 0, 2, 0]
    assert 400 <= near.count() < 0.1 * 40 * 660


def test_centroids_are_means():
    x = np.concatenate([np.full((20, 2), 0.0), np.full((30, 2), 9.0)]) + np.random.default_rng(4).normal(size=(50, 2)) * 0.01
    c = ann.k_means(x, 2, 10, np.random.default_rng(0))
    assert np.allclose(sorted(c[:, 0]), [0, 9], atol=0.05)


def test_exact_places_by_ranges_and_by_groups(spark):
    r = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in r.integers(0, 400, 5000)] + [("cold", 1.0), ("two", 3.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for name in ("hot", "cold", "two"):
        s = sorted(v for g, v in rows if g == name)
        want[name] = tuple(s[int((len(s) - 1) * p)] for p in (0.5, 0.95, 0.99))
    for ranges in (True, False):
        got = {x.g: (x.p50, x.p95, x.p99) for x in ops.percentiles(df, "v", [0.5, 0.95, 0.99], ["g"], ranges).collect()}
        assert got == want
    n = ops.numbered(df.where("g = 'hot'").withColumn("k", F.monotonically_increasing_id()), [], ["v", "k"], F.col("v"), "n").orderBy("v", "k").collect()
    assert [x.n for x in n] == list(range(1, 5001))


def test_a_failing_scorer_changes_nothing(spark):
    class Broken:
        def score(self, question, texts):
            raise RuntimeError("no model")

    hits = spark.createDataFrame([(1, 1, 5, 2.0), (1, 2, 6, 1.0)], "query_id long, rank int, doc_id long, score double")
    q = spark.createDataFrame([(1, "red lamp")], "query_id long, query string")
    docs = spark.createDataFrame([(5, "a blue lamp"), (6, "the red lamp")], "doc_id long, text string")
    order = lambda s: [r.doc_id for r in answer.reranked(answer.with_scores(hits, q, docs, s), 2).orderBy("rank").collect()]
    assert order(Broken()) == [5, 6] and order(answer.SharedWords()) == [6, 5]
    assert answer.gated(answer.with_scores(hits, q, docs, answer.SharedWords()), 0.9).count() == 1


def test_embedding_in_batches(spark):
    rows = spark.createDataFrame([(k, f"lamp {k % 3}") for k in range(10)] + [(99, None)], "doc_id long, text string")

    class Counted(answer.HashedWords):
        def embed(self, texts):
            assert len(texts) <= 4
            return super().embed(texts)

    got = {r.doc_id: r.embedding for r in answer.embedded(rows, Counted(8), batch=4).collect()}
    assert got[0] == got[3] != got[1] and not any(got[99]) and len(got[0]) == 8


def test_sizes_and_passes():
    assert [answer.passes(x) for x in (None, 0, 4, 99)] == [3, 3, 4, 10] and answer.passes(5, site=True) == 1
    assert [answer.peer_k(k) for k in (3, 40)] == [20, 80] and [rank.pool_size(k, n) for k, n in ((4, 0), (20, 0), (9, 5))] == [50, 100, 9]
    assert [answer.over_fetch(10), answer.over_fetch(10, domains=True), answer.over_fetch(10, dates=True), answer.over_fetch(10, site=True), answer.over_fetch(90, dates=True)] == [10, 50, 100, 300, 500]


def test_queue_claims_and_links(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("http://a/1", "a", 0, 1.0, 1, "queued"), ("http://a/2", "a", 0, 2.0, 2, "queued"), ("http://b/1", "b", 3, 0.5, 3, "queued"), ("http://c/1", "c", 0, 9.0, 4, "queued"), ("http://c/2", "c", 0, 1.0, 5, "in_flight")]
    f = spark.createDataFrame(rows, "url string, host string, lane int, priority double, enqueued_at long, status string")
    assert [r.url for r in queue.claimed(f, 3, F.lit(t)).collect()] == ["http://a/2", "http://b/1", "http://a/1"]
    assert {r.status for r in queue.recovered(f).collect()} == {"queued"} and queue.claimed_by_lane(f, 2).count() == 2
    links = spark.createDataFrame([("http://A/3#x", 1), ("http://a/4", 0), ("http://a/1", 0), ("ftp://x", 0), ("http://d/1", 9)], "url string, depth int")
    got = {(r.url, r.priority) for r in queue.links_queued(f, links, F.lit(t), 3).collect()}
    assert got == {("http://a/4", 1.0), ("http://d/1", round(1 / 3.25, 6))}
    assert queue.depth(f, hosts=["a", "z"]).collect()[0].n == 2


def test_versions_are_whole(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.latest() == 0
    assert v.save(spark.range(3).toDF("k")) == 1 and v.save(spark.range(5).toDF("k")) == 2
    assert v.read(1).count() == 3 and v.read().count() == 5
    # Data without a pointer is no version.
    spark.range(9).toDF("k").write.parquet(str(tmp_path / "t" / "data" / "half"))
    assert v.read().count() == 5
    assert store.copied(spark, str(tmp_path / "t" / "data"), str(tmp_path / "copy"), ["half"]) == {"half": 9}


def test_purges_dry_and_applied(spark):
    docs = spark.createDataFrame([(1, "http://bad.org/x"), (2, "http://a.bad.org/"), (3, "http://good.bad.org/"), (4, "http://fine.org/")], "doc_id long, url string")
    one = lambda x: spark.createDataFrame([(x,)], "suffix string")
    ids = lambda apply: sorted(r.doc_id for r in store.purge(docs, one("bad.org"), one("good.bad.org"), apply).collect())
    assert ids(False) == [1, 2] and ids(True) == [3, 4]
    p = spark.createDataFrame([(1, "m1"), (2, "m2")], "doc_id long, model string")
    assert store.other_models(p, "m1", False).first().doc_id == 2 and set(store.backfilled(docs.withColumn("text", F.lit("t"))).columns) >= {"host", "sha"}


def test_article_verdicts_by_topic_and_nearness(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.75, 0.66], 8), (3, [0.0, 1.0], 9)], "vec_id long, embedding array<double>, article long")
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], "lamps"), (3, [0.76, -0.65], None), (4, [-1.0, 0.0], "lamps")], "query_id long, embedding array<double>, topic string")
    a = spark.createDataFrame([(8, ["lamps"]), (9, ["lamps", "x"])], "id long, topics array<string>")
    got = {r.query_id: (r.verdict, r.match, r.article) for r in articles.verdicts(q, v, a).collect()}
    assert got == {1: ("covered", "embedding", 7), 2: ("covered", "alias", 8), 3: ("related", "embedding", 7), 4: ("none", None, None)}
    assert articles.title_blockers(v.select("vec_id", "embedding"), q).count() == 3
