"""Queries that answer, research and merge, and approximate neighbours, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as W
from ..operators import ann
from ..operators import evaluate as E
from ..operators import hybrid as H
from ..operators import rank as R
from ..operators import retrieve as V
from ..operators.index import Index
from ..sources.readers import Tables
from ..storage import written
from .catalog import ASKED_DENSE, BM, DENSE, DOCS, POST, QT, SCORED, asked, asked_vectors, docs, query, tok, top_sql, vectors_asked

# --- the plain interface, enrichment, filters


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 10)}), k AS (SELECT * FROM r JOIN docs USING (doc_id) WHERE doc_id % 9 <> 0 AND query_id IN (SELECT item_id FROM benchmark WHERE text <> '' AND octet_length(encode(text)) <= 2048 AND NOT regexp_matches(text, '[\\p{{Cc}}\\p{{Cf}}]'))) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, doc_id, url, title, score FROM k")
def v1_search(t):
    """Hits with address and title; those whose document is gone are left out and ranks closed up."""
    return W.v1_search(asked(t), W.Words(t.index), docs(t).where("doc_id % 9 <> 0"), 10)


@query(f"WITH {SCORED}, d AS (SELECT query_id, doc_id, round(score * exp(-ln(2) * greatest(doc_id % 400, 0) / 180.0), 6) AS score FROM ({top_sql('scored', 30)})) {top_sql('d', 10)}")
def decayed_search(t):
    """The 30 best by words, weighed by age: days since publication follow from the id."""
    d = docs(t).select("doc_id", (F.lit("1998-08-02").cast("timestamp") - F.make_dt_interval(days=(F.col("doc_id") % 400).cast("int"))).alias("published_at"))
    return W.decayed(V.bm25(asked(t), t.index, 30), d, F.lit("1998-08-02").cast("timestamp")).where("rank <= 10").select("query_id", "rank", "doc_id", "score")


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 10)}) SELECT query_id, rank, doc_id FROM r LEFT JOIN (SELECT doc_id, lang AS author FROM documents WHERE doc_id % 4 <> 0) USING (doc_id) WHERE author IS NULL OR (author LIKE '%e%' AND author NOT LIKE '%s%')")
def author_filter(t):
    """Hits without a row of metadata stay."""
    metas = t.documents.where("doc_id % 4 <> 0").select("doc_id", F.col("lang").alias("author"))
    return R.by_author(V.bm25(asked(t), t.index), metas, ["E"], ["S"]).select("query_id", "rank", "doc_id")


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 20)}) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 END ASC NULLS LAST, rank)::INT AS place FROM r")
def date_sort_ascending(t):
    """Oldest first, undated last, hits of one date by rank."""
    h = V.bm25(asked(t), t.index, 20).withColumn("when", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50))
    return R.by_date(h, "when", False, ["query_id"], "rank").select("query_id", "doc_id", "place")


@query(f"WITH {SCORED}, l AS ({top_sql('scored', 10, 'query_id, rank, doc_id')}), u AS (SELECT query_id, 0 AS list, rank, doc_id, 'first' AS title FROM l UNION ALL SELECT query_id, 1, 11 - rank, doc_id, 'second' FROM l WHERE doc_id % 2 = 0 UNION ALL SELECT query_id, 1, rank, doc_id + 1, 'second' FROM l) SELECT query_id, doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list, rank) AS n FROM u) WHERE n = 1")
def first_seen_titles(t):
    l = V.bm25(asked(t), t.index).select("query_id", F.lit(0).alias("list"), "rank", "doc_id", F.lit("first").alias("title"))
    more = l.where("doc_id % 2 = 0").select("query_id", F.lit(1).alias("list"), (11 - F.col("rank")).alias("rank"), "doc_id", F.lit("second").alias("title"))
    third = l.select("query_id", F.lit(1).alias("list"), "rank", (F.col("doc_id") + 1).alias("doc_id"), F.lit("second").alias("title"))
    return W.first_titles(l.union(more).union(third))


@query(f"WITH {DOCS}, n AS (SELECT source AS host, title, min(doc_id) AS doc_id FROM docs WHERE title <> '' GROUP BY 1, 2) SELECT host, place::INT AS place, title FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY doc_id) AS place FROM n) WHERE place <= 10")
def site_titles(t):
    return W.site_titles(docs(t).withColumn("host", F.col("source")), 10)


@query("WITH r AS (SELECT event_type AS source, 'http://r/' || user_id % 40 AS url, value AS popularity FROM events), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY popularity DESC, source) AS n FROM r) SELECT source, url, popularity FROM u WHERE n = 1 ORDER BY popularity DESC, url LIMIT 24")
def found_resources(t):
    """What several catalogues found, as one list."""
    return W.found_resources(t.events.select(F.col("event_type").alias("source"), F.concat(F.lit("http://r/"), (F.col("user_id") % 40).cast("string")).alias("url"), F.col("value").alias("popularity")))


# --- reranking and judging: the stand-in scorer counts shared words


SPLIT = r"list_distinct([w FOR w IN regexp_split_to_array(lower({x}), '\s+') IF w <> ''])"
JUDGED = f"""hits AS ({top_sql('scored', 20)}), j AS (SELECT h.query_id, h.rank, h.doc_id, h.score, round(len([w FOR w IN {SPLIT.format(x='b.text')} IF list_contains({SPLIT.format(x='d.text')}, w)]) / greatest(1, len({SPLIT.format(x='b.text')}))::DOUBLE, 6) AS judged
    FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.doc_id)"""


def judged_hits(t: Tables) -> DataFrame:
    return W.with_scores(V.bm25(asked(t), t.index, 20), asked(t), docs(t), W.SharedWords())


@query(f"WITH {SCORED}, {JUDGED} SELECT query_id, rank::INT AS rank, doc_id, judged FROM (SELECT query_id, doc_id, judged, row_number() OVER (PARTITION BY query_id ORDER BY judged DESC, rank) AS rank FROM j) WHERE rank <= 5")
def reranked(t):
    return W.reranked(judged_hits(t), 5).select("query_id", "rank", "doc_id", "judged")


@query(f"WITH {SCORED}, {JUDGED} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, doc_id FROM j WHERE judged >= 0.3")
def judge_gate(t):
    return W.gated(judged_hits(t), 0.3).select("query_id", "rank", "doc_id")


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 5)}), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), p AS (SELECT r.*, n, CASE WHEN query_id % 3 = 0 THEN rank ELSE CASE rank WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 10 + rank END END AS o FROM r JOIN n USING (query_id)) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o))::INT AS rank, doc_id FROM p")
def listwise_order(t):
    """A model's order: the third, then the first; what it leaves out follows; a reply without an order changes nothing."""
    hits = V.bm25(asked(t), t.index, 5)
    replies = asked(t).select("query_id", F.when(F.col("query_id") % 3 == 0, "I cannot").otherwise("Best first: [2, 0, 99, 2]").alias("reply"))
    return W.reordered(hits, replies, 5).select("query_id", "rank", "doc_id")


@query(f"""WITH {SCORED}, {JUDGED}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY judged DESC, rank) AS place FROM j WHERE judged >= 0.1)
    SELECT query_id, n::INT AS source, doc_id, substring(text, 1, 300) AS excerpt FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM a) JOIN documents USING (doc_id) WHERE n <= 4""")
def answer_sources(t):
    """Retrieve, rerank, judge, cut: what an answer may cite."""
    return W.answer_sources(asked(t), W.Words(t.index), docs(t), k=4, pool=20, scorer=W.SharedWords(), least=0.1)


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 3)}) SELECT query_id, rank AS source, doc_id FROM r WHERE rank IN (1, 3)")
def cited_sources(t):
    """Sources that a written answer names."""
    s = V.bm25(asked(t), t.index, 3).select("query_id", F.col("rank").alias("source"), "doc_id")

    class Stub:
        def reply(self, prompt: str) -> str:
            return "<think>[2]</think>So it is [1], or [3, 9]."

    answers = W.replied(W.prompts(asked(t), s, docs(t)), Stub())
    return W.cited(answers, s)


# --- research


PLAN = "plan AS (SELECT item_id AS question_id, 0 AS place, array_to_string(string_split(text, ' ')[1:6], ' ') AS q FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(string_split(text, ' ')[5:12], ' ') FROM benchmark)"
SUBS = f"""{PLAN}, qt AS (SELECT question_id, place, unnest(list_distinct({tok('q')})) AS term FROM plan),
    s AS (SELECT question_id, place, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2, 3)"""


def sub_top(k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, place ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"


def plan(t: Tables) -> DataFrame:
    w = F.split("text", " ")
    parts = F.array(F.array_join(F.slice(w, 1, 6), " "), F.array_join(F.slice(w, 5, 8), " "))
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.posexplode(parts).alias("place", "query"))


@query(f"WITH {POST}, {SUBS}, b AS (SELECT question_id, doc_id, max(score) AS score FROM ({sub_top(20)}) GROUP BY 1, 2) SELECT question_id, source::INT AS source, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS source FROM b) WHERE source <= 8")
def research(t):
    """Sub-queries of a question, merged by the best score, numbered as sources."""
    return W.research(plan(t), W.Words(t.index), 8)


@query(f"""WITH {POST}, {SUBS}, b AS (SELECT question_id, doc_id, max(score) AS score FROM ({sub_top(20)}) GROUP BY 1, 2), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS n FROM b) WHERE n <= 5),
    c AS (SELECT question_id, doc_id, max(score) AS score FROM ({sub_top(20)}) WHERE place = 1 GROUP BY 1, 2), two AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS n FROM c WHERE (question_id, doc_id) NOT IN (SELECT (question_id, doc_id) FROM one)),
    last AS (SELECT question_id, max(n) AS last FROM one GROUP BY 1)
    SELECT question_id, n::INT AS source, doc_id, 1 AS pass FROM one UNION ALL SELECT question_id, (coalesce(last, 0) + n)::INT, doc_id, 2 FROM two LEFT JOIN last USING (question_id) WHERE n <= 5""")
def research_passes(t):
    """Two passes; the second asks the later half of each plan again and finds what the first did not use."""
    first = plan(t)
    return W.research_passes(first, W.Words(t.index), lambda n, _: first.where("place = 1") if n == 1 else None, 5).select("question_id", "source", "doc_id", "pass")


@query(f"""WITH {SCORED}, one AS ({top_sql('scored', 4, 'query_id AS question_id, rank AS source, doc_id')}), more AS (SELECT query_id AS question_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE doc_id % 2 = 0),
    kept AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n FROM more WHERE rank <= 6 AND (question_id, doc_id) NOT IN (SELECT (question_id, doc_id) FROM one)), last AS (SELECT question_id, max(source) AS last FROM one GROUP BY 1)
    SELECT * FROM one UNION ALL SELECT question_id, (coalesce(last, 0) + n)::INT AS source, doc_id FROM kept LEFT JOIN last USING (question_id) WHERE coalesce(last, 0) + n <= 7""")
def research_appended(t):
    """New hits go behind the sources that a question has, up to a limit."""
    rename = lambda h, c: h.select(F.col("query_id").alias("question_id"), F.col("rank").alias(c), "doc_id")
    first = rename(V.bm25(asked(t), t.index, 4), "source")
    more = rename(V.bm25(asked(t), t.index, 6, where=F.col("doc_id") % 2 == 0), "rank")
    return W.appended(first, more, 7)


@query(f"""WITH {POST}, {SUBS}, b AS (SELECT question_id AS query_id, doc_id, round(max(1.0 / (60 + rank - 1)) * CASE WHEN any_value(source) = 'src0' THEN 2 ELSE 1 END, 9) AS score FROM ({sub_top(30)}) JOIN documents USING (doc_id) GROUP BY 1, 2) {top_sql('b', 10)}""")
def planned_search(t):
    """A planner's replies read, its queries searched, documents by their best place and their host's boost."""
    words = F.split("text", " ")
    one = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("find").alias("intent"), F.array(one(1, 6), one(5, 8)).alias("queries"))), F.lit("\n```"))
    p = W.planned(t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), reply.alias("reply")))
    boosts = t.documents.where("source = 'src0'").select("doc_id", F.lit(2.0).alias("boost"))
    return W.planned_search(p, W.Words(t.index), 10, boosts)


# --- shards


def shard_sql(n: int) -> str:
    """A ranked list of one of two shards, under statistics of its own."""
    return f"""tk{n} AS (SELECT * FROM tk WHERE doc_id % 2 = {n}), p{n} AS (SELECT * FROM post WHERE doc_id % 2 = {n}), df{n} AS (SELECT term, count(*) AS df FROM p{n} GROUP BY 1), st{n} AS (SELECT count(*) AS n_docs, avg(len(t) + len(b)) AS mean_len FROM tk{n} WHERE len(t) + len(b) > 0),
    s{n} AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df{n} USING (term) CROSS JOIN st{n} JOIN p{n} USING (term) GROUP BY 1, 2), l{n} AS ({top_sql(f's{n}', 20)})"""


def shards(t: Tables) -> list[W.Words]:
    return [W.Words(Index.over(written(t.index.rows.where(F.col("doc_id") % 2 == n), "shard"))) for n in (0, 1)]


@query(f"WITH {POST}, {QT}, {shard_sql(0)}, {shard_sql(1)}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) GROUP BY 1, 2) {top_sql('f', 10)}")
def scattered_search(t):
    """Two shards with statistics of their own, twice as many hits of each, fused by place."""
    return W.scattered(asked(t), shards(t), 10)


@query(f"WITH {DENSE}, l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, doc_id % 2 ORDER BY score DESC, doc_id) AS rank FROM dense), f AS (SELECT query_id, doc_id, round(1.0 / (60 + rank), 9) AS score FROM l WHERE rank <= 20) {top_sql('f', 10)}")
def scattered_similar(t):
    q = vectors_asked(t)
    parts = [W.Vectors(t.embeddings.where(F.col("vec_id") % 2 == n), q) for n in (0, 1)]
    return W.scattered(q.select("query_id"), parts, 10)


# --- evaluation


@query(f"""WITH {POST}, v AS (SELECT item_id AS query_id, 0 AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(string_split(text, ' ')[1:6], ' ') FROM benchmark), qt AS (SELECT query_id, variant, unnest(list_distinct({tok('text')})) AS term FROM v),
    s AS (SELECT query_id, variant, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2, 3), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2), r AS ({top_sql('f', 10)}), rel AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE doc_id % 40 = item_id % 40),
    n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), g AS (SELECT query_id, count(*) AS found, min(rank) AS first FROM r JOIN rel USING (query_id, doc_id) GROUP BY 1)
    SELECT query_id, round(coalesce(found / n, 0.0), 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS mrr FROM n LEFT JOIN g USING (query_id)""")
def eval_paraphrased(t):
    """An evaluation whose queries bring paraphrases: lists are fused before they are judged."""
    first = F.array(F.array_join(F.slice(F.split("text", " "), 1, 6), " "))
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), first.alias("paraphrases"))
    rel = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("_k")).join(t.documents.select("doc_id", (F.col("doc_id") % 40).alias("_k")), "_k").select("query_id", "doc_id")
    return E.metrics(H.with_paraphrases(q, t.index, 10), rel).select("query_id", "recall", "mrr")


@query(f"WITH {SCORED}, b AS ({top_sql('scored', 10)}), {ASKED_DENSE}, d AS ({top_sql('dense', 10)}), m AS (SELECT 1 AS place, 'bm25' AS mode, count(*) AS hits, count(DISTINCT query_id) AS n_queries FROM b UNION ALL SELECT 2, 'dense', count(*), count(DISTINCT query_id) FROM d) SELECT * FROM m")
def compared_modes(t):
    """Runs of several retrievers side by side, in a fixed order."""
    runs = [("bm25", V.bm25(asked(t), t.index)), ("dense", V.dense(asked_vectors(t), t.embeddings))]
    out = None
    for k, (name, hits) in enumerate(runs, 1):
        row = hits.agg(F.lit(k).alias("place"), F.lit(name).alias("mode"), F.count("*").alias("hits"), F.countDistinct("query_id").alias("n_queries"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 200 AS n, 200 AS n_ids, true AS same_again")
def distractors(t):
    """Made-up documents follow from their ids alone, so two runs make the same."""
    make = W.distractors(200, 1_000_000, ["river", "stone", "lamp", "cloud", "wheel"], 12)
    a, b = make(t.spark), make(t.spark).withColumnRenamed("text", "_again")
    got = a.join(b, "doc_id").agg(F.count("*").cast("int").alias("n"), F.countDistinct("doc_id").cast("int").alias("n_ids"), F.min(F.col("text") == F.col("_again")).alias("same_again"))
    return got


# --- approximate neighbours


@query("SELECT count(*) AS n_queries, true AS passes FROM embeddings WHERE vec_id % 50 = 0")
def graph_recall(t):
    """Proximity graphs against the exact way: a recall of 0.9 and more at 10."""
    q = vectors_asked(t)
    r = ann.recall(V.dense(q, t.embeddings), ann.graph_search(q, t.embeddings, 10))
    return r.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("passes"))


@query("SELECT count(*) AS n_queries, true AS passes FROM embeddings WHERE vec_id % 50 = 0")
def code_recall(t):
    """Quantised vectors, their best ranked again by the vectors themselves: a recall of 0.9 and more at 10."""
    q = vectors_asked(t)
    book = ann.train_codebook(t.embeddings)
    found = ann.code_search(q, written(ann.encoded(t.embeddings, book), "codes"), book, t.embeddings, 10)
    return ann.recall(V.dense(q, t.embeddings), found).agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("passes"))


@query("WITH r AS (SELECT vec_id % 50 AS v FROM embeddings), s AS (SELECT list_sort(list(v)) AS l, count(*) AS n, avg(v) AS m, stddev_pop(v) AS d FROM r) SELECT n, round(m, 6) AS mean, round(d, 6) AS deviation, l[least(floor(n * 0.5), n - 1)::INT + 1] AS p50, l[least(floor(n * 0.95), n - 1)::INT + 1] AS p95 FROM s")
def recall_summary(t):
    """Mean, deviation and places of a column of figures, as recall runs report them."""
    return ann.summary(t.embeddings.select((F.col("vec_id") % 50).alias("v")), "v")


@query(None)
def graph_topk(t):
    """The hits themselves; approximate, so no SQL gives them."""
    return ann.graph_search(vectors_asked(t), t.embeddings, 10)


@query(None)
def code_topk(t):
    book = ann.train_codebook(t.embeddings)
    return ann.code_search(vectors_asked(t), written(ann.encoded(t.embeddings, book), "codes"), book, None, 10)


@query(None)
def mmr_diversified(t):
    k = 10
    c = V.dense(vectors_asked(t), t.embeddings, R.pool_size(k), others_only=True).join(t.embeddings.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector")), F.col("doc_id") == F.col("_v"))
    return R.diversified(c.select("query_id", "doc_id", "score", "vector"), 0.7, k)


@query(f"WITH {DENSE}, o AS (SELECT * FROM dense WHERE doc_id <> query_id), t AS ({top_sql('o', 10, 'query_id, rank, doc_id')}) SELECT * FROM t")
def mmr_by_relevance(t):
    """A weight of one is relevance alone."""
    c = V.dense(vectors_asked(t), t.embeddings, R.pool_size(10), others_only=True).join(t.embeddings.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector")), F.col("doc_id") == F.col("_v"))
    return R.diversified(c.select("query_id", "doc_id", "score", "vector"), 1.0, 10)
