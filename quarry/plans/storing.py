"""Queries over the document store, the crawl queue and articles, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import articles as A
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import ops as O
from ..operators import queue as Q
from ..operators import retrieve as V
from ..operators import store as D
from ..sources.readers import Tables
from ..storage import written
from .catalog import BARE, DENSE, DOCS, EVAL, HOST, POST, docs, frontier, judged, listed_sql, query, top_sql, vectors_asked

# --- documents and passages

NOW = "TIMESTAMP '1998-08-02'"


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def now():
    return F.lit("1998-08-02").cast("timestamp")


@query("""WITH o AS (SELECT page_id, url, page_id AS first FROM pages WHERE page_id % 3 <> 0), n AS (SELECT page_id, url, page_id + 1000 AS first, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS r FROM pages WHERE page_id % 2 = 0)
    SELECT coalesce(n.url, o.url) AS url, coalesce(n.page_id, o.page_id) AS page_id, coalesce(o.first, n.first) AS first_seen FROM (SELECT url, max(page_id) AS page_id, min(first) AS first FROM o GROUP BY url) o FULL JOIN (SELECT * FROM n WHERE r = 1) n ON o.url = n.url""")
def upsert_pages(t):
    """By address; the time of first sight is kept, the rest is replaced. A batch that names an address twice counts once."""
    i = F.col("page_id")
    old = t.pages.where(i % 3 != 0).groupBy("url").agg(F.max("page_id").alias("page_id"), F.min("page_id").alias("first_seen"))
    new = D.newest(t.pages.where(i % 2 == 0), ["url"], [F.desc("page_id")]).select("url", "page_id", (i + 1000).alias("first_seen"))
    return C.upserted(old, new, "url", keep_first=["first_seen"])


PASSAGES = "passages AS (SELECT vec_id AS doc_id, vec_id % 4 AS byte_offset, 'm' || label % 3 AS model, 'old' AS state FROM embeddings)"


def passages(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 4).alias("byte_offset"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"), F.lit("old").alias("state"))


@query(f"WITH {PASSAGES} SELECT doc_id, byte_offset, model, CASE WHEN doc_id % 5 = 0 AND byte_offset < 2 THEN 'new' ELSE 'old' END AS state FROM passages UNION ALL SELECT doc_id, byte_offset + 100, model, 'new' FROM passages WHERE doc_id % 5 = 0 AND byte_offset >= 2")
def upsert_passages(t):
    p = passages(t)
    new = p.where("doc_id % 5 = 0").withColumns({"byte_offset": F.when(F.col("byte_offset") < 2, F.col("byte_offset")).otherwise(F.col("byte_offset") + 100), "state": F.lit("new")})
    return D.upserted_passages(p, new)


@query(f"WITH {PASSAGES} SELECT p.doc_id, p.byte_offset, d.lang FROM passages p JOIN documents d ON d.doc_id = p.doc_id WHERE model = 'm1'")
def passages_of_model(t):
    return D.other_models(passages(t), "m1", apply=True).join(t.documents, "doc_id").select("doc_id", "byte_offset", "lang")


@query(f"WITH {PASSAGES}, p AS (SELECT count(*) AS n_passages, count(DISTINCT model) AS n_models FROM passages) SELECT count(*) AS n_docs, count(CASE WHEN doc_id % 3 <> 0 THEN 1 END) AS n_dated, any_value(n_passages) AS n_passages, any_value(n_models) AS n_models FROM documents, p")
def coverage(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, now()).alias("published_at"))
    return D.coverage(d, passages(t))


@query(f"WITH {POST} SELECT 7 AS docs_drift, (n_tokens - 1000)::BIGINT AS words_drift FROM stats")
def counter_drift(t):
    kept = t.index.stats.select((F.col("n_docs") - 7).alias("indexed_docs"), F.lit(1000).alias("sum_doc_len"))
    return D.drift(kept, t.index.rows).select(F.col("docs_drift").cast("int").alias("docs_drift"), "words_drift")


@query("SELECT o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::INT AS change_count, o_orderkey % 3 = 0 AS changed FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 0, false FROM orders WHERE o_orderkey % 2 = 1")
def change_detection(t):
    k = F.col("o_orderkey")
    old = t.orders.where(k % 2 == 0).select(k.alias("url"), F.lit("a").alias("sha"), F.lit(1).alias("change_count"), now().alias("changed_at"))
    new = t.orders.select(k.alias("url"), F.when(k % 3 == 0, "b").otherwise("a").alias("sha"), now().alias("fetched_at"))
    return D.changed(old, new).select("url", "change_count", "changed")


@query(f"WITH {DOCS} SELECT doc_id, url, text FROM docs WHERE source = 'src1' AND doc_id % 4 <> 0 ORDER BY doc_id LIMIT 25")
def exported(t):
    """Date, then domain, then the limit, written as JSON lines and read back."""
    from ..sources.writers import export
    from ..storage import new_path

    d = docs(t).withColumn("published_at", F.when(F.col("doc_id") % 4 != 0, now()))
    rows = D.export_rows(d, include=["src1"], since=F.lit("1990-01-01").cast("timestamp"), limit=25)
    path = new_path(t.spark, "export")
    export(rows.select("doc_id", "url", "title", "text"), path, "jsonl")
    return t.spark.read.schema("doc_id long, url string, title string, text string").json(path).select("doc_id", "url", "text")


@query("SELECT count(*) AS total, coalesce(sum((event_id % 4 = 0)::INT), 0)::BIGINT AS useful FROM events")
def outcomes(t):
    return D.outcomes(t.events.select((F.col("event_id") % 4 == 0).alias("useful")))


@query("SELECT event_id, event_type, event_id % 4 = 0 AS useful FROM events")
def outcomes_export(t):
    """As CSV with a header, read back."""
    from ..sources.writers import export
    from ..storage import new_path

    path = new_path(t.spark, "outcomes")
    export(t.events.select("event_id", "event_type", (F.col("event_id") % 4 == 0).alias("useful")), path, "csv")
    return t.spark.read.schema("event_id long, event_type string, useful boolean").csv(path, header=True)


@query("SELECT event_type AS strategy, count(*) AS n, round(avg(event_id % 7), 6) AS mean_coverage, round(avg(user_id % 5), 6) AS mean_grounding, round(avg(event_id % 7) + avg(user_id % 5), 6) AS combined FROM events GROUP BY 1")
def answer_report(t):
    return D.answer_report(t.events.select(F.col("event_type").alias("strategy"), (F.col("event_id") % 7).alias("coverage"), (F.col("user_id") % 5).alias("grounding")))


@query("""WITH r AS (SELECT ['answered', 'no_info', 'empty', 'error'][event_id % 4 + 1] AS verdict, event_id % 500 AS ms FROM events)
    SELECT count(*) AS queries, count(*) FILTER (verdict = 'answered') AS answered, count(*) FILTER (verdict = 'no_info') AS no_info, count(*) FILTER (verdict = 'empty') AS empty, count(*) FILTER (verdict = 'error') AS errors,
    100 * count(*) FILTER (verdict = 'answered') // count(*) AS answer_rate_pct, (sum(ms) // count(*))::BIGINT AS avg_latency_ms FROM r""")
def verdict_report(t):
    k = F.col("event_id") % 4
    return D.verdict_report(t.events.select(F.when(k == 0, "answered").when(k == 1, "no_info").when(k == 2, "empty").otherwise("error").alias("verdict"), (F.col("event_id") % 500).alias("latency_ms")))


@query(f"""WITH d AS (SELECT count(*) AS n_docs, count(DISTINCT {HOST}) AS n_hosts, count(*) FILTER (page_id <= 300) AS fetched_300s, count(*) FILTER (page_id <= 900) AS fetched_900s, count(*) FILTER (page_id <= 1800) AS fetched_1800s FROM pages),
    f AS (SELECT count(*) FILTER (page_id % 4 IN (0, 2)) AS queued, count(*) FILTER (page_id % 4 = 1) AS in_flight, count(*) FILTER (page_id % 4 = 3) AS done, 0 AS error FROM pages)
    SELECT n_docs, n_hosts, fetched_300s, fetched_900s, fetched_1800s, (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) AS n_terms, queued, in_flight, done, error::BIGINT AS error FROM d, f""")
def crawl_status(t):
    d = t.pages.select("url", (now() - F.make_dt_interval(secs=F.col("page_id"))).alias("fetched_at"))
    return D.crawl_status(frontier(t), d, t.documents.select("lang").distinct(), now())


@query(f"WITH {EVAL}, r AS (SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m) SELECT round(0.0, 6)::DOUBLE AS d_recall, round(0.0, 6)::DOUBLE AS d_mrr, round(0.0, 6)::DOUBLE AS d_ndcg FROM r")
def eval_difference(t):
    """A saved summary, loaded again, against the same run."""
    m = judged(t)
    saved = written(m, "summary")
    return E.difference(saved, m)


@query("SELECT event_type, 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY 1")
def metric_lines(t):
    lines = D.prometheus(t.events.groupBy("event_type").agg(F.count("*").alias("value")), "requests_total", ["event_type"], "counter", "Requests by kind.")
    return lines.where("place = 1").select(F.regexp_extract("line", '"([^"]*)"', 1).alias("event_type"), "line")


# --- maintenance


@query("SELECT event_id FROM events WHERE epoch(ts) >= epoch((SELECT max(ts) FROM events)) - 7 * 86400")
def pruned_cache(t):
    last = t.events.agg(F.max("ts").alias("_now"))
    rows = t.events.select("event_id", F.col("ts").alias("created_at")).crossJoin(F.broadcast(last))
    return D.pruned(rows, F.col("_now"), 7.0).select("event_id")


@query("SELECT page_id FROM (SELECT page_id, page_id % 4 AS k FROM pages) WHERE NOT (k = 3 AND page_id % 6 >= 3) AND NOT (k = 1 AND page_id > 100)")
def collected_queue(t):
    k = F.col("page_id") % 4
    rows = t.pages.select("page_id", F.when(k == 3, "error").when(k == 1, "done").otherwise("queued").alias("status"), (F.col("page_id") % 6).alias("attempts"), (now() - F.make_dt_interval(secs=F.col("page_id"))).alias("enqueued_at"))
    return Q.collected(rows, 3, now(), 100).select("page_id")


@query(f"WITH f AS (SELECT page_id, {BARE} AS host, ['queued', 'in_flight', 'queued', 'done'][page_id % 4 + 1] AS status, (page_id // 4 % 4)::INT AS lane FROM pages), a AS (SELECT host, CASE WHEN count(*) % 3 = 0 THEN 'purge' WHEN count(*) % 3 = 1 THEN 'demote' ELSE 'keep' END AS action FROM f GROUP BY 1) SELECT page_id, status, (CASE WHEN status = 'queued' AND action = 'demote' THEN 3 ELSE lane END)::INT AS lane FROM f JOIN a USING (host) WHERE NOT (status = 'queued' AND action = 'purge')")
def swept_queue(t):
    f = t.pages.select("page_id", U.bare_host(F.col("url")).alias("host")).join(frontier(t).select(F.col("enqueued_at").alias("page_id"), "status", "lane"), "page_id")
    n = F.count("*") % 3
    actions = f.groupBy("host").agg(F.when(n == 0, "purge").when(n == 1, "demote").otherwise("keep").alias("action"))
    return Q.swept(f, actions).select("page_id", "status", "lane")


@query("SELECT url, 'e' || page_id AS last_error, (page_id % 5)::INT AS attempts FROM pages WHERE page_id % 4 = 3 ORDER BY page_id DESC LIMIT 10")
def queue_errors(t):
    i = F.col("page_id")
    rows = t.pages.select("url", F.when(i % 4 == 3, "error").otherwise("queued").alias("status"), F.concat(F.lit("e"), i.cast("string")).alias("last_error"), (i % 5).cast("int").alias("attempts"), i.alias("enqueued_at"))
    return Q.errors(rows, 10)


@query(f"SELECT {BARE} AS host, count(*) AS n FROM pages WHERE page_id % 4 IN (0, 2) GROUP BY 1 ORDER BY n DESC, host LIMIT 7")
def queue_depth(t):
    return Q.depth(frontier(t), n=7)


@query("SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'in_flight' WHEN 1 THEN 'done' WHEN 2 THEN 'error' ELSE 'queued' END AS status, (CASE page_id % 4 WHEN 3 THEN 2 ELSE 1 END)::INT AS attempts, CASE page_id % 4 WHEN 2 THEN 'why' END AS last_error FROM pages")
def queue_events(t):
    """Claims, results and recoveries applied to the queue, out of order as they come."""
    i = F.col("page_id")
    id_ = i.cast("string")
    q = t.pages.select(id_.alias("url"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    event = lambda seq, name, error=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("event"), F.lit(error).cast("string").alias("error"))
    k = i % 4
    none = event(0, "nothing")
    second = F.when(k == 0, none).when(k == 1, event(2, "complete")).when(k == 2, event(2, "fail", "why")).otherwise(event(2, "recover"))
    third = F.when(k == 3, event(3, "claim")).otherwise(event(3, "enqueue?"))
    fourth = F.when(k == 3, event(4, "recover")).otherwise(event(9, "recover?"))
    events = t.pages.select(id_.alias("url"), F.explode(F.array(fourth, third, second, event(1, "claim"))).alias("e")).select("url", "e.*")
    return Q.after_events(q, events).select(F.col("url").cast("long").alias("id"), "status", "attempts", "last_error")


@query("SELECT page_id, CASE WHEN page_id % 4 = 1 AND page_id <= 100 THEN 'in_flight' WHEN page_id % 4 = 3 THEN 'done' ELSE 'queued' END AS status FROM pages")
def stale_claims(t):
    i = F.col("page_id")
    f = frontier(t).select(F.col("enqueued_at").alias("page_id"), "status").withColumn("claimed_at", now() - F.make_dt_interval(secs=i))
    return Q.without_stale(f, now(), 100).select("page_id", "status")


@query(f"""WITH h AS (SELECT {BARE} AS host, min(page_id) + 1 AS rank FROM pages GROUP BY 1), s AS (SELECT host, rank, 'https://' || host || '/' AS url FROM h WHERE host <> '')
    SELECT url, round(1.0 / (1 + log10(rank)), 6)::DOUBLE AS priority FROM s WHERE url NOT IN (SELECT url FROM pages)""")
def seeded_queue(t):
    hosts = t.pages.groupBy(U.bare_host(F.col("url")).alias("host")).agg((F.min("page_id") + 1).alias("rank")).where("host <> ''")
    f = frontier(t).select("url", "status")
    return Q.seeded(f, hosts, now()).where("lane = 2").select("url", F.round("priority", 6).alias("priority"))


@query(f"SELECT url, {HOST} AS host FROM pages WHERE ({HOST} = 'example.net' OR {HOST} LIKE '%.example.net') AND page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) ORDER BY page_id LIMIT 10000")
def recrawled(t):
    i = F.col("page_id")
    busy = t.pages.where(i % 3 == 0).select("url", F.lit("queued").alias("status"))
    stored = t.pages.where(i % 3 != 0).select("url", i.alias("fetched_at"))
    return Q.recrawled(busy, stored, "example.net", now()).select("url", "host")


@query(f"WITH h AS (SELECT {BARE} AS host, count(*) AS n FROM pages GROUP BY 1) SELECT host, n FROM h WHERE host LIKE '%tion%' ORDER BY n DESC, host LIMIT 5")
def hosts_filtered(t):
    h = t.pages.groupBy(U.bare_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return h.where(F.col("host").contains("tion")).orderBy(F.desc("n"), "host").limit(5)


@query(f"WITH h AS (SELECT {BARE} AS host FROM pages WHERE {BARE} <> ''), g AS (SELECT host, count(*) AS n, avg(1.0) AS r FROM h GROUP BY 1 HAVING count(*) >= 3) SELECT page_id FROM pages WHERE {BARE} NOT IN (SELECT host FROM g)")
def unblocked_pages(t):
    """Pages whose host has not been blocked by a sweep."""
    p = t.pages.select("page_id", U.bare_host(F.col("url")).alias("host"))
    dead = O.host_health(p.select("host", F.lit(False).alias("ok")).where("host <> ''"), 3, 0.1, 0.3).where("action = 'purge'")
    return Q.blocked(p, dead).select("page_id")


# --- census


NON_ENGLISH = ["jp", "cn", "kr", "ru", "pl", "hu", "nl", "nu", "de", "fr", "es", "it", "br", "tw", "vn", "tr", "id", "th", "ua", "cz", "se", "no", "dk", "fi", "gr", "ro", "bg", "rs", "hr", "sk", "si", "ir", "sa", "ae", "eg", "il", "in", "pk", "bd", "ar", "mx", "cl", "co", "pe"]  # fixed values


@query(f"WITH p AS (SELECT coalesce(regexp_extract({BARE}, '\\.([^.]+)$', 1), '') AS tld, length(coalesce(html, '')) AS w FROM pages) SELECT tld, count(*) AS n_docs, sum(w)::BIGINT AS n_tokens, tld IN {listed_sql(NON_ENGLISH)} AS non_english, round(count(*) / (SELECT count(*) FROM p), 6)::DOUBLE AS share FROM p GROUP BY 1")
def census_footprint(t):
    """Pages and their length per top-level domain, with those that are mostly not English marked."""
    p = t.pages.select(U.tld(U.bare_host(F.col("url"))).alias("tld"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("_w"))
    c = C.census(p, F.col("tld"), "tld", "_w")
    total = p.agg(F.count("*").alias("_n"))
    return c.crossJoin(F.broadcast(total)).select("tld", "n_docs", "n_tokens", F.col("tld").isin(NON_ENGLISH).alias("non_english"), F.round(F.col("n_docs") / F.col("_n"), 6).alias("share"))


@query("SELECT count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang <> 'en') AS other, count(*) FILTER (coalesce(lang, '') = '') AS unknown, count(DISTINCT lang) AS n_languages FROM documents")
def census_languages(t):
    lang = F.coalesce(T.language(F.col("lang")), F.lit(""))
    d = t.documents.select(lang.alias("l"))
    n = lambda c: F.sum(c.cast("long"))
    return d.agg(n(F.col("l") == "en").alias("english"), n((F.col("l") != "en") & (F.col("l") != "")).alias("other"), n(F.col("l") == "").alias("unknown"), F.countDistinct(F.when(F.col("l") != "", F.col("l"))).alias("n_languages"))


@query("WITH g AS (SELECT sha256(text) AS k, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1), t AS (SELECT * FROM g ORDER BY first LIMIT 20), m AS (SELECT first, n, doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS place FROM t JOIN documents ON sha256(text) = k) SELECT first, n, doc_id, place::INT AS place FROM m WHERE place <= 3")
def duplicate_samples(t):
    """Three members each of the first twenty groups of copies."""
    d = t.documents.where("text IS NOT NULL").select("doc_id", T.digest(F.col("text")).alias("k"))
    g = d.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").orderBy("first").limit(20)
    w = V.Window.partitionBy("k").orderBy("doc_id")
    return d.join(F.broadcast(g), "k").withColumn("place", F.row_number().over(w)).where("place <= 3").select("first", "n", "doc_id", "place")


@query("""WITH h AS (SELECT event_type AS host, count(*) AS n FROM events GROUP BY 1), r AS (SELECT lower(host) AS host, 100 * row_number() OVER (ORDER BY host) AS rank FROM h)
    SELECT host, round(least(greatest(0.5 + CASE WHEN host = (SELECT min(host) FROM r) THEN 0.4 ELSE 0 END + CASE WHEN rank <= 100 THEN 0.30 WHEN rank <= 1000 THEN 0.22 ELSE 0.16 END + 0.15 * 50 / 100.0, 0), 1), 6)::DOUBLE AS score,
    round(1 + 2.0 * least(greatest(0.5 + CASE WHEN host = (SELECT min(host) FROM r) THEN 0.4 ELSE 0 END + CASE WHEN rank <= 100 THEN 0.30 WHEN rank <= 1000 THEN 0.22 ELSE 0.16 END + 0.15 * 50 / 100.0, 0), 1), 6)::DOUBLE AS multiplier FROM r""")
def host_authority(t):
    """Hosts with a rank, a trust flow and one that is trusted."""
    from ..functions import scoring as S

    hosts = t.events.select(F.lower("event_type").alias("host")).distinct()
    ranks = hosts.groupBy().agg(F.array_sort(F.collect_set("host")).alias("_a")).select(F.posexplode("_a").alias("_p", "host")).select("host", (100 * (F.col("_p") + 1)).alias("rank"))
    trusted = hosts.agg(F.min("host").alias("host"))
    flows = hosts.select("host", F.lit(50).alias("trust_flow"))
    a = C.with_authority(hosts, trusted=trusted, ranks=ranks, flows=flows)
    return a.select("host", "score", F.round(S.multiplier(F.col("score")), 6).alias("multiplier"))


# --- logs


@query("""WITH s AS (SELECT ts, event_type AS endpoint, event_id FROM events), n AS (SELECT max(ts) AS t FROM s)
    SELECT endpoint, count(*) FILTER (epoch(t) - epoch(ts) <= 300) AS m5, count(*) FILTER (epoch(t) - epoch(ts) <= 900) AS m15, count(*) FILTER (epoch(t) - epoch(ts) <= 1800) AS m30 FROM s, n GROUP BY 1""")
def rolling_counts(t):
    """Events of the last 5, 15 and 30 minutes before the last one."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts").alias("_t"))
    age = F.unix_micros("_t") - F.unix_micros("ts")
    n = lambda s: F.sum((age <= s * 1_000_000).cast("long"))
    return events.crossJoin(F.broadcast(last)).groupBy(F.col("event_type").alias("endpoint")).agg(n(300).alias("m5"), n(900).alias("m15"), n(1800).alias("m30"))


@query("SELECT lower(trim(event_type)) AS query, count(*) AS n, count(*) FILTER (event_id % 3 = 2) AS up, count(*) FILTER (event_id % 3 = 0) AS down, sum(event_id % 3 - 1)::BIGINT AS net FROM events GROUP BY 1 HAVING sum(event_id % 3 - 1) < 0")
def disliked_queries(t):
    ratings = t.events.select(F.col("event_id").alias("qid"), (F.col("event_id") % 3 - 1).alias("rating"))
    return O.disliked(O.feedback_by_query(ratings, t.events.select(F.col("event_id").alias("qid"), F.col("event_type").alias("query"))))


@query("WITH d AS (SELECT event_type AS article, ts::DATE AS day, count(DISTINCT user_id) AS readers FROM events GROUP BY 1, 2), l AS (SELECT max(day) AS last FROM d) SELECT article, strftime(day, '%Y-%m-%d') AS day, readers FROM d, l WHERE day > last - 14 AND day <= last")
def readers_held(t):
    """Daily readers of the last fourteen days."""
    from .catalog import views

    d = O.readers(views(t))
    last = d.agg(F.max("day").alias("_last"))
    return O.recent_days(d.crossJoin(F.broadcast(last)), F.col("_last")).select("article", F.date_format("day", "yyyy-MM-dd").alias("day"), "readers")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_tail(t):
    """The last events of a log of JSON lines."""
    from ..storage import new_path

    path = new_path(t.spark, "log")
    t.events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type").write.option("timestampNTZFormat", MICROS).json(path)
    return t.spark.read.schema("event_id long, ts timestamp_ntz, event_type string").json(path).orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


# --- articles: parts stand in for them

ARTICLES = """articles AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '-')) || '-' || p_partkey AS slug, ['published', 'pending', 'held', 'rejected', 'tombstoned'][p_partkey % 5 + 1] AS status, p_partkey % 7 = 0 AS residue, p_partkey % 11 = 0 AS prelive,
    p_brand AS vertical, ['thin', 'ok', 'strong'][p_partkey % 3 + 1] AS quality_tier, p_size AS updated_at, p_partkey % 13 AS readers_7d FROM part)"""


def articles(t: Tables) -> DataFrame:
    i = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (i % n + 1).cast("int"))
    return t.part.select(
        i.alias("id"), F.concat(F.lower(F.regexp_replace("p_name", " ", "-")), F.lit("-"), i.cast("string")).alias("slug"), pick(["published", "pending", "held", "rejected", "tombstoned"], 5).alias("status"), (i % 7 == 0).alias("residue"),
        (i % 11 == 0).alias("prelive"), F.col("p_brand").alias("vertical"), pick(["thin", "ok", "strong"], 3).alias("quality_tier"), F.col("p_size").alias("updated_at"), (i % 13).alias("readers_7d"), F.array(F.col("p_size") % 10, 10 + i % 4).alias("topics"),
    )


PROMOTED = "(status = 'published' AND NOT residue AND quality_tier IN ('ok', 'strong'))"


@query(f"WITH {ARTICLES} SELECT id, slug FROM articles WHERE status IN ('published', 'held') AND {PROMOTED} AND updated_at >= 20")
def article_list(t):
    return A.listed(articles(t), ["published", "held"], True, updated_since=F.lit(20)).select("id", "slug")


@query(f"WITH {ARTICLES} SELECT id, slug, readers_7d FROM articles WHERE readers_7d < 9 OR (readers_7d = 9 AND slug > 'm') ORDER BY readers_7d DESC, slug LIMIT 15")
def article_page(t):
    return A.page(articles(t), "readers_7d", 15, {"readers_7d": 9, "slug": "m"}).select("id", "slug", "readers_7d")


@query(f"WITH {ARTICLES} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in A.STATUSES) + ", count(*) FILTER (residue AND status = 'tombstoned') AS residues_tombstoned, count(*) FILTER (residue AND status <> 'tombstoned') AS residues_rejected, count(*) FILTER (prelive) AS prelive FROM articles")
def article_figures(t):
    return A.figures(articles(t))


@query("WITH o AS (SELECT topic, min(id) AS id FROM (SELECT p_partkey AS id, unnest([p_size % 10, 10 + p_partkey % 4]) AS topic FROM part) GROUP BY 1) SELECT topic, id FROM o")
def topic_owners(t):
    return A.owners(articles(t))


@query("WITH o AS (SELECT topic, min(id) AS owner FROM (SELECT p_partkey AS id, unnest([p_size % 10, 10 + p_partkey % 4]) AS topic FROM part) GROUP BY 1), a AS (SELECT p_partkey AS id, unnest([3, 11]) AS topic, unnest([1, 2]) AS place FROM part WHERE p_partkey % 50 = 1), j AS (SELECT id, topic, owner, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM a JOIN o USING (topic) WHERE id <> owner) SELECT id, topic, owner FROM j WHERE n = 1")
def topic_conflicts(t):
    asked = t.part.where("p_partkey % 50 = 1").select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(x).alias("topic"), F.lit(k).alias("place")) for k, x in enumerate((3, 11), 1)])).alias("_x")).select("id", "_x.*")
    return A.conflicts(articles(t), asked)


@query("SELECT o_orderkey, '1,2,' || o_orderkey % 5 || ',' || CASE WHEN o_orderkey % 7 NOT IN (1, 2, o_orderkey % 5) THEN o_orderkey % 7 ELSE o_orderkey % 3 + 20 END AS merged FROM orders WHERE o_orderkey % 10 = 3")
def merged_topics(t):
    """Stored entries and the first new one, for which there is just room."""
    i = F.col("o_orderkey")
    stored, asked = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), i % 5), F.array(i % 7, F.lit(2).cast("long"), i % 3 + 20)
    return t.orders.where("o_orderkey % 10 = 3").select("o_orderkey", F.array_join(A.merged_lists(stored, asked, 4).cast("array<string>"), ",").alias("merged"))


@query(f"""WITH {DENSE}, best AS (SELECT query_id, doc_key::BIGINT AS article, max(score) AS s FROM dense WHERE doc_id % 50 <> 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, article) AS n FROM best)
    SELECT query_id, CASE WHEN s >= 0.78 THEN 'covered' WHEN s >= 0.3 THEN 'related' ELSE 'none' END AS verdict, CASE WHEN s >= 0.3 THEN 'embedding' END AS match, CASE WHEN s >= 0.3 THEN article END AS article, round(s, 4) AS score FROM r WHERE n = 1""")
def article_verdicts(t):
    """What covers a query, with a lower bound for related ones, as the tables' vectors are far apart; nobody claims a topic."""
    q = vectors_asked(t).withColumn("topic", F.lit(None).cast("long"))
    v = t.embeddings.where("vec_id % 50 <> 0").select("vec_id", "embedding", F.col("label").cast("long").alias("article"))
    none = t.spark.createDataFrame([], "id long, topics array<bigint>")
    return A.verdicts(q, v, none, related=0.3)


@query(f"WITH {DENSE}, t AS ({top_sql('dense', 1)}) SELECT query_id, doc_id AS article, score FROM t WHERE score >= 0.74")
def title_blockers(t):
    return A.title_blockers(t.embeddings.select("vec_id", "embedding"), vectors_asked(t))
