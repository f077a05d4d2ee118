"""Registered queries over the driver tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import hybrid as H
from ..operators import index as I
from ..operators import ops as O
from ..operators import rank as R
from ..operators import retrieve as V
from ..sources.readers import Tables
from ..sources.writers import sitemap_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the driver tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tok(x: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
    return f"[t FOR t IN regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+') IF length(t) >= 2 AND NOT list_contains({stop}, t)]"


TITLE = r"substring(trim(regexp_extract(coalesce(text, ''), '(?:^|\n)[ \t\r]*([^\s][^\n]*)', 1)), 1, 200)"
DOCS = f"docs AS (SELECT *, {TITLE} AS title, 'doc://' || source || '/' || doc_id AS url FROM documents)"
POST = f"""{DOCS}, tk AS (SELECT doc_id, lang, {tok('title')} AS t, {tok('text')} AS b FROM docs),
    wide AS (SELECT doc_id, lang, len(t) + len(b) AS doc_len, unnest(t || t || t || b) AS term FROM tk),
    post AS (SELECT term, doc_id, lang, doc_len, count(*) AS tf FROM wide GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    stats AS (SELECT count(*) AS n_docs, avg(len(t) + len(b)) AS mean_len, coalesce(sum(len(t) + len(b)), 0)::BIGINT AS n_tokens FROM tk WHERE len(t) + len(b) > 0)"""
QT = f"qt AS (SELECT item_id AS query_id, unnest(list_distinct({tok('text')})) AS term FROM benchmark)"
IDF = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
BM = f"{IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))"
SCORED = f"{POST}, {QT}, scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


def top_sql(source: str, k: int, cols: str = "query_id, rank, doc_id, score") -> str:
    return f"SELECT {cols} FROM (SELECT *, {RANK}::INT AS rank FROM {source}) WHERE rank <= {k}"


def docs(t: Tables) -> DataFrame:
    return I.adapted(t.documents)


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- scans, projections, lookups


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id")
def scan_documents(t):
    return C.listed(t.documents.select("doc_id", "lang", "source", "n_chars"))


@query("SELECT d.doc_id, substring(d.text, 1, 500) AS head FROM documents d JOIN labels USING (doc_id)")
def doc_metas(t):
    return t.documents.join(t.labels.select("doc_id"), "doc_id").select("doc_id", F.substring("text", 1, 500).alias("head"))


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://%'")
def url_prefix_scan(t):
    return t.pages.where(F.col("url").startswith("https://")).select("page_id", "url")


@query(f"WITH {DOCS} SELECT doc_id, url, title FROM docs")
def doc_meta_iterator(t):
    return docs(t).select("doc_id", "url", "title")


@query("SELECT label, v.vec_id, d.doc_id, d.lang FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id")
def passages_with_documents(t):
    return t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("label", "vec_id", "doc_id", "lang")


def wanted_ids(t: Tables) -> DataFrame:
    """A request: a list of ids in its own order, as one row that is taken apart with positions."""
    ids = t.benchmark.agg(F.sort_array(F.collect_list(F.col("item_id") * 3), asc=False).alias("_ids"))
    return ids.select(F.posexplode("_ids").alias("_p", "doc_id")).select((F.col("_p") + 1).alias("position"), "doc_id")


@query("SELECT row_number() OVER (ORDER BY b.item_id DESC)::INT AS position, b.item_id * 3 AS doc_id, d.doc_id IS NOT NULL AS found, substring(d.text, 1, 100) AS text FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3")
def contents_lookup(t):
    return C.fetched(wanted_ids(t), t.documents, 100)


@query("SELECT row_number() OVER (ORDER BY b.item_id DESC)::INT AS position, b.item_id * 3 AS doc_id, d.doc_id IS NOT NULL AS found, d.text AS text FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3")
def contents_whole(t):
    return C.fetched(wanted_ids(t), t.documents)


# --- index


@query(f"SELECT doc_id, unnest({tok('text')}) AS term FROM documents")
def tokenize_terms(t):
    return t.documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))


@query(f"WITH {POST} SELECT term, doc_id, doc_len, tf FROM post")
def postings(t):
    return t.index.postings.select("term", "doc_id", "doc_len", "tf")


@query(f"WITH {POST} SELECT term, doc_id, doc_len, tf FROM post WHERE term IN ('on', 'tion', 'ing', 'ciónar', 'es')")
def posting_scan(t):
    """Postings of some terms, from the directories that their hashes name."""
    return t.index.scan(["on", "tion", "ing", "ciónar", "es"]).select("term", "doc_id", "doc_len", "tf")


@query(f"WITH {POST} SELECT term, doc_id, tf FROM post JOIN documents USING (doc_id) WHERE term IN ('on', 'tion', 'ing', 'es') AND source = 'src1'")
def host_posting_scan(t):
    return t.index.scan(["on", "tion", "ing", "es"], "src1").select("term", "doc_id", "tf")


@query(f"""WITH {POST}, n AS (SELECT term, count(*) AS df FROM post WHERE doc_id % 10 <> 1 GROUP BY term), x AS (SELECT doc_id + 5000000 AS doc_id, unnest(list_distinct({tok('lang')})) AS term FROM documents WHERE doc_id % 10 = 0),
    kept AS (SELECT term, doc_id FROM post WHERE doc_id % 10 <> 1 UNION ALL SELECT term, doc_id FROM x) SELECT term, count(*) AS df FROM kept GROUP BY 1""")
def reindexed(t):
    """Term frequencies after some documents were removed and others added."""
    new = t.documents.where("doc_id % 10 = 0").select((F.col("doc_id") + 5000000).alias("doc_id"), F.lit("").alias("title"), F.col("lang").alias("text"))
    return t.index.reindexed(new, t.documents.where("doc_id % 10 = 1").select("doc_id")).terms


@query(f"WITH {POST} SELECT term, df FROM df")
def term_doc_freq(t):
    return t.index.terms


@query(f"WITH {POST} SELECT n_docs, round(mean_len, 6) AS mean_len, n_tokens FROM stats")
def corpus_stats(t):
    return t.index.stats.withColumn("mean_len", F.round("mean_len", 6))


@query(r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> ''] AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 320) / 256.0), 0)::INT + 1)) AS n FROM w WHERE len(w) > 0)
    SELECT doc_id, n::INT AS chunk_no, array_to_string(w[n * 256 + 1 : n * 256 + 320], ' ') AS text, (n * 256)::INT AS first_word FROM c""")
def chunk_words(t):
    return I.chunks(t.documents)


# --- retrieval


@query(f"WITH {SCORED} {top_sql('scored', 10)}")
def bm25_batch(t):
    return V.bm25(asked(t), t.index)


@query(f"WITH {POST}, {QT}, scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) WHERE lang = 'en' GROUP BY 1, 2) {top_sql('scored', 10)}")
def bm25_in_lang(t):
    return V.bm25(asked(t), t.index, where=F.col("lang") == "en")


@query(f"""WITH {POST}, {QT}, scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term)
    JOIN documents d USING (doc_id) WHERE d.source = 'src1' GROUP BY 1, 2) {top_sql('scored', 10)}""")
def bm25_in_host(t):
    """One host's documents under the statistics of all."""
    return V.bm25(asked(t), t.index, where=F.col("host") == "src1")


@query(f"""WITH {POST}, {QT}, i AS (SELECT query_id, term, {IDF} AS i, max({IDF}) OVER (PARTITION BY query_id) AS m FROM qt JOIN df USING (term) CROSS JOIN stats),
    kept AS (SELECT query_id, term FROM i WHERE i >= 2.5 OR (m < 2.5 AND i = m)),
    scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM kept JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2) {top_sql('scored', 10)}""")
def bm25_idf_floor(t):
    return V.bm25(asked(t), t.index, idf_floor=2.5)


@query(f"WITH {SCORED}, boosted AS (SELECT query_id, doc_id, round(score * CASE WHEN source = 'src0' THEN 50 ELSE 1 END, 6) AS score FROM scored JOIN documents USING (doc_id)) {top_sql('boosted', 10)}")
def bm25_boosted(t):
    return V.bm25(asked(t), t.index, factor=F.when(F.col("host") == "src0", 50.0).otherwise(1.0))


@query(f"""WITH {SCORED}, site AS (SELECT doc_id FROM documents WHERE doc_id % 97 = 3), q AS (SELECT DISTINCT item_id AS query_id FROM benchmark),
    seeded AS (SELECT query_id, doc_id, round(coalesce(score, 0.001) * 50, 6) AS score FROM q CROSS JOIN site LEFT JOIN scored USING (query_id, doc_id) WHERE (SELECT count(*) FROM site) <= 256 OR score IS NOT NULL
        UNION ALL SELECT query_id, doc_id, score FROM scored WHERE doc_id NOT IN (SELECT doc_id FROM site)) {top_sql('seeded', 10)}""")
def bm25_seeded(t):
    """Boosted documents come up even where they share no word with the query, if there are few of them."""
    site = t.documents.where("doc_id % 97 = 3").select("doc_id", F.lit(50.0).alias("boost"))
    return V.boosted(asked(t), t.index, site, 10)


@query(f"""WITH {POST}, {QT}, b AS (SELECT query_id, term, {IDF} * 2.2 AS b FROM qt JOIN df USING (term) CROSS JOIN stats)
    SELECT query_id, term, round(b, 6) AS bound, round(sum(b) OVER (PARTITION BY query_id ORDER BY b DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS rest FROM b""")
def score_bounds(t):
    return V.bounds(asked(t), t.index)


@query(f"WITH {SCORED} {top_sql('scored', 10)}")
def bm25_pruned(t):
    return V.pruned(asked(t), t.index)


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 10)}) SELECT query_id, score AS kth FROM r WHERE rank = 10")
def kth_score(t):
    return V.kth(V.bm25_hits(asked(t), t.index, 10), 10)


@query(f"""WITH {SCORED}, p AS (SELECT item_id AS query_id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS phrase FROM benchmark),
    f AS (SELECT query_id, doc_id, score FROM scored JOIN p USING (query_id) JOIN docs USING (doc_id) WHERE contains(lower(text), phrase) OR contains(lower(title), phrase)) {top_sql('f', 10)}""")
def bm25_phrase(t):
    q = asked(t).withColumn("quoted", F.concat(F.lit('"'), F.array_join(F.slice(F.split("query", " "), 1, 2), " "), F.lit('"')))
    wanted = q.select("query_id", T.phrases(F.col("quoted")).alias("wanted"))
    s = V.scored(asked(t), t.index).join(wanted, "query_id").join(docs(t).select("doc_id", "title", "text"), "doc_id")
    return V.top(s.where(T.has_phrases(F.col("text"), F.col("title"), F.col("wanted"))), 10).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {SCORED}, r AS ({top_sql('scored', 10)}) SELECT query_id, rank, doc_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN round(score / max(score) OVER (PARTITION BY query_id), 6) ELSE score END AS score FROM r")
def score_calibrated(t):
    return R.calibrated(V.bm25(asked(t), t.index))


DOT = "list_sum([p[1]::DOUBLE * p[2]::DOUBLE FOR p IN list_zip({a}, {b})])"
DENSE = f"""dense AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, p.label AS doc_key,
    round({DOT.format(a='q.embedding', b='p.embedding')} / (sqrt({DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({DOT.format(a='p.embedding', b='p.embedding')})), 6) AS score
    FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0)"""


def vectors_asked(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {DENSE} {top_sql('dense', 10)}")
def dense_topk(t):
    return V.dense(vectors_asked(t), t.embeddings)


@query(f"WITH {DENSE}, m AS (SELECT query_id, doc_key::BIGINT AS doc_id, max(score) AS score FROM dense GROUP BY 1, 2) {top_sql('m', 5)}")
def dense_max_passage(t):
    return V.dense(vectors_asked(t), t.embeddings, 5, key=F.col("label"))


@query(f"""WITH {DENSE}, m AS (SELECT query_id, doc_key::BIGINT AS doc_id, max(score) AS score FROM dense GROUP BY 1, 2), r AS ({top_sql('m', 5)}),
    b AS (SELECT query_id, doc_key::BIGINT AS doc_id, doc_id AS vec_id, row_number() OVER (PARTITION BY query_id, doc_key ORDER BY score DESC, doc_id) AS n FROM dense)
    SELECT query_id, rank, doc_id, score, vec_id * 100 AS byte_offset, 100 + vec_id % 7 AS byte_length FROM r JOIN b USING (query_id, doc_id) WHERE n = 1""")
def dense_best_spans(t):
    """A document's best passage with its span."""
    passages = t.embeddings.select("vec_id", "embedding", "label", (F.col("vec_id") * 100).alias("byte_offset"), (100 + F.col("vec_id") % 7).alias("byte_length"))
    return V.best_spans(vectors_asked(t), passages, F.col("label"), 5)


@query(f"WITH {DENSE}, o AS (SELECT * FROM dense WHERE doc_id <> query_id) {top_sql('o', 10)}")
def dense_find_similar(t):
    return V.dense(vectors_asked(t), t.embeddings, others_only=True)


HALF = f"""qa AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) % 2 AS half FROM qt),
    half AS (SELECT query_id, half, doc_id, round(sum({BM}), 6) AS score FROM qa JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2, 3),
    lists AS (SELECT * FROM (SELECT query_id, half, doc_id, row_number() OVER (PARTITION BY query_id, half ORDER BY score DESC, doc_id) AS rank FROM half) WHERE rank <= 20)"""


def halves(t: Tables) -> DataFrame:
    """Two ranked lists per query, from every other of its terms."""
    terms = V.query_terms(asked(t)).withColumn("half", F.row_number().over(Window.partitionBy("query_id").orderBy("term")) % 2)
    q = terms.groupBy("query_id", "half").agg(F.array_join(F.collect_list("term"), " ").alias("query"))
    ranked = [V.bm25(q.where(F.col("half") == h).select("query_id", "query"), t.index, k=20).withColumn("half", F.lit(h)) for h in (0, 1)]
    return ranked[0].unionByName(ranked[1])


@query(f"WITH {POST}, {QT}, {HALF}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2) {top_sql('f', 10)}")
def fused_halves(t):
    return V.fused(halves(t), 10)


#: Questions with a text and a vector: the benchmark items that have an embedding of their number.
ASKED_DENSE = f"""dense AS (SELECT b.item_id AS query_id, p.vec_id AS doc_id,
    round({DOT.format(a='q.embedding', b='p.embedding')} / (sqrt({DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({DOT.format(a='p.embedding', b='p.embedding')})), 6) AS score
    FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings p)"""


def asked_vectors(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("query_id"))
    return q.join(t.embeddings, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


@query(f"""WITH {SCORED}, {ASKED_DENSE}, lists AS ({top_sql('scored', 20)} UNION ALL {top_sql('dense', 20)}),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2), r AS ({top_sql('f', 10)}) SELECT query_id, rank, doc_id, round(1.0 / rank, 6) AS score FROM r""")
def hybrid_rrf(t):
    """Words and vectors: twice the hits of each list, fused, scored by place."""
    return H.hybrid(asked(t), t.index, asked_vectors(t), t.embeddings, 10)


@query(f"""WITH {SCORED}, {ASKED_DENSE}, lifted AS (SELECT query_id, doc_id, round(score * (1 + 2.0 * CASE WHEN source = 'src0' THEN 0.9 ELSE 0.5 END), 6) AS score FROM ({top_sql('dense', 26)}) JOIN documents USING (doc_id)),
    lists AS ({top_sql('scored', 10)} UNION ALL {top_sql('lifted', 26)}),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2) {top_sql('f', 26)}""")
def hybrid_authority(t):
    """The other fusion: vector hits, some more of them, are weighed by their host's authority before they are ranked."""
    lift = t.documents.select("doc_id", S.multiplier(F.when(F.col("source") == "src0", 0.9).otherwise(0.5)).alias("lift"))
    return H.hybrid_lifted(asked(t), t.index, asked_vectors(t), t.embeddings, lift, 10)


@query(f"""WITH {POST}, v AS (SELECT item_id AS query_id, 0 AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(string_split(text, ' ')[1:6], ' ') FROM benchmark UNION ALL SELECT item_id, 2, array_to_string(string_split(text, ' ')[4:12], ' ') FROM benchmark),
    qt AS (SELECT query_id, variant, unnest(list_distinct({tok('text')})) AS term FROM v),
    s AS (SELECT query_id, variant, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2, 3),
    lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2) {top_sql('f', 20)}""")
def paraphrase_rrf(t):
    """Each query and its paraphrases, given as data, are searched alike and fused."""
    words = F.split("text", " ")
    variants = t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.array(F.array_join(F.slice(words, 1, 6), " "), F.array_join(F.slice(words, 4, 9), " ")).alias("paraphrases"))
    return H.with_paraphrases(variants.select("query_id", F.col("text").alias("query"), "paraphrases"), t.index, 20)


@query(f"""WITH {POST}, q AS (SELECT item_id AS query_id, text || ' ' || coalesce((SELECT d.text FROM documents d WHERE d.doc_id = item_id), '') AS text FROM benchmark),
    qt AS (SELECT query_id, unnest(list_distinct({tok('text')})) AS term FROM q),
    scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2) {top_sql('scored', 10)}""")
def hyde_search(t):
    """A passage that might answer, given as data, is added to the query."""
    passages = t.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("passage"))
    return V.bm25(H.with_passage(asked(t), passages), t.index)


@query(rf"""WITH {POST}, q AS (SELECT item_id AS query_id, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS w FROM benchmark),
    e AS (SELECT query_id, 'who wrote the ' || w || '? ' || w || ' author writer ' || w || ' book novel publication' AS text FROM q WHERE w <> ''),
    qt AS (SELECT query_id, unnest(list_distinct({tok('text')})) AS term FROM e),
    scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM qt JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2) {top_sql('scored', 10)}""")
def entity_search(t):
    """Questions about an entity are searched with their rewrites added."""
    word = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    q = t.benchmark.where(word != "").select(F.col("item_id").alias("query_id"), F.concat(F.lit("who wrote the "), word, F.lit("?")).alias("query"))
    return V.bm25(H.with_rewrites(q), t.index)


@query(f"WITH {POST}, {QT}, {HALF}, f AS (SELECT query_id, doc_id, round(sum(CASE WHEN half = 0 THEN 2.0 ELSE 1.0 END / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2) {top_sql('f', 10)}")
def weighted_rrf(t):
    return V.fused(halves(t), 10, F.when(F.col("half") == 0, 2.0).otherwise(1.0))


@query(f"WITH {POST}, {QT}, {HALF}, f AS (SELECT query_id, doc_id, round(max(1.0 / (60 + rank - 1)), 9) AS score FROM lists GROUP BY 1, 2) {top_sql('f', 10)}")
def best_rank_merge(t):
    return V.best_ranked(halves(t), 10)


LIKE = f"""s AS (SELECT doc_id AS query_id, term AS doc_id, round(tf * (ln(n_docs) - ln(df)), 6) AS score FROM post JOIN df USING (term) CROSS JOIN stats WHERE doc_id % 50 = 0 AND ln(n_docs) - ln(df) > 0),
    lt AS ({top_sql('s', 10, 'query_id, rank, doc_id AS term, score')})"""


@query(f"WITH {POST}, {LIKE} SELECT * FROM lt")
def mlt_terms(t):
    return V.like_terms(t.index, t.documents.where("doc_id % 50 = 0"))


@query(f"WITH {POST}, {LIKE}, scored AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM (SELECT query_id, term FROM lt) JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) WHERE query_id <> doc_id GROUP BY 1, 2) {top_sql('scored', 10)}")
def more_like_this(t):
    terms = V.like_terms(t.index, t.documents.where("doc_id % 50 = 0"))
    q = terms.groupBy("query_id").agg(F.array_join(F.collect_list("term"), " ").alias("query"))
    return V.top(V.bm25_hits(q, t.index, 11).where("query_id <> doc_id"), 10).select("query_id", "rank", "doc_id", "score")


PRF = f"""every AS ({top_sql('scored', 10)}), hits AS (SELECT * FROM every WHERE query_id IN (SELECT query_id FROM every GROUP BY 1 HAVING count(*) >= 3)),
    ft AS (SELECT query_id, unnest(list_distinct({tok('substring(text, 1, 2000)')})) AS term FROM hits JOIN documents USING (doc_id)),
    fc AS (SELECT query_id, term AS doc_id, count(*) AS score FROM ft WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = ft.query_id AND qt.term = ft.term) GROUP BY 1, 2 HAVING count(*) >= 2),
    pt AS ({top_sql('fc', 5, 'query_id, rank, doc_id AS term, score AS n_docs')})"""


@query(f"WITH {SCORED}, {PRF} SELECT * FROM pt")
def prf_terms(t):
    return V.feedback_terms(V.bm25(asked(t), t.index), docs(t), asked(t))


@query(f"WITH {SCORED}, {PRF}, q2 AS (SELECT query_id, term FROM qt UNION SELECT query_id, term FROM pt), s2 AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM q2 JOIN df USING (term) CROSS JOIN stats JOIN post USING (term) GROUP BY 1, 2) {top_sql('s2', 10)}")
def prf_search(t):
    more = V.feedback_terms(V.bm25(asked(t), t.index), docs(t), asked(t)).groupBy("query_id").agg(F.array_join(F.collect_list("term"), " ").alias("more"))
    q = asked(t).join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "more").alias("query"))
    return V.bm25(q, t.index)


@query(r"""WITH q AS (SELECT conv_id, turn, 'who invented the ' || lower(regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1)) || '?' AS q FROM conversations),
    e AS (SELECT conv_id, turn, trim(regexp_extract(q, '^who (?:created|invented|founded|built|developed|designed|made|started) (?:the )?(.+?)\??$', 1)) AS e FROM q)
    SELECT conv_id, turn, unnest([e || ' creator inventor founder', e || ' history origin', e || ' developer designer']) AS rewrite FROM e WHERE e <> ''""")
def entity_rewrite(t):
    q = F.concat(F.lit("who invented the "), F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+)", 1)), F.lit("?"))
    return t.conversations.select("conv_id", "turn", F.explode(T.entity_rewrites(q)).alias("rewrite"))


#: What stands before and after the word asked about, at least once for each form.
ASKED = [
    ("Who built ", "?"), ("who wrote the ", "?"), ("who discovered ", ""), ("who is the ", "?"), ("when was the ", " invented?"), ("when did ", ""),
    ("where is ", "?"), ("how tall is the ", "?"), ("how deep is ", "?"), ("what is the capital of ", "?"), ("what is the longest ", "!"), ("what is the population of ", "?"), ("why is ", "?"),
]


@query(rf"""WITH asked(head, tail) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ASKED)}),
    q AS (SELECT conv_id, turn, lower(head || regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) || tail) AS q, row_number() OVER () AS r FROM conversations, asked),
    form(n, re, tails) AS (VALUES
        (1, '^who (?:created|invented|founded|built|developed|designed|made|started) (?:the )?(.+?)\??$', ['creator inventor founder', 'history origin', 'developer designer']),
        (2, '^who (?:wrote|authored|composed) (?:the )?(.+?)\??$', ['author writer', 'book novel publication']),
        (3, '^who (?:discovered) (.+?)\??$', ['discoverer', 'discovery history']),
        (4, '^who is (?:the )?(.+?)\??$', ['biography', 'about']),
        (5, '^when (?:was|did|were) (?:the )?(.+?)(?: (?:created|invented|founded|born|happen|happened|occur|land|landed))?\??$', ['date year', 'history origin']),
        (6, '^where is (?:the )?(.+?)\??$', ['location address country']),
        (7, '^how tall is (?:the )?(.+?)\??$', ['height meters feet', 'tall']),
        (8, '^how (?:big|large|long|wide|deep|high) is (?:the )?(.+?)\??$', ['size dimensions', 'length width']),
        (9, '^what is the capital of (.+?)\??$', ['capital city']),
        (10, '^what is the (?:largest|biggest|longest|tallest|shortest) (.+?)\??$', ['superlative record']),
        (11, '^what is the population of (.+?)\??$', ['population inhabitants census'])),
    e AS (SELECT conv_id, turn, r, n, tails, rtrim(trim(regexp_extract(trim(q), re, 1)), ' .!?') AS e FROM q, form),
    f AS (SELECT * FROM e WHERE e <> '' QUALIFY row_number() OVER (PARTITION BY r ORDER BY n) = 1)
    SELECT conv_id, turn, e || ' ' || unnest(tails) AS rewrite FROM f""")
def entity_rewrite_forms(t):
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+)", 1)
    q = F.explode(F.array(*[F.concat(F.lit(a), word, F.lit(b)) for a, b in ASKED])).alias("q")
    return t.conversations.select("conv_id", "turn", q).select("conv_id", "turn", F.explode(T.entity_rewrites(F.col("q"))).alias("rewrite"))


# --- evaluation

RELEVANT = "rel AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 50 = 0 AND q.vec_id <> p.vec_id)"
EVAL = f"""{DENSE}, {RELEVANT}, o AS (SELECT * FROM dense WHERE doc_id <> query_id), ranked AS ({top_sql('o', 10)}),
    n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
    g AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM ranked JOIN rel USING (query_id, doc_id) GROUP BY 1),
    m AS (SELECT query_id, round(coalesce(found / n, 0.0), 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS mrr, round(coalesce(dcg / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(n, 10) + 1)]), 0.0), 6) AS ndcg FROM n LEFT JOIN g USING (query_id))"""


def judged(t: Tables) -> DataFrame:
    q, p = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label"), t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    return E.metrics_by_label(V.dense(vectors_asked(t), t.embeddings, others_only=True), q, p)


@query(f"WITH {EVAL} SELECT * FROM m")
def eval_recall_mrr_ndcg(t):
    return judged(t)


@query(f"WITH {EVAL} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m")
def eval_mean(t):
    return E.mean(judged(t))


# --- corpus jobs


@query(f"SELECT lang, count(*) AS n_docs, sum(len({tok('text')}))::BIGINT AS n_tokens FROM documents GROUP BY lang")
def census_lang(t):
    return C.census(t.index.rows, T.language(F.col("lang")), "lang")


HOST = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)"
BARE = rf"regexp_replace({HOST}, '^www\.', '')"
KEY = rf"""(CASE WHEN lower(url) LIKE 'http://%' THEN 'https' ELSE lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) END) || '://' || {BARE}
    || (CASE WHEN regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/:?#]+:(\d+)', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/:?#]+:(\d+)', 1) END)
    || (CASE WHEN regexp_replace(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END)
    || (CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END)"""
PARAMS = r"list_sort([p FOR p IN string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&') IF p <> '' AND split_part(p, '=', 1) NOT IN ('ref', 'ref_src', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', '_ga') AND NOT starts_with(p, 'utm_')])"
KEYED = f"keyed AS (SELECT page_id, {KEY} AS key, {BARE} AS host FROM (SELECT *, {PARAMS} AS params FROM pages))"


@query(f"SELECT regexp_extract({BARE}, '[^.]+$') AS tld, count(*) AS n_pages FROM pages GROUP BY 1")
def census_tld(t):
    return t.pages.groupBy(U.tld(U.bare_host(F.col("url"))).alias("tld")).agg(F.count("*").alias("n_pages"))


@query(f"WITH {KEYED} SELECT page_id, key, host FROM keyed")
def url_keys(t):
    return t.pages.select("page_id", U.dedup_key(F.col("url")).alias("key"), U.bare_host(F.col("url")).alias("host"))


@query(f"WITH {KEYED} SELECT key, count(*) AS n, min(page_id) AS first, count(*) - 1 AS removable FROM keyed GROUP BY key HAVING count(*) > 1")
def dup_url_groups(t):
    return C.duplicate_keys(t.pages.withColumn("key", U.dedup_key(F.col("url"))), "key", "page_id")


@query(f"WITH {KEYED} SELECT host, count(*) AS removable FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS n FROM keyed) WHERE n > 1 GROUP BY host")
def removable_by_host(t):
    return C.removable_by_host(t.pages)


@query("WITH g AS (SELECT sha256(text) AS sha, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first, n FROM documents JOIN g ON sha256(text) = sha")
def dup_content_groups(t):
    return C.copies(t.documents)


@query(f"SELECT {BARE} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def top_hosts(t):
    return t.pages.groupBy(U.bare_host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query(f"WITH h AS (SELECT {BARE} AS host, count(*) AS n FROM pages GROUP BY 1) SELECT host, n, (SELECT count(*) FROM h) AS total FROM h ORDER BY n DESC, host LIMIT 10 OFFSET 10")
def hosts_page(t):
    h = t.pages.groupBy(U.bare_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return R.page(h, [F.desc("n"), "host"], 10, 10)


def listed_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


DOMAIN = f"(CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {listed_sql(U.DEEP_SUFFIXES)} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END)"
LAST = "(CASE WHEN contains(host, '.') THEN regexp_extract(host, '[^.]+$') ELSE '' END)"
FARM = f"(CASE WHEN domain IN {listed_sql(S.PLATFORMS)} THEN 0.0 WHEN n_hosts >= 100000 THEN 0.4 WHEN n_hosts >= 10000 THEN 0.3 WHEN n_hosts >= 1000 THEN 0.1 ELSE 0.0 END)"
TLD_PART = f"(CASE WHEN {LAST} IN {listed_sql(S.INSTITUTIONAL)} THEN 0.2 WHEN {LAST} IN {listed_sql(S.SUSPECT)} THEN -0.3 ELSE 0.0 END)"
SECOND = "(CASE WHEN " + " OR ".join(f"ends_with(host, '{x}')" for x in S.SECOND_LEVEL) + " THEN 0.15 ELSE 0.0 END)"
AUDIT = rf"""h AS (SELECT {BARE} AS host, count(*) AS n_pages FROM pages GROUP BY 1), d AS (SELECT *, {DOMAIN} AS domain FROM h WHERE host <> ''),
    s AS (SELECT domain, count(*) AS n_hosts FROM d GROUP BY 1),
    a AS (SELECT host, domain, n_pages, n_hosts, round(greatest(least(0.5 + {TLD_PART} + {SECOND} - {FARM}, 1.0), 0.0), 6)::DOUBLE AS score FROM d JOIN s USING (domain))"""


@query(f"WITH {AUDIT} SELECT *, CASE WHEN score >= 0.75 THEN 'trusted' WHEN score >= 0.4 THEN 'keep' WHEN score >= 0.25 THEN 'down-weight' ELSE 'block' END AS class FROM a")
def domain_audit(t):
    return C.domain_audit(t.pages)


@query("SELECT doc_id, n_terms, n_terms >= 2 AS flagged FROM (SELECT doc_id, len([x FOR x IN ['loser', 'idiot', 'clown', 'moron', 'trash'] IF list_contains(regexp_split_to_array(lower(substring(text, 1, 200000)), '[^\\p{L}\\p{Nd}]+'), x)])::INT AS n_terms FROM documents)".replace("\\\\", "\\"))
def listed_flag(t):
    """The adult filter's mechanism, on the invented words of the driver's tables."""
    rows = t.documents.withColumn("url", F.lit(""))
    return C.flagged(rows, ["loser", "idiot", "clown", "moron", "trash"], [], []).select("doc_id", "n_terms", "flagged")


@query(f"SELECT {BARE} AS host FROM pages WHERE {BARE} = 'example.net' OR {BARE} LIKE '%.example.net' GROUP BY 1")
def purge_domain_hosts(t):
    hosts = t.pages.select(U.bare_host(F.col("url")).alias("host")).distinct()
    return C.under_suffixes(hosts, t.spark.createDataFrame([("example.net",)], "suffix string"))


@query(r"""WITH w AS (SELECT doc_id, length(trim(text)) < 2000 AS short, [x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> ''] AS w FROM documents),
    s AS (SELECT doc_id, len(w) - 7 AS n, unnest([array_to_string(w[i : i + 7], ' ') FOR i IN range(1, len(w) - 6)]) AS span FROM w WHERE len(w) >= 160),
    c AS (SELECT doc_id, any_value(n) AS n, span, greatest(count(*) - 3, 0) AS extra FROM s GROUP BY doc_id, span)
    SELECT doc_id FROM c GROUP BY doc_id HAVING sum(extra) * 100 >= any_value(n) * 80""")
def repetition_filter(t):
    return C.stuffed(t.documents)


@query(r"""SELECT page_id, CASE WHEN octet_length(encode(url)) > 2048 THEN 'too long' WHEN NOT regexp_matches(lower(trim(url)), '^https?://') THEN 'scheme' WHEN regexp_matches(trim(url), '^[a-zA-Z]+://[^/?#]*@') THEN 'credentials'
    WHEN regexp_extract(trim(url), '^[a-zA-Z]+://[^/:?#]+:(\d+)', 1) NOT IN ('', '80', '443') THEN 'port' WHEN NOT contains(h, '.') OR regexp_matches(h, '^\d+(\.\d+){3}$') OR h LIKE '%.' OR NOT regexp_matches(h, '^[a-z0-9.-]+$') OR regexp_matches(h, '\.(localhost|local|internal|home|lan|test|invalid)$') THEN 'host'
    WHEN regexp_matches(lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\.(exe|msi|scr|bat|cmd|ps1|apk|dmg|iso)$') THEN 'file type' END AS problem FROM (SELECT *, """ + HOST + " AS h FROM pages)")
def url_intake(t):
    return t.pages.select("page_id", U.intake_problem(F.col("url")).alias("problem"))


@query(f"SELECT page_id FROM pages WHERE ({HOST} = 'example.net' OR {HOST} LIKE '%.example.net') AND NOT ({HOST} LIKE '%.tion.example.net')")
def domain_filter(t):
    h = U.host(F.col("url"))
    return t.pages.where(U.in_domain(h, "example.net") & ~U.in_domain(h, "tion.example.net")).select("page_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_antijoin(t):
    return C.without(t.embeddings.select("vec_id"), t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(t):
    return C.without(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_left(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'q' || l.quality END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_documents(t):
    new = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return C.upserted(t.documents.select("doc_id", "lang"), new, "doc_id")


@query(f"WITH {DOCS} SELECT doc_id, '<url><loc>' || url || '</loc></url>' AS line FROM docs ORDER BY doc_id LIMIT 50000")
def sitemap_export(t):
    return sitemap_lines(docs(t))


@query(r"SELECT conv_id, turn, list_distinct([x::INT FOR x IN regexp_extract_all('[' || turn || '] ' || '[1, ' || conv_id || ']', '\d+')]) IS NOT NULL AS cites, len(list_distinct([x::INT FOR x IN regexp_extract_all('[' || turn || '] [1, ' || conv_id || ']', '\d+')]))::INT AS n_cited FROM conversations")
def cited_ids(t):
    text = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] [1, "), F.col("conv_id").cast("string"), F.lit("]"))
    ids = T.cited_ids(text)
    return t.conversations.select("conv_id", "turn", ids.isNotNull().alias("cites"), F.size(ids).alias("n_cited"))


# --- dates, queues, logs


@query("SELECT o_orderkey, round(exp(-ln(2) * greatest(date_diff('second', o_orderdate, TIMESTAMP '1998-08-02') / 86400.0, 0.0) / 180), 6) AS weight FROM orders")
def time_decay(t):
    age = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.lit("1998-08-02").cast("timestamp")) / 86400.0
    return t.orders.select("o_orderkey", F.round(S.decay(age), 6).alias("weight"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN l.doc_id IS NOT NULL THEN n_chars END DESC NULLS LAST, doc_id)::INT AS place FROM documents LEFT JOIN labels l USING (doc_id)")
def date_sort_nulls_last(t):
    d = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return R.by_date(d.withColumn("when", F.when(F.col("quality").isNotNull(), F.col("n_chars"))), "when", True, ["lang"], "doc_id").select("doc_id", "place")


@query("""WITH d AS (SELECT o_orderkey AS doc_id, o_orderdate AS fetched_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate - INTERVAL 40 DAY END AS changed_at FROM orders),
    i AS (SELECT *, coalesce(least(greatest((epoch_us(TIMESTAMP '1998-08-02') - epoch_us(changed_at)) / 86400000000.0 / 2, 7.0), 365.0), 7.0) AS i FROM d)
    SELECT doc_id, round(i, 6)::DOUBLE AS interval_days FROM i WHERE (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(fetched_at)) / 86400000000.0 >= i""")
def refresh_due(t):
    d = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp") - F.expr("INTERVAL 40 DAY")).alias("changed_at"))
    return O.refresh_due(d, F.lit("1998-08-02").cast("timestamp"), 7.0, 365.0)


FRONTIER = f"frontier AS (SELECT url, {BARE} AS host, 1.0 / (1 + page_id % 7) AS priority, page_id AS enqueued_at, ['queued', 'in_flight', 'queued', 'done'][page_id % 4 + 1] AS status, (page_id // 4 % 4)::INT AS lane FROM pages)"


def frontier(t: Tables) -> DataFrame:
    i = F.col("page_id")
    status = F.element_at(F.array(F.lit("queued"), F.lit("in_flight"), F.lit("queued"), F.lit("done")), (i % 4 + 1).cast("int"))
    return t.pages.select("url", U.bare_host(F.col("url")).alias("host"), (1.0 / (1 + i % 7)).alias("priority"), i.alias("enqueued_at"), status.alias("status"), (F.floor(i / 4) % 4).cast("int").alias("lane"))


@query(f"WITH {FRONTIER} SELECT url, host, (host IN (SELECT host FROM frontier WHERE status = 'in_flight'))::INT AS busy, row_number() OVER (PARTITION BY host ORDER BY priority DESC, enqueued_at, url)::INT AS turn FROM frontier WHERE status = 'queued'")
def frontier_host_fair(t):
    return O.host_fair(frontier(t))


@query(f"WITH {FRONTIER} SELECT url, lane, round(row_number() OVER (PARTITION BY lane ORDER BY priority DESC, enqueued_at, url) / [50, 30, 15, 5][lane + 1], 6) AS slot FROM frontier WHERE status = 'queued'")
def lane_round_robin(t):
    return O.lane_order(frontier(t))


@query(f"WITH {FRONTIER} SELECT lane, status, count(*) AS n FROM frontier GROUP BY 1, 2")
def frontier_status(t):
    return O.status_counts(frontier(t))


@query(f"WITH {FRONTIER}, g AS (SELECT host, count(*) AS attempts, avg((status = 'done')::INT) AS r FROM frontier GROUP BY 1 HAVING count(*) >= 3) SELECT host, attempts, round(r, 6) AS rate, CASE WHEN r < 0.1 THEN 'purge' WHEN r < 0.3 THEN 'demote' ELSE 'keep' END AS action FROM g")
def host_health(t):
    return O.host_health(frontier(t).select("host", (F.col("status") == "done").alias("ok")), 3, 0.1, 0.3)


SAMPLES = "samples AS (SELECT ts, event_type AS endpoint, value AS latency, event_id % 10 <> 0 AS ok FROM events)"
LEVELS = f"""{SAMPLES}, levels AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, endpoint, count(*) AS n, round(avg((NOT ok)::INT), 6) AS error_rate,
    list_sort(list(latency))[floor((count(*) - 1) * 0.5)::INT + 1] AS p50, list_sort(list(latency))[floor((count(*) - 1) * 0.95)::INT + 1] AS p95, list_sort(list(latency))[floor((count(*) - 1) * 0.99)::INT + 1] AS p99 FROM samples GROUP BY 1, 2)"""


def samples(t: Tables) -> DataFrame:
    return t.events.select("ts", F.col("event_type").alias("endpoint"), F.col("value").alias("latency"), (F.col("event_id") % 10 != 0).alias("ok"))


@query(f"WITH {LEVELS} SELECT * FROM levels")
def sla_window(t):
    return O.service_levels(samples(t), "1 hour")


@query(f"WITH {LEVELS}, s AS (SELECT endpoint, window_start, CASE WHEN p50 > 30 THEN 'critical' WHEN p50 > 20 THEN 'warn' ELSE 'ok' END AS severity FROM levels), l AS (SELECT *, lag(severity, 1, 'ok') OVER (PARTITION BY endpoint ORDER BY window_start) AS before FROM s) SELECT endpoint, window_start, before, CASE severity WHEN 'ok' THEN 'recovered' ELSE severity END AS severity FROM l WHERE severity <> before")
def severity_transitions(t):
    return O.transitions(O.service_levels(samples(t), "1 hour"), "p50", 20.0)


@query("SELECT event_type AS endpoint, list_sort(list(value))[floor((count(*) - 1) * 0.95)::INT + 1] AS p95 FROM events GROUP BY 1")
def sla_percentiles(t):
    return O.percentiles(t.events.select(F.col("event_type").alias("endpoint"), "value"), "value", [0.95], ["endpoint"])


@query("SELECT le::DOUBLE AS le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1, 5, 10, 50, 100]) AS le) GROUP BY 1")
def latency_histogram(t):
    return O.histogram(t.events, "value", [1, 5, 10, 50, 100])


DAILY = "daily AS (SELECT event_type AS article, ts::DATE AS day, count(DISTINCT user_id) AS readers FROM events GROUP BY 1, 2)"


def views(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("article"), "ts", F.col("user_id").alias("reader"))


@query(f"WITH {DAILY} SELECT article, strftime(day, '%Y-%m-%d') AS day, readers, sum(readers) OVER (PARTITION BY article ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::BIGINT AS readers_7d FROM daily")
def readers_7d(t):
    return O.readers_week(O.readers(views(t))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END, '(unknown)') AS endpoint, count(*) AS n, count(*) FILTER (event_id % 3 = 2) AS up, count(*) FILTER (event_id % 3 = 0) AS down, sum(event_id % 3 - 1)::BIGINT AS net FROM events GROUP BY 1")
def feedback_summary(t):
    ratings = t.events.select(F.col("event_id").alias("qid"), (F.col("event_id") % 3 - 1).alias("rating"))
    return O.feedback(ratings, t.events.where("event_id % 5 <> 0").select(F.col("event_id").alias("qid"), F.col("event_type").alias("endpoint")))


@query("SELECT event_type, (props::JSON->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_properties(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


# --- general relational coverage


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def orders_by_nation(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"))


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 10)")
def events_cube(t):
    return t.events.withColumn("bucket", F.col("user_id") % 10).cube("event_type", "bucket").agg(F.count("*").alias("n"))
