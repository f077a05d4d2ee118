"""Queries over texts, addresses, dates and replies, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies as P
from ..functions import scoring as S
from ..functions import text as T
from ..functions import titles as N
from ..functions import urls as U
from ..operators import corpus as C
from ..operators import index as I
from ..operators import store as D
from ..sources import readers as X
from ..sources.readers import Tables
from .catalog import BARE, DOCS, HOST, docs, query, tok

# --- addresses


@query("SELECT p.page_id, p.url FROM pages p JOIN (SELECT DISTINCT url FROM pages WHERE page_id % 7 = 0) USING (url)")
def url_lookup(t):
    """Pages by address, for a whole table of addresses at once."""
    asked = t.pages.where("page_id % 7 = 0").select("url").distinct()
    return t.pages.join(asked, "url", "left_semi").select("page_id", "url")


@query(f"SELECT page_id, {BARE} AS host FROM pages WHERE {BARE} LIKE '%.net'")
def host_pages(t):
    """Pages of hosts, from a table in directories by host."""
    from ..storage import written

    rows = t.pages.select("page_id", U.bare_host(F.col("url")).alias("host"))
    by_host = written(rows.withColumn("tld", U.tld(F.col("host"))), "hosts", ["tld"])
    return by_host.where("tld = 'net'").select("page_id", "host")


PATH = r"regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id FROM pages WHERE ({HOST} = 'example.net' OR {HOST} LIKE '%.example.net') AND ({PATH} = '/p' OR starts_with({PATH}, '/p/')) OR ({HOST} = 'example.org' OR {HOST} LIKE '%.example.org')")
def site_scope(t):
    return t.pages.where(U.in_sites(F.col("url"), "https://example.net/p/, example.org,")).select("page_id")


@query(f"SELECT page_id, NOT contains(url, '/private') AND NOT ({HOST} = 'tion.example.net' OR {HOST} LIKE '%.tion.example.net') AND ({HOST} = 'example.net' OR {HOST} LIKE '%.example.net' OR page_id % 5 = 0) AS allowed FROM pages")
def crawl_policy(t):
    return t.pages.select("page_id", U.crawl_allowed(F.col("url"), ["/private"], ["Tion.example.net:443"], ["example.net."], F.col("page_id") % 5 == 0).alias("allowed"))


PORT = r"regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+:(\d+)', 1)"
SCHEME = r"lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"
VARIANT = rf"""regexp_replace(regexp_replace({HOST}, '\.+$', ''), '^www\.', '') || CASE WHEN {PORT} = '' OR ({SCHEME} = 'http' AND {PORT} = '80') OR ({SCHEME} = 'https' AND {PORT} = '443') THEN '' ELSE ':' || {PORT} END
    || regexp_replace({PATH}, '/$', '')"""


@query(f"SELECT page_id, {VARIANT} AS key FROM pages WHERE {HOST} <> ''")
def url_variants(t):
    """The tables' paths have no dot segments; those are tested on addresses of their own."""
    return t.pages.select("page_id", U.variant_key(F.col("url")).alias("key")).where("key IS NOT NULL")


@query(f"WITH v AS (SELECT page_id AS doc_id, {VARIANT} AS key FROM pages WHERE {HOST} <> '') SELECT doc_id, key, n FROM v JOIN (SELECT key, count(*) AS n FROM v GROUP BY key HAVING count(*) > 1) USING (key)")
def url_twins(t):
    return D.twins(t.pages.select(F.col("page_id").alias("doc_id"), "url"))


@query(r"""WITH r AS (SELECT page_id, coalesce(html, '') AS h, url FROM pages), h AS (SELECT page_id, url, unnest(['/a/b?x=1#top', '../up', 'mailto:x@y.z', '#here', 'https://other.org/p#q', '//cdn.net/i']) AS href FROM r)
    SELECT page_id, href, CASE WHEN href LIKE 'mailto:%' OR href LIKE '#%' THEN NULL WHEN href LIKE 'https://%' THEN 'https://other.org/p' WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || href
        WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b?x=1' ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END || 'up' END AS link FROM h""")
def resolved_links(t):
    hrefs = F.explode(F.array(*[F.lit(x) for x in ("/a/b?x=1#top", "../up", "mailto:x@y.z", "#here", "https://other.org/p#q", "//cdn.net/i")]))
    rows = t.pages.select("page_id", "url", hrefs.alias("href"))
    return rows.select("page_id", "href", U.resolved(F.col("url"), F.col("href")).alias("link"))


@query(f"SELECT page_id, CASE WHEN {HOST} = 'tion.example.net' OR {HOST} LIKE '%.tion.example.net' THEN 3.0 WHEN {HOST} = 'example.net' OR {HOST} LIKE '%.example.net' THEN 1.5 WHEN {HOST} LIKE '%.org' OR {HOST} = 'org' THEN 0.5 ELSE 1.0 END::DOUBLE AS boost FROM pages")
def host_boost(t):
    b = t.spark.createDataFrame([("example.net", 1.5), ("Tion.example.net", 3.0), ("org", 0.5), ("", 9.0)], "suffix string, boost double")
    return U.host_boosts(t.pages.select("page_id", "url"), F.col("url"), b).select("page_id", "boost")


@query("""WITH RECURSIVE b AS (SELECT page_id, hex(encode(url)) AS x FROM pages WHERE url IS NOT NULL),
    h AS (SELECT page_id, x, 0 AS i, 2166136261::BIGINT AS h FROM b UNION ALL
        SELECT page_id, x, i + 1, ((xor(h, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT FROM h WHERE 2 * i < length(x))
    SELECT page_id, (h % 16)::INT AS shard FROM h WHERE 2 * i = length(x)""")
def url_shards(t):
    return t.pages.where("url IS NOT NULL").select("page_id", U.shard(F.col("url"), 16).alias("shard"))


@query(r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages), q AS (SELECT page_id, u, [p FOR p IN string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&') IF p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid') AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')] AS ps FROM p),
    s AS (SELECT page_id, u, array_to_string([x[3] FOR x IN list_sort([[split_part(p, '=', 1), lpad(i::VARCHAR, 6, '0'), CASE WHEN contains(p, '=') THEN p ELSE p || '=' END] FOR p, i IN ps])], '&') AS q FROM q)
    SELECT page_id, CASE WHEN lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) IN ('http', 'https') THEN lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS url FROM s""")
def canonical_urls(t):
    return t.pages.select("page_id", U.canonical(F.col("url")).alias("url"))


@query(f"WITH h AS (SELECT DISTINCT {BARE} AS host FROM pages) SELECT host FROM h WHERE host <> '' AND (host LIKE '%.net' OR host = 'net') AND NOT (host = 'tion.example.net' OR host LIKE '%.tion.example.net')")
def purge_keeping(t):
    """Hosts under a suffix but for kept ones."""
    one = lambda x: t.spark.createDataFrame([(x,)], "suffix string")
    pages = t.pages.select(F.col("page_id").alias("doc_id"), "url")
    return D.purge(pages, one("net"), one("tion.example.net"), apply=False).select("host").where("host <> ''").distinct()


# --- texts


@query(r"""WITH d AS (SELECT doc_id, text, encode(text) AS b FROM documents WHERE text IS NOT NULL AND length(text) = octet_length(encode(text)))
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE trim(CASE WHEN regexp_matches(substring(text, 185, 16), '[ \n\t]') THEN regexp_replace(substring(text, 1, 200), '[ \n\t][^ \n\t]*$', '') ELSE substring(text, 1, 200) END, E' \n\t\r') || '…' END AS excerpt FROM d""")
def ascii_excerpts(t):
    """Excerpts of the texts whose bytes are characters; others are tested against their bytes."""
    d = t.documents.where(F.length("text") == F.octet_length("text"))
    return d.select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"))


@query(r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) = octet_length(encode(text)))
    SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE trim(substring(text, 1, 997), E' \n\t\r') || '…' END AS part FROM d""")
def context_parts(t):
    """A source's share of the context when thirty are cited."""
    d = t.documents.where(F.length("text") == F.octet_length("text"))
    return d.select("doc_id", T.context(F.col("text"), 30).alias("part"))


@query(r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) = octet_length(encode(text)) AND NOT contains(text, chr(13)) AND NOT contains(text, chr(9))),
    c AS (SELECT doc_id, text, 286 - 1 AS i FROM d),
    w AS (SELECT doc_id, text, i, length(regexp_replace(substring(text, 1, i + 1), '[ \n][^ \n]*$', '')) AS s, regexp_matches(substring(text, 1, i + 1), '[ \n]') AS has FROM c)
    SELECT doc_id, CASE WHEN length(text) <= i THEN text WHEN has AND s > i // 2 THEN substring(text, 1, s) ELSE substring(text, 1, i) END AS head FROM w""")
def embed_heads(t):
    """What a model of 100 tokens is given: about 0.35 of one per ASCII character."""
    d = t.documents.where((F.length("text") == F.octet_length("text")) & ~F.col("text").contains("\r") & ~F.col("text").contains("\t"))
    return d.select("doc_id", T.embed_head(F.col("text"), 100).alias("head"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS text FROM documents")
def collapsed_texts(t):
    return t.documents.select("doc_id", F.trim(T.collapsed(F.col("text"))).alias("text"))


@query("SELECT conv_id, turn, trim(text) AS text FROM conversations")
def unthought(t):
    """Replies without what a model thought aloud."""
    raw = F.concat(F.lit("<think>so\nit is</think> "), F.col("text"), F.lit(" <think>x</think>"))
    return t.conversations.select("conv_id", "turn", T.without_thinking(raw).alias("text"))


@query("SELECT event_type, array_to_string([lower(trim(x)) FOR x IN string_split('A, ' || event_type || ',, b c ', ',') IF trim(x) <> ''], '|') AS parts, count(*) AS n FROM events GROUP BY 1")
def listed_values(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.array_join(T.listed(F.concat(F.lit("A, "), "event_type", F.lit(",, b c "))), "|").alias("parts"), "n")


SLUG = r"""array_to_string([w FOR w IN regexp_split_to_array(replace(replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '([a-z0-9])#', '\1 sharp ', 'g'), '[''’]', '', 'g'), '&', ' and '), '+', ' plus '), '[^a-z0-9]+') IF w <> ''], '-')"""
CUT = "rtrim(CASE WHEN length(f) <= 80 THEN f WHEN substring(f, 81, 1) = '-' THEN substring(f, 1, 80) WHEN strpos(substring(f, 1, 80), '-') > 1 THEN regexp_replace(substring(f, 1, 80), '-[^-]*$', '') ELSE substring(f, 1, 80) END, '-')"


@query(f"WITH {DOCS}, f AS (SELECT doc_id, {SLUG.format(x='title')} AS f FROM docs WHERE length(title) = octet_length(encode(title))) SELECT doc_id, {CUT} AS slug FROM f")
def ascii_slugs(t):
    d = docs(t).where(F.length("title") == F.octet_length("title"))
    return d.select("doc_id", N.slugs(F.col("title")).alias("slug"))


@query(f"WITH {DOCS}, f AS (SELECT doc_id, lang AS base FROM docs), n AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM f) SELECT doc_id, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n")
def assigned_slugs(t):
    return N.assigned(t.documents.select("doc_id", F.col("lang").alias("base")), "doc_id", "base")


@query(rf"""WITH {DOCS}, f AS (SELECT doc_id, title, lower(title) AS f FROM docs WHERE length(title) = octet_length(encode(title)))
    SELECT doc_id, CASE WHEN regexp_matches(title, '[\x00-\x1f\x7f]') THEN 'char_class' WHEN title <> trim(title) OR contains(title, '  ') THEN 'spacing' WHEN length(title) NOT BETWEEN 2 AND 120 THEN 'length'
        WHEN regexp_matches(f, '@|\[at\]|\(at\)') OR contains(f, chr(123) || 'at' || chr(125)) THEN 'address' WHEN regexp_matches(f, '://|www\.|mailto:') THEN 'url' WHEN regexp_matches(f, '[<>\[\]|\\^~*="`]') OR contains(f, chr(123)) OR contains(f, chr(125)) THEN 'forbidden_char' WHEN contains(f, '?') THEN 'question' ELSE 'later' END AS problem
    FROM f""")
def title_checks(t):
    """Which of the first rules a title breaks; the rules behind them, by Unicode and wording, are tested by themselves."""
    d = docs(t).where(F.length("title") == F.octet_length("title")).select("doc_id", N.title_problems(F.col("title")).alias("_p"))
    first = ["char_class", "spacing", "length", "address", "url", "forbidden_char", "question"]
    return d.select("doc_id", F.when(F.col("_p").isin(first), F.col("_p")).otherwise("later").alias("problem"))


@query("SELECT doc_id FROM documents WHERE octet_length(encode(coalesce(text, ''))) >= 200")
def long_enough(t):
    return t.documents.where(F.octet_length(F.coalesce("text", F.lit(""))) >= 200).select("doc_id")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS text_sha, sha256(coalesce(source, '') || chr(0) || coalesce(text, '')) AS page_sha, sha256(lower(trim(coalesce(lang, '')))) AS query_sha FROM documents""")
def digests(t):
    blank = lambda c: F.coalesce(c, F.lit(""))
    return t.documents.select("doc_id", T.digest(blank("text")).alias("text_sha"), T.digest(blank("source"), blank("text")).alias("page_sha"), T.digest(F.lower(F.trim(blank("lang")))).alias("query_sha"))


@query(r"""WITH d AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\x0c]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL AND length(text) = octet_length(encode(text))),
    c AS (SELECT doc_id, text, w, unnest(range(0, greatest(ceil((len(w) - 320) / 256.0), 0)::INT + 1)) AS n FROM d WHERE len(w) > 0)
    SELECT doc_id, n::INT AS chunk_no, len(string_split(array_to_string(w[n * 256 + 1 : n * 256 + 320], ' '), ' '))::BIGINT AS n_words FROM c""")
def chunk_sizes(t):
    """Words inside every byte span, read back from the text by the span."""
    d = t.documents.where(F.length("text") == F.octet_length("text"))
    spans = I.chunk_spans(d).join(d.select("doc_id", "text"), "doc_id")
    part = F.expr("substring(text, cast(byte_offset + 1 AS int), cast(byte_length AS int))")
    return spans.select("doc_id", "chunk_no", F.size(F.split(part, "[ \t\n\r\x0b\x0c]+")).cast("long").alias("n_words"))


# --- dates


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE::TIMESTAMP WHEN o_orderkey % 4 = 1 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL 90 MINUTE WHEN o_orderkey % 4 = 2 THEN NULL ELSE o_orderdate::DATE::TIMESTAMP - INTERVAL 2 HOUR END AS bound FROM orders""")
def date_bounds(t):
    """A date, a full timestamp in UTC, nonsense, a timestamp in another zone."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T01:30:00Z"))).when(k == 2, F.concat(F.lit("about "), day)).otherwise(F.concat(day, F.lit("T00:00:00+02:00")))
    return t.orders.select("o_orderkey", T.date_bound(raw).cast("timestamp_ntz").alias("bound"))


@query("""WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS d FROM orders) SELECT doc_id FROM d WHERE d >= TIMESTAMP '1995-01-01' AND d <= TIMESTAMP '1996-06-30'""")
def date_window(t):
    """Both ends included; a date that is not known fails."""
    d = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("published_at"), F.lit("").alias("url"))
    return D.export_rows(d, since=F.lit("1995-01-01").cast("timestamp"), until=F.lit("1996-06-30").cast("timestamp")).select("doc_id")


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 100 AS n FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN n WHEN 1 THEN 0 WHEN 2 THEN 90 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 0 END::DOUBLE AS wait, greatest(n * 40 / 1000.0, 1.0)::DOUBLE * pow(2.0, least(k, 8)) AS backoff FROM d""")
def retry_waits(t):
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey") % 100
    header = F.when(k == 0, n.cast("string")).when(k == 1, "soon").when(k == 2, "Sun, 02 Aug 1998 00:01:30 GMT").when(k == 3, "Sat, 01 Aug 1998 00:00:00 GMT").when(k == 4, "")
    return t.orders.select("o_orderkey", S.retry_after(header, F.lit("1998-08-02").cast("timestamp")).alias("wait"), S.backoff_seconds(k, n * 40).alias("backoff"))


@query("SELECT o_orderkey, round(greatest(2.0 / (1 + 0.25 * (o_orderkey % 200)), 0.05), 6)::DOUBLE AS priority FROM orders")
def link_priorities(t):
    return t.orders.select("o_orderkey", F.round(S.link_priority(F.lit(2.0), F.col("o_orderkey") % 200), 6).alias("priority"))


# --- replies


def reply(t: Tables) -> DataFrame:
    k, x = F.col("conv_id") % 4, F.col("turn").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('```json\n["a '), x, F.lit('", "b"]\n```'))).when(k == 1, F.concat(F.lit('Sure: ["q'), x, F.lit('"] as asked'))).when(k == 2, "no list").otherwise("[]")
    return t.conversations.select("conv_id", "turn", raw.alias("reply"))


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'a ' || turn || '|b' WHEN 1 THEN 'q' || turn ELSE 'asked' END AS queries FROM conversations")
def reply_lists(t):
    return reply(t).select("conv_id", "turn", F.array_join(P.string_list(F.col("reply"), F.lit("asked")), "|").alias("queries"))


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'compare' ELSE 'research' END AS intent, CASE conv_id % 4 WHEN 0 THEN 5 ELSE 1 END::INT AS n_queries,
    CASE conv_id % 4 WHEN 0 THEN 'dense' ELSE 'hybrid' END AS retriever, CASE WHEN conv_id % 4 = 0 AND turn BETWEEN 1 AND 3650 THEN turn END::INT AS since_days FROM conversations""")
def reply_plans(t):
    k, x = F.col("conv_id") % 4, F.col("turn").cast("string")
    good = F.concat(F.lit('```json\n{"intent": "compare", "queries": ["a","b","c","d","e","f"], "retriever": "dense", "since_days": '), x, F.lit("}\n```"))
    raw = F.when(k == 0, good).when(k == 1, '{"intent": "", "queries": [], "retriever": "magic", "since_days": 9999}').when(k == 2, "sorry").otherwise("{}")
    p = t.conversations.select("conv_id", "turn", P.plan(raw, F.lit("asked")).alias("p"))
    return p.select("conv_id", "turn", "p.intent", F.size("p.queries").alias("n_queries"), "p.retriever", "p.since_days")


@query("""SELECT conv_id, turn, conv_id % 3 < 2 AS readable, CASE conv_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS sufficient, CASE conv_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 END::INT AS n_refine FROM conversations""")
def reply_verdicts(t):
    k = F.col("conv_id") % 3
    raw = F.when(k == 0, 'Well, ```json\n{"sufficient": false, "missing": "x", "refine_queries": ["a","b","c","d"]}\n``` done').when(k == 1, '{"sufficient": true}').otherwise("no {idea")
    v = t.conversations.select("conv_id", "turn", P.verdict(raw).alias("v"))
    return v.select("conv_id", "turn", F.col("v").isNotNull().alias("readable"), "v.sufficient", F.when(F.col("v").isNotNull(), F.size("v.refine_queries")).alias("n_refine"))


@query("SELECT conv_id, turn, octet_length(encode(text || ' It does not mention it.')) <= 800 AS says_nothing FROM conversations")
def no_info_answers(t):
    return t.conversations.select("conv_id", "turn", P.says_nothing(F.concat("text", F.lit(" It does not mention it."))).alias("says_nothing"))


@query("SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'required' WHEN octet_length(encode(text)) > 300 THEN 'too_long' WHEN regexp_matches(text, '[\\p{Cc}\\p{Cf}]') THEN 'invalid_chars' ELSE '' END AS problem FROM conversations".replace("\\\\", "\\"))
def query_problems(t):
    return t.conversations.select("conv_id", "turn", P.query_problem(F.col("text"), 300).alias("problem"))


# --- pages


@query(None)
def html_text(t):
    return X.parsed_pages(t.pages)


@query(r"SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE html IS NOT NULL AND regexp_matches(html, '(?s)<title>[^&<]+</title>') AND NOT regexp_matches(html, 'og:title|twitter:title|ld\+json')")
def html_titles(t):
    """Titles and languages of pages that name them plainly."""
    plain = t.pages.where(F.col("html").rlike("(?s)<title>[^&<]+</title>") & ~F.col("html").rlike(r"og:title|twitter:title|ld\+json"))
    return X.parsed_pages(plain).select("page_id", "title", "lang")


@query(f"WITH {DOCS}, h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM docs) SELECT h.doc_id FROM h WHERE h.doc_id % 3 = 0 AND sha NOT IN (SELECT sha FROM h WHERE doc_id % 3 <> 0)")
def novel_documents(t):
    """Documents whose text no document of the others has, at addresses that nothing uncomparable holds."""
    d = docs(t).select("doc_id", "url", T.digest(F.coalesce("text", F.lit(""))).alias("sha"), F.lit("crawl").alias("source"))
    return D.novel(d.where("doc_id % 3 = 0").select("doc_id", "url", "sha"), d.where("doc_id % 3 <> 0")).select("doc_id")


@query(f"WITH {DOCS}, tk AS (SELECT doc_id, {tok('title')} AS t, {tok('text')} AS b, {tok('lang')} AS n FROM docs), o AS (SELECT doc_id, list_distinct(t || b) AS o, list_distinct([x FOR x IN b IF length(x) > 4] || n) AS n FROM tk WHERE doc_id % 5 = 0) SELECT doc_id, len([x FOR x IN o IF NOT list_contains(n, x)])::INT AS n_gone, len([x FOR x IN n IF NOT list_contains(o, x)])::INT AS n_come FROM o")
def reindexed_terms(t):
    """What indexing another text of a document takes from the index and adds to it."""
    d = docs(t).where("doc_id % 5 = 0")
    keep = F.array_join(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) > 4), " ")
    new = d.withColumn("text", F.concat_ws(" ", keep, "lang")).withColumn("title", F.lit(""))
    r = I.replaced_terms(I.forward(d), I.forward(new))
    return r.select("doc_id", F.size("gone").alias("n_gone"), F.size("come").alias("n_come"))


@query(f"WITH h AS (SELECT {HOST} AS host FROM pages) SELECT 'host' AS kind, host AS name, count(*) AS n FROM h GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, host) <= 5 UNION ALL SELECT 'tld', CASE WHEN contains(host, '.') THEN regexp_extract(host, '[^.]+$') ELSE '' END, count(*) FROM h GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, 2) <= 5")
def purge_histograms(t):
    return D.histograms(t.pages.select(U.host(F.col("url")).alias("host")), 5)


@query("SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def stale_graph_entries(t):
    from ..operators import ann

    graph = t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    return ann.stale_entries(graph, t.documents.where("doc_id % 3 <> 0")).select(F.col("doc_id").alias("vec_id"))


@query("WITH t AS (SELECT DISTINCT lang AS term FROM documents UNION SELECT 'none-' || item_id::VARCHAR FROM benchmark) SELECT term FROM t WHERE term NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL) AND term IS NOT NULL")
def orphaned_terms(t):
    terms = t.documents.select(F.col("lang").alias("term")).union(t.benchmark.select(F.concat(F.lit("none-"), F.col("item_id").cast("string")))).distinct().where("term IS NOT NULL")
    return I.orphaned_terms(terms, t.documents.select(F.col("lang").alias("term")))


@query(f"""WITH p AS (SELECT page_id, {BARE} AS host FROM pages), r AS (SELECT DISTINCT host, CASE WHEN host LIKE '%.tion.example.net' THEN 2 ELSE 1 END AS k FROM p)
    SELECT page_id, page_id % 3 <> 0 OR page_id % 2 = 0 AS allowed FROM pages WHERE {BARE} <> ''""")
def robots_allowed(t):
    """Every host refuses its third pages but for even ones, to our agent alone; addresses are made from page numbers."""
    h = U.bare_host(F.col("url"))
    urls = t.pages.where(h != "").select("page_id", h.alias("host"), F.concat(F.lit("https://"), h, F.when(F.col("page_id") % 3 == 0, "/third/").otherwise("/page/"), F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd"), F.lit("?x=1#y")).alias("url"))
    rule = [("*", "disallow", "/"), ("bot", "disallow", "/third/*"), ("bot", "allow", "/third/even?x=*"), ("bot", "allow", "/nothing$")]
    rules = urls.select("host").distinct().select("host", F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for a, k, p in rule])).alias("r")).select("host", "r.*")
    return X.robots_decisions(rules, urls, "Our-Bot/2.0").select("page_id", "allowed")
