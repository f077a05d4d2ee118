"""Queries over files: the driver's tables are written in a format and read back by its reader, each beside its SQL."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources import readers as X
from ..sources import writers as Y
from ..storage import new_path
from .catalog import DOCS, docs, query


def as_lines(df: DataFrame, tag: str, **options) -> str:
    """A folder of text files that hold df's one column, line by line."""
    path = new_path(df.sparkSession, tag)
    df.write.text(path, **options)
    return path


def as_files(df: DataFrame, folder: str, ending: str) -> str:
    """A file per row (name, body) under a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_output_stream(f"{base}/{name}{ending}", compression=None) as f:
                    f.write(body)
            yield b.select([0])

    df.select("name", F.col("body").cast("binary")).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT 'doc://x/' || item_id AS url, 'Item ' || item_id AS title, text FROM benchmark")
def json_corpus(t):
    """A corpus as one JSON document."""
    i = F.col("item_id").cast("string")
    path = new_path(t.spark, "corpus")
    Y.export(t.benchmark.select(F.concat(F.lit("doc://x/"), i).alias("url"), F.concat(F.lit("Item "), i).alias("title"), "text"), path, "json")
    return X.json_corpus(t.spark, path)


@query(f"WITH {DOCS} SELECT url, title, text FROM docs")
def jsonl_corpus(t):
    path = new_path(t.spark, "corpus")
    Y.export(docs(t).select("url", "title", "text"), path, "jsonl")
    return X.jsonl_corpus(t.spark, path)


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS query_id, text, 'doc://' || item_id AS relevant, 1 AS n_paraphrases FROM benchmark")
def query_set(t):
    """A set of queries with what is relevant and how else they may be put."""
    q = t.benchmark.select("item_id", F.struct("text", F.array(F.concat(F.lit("doc://"), F.col("item_id").cast("string"))).alias("relevant"), F.array(F.upper("text")).alias("paraphrases")).alias("q"))
    one = q.agg(F.array_sort(F.collect_list(F.struct("item_id", "q"))).alias("a")).select(F.to_json(F.struct(F.lit("set").alias("name"), F.transform("a", lambda x: x["q"]).alias("queries"))).alias("value"))
    return X.json_queries(t.spark, as_lines(one, "queries")).select("query_id", "text", F.col("relevant")[0].alias("relevant"), F.size("paraphrases").alias("n_paraphrases"))


@query("SELECT DISTINCT 'x' || user_id % 30 || '.org' AS suffix FROM events WHERE event_id % 3 <> 0")
def suffix_list(t):
    line = F.concat(F.lit("  .X"), (F.col("user_id") % 30).cast("string"), F.lit(".org # listed"))
    lines = t.events.select(F.when(F.col("event_id") % 3 == 0, "# only a remark").otherwise(line).alias("value"))
    return X.suffix_list(t.spark, as_lines(lines, "suffixes")).distinct()


@query("SELECT 'h' || user_id % 50 AS host, min(event_id)::INT AS rank FROM events GROUP BY 1")
def popularity_list(t):
    """The best rank of each host, whatever its case."""
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.concat(F.when(F.col("event_id") % 2 == 0, "H").otherwise("h"), (F.col("user_id") % 50).cast("string")))
    return X.popularity(t.spark, as_lines(t.events.select(line.alias("value")), "ranks"))


@query("SELECT 'h' || user_id % 50 AS host, max(least(event_id % 130, 100))::INT AS trust_flow FROM events GROUP BY 1")
def trust_flow_list(t):
    host, flow = F.concat(F.lit("H"), (F.col("user_id") % 50).cast("string")), (F.col("event_id") % 130).cast("string")
    line = F.concat_ws(",", F.lit("1"), F.lit("2"), host, *[F.lit("x")] * 6, flow)
    return X.trust_flow(t.spark, as_lines(t.events.select(line.alias("value")), "flows"))


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS position, 'http://site' || item_id || '.org/' AS url FROM benchmark WHERE item_id <= 60")
def contributed_list(t):
    """A small file of addresses under a header, beside another column."""
    ids = F.array_sort(F.collect_list("item_id"))
    rows = F.transform(ids, lambda i: F.concat(F.lit("name,http://site"), i.cast("string"), F.lit(".org/")))
    lines = t.benchmark.where("item_id <= 60").agg(F.concat_ws("\n", F.lit("name,Website"), rows).alias("value"))
    return X.contributed_urls(t.spark, as_lines(lines, "contributed"))


@query("WITH u AS (SELECT page_id % 40 AS k, min(page_id) AS position FROM pages WHERE page_id % 40 % 4 <> 3 GROUP BY 1) SELECT 'https://site' || k || '.org/' || CASE WHEN k % 4 = 1 THEN '?q=1' ELSE '' END AS url, position FROM u")
def taken_in(t):
    """Addresses that intake accepts, cleaned, each once."""
    k = F.col("page_id") % 40
    u = F.concat(F.lit("HTTPS://Site"), k.cast("string"), F.when(k % 4 == 0, ".ORG").when(k % 4 == 1, ".org?q=1").when(k % 4 == 2, ".org/#top").otherwise(".lan/x"))
    return U.taken_in(t.pages.select(F.col("page_id").alias("position"), u.alias("url")))


@query(r"SELECT url, trim(regexp_extract(text, '(?:^|\n)[ \t]*([^\s][^\n]*)', 1)) AS first, trim(text, E' \t\n\r') AS text FROM (SELECT 'http://x/' || doc_id AS url, text FROM documents WHERE doc_id % 3 = 0 AND trim(coalesce(text, ''), E' \t\n\r') <> '' AND length(text) = octet_length(encode(text)) AND NOT contains(text, chr(13)) AND length(trim(regexp_extract(text, '(?:^|\n)[ \t]*([^\s][^\n]*)', 1))) <= 200)")
def wet_archive(t):
    """Conversion records of packed archives, between records of other kinds, some twenty to a file."""
    d = t.documents.where("doc_id % 3 = 0 AND trim(coalesce(text, '')) <> ''").select("doc_id", "text")
    plain = (F.length("text") == F.octet_length("text")) & ~F.col("text").contains("\r") & (F.length(F.trim(F.regexp_extract("text", r"(?:^|\n)[ \t]*([^\s][^\n]*)", 1))) <= 200)
    record = lambda kind, body: F.concat(F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x/"), F.col("doc_id").cast("string"), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    both = d.where(plain).select("doc_id", F.concat(record("request", F.lit("GET /")), record("conversion", F.col("text"))).alias("r"))
    files = both.groupBy((F.col("doc_id") % 20).cast("string").alias("name")).agg(F.concat_ws("", F.collect_list("r")).alias("body"))
    folder = as_files(packed(files), new_path(t.spark, "archives"), ".wet.gz")
    return X.wet(t.spark, folder).select("url", F.col("title").alias("first"), "text").where("text <> ''")


def packed(files: DataFrame) -> DataFrame:
    """Files (name, body) with their bodies packed."""
    @F.pandas_udf("binary")
    def gz(s: pd.Series) -> pd.Series:
        return s.map(lambda x: gzip.compress(x.encode()))

    return files.select("name", gz("body").alias("body"))


@query("SELECT DISTINCT url AS loc FROM pages WHERE url IS NOT NULL AND page_id % 5 < 4")
def sitemap_pages(t):
    """An index of four sitemaps, half of them packed, and the addresses in them; a fifth map is not in the index."""
    escape = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    maps = t.pages.where("url IS NOT NULL").groupBy((F.col("page_id") % 5).alias("k")).agg(F.concat(F.lit("<urlset>"), F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc>"), escape, F.lit("</loc></url>")))), F.lit("</urlset>")).alias("body"))
    folder = new_path(t.spark, "sitemaps")
    name = F.concat(F.lit("map"), F.col("k").cast("string"))
    as_files(maps.where("k IN (0, 1, 4)").select(name.alias("name"), "body"), folder, ".xml")
    as_files(packed(maps.where("k IN (2, 3)").select(name.alias("name"), "body")), folder, ".xml.gz")
    index = t.spark.createDataFrame([("index", "<sitemapindex>" + "".join(f"<sitemap><loc>http://x/map{k}.xml{'.gz' * (k > 1)}</loc></sitemap>" for k in range(4)) + "</sitemapindex>")], "name string, body string")
    return X.sitemap(t.spark, as_files(index, new_path(t.spark, "index"), ".xml"), folder)


@query("SELECT DISTINCT 'http://feed/' || page_id AS link FROM pages WHERE page_id % 3 < 2")
def feed_links(t):
    """Links of feeds of both forms; entries without one are left out."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    item = F.when(k == 0, F.concat(F.lit("<item><link>http://feed/"), i, F.lit("</link></item>"))).when(k == 1, F.concat(F.lit('<entry><link rel="self" href="http://no/"/><link href="http://feed/'), i, F.lit('"/></entry>'))).otherwise("<item><title>t</title></item>")
    files = t.pages.groupBy((F.col("page_id") % 6).cast("string").alias("name")).agg(F.concat(F.lit("<feed>"), F.concat_ws("", F.collect_list(item)), F.lit("</feed>")).alias("body"))
    return X.feed(t.spark, as_files(files, new_path(t.spark, "feeds"), ".xml")).distinct()


@query("SELECT count(*) AS n_texts, true AS same FROM benchmark")
def exported_texts(t):
    """Exports as text hold every title and address."""
    d = t.benchmark.select(F.concat(F.lit("http://x/"), F.col("item_id").cast("string")).alias("url"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), "text")
    path = new_path(t.spark, "texts")
    Y.export(d, path, "text")
    whole = t.spark.read.text(path, wholetext=True)
    n = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^URL: (http://x/\d+)$"), 1)).alias("url")).distinct()
    return n.join(d, "url").agg(F.count("*").alias("n_texts"), (F.count("*") == F.countDistinct("url")).alias("same"))


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 AND length(coalesce(html, '')) < 2000 THEN CASE page_id % 4 WHEN 0 THEN 'unverified' ELSE 'rejected' END END AS problem FROM pages")
def page_problems(t):
    """Short pages whose title says that they are a check or a parked domain."""
    k = F.col("page_id") % 4
    title = F.when(k == 0, " Just  a moment... ").when(k == 1, "Buy this domain!").when(k == 2, "A moment of peace").otherwise("Login help")
    return t.pages.select("page_id", T.page_problem(title, F.coalesce("html", F.lit(""))).alias("problem"))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || event_id || chr(10) || 'data: end' || chr(10) || chr(10) AS value FROM events")
def event_lines(t):
    """Events as a server would stream them."""
    return Y.event_lines(t.events.select(F.col("event_id").alias("place"), F.col("event_type").alias("event"), F.concat(F.col("event_id").cast("string"), F.lit("\nend")).alias("data"))).select(F.col("place").alias("event_id"), "value")
