"""Readers: driver tables, JSON, lists, WET archives, HTML, sitemaps, feeds, robots rules."""

from __future__ import annotations

import gzip
import html.parser
import io
import json
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_bound


class Tables:
    """Driver tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def index(self):
        """The stored index of documents, built on first use."""
        from ..operators.index import adapted, stored

        return stored(self.spark, self.folder, lambda: adapted(self.documents))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A file {docs: [{url, title, text}]}."""
    return spark.read.schema("docs array<struct<url: string, title: string, text: string>>").json(path, multiLine=True).select(F.inline("docs"))


def json_queries(spark: SparkSession, path: str) -> DataFrame:
    """A file {name, queries: [{text, relevant, paraphrases}]}."""
    shape = "name string, queries array<struct<text: string, relevant: array<string>, paraphrases: array<string>>>"
    q = spark.read.schema(shape).json(path, multiLine=True).select(F.posexplode("queries"))
    return q.select(F.col("pos").alias("query_id"), "col.*")


def suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """One suffix per line, # begins a comment."""
    s = F.lower(F.trim(F.substring_index("value", "#", 1)))
    return spark.read.text(path).select(F.regexp_replace(s, r"^\.+", "").alias("suffix")).where("suffix <> ''")


def popularity(spark: SparkSession, path: str) -> DataFrame:
    """rank,host lines; the best rank of each host."""
    return spark.read.schema("rank int, host string").csv(path).groupBy(F.lower("host").alias("host")).agg(F.min("rank").alias("rank"))


def trust_flow(spark: SparkSession, path: str) -> DataFrame:
    """Third column host, tenth trust flow, at most 100; the largest of each host."""
    c = spark.read.csv(path)
    return c.groupBy(F.lower("_c2").alias("host")).agg(F.max(F.least(F.col("_c9").try_cast("int"), F.lit(100))).alias("trust_flow"))


def contributed_urls(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """One URL per line, or the column url/urls/webpage/website; a row without one, or more than `most` rows, fails the
    whole file. A file is small by its rule, so its rows are read once, on the driver, up to that bound."""
    names = ("url", "urls", "webpage", "website")
    clean = lambda x: (x or "").removeprefix("\ufeff").strip()
    rows = [list(r) for r in spark.read.csv(path, header=False, ignoreLeadingWhiteSpace=True).limit(most + 2).collect()]
    at = [k for k, x in enumerate(rows[0]) if clean(x).lower() in names] if rows else []
    if rows and not at and sum(x is not None for x in rows[0]) != 1:
        raise ValueError("several columns need a header that names the one with addresses")
    urls = [clean(r[at[-1] if at else 0]) for r in rows[1 if at else 0 :]]
    if "" in urls:
        raise ValueError(f"row {urls.index('') + (2 if at else 1)} has no address")
    if len(urls) > most:
        raise ValueError(f"more than {most} rows")
    return spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "position int, url string")


def jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One {url, title, text} a line; lines that are none have nulls and are left out."""
    return spark.read.schema("url string, title string, text string").json(path).where("url IS NOT NULL")


LOG = "qid string, ts timestamp, endpoint string, query string, latency_ms double, status int"


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n events of a query log of JSON lines, the newest first."""
    return spark.read.schema(LOG).json(path).where("ts IS NOT NULL").orderBy(F.desc("ts"), F.desc("qid")).limit(n)


def wet_records(stream: io.BufferedIOBase) -> Iterator[tuple[str, str, bytes]]:
    """(type, target, body) of every record of an inflated WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        head: dict[str, str] = {}
        while (h := stream.readline()).strip():
            k, _, v = h.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head.get("warc-type", ""), head.get("warc-target-uri", ""), stream.read(int(head.get("content-length") or 0))


def wet(spark: SparkSession, path: str) -> DataFrame:
    """url, title and text of conversion records. A file is one task, for gzip cannot be split; it is read as a stream, a
    record at a time, so no file is held as a whole."""
    files = spark.read.format("binaryFile").load(path).select("path")  # the content column is pruned
    n = max(1, min(4096, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, where = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(where, compression="gzip" if where.endswith(".gz") else None) as f:
                    yield from wet_batches(wet_records(io.BufferedReader(f)))

    return files.repartition(n).mapInArrow(run, "url string, title string, text string")


def wet_batches(records: Iterator[tuple[str, str, bytes]], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for kind, url, body in records:
        if kind == "conversion":
            text = body.decode("utf-8", "replace").strip()
            first = next((x.strip() for x in text.split("\n") if x.strip()), "")
            rows.append((url, first.encode()[:200].decode("utf-8", "ignore"), text))
            held += len(body)
        if held >= most or len(rows) >= 1000:
            yield wet_batch(rows)
            rows, held = [], 0
    if rows:
        yield wet_batch(rows)


def wet_batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["url", "title", "text"])


# Elements without content, words of class, id or role that mark what surrounds content.
DROPPED = ["script", "style", "noscript", "iframe", "svg", "nav", "footer", "header", "aside", "form", "button"]
SURROUNDING = [
    "nav", "navbar", "navigation", "menu", "sidebar", "side-bar", "footer", "site-footer", "header", "site-header", "page-header", "banner", "cookie-banner", "cookie-notice",
    "ad", "ads", "advert", "advertisement", "promo", "comment", "comments", "share", "social", "social-share", "breadcrumb", "breadcrumbs", "newsletter", "subscribe",
]
ROLES = ["navigation", "banner", "complementary"]
ICONS = ["icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon"]
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def linked_data(raw: str) -> dict[str, str]:
    """The first value of each field in a block of linked data, its objects taken outermost first; empty if unreadable."""
    try:
        todo = [json.loads(raw)]
    except ValueError:
        return {}
    out: dict[str, str] = {}

    def text(x: object, inner: str) -> str:
        """A string, an object's field, or the first of a list that has one."""
        if isinstance(x, str):
            return x.strip()
        if isinstance(x, dict):
            return text(x.get(inner), "") if inner else ""
        return next((t for y in x if (t := text(y, inner))), "") if isinstance(x, list) else ""

    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            for name, inner in (("name", ""), ("headline", ""), ("description", ""), ("keywords", ""), ("datePublished", ""), ("dateModified", ""), ("author", "name"), ("image", "url")):
                value = text(x.get(name), inner) if not (name == "author" and isinstance(x.get(name), list)) else ""
                if value and not isinstance(x.get(name), list) or value and name == "image":
                    out.setdefault(name, value)
            todo += list(x.values())
        elif isinstance(x, list):
            todo += x
    return out


class PageParser(html.parser.HTMLParser):
    """What a page says: title, text, links, language, image, icon, author, dates."""

    def __init__(self, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.lang, self.icon = base, "", ""
        self.bare_title, self.parts, self.links = "", [], {}
        self.meta: dict[str, str] = {}
        self.data: dict[str, str] = {}
        self.open: list[tuple[str, bool]] = []  # open elements and whether each is left out
        self.quiet, self.reading, self.block, self.in_body = 0, "", "", False

    def resolve(self, href: str) -> str:
        href = href.strip()
        if not href or href.startswith(("#", "javascript:", "mailto:")):
            return ""
        try:
            full = urllib.parse.urldefrag(urllib.parse.urljoin(self.base, href)).url
            return full if urllib.parse.urlsplit(full).scheme in ("http", "https") else ""
        except ValueError:
            return ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html":
            self.lang = a.get("lang", self.lang)
        elif tag == "body":
            self.in_body = True
        elif tag == "title" and not self.bare_title:
            self.reading = "title"
        elif tag == "link":
            if not self.icon and a.get("href", "").strip() and any(x in ICONS for x in a.get("rel", "").lower().split()):
                self.icon = self.resolve(a["href"])
        elif tag == "meta":
            for key in (a.get("property", "").lower(), a.get("name", "").lower()):
                if key and a.get("content", "").strip():
                    self.meta.setdefault(key, a["content"].strip())
        elif tag == "script" and "ld+json" in a.get("type", "").lower():
            self.reading, self.block = "data", ""
        words = " ".join(a.get(k, "") for k in ("class", "id", "role")).lower().split()
        out = tag in DROPPED or any(w in SURROUNDING for w in words) or a.get("role", "").strip().lower() in ROLES
        if tag not in VOID:
            self.open.append((tag, out))
            self.quiet += out
        if tag == "a" and self.in_body and not self.quiet and (u := self.resolve(a.get("href", ""))):
            self.links[u] = None

    def handle_endtag(self, tag: str) -> None:
        if self.reading == "data" and tag == "script":
            for k, v in linked_data(self.block.strip()).items():
                self.data.setdefault(k, v)
        if tag in ("title", "script"):
            self.reading = ""
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, out = self.open.pop()
                self.quiet -= out
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.reading == "title":
            self.bare_title += data
        elif self.reading == "data":
            self.block += data
        elif self.in_body and not self.quiet and data.strip():
            self.parts.append(data.strip())

    def page(self) -> dict:
        """The fields of the page. What its author says of it stands before its text."""
        m, d = self.meta, self.data
        title = m.get("og:title") or d.get("headline") or m.get("twitter:title") or self.bare_title.strip() or d.get("name", "")
        about = m.get("og:description") or d.get("description") or m.get("twitter:description") or m.get("description", "")
        body = " ".join(" ".join(self.parts).split())
        date = next((x for k in ("datePublished", "dateModified") if (x := d.get(k, "")) and DATE(x)), None)
        return {
            "title": title, "text": " ".join(x for x in (about, d.get("keywords"), d.get("author"), body) if x), "lang": self.lang, "links": list(self.links),
            "author": d.get("author"), "published": date, "image": m.get("og:image") or m.get("twitter:image") or d.get("image"), "icon": self.icon or None,
        }


#: A full timestamp with a zone, or a date.
DATE = re.compile(r"\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d))?").fullmatch


def parsed(page: str | None, base: str = "") -> dict:
    p = PageParser(base or "")
    p.feed(page or "")
    p.close()
    return p.page()


PAGE = "page_id long, title string, text string, lang string, links array<string>, author string, published_at timestamp, image string, icon string"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """PAGE rows of raw pages (page_id, url, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [{"page_id": i, **parsed(body, url)} for i, url, body in zip(f["page_id"], f["url"], f["html"])]
            yield pd.DataFrame(out, columns=["page_id", "title", "text", "lang", "links", "author", "published", "image", "icon"])

    form = PAGE.replace("published_at timestamp", "published string")
    rows = pages.select("page_id", "url", "html").mapInPandas(run, form)
    return rows.withColumn("published_at", date_bound(F.col("published"))).select(*[c.split()[0] for c in PAGE.split(", ")])


def inflated(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def locations(data: bytes) -> tuple[str, list[str]]:
    """'urlset' or 'sitemapindex', and its addresses. A broken file gives what stands before the break."""
    kind, out, inside = "", [], False
    try:
        for event, e in ElementTree.iterparse(io.BytesIO(inflated(data)), ("start", "end")):
            name = e.tag.rpartition("}")[2]
            if event == "start":
                kind, inside = kind or name, inside or name in ("url", "sitemap")
            elif name == "loc" and inside and (e.text or "").strip():
                out.append(e.text.strip())
            elif name in ("url", "sitemap"):
                inside = False
                e.clear()
    except (ElementTree.ParseError, EOFError, OSError):
        pass
    return kind, out


def sitemap(spark: SparkSession, path: str, children: str | None = None) -> DataFrame:
    """loc of the pages of sitemaps, packed or not. Of an index, the files it names are looked for by their last path
    part under the folder `children`, one level down."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("struct<kind: string, locs: array<string>>")
    def read(content: pd.Series) -> pd.DataFrame:
        got = [locations(bytes(x)) for x in content]
        return pd.DataFrame({"kind": [k for k, _ in got], "locs": [v for _, v in got]})

    first = files.select(read("content").alias("_x")).select("_x.kind", F.explode("_x.locs").alias("loc"))
    pages = first.where("kind = 'urlset'").select("loc")
    if children is None:
        return pages
    named = first.where("kind = 'sitemapindex'").select(F.substring_index("loc", "/", -1).alias("_n")).distinct()
    below = spark.read.format("binaryFile").load(children).withColumn("_n", F.substring_index("path", "/", -1)).join(named, "_n", "left_semi")
    second = below.select(read("content").alias("_x")).where("_x.kind = 'urlset'").select(F.explode("_x.locs").alias("loc"))
    return pages.union(second).distinct()


def feed_links(data: bytes) -> list[str]:
    """Addresses of a feed's entries, of either form; of several links of an entry the alternate one."""
    out: list[str] = []
    try:
        root = ElementTree.fromstring(inflated(data))
    except (ElementTree.ParseError, EOFError, OSError):
        return out
    for e in root.iter():
        name = e.tag.rpartition("}")[2]
        if name == "item":
            out += [c.text.strip() for c in e if c.tag.rpartition("}")[2] == "link" and (c.text or "").strip()][:1]
        elif name == "entry":
            links = [c for c in e if c.tag.rpartition("}")[2] == "link" and c.get("href", "").startswith(("http://", "https://"))]
            out += [c.get("href") for c in sorted(links, key=lambda c: c.get("rel", "alternate") != "alternate")][:1]
    return out


def feed(spark: SparkSession, path: str) -> DataFrame:
    """link of the entries of feeds, one task or more a file."""

    @F.pandas_udf("array<string>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda x: feed_links(bytes(x)))

    return spark.read.format("binaryFile").load(path).select(F.explode(read("content")).alias("link"))


def pdf_text(data: bytes) -> str:
    """The text that a PDF shows by its plain and deflated streams, for files whose fonts keep byte codes. Others need a
    reader of their own; what cannot be read is left out."""
    out: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for show in re.findall(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")", body, re.S):
            words = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", show[0] or show[1], re.S)
            text = b"".join(re.sub(rb"\\([()\\])", rb"\1", w) for w in words).decode("latin-1")
            if any(c.isalnum() for c in text):
                out.append(text)
    return " ".join(" ".join(out).split())


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """path and text of PDF files; a file that breaks its parser has an empty text."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        def one(x: bytes) -> str:
            try:
                return pdf_text(bytes(x))
            except (ValueError, RecursionError):
                return ""

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("text"))


def conditional(docs: DataFrame) -> DataFrame:
    """Request headers for fetching stored pages (url, etag, last_modified) again: what a fetcher outside sends."""
    pairs = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(h).alias("name"), F.col(c).alias("value"))) for h, c in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified"))]))
    return docs.select("url", pairs.alias("headers"))


def fetched_pages(responses: DataFrame) -> DataFrame:
    """Responses (url, final_url, status, content_type, etag, last_modified, body) as pages: 304 says unchanged, errors
    carry a reason, and the kind of body decides the parser."""
    kind = F.when(F.lower("content_type").contains("pdf"), "pdf").when(F.lower("content_type").contains("html") | F.col("content_type").isNull(), "html").otherwise("other")
    status = F.when(F.col("status") == 304, "unchanged").when(F.col("status") >= 400, F.concat(F.lit("http "), F.col("status").cast("string"))).otherwise("fetched")
    return responses.select("url", F.coalesce("final_url", "url").alias("final_url"), status.alias("outcome"), kind.alias("parser"), "etag", "last_modified", F.when(status == "fetched", F.col("body")).alias("body"))


def robots_rules(text: str) -> list[tuple[str, str, str]]:
    """(agent, kind, pattern) of a robots file; consecutive agent lines share the rules that follow."""
    rules, agents, open_ = [], [], False
    for raw in text.splitlines():
        key, _, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if value:
                rules += [(a, key, value) for a in agents]
    return rules


def robots_regex(pattern: str) -> str:
    """A rule's pattern as an anchored expression: * for anything, $ for the end."""
    ends = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in pattern.removesuffix("$").split("*")) + ("$" if ends else "")


def robots_allowed(rules: list[tuple[str, str, str]], agent: str, path: str) -> bool:
    """The longest matching rule of the longest matching agent decides; between equals, disallow."""
    agent = agent.lower()
    known = [a for a in {r[0] for r in rules} if a == "*" or a in agent]
    if not known:
        return True
    best = max(known, key=lambda a: (a != "*", len(a)))
    hits = [(len(p), kind) for a, kind, p in rules if a == best and re.search(robots_regex(p), path)]
    longest = lambda kind: max((n for n, k in hits if k == kind), default=-1)
    return longest("disallow") < 0 or longest("allow") > longest("disallow")


def robots_decisions(rules: DataFrame, urls: DataFrame, agent: str) -> DataFrame:
    """Adds `allowed` to addresses (url, host) by the rules (host, agent, kind, pattern) of their hosts: the longest
    agent's rules, the longest match, refusal between equals. Rules meet only addresses of their host."""
    a = agent.lower()
    fits = rules.where((F.col("agent") == "*") | F.lit(a).contains(F.col("agent")))
    size = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = fits.groupBy(F.col("host").alias("_h")).agg(F.max(size).alias("_size"))
    mine = fits.withColumn("_s", size).join(best, (F.col("host") == F.col("_h")) & (F.col("_s") == F.col("_size"))).select(F.col("host").alias("_host"), "kind", "pattern")
    ends = F.col("pattern").endswith("$")
    core = F.when(ends, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(F.col("pattern"))
    quoted = F.regexp_replace(core, r"([.+?^$(){}|\[\]\\])", r"\\$1")
    mine = mine.withColumn("_re", F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(ends, "$").otherwise("")))
    where = F.regexp_replace(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    target = F.when(where == "", "/").otherwise(F.regexp_replace(where, "#.*$", ""))
    j = urls.withColumn("_t", target).join(mine, F.col("host") == F.col("_host"), "left").withColumn("_hit", F.expr("_t RLIKE _re"))
    longest = lambda k: F.coalesce(F.max(F.when(F.col("_hit") & (F.col("kind") == k), F.length("pattern"))), F.lit(-1))
    got = j.groupBy(*urls.columns).agg(longest("allow").alias("_a"), longest("disallow").alias("_d"))
    return got.select(*urls.columns, ((F.col("_d") < 0) | (F.col("_a") > F.col("_d"))).alias("allowed"))
