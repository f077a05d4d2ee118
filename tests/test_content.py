"""Titles, excerpts, replies, address variants, pages: what SQL cannot tell."""

import gzip
import math

from pyspark.sql import functions as F

from quarry.functions import replies, scoring, text, titles, urls
from quarry.operators import corpus, store
from quarry.sources import readers


def col(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_title_rules():
    told = {
        "A fine title": "", "x\ty": "char_class", " padded": "spacing", "two  gaps": "spacing", "x": "length", "n" * 121: "length", "mail me [at] home": "address",
        "see www.here": "url", "a < b": "forbidden_char", "why so?": "question", "printer.corp": "internal_host", "deep.name.example": "host_like", "shop.store in town": "",
        "lamps.com": "host_like", "ASP.NET tips": "", "call 12 34-56 now": "digit_run", "abc123def456": "hex_id", "fix #7": "ticket_ref", "what you want": "first_second_person",
        "the US economy": "", "join us": "first_second_person", "World War I": "", "as i see": "personal_phrase", "Should I stay": "personal_phrase", "I/O basics": "", "日本": "slug_empty",
    }
    assert {t: titles.title_problem(t) for t in told} == told
    assert titles.title_problem("日本", alias=True) == ""


def test_slugs():
    assert titles.slug("Crème brûlée & C# + F#: Ørsted’s tea") == "creme-brulee-and-c-sharp-plus-f-sharp-orsteds-tea"
    assert titles.slug("Straße # 5") == "strasse-5" and titles.slug("ﬁne ½") == "fine-1-2"
    long = "-".join(["word"] * 30)
    assert len(titles.slug(long)) <= 80 and titles.slug(long).endswith("word") and titles.slug("y" * 99) == "y" * 80
    assert titles.numbered("z" * 80, 12) == "z" * 77 + "-12" and titles.numbered("a", 1) == "a"


def test_assigned_slugs_are_unique(spark):
    bases = ["a", "a", "a-2", "a", "api", "b" * 80, "b" * 80, "a-2"]
    rows = spark.createDataFrame(list(enumerate(bases)), "k int, base string")
    got = [r.slug for r in titles.assigned(rows, "k", "base").orderBy("k").collect()]
    assert len(set(got)) == len(got) and got[0] == "a" and got[2] == "a-2" and "api" not in got and all(len(x) <= 80 for x in got)


def test_excerpts_count_bytes():
    assert text.excerpt_of("short", 10) == "short" and text.excerpt_of("one two three", 9) == "one two…"
    assert text.excerpt_of("é" * 10, 5) == "éé…" and text.excerpt_of("x" * 40, 30) == "x" * 30 + "…"
    assert text.context_of("é" * 6000, 3) == "é" * 4998 + "…" and text.context_of("ab", 99) == "ab" and text.context_of("abc" * 999, 20_000) == ""
    assert text.embed_head_of("日" * 9, 5) == "日" * 4 and text.embed_head_of("word " * 1000, 5000) == ("word " * 500).strip()
    assert text.embed_head_of("", 3) == ""


def test_date_bounds(spark):
    got = col(spark, ["2020-02-30", "2020-02-03", "2020-02-03T04:05:06Z", "2020-02-03T04:05:06+02:00", "2020-02-03 04:05:06", "", None], lambda c: F.unix_timestamp(text.date_bound(c)))
    assert got == [None, 1580688000, 1580702706, 1580695506, None, None, None]


def test_replies(spark):
    assert col(spark, ['```json\n["a"]\n```', 'x ["b", "c"] y', "][", "[1", None], lambda c: replies.string_list(c, F.lit("q"))) == [["a"], ["b", "c"], ["q"], ["q"], ["q"]]
    assert col(spark, ["[2, 2, 0]", "[9]", "none"], lambda c: replies.places(c, F.lit(3))) == [[2, 0, 1], [0, 1, 2], [0, 1, 2]]
    p = col(spark, ['{"queries": ["a"], "since_days": 3651, "decay_days": 7}', "oops"], lambda c: replies.plan(c, F.lit("q")))
    assert p[0].queries == ["a"] and p[0].since_days is None and p[0].decay_days == 7 and tuple(p[1]) == ("research", ["q"], "hybrid", None, None)
    assert col(spark, ['pre {"missing": "m"} post', "{", "no"], replies.verdict)[1:] == [None, None]
    assert col(spark, ["", "q" * 3000, "a​b", "fine"], replies.query_problem) == ["required", "too_long", "invalid_chars", ""]
    assert col(spark, ["The sources do NOT mention it.", "It is so.", "do not have " + "x" * 800], replies.says_nothing) == [True, False, False]


def test_address_variants(spark):
    same = ["http://www.Site.org:80/a/./b/../c/?q=1", "https://site.org./a/c", "https://site.org:443/a/c/#x", "http://site.org/a/%2E/x/%2e%2E/c"]
    assert len(set(col(spark, same, urls.variant_key))) == 1
    assert col(spark, ["http://site.org:443/a", "http://site.org/../..", "mailto:x"], urls.variant_key) == ["site.org:443/a", "site.org", None]
    assert col(spark, ["HTTP://A.org/x?utm_a=1&REF=2&b=3&Fbclid=4&a=5#f", "ftp://a/", "https://a.org?x"], urls.canonical) == ["http://a.org/x?REF=2&a=5&b=3", None, "https://a.org?x="]
    assert col(spark, ["http://a.org/?ref=1&ref_src=2&_ga=3&k=v"], urls.dedup_key) == ["https://a.org/?k=v"]
    assert [urls.resolve("http://a.org/b/c", h) for h in ("d#e", "//x.y/z", "javascript:1", "#top", " ", "../../q")] == ["http://a.org/b/d", "http://x.y/z", None, None, None, "http://a.org/q"]
    assert urls.fnv1a(b"") == 2166136261 and urls.fnv1a(b"a") == 0xE40C292C and urls.fnv1a(b"foobar") == 0xBF9CF968
    assert col(spark, ["a.b.co.uk", "me.github.io", "x.y.example", "localhost"], urls.registered) == ["b.co.uk", "me.github.io", "y.example", "localhost"]


def test_novelty(spark):
    live = spark.createDataFrame([("http://a.org/x", "s1", "crawl"), ("http://b.org/y", "s2", "import")], "url string, sha string, source string")
    new = spark.createDataFrame([("http://c.org/", "s1"), ("https://www.b.org/y/?q", "s3"), ("https://a.org/x", "s4")], "url string, sha string")
    assert [r.url for r in store.novel(new, live).collect()] == ["https://a.org/x"]


def test_authority_takes_the_host_before_the_domain(spark):
    hosts = spark.createDataFrame([("a.x.org",), ("x.org",), ("y.icu",), ("z.ac.uk",), ("q.edu",)], "host string")
    t, r = spark.createDataFrame([("x.org",)], "host string"), spark.createDataFrame([("x.org", 50), ("a.x.org", 5000)], "host string, rank int")
    f = spark.createDataFrame([("x.org", 80)], "host string, trust_flow int")
    got = {x.host: x.score for x in corpus.with_authority(hosts, t, r, f).collect()}
    assert got == {"a.x.org": 1.0, "x.org": 1.0, "y.icu": 0.2, "z.ac.uk": 0.65, "q.edu": 0.7}
    bare = {x.host: x.score for x in corpus.with_authority(hosts, ranks=r, flows=f).collect()}
    assert math.isclose(bare["a.x.org"], 0.5 + 0.16 + 0.8 * 0.12) and math.isclose(bare["x.org"], 0.5 + 0.3 + 0.12)
    assert col(spark, [0, 2, 9], lambda c: scoring.backoff_seconds(c, F.lit(3000)), "int") == [3.0, 12.0, 768.0]


PAGE = """<html lang="en"><head><title> Bare </title><meta property="og:description" content="About it"><link rel="shortcut icon" href="/i.png">
<script type="application/ld+json">{"@graph": [{"headline": "Head", "author": {"name": "Ann Other"}, "image": [{"url": "http://i/p.png"}], "datePublished": "2021-05-06"}, {"headline": "Second"}]}</script>
<script>var x = "<p>no</p>";</script></head><body class="page menu-open"><nav>skip <a href="/skip">s</a></nav><p>One<br>two</p><div class="x sidebar">skip</div>
<a href="/k#f">link</a><a href="mailto:a@b">m</a><img src="x"><p>three &amp; four</p></body></html>"""


def test_pages(spark):
    p = readers.parsed(PAGE, "http://a.org/b")
    assert (p["title"], p["text"], p["lang"]) == ("Head", "About it Ann Other One two link m three & four", "en")
    assert (p["links"], p["icon"], p["image"], p["author"], p["published"]) == (["http://a.org/k"], "http://a.org/i.png", "http://i/p.png", "Ann Other", "2021-05-06")
    assert readers.parsed("<script type='application/ld+json'>{bad</script><title>T</title><body>b")["title"] == "T" and readers.parsed(None)["text"] == ""
    assert readers.linked_data('[{"name": " n "}, {"name": "m", "author": "A", "keywords": "k"}]') == {"name": "n", "author": "A", "keywords": "k"}
    pages = spark.createDataFrame([(1, "http://a.org/", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in readers.parsed_pages(pages).collect()}
    assert str(got[1].published_at) == "2021-05-06 00:00:00" and got[2].links == []


def test_files(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>')
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>http://a/maps/c.xml.gz</loc></sitemap></sitemapindex>")
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "c.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc>http://a/3</loc></url><url><lo"))
    (tmp_path / "maps" / "other.xml").write_text("<urlset><url><loc>http://a/4</loc></url></urlset>")
    read = lambda name, **k: sorted(r.loc for r in readers.sitemap(spark, str(tmp_path / name), **k).collect())
    assert read("s.xml") == ["http://a/1", "http://a/2"] and read("i.xml", children=str(tmp_path / "maps")) == ["http://a/3"]
    assert readers.feed_links(b"<rss><channel><item><link> http://a/r </link></item><item><title>x</title></item></channel></rss>") == ["http://a/r"]
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="http://a/s"/><link rel="alternate" href="http://a/t"/></entry><entry><link href="http://a/u"/></entry></feed>'
    assert readers.feed_links(atom) == ["http://a/t", "http://a/u"] and readers.feed_links(b"<broken") == []
    (tmp_path / "c.jsonl").write_text('{"url": "http://a", "title": "t", "text": "x"}\nnot json\n')
    assert readers.jsonl_corpus(spark, str(tmp_path / "c.jsonl")).count() == 1
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    (tmp_path / "w.wet.gz").write_bytes(gzip.compress(record(b"warcinfo", b"i")) + gzip.compress(record(b"conversion", "\n Tïtle \nbody".encode())))
    assert [tuple(r) for r in readers.wet(spark, str(tmp_path / "w.wet.gz")).collect()] == [("http://x/", "Tïtle", "Tïtle \nbody")]
    pdf = b"%PDF-1.4\n1 0 obj\n<< >>\nstream\nBT (Hello \\(you\\)) Tj [(wo) -20 (rld)] TJ ET\nendstream\nendobj\nxx stream\n\xff\xfe bad"
    assert readers.pdf_text(pdf) == "Hello (you) world" and readers.pdf_text(b"") == ""


def test_contributed_files_fail_as_a_whole(spark, tmp_path):
    import pytest

    f = tmp_path / "c.csv"
    read = lambda body: (f.write_text(body), [r.url for r in readers.contributed_urls(spark, str(f), 3).orderBy("position").collect()])[1]
    assert read("﻿http://a\nhttp://b\n") == ["http://a", "http://b"] and read("name,Website\nx,http://c\n") == ["http://c"]
    for bad in ("name,URL\nx,http://a\ny,\n", "a,b\nc,d\n", "http://1\nhttp://2\nhttp://3\nhttp://4\n"):
        with pytest.raises(ValueError):
            read(bad)


def test_fetch_headers_and_outcomes(spark):
    docs = spark.createDataFrame([("u", "e1", ""), ("v", None, None)], "url string, etag string, last_modified string")
    assert {r.url: [(h.name, h.value) for h in r.headers] for r in readers.conditional(docs).collect()} == {"u": [("If-None-Match", "e1")], "v": []}
    form = "url string, final_url string, status int, content_type string, etag string, last_modified string, body string"
    got = readers.fetched_pages(spark.createDataFrame([("a", None, 200, "text/HTML; x", None, None, "b"), ("b", "c", 304, None, None, None, ""), ("d", None, 404, "application/pdf", None, None, "x")], form)).collect()
    assert [(r.final_url, r.outcome, r.parser, r.body) for r in got] == [("a", "fetched", "html", "b"), ("c", "unchanged", "html", None), ("d", "http 404", "pdf", None)]
