"""URLs as columns: hosts, keys, scopes, intake rules."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track, in page addresses and, more of them, in keys of duplicates.
PAGE_TRACKERS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
TRACKERS = ["ref", "ref_src", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga"]
# Public suffixes of more than one label, by rule: these second levels under the country codes beside them, and hosting
# domains under which names belong to different owners.
SECOND_LEVELS = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "jp": "ac ad co ed go gr lg ne or", "au": "com net org edu gov asn id", "nz": "ac co geek gen govt iwi maori net org school",
    "br": "com net org gov edu art blog eco", "in": "ac co edu firm gen gov ind mil net org res", "za": "ac co gov law mil net nom org web", "kr": "ac co go ne or pe re",
    "cn": "ac com edu gov mil net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per", "my": "com edu gov mil name net org",
    "mx": "com edu gob net org", "ar": "com edu gob gov int mil net org tur", "co": "com edu gov mil net nom org", "tr": "av bbs bel com edu gen gov k12 mil name net org web",
    "il": "ac co gov idf k12 muni net org", "th": "ac co go in mi net or", "id": "ac biz co desa go mil my net or sch web", "ua": "com edu gov in net org", "pl": "com edu gov info net org waw",
    "vn": "ac biz com edu gov health info name net org", "ph": "com edu gov mil net ngo org", "pk": "com edu gov net org", "bd": "ac com edu gov mil net org", "eg": "com edu gov net org", "sa": "com edu gov med net org pub sch",
    "es": "com edu gob nom org", "it": "edu gov", "fr": "asso com gouv nom prd tm", "ru": "ac edu gov int mil", "gr": "com edu gov net org", "pe": "com edu gob mil net nom org", "cl": "co gob gov mil", "ir": "ac co gov id net org sch", "ae": "ac co gov mil net org sch",
}
HOSTING = ["github.io", "gitlab.io", "netlify.app", "vercel.app", "pages.dev", "web.app", "firebaseapp.com", "appspot.com", "herokuapp.com", "glitch.me", "repl.co", "deno.dev", "fly.dev", "workers.dev", "blogspot.com"]
DEEP_SUFFIXES = [f"{x}.{tld}" for tld, names in SECOND_LEVELS.items() for x in names.split()] + HOSTING


def host(url: Column) -> Column:
    """Lower-case host without port."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def tld(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")


def registered(name: Column) -> Column:
    """The registered domain: two labels, or three under a deep suffix; a suffix itself stands for itself."""
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    return F.when(two.isin(DEEP_SUFFIXES), three).otherwise(two)


def in_domain(name: Column, domain: str) -> Column:
    """The domain itself or a host below it."""
    return (name == domain) | name.endswith("." + domain)


def path(url: Column) -> Column:
    p = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def in_site(url: Column, site_host: str, prefix: str) -> Column:
    """Host and a path prefix that ends at a segment's end."""
    p = prefix.rstrip("/")
    return in_domain(host(url), site_host) & ((path(url) == p) | path(url).startswith(p + "/"))


def parameters(url: Column) -> Column:
    """Query parameters without trackers, sorted."""
    q = F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.substring_index(p, "=", 1)
    return F.array_sort(F.filter(F.split(q, "&"), lambda p: (p != "") & ~name(p).isin(TRACKERS) & ~name(p).startswith("utm_")))


def dedup_key(url: Column) -> Column:
    """One key for https/http, www., default ports, closing slashes, fragments, trackers and parameter order."""
    port = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/:?#]+:(\d+)", 1)
    p = F.regexp_replace(path(url), "/+$", "")
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    query = F.array_join(parameters(url), "&")
    return F.concat(
        F.when(scheme == "http", "https").otherwise(scheme),
        F.lit("://"),
        bare_host(url),
        F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        F.when(p == "", "/").otherwise(p),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def canonical(url: Column) -> Column:
    """http(s) only; no fragment, lower-case host, trackers dropped whatever their case, parameters sorted by name. Else
    null. Parameters of one name keep their order."""
    base = F.regexp_extract(F.trim(url), r"^([^?#]*)", 1)
    scheme, rest = F.lower(F.regexp_extract(base, r"^([a-zA-Z]+)://", 1)), F.regexp_extract(base, r"^[a-zA-Z]+://[^/]*(.*)$", 1)
    where = F.lower(F.regexp_extract(base, r"^[a-zA-Z]+://([^/]*)", 1))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~name(p).isin(PAGE_TRACKERS) & ~name(p).startswith("utm_"))
    placed = F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    query = F.array_join(F.transform(F.array_sort(placed), lambda x: x["p"]), "&")
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), where, rest, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def in_sites(url: Column, sites: str) -> Column:
    """Within any of comma-separated hosts or host/path entries, with or without a scheme; no entry: everywhere."""
    out, some = F.lit(False), False
    for raw in sites.split(","):
        entry = raw.strip().removeprefix("https://").removeprefix("http://")
        name, slash, rest = entry.partition("/")
        if name.strip():
            some = True
            prefix = (slash + rest).strip().rstrip("/")
            out = out | (in_site(url, name.strip().lower(), prefix) if prefix else in_domain(host(url), name.strip().lower()))
    return out if some else F.lit(True)


def crawl_allowed(url: Column, patterns: list[str], exclude: list[str], include: list[str], dynamic: Column | None = None) -> Column:
    """Crawl policy: a listed piece of the address refuses, then an excluded domain; an empty inclusion list admits, else
    an included or a `dynamic` (learnt) domain does."""
    refused, listed = F.lit(False), F.lit(not include)
    for p in patterns:
        refused = refused | url.contains(p) if p else refused
    name = F.regexp_replace(host(url), r"\.$", "")
    for d in exclude:
        refused = refused | in_domain(name, entry_host(d))
    for d in include:
        listed = listed | in_domain(name, entry_host(d))
    if dynamic is not None:
        listed = listed | F.coalesce(dynamic, F.lit(False))
    return ~refused & listed


def entry_host(entry: str) -> str:
    """A list entry as a host: lower case, without port and outer dots."""
    e = entry.strip().lower()
    return (e.partition(":")[0] if e.count(":") == 1 else e).strip(".")


DEFAULT_PORTS = {"http": "80", "https": "443"}


def port(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+:(\d+)", 1)


def clean_path(p: Column) -> Column:
    """A path without "." and "..", percent-encoded ones too, and without a closing slash."""
    dot, up = "(?i)^(?:\\.|%2e)$", "(?i)^(?:\\.\\.|\\.%2e|%2e\\.|%2e%2e)$"
    less = lambda out: F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    step = lambda out, x: F.when(x.rlike(up), less(out)).when(x.rlike(dot), out).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    return F.regexp_replace(F.array_join(kept, "/"), "/$", "")


def variant_key(url: Column) -> Column:
    """One key for addresses that differ by scheme, www., a dot after the host, the default port, dot segments, a closing
    slash or a query alone. null without a host."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"\.+$", ""), r"^www\.", "")
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    n = port(url)
    default = F.when(scheme == "http", DEFAULT_PORTS["http"]).when(scheme == "https", DEFAULT_PORTS["https"])
    raw = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(h != "", F.concat(h, F.when((n == "") | (n == default), "").otherwise(F.concat(F.lit(":"), n)), clean_path(raw)))


def resolve(base: str | None, href: str | None) -> str | None:
    """A link of a page as an absolute http(s) address without fragment; None for other schemes and bare anchors."""
    h = (href or "").strip()
    if not h or h.startswith("#"):
        return None
    try:
        full = urllib.parse.urldefrag(urllib.parse.urljoin(base or "", h)).url
        parts = urllib.parse.urlsplit(full)
    except ValueError:
        return None
    return full if parts.scheme in ("http", "https") and parts.netloc else None


def resolved(base: Column, href: Column) -> Column:
    @F.pandas_udf("string")
    def apply(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y) for x, y in zip(b, h)], dtype=object)

    return apply(base, href)


def host_boosts(rows: DataFrame, url: Column, boosts: DataFrame) -> DataFrame:
    """Adds `boost`: that of the longest listed suffix of the address's host, 1 without one. boosts: suffix, boost. A
    host's own suffixes are spelled out and joined. rows are told apart by all their columns and one more."""
    marked = rows.withColumn("_host", host(url))
    labels = F.split("_host", r"\.")
    own = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = boosts.select(F.lower("suffix").alias("_suffix"), F.col("boost").alias("_boost")).where("_suffix <> ''")
    hosts = marked.select("_host", F.explode(own).alias("_suffix")).distinct().join(listed, "_suffix")
    best = hosts.groupBy("_host").agg(F.max_by("_boost", F.length("_suffix")).alias("boost"))
    return marked.join(best, "_host", "left").select(*rows.columns, F.coalesce("boost", F.lit(1.0)).alias("boost"))


def ends_in(text: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | text.endswith(e)
    return out


def taken_in(urls: DataFrame) -> DataFrame:
    """Contributed addresses (position, url) that are fine, without fragment, with a path, each once, in their order."""
    u = F.regexp_replace(F.trim("url"), "#.*$", "")
    whole = F.regexp_replace(u, r"^([a-zA-Z]+://[^/?#]*)(?=$|\?)", "$1/")
    head = F.regexp_extract(whole, r"^([a-zA-Z]+://[^/?#]*)", 1)
    clean = F.concat(F.lower(head), F.expr("substring(_w, length(_h) + 1)"))
    good = urls.where(intake_problem(F.col("url")).isNull()).withColumns({"_w": whole, "_h": head}).select("position", clean.alias("url"))
    return good.groupBy("url").agg(F.min("position").alias("position"))


def fnv1a(data: bytes) -> int:
    """The 32-bit hash that deals addresses to shards."""
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def shard(url: Column, n: int) -> Column:
    """The shard of an address among n: hashed by its bytes, modulo n."""

    @F.pandas_udf("int")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda u: fnv1a(u.encode()) % n, na_action="ignore").astype("Int32")

    return apply(url)


# Endings of hosts that are not public, and of paths that are programs.
RESERVED_HOSTS = [".localhost", ".local", ".internal", ".home", ".lan", ".test", ".invalid"]
PROGRAMS = [".exe", ".msi", ".scr", ".bat", ".cmd", ".ps1", ".apk", ".dmg", ".iso"]


def intake_problem(url: Column) -> Column:
    """Why a contributed URL is refused; null if it is fine."""
    u, h = F.trim(url), host(url)
    port = F.regexp_extract(u, r"^[a-zA-Z]+://[^/:?#]+:(\d+)", 1)
    return (
        F.when(F.octet_length(url) > 2048, "too long")
        .when(~F.lower(u).rlike("^https?://"), "scheme")
        .when(u.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "credentials")
        .when(~port.isin("", "80", "443"), "port")
        .when(~h.contains(".") | h.rlike(r"^\d+(\.\d+){3}$") | h.endswith(".") | ~h.rlike("^[a-z0-9.-]+$") | ends_in(h, RESERVED_HOSTS), "host")
        .when(ends_in(F.lower(path(u)), PROGRAMS), "file type")
    )
