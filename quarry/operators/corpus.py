"""Corpus jobs: census, duplicates, audits, filters, purges, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..storage import spread


def census(rows: DataFrame, by: Column, name: str, words: str = "body_len") -> DataFrame:
    """Documents and their words per value; rows of an index, or any with a column of word counts."""
    return rows.groupBy(by.alias(name)).agg(F.count("*").alias("n_docs"), F.sum(words).alias("n_tokens"))


def listed(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents in the order of their ids, all or the first ones."""
    ordered = docs.orderBy("doc_id")
    return ordered if limit is None else ordered.limit(limit)


def duplicate_keys(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Groups of more than one row with the same key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1").withColumn("removable", F.col("n") - 1)


def removable_by_host(pages: DataFrame) -> DataFrame:
    """Pages per host beyond the first of their key."""
    keyed = pages.select("page_id", U.dedup_key(F.col("url")).alias("key"), U.bare_host(F.col("url")).alias("host"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("page_id"))
    return keyed.withColumn("_n", n).where("_n > 1").groupBy("host").agg(F.count("*").alias("removable"))


def copies(docs: DataFrame) -> DataFrame:
    """Documents whose exact text another document holds, with the smallest of its kind."""
    d = docs.select("doc_id", T.digest(F.col("text")).alias("sha"))
    g = d.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(g, "sha").select("doc_id", "first", "n")


def with_authority(hosts: DataFrame, trusted: DataFrame | None = None, ranks: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """Adds domain, n_hosts (distinct hosts of the domain) and score to distinct hosts. Dimensions: trusted (host),
    ranks (host, rank), flows (host, trust_flow); each is looked up by host, then by domain."""
    h = hosts.withColumn("domain", U.registered(F.col("host")))
    siblings = h.groupBy(F.col("domain").alias("_d")).agg(F.count("*").alias("n_hosts"))
    h = h.join(siblings, F.col("domain") == F.col("_d")).drop("_d")
    signals: dict[str, Column] = {}

    def looked_up(h: DataFrame, table: DataFrame, value: Column, by_host: str, by_domain: str) -> DataFrame:
        one = table.select(F.col("host").alias("_k"), value.alias("_v")).groupBy("_k").agg(F.max("_v").alias("_v"))
        for key, name in (("host", by_host), ("domain", by_domain)):
            h = h.join(one.select(F.col("_k").alias(f"_k_{name}"), F.col("_v").alias(f"_{name}")), F.col(key) == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
            signals[name] = F.col(f"_{name}")
        return h

    if trusted is not None:
        h = looked_up(h, trusted, F.lit(True), "trusted_host", "trusted_domain")
        signals["trusted"] = F.coalesce(signals.pop("trusted_host"), F.lit(False)) | F.coalesce(signals.pop("trusted_domain"), F.lit(False))
    if ranks is not None:
        h = looked_up(h, ranks, F.col("rank"), "rank", "domain_rank")
    if flows is not None:
        h = looked_up(h, flows, F.col("trust_flow"), "flow", "domain_flow")
    score = F.round(S.authority(F.col("host"), F.col("domain"), U.tld(F.col("host")), F.col("n_hosts"), signals), 6)
    return h.withColumn("score", score).select(*hosts.columns, "domain", "n_hosts", "score")


def domain_audit(pages: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """Hosts with page counts, sibling hosts, score and class."""
    hosts = pages.groupBy(U.bare_host(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages")).where("host <> ''")
    return with_authority(hosts, **dimensions).withColumn("class", S.authority_class(F.col("score"))).select("host", "domain", "n_pages", "n_hosts", "score", "class")


def listed_terms(text: Column, terms: list[str]) -> Column:
    """How many distinct listed words a text holds."""
    return F.size(F.array_intersect(T.letter_tokens(text), F.array(*[F.lit(t) for t in terms])))


BODY_BYTES = 200_000


def head_bytes(text: Column, n: int) -> Column:
    """The first n bytes of a text as text, a character that is cut left out."""
    return F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, n), "UTF-8"), "\ufffd$", "")


def flagged(rows: DataFrame, terms: list[str], hosts: list[str], tlds: list[str], least: int = 2) -> DataFrame:
    """Adult filter with lists given by the caller: a host fragment or top-level domain, or `least` distinct words."""
    h = U.host(F.col("url"))
    by_host = U.tld(h).isin(tlds) if tlds else F.lit(False)
    for x in hosts:
        by_host = by_host | h.contains(x)
    # The first 200,000 bytes of a text, which few texts reach: a byte count before any character is cut.
    n = listed_terms(F.when(F.octet_length("text") <= BODY_BYTES, F.col("text")).otherwise(head_bytes(F.col("text"), BODY_BYTES)), terms)
    return rows.withColumns({"n_terms": n, "by_host": by_host}).withColumn("flagged", F.col("by_host") | (F.col("n_terms") >= least))


def stuffed(docs: DataFrame, span: int = 8, often: int = 3, least_words: int = 160, percent: int = 80) -> DataFrame:
    """Documents most of whose word spans are occurrences beyond the third, counted within each text: no shuffle."""

    def is_stuffed(text: str) -> bool:
        words = text.lower().encode("utf-8", "replace").split()
        n = len(words) - span + 1
        if len(words) < least_words:
            return False
        index: dict[bytes, int] = {}
        a = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        # Runs of 2, 4, 8 words get numbers from the numbers of their halves.
        width = 1
        while width < span:
            pair = a[: len(a) - width] * (int(a.max()) + 1) + a[width:]
            a = np.unique(pair, return_inverse=True)[1]
            width *= 2
        return int(np.maximum(np.bincount(a) - often, 0).sum()) * 100 >= n * percent

    assert span & (span - 1) == 0, "spans are built by doubling"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([is_stuffed(t or "") for t in b.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep)], ["doc_id"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long")


def under_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Hosts equal to or below any suffix: their own suffixes are spelled out and joined, no pairwise test."""
    labels = F.split("host", r"\.")
    own = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    s = hosts.select("host", F.explode(own).alias("suffix"))
    return s.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").select("host").distinct()


def upserted(old: DataFrame, new: DataFrame, key: str, keep_first: list[str] = []) -> DataFrame:
    """New rows replace old ones of their key; the named columns keep their first value."""
    names = old.columns
    o, n = old.select([F.col(c).alias(f"_o_{c}") for c in names]), new.select([F.col(c).alias(f"_n_{c}") for c in names])
    both = o.join(n, F.col(f"_o_{key}") == F.col(f"_n_{key}"), "full")
    is_new = F.col(f"_n_{key}").isNotNull()
    value = lambda c: F.coalesce(f"_o_{c}", f"_n_{c}") if c in keep_first else F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return both.select([value(c).alias(c) for c in names])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table (soft delete, purge, orphans)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def fetched(wanted: DataFrame, docs: DataFrame, chars: int | None = None) -> DataFrame:
    """Requested ids in order, with their whole text or its first `chars` characters, missing ones marked."""
    d = docs.select(F.col("doc_id").alias("_d"), (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("text"))
    return wanted.join(d, F.col("doc_id") == F.col("_d"), "left").select("position", "doc_id", F.col("_d").isNotNull().alias("found"), "text")
