"""The document store as tables: upserts, deletes, exports, coverage, reports, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import corpus as C
from .rank import in_window


def newest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first of the order: what stays when a batch names a key twice."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upserted_passages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Passages of a (doc_id, byte_offset, model) that come again replace the old ones."""
    keys = ["doc_id", "byte_offset", "model"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def changed(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """Change of fetched pages (url, sha, fetched_at) against stored ones (url, sha, change_count, changed_at): an equal
    digest leaves count and time, another one counts, a new page starts at 0 without a time."""
    o = old.select("url", F.col("sha").alias("_sha"), F.col("change_count").alias("_n"), F.col("changed_at").alias("_at"))
    j = fetched.join(o, "url", "left")
    differs = F.col("_sha").isNotNull() & ~F.col("sha").eqNullSafe(F.col("_sha"))
    return j.select("url", "sha", "fetched_at", (F.coalesce("_n", F.lit(0)) + differs.cast("int")).alias("change_count"), F.when(differs, F.col("fetched_at")).otherwise(F.col("_at")).alias("changed_at"), differs.alias("changed"))


def novel(contributed: DataFrame, live: DataFrame) -> DataFrame:
    """Contributed pages (url, sha) whose content no live document (url, sha, source) has, and at a variant of whose
    address no document stands whose content cannot be compared (anything that was not crawled)."""
    known = contributed.join(live.select("sha").distinct(), "sha", "left_anti")
    held = live.where("source <> 'crawl'").select(U.variant_key(F.col("url")).alias("_key")).where("_key IS NOT NULL").distinct()
    return known.withColumn("_key", U.variant_key(F.col("url"))).join(held, "_key", "left_anti").select(*contributed.columns)


def twins(docs: DataFrame) -> DataFrame:
    """Documents at an address that differs from another one's only by its variants: url, and how many share its key."""
    keyed = docs.select("doc_id", "url", U.variant_key(F.col("url")).alias("key")).where("key IS NOT NULL")
    n = keyed.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(n, F.col("key") == F.col("_k")).select("doc_id", "key", "n")


def export_rows(docs: DataFrame, include: list[str] = [], exclude: list[str] = [], since: Column | None = None, until: Column | None = None, limit: int | None = None, date: str = "published_at") -> DataFrame:
    """What an export holds: dates first (undated rows fail any bound), then domains, then the limit, by id."""
    rows = docs
    if since is not None or until is not None:
        rows = rows.where(in_window(F.col(date), since, until))
    h = U.host(F.col("url"))
    if include:
        wanted = F.lit(False)
        for d in include:
            wanted = wanted | U.in_domain(h, d)
        rows = rows.where(wanted)
    for d in exclude:
        rows = rows.where(~U.in_domain(h, d))
    return rows if limit is None else rows.orderBy("doc_id").limit(limit)


def crawl_status(frontier: DataFrame, docs: DataFrame, terms: DataFrame, now: Column) -> DataFrame:
    """One row: documents, terms, distinct hosts, pages by status, and documents fetched in the last 5, 15, 30 minutes."""
    by = frontier.agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("queued", "in_flight", "done", "error")])
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    rolling = [F.sum(((age >= 0) & (age <= s)).cast("long")).alias(f"fetched_{s}s") for s in (300, 900, 1800)]
    d = docs.agg(F.count("*").alias("n_docs"), F.countDistinct(U.host(F.col("url"))).alias("n_hosts"), *rolling)
    return d.crossJoin(F.broadcast(terms.agg(F.count("*").alias("n_terms")))).crossJoin(F.broadcast(by))


def coverage(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents with a date, passages, distinct models."""
    d = docs.agg(F.count("*").alias("n_docs"), F.count("published_at").alias("n_dated"))
    p = passages.agg(F.count("*").alias("n_passages"), F.countDistinct("model").alias("n_models"))
    return d.crossJoin(F.broadcast(p))


def drift(counters: DataFrame, rows: DataFrame) -> DataFrame:
    """Kept counters against a scan: counted minus kept, of documents and of their words."""
    scan = rows.where("doc_len > 0").agg(F.count("*").alias("_n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("_w"))
    return counters.crossJoin(F.broadcast(scan)).select((F.col("_n") - F.col("indexed_docs")).alias("docs_drift"), (F.col("_w") - F.col("sum_doc_len")).alias("words_drift"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("useful").cast("long")), F.lit(0)).alias("useful"))


def histograms(gone: DataFrame, n: int = 20) -> DataFrame:
    """What a purge takes, by host and by top-level domain: kind, name, n, the n largest of each."""
    rows = gone.select(F.explode(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("name")), F.struct(F.lit("tld").alias("kind"), U.tld(F.col("host")).alias("name")))).alias("_x")).select("_x.*")
    counted = rows.groupBy("kind", "name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counted.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def purge(docs: DataFrame, suffixes: DataFrame, keep: DataFrame, apply: bool) -> DataFrame:
    """Documents under listed suffixes but for kept ones: those that would go, or with apply those that stay."""
    hosts = docs.select(U.bare_host(F.col("url")).alias("host")).distinct()
    gone = C.without(C.under_suffixes(hosts, suffixes), C.under_suffixes(hosts, keep), "host")
    marked = docs.withColumn("host", U.bare_host(F.col("url")))
    return marked.join(gone, "host", "left_anti" if apply else "left_semi")


def prometheus(values: DataFrame, name: str, labels: list[str] = [], kind: str = "gauge", about: str = "") -> DataFrame:
    """Lines of the text format: a row per metric value (column value), with its labels."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    head = f"# HELP {name} {about}\n# TYPE {name} {kind}"
    line = F.concat(F.lit(name), F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    first = values.sparkSession.createDataFrame([(0, head)], "place int, line string")
    return first.union(values.select(F.lit(1), line))


def pruned(cache: DataFrame, now: Column, days: float) -> DataFrame:
    """Cache rows (created_at) that are young enough to stay."""
    return cache.where(F.unix_timestamp("created_at") >= F.unix_timestamp(now) - days * 86400)


def other_models(passages: DataFrame, model: str, apply: bool) -> DataFrame:
    """Passages of other models, or with apply what is left without them."""
    return passages.where(F.col("model") == model) if apply else passages.where(F.col("model") != model)


def copied(spark: SparkSession, source: str, target: str, tables: list[str], options: dict[str, str] = {}) -> dict[str, int]:
    """Copies tables from one store to another, as a migration does; rows written per table. `options` reads the source
    by JDBC (url, driver) where it names one."""
    out = {}
    for name in tables:
        df = spark.read.format("jdbc").options(dbtable=name, **options).load() if options else spark.read.parquet(f"{source}/{name}")
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        out[name] = spark.read.parquet(f"{target}/{name}").count()
    return out


def backfilled(docs: DataFrame) -> DataFrame:
    """Derived columns that older rows lack: host and content digest."""
    return docs.withColumns({"host": U.host(F.col("url")), "sha": T.digest(F.col("text"))})


def answer_report(rows: DataFrame) -> DataFrame:
    """Mean coverage and grounding of answers per strategy (strategy, coverage, grounding)."""
    g = rows.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("coverage").alias("_c"), F.avg("grounding").alias("_g"))
    return g.select("strategy", "n", F.round("_c", 6).alias("mean_coverage"), F.round("_g", 6).alias("mean_grounding"), F.round(F.col("_c") + F.col("_g"), 6).alias("combined"))


def verdict_report(rows: DataFrame) -> DataFrame:
    """Verdicts of a quick run (verdict, latency_ms): counts, whole-number rate of answers, whole mean latency."""
    count = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    known = F.col("verdict").isin("answered", "no_info", "empty")
    got = rows.agg(F.count("*").alias("queries"), count("answered").alias("answered"), count("no_info").alias("no_info"), count("empty").alias("empty"), F.sum((~known).cast("long")).alias("errors"), F.sum("latency_ms").cast("long").alias("_ms"))
    return got.select("queries", "answered", "no_info", "empty", "errors", F.floor(100 * F.col("answered") / F.col("queries")).alias("answer_rate_pct"), F.floor(F.col("_ms") / F.col("queries")).alias("avg_latency_ms"))
