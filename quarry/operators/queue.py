"""The crawl queue as a table: claims, results, recovery, sweeps. Columns: url, host, lane, priority, enqueued_at,
attempts, status, last_error, claimed_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import urls as U
from .ops import host_fair, lane_order

EVENTS = ["claim", "complete", "fail", "recover"]


def claimed(frontier: DataFrame, n: int, now: Column) -> DataFrame:
    """The n pages that are fetched next, hosts in flight last, one page of each host a round: url, claimed_at."""
    order = host_fair(frontier).join(frontier.select("url", "priority", "enqueued_at"), "url")
    return order.orderBy("busy", "turn", F.desc("priority"), "enqueued_at", "url").limit(n).select("url", now.alias("claimed_at"))


def claimed_by_lane(frontier: DataFrame, n: int) -> DataFrame:
    """The n pages that the lanes' shares bring up next."""
    return lane_order(frontier).orderBy("slot", "lane", "url").limit(n).select("url", "lane")


def after_events(frontier: DataFrame, events: DataFrame) -> DataFrame:
    """The queue after events (url, seq, event, error): a page's events apply in the order of seq. A claim counts as an
    attempt; a page that fails is an error; recovery puts a page in flight back."""
    order = F.array_sort(F.collect_list(F.struct("seq", "event", "error")))
    lists = events.groupBy(F.col("url").alias("_u")).agg(order.alias("_e"))
    start = F.struct(F.col("status").alias("status"), F.col("attempts").cast("int").alias("attempts"), F.col("last_error").alias("last_error"))

    def step(s: Column, e: Column) -> Column:
        kind = e["event"]
        claim, flies = (kind == "claim") & (s["status"] == "queued"), s["status"] == "in_flight"
        status = F.when(claim, "in_flight").when((kind == "complete") & flies, "done").when((kind == "fail") & flies, "error").when((kind == "recover") & flies, "queued").otherwise(s["status"])
        error = F.when((kind == "fail") & flies, e["error"]).when((kind == "complete") & flies, F.lit(None).cast("string")).otherwise(s["last_error"])
        return F.struct(status.alias("status"), (s["attempts"] + claim.cast("int")).cast("int").alias("attempts"), error.alias("last_error"))

    none = F.array().cast("array<struct<seq:bigint,event:string,error:string>>")
    j = frontier.join(lists.withColumn("_e", F.col("_e").cast("array<struct<seq:bigint,event:string,error:string>>")), F.col("url") == F.col("_u"), "left")
    s = j.withColumn("_s", F.aggregate(F.coalesce("_e", none), start, step))
    rest = [c for c in frontier.columns if c not in ("status", "attempts", "last_error")]
    return s.select(*rest, "_s.status", "_s.attempts", "_s.last_error")


def recovered(frontier: DataFrame) -> DataFrame:
    """After a stop: nothing is in flight any more."""
    return frontier.withColumn("status", F.when(F.col("status") == "in_flight", "queued").otherwise(F.col("status")))


def without_stale(frontier: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Pages that have been in flight for too long are queued again."""
    stale = (F.col("status") == "in_flight") & (F.unix_timestamp(now) - F.unix_timestamp("claimed_at") > seconds)
    return frontier.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def collected(frontier: DataFrame, most_attempts: int, now: Column, done_seconds: int) -> DataFrame:
    """Without pages that failed too often and without pages done long ago."""
    dead = (F.col("status") == "error") & (F.col("attempts") >= most_attempts)
    old = (F.col("status") == "done") & (F.unix_timestamp(now) - F.unix_timestamp("enqueued_at") > done_seconds)
    return frontier.where(~(dead | F.coalesce(old, F.lit(False))))


def swept(frontier: DataFrame, actions: DataFrame) -> DataFrame:
    """After a sweep of hosts (host, action): queued pages of purged hosts go, those of demoted ones move to the last lane."""
    a = actions.select(F.col("host").alias("_h"), "action")
    j = frontier.join(a, F.col("host") == F.col("_h"), "left")
    queued = F.col("status") == "queued"
    kept = j.where(~(queued & (F.coalesce("action", F.lit("keep")) == "purge")))
    lane = F.when(queued & (F.col("action") == "demote"), 3).otherwise(F.col("lane"))
    return kept.withColumn("lane", lane.cast("int")).select(*frontier.columns)


def blocked(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows whose host is not on a list."""
    return rows.join(hosts.select("host").distinct(), "host", "left_anti")


def errors(frontier: DataFrame, limit: int) -> DataFrame:
    """Pages that failed, the last enqueued first."""
    return frontier.where("status = 'error'").orderBy(F.desc("enqueued_at"), "url").limit(limit).select("url", "last_error", "attempts")


def depth(frontier: DataFrame, hosts: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Queued pages per host: of listed hosts, or the n longest queues."""
    queued = frontier.where("status = 'queued'")
    if hosts is not None:
        queued = queued.where(F.col("host").isin(hosts))
    counted = queued.groupBy("host").agg(F.count("*").alias("n"))
    return counted if n is None else counted.orderBy(F.desc("n"), "host").limit(n)


def seeded(frontier: DataFrame, hosts: DataFrame, now: Column, lane: int = 2, scheme: str = "https") -> DataFrame:
    """The queue and the front pages of ranked hosts (host, rank) that it does not have, better ranks first."""
    url = F.concat(F.lit(f"{scheme}://"), F.col("host"), F.lit("/"))
    new = hosts.select(url.alias("url"), "host", F.lit(lane).alias("lane"), (1.0 / (1 + F.log10(F.greatest("rank", F.lit(1))))).alias("priority"), now.alias("enqueued_at"), F.lit(0).alias("attempts"), F.lit("queued").alias("status"))
    new = new.dropDuplicates(["url"]).join(frontier.select("url"), "url", "left_anti")
    return frontier.unionByName(new, allowMissingColumns=True)


def links_queued(frontier: DataFrame, links: DataFrame, now: Column, host_cap: int, base: float = 1.0) -> DataFrame:
    """Links of a crawled page (url, depth) that the queue does not have, with a priority that falls with depth, and no
    more of a host than the cap leaves."""
    new = links.groupBy(U.canonical(F.col("url")).alias("url")).agg(F.min("depth").alias("depth")).where("url IS NOT NULL").join(frontier.select("url"), "url", "left_anti")
    new = new.withColumn("host", U.host(F.col("url"))).withColumn("priority", F.round(S.link_priority(F.lit(base), F.col("depth")), 6))
    have = frontier.where("status = 'queued'").groupBy(F.col("host").alias("_h")).agg(F.count("*").alias("_have"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "url"))
    return new.withColumn("_turn", turn).join(have, F.col("host") == F.col("_h"), "left").where(F.col("_turn") + F.coalesce("_have", F.lit(0)) <= host_cap).select("url", "host", "depth", "priority", now.alias("enqueued_at"))


def recrawled(frontier: DataFrame, docs: DataFrame, domain: str, now: Column, most: int = 10_000) -> DataFrame:
    """Stored pages of a domain that are queued again, the longest unfetched first: url, host, enqueued_at."""
    h = U.host(F.col("url"))
    busy = frontier.where("status IN ('queued', 'in_flight')").select("url")
    return docs.where(U.in_domain(h, domain)).join(busy, "url", "left_anti").orderBy("fetched_at", "url").limit(most).select("url", h.alias("host"), now.alias("enqueued_at"))
