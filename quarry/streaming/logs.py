"""Log and queue operators over streams: service levels, severity changes, readers, fetch deduplication, queue state,
change detection, request rates, appended logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rolling_levels(samples: DataFrame, late: str = "10 minutes", size: str = "5 minutes", step: str = "30 seconds") -> DataFrame:
    """Sliding windows per endpoint: count, errors, approximate percentiles."""
    g = samples.withWatermark("ts", late).groupBy(F.window("ts", size, step), "endpoint")
    return g.agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("errors"), F.percentile_approx("latency", F.array(F.lit(0.5), F.lit(0.95)), 1000).alias("p"))


def daily_readers(views: DataFrame, late: str = "1 day") -> DataFrame:
    """Distinct readers per article and day, by a sketch; a day is final when the watermark has passed it."""
    g = views.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "article")
    return g.agg(F.approx_count_distinct("reader").alias("readers"))


def first_fetches(fetches: DataFrame, hours: int) -> DataFrame:
    """A URL counts once in the given time."""
    return fetches.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def severity_changes(levels: DataFrame, target: float) -> DataFrame:
    """Emits a row when an endpoint's severity differs from its last one; back below the target it is 'recovered'.
    levels: endpoint, ts, value."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else "ok"
        out = []
        for ts, v in pd.concat(list(frames)).sort_values("ts")[["ts", "value"]].itertuples(index=False):
            now = "critical" if v > 1.5 * target else "warn" if v > target else "ok"
            if now != last:
                out.append((key[0], ts, last, "recovered" if now == "ok" else now))
                last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["endpoint", "ts", "before", "severity"])

    return levels.groupBy("endpoint").applyInPandasWithState(step, "endpoint string, ts timestamp, before string, severity string", "severity string", "append", GroupStateTimeout.NoTimeout)


PAGE_STATE = "status string, attempts int, last_error string, claimed_at double"
#: Status after an event, by the status before: anything else changes nothing.
MOVES = {("queued", "claim"): "in_flight", ("in_flight", "complete"): "done", ("in_flight", "fail"): "error", ("in_flight", "recover"): "queued", ("done", "enqueue"): "queued", ("error", "enqueue"): "queued"}


def queue_states(events: DataFrame, stale_seconds: int | None = None) -> DataFrame:
    """A page's state after every batch that has events of it (url, ts, seq, event, error): url, status, attempts,
    last_error. A page that is new is queued. With stale_seconds, a page in flight for longer is queued again once the
    watermark (of ts, on the events) has passed that time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, error, claimed = state.get if state.exists else ("queued", 0, None, 0.0)
        if state.hasTimedOut:
            if status == "in_flight":
                status = "queued"
        else:
            rows = pd.concat(list(frames)).sort_values(["seq", "ts"])
            for ts, event, why in rows[["ts", "event", "error"]].itertuples(index=False):
                after = MOVES.get((status, event))
                if after is None:
                    continue
                if event == "claim":
                    attempts, claimed = attempts + 1, ts.timestamp()
                error = why if event == "fail" else None if event == "complete" else error
                status = after
        state.update((status, attempts, error, claimed))
        if stale_seconds is not None and status == "in_flight":
            state.setTimeoutTimestamp(max(int((claimed + stale_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], status, attempts, error)], columns=["url", "status", "attempts", "last_error"])

    wait = GroupStateTimeout.NoTimeout if stale_seconds is None else GroupStateTimeout.EventTimeTimeout
    return events.groupBy("url").applyInPandasWithState(step, "url string, status string, attempts int, last_error string", PAGE_STATE, "update", wait)


def content_changes(fetches: DataFrame) -> DataFrame:
    """Fetches (url, ts, sha) with how often the content has changed so far and when it last did."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sha, n, at = state.get if state.exists else (None, 0, None)
        out = []
        for ts, new in pd.concat(list(frames)).sort_values("ts")[["ts", "sha"]].itertuples(index=False):
            differs = sha is not None and new != sha
            if differs:
                n, at = n + 1, ts
            sha = new
            out.append((key[0], ts, sha, n, at, differs))
        state.update((sha, n, at))
        yield pd.DataFrame(out, columns=["url", "ts", "sha", "change_count", "changed_at", "changed"])

    form = "url string, ts timestamp, sha string, change_count int, changed_at timestamp, changed boolean"
    return fetches.groupBy("url").applyInPandasWithState(step, form, "sha string, n int, at timestamp", "append", GroupStateTimeout.NoTimeout)


def token_buckets(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """Requests (client, ts) with whether a bucket of `burst` tokens, filled at `rate` a second, lets each through."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for ts in pd.concat(list(frames)).sort_values("ts")["ts"]:
            now = ts.timestamp()
            if last is not None:
                tokens = min(burst, tokens + max(now - last, 0.0) * rate)
            last = now if last is None else max(last, now)
            passes = tokens >= 1
            tokens -= passes
            out.append((key[0], ts, bool(passes)))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["client", "ts", "allowed"])

    return requests.groupBy("client").applyInPandasWithState(step, "client string, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def crawl(events: DataFrame, fetch: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """A crawl loop: each batch of claimed pages (url) is fetched and its results are written. `write` gets the batch's
    number, so that a batch that runs again can be told from a new one."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(fetch(batch), number)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_results(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's pages, postings and queue changes, each under the batch's number: a batch that runs again replaces
    what it wrote. pages: url, doc_id, title, text, ok."""
    from ..operators.index import postings

    def write(pages: DataFrame, number: int) -> None:
        pages = pages.persist()
        good = pages.where("ok")
        for name, df in (("pages", good), ("postings", postings(good)), ("queue", pages.select("url", F.when(F.col("ok"), "done").otherwise("error").alias("status")))):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        pages.unpersist()

    return write


def refresh_loop(ticks: DataFrame, due: Callable[[], DataFrame], push: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """At every batch of ticks, pushes what is due."""
    return ticks.writeStream.foreachBatch(lambda batch, _: push(due())).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def appended_log(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Events as JSON lines, by day."""
    dated = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dated.writeStream.partitionBy("day").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fresh_entries(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Rows of a cache table (key, created_at) that are still good, the newest of each key."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    w = F.max_by(F.struct(*cache.columns), "created_at").alias("_x")
    return cache.where((age >= 0) & (age <= seconds)).groupBy("key").agg(w).select("_x.*")
