"""Crawl queue, refresh planning, logs, service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

# Shares of the four lanes.
LANE_WEIGHTS = {0: 50, 1: 30, 2: 15, 3: 5}


def host_fair(frontier: DataFrame) -> DataFrame:
    """Claim order: hosts with nothing in flight first, then one page of each host per round, by priority and age."""
    busy = frontier.where("status = 'in_flight'").select(F.col("host").alias("_h")).distinct().withColumn("busy", F.lit(1))
    queued = frontier.where("status = 'queued'").join(busy, F.col("host") == F.col("_h"), "left").withColumn("busy", F.coalesce("busy", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "enqueued_at", "url"))
    return queued.withColumn("turn", turn).select("url", "host", "busy", "turn")


#: Buckets that rows of one group are ranked in at most.
RANK_BUCKETS = 64


def numbered(rows: DataFrame, group: list[str], order: list, leading: Column, name: str) -> DataFrame:
    """Rows numbered within their group without gathering a group in one task: rows are dealt to ranges of `leading`
    (numeric, ascending with the order), counted per range, and numbered inside it. Ties of `leading` stay together, so a
    range is as large as its most common value at least."""
    cuts = rows.groupBy(*group).agg(F.array_distinct(F.percentile_approx(leading, F.array(*[F.lit(k / RANK_BUCKETS) for k in range(1, RANK_BUCKETS)]), 10_000)).alias("_cuts"))
    keyed = rows.join(F.broadcast(cuts), group) if group else rows.crossJoin(F.broadcast(cuts))
    keyed = keyed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < leading))).drop("_cuts")
    sizes = keyed.groupBy(*group, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*group, "_range", before.alias("_before"))
    here = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return keyed.withColumn("_here", here).join(F.broadcast(offsets), [*group, "_range"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_here", "_before", "_range")


def lane_order(frontier: DataFrame) -> DataFrame:
    """Virtual time of each queued page: its number in its lane over the lane's share."""
    weight = F.create_map(*[F.lit(x) for kv in LANE_WEIGHTS.items() for x in kv])
    queued = numbered(frontier.where("status = 'queued'"), ["lane"], [F.desc("priority"), "enqueued_at", "url"], -F.col("priority"), "_n")
    return queued.withColumn("slot", F.round(F.col("_n") / weight[F.col("lane")], 6)).select("url", "lane", "slot")


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("lane", "status").agg(F.count("*").alias("n"))


def host_health(fetches: DataFrame, least: int, dead: float, weak: float) -> DataFrame:
    """Hosts with enough attempts by success rate: purge, demote or keep."""
    g = fetches.groupBy("host").agg(F.count("*").alias("attempts"), F.avg(F.col("ok").cast("double")).alias("_r")).where(F.col("attempts") >= least)
    return g.select("host", "attempts", F.round("_r", 6).alias("rate"), F.when(F.col("_r") < dead, "purge").when(F.col("_r") < weak, "demote").otherwise("keep").alias("action"))


def refresh_due(docs: DataFrame, now: Column, least: float, most: float, limit: int | None = None) -> DataFrame:
    """Documents whose refresh interval has passed, the longest unfetched first. Columns: doc_id, fetched_at, changed_at."""
    days = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000.0
    interval = S.refresh_days(days(now, F.col("changed_at")), least, most)
    due = docs.withColumn("interval_days", F.round(interval, 6)).where(days(now, F.col("fetched_at")) >= interval)
    due = due.orderBy("fetched_at", "doc_id") if limit is None else due.orderBy("fetched_at", "doc_id").limit(limit)
    return due.select("doc_id", "interval_days")


def value_at(rows: DataFrame, column: str, shares: list[float], place, group: list[str] = [], ranges: bool = True) -> DataFrame:
    """The value at a place of each group's sorted values, for each share: columns p50, p95, ... `place` gives the place,
    from 0, of (count, share). Equal values are counted first, so a group takes a row per distinct value. With ranges,
    running counts go through ranges of values, so no group is gathered in one task: for few, large groups. Without, a
    group's distinct values stream through one task in order: for many groups."""
    counts = rows.groupBy(*group, column).agg(F.count("*").alias("_c"))
    cell = lambda p: F.min(F.when(F.col("_upto") > place(F.col("_n"), p), F.col(column))).alias(f"p{round(p * 100)}")
    upto = lambda by: F.sum("_c").over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    if not ranges:
        ran = counts.withColumns({"_upto": upto(group), "_n": F.sum("_c").over(Window.partitionBy(*group))})
        return ran.groupBy(*group).agg(*[cell(p) for p in shares])
    cuts = counts.groupBy(*group).agg(F.sum("_c").alias("_n"), F.array_distinct(F.percentile_approx(column, F.array(*[F.lit(k / RANK_BUCKETS) for k in range(1, RANK_BUCKETS)]), 10_000)).alias("_cuts"))
    keyed = counts.join(cuts, group) if group else counts.crossJoin(F.broadcast(cuts))
    keyed = keyed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    sizes = keyed.groupBy(*group, "_range").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*group, "_range", before.alias("_before"))
    ran = keyed.withColumn("_upto", upto([*group, "_range"])).join(offsets, [*group, "_range"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    return ran.groupBy(*group).agg(*[cell(p) for p in shares])


def percentiles(rows: DataFrame, column: str, shares: list[float], group: list[str] = [], ranges: bool = True) -> DataFrame:
    """Exact: the value at floor((n - 1) p)."""
    return value_at(rows, column, shares, lambda n, p: F.floor((n - 1) * p), group, ranges)


def service_levels(samples: DataFrame, window: str, exact: bool = True) -> DataFrame:
    """Counts, error rate and percentiles per endpoint and window; exact=False takes a bounded sketch of values."""
    s = samples.select(F.window("ts", window)["start"].alias("window_start"), "endpoint", "latency", "ok")
    key = ["window_start", "endpoint"]
    rates = [F.count("*").alias("n"), F.round(F.avg((~F.col("ok")).cast("double")), 6).alias("error_rate")]
    shares = [0.5, 0.95, 0.99]
    if not exact:
        rates += [F.percentile_approx("latency", p, 10_000).alias(f"p{round(p * 100)}") for p in shares]
        return s.groupBy(*key).agg(*rates)
    return s.groupBy(*key).agg(*rates).join(percentiles(s, "latency", shares, key, ranges=False), key).select(*key, "n", "error_rate", "p50", "p95", "p99")


def transitions(levels: DataFrame, metric: str, target: float) -> DataFrame:
    """Changes of severity only: warn over the target, critical over one and a half of it, recovered when a warned or
    critical endpoint meets it again."""
    v = F.col(metric)
    severity = F.when(v > 1.5 * target, "critical").when(v > target, "warn").otherwise("ok")
    before = F.lag("_now", 1, "ok").over(Window.partitionBy("endpoint").orderBy("window_start"))
    changed = levels.withColumn("_now", severity).withColumn("before", before).where("_now <> before")
    return changed.select("endpoint", "window_start", "before", F.when(F.col("_now") == "ok", "recovered").otherwise(F.col("_now")).alias("severity"))


def feedback_by_query(ratings: DataFrame, log: DataFrame) -> DataFrame:
    """Ratings per query text of the log, whatever its case."""
    j = ratings.join(log.select(F.col("qid").alias("_q"), "query"), F.col("qid") == F.col("_q"))
    r = F.col("rating")
    return j.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("n"), F.sum((r > 0).cast("long")).alias("up"), F.sum((r < 0).cast("long")).alias("down"), F.sum(r.cast("long")).alias("net"))


def disliked(tallies: DataFrame) -> DataFrame:
    """Those with more ratings down than up, the worst first."""
    return tallies.where("net < 0").orderBy("net", "query")


def feedback(ratings: DataFrame, log: DataFrame) -> DataFrame:
    """Ratings per endpoint of the query log; ratings of unlogged queries go to '(unknown)'."""
    j = ratings.join(log.select(F.col("qid").alias("_q"), "endpoint"), F.col("qid") == F.col("_q"), "left")
    r = F.col("rating")
    return j.groupBy(F.coalesce("endpoint", F.lit("(unknown)")).alias("endpoint")).agg(
        F.count("*").alias("n"), F.sum((r > 0).cast("long")).alias("up"), F.sum((r < 0).cast("long")).alias("down"), F.sum(r.cast("long")).alias("net")
    )


def readers(views: DataFrame) -> DataFrame:
    """Distinct readers per article and UTC day."""
    return views.groupBy("article", F.to_date("ts").alias("day")).agg(F.countDistinct("reader").alias("readers"))


def recent_days(daily: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """Daily counts that are still held."""
    return daily.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))


def readers_week(daily: DataFrame) -> DataFrame:
    """Sum of the daily counts of seven days up to each day."""
    w = Window.partitionBy("article").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.withColumn("readers_7d", F.sum("readers").over(w))


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts per upper bound."""
    v = F.col(column)
    cells = [F.struct(F.lit(float(b)).alias("le"), F.sum((v <= b).cast("long")).alias("n")) for b in bounds]
    return values.agg(F.array(*cells).alias("_a")).select(F.explode("_a").alias("_x")).select("_x.le", "_x.n")
