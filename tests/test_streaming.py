"""Streams over files in small batches, against what one pass over all rows gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.streaming import logs

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of batches of rows: one file each, read in order."""

    def make(batches, schema):
        folder = tmp_path / "in"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def run(spark, df, mode="append"):
    name = f"out_{abs(hash(df))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_severities_recover(spark, stream):
    s = stream([[("a", at(0), 5.0), ("a", at(1), 11.0)], [("a", at(2), 12.0), ("a", at(3), 16.0)], [("a", at(4), 1.0), ("b", at(5), 1.0)]], "endpoint string, ts timestamp, value double")
    got = [(r.endpoint, r.before, r.severity) for r in sorted(run(spark, logs.severity_changes(s, 10.0)), key=lambda r: r.ts)]
    assert got == [("a", "ok", "warn"), ("a", "warn", "critical"), ("a", "critical", "recovered")]


def test_queue_states(spark, stream):
    s = stream([[("u", at(0), 1, "claim", None), ("v", at(0), 1, "complete", None)], [("u", at(1), 2, "fail", "why")], [("u", at(2), 3, "enqueue", None), ("u", at(3), 4, "claim", None), ("u", at(4), 5, "complete", None)]], "url string, ts timestamp, seq int, event string, error string")
    rows = run(spark, logs.queue_states(s), "update")
    assert [(r.status, r.attempts, r.last_error) for r in rows if r.url == "u"] == [("in_flight", 1, None), ("error", 1, "why"), ("done", 2, None)]
    assert [(r.status, r.attempts) for r in rows if r.url == "v"] == [("queued", 0)]


def test_stale_claims_go_back(spark, stream):
    s = stream([[("u", at(0), 1, "claim", None)], [("w", at(500), 1, "claim", None)], [("w", at(501), 2, "complete", None)]], "url string, ts timestamp, seq int, event string, error string").withWatermark("ts", "0 seconds")
    rows = run(spark, logs.queue_states(s, 60), "update")
    assert [r.status for r in rows if r.url == "u"] == ["in_flight", "queued"]


def test_content_changes(spark, stream):
    s = stream([[("u", at(0), "a")], [("u", at(1), "a"), ("u", at(2), "b")], [("u", at(3), "a")]], "url string, ts timestamp, sha string")
    got = [(r.change_count, r.changed) for r in sorted(run(spark, logs.content_changes(s)), key=lambda r: r.ts)]
    assert got == [(0, False), (0, False), (1, True), (2, True)]


def test_token_buckets(spark, stream):
    s = stream([[("c", at(0)), ("c", at(0.1)), ("c", at(0.2))], [("c", at(1.3)), ("d", at(1.3))]], "client string, ts timestamp")
    got = {c: [r.allowed for r in sorted((x for x in rows if x.client == c), key=lambda r: r.ts)] for rows in [run(spark, logs.token_buckets(s, 1.0, 2.0))] for c in "cd"}
    assert got == {"c": [True, True, False, True], "d": [True]}


def test_windows_and_first_fetches(spark, stream, tmp_path):
    rows = [[("e", at(10 * k), float(k), k % 4 != 0, f"u{k % 5}") for k in range(40)], [("e", at(9000), 1.0, True, "late")]]
    s = stream(rows, "endpoint string, ts timestamp, latency double, ok boolean, url string")
    levels = run(spark, logs.rolling_levels(s, late="1 minute"))
    full = [r for r in levels if r.window.start == T0]
    assert full and full[0].n == 30 and full[0].errors == 8
    assert len(run(spark, logs.first_fetches(s.select("url", "ts"), 1))) == 6
    day = run(spark, logs.daily_readers(s.select(F.col("endpoint").alias("article"), "ts", F.col("url").alias("reader")), "1 hour"), "complete")
    assert [r.readers for r in day] == [6]


def test_crawl_writes_by_batch(spark, stream, tmp_path):
    s = stream([[("u1",), ("u2",)], [("u3",)]], "url string")

    def fetch(batch):
        i = F.substring("url", 2, 9).cast("long")
        return batch.select("url", i.alias("doc_id"), F.lit("").alias("title"), F.concat(F.lit("lamp "), "url").alias("text"), (i != 2).alias("ok"))

    write = logs.write_results(str(tmp_path / "out"))
    q = logs.crawl(s, fetch, write, str(tmp_path / "check"))
    q.awaitTermination()
    assert {r.url for r in spark.read.parquet(str(tmp_path / "out" / "pages")).collect()} == {"u1", "u3"}
    assert {(r.url, r.status) for r in spark.read.parquet(str(tmp_path / "out" / "queue")).collect()} == {("u1", "done"), ("u2", "error"), ("u3", "done")}
    assert spark.read.parquet(str(tmp_path / "out" / "postings")).where("term = 'lamp'").count() == 2


def test_logs_are_appended_and_refreshes_pushed(spark, stream, tmp_path):
    s = stream([[("q1", at(0))], [("q2", at(90_000))]], "qid string, ts timestamp")
    logs.appended_log(s, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.schema("qid string, ts timestamp, day string").json(str(tmp_path / "log"))
    assert {(r.qid, str(r.day)) for r in got.collect()} == {("q1", "2024-01-01"), ("q2", "2024-01-02")}
    pushed = []
    logs.refresh_loop(s, lambda: spark.range(2), lambda df: pushed.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert pushed == [2, 2]


def test_cache_entries_expire(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    rows = spark.createDataFrame([("a", at(0), "old"), ("a", at(3000), "new"), ("b", at(-9000), "gone"), ("c", at(9999), "ahead")], "key string, created_at timestamp, value string")
    assert [(r.key, r.value) for r in logs.fresh_entries(rows, now, 3600).collect()] == [("a", "new")]
