"""Writers: exports, sitemaps, streams of events as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMS = ("json", "jsonl", "text", "md", "csv", "parquet")


def headed(form: str) -> Column:
    """A document as text under its title and address."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    if form == "md":
        return F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("url"), F.lit("\n\n"), body, F.lit("\n\n---"))
    return F.concat(F.when(title != "", F.concat(F.lit("Title: "), title, F.lit("\n"))).otherwise(""), F.lit("URL: "), F.col("url"), F.lit("\n\n"), body, F.lit("\n---"))


def export(docs: DataFrame, path: str, form: str = "jsonl") -> None:
    """json (one file {docs: [...]}, written by one task as rows stream by), jsonl, text, md, csv or parquet."""
    if form not in FORMS:
        raise ValueError(f"{form} is none of {', '.join(FORMS)}")
    w = docs.write.mode("overwrite")
    if form == "jsonl":
        w.json(path)
    elif form in ("csv", "parquet"):
        w.options(header=True).format(form).save(path)
    elif form == "json":
        one = docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).coalesce(1)
        one.mapInArrow(listed, "value string").write.mode("overwrite").text(path)
    else:
        docs.select(headed(form).alias("value")).write.mode("overwrite").text(path)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of JSON as the lines of one document."""
    first = True
    for b in batches:
        rows = b.column(0).to_pylist()
        lines = [('{"docs": [' if first and k == 0 else ",") + r for k, r in enumerate(rows)]
        if lines:
            first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(['{"docs": []}' if first else "]}"])], ["value"])


def sitemap_lines(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """<url> elements of the first documents by id; the format allows no more in one file."""
    safe = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return docs.orderBy("doc_id").limit(most).select("doc_id", F.concat(F.lit("<url><loc>"), safe, F.lit("</loc></url>")).alias("line"))


def event_lines(events: DataFrame) -> DataFrame:
    """Server-sent events (place, event, data) as text: an event line, its data line by line, a blank line."""
    data = F.concat_ws("\n", F.transform(F.split("data", "\n"), lambda x: F.concat(F.lit("data: "), x)))
    return events.select("place", F.concat(F.lit("event: "), F.col("event"), F.lit("\n"), data, F.lit("\n\n")).alias("value"))
