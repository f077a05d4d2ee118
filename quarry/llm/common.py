"""What the operators share: session settings, whole-text batches, labelled samples."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, written  # noqa: F401 - operators take them from here

#: Rows per Arrow batch: 500 texts of the longest kind seen (about 120 KB) stay under 64 MB.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on.

    Arrow batches are bounded in rows, so that a batch of very long texts fits a Python worker. Shuffle files go when
    the job that made them ends: each step's result is a written table, so nothing reads them later.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of jobs whose results are already written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts as Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def documents_schema(df: DataFrame):
    """The schema of df with every column nullable, as Arrow stages return it."""
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def rows_batch(rows: list[tuple], form: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of a flat schema string, where no session can read it: in workers."""
    fields = [f.split(" ") for f in form.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ARROW[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to one batch (or a dict of its columns)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = make(b)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
                yield out

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of text that a sample for fitting may hold.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most `rows` (text, label) pairs of at most `most_bytes` together for fitting, none of them held out; both
    bounds are parameters.

    The rows with the smallest xxhash64(doc_id) are taken, so the sample is the same on every run; rows without a
    label or id are skipped, as are texts that the bytes left do not suffice for. Of rows that repeat an id the least
    text counts, found before anything is collected; of repeated labels the least.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    y = y.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = [(r[0], r[1]) for r in y.orderBy(F.xxhash64("_id"), "_id").limit(rows).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_t"))

    def texts_of(ids: list[int]) -> DataFrame:
        small = spark.createDataFrame([(i,) for i in ids], "_id long")
        return d.join(F.broadcast(small), "_id").groupBy("_id").agg(F.min("_t").alias("_t"))

    size = {r[0]: r[1] for r in texts_of([i for i, _ in chosen]).select("_id", F.octet_length("_t")).collect()}
    taken, left = [], most_bytes
    for i, v in chosen:
        if i in size and size[i] <= left:
            left -= size[i]
            taken.append((i, v))
    if not taken:
        return []
    text = {r[0]: r[1] for r in texts_of([i for i, _ in taken]).collect()}
    return [(text[i], v) for i, v in sorted(taken)]
