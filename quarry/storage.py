"""Tables that outlive a step: the folder that driver and executors share, written tables, versions."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster in spark.checkpoint.dir. Where the setting is absent, a folder of this machine
    will do only if executors run on it: a local master. It is made once a process; the session is left as it is."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = own_folder()
    return found.rstrip("/")


@functools.lru_cache(maxsize=1)
def own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def write(df: DataFrame, tag: str, by: list[str] = [], **options: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, in directories by the columns `by`, and its path: lineage ends here,
    and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    out = df.write.options(**options)
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str, by: list[str] = [], **options: str) -> DataFrame:
    """The table of `write` alone."""
    return write(df, tag, by, **options)[0]


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it comes in so few partitions that most would idle: a file of one row group is read by
    one task, however many there are. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing will read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Versions:
    """Point-in-time versions of a table: each is an immutable directory, and a small pointer table names the current one.

    A version is visible only once its pointer is written, so a batch is applied as a whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, df: DataFrame) -> int:
        number = self.latest() + 1
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        self.spark.createDataFrame([(number, name)], "version int, name string").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return number

    def pointers(self) -> list[tuple[int, str]]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return []
        return sorted((r[0], r[1]) for r in self.spark.read.schema("version int, name string").parquet(f"{self.path}/pointer").collect())

    def latest(self) -> int:
        found = self.pointers()
        return found[-1][0] if found else 0

    def read(self, version: int | None = None) -> DataFrame:
        names = dict(self.pointers())
        return self.spark.read.parquet(f"{self.path}/data/{names[version or max(names)]}")
