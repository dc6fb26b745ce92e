"""What the operators share: the shared folder, staged tables, files of executors, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space and the ASCII letters that the text contracts name.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="photonlake-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder of its own below the shared one; tables staged there cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/photonlake/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
        """Writes df once and returns the written table."""
        writer = df.write.mode("overwrite").option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes staged tables that no later plan reads."""
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        """Removes the whole folder, once nothing in it is read any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The most bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
Batches = Iterator[pa.RecordBatch]
#: What a worker process keeps from batch to batch of a task, by name.
CACHES: dict[str, dict] = {}


def lean(function: Callable[[Batches], Batches], keep: str | None = None) -> Callable[[Batches], Batches]:
    """function, with whose tasks a worker's memory goes back to the system.

    Spark uses a worker process for many tasks and stages, and what one of them leaves there is missing to the others:
    cached words, Arrow's pool and free memory that the allocator holds on to. The cache named keep outlives its task,
    for further tasks of its kind in the same worker; the next task of another kind empties it.
    """

    def run(batches: Batches) -> Batches:
        emptied(keep)
        try:
            yield from function(batches)
        finally:
            emptied(keep)

    return run


def emptied(keep: str | None) -> None:
    for name, cache in CACHES.items():
        if name != keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, function: Callable[[Batches], Batches], schema, keep: str | None = None) -> DataFrame:
    """df.mapInArrow(function), in batches of bounded size and with lean workers."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(lean(function, keep), schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, on whichever machine this runs."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when whole; a repeated task replaces it with equal bytes."""

    def __init__(self, uri: str):
        self.fs, self.final = filesystem(uri)
        self.fs.create_dir(self.final.rpartition("/")[0], recursive=True)
        self.partial = f"{self.final}.{uuid.uuid4().hex}.partial"
        self.stream = self.fs.open_output_stream(self.partial, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.partial, self.final)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a plain reuse would repeat its expression in each place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)
