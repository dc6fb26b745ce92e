"""Images that keep arriving: a stream of files, their records by micro-batch, and windows over capture times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metadata import flat_metadata
from ..sources.images import TASKS_A_CORE

#: Files that wait in the driver's memory for later micro-batches.
MOST_WAITING = 1_000_000
IMAGES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, path: str, files_a_batch: int = 10_000) -> DataFrame:
    """A stream of the files that arrive below a path.

    Files that a listing finds beyond a micro-batch's wait for the next ones, so that not each lists the path again. A
    micro-batch looks up its own files in a task for each of them, but for a setting that is lowered for the session.
    """
    name, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", TASKS_A_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(name, min(int(spark.conf.get(name)), tasks))
    source = spark.readStream.format("binaryFile").schema(IMAGES).option("recursiveFileLookup", "true")
    return source.option("maxFilesPerTrigger", files_a_batch).option("maxCachedFiles", MOST_WAITING).load(path)


def catalogue(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes the records of every micro-batch to its own partition of a table; a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        flat_metadata(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Images by window of capture time and format, once no image of the window can come any more.

    The watermark is the latest capture time less the allowance. An image that was captured before it is late and left
    out; one that arrives again under its path counts once. Images without a capture time are left out. A window comes
    out when the watermark has passed its end; state is kept for windows and paths that the watermark hasn't passed.
    """
    taken = flat_metadata(stream, columns=("path", "format", "captured_at")).where("captured_at IS NOT NULL")
    once = taken.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["path"])
    return once.groupBy(F.window("captured_at", window).alias("w"), "format").count().select(F.col("w.start").alias("start"), "format", F.col("count").alias("images"))


def save_counts(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the windows that close to a table, until no more images have arrived."""
    return counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def late_images(query: StreamingQuery) -> int:
    """How many images the query's recent micro-batches left out as late: rows that came to the first state too old."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in map(dict, p["stateOperators"]) if o["operatorName"] == "dedupeWithinWatermark")
