"""Images as rows, and their metadata segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import KINDS, Damaged
from .formats import BUILT_IN, Registry

SEGMENTS = "path string, format string, raw_exif binary, raw_iptc binary, raw_xmp binary, error string"
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "heif", "avif", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2")


def read_images(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files below a path; by extension, in either case, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return files


def with_format(images: DataFrame, registry: Registry = BUILT_IN) -> DataFrame:
    return images.withColumn("format", registry.format_column(F.col("content")))


#: The most bytes of a batch of images that goes to a Python worker; a larger image is a batch of its own.
BATCH_BYTES = 32 << 20


def bounded(images: DataFrame) -> DataFrame:
    """images, whose session sends them to Python workers in batches of bounded size, unless it is set to less."""
    spark, name = images.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    return images


#: The rows that a task has at least where rows are spread, and the tasks for each core of the session.
ROWS_A_TASK, TASKS_A_CORE = 1000, 4


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over as many tasks as keep the session's cores busy.

    A file is read in pieces that hold a row group each, so a small file of many rows is one task's, whatever is done with
    its rows. Tables of few rows are left as they are.
    """
    tasks = min(-(-rows.count() // ROWS_A_TASK), max(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    return rows.repartition(tasks) if tasks > 1 else rows


def kept_errors(rows: DataFrame, mode: str) -> DataFrame:
    """PERMISSIVE keeps images with an error, DROPMALFORMED drops them, FAILFAST raises on the first."""
    if mode == "FAILFAST":
        return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("image "), F.col("path"), F.lit(": "), F.col("error"))).cast("boolean")).otherwise(F.lit(True)))
    return rows.where("error IS NULL") if mode == "DROPMALFORMED" else rows


def opened(content: bytes | None, kind: str | None, registry: Registry = BUILT_IN, kinds: frozenset[str] = KINDS) -> tuple[dict[str, bytes], str | None]:
    """An image's payloads by kind, of the kinds asked for, and what is wrong with it."""
    if kind is None:
        return {}, f"UnsupportedFormat: {content[:12].hex()}" if content else "EmptyInput"
    found: dict[str, bytes] = {}
    try:
        for name, payload in registry.walk(kind, content, kinds):
            found[name] = payload
    except Damaged as e:
        return found if kind == "HEIF" else {}, f"Corrupt: {e}"
    return found, None


def segments(images: DataFrame, components: tuple[str, ...] = ("exif", "iptc", "xmp"), mode: str = "PERMISSIVE", registry: Registry = BUILT_IN) -> DataFrame:
    """path, format, raw_exif, raw_iptc, raw_xmp, error of images with path and content; a narrow pass.

    Components that are not asked for are null and not copied out of the images. Null and empty contents, unknown
    formats and damaged files have an error; an empty table gives no rows; further columns are ignored.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("path", pa.string()), ("format", pa.string()), *((f"raw_{c}", pa.binary()) for c in ("exif", "iptc", "xmp")), ("error", pa.string())])
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                content = content.as_py()
                kind = registry.format_of(content)
                found, error = opened(content, kind, registry)
                rows.append((path.as_py(), kind, *(found.get(c) if c in components else None for c in ("exif", "iptc", "xmp")), error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)

    return kept_errors(bounded(images.select("path", "content")).mapInArrow(walk, SEGMENTS), mode)
