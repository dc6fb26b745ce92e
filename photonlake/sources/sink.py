"""A sink of image files whose job is committed as a whole, for tables and for streams.

Tasks write into hidden folders of their own, each with an index of its files. The driver commits by collecting the
folders of the tasks that count into one and giving that its name, in place of what an earlier run of the same job or
micro-batch left. So a failed job leaves nothing, a task that ran twice counts once, and a repeated job or batch replaces
its own files alone. A commit renames a folder for each task, whatever the number of files.

    root/<job>/part-00000/<image>    root/<job>/_index/part-00000.parquet: path, target, bytes
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.edit import target_name
from .ranges import located

FORMAT = "image_sink"
INDEX = pa.schema([("path", pa.string()), ("target", pa.string()), ("bytes", pa.int64())])


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, its place among the tasks, and what is in it."""

    folder: str
    part: int
    files: int
    size: int


def task_files(batches: Iterator[pa.RecordBatch], root: str, staging: str) -> Written:
    """Writes the images (path, content) of a task into a folder of its own; rows without either are left out."""
    context = TaskContext.get()
    part = context.partitionId()
    where, base = located(root)
    folder = f"{staging}/part-{part:05d}-{context.taskAttemptId()}"
    where.create_dir(f"{base}/{folder}", recursive=True)
    rows, size = [], 0
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            path, content = path.as_py(), content.as_py()
            if path is None or content is None:
                continue
            name = target_name(path)
            with where.open_output_stream(f"{base}/{folder}/{name}", compression=None) as out:
                out.write(content)
            rows.append((path, f"part-{part:05d}/{name}", len(content)))
            size += len(content)
    index = pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(INDEX)], schema=INDEX)
    with where.open_output_stream(f"{base}/{folder}/_index") as out:
        pq.write_table(index, out)
    return Written(folder, part, len(rows), size)


def commit(root: str, staging: str, name: str, tasks: list[Written | None]) -> None:
    """Makes the folders of the tasks that count the folder of a job, in place of its earlier one."""
    where, base = located(root)
    whole = f"{base}/{staging}-whole"
    where.create_dir(f"{whole}/_index", recursive=True)
    for t in filter(None, tasks):
        where.move(f"{base}/{t.folder}/_index", f"{whole}/_index/part-{t.part:05d}.parquet")
        where.move(f"{base}/{t.folder}", f"{whole}/part-{t.part:05d}")
    old = f"{base}/{staging}-old"
    if where.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:
        where.move(f"{base}/{name}", old)
    where.move(whole, f"{base}/{name}")
    removed(root, f"{staging}-old")


def removed(root: str, folder: str) -> None:
    where, base = located(root)
    if where.get_file_info(f"{base}/{folder}").type != pafs.FileType.NotFound:
        where.delete_dir(f"{base}/{folder}")


class ImageSink(DataSource):
    """Options: path, and for tables job, the name under which a repeated write replaces its files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TableWriter(self.options["path"], self.options.get("job") or f"job-{uuid.uuid4().hex}")

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"])


class _TableWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job, self.staging = root, job, f"_staging-{job}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return task_files(iterator, self.root, self.staging)

    def commit(self, messages: list[Written | None]) -> None:
        commit(self.root, self.staging, self.job, messages)
        removed(self.root, self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        removed(self.root, self.staging)
        removed(self.root, f"{self.staging}-whole")


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return task_files(iterator, self.root, self.staging)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        commit(self.root, f"{self.staging}-{batchId}", batch_name(batchId), messages)
        removed(self.root, self.staging)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        removed(self.root, self.staging)


def batch_name(number: int) -> str:
    return f"batch-{number:08d}"


def save_images(images: DataFrame, root: str, job: str) -> None:
    """Writes images (path, content) as one committed job; a repeated job replaces its own files, others stay.

    File names are the last parts of paths with a hash of the whole path. Rows with a null path or content are left out;
    a row that raises fails the job, which then leaves no file; an empty table gives a job without files. The session
    must not name jobs alike that run at one time.
    """
    images.sparkSession.dataSource.register(ImageSink)
    images.select("path", "content").write.format(FORMAT).option("job", job).mode("append").save(root)


def saved(spark: SparkSession, root: str, job: str) -> DataFrame:
    """path, target (below the job's folder) and bytes of the files of a committed job or batch."""
    return spark.read.schema("path string, target string, bytes long").parquet(f"{root}/{job}/_index")


def save_stream(images: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Writes the images of each micro-batch of a stream, by its number, until no more have arrived.

    A batch that runs again after a failure replaces its own files with equal ones.
    """
    images.sparkSession.dataSource.register(ImageSink)
    return images.select("path", "content").writeStream.format(FORMAT).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(root)
