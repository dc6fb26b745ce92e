"""Committed jobs of image files, and streams that write each micro-batch once."""

import os
import time

import pytest
from pyspark.sql import functions as F

from photonlake.operators.edit import edit_metadata
from photonlake.operators.metadata import flat_metadata
from photonlake.sources.images import read_images
from photonlake.sources.sink import batch_name, save_images, save_stream, saved
from photonlake.streaming.images import stream_images

from .test_edges import jpeg, little


def images(spark, n, tag="A"):
    rows = [(f"/d{k % 3}/i{k}.jpg", jpeg(little([(0x0110, 2, 3, tag.encode() + b"1\0\0"), (0x0112, 3, 1, bytes((k % 8 + 1, 0, 0, 0)))]))) for k in range(n)]
    return spark.createDataFrame(rows, "path string, content binary").repartition(6)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if f.endswith(".jpg")}


def test_a_job_is_there_as_a_whole(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = images(spark, 40).unionByName(spark.createDataFrame([(None, b"x"), ("null.jpg", None)], "path string, content binary"))
    save_images(rows, root, "first")
    own = files(tmp_path / "out")
    assert len(own) == 40 and not [f for f in os.listdir(tmp_path / "out") if f.startswith("_")]
    index = saved(spark, root, "first").collect()
    assert {r.path for r in index} == {r.path for r in images(spark, 40).collect()} and all(len(own[f"first/{r.target}"]) == r.bytes for r in index)
    assert read_images(spark, root).count() == 40
    save_images(images(spark, 10, "B"), root, "second")
    save_images(images(spark, 5, "C"), root, "first")  # in place of its own 40 files
    assert len(files(tmp_path / "out")) == 15 and saved(spark, root, "first").count() == 5
    save_images(images(spark, 1).limit(0), root, "first")
    assert len(files(tmp_path / "out")) == 10 and saved(spark, root, "first").count() == 0


def test_a_task_that_is_killed_midway_leaves_no_file(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    save_images(images(spark, 12), root, "job")
    before = files(tmp_path / "out")

    def failing(batches):
        for batch in batches:
            if any(p.as_py() == "/d0/i27.jpg" for p in batch.column("path")):
                time.sleep(2)  # others are done by then
                os._exit(1)
            yield batch

    with pytest.raises(Exception):
        save_images(images(spark, 60, "Z").mapInArrow(failing, "path string, content binary"), root, "job")
    time.sleep(1)
    assert files(tmp_path / "out") == before
    save_images(images(spark, 60, "Z"), root, "job")
    assert len(files(tmp_path / "out")) == 60


def stamped(spark, source, limit=4):
    stream = stream_images(spark, source, limit)
    return edit_metadata(stream, {"camera_model": F.concat(F.lit("by "), F.substring_index("path", "/", -1))})


def test_a_stream_edits_and_writes_each_batch_once(spark, tmp_path):
    source, root, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    source.mkdir()
    for k, r in enumerate(images(spark, 10).orderBy("path").collect()):
        (source / f"{k}.jpg").write_bytes(r.content)
        os.utime(source / f"{k}.jpg", (1_000_000 + k, 1_000_000 + k))
    save_stream(stamped(spark, f"file://{source}"), f"file://{root}", f"file://{checkpoint}").awaitTermination()
    first = files(root)
    assert len(first) == 10 and {n.split("/")[0] for n in first} == {batch_name(0), batch_name(1), batch_name(2)}
    models = flat_metadata(read_images(spark, f"file://{root}")).select("model").collect()
    assert {r.model for r in models} == {f"by {k}.jpg" for k in range(10)}
    os.remove(checkpoint / "commits" / "2")  # as if the driver was lost after the files, before the commit
    if (checkpoint / "commits" / ".2.crc").exists():
        os.remove(checkpoint / "commits" / ".2.crc")
    (root / batch_name(2) / "part-00000" / "left.jpg").write_bytes(b"from the lost run")
    save_stream(stamped(spark, f"file://{source}"), f"file://{root}", f"file://{checkpoint}").awaitTermination()
    assert files(root) == first
    (source / "late.jpg").write_bytes((source / "3.jpg").read_bytes())
    save_stream(stamped(spark, f"file://{source}"), f"file://{root}", f"file://{checkpoint}").awaitTermination()
    again = files(root)
    assert len(again) == 11 and {n: again[n] for n in first} == first and [n for n in again if n not in first][0].startswith(batch_name(3))
