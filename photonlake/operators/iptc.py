"""IPTC-IIM blocks as rows, one a dataset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import datasets
from ..sources.containers import Damaged

MOST_VALUE, MOST_BLOCK = 1 << 20, 256 << 20
UTF8 = b"\x1b%G"


def datasets_of(b: bytes, strict: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(record, dataset, value); the block ends at the first damage. If strict, datasets beyond the limits raise."""
    at, total = 0, 0
    while (at := b.find(b"\x1c", at)) >= 0 and at + 5 <= len(b):
        record, dataset, size, head = b[at + 1], b[at + 2], int.from_bytes(b[at + 3 : at + 5], "big"), 5
        if size & 0x8000:
            wide = size & 0x7FFF
            size, head = int.from_bytes(b[at + 5 : at + 5 + wide], "big"), 5 + wide
            if wide > 4:
                return
        total += size
        if strict and at + head + size <= len(b) and (size > MOST_VALUE or total > MOST_BLOCK):
            raise Damaged(f"a dataset of over {MOST_VALUE} bytes" if size > MOST_VALUE else f"a block of over {MOST_BLOCK} bytes")
        if size > MOST_VALUE or total > MOST_BLOCK or at + head + size > len(b):
            return
        if record < 10:
            yield record, dataset, b[at + head : at + head + size]
        at += head + size


def checked(b: bytes) -> None:
    """Raises where a block ends at a dataset that is beyond the limits; what stands before it is read all the same."""
    for _ in datasets_of(b, strict=True):
        pass


def iptc_datasets(facts: DataFrame) -> DataFrame:
    """A row for each dataset of the IPTC blocks of images in order; is_utf8 is the block's own."""
    return facts.where("kind = 'iptc'").select("path", "pos", F.col("space").cast("int").alias("record"), F.col("item").alias("dataset"), "value", (F.col("coding") == "UTF-8").alias("is_utf8"))


def iptc_text(value: Column, is_utf8: Column) -> Column:
    """A dataset's text: UTF-8 where the block says so, else Latin-1."""
    return F.when(is_utf8, F.try_validate_utf8(value.cast("string"))).otherwise(F.decode(value, "ISO-8859-1"))


def dataset_names(rows: DataFrame) -> DataFrame:
    """rows (record, dataset and more) with the registry's name of each dataset; the registry has under 50 rows."""
    return rows.join(F.broadcast(datasets(rows.sparkSession)), ["record", "dataset"], "left")
