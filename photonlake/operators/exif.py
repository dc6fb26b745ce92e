"""EXIF segments as rows, one an entry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import tags
from ..sources.containers import directory

#: Tags that point to a further directory.
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}


def directories(b: bytes, tags_wanted: frozenset[int] | None = None) -> Iterator[tuple[str, int, int, int, int, bytes, str]]:
    """(directory, number in its chain, tag, type, count, value, byte order) of a TIFF block's entries.

    Directories that point back to one already read end their chain; one that cannot be read has no entries. If tags are
    wanted, their entries are read and what leads to further directories, and the chain of first directories isn't.
    """
    order = {b"II": "little", b"MM": "big"}.get(b[:2])
    if len(b) < 8 or not order or int.from_bytes(b[2:4], order) != 42:
        return
    open_, seen, mark = [("ifd0", 0, int.from_bytes(b[4:8], order))], set(), b[:2].decode()
    tags_read = None if tags_wanted is None else tags_wanted | POINTERS.keys()
    while open_:
        name, k, at = open_.pop(0)
        if at in seen:
            continue
        seen.add(at)
        entries, after = directory(b, order, at, tags_read)
        for tag, kind, count, value in entries:
            yield name, k, tag, kind, count, value, mark
            if tag in POINTERS and len(value) == 4 and k == 0 and (name, tag) != ("exif", 0x8769):
                open_.append((POINTERS[tag], 0, int.from_bytes(value, order)))
        if after and name == "ifd0" and tags_wanted is None:
            open_.append((name, k + 1, after))


def exif_entries(facts: DataFrame) -> DataFrame:
    """A row for each entry of the EXIF directories of images, MakerNotes that are directories (ifd maker) included."""
    return facts.where("kind = 'exif'").select("path", F.col("space").alias("ifd"), F.col("pos").alias("chain_idx"), F.col("item").alias("tag"), "type", "count", "value", F.col("coding").alias("byte_order"))


def named(entries: DataFrame) -> DataFrame:
    """entries with the registry's name of each tag, null for unknown ones; the registry has under 200 rows."""
    family = F.when(F.col("ifd") == "gps", "gps").when(F.col("ifd") == "maker", "maker").otherwise("exif")
    return entries.withColumn("family", family).join(F.broadcast(tags(entries.sparkSession).select("family", "tag", "name")), ["family", "tag"], "left").drop("family")
