"""Images as facts: a row for each entry, dataset and property, made in one narrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.formats import BUILT_IN, Registry
from ..sources.images import bounded, opened
from .exif import directories
from .iptc import UTF8, checked, datasets_of
from .makernote import makernote_directory, makernote_entries
from .xmp import properties

#: at numbers an image's facts; coding is the byte order or the character set of a value.
FACTS = "path string, format string, at int, kind string, space string, item int, pos int, name string, type int, count long, value binary, coding string, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_FIELDS = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in FACTS.split(", "))])
COMPONENTS = ("exif", "iptc", "xmp", "makernote")


def facts_of(found: dict[str, bytes], components: tuple[str, ...], registry: Registry = BUILT_IN) -> Iterator[tuple]:
    """kind, space, item, pos, name, type, count, value and coding of each fact of an image's payloads."""
    if "exif" in components:
        make, note, own_order = "", b"", "II"
        for kind in ("exif", "exif_ifd"):
            for ifd, k, tag, form, count, value, order in directories(found.get(kind, b"")):
                ifd = "exif" if kind == "exif_ifd" and ifd == "ifd0" else ifd
                yield "exif", ifd, tag, k, None, form, count, value, order
                if (ifd, tag) == ("ifd0", 0x010F) and not k:
                    make = value.rstrip(b"\0").decode("latin-1")
                if (ifd, tag) == ("exif", 0x927C):
                    note, own_order = value, order
        if note and "makernote" in components:
            for tag, form, count, value, order in makernote_directory(make, note, own_order):
                yield "exif", "maker", tag, 0, None, form, count, value, order
            own_notes = registry.notes.get(make)
            for tag, value in (own_notes(make, note, own_order) if own_notes else makernote_entries(make, note)).items():
                yield "makernote", make, tag, 0, None, None, len(value), value, None
    if "iptc" in components and "iptc" in found:
        own = list(datasets_of(found["iptc"]))
        coding = "UTF-8" if any(r == 1 and d == 90 and v == UTF8 for r, d, v in own) else "ISO-8859-1"
        for k, (record, dataset, value) in enumerate(own):
            yield "iptc", str(record), dataset, k, None, None, len(value), value, coding
    if "xmp" in components and "xmp" in found:
        for (ns, local), value in properties(found["xmp"]).items():
            yield "xmp", ns, None, 0, local, None, len(value), value.encode(), "UTF-8"


def facts(images: DataFrame, components: tuple[str, ...] = COMPONENTS, registry: Registry = BUILT_IN) -> DataFrame:
    """The facts of images with path and content, and for each image one of kind head with its format and error.

    A component that cannot be read leaves the facts of the others, and the error names it.
    """

    parts = [(part, own) for part in COMPONENTS[:3] if (own := tuple(c for c in components if c == part or part == "exif" and c == "makernote"))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                path, content = path.as_py(), content.as_py()
                form = registry.format_of(content)
                found, error = opened(content, form, registry)
                own = []
                for component, asked in parts:
                    try:
                        own += facts_of(found, asked, registry)
                        if component == "iptc" and "iptc" in components:
                            checked(found.get("iptc", b""))
                    except ValueError as e:
                        error = error or f"Corrupt: {component}: {e}"
                rows.append((path, form, 0, "head", *[None] * 8, error))
                rows += [(path, form, k, *x, None) for k, x in enumerate(own, 1)]
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return bounded(images.select("path", "content")).mapInArrow(parse, FACTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FIELDS)], schema=_FIELDS)
