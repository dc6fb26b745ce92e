"""Editing the metadata inside images, and writing the images.

Fields are set in those of an image's components that it has and that can hold them; none is created. An image is
edited in one narrow pass, from its content to its new content.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import NAMESPACES
from ..sources.containers import Damaged
from ..sources.formats import BUILT_IN
from ..sources.images import bounded, opened
from ..sources.layout import Changes
from ..sources.writers import WRITERS, edited_exif, edited_tiff, encoded_iptc, encoded_xmp
from .iptc import UTF8, datasets_of
from .xmp import SEPARATOR, properties

#: Where fields of text stand, by component.
EXIF_TEXT = {"caption": ("ifd0", 0x010E), "make": ("ifd0", 0x010F), "camera_model": ("ifd0", 0x0110), "creator": ("ifd0", 0x013B), "copyright": ("ifd0", 0x8298), "lens_model": ("exif", 0xA434)}
IPTC_TEXT = {"caption": 120, "copyright": 116, "creator": 80}
XMP_TEXT = {"caption": ("dc", "description"), "copyright": ("dc", "rights"), "creator": ("dc", "creator"), "camera_model": ("tiff", "Model"), "lens_model": ("aux", "Lens")}
#: The fields and their types; a null field is left as it is.
FIELDS = {
    **dict.fromkeys(EXIF_TEXT, "string"), "keywords": "array<string>", "latitude": "double", "longitude": "double", "captured_at": "timestamp", "exposure_num": "long", "exposure_den": "long",
    "f_number": "double", "iso": "long", "focal_length_mm": "double", "orientation": "int", "width": "long", "height": "long",
    "add_keywords": "array<string>", "properties": "array<struct<ns:string,local:string,value:string>>",
}
#: Fields that IPTC blocks and XMP packets hold besides those of text.
IPTC_MORE = ("keywords", "add_keywords")
XMP_MORE = (*IPTC_MORE, "captured_at", "latitude", "properties")
PREFIXES = {uri: p for p, uri in NAMESPACES.items()}
#: Edited images are sent on in batches of about so many bytes.
BATCH_BYTES = 32 << 20


def _dms(x: float) -> bytes:
    d, rest = divmod(abs(x), 1)
    m, rest = divmod(rest * 60, 1)
    return b"".join(int(v).to_bytes(4, "big") for v in (d, 1, m, 1, round(rest * 60 * 1_000_000), 1_000_000))


def exif_changes(s: dict) -> Changes:
    out: Changes = {"ifd0": {}, "exif": {}, "gps": {}}
    for name, (ifd, tag) in EXIF_TEXT.items():
        if s.get(name) is not None:
            data = s[name].encode() + b"\0"
            out[ifd][tag] = (2, len(data), data)

    def hundredths(tag: int, x: float | None) -> None:
        if x is not None:
            out["exif"][tag] = (5, 1, round(x * 100).to_bytes(4, "big") + (100).to_bytes(4, "big"))

    hundredths(0x829D, s.get("f_number"))
    hundredths(0x920A, s.get("focal_length_mm"))
    if s.get("exposure_num") is not None and s.get("exposure_den") is not None:
        out["exif"][0x829A] = (5, 1, s["exposure_num"].to_bytes(4, "big") + s["exposure_den"].to_bytes(4, "big"))
    if s.get("iso") is not None:
        out["exif"][0x8827] = (3, 1, min(s["iso"], 65535).to_bytes(2, "big"))
    if s.get("orientation") is not None:
        out["ifd0"][0x0112] = (3, 1, s["orientation"].to_bytes(2, "big"))
    if s.get("width") is not None and s.get("height") is not None:
        out["exif"] |= {0xA002: (4, 1, s["width"].to_bytes(4, "big")), 0xA003: (4, 1, s["height"].to_bytes(4, "big"))}
    if s.get("captured_at") is not None:
        out["exif"][0x9003] = (2, 20, s["captured_at"].strftime("%Y:%m:%d %H:%M:%S").encode() + b"\0")
    if s.get("latitude") is not None and s.get("longitude") is not None:
        lat, lon = s["latitude"], s["longitude"]
        out["gps"] = {1: (2, 2, b"S\0" if lat < 0 else b"N\0"), 2: (5, 3, _dms(lat)), 3: (2, 2, b"W\0" if lon < 0 else b"E\0"), 4: (5, 3, _dms(lon))}
    return {k: v for k, v in out.items() if v}


def edited_iptc(block: bytes, s: dict) -> bytes:
    """The block with its fields set. Text beyond Latin-1 makes the whole block UTF-8."""
    own = list(datasets_of(block, strict=True))  # an edit must not lose what it cannot read
    utf8 = any(r == 1 and d == 90 and v == UTF8 for r, d, v in own)
    new = [*(x for n in IPTC_TEXT if (x := s.get(n)) is not None), *(s.get("keywords") or ()), *(s.get("add_keywords") or ())]
    if not utf8 and any(ord(c) > 255 for x in new for c in x):
        own = [(1, 90, UTF8), *((r, d, v.decode("latin-1").encode() if r > 1 else v) for r, d, v in own)]
        utf8 = True
    coding = "utf-8" if utf8 else "latin-1"
    for name, dataset in IPTC_TEXT.items():
        if s.get(name) is not None:
            at = next((k for k, x in enumerate(own) if x[:2] == (2, dataset)), None)
            fact = (2, dataset, s[name].encode(coding))
            own = [*own, fact] if at is None else [*own[:at], fact, *own[at + 1 :]]
    if s.get("keywords") is not None:
        own = [x for x in own if x[:2] != (2, 25)] + [(2, 25, w.encode(coding)) for w in s["keywords"]]
    own += [(2, 25, w.encode(coding)) for w in s.get("add_keywords") or ()]
    return encoded_iptc(sorted(own, key=lambda x: x[0]))


def edited_xmp(packet: bytes, s: dict) -> bytes:
    own = properties(packet)

    def put(prefix: str, local: str, value: str) -> None:
        own.pop((NAMESPACES[prefix], local), None)
        if value:
            own[NAMESPACES[prefix], local] = value

    for name, key in XMP_TEXT.items():
        if s.get(name) is not None:
            put(*key, s[name])
    if s.get("keywords") is not None:
        put("dc", "subject", SEPARATOR.join(s["keywords"]))
    if s.get("add_keywords"):
        put("dc", "subject", SEPARATOR.join([*filter(None, [own.get((NAMESPACES["dc"], "subject"))]), *s["add_keywords"]]))
    for p in s.get("properties") or ():
        own.pop((p["ns"], p["local"]), None)
        if p["value"]:
            own[p["ns"], p["local"]] = p["value"]
    if s.get("captured_at") is not None:
        put("exif", "DateTimeOriginal", s["captured_at"].strftime("%Y-%m-%dT%H:%M:%SZ"))
    if s.get("latitude") is not None and s.get("longitude") is not None:
        for local, x, ends in (("GPSLatitude", s["latitude"], "NS"), ("GPSLongitude", s["longitude"], "EW")):
            put("exif", local, f"{int(abs(x))},{abs(x) % 1 * 60:.6f}{ends[x < 0]}")
    return encoded_xmp(own, PREFIXES)


def edited(content: bytes, form: str, s: dict) -> bytes:
    """An image with fields set; Damaged if it cannot be read or cannot hold them."""
    own, error = opened(content, form)
    if error:
        raise Damaged(error)
    changes, new = exif_changes(s), {}
    given = {k for k, v in s.items() if v is not None}
    if "iptc" in own and not given.isdisjoint((*IPTC_TEXT, *IPTC_MORE)):
        new["iptc"] = edited_iptc(own["iptc"], s)
    if "xmp" in own and not given.isdisjoint((*XMP_TEXT, *XMP_MORE)):
        new["xmp"] = edited_xmp(own["xmp"], s)
    if form not in WRITERS:
        extra = {tag: (kind, len(new[k]), new[k]) for k, tag, kind in (("iptc", 0x83BB, 7), ("xmp", 0x02BC, 1)) if k in new}
        changes = {**changes, "ifd0": {**changes.get("ifd0", {}), **extra}} if extra else changes
        return edited_tiff(content, changes) if changes else content
    if "exif_ifd" in own and changes.get("exif"):
        new["exif_ifd"] = edited_exif(own["exif_ifd"], {"ifd0": changes.pop("exif")})
    if "exif" in own and changes:
        new["exif"] = edited_exif(own["exif"], changes)
    return WRITERS[form](content, own | new) if new else content


def edit_metadata(images: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """path, content, changed and error of images with path and content, with fields set to the columns given.

    A null field stays as it is, and an image none of whose components can hold it is unchanged. add_keywords are put
    after those that are there; properties set XMP properties by namespace and name, and an empty value takes one away.
    Images that cannot be read or cannot hold a field, be it NaN or out of range, keep their content and have an error;
    an empty table gives no rows.
    """
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    names = list(fields)
    rows = images.select("path", "content", F.struct(*[c.cast(FIELDS[n]).alias(n) for n, c in fields.items()]).alias("fields"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            given = batch.column("fields")
            for path, content, *values in zip(batch.column("path"), batch.column("content"), *(c.to_pylist() for c in map(_in_utc, given.flatten()))):
                old, new, error = content.as_py(), None, None
                values = dict(zip(names, values))
                try:
                    new = edited(old, BUILT_IN.format_of(old), values)
                except (ValueError, OverflowError) as e:
                    error = str(e)
                rows.append((path.as_py(), old if new is None else new, new is not None and new != old, error))
                held += len(rows[-1][1] or b"")
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield _edited_batch(rows)
                    rows, held = [], 0
        yield _edited_batch(rows)

    return bounded(rows).mapInArrow(edit, "path string, content binary, changed boolean, error string")


def _in_utc(values: pa.Array) -> pa.Array:
    """Instants as times in UTC that name no zone, which take far less time to convert; other values as they are."""
    return values.view(pa.timestamp(values.type.unit)) if pa.types.is_timestamp(values.type) and values.type.tz else values


_EDITED = pa.schema([("path", pa.string()), ("content", pa.binary()), ("changed", pa.bool_()), ("error", pa.string())])


def _edited_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_EDITED)], schema=_EDITED)


def target_name(path: str) -> str:
    """The last part of a path with a hash of the whole path before its suffix."""
    stem, dot, suffix = path.rpartition("/")[2].rpartition(".")
    if not dot:
        stem, suffix = suffix, ""
    return f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:32]}{dot}{suffix}"


def write_images(images: DataFrame, root: str) -> DataFrame:
    """Writes each image under root, and gives path, target and bytes.

    A file's name is its path's last part with a hash of the whole path before the suffix, so equal names in different
    folders stay apart. A file appears under its name only when whole, and a task that runs again writes the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                name, data = target_name(path.as_py()), content.as_py()
                passing = f"{base}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(passing, compression=None) as out:
                    out.write(data)
                where.move(passing, f"{base}/{name}")
                rows.append((path.as_py(), f"{root}/{name}", len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "target", "bytes"])

    return images.where("content IS NOT NULL AND path IS NOT NULL").select("path", "content").mapInArrow(write, "path string, target string, bytes long")
