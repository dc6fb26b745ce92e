"""One record an image: fields resolved by the priority of their sources.

One narrow pass reads what the fields need out of an image's payloads, as typed columns of one row: texts, numbers and
pairs of numbers. Priorities, quotients, places and times are expressions over them. Nothing is shuffled.

What is parsed follows from the columns that are asked for: directories give the tags that these need, and XMP is parsed
where a column needs it that EXIF does not already fill. Images come as a column of contents, or from files of which the
ranges are read that this parsing asks for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image as I
from ..functions.registry import NAMESPACES
from ..sources.containers import KINDS
from ..sources.formats import BUILT_IN, Registry
from ..sources.images import bounded, kept_errors, opened
from ..sources.ranges import opened_files
from ..sources.table import FORMAT, ImageFiles
from .exif import directories
from .iptc import UTF8, checked, datasets_of
from .xmp import properties

#: Directory and tag of the fields that are read, by how they are read.
TEXTS = {
    "make": ("ifd0", 0x010F), "model": ("ifd0", 0x0110), "software": ("ifd0", 0x0131), "date_time": ("ifd0", 0x0132), "artist": ("ifd0", 0x013B), "copyright": ("ifd0", 0x8298),
    "description": ("ifd0", 0x010E), "original": ("exif", 0x9003), "offset": ("exif", 0x9011), "lens": ("exif", 0xA434),
}
SHORTS = {
    "orientation": ("ifd0", 0x0112), "iso": ("exif", 0x8827), "metering": ("exif", 0x9207), "flash": ("exif", 0x9209), "color": ("exif", 0xA001), "mode": ("exif", 0xA402), "white": ("exif", 0xA403),
}
SIZES = {"width": ("exif", 0xA002), "height": ("exif", 0xA003)}
RATIONALS = {"exposure": ("exif", 0x829A), "f_number": ("exif", 0x829D), "distance": ("exif", 0x9206), "focal": ("exif", 0x920A), "zoom": ("exif", 0xA404), "alt": ("gps", 6)}
PLACES = {"lat": (("gps", 1), ("gps", 2)), "lon": (("gps", 3), ("gps", 4))}
FIRST_BYTES = {"alt_ref": ("gps", 5), "scene": ("exif", 0xA301)}
#: The properties and datasets that are read.
XMP_FIELDS = {
    "x_model": ("tiff", "Model"), "x_make": ("tiff", "Make"), "x_tool": ("xmp", "CreatorTool"), "x_lens": ("aux", "Lens"), "x_rights": ("dc", "rights"), "x_description": ("dc", "description"),
    "x_creator": ("dc", "creator"), "x_subject": ("dc", "subject"), "x_lat": ("exif", "GPSLatitude"), "x_lon": ("exif", "GPSLongitude"), "x_original": ("exif", "DateTimeOriginal"),
}
_XMP_KEYS = {n: (NAMESPACES[p], local) for n, (p, local) in XMP_FIELDS.items()}
IPTC_FIELDS = {"i_caption": 120, "i_copyright": 116, "i_creator": 80}

FAILURES = pa.list_(pa.struct([("component", pa.string()), ("kind", pa.string()), ("message", pa.string()), ("magic", pa.binary())]))
_COLUMNS = {
    "path": pa.string(), "format": pa.string(), "error": pa.string(), "failures": FAILURES, "length": pa.int64(), "bytes_read": pa.int64(),
    **dict.fromkeys(TEXTS, pa.string()), **dict.fromkeys([*SHORTS, *SIZES], pa.int64()),
    **{f"{n}_{part}": pa.int64() for n in RATIONALS for part in ("num", "den")}, **{f"{n}_ref": pa.string() for n in PLACES}, **{n: pa.list_(pa.int64()) for n in PLACES},
    **dict.fromkeys(FIRST_BYTES, pa.int64()), **dict.fromkeys([*XMP_FIELDS, *IPTC_FIELDS], pa.string()), "i_keywords": pa.list_(pa.string()), "x_all": pa.map_(pa.string(), pa.string()),
}
_NAMES = {
    pa.string(): "string", pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>",
    pa.map_(pa.string(), pa.string()): "map<string,string>", FAILURES: "array<struct<component:string,kind:string,message:string,magic:binary>>",
}
#: Where the values of the fields stand, by field.
TAGS_OF = {
    **{n: (at,) for n, at in (*TEXTS.items(), *SHORTS.items(), *SIZES.items(), *FIRST_BYTES.items())}, **{f"{n}_{part}": (at,) for n, at in RATIONALS.items() for part in ("num", "den")},
    **{k: at for n, at in PLACES.items() for k in (n, f"{n}_ref")},
}
#: What each column of a record needs. The first four are filled by EXIF before XMP, so XMP counts only where it isn't.
NEEDS = {
    "make": ("make", "x_make"), "model": ("model", "x_model", "x_tool"), "lens": ("lens", "x_lens"), "software": ("software", "x_tool"),
    "path": ("path",), "format": ("format",), "error": ("error",), "failures": ("failures",), "length": ("length",), "bytes_read": ("bytes_read",),
    "width": ("width", "height"), "height": ("width", "height"), "captured_at": ("original", "offset", "x_original"), "date_time": ("date_time",),
    "latitude": ("lat", "lat_ref", "lon", "lon_ref", "x_lat", "x_lon"), "longitude": ("lat", "lat_ref", "lon", "lon_ref", "x_lat", "x_lon"), "altitude": ("alt_num", "alt_den", "alt_ref"),
    "exposure_time": ("exposure_num", "exposure_den"), "f_number": ("f_number_num", "f_number_den"), "iso": ("iso",), "focal_length_mm": ("focal_num", "focal_den"), "orientation": ("orientation",),
    "white_balance": ("white",), "flash": ("flash",), "exposure_mode": ("mode",), "color_space": ("color",), "metering_mode": ("metering",), "subject_distance": ("distance_num", "distance_den"),
    "digital_zoom_ratio": ("zoom_num", "zoom_den"), "scene_type": ("scene",), "caption": ("x_description", "i_caption", "description"), "copyright": ("x_rights", "i_copyright", "copyright"),
    "creator": ("x_creator", "i_creator", "artist"), "keywords": ("x_subject", "i_keywords"), "xmp": ("x_all",),
}
EXIF_FIRST = ("make", "model", "lens", "software")
#: The columns of a record of contents; files have length and bytes_read besides, and both, where asked for, failures, and
#: in xmp all properties by URI, namespace and name together.
RECORD_COLUMNS = (
    "path", "format", "error", "make", "model", "lens", "software", "width", "height", "captured_at", "date_time", "latitude", "longitude", "altitude", "exposure_time", "f_number", "iso",
    "focal_length_mm", "orientation", "white_balance", "flash", "exposure_mode", "color_space", "metering_mode", "subject_distance", "digital_zoom_ratio", "scene_type", "caption", "copyright",
    "creator", "keywords",
)


def fields_for(columns: Iterable[str]) -> list[str]:
    """The fields that columns of a record need, in order."""
    unknown = set(columns) - set(NEEDS)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    wanted = {f for c in columns for f in NEEDS[c]}
    return [f for f in _COLUMNS if f in wanted]


def ddl(fields: Iterable[str]) -> str:
    return ", ".join(f"{n} {_NAMES[_COLUMNS[n]]}" for n in fields)


Entry = tuple[int, int, bytes, str]  # type, count, value, byte order


def _number(value: bytes, order: str, at: int, width: int) -> int | None:
    part = value[at : at + width]
    return int.from_bytes(part, order) if len(part) == width else None


def _text(e: Entry) -> str | None:
    """Text without its trailing NULs; none unless of type ASCII."""
    return e[2].rstrip(b"\0").decode("utf-8", "replace") or None if e[0] == 2 else None


def _short(e: Entry) -> int:
    """A SHORT; a value of another type that is there is 0."""
    return _number(e[2], e[3], 0, 2) or 0 if e[0] in (3, 8) else 0


def _size(e: Entry) -> int | None:
    return _number(e[2], e[3], 0, {3: 2, 4: 4}[e[0]]) if e[0] in (3, 4) else None


def _rational(e: Entry, i: int = 0) -> tuple[int | None, int | None]:
    """The i-th numerator and denominator; none for another type or too few bytes."""
    pair = e[0] in (5, 10) and len(e[2]) >= 8 * i + 8
    return (_number(e[2], e[3], 8 * i, 4), _number(e[2], e[3], 8 * i + 4, 4)) if pair else (None, None)


@lru_cache(maxsize=64)
def _exif_plan(fields: tuple[str, ...]) -> tuple[frozenset[int], list, list, list, list]:
    """The tags that fields need, and where and how each field is read."""
    readers = [(n, names[n], read) for names, read in ((TEXTS, _text), (SHORTS, _short), (SIZES, _size)) for n in names if n in fields]
    rationals = [(n, at) for n, at in RATIONALS.items() if f"{n}_num" in fields]
    places = [(n, *at) for n, at in PLACES.items() if n in fields]
    firsts = [(n, at) for n, at in FIRST_BYTES.items() if n in fields]
    return frozenset(tag for f in fields for _, tag in TAGS_OF.get(f, ())), readers, rationals, places, firsts


def exif_fields(found: dict[str, bytes], fields: Sequence[str] = tuple(TAGS_OF)) -> dict[str, object]:
    """The fields of an image's directories; of repeated entries the first counts."""
    tags, readers, rationals, places, firsts = _exif_plan(tuple(fields))
    own: dict[tuple[str, int], Entry] = {}
    for kind in ("exif", "exif_ifd"):
        if kind in found:
            for ifd, k, tag, form, count, value, mark in directories(found[kind], tags):
                if not k:
                    own.setdefault(("exif" if kind == "exif_ifd" and ifd == "ifd0" else ifd, tag), (form, count, value, "little" if mark == "II" else "big"))
    out: dict[str, object] = {n: read(own[at]) for n, at, read in readers if at in own}
    for n, at in rationals:
        if at in own:
            out[f"{n}_num"], out[f"{n}_den"] = _rational(own[at])
    for n, ref, at in places:
        if ref in own and at in own and own[at][1] == 3:
            out[f"{n}_ref"], out[n] = own[ref][2][:1].decode("latin-1"), [x for i in range(3) for x in _rational(own[at], i)]
    out.update((n, own[at][2][0]) for n, at in firsts if at in own and own[at][2])
    return out


def iptc_fields(block: bytes) -> dict[str, object]:
    """The fields of an IPTC block; of repeated datasets the first counts, but for keywords."""
    own = list(datasets_of(block))
    utf8 = any(r == 1 and d == 90 and v == UTF8 for r, d, v in own)

    def text(v: bytes) -> str | None:
        try:
            return v.decode("utf-8" if utf8 else "latin-1")
        except UnicodeDecodeError:
            return None

    first = {d: v for r, d, v in reversed(own) if r == 2}
    return {n: text(first[d]) for n, d in IPTC_FIELDS.items() if d in first} | {"i_keywords": [text(v) for r, d, v in own if (r, d) == (2, 25)]}


def xmp_fields(packet: bytes, fields: Sequence[str] = ()) -> dict[str, object]:
    own = properties(packet)
    every = {"x_all": [(ns + local, v) for (ns, local), v in own.items()]} if "x_all" in fields else {}
    return every | {n: v for n, key in _XMP_KEYS.items() if (v := own.get(key))}


def failure(component: str, error: str, content: bytes | None) -> dict[str, object]:
    kind, _, message = error.partition(": ")
    return {"component": component, "kind": kind, "message": message or None, "magic": bytes(content[:12]) if content and kind == "UnsupportedFormat" else None}


@lru_cache(maxsize=64)
def _record_plan(columns: frozenset[str], fields: tuple[str, ...], components: tuple[str, ...]) -> tuple[bool, frozenset[str], frozenset[str], bool, list[str]]:
    """Whether all components are read, the kinds of payloads that are, the same with XMP where it is needed at once, and
    what needs XMP: at once, or where EXIF lacks it."""
    every = not columns.isdisjoint(("error", "failures"))
    exif, iptc = (every or any(f in group for f in fields) for group in (TAGS_OF, (*IPTC_FIELDS, "i_keywords")))
    kinds = {k for c, on in (("exif", exif), ("iptc", iptc), ("xmp", every)) if on and c in components for k in KINDS if k.startswith(c)}
    in_xmp = [c for c in columns if "xmp" in components and any(f.startswith("x_") for f in NEEDS[c])]
    at_once = any(c not in EXIF_FIRST for c in in_xmp)
    return every, frozenset(kinds), frozenset(kinds | {"xmp"} if at_once else kinds), at_once, [c for c in in_xmp if c in EXIF_FIRST]


def record_of(content: bytes | None, form: str | None, columns: frozenset[str], fields: Sequence[str], components: Sequence[str], registry: Registry = BUILT_IN) -> dict[str, object]:
    """The fields of one image that columns need, with its error and failures.

    A component that cannot be read leaves the others; the first failure is the error, and it names the component unless
    the container itself is damaged. Asking for error or failures reads every component.
    """
    every, kinds, walked, at_once, unless_filled = _record_plan(columns, tuple(fields), tuple(components))
    found, error = opened(content, form, registry, walked) if walked or form is None else ({}, None)
    if error and walked != kinds:  # damage in XMP leaves what is read without it
        found, error = opened(content, form, registry, kinds) if kinds or form is None else ({}, None)
        walked = kinds
    failures = [failure("container", error, content)] if error else []
    out: dict[str, object] = {}

    def read(component: str, parse) -> None:
        try:
            out.update(parse())
        except ValueError as e:
            failures.append(failure(component, f"Corrupt: {e}", content))

    if "exif" in kinds:
        read("exif", lambda: exif_fields(found, fields))
    if "iptc" in found:
        read("iptc", lambda: iptc_fields(found["iptc"]))
        read("iptc", lambda: checked(found["iptc"]) or {})
    lacking = at_once or any(out.get(c) is None for c in unless_filled)
    if lacking and "xmp" not in walked and form is not None and not error:
        found, late = opened(content, form, registry, frozenset(("xmp",)))
        failures += [failure("container", late, content)] if late else []
    if lacking and "xmp" in found or every and "xmp" in found:
        read("xmp", lambda: xmp_fields(found["xmp"], fields))
    if failures:
        f = failures[0]
        parts = [f["kind"], *([f["component"]] if f["component"] != "container" else []), *([f["message"]] if f["message"] else [])]
        out |= {"error": ": ".join(parts), "failures": failures}
    return out


def batch_of(rows: list[dict[str, object]], fields: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _COLUMNS[n]) for n in fields], names=list(fields))


def decoded(images: DataFrame, components: Sequence[str], columns: Sequence[str] = RECORD_COLUMNS, registry: Registry = BUILT_IN) -> DataFrame:
    """The fields of each image (path, content) that columns need."""
    fields, wanted = fields_for(columns), frozenset(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                content = content.as_py()
                form = registry.format_of(content)
                size = None if content is None else len(content)
                rows.append({"path": path.as_py(), "format": form, "length": size, "bytes_read": size, **record_of(content, form, wanted, fields, components, registry)})
            yield batch_of(rows, fields)

    return bounded(images.select("path", "content")).mapInArrow(read, ddl(fields))


#: Rows of a batch of records of files.
ROWS = 1000


def decoded_files(files: Iterable[tuple[str, int | None]], columns: Sequence[str], components: Sequence[str] = ("exif", "iptc", "xmp"), registry: Registry = BUILT_IN) -> Iterator[pa.RecordBatch]:
    """The fields of each file (path, length) that columns need, from the ranges of it that hold them."""
    fields, wanted, rows = fields_for(columns), frozenset(columns), []
    for path, data, problem in opened_files(files):
        if data is None:
            rows.append({"path": path, "error": problem, "failures": [failure("file", problem, None)]})
        else:
            try:
                form = registry.format_of(data)
                own = record_of(data, form, wanted, fields, components, registry)
            except OSError as e:
                form, own = None, {"error": f"Unreadable: {e}", "failures": [failure("file", f"Unreadable: {e}", None)]}
            rows.append({"path": path, "format": form, "length": len(data), "bytes_read": data.fetched, **own})
        if len(rows) == ROWS:
            yield batch_of(rows, fields)
            rows = []
    if rows:
        yield batch_of(rows, fields)


def _pair(n: str) -> Column:
    return F.struct(F.col(f"{n}_num").alias("num"), F.col(f"{n}_den").alias("den"))


def _place(c: str, most: int, strict: bool) -> Column:
    parts = [F.struct(F.get(F.col(c), F.lit(2 * i)).alias("num"), F.get(F.col(c), F.lit(2 * i + 1)).alias("den")) for i in range(3)]
    return F.when(F.col(c).isNotNull(), I.degrees(parts, F.col(f"{c}_ref"), most, strict))


def record_columns(strict_gps: bool = False) -> dict[str, Column]:
    """The columns of a record as expressions over fields; those of the place also need the column place."""

    def text(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    both = (F.col("width") > 0) & (F.col("height") > 0)
    high = I.quotient(_pair("alt"))
    keywords = F.when(F.size("i_keywords") > 0, F.col("i_keywords"))
    return {
        **{c: F.col(c) for c in ("path", "format", "error", "failures", "length", "bytes_read", "iso", "orientation", "flash")},
        "xmp": F.col("x_all"),
        "make": F.coalesce("make", text("x_make")), "model": F.coalesce("model", text("x_model"), text("x_tool")), "lens": F.coalesce("lens", text("x_lens")), "software": F.coalesce("software", text("x_tool")),
        "width": F.when(both, F.col("width")), "height": F.when(both, F.col("height")),
        "captured_at": F.coalesce(I.exif_time(F.col("original"), F.col("offset")), I.xmp_time(F.col("x_original"))), "date_time": I.exif_time(F.col("date_time")),
        "latitude": F.col("place.lat"), "longitude": F.col("place.lon"), "altitude": F.when(F.col("alt_ref") == 1, -high).otherwise(high),
        "exposure_time": I.exposure_text(_pair("exposure")), "f_number": I.quotient(_pair("f_number")), "focal_length_mm": I.quotient(_pair("focal")),
        "white_balance": F.col("white"), "exposure_mode": F.col("mode"), "color_space": F.col("color"), "metering_mode": F.col("metering"),
        "subject_distance": I.quotient(_pair("distance")), "digital_zoom_ratio": I.quotient(_pair("zoom")), "scene_type": F.col("scene").cast("int"),
        "caption": F.coalesce(I.first_of(F.col("x_description")), text("i_caption"), F.col("description")), "copyright": F.coalesce(I.first_of(F.col("x_rights")), text("i_copyright"), F.col("copyright")),
        "creator": F.coalesce(I.first_of(F.col("x_creator")), text("i_creator"), F.col("artist")), "keywords": F.coalesce(I.items_of(F.col("x_subject")), keywords),
    }


def as_records(fields: DataFrame, columns: Sequence[str], strict_gps: bool = False) -> DataFrame:
    """Columns of records from the fields that they need."""
    if not {"latitude", "longitude"}.isdisjoint(columns):
        fields = fields.select("*", *(I.xmp_parts(F.col(f"x_{c}")).alias(f"x_{c}_parts") for c in PLACES))
        sides = (("lat", 90), ("lon", 180))
        exif_place, xmp_place = ([_place(c, most, strict_gps) for c, most in sides], [I.xmp_degrees(F.col(f"x_{c}_parts"), F.col(f"x_{c}"), most) for c, most in sides])
        fields = fields.select("*", *(x.alias(f"{source}_{c}_at") for source, place in (("exif", exif_place), ("xmp", xmp_place)) for c, x in zip(PLACES, place)))
        whole = [F.when(F.col(f"{s}_lat_at").isNotNull() & F.col(f"{s}_lon_at").isNotNull(), F.struct(F.col(f"{s}_lat_at").alias("lat"), F.col(f"{s}_lon_at").alias("lon"))) for s in ("exif", "xmp")]
        fields = fields.withColumn("place", F.coalesce(*whole))
    own = record_columns(strict_gps)
    return fields.select(*(own[c].alias(c) for c in columns))


def flat_metadata(
    images: DataFrame, components: Sequence[str] = ("exif", "iptc", "xmp"), strict_gps: bool = False, mode: str = "PERMISSIVE", columns: Sequence[str] = RECORD_COLUMNS, registry: Registry = BUILT_IN
) -> DataFrame:
    """A row for each image (path, content): the columns asked for, null where no source has them.

    Components left out are not parsed, nor what no column asked for needs. Every row is an image, whatever its path;
    null and empty contents, unknown formats and damaged files have an error and no fields; a component that cannot be
    read has one, which names it, and leaves the others; failures has them all. An empty table gives no rows; further
    columns are ignored.
    """
    needed = columns if mode == "PERMISSIVE" else [*columns, *({"path", "error"} - set(columns))]
    return kept_errors(as_records(decoded(images, components, needed, registry), needed, strict_gps), mode).select(*columns)


def read_metadata(spark: SparkSession, path: str, columns: Sequence[str] = RECORD_COLUMNS, suffixes: Sequence[str] = (), strict_gps: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each file below a path, as flat_metadata has it, of which only the ranges are read that columns need.

    length and bytes_read, where asked for, are those of the file and of what was read of it.
    """
    spark.dataSource.register(ImageFiles)
    needed = columns if mode == "PERMISSIVE" else [*columns, *({"path", "error"} - set(columns))]
    options = {"columns": ",".join(needed), "suffixes": ",".join(suffixes), "parts": str(spark.sparkContext.defaultParallelism)}
    fields = spark.read.format(FORMAT).options(**options).load(path)
    return kept_errors(as_records(fields, needed, strict_gps), mode).select(*columns)


def files_metadata(files: DataFrame, columns: Sequence[str] = RECORD_COLUMNS, strict_gps: bool = False, mode: str = "PERMISSIVE", registry: Registry = BUILT_IN) -> DataFrame:
    """The same of files that a table names (path, and length where it is known), as when a catalogue lists them.

    A file that isn't there, or a null path, has an error.
    """
    needed = columns if mode == "PERMISSIVE" else [*columns, *({"path", "error"} - set(columns))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from decoded_files(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()), needed, registry=registry)

    listed = files.select("path", F.col("length").cast("long") if "length" in files.columns else F.lit(None).cast("long").alias("length"))
    return kept_errors(as_records(listed.mapInArrow(read, ddl(fields_for(needed))), needed, strict_gps), mode).select(*columns)


#: What validated() says of images that can't be written as they are.
UNKNOWN, NO_DIRECTORY, NO_PROPERTIES = "unknown format", "EXIF without a first directory", "XMP that cannot be read"


def validated(images: DataFrame) -> DataFrame:
    """path, format and problem of every image: null where it is fit to be written.

    Null and empty contents are of no known format; an image without EXIF or XMP is fit; an empty table gives no rows.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, forms = [], []
            for content in batch.column("content"):
                content = content.as_py()
                form = BUILT_IN.format_of(content)
                forms.append(form)
                found, error = opened(content, form)
                if error and form is not None:
                    out.append(error)
                elif form is None:
                    out.append(UNKNOWN)
                elif "exif" in found and not any(d[0] == "ifd0" for d in directories(found["exif"])):
                    out.append(NO_DIRECTORY)
                else:
                    try:
                        properties(found.get("xmp", b""))
                        out.append(None)
                    except ValueError:
                        out.append(NO_PROPERTIES)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(forms, pa.string()), pa.array(out, pa.string())], names=["path", "format", "problem"])

    return bounded(images.select("path", "content")).mapInArrow(check, "path string, format string, problem string")


def as_json(records: DataFrame) -> DataFrame:
    """path and the record as JSON, absent fields left out."""
    fields = [c for c in records.columns if c not in ("path", "error")]
    return records.select("path", F.to_json(F.struct(F.col("path").alias("file"), *fields)).alias("json"))
