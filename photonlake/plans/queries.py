"""Queries over images made of the driver's tables, and the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image as I
from ..functions.registry import NAMESPACES, formats
from ..operators.edit import edit_metadata
from ..operators.exif import exif_entries, named
from ..operators.facts import facts
from ..operators.iptc import dataset_names, iptc_datasets, iptc_text
from ..operators.metadata import NO_DIRECTORY, NO_PROPERTIES, UNKNOWN, as_json, files_metadata, flat_metadata, read_metadata, validated
from ..operators.xmp import xmp_properties, xmp_value
from ..sources.images import read_images, segments, spread, with_format
from ..sources.shared import shared_folder
from ..sources.sink import save_images, save_stream, saved
from ..streaming.images import capture_counts, catalogue, late_images, save_counts, stream_images
from . import builders as B


FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def fixture(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table of images; one stored below the setting photonlake.fixtures is read, else it is built."""
    FIXTURES[build.__name__] = build

    @wraps(build)
    def images(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = spark.conf.get("photonlake.fixtures", None)
        return spark.read.parquet(f"{folder}/{build.__name__}") if folder else build(spark, sf_dir)

    return images


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are spread over tasks: images take far more time than the rows that they are made of."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def path(prefix: str, key: str, ending: str = "jpg") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(f".{ending}")).alias("path")


def with_parts(rows: DataFrame, **parts: Column) -> DataFrame:
    """rows with the parts of images, which containers name more than once, as columns: each is made once a row."""
    return rows.select("*", *(c.alias(n) for n, c in parts.items()))


def part_exif(own: list | None = None) -> Column:
    """A camera's block: the brand is the make, the name the model, the type the lens, the price the f-number."""
    top = [B.ascii_entry(0x010F, F.col("p_brand")), B.ascii_entry(0x0110, F.col("p_name")), B.short_entry(0x0112, F.col("p_size") % 8 + 1), *(own or [])]
    inner = [
        B.ascii_entry(0xA434, F.col("p_type")), B.short_entry(0x8827, F.col("p_size")), B.rational_entry(0x829D, (F.round(F.col("p_retailprice") * 100), 100)),
        B.long_entry(0xA002, F.col("p_partkey")), B.short_entry(0xA003, F.col("p_size")), B.short_entry(0x9207, F.col("p_size") % 9), B.short_entry(0x9209, F.col("p_size") % 4),
    ]
    return B.exif(top, inner)


@fixture
def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(table(spark, sf_dir, "part"), exif=part_exif()).select(path("p", "p_partkey"), B.jpeg(F.col("exif")).alias("content"))


def camera_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(part_images(spark, sf_dir), columns=("path", "format", "make", "model", "lens", "iso", "f_number", "width", "height"))


def images_by_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(part_images(spark, sf_dir), ("exif",), columns=("format", "make", "lens", "iso")).groupBy("format", "make").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("lens").alias("lenses"), F.max("iso").alias("most_iso"))


def exposure_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_metadata(part_images(spark, sf_dir), ("exif",), columns=("path", "orientation", "metering_mode", "flash"))
    return rows.select("path", I.described("orientation", F.col("orientation")).alias("orientation"), I.described("metering_mode", F.col("metering_mode")).alias("metering"), I.flash_fired(F.col("flash")).alias("flash_fired"))


def tags_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(exif_entries(facts(part_images(spark, sf_dir), ("exif",)))).groupBy("ifd", "name").agg(F.count(F.lit(1)).alias("entries"), F.sum("count").cast("long").alias("values"))


@fixture
def customer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.concat(B.element("tiff:Model", F.col("c_name")), B.listed("dc:creator", "Seq", F.col("c_name")), B.listed("dc:subject", "Bag", F.col("c_mktsegment"), F.col("c_nationkey").cast("string")))
    rows = with_parts(table(spark, sf_dir, "customer"), packet=B.xmp(inner))
    return rows.select(path("c", "c_custkey", "png"), B.png(None, F.col("packet")).alias("content"), "c_mktsegment", "c_nationkey")


def xmp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(customer_images(spark, sf_dir), ("xmp",), columns=("path", "format", "model", "creator", "keywords")).select("path", "format", "model", "creator", F.array_join("keywords", ";").alias("keywords"))


def images_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(customer_images(spark, sf_dir), ("xmp",), columns=("keywords",)).select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("images"))


@fixture
def event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    north = F.when(F.col("event_id") % 2 == 0, "N").otherwise("S")
    east = F.when(F.col("event_id") % 3 == 0, "E").otherwise("W")
    third = F.col("user_id") % 60
    gps = [
        B.ascii_entry(1, north), B.rational_entry(2, (F.col("event_id") % 90, 1), (third, 1), (F.col("event_id") % 60, 1)),
        B.ascii_entry(3, east), B.rational_entry(4, (F.col("event_id") % 180, 1), (third, 1), (F.col("event_id") % 60, 1)),
        (5, 1, F.lit(1), B.number(F.col("event_id") % 2, 1)), B.rational_entry(6, (F.col("user_id"), 4)),
    ]
    rows = with_parts(e, exif=B.exif([B.ascii_entry(0x010F, F.col("event_type"))], None, gps))
    return rows.select(path("e", "event_id", "webp"), B.webp(F.col("exif")).alias("content"))


def gps_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(event_images(spark, sf_dir), ("exif",), columns=("path", "format", "latitude", "longitude", "altitude"))


def iptc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    block = B.iptc((1, 90, B.raw("1B2547")), (2, 120, B.text(F.concat("s_name", F.lit(" — café")))), (2, 25, B.text(F.col("s_name"))), (2, 25, B.text(F.col("s_nationkey").cast("string"))))
    images = s.select(path("s", "s_suppkey"), B.jpeg(None, None, block).alias("content"))
    return flat_metadata(images, ("iptc",)).select("path", "caption", F.array_join("keywords", ";").alias("keywords"))


def iptc_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    images = n.select(path("n", "n_nationkey"), B.jpeg(None, None, B.iptc((2, 101, B.text(F.col("n_name"))), (2, 120, F.concat(B.text(F.col("n_name")), B.raw("E9"))))).alias("content"))
    return dataset_names(iptc_datasets(facts(images, ("iptc",)))).select("path", "pos", "dataset", "name", iptc_text(F.col("value"), F.col("is_utf8")).alias("text"))


@fixture
def priority_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XMP for large parts, IPTC for even ones, EXIF for all."""
    inner = F.concat(B.listed("dc:description", "Alt", F.concat(F.lit("x "), "p_name")), B.listed("dc:rights", "Alt", F.concat(F.lit("x "), "p_brand")))
    xmp, iptc = B.xmp(inner), B.iptc((2, 120, B.text(F.concat(F.lit("i "), "p_name"))), (2, 116, B.text(F.concat(F.lit("i "), "p_brand"))))
    exif = part_exif([B.ascii_entry(0x010E, F.concat(F.lit("e "), "p_name")), B.ascii_entry(0x8298, F.concat(F.lit("e "), "p_brand"))])
    rows = with_parts(table(spark, sf_dir, "part"), exif=exif, packet=F.when(F.col("p_size") > 25, xmp), block=F.when(F.col("p_size") % 2 == 0, iptc))
    return rows.select(path("p", "p_partkey"), B.jpeg(F.col("exif"), F.col("packet"), F.col("block")).alias("content"), "p_brand")


def caption_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(priority_images(spark, sf_dir), columns=("path", "caption", "copyright"))


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(priority_images(spark, sf_dir)).groupBy("format").agg(*[F.count(f"raw_{c}").alias(c) for c in ("exif", "iptc", "xmp")])


@fixture
def order_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    taken = B.ascii_entry(0x9003, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    rows = with_parts(o, exif=B.exif([B.ascii_entry(0x010F, F.col("o_orderpriority"))], [taken]))
    return rows.select(path("o", "o_orderkey", "png"), B.png(F.col("exif")).alias("content"))


def captured_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_metadata(order_images(spark, sf_dir), ("exif",), columns=("captured_at", "make"))
    return rows.groupBy(F.date_format("captured_at", "yyyy-MM").alias("month"), "make").agg(F.count(F.lit(1)).alias("images"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice of copyright set in every component that an image has."""
    after = edit_metadata(priority_images(spark, sf_dir), {"copyright": F.concat(F.lit("(c) "), F.col("p_brand"))})
    return flat_metadata(after, columns=("path", "copyright", "caption", "make", "model", "lens", "iso"))


def keywords_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = edit_metadata(customer_images(spark, sf_dir), {"keywords": F.array(F.lit("edited"), F.lower("c_mktsegment"))})
    return flat_metadata(after, ("xmp",), columns=("path", "creator", "keywords")).withColumn("keywords", F.array_join("keywords", ";"))


@fixture
def tiff_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(path("p", "p_partkey", "tif"), part_exif().alias("content"), "p_type", "p_size")


def tiff_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = edit_metadata(tiff_images(spark, sf_dir), {"camera_model": F.col("p_type"), "iso": F.col("p_size") * 1000, "f_number": F.lit(2.8)})
    return flat_metadata(after, ("exif",), columns=("path", "format", "make", "model", "lens", "iso", "f_number"))


def edit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of edits did: EXIF images take an orientation, images without EXIF are left as they are."""
    both = part_images(spark, sf_dir).unionByName(customer_images(spark, sf_dir).select("path", "content"))
    after = edit_metadata(both, {"orientation": F.lit(9)})
    return after.groupBy(F.when(F.col("error").isNotNull(), "failed").when(F.col("changed"), "changed").otherwise("skipped").alias("status")).agg(F.count(F.lit(1)).alias("images"))


@fixture
def canon_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = B.ifd([B.short_entry(1, F.col("p_size")), B.short_entry(6, F.col("p_size") + 1)], 0)
    rows = with_parts(with_parts(table(spark, sf_dir, "part"), note=note), exif=B.exif([B.ascii_entry(0x010F, F.lit("Canon"))], [(0x927C, 7, F.octet_length("note"), F.col("note"))]))
    return rows.select(path("p", "p_partkey"), B.jpeg(F.col("exif")).alias("content"))


def makernote_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(canon_images(spark, sf_dir), ("exif", "makernote")).where("kind = 'makernote'")
    return rows.select("path", F.col("space").alias("make"), F.col("item").alias("tag"), I.unsigned(F.col("value"), F.lit("MM"), 0, 2).alias("number"))


#: The first bytes of each format, and the format.
MAGICS = (
    ("FFD8FFE000104A4649460001", "JPEG"), ("89504E470D0A1A0A0000000D", "PNG"), ("524946460A00000057454250", "WebP"), ("0000001866747970686569630000", "HEIF"),
    ("0000001866747970617669660000", "AVIF"), ("0000001866747970617663730000", "HEIF"), ("000000186674797063727820", "CR3"), ("49492A00100000004352020000000000", "CR2"),
    ("4949524F08000000", "ORF"), ("4949550008000000", "RW2"), ("49492A0008000000010000010400010000008002000000000000", "TIFF"), ("4D4D002A00000008000101000004000000010000028000000000", "TIFF"),
    ("49492A00080000000100" + "12C60100040000000104000000000000", "DNG"), ("49492A00080000000100" + "0F010200050000001A00000000000000" + "534F4E5900", "ARW"),
    ("49492A00080000000100" + "0F010200060000001A00000000000000" + "4E696B6F6E00", "NEF"), ("474946383961", None),
)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats told by first bytes, whatever follows: the names of customers here."""
    magic = F.element_at(F.array(*[F.lit(h) for h, _ in MAGICS]), (F.col("c_custkey") % len(MAGICS)).cast("int") + 1)
    rows = table(spark, sf_dir, "customer").select("c_custkey", B.join(F.unhex(magic), B.text(F.col("c_name"))).alias("content"))
    named = with_format(rows).join(F.broadcast(formats(spark).select(F.col("name").alias("format"), "writable")), "format", "left")
    return named.select("c_custkey", "format", F.coalesce("writable", F.lit(False)).alias("writable"))


#: Images laid out by hand, and what is in them: byte order, tag, number.
GOLDEN = (
    ("G1.tif", "49492A0008000000010000010400010000008002000000000000", "II", 256, 640),
    ("G2.tif", "4D4D002A00000008000101000004000000010000028000000000", "MM", 256, 640),
    ("G3.jpg", "FFD8FFE1002245786966000049492A0008000000010000010400010000002003000000000000FFDA0002FFD9", "II", 256, 800),
)


def golden_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of images laid out by hand, one for each region."""
    digits, name = (F.element_at(F.array(*[F.lit(g[k]) for g in GOLDEN]), (F.col("r_regionkey") % len(GOLDEN)).cast("int") + 1) for k in (1, 0))
    images = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit("/"), name).alias("path"), F.unhex(digits).alias("content"))
    return exif_entries(facts(images, ("exif",))).select("path", "byte_order", "tag", I.unsigned(F.col("value"), F.col("byte_order"), 0, 4).alias("number"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that are cut off, empty or of no known format, by what is said of them."""
    r = table(spark, sf_dir, "region")
    k = F.col("r_regionkey") % 3
    content = F.when(k == 0, B.raw("89504E470D0A1A0A000000FF49484452")).when(k == 1, B.raw("")).otherwise(B.raw("474946383961"))
    rows = flat_metadata(r.select(path("r", "r_regionkey"), content.alias("content")))
    return rows.select("path", F.substring_index("error", ":", 1).alias("error"))


#: Makes, what stands before the directory of their notes in hexadecimal digits, the offset that the
#: directory has in its own count, and whether it is little-endian.
MAKER_NOTES = (
    ("NIKON CORPORATION", "4E696B6F6E000210" + "4D4D002A00000008", 8, False), ("FUJIFILM", "46554A4946494C4D30313330" + "10000000", 16, True),
    ("OLYMPUS CORPORATION", "4F4C594D50555300" + "4D4D0300", 12, False), ("PENTAX Corporation", "414F43004D4D", 6, False), ("RICOH", "50454E5441582000" + "49490000", 12, True),
    ("Panasonic", "50616E61736F6E6963000000", 12, True), ("LEICA CAMERA AG", "4C45494341000000", 8, True), ("SIGMA", "5349474D410000000100", 10, True), ("CASIO", "", 0, False),
)


def maker_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MakerNotes that are directories, of a maker by the part's number, and of one whose notes are raw values alone."""
    k, size = F.col("p_partkey") % len(MAKER_NOTES), F.col("p_size")

    def note(head: str, at: int, little: bool) -> Column:
        return B.join(B.raw(head), B.ifd([B.short_entry(2, size, little), B.rational_entry(9, (size, 10), little=little)], at, little))

    make = F.element_at(F.array(*[F.lit(m[0]) for m in MAKER_NOTES]), k.cast("int") + 1)
    content = F.lit(None).cast("binary")
    for n, (_, head, at, little) in enumerate(MAKER_NOTES):
        content = F.when(k == n, note(head, at, little)).otherwise(content)
    rows = table(spark, sf_dir, "part").select("p_partkey", make.alias("make"), content.alias("note"))
    exif = B.exif([B.ascii_entry(0x010F, F.col("make"))], [(0x927C, 7, F.octet_length("note"), F.col("note"))])
    return with_parts(rows, exif=exif).select(path("p", "p_partkey"), B.jpeg(F.col("exif")).alias("content"))


def makernote_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exif_entries(facts(maker_images(spark, sf_dir), ("exif", "makernote"))).where("ifd = 'maker'")
    number = F.when(F.col("type") == 3, I.unsigned(F.col("value"), F.col("byte_order"), 0, 2)).otherwise(I.unsigned(F.col("value"), F.col("byte_order"), 0, 4))
    return rows.select("path", "tag", "type", "byte_order", number.alias("number"))


def heif_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Exif items of which the second is the primary for even parts, and an XMP item; AVIF for large parts."""
    decoy, inner = B.exif([B.ascii_entry(0x010F, F.lit("first"))]), B.listed("dc:description", "Alt", F.col("p_name"))

    rows = with_parts(table(spark, sf_dir, "part"), decoy=decoy, exif=part_exif(), packet=B.xmp(inner))
    primary, brand = F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(3), F.when(F.col("p_size") <= 25, "heic").when(F.col("p_partkey") % 2 == 0, "avif").otherwise("avis")
    content = B.heif([(1, "Exif", F.col("decoy")), (2, "Exif", F.col("exif")), (3, "mime", F.col("packet"))], primary, brand)
    return rows.select(path("p", "p_partkey", "heic"), content.alias("content"), "p_type")


def heif_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(heif_images(spark, sf_dir), columns=("path", "format", "make", "model", "iso", "caption", "error"))


def heif_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = edit_metadata(heif_images(spark, sf_dir), {"make": F.concat(F.lit("new "), "p_type"), "caption": F.col("p_type")})
    return flat_metadata(after, columns=("path", "format", "make", "caption"))


def cr3_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = B.exif([B.ascii_entry(0x010F, F.lit("Canon")), B.ascii_entry(0x0110, F.col("p_name"))])
    second = B.exif([B.short_entry(0x8827, F.col("p_size")), B.ascii_entry(0xA434, F.col("p_type"))])
    rows = with_parts(table(spark, sf_dir, "part"), first=first, second=second, packet=B.xmp(B.listed("dc:rights", "Alt", F.col("p_brand"))))
    content = B.cr3(F.col("first"), F.col("second"), F.col("packet"))
    return rows.select(path("p", "p_partkey", "cr3"), content.alias("content"), "p_type")


def cr3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(cr3_images(spark, sf_dir), columns=("path", "format", "make", "model", "lens", "iso", "copyright"))


def cr3_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = edit_metadata(cr3_images(spark, sf_dir), {"iso": F.lit(3200), "copyright": F.concat(F.lit("(c) "), "p_type"), "creator": F.col("p_type")})
    return flat_metadata(after, columns=("path", "format", "model", "iso", "copyright", "creator"))


def raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of six kinds, by the part's number."""
    k = F.col("p_partkey") % 6

    def big(make: str, *more: B.Entry) -> Column:
        return B.exif([B.ascii_entry(0x010F, F.lit(make)), B.ascii_entry(0x0110, F.col("p_name")), *more], [B.short_entry(0x8827, F.col("p_size"))])

    little = [B.ascii_entry(0x010F, F.col("p_brand")), B.ascii_entry(0x0110, F.col("p_name")), B.short_entry(0x0112, F.col("p_size") % 8 + 1, True)]
    content = (
        F.when(k == 0, big("NIKON CORPORATION")).when(k == 1, big("SONY")).when(k == 2, big("SONY", (0xC612, 1, F.lit(4), B.raw("01040000"))))
        .when(k == 3, B.little_tiff("49492A00100000004352020000000000", little)).when(k == 4, B.little_tiff("4949524F08000000", little)).otherwise(B.little_tiff("4949550008000000", little))
    )
    return table(spark, sf_dir, "part").select(path("p", "p_partkey", "raw"), content.alias("content"), "p_type")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(raw_images(spark, sf_dir), ("exif",), columns=("path", "format", "make", "model", "iso", "orientation"))


def raw_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = edit_metadata(raw_images(spark, sf_dir), {"lens_model": F.col("p_type"), "orientation": F.lit(3)})
    return flat_metadata(after, ("exif",), columns=("path", "format", "model", "lens", "orientation"))


def packed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XMP in WebP files and, as compressed text, in PNG files."""
    inner = F.concat(B.element("tiff:Model", F.col("c_name")), B.listed("dc:subject", "Bag", F.col("c_mktsegment"), F.col("c_phone")))
    even = F.col("c_custkey") % 2 == 0
    rows = with_parts(table(spark, sf_dir, "customer").withColumn("c_phone", F.col("c_nationkey").cast("string")), packet=B.xmp(inner))
    content = F.when(even, B.webp(None, F.col("packet"))).otherwise(B.png(None, F.col("packet"), True))
    return rows.select(path("c", "c_custkey", "bin"), content.alias("content"), "c_mktsegment", "c_custkey")


def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_metadata(packed_images(spark, sf_dir), ("xmp",)).select("path", "format", "model", F.array_join("keywords", ";").alias("keywords"))


def webp_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = edit_metadata(packed_images(spark, sf_dir).where("c_custkey % 2 = 0"), {"camera_model": F.lower("c_mktsegment")})
    return flat_metadata(after, ("xmp",)).select("path", "format", "model", F.size("keywords").alias("keywords"))


#: Packets that no XML parser takes: bad references, prefixes that nothing declares, comments, tags that never end.
UNTIDY = (
    ("<tiff:Make>A&#;B</tiff:Make><tiff:Model>M&unknown;{}</tiff:Model>", "make", "'A&#;B'"),
    ("<zz:Thing>lost</zz:Thing><tiff:Make>{}</tiff:Make>", "make", "{}"),
    ("<!-- <tiff:Make>no</tiff:Make> --><tiff:Make>{}</tiff:Make><!DOCTYPE x>", "make", "{}"),
    ("<tiff:Make>&#x41;&#66;&#xGG;{}", "make", "'AB' || {}"),
    ("<dc:rights><rdf:Alt><rdf:li xml:lang='x-default'>{}</rdf:li><rdf:li xml:lang='de'>d</rdf:li></rdf:Alt></dc:rights>", "copyright", "{}"),
)


def untidy_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of packets that are not well-formed."""
    k, name = F.col("s_suppkey") % len(UNTIDY), F.col("s_name")
    inner = F.lit("")
    for n, (form, _, _) in enumerate(UNTIDY):
        head, tail = form.split("{}")
        inner = F.when(k == n, F.concat(F.lit(head), name, F.lit(tail))).otherwise(inner)
    rows = flat_metadata(table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), B.jpeg(None, B.xmp(inner)).alias("content")), ("xmp",))
    return rows.select("path", "make", "model", "copyright", "error")


def xmp_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of structures in both their forms, by name."""
    inner = F.concat(
        F.lit("<dc:contact rdf:parseType='Resource'><dc:mail>"), "s_name", F.lit("</dc:mail></dc:contact><dc:source><rdf:Description dc:id='"), F.col("s_suppkey").cast("string"),
        F.lit("'><dc:nation>"), F.col("s_nationkey").cast("string"), F.lit("</dc:nation></rdf:Description></dc:source><dc:link rdf:resource='r'/>"),
    )
    images = table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), B.jpeg(None, B.xmp(inner)).alias("content"))
    return xmp_properties(facts(images, ("xmp",))).select("path", "local", "value")


def xmp_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property by its namespace and name, of the images that have it."""
    after = edit_metadata(customer_images(spark, sf_dir), {"properties": F.when(F.col("c_nationkey") % 2 == 0, F.array(F.struct(F.lit(NAMESPACES["photoshop"]).alias("ns"), F.lit("City").alias("local"), F.col("c_mktsegment").alias("value"))))})
    return xmp_value(xmp_properties(facts(after, ("xmp",))), NAMESPACES["photoshop"], "City")


def more_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords added to those of XMP packets, and a property set by its namespace and name."""
    uri = NAMESPACES["photoshop"]
    after = edit_metadata(customer_images(spark, sf_dir), {"add_keywords": F.array(F.lit("new"), F.lower("c_mktsegment")), "properties": F.array(F.struct(F.lit(uri).alias("ns"), F.lit("City").alias("local"), F.col("c_mktsegment").alias("value")))})
    return flat_metadata(after, ("xmp",), columns=("path", "keywords", "xmp")).select("path", F.array_join("keywords", ";").alias("keywords"), F.col("xmp")[uri + "City"].alias("city"))


def iptc_keywords_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = B.iptc((2, 25, B.text(F.col("s_name"))), (2, 120, B.text(F.col("s_name"))))
    images = table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), B.jpeg(None, None, block).alias("content"), "s_nationkey")
    after = edit_metadata(images, {"add_keywords": F.array(F.concat(F.lit("nation "), "s_nationkey"), F.lit("日本"))})
    return flat_metadata(after, ("iptc",)).select("path", "caption", F.array_join("keywords", ";").alias("keywords"))


def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by what keeps them from being written."""
    k, deep = F.col("s_suppkey") % 4, F.repeat(F.lit("<a>"), 120)
    content = (
        F.when(k == 0, B.raw("474946383961")).when(k == 1, B.jpeg(B.join(B.raw("4D4D002A000000FF0000"))))
        .when(k == 2, B.jpeg(None, B.xmp(deep))).otherwise(B.jpeg(B.exif([B.ascii_entry(0x010F, F.col("s_name"))])))
    )
    return validated(table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), content.alias("content"))).select("path", "format", "problem")


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as JSON, with absent fields left out, and read again."""
    lines = as_json(flat_metadata(part_images(spark, sf_dir)))
    read = F.from_json("json", "file string, make string, iso long, f_number double, caption string")
    return lines.select("path", read.alias("r"), F.array_size(F.json_object_keys("json")).alias("fields")).select("path", "r.file", "r.make", "r.iso", "r.f_number", "r.caption", "fields")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark)}/photonlake/{name}-{uuid.uuid4().hex}"


def files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two kinds written as one committed job, and read from the files that its index names."""
    root = _shared(spark, "files")
    both = part_images(spark, sf_dir).unionByName(customer_images(spark, sf_dir).select("path", "content"))
    save_images(both, root, "images")
    files = saved(spark, root, "images").select(F.col("path").alias("source"), F.concat(F.lit(f"{root}/images/"), "target").alias("path"), F.col("bytes").alias("length"))
    rows = files_metadata(spread(files), ("path", "format", "make", "model", "iso"))
    return rows.join(files, "path").select(F.col("source").alias("path"), "format", "make", "model", "iso")


#: Bytes of image data in the files of range_records.
DATA_BYTES = 256 << 10


def range_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with far more image data than metadata, before, between or after it, of which few bytes are read."""
    k, data = F.col("s_suppkey") % 5, F.unhex(F.repeat(F.lit("00"), DATA_BYTES))
    exif = B.exif([B.ascii_entry(0x010F, F.col("s_name")), B.ascii_entry(0x0110, F.concat(F.lit("n"), "s_nationkey"))], [B.short_entry(0x8827, F.col("s_nationkey"))])
    packet = B.xmp(B.listed("dc:description", "Alt", F.col("s_name")))
    webp = F.concat(B.text(F.lit("RIFF")), B.raw("00000000"), B.text(F.lit("WEBPVP8 ")), B.number(DATA_BYTES, 4, True), data, B.text(F.lit("EXIF")), B.number(F.octet_length("exif"), 4, True), F.col("exif"))
    png = F.concat(B.raw("89504E470D0A1A0A"), B.chunk("IHDR", B.raw("00000001000000010802000000")), B.number(DATA_BYTES, 4), B.text(F.lit("IDAT")), data, B.raw("00000000"), B.chunk("eXIf", F.col("exif")), B.chunk("IEND", B.raw("")))
    content = (
        F.when(k == 0, F.concat(B.jpeg(F.col("exif"), F.col("packet")), data)).when(k == 1, F.concat(F.col("exif"), data)).when(k == 2, png).when(k == 3, webp)
        .otherwise(F.concat(B.heif([(1, "Exif", F.col("exif")), (2, "mime", F.col("packet"))], 1), data))
    )
    images = table(spark, sf_dir, "supplier").select("s_suppkey", exif.alias("exif"), packet.alias("packet"), k.alias("k")).select(path("s", "s_suppkey", "img"), content.alias("content"))
    root = _shared(spark, "ranges")
    save_images(images, root, "images")
    sources = saved(spark, root, "images").select(F.col("path").alias("source"), F.substring_index("target", "/", -1).alias("name"))
    rows = read_metadata(spark, root, ("path", "format", "make", "model", "iso", "caption", "length", "bytes_read")).withColumn("name", F.substring_index("path", "/", -1))
    few = (F.col("bytes_read") * 20 < F.col("length")).alias("few_read")
    return rows.join(sources, "name").select(F.col("source").alias("path"), "format", "make", "model", "iso", "caption", few)


def failed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that cannot be read beside directories that can, and files that cannot be read at all."""
    k, deep = F.col("s_suppkey") % 4, F.repeat(F.lit("<a>"), 120)
    exif = B.exif([B.ascii_entry(0x010F, F.col("s_name"))])
    content = (
        F.when(k == 0, B.jpeg(exif, B.xmp(deep))).when(k == 1, B.jpeg(exif, B.xmp(B.element("tiff:Model", F.col("s_name")))))
        .when(k == 2, B.raw("474946383961AABBCCDDEEFF")).otherwise(B.raw("89504E470D0A1A0A000000FF49484452"))
    )
    rows = flat_metadata(table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), content.alias("content")), columns=("path", "make", "model", "failures"))
    one = F.get("failures", F.lit(0))
    return rows.select("path", "make", "model", one["component"].alias("component"), one["kind"].alias("kind"), F.hex(one["magic"]).alias("magic"))


#: The fewest and the most files of a micro-batch, and the micro-batches of as many files as lie between.
FEWEST_FILES, MOST_FILES, BATCHES = 40, 10_000, 8


def files_a_batch(files: int) -> int:
    """Files of a micro-batch of a stream that starts with so many: a micro-batch takes about a second, however few it has."""
    return min(max(-(-files // BATCHES), FEWEST_FILES), MOST_FILES)


def streamed_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a stream takes in micro-batches, as the table that it leaves."""
    root = _shared(spark, "stream")
    images = table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), B.jpeg(B.exif([B.ascii_entry(0x010F, F.col("s_name"))], [B.short_entry(0x8827, F.col("s_nationkey"))])).alias("content"))
    save_images(images, f"{root}/files", "images")
    catalogue(stream_images(spark, f"{root}/files", files_a_batch(saved(spark, f"{root}/files", "images").count())), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").select("format", "make", "iso")


def stream_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a stream edits and writes anew as they arrive, read from what it wrote."""
    root = _shared(spark, "edits")
    images = table(spark, sf_dir, "supplier").select(path("s", "s_suppkey"), B.jpeg(B.exif([B.ascii_entry(0x010F, F.col("s_name"))], [B.short_entry(0x8827, F.col("s_nationkey"))])).alias("content"))
    save_images(images, f"{root}/in", "images")
    stream = stream_images(spark, f"{root}/in", files_a_batch(saved(spark, f"{root}/in", "images").count()))
    after = edit_metadata(stream, {"camera_model": F.lit("streamed"), "orientation": F.lit(6)})
    save_stream(after, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return read_metadata(spark, f"{root}/out", ("format", "make", "model", "iso", "orientation"))


#: The windows of captured_windows, how late an image may come, in days, and how many times images arrive.
WINDOW_DAYS, LATE_DAYS, WAVES = 30, 400, 4


def captured_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of capture time over images that arrive out of order, some twice and some too late, and how many of these.

    Orders arrive by year in waves; every tenth comes a wave later than the others of its time, and every seventh again.
    """
    root, day = _shared(spark, "windows"), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    o = table(spark, sf_dir, "orders").withColumn("wave", F.when(F.year("o_orderdate") < 1994, 0).when(F.year("o_orderdate") < 1996, 1).otherwise(2) + (F.col("o_orderkey") % 10 == 0).cast("int"))
    rows = with_parts(o, exif=B.exif([B.ascii_entry(0x010F, F.col("o_orderpriority"))], [B.ascii_entry(0x9003, day)]))
    images = rows.select("wave", "o_orderkey", path("o", "o_orderkey", "png"), B.png(F.col("exif")).alias("content"))
    late = 0
    for wave in range(WAVES):
        arriving = images.where((F.col("wave") == wave) | (F.col("wave") == wave - 1) & (F.col("o_orderkey") % 7 == 0))
        arriving.select("path", "content").write.mode("append").parquet(f"{root}/images")
        stream = spark.readStream.schema("path string, content binary").parquet(f"{root}/images")
        query = save_counts(capture_counts(stream, f"{WINDOW_DAYS} days", f"{LATE_DAYS} days"), f"{root}/table", f"{root}/checkpoint")
        query.awaitTermination()
        late += late_images(query)
    closed = spark.read.parquet(f"{root}/table").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "format", "images")
    return closed.unionByName(spark.range(1).select(F.lit("late").alias("start"), F.lit("PNG").alias("format"), F.lit(late).cast("long").alias("images")))


def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that can be read, the others dropped."""
    cut = F.when(F.col("p_partkey") % 5 == 0, F.substring(F.col("content"), 1, 20)).otherwise(F.col("content"))
    images = with_parts(table(spark, sf_dir, "part"), exif=part_exif()).select("p_partkey", path("p", "p_partkey", "png"), B.png(F.col("exif")).alias("content"))
    return flat_metadata(images.select("path", cut.alias("content")), ("exif",), mode="DROPMALFORMED").select("path", "make", "error")


@fixture
def setting_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the fields of an exposure; some of their quotients have a denominator of 0."""
    k = F.col("o_orderkey")
    top = [B.ascii_entry(0x0131, F.col("o_orderpriority")), B.ascii_entry(0x0132, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))]
    inner = [
        B.rational_entry(0x829A, (1, k % 13)), B.rational_entry(0x920A, (k % 300, 10)), B.rational_entry(0x9206, (k % 50, 4)), B.rational_entry(0xA404, (k % 8, k % 5)),
        B.short_entry(0xA403, k % 2), B.short_entry(0xA402, k % 3), B.short_entry(0xA001, F.when(k % 2 == 0, 1).otherwise(65535)), (0xA301, 7, F.lit(1), B.number(k % 3, 1)),
    ]
    return with_parts(table(spark, sf_dir, "orders"), exif=B.exif(top, inner)).select(path("o", "o_orderkey"), B.jpeg(F.col("exif")).alias("content"))


SETTINGS = ("path", "software", "date_time", "exposure_time", "focal_length_mm", "white_balance", "exposure_mode", "color_space", "subject_distance", "digital_zoom_ratio", "scene_type")


def exposure_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_metadata(setting_images(spark, sf_dir), columns=SETTINGS)
    return rows.withColumn("date_time", F.date_format("date_time", "yyyy-MM-dd"))


def xmp_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that XMP packets have as text, in both its forms."""
    k, minute = F.col("event_id"), (F.col("user_id") % 60).cast("string")
    rest = F.when(k % 2 == 0, F.concat(minute, F.lit(".5"))).otherwise(F.concat(minute, F.lit(",30")))
    lat = F.concat((k % 90).cast("string"), F.lit(","), rest, F.when(k % 4 < 2, "N").otherwise("S"))
    lon = F.concat((k % 180).cast("string"), F.lit(","), rest, F.when(k % 3 == 0, "E").otherwise("W"))
    packet = B.xmp(F.concat(B.element("exif:GPSLatitude", lat), B.element("exif:GPSLongitude", lon)))
    rows = with_parts(table(spark, sf_dir, "events"), packet=packet)
    return flat_metadata(rows.select(path("e", "event_id"), B.jpeg(None, F.col("packet")).alias("content")), columns=("path", "latitude", "longitude"))


def edited_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, times, exposures and sizes set in EXIF for even orders and in XMP for odd ones, which hold the first two."""
    k, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    exif, packet = B.exif([B.ascii_entry(0x010F, F.lit("m"))], [B.short_entry(0x8827, F.lit(1))]), B.xmp(B.element("tiff:Model", F.lit("m")))
    rows = with_parts(table(spark, sf_dir, "orders"), exif=F.when(even, exif), packet=F.when(~even, packet))
    images = rows.select("o_orderkey", "o_orderdate", path("o", "o_orderkey"), B.jpeg(F.col("exif"), F.col("packet")).alias("content"))
    fields = {
        "latitude": (k % 90) + F.lit(0.5), "longitude": -(k % 180) - F.lit(0.25), "captured_at": F.col("o_orderdate").cast("timestamp"), "exposure_num": F.lit(1), "exposure_den": k % 1000 + 1,
        "focal_length_mm": (k % 300) / F.lit(4.0), "width": k, "height": k % 9 + 1,
    }
    rows = flat_metadata(edit_metadata(images, fields), columns=("path", "latitude", "longitude", "captured_at", "exposure_time", "focal_length_mm", "width", "height"))
    return rows.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd"))


#: Makes whose notes are raw values alone, and whether those of this query are little-endian.
RAW_MAKERS = (("Nikon", False), ("SONY", True), ("DJI", False), ("SAMSUNG", True))


def raw_makernotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % len(RAW_MAKERS), F.col("p_size")
    content = F.lit(None).cast("binary")
    for n, (make, little) in enumerate(RAW_MAKERS):
        note = B.ifd([B.short_entry(3, size, little), B.long_entry(8, F.col("p_partkey"), little)], 0, little)
        content = F.when(k == n, B.exif([B.ascii_entry(0x010F, F.lit(make))], [(0x927C, 7, F.octet_length(note), note)])).otherwise(content)
    rows = facts(with_parts(table(spark, sf_dir, "part"), exif=content).select(path("p", "p_partkey"), B.jpeg(F.col("exif")).alias("content")), ("exif", "makernote")).where("kind = 'makernote'")
    order = F.when(F.col("space").isin([m for m, little in RAW_MAKERS if little]), "II").otherwise("MM")
    number = F.when(F.col("item") == 3, I.unsigned(F.col("value"), order, 0, 2)).otherwise(I.unsigned(F.col("value"), order, 0, 4))
    return rows.select("path", F.col("space").alias("make"), F.col("item").alias("tag"), number.alias("number"))


def legacy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XMP in the older text chunks of PNG files, plain and compressed; a newer chunk comes before either."""
    head, packet = B.join(B.text(F.lit("XML:com.adobe.xmp")), B.raw("00")), F.col("packet")
    plain, small = B.chunk("tEXt", B.join(head, packet)), B.chunk("zTXt", B.join(head, B.raw("00"), B.stored_zlib(packet)))
    newer = B.chunk("iTXt", B.join(head, B.raw("00000000"), F.col("newer")))
    k = F.col("c_custkey") % 4
    chunks = F.when(k == 0, plain).when(k == 1, small).when(k == 2, B.join(small, plain)).otherwise(B.join(plain, newer))
    content = B.join(B.raw("89504E470D0A1A0A"), B.chunk("IHDR", B.raw("00000001000000010802000000")), chunks, B.chunk("IEND", B.raw("")))
    rows = with_parts(table(spark, sf_dir, "customer"), packet=B.xmp(B.element("tiff:Model", F.col("c_name"))), newer=B.xmp(B.element("tiff:Model", F.lower("c_name"))))
    return flat_metadata(rows.select(path("c", "c_custkey", "png"), content.alias("content")), columns=("path", "format", "model", "error"))


def edited_thrice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images edited again and again, which grow with the first edit alone; TIFF files for even parts."""
    even = F.col("p_partkey") % 2 == 0
    rows = with_parts(table(spark, sf_dir, "part"), exif=part_exif())
    images = rows.select(path("p", "p_partkey"), F.when(even, F.col("exif")).otherwise(B.jpeg(F.col("exif"))).alias("content"))
    sizes = []
    for n in range(3):
        images = edit_metadata(images, {"copyright": F.lit(f"edit {n}"), "iso": F.lit(100 + n)}).select("path", "content")
        sizes.append(images.select("path", F.octet_length("content").alias(f"size{n}")))
    rows = flat_metadata(images, ("exif",), columns=("path", "length", "copyright", "make", "iso", "lens"))
    return rows.join(sizes[0], "path").select("path", "copyright", "make", "iso", "lens", (F.col("length") - F.col("size0")).alias("grown"))


QUERIES = {
    "camera_records": camera_records, "images_by_make": images_by_make, "exposure_words": exposure_words, "tags_by_directory": tags_by_directory, "xmp_records": xmp_records,
    "images_by_keyword": images_by_keyword, "gps_places": gps_places, "iptc_records": iptc_records, "iptc_dataset_rows": iptc_dataset_rows, "caption_priority": caption_priority,
    "segment_counts": segment_counts, "captured_by_month": captured_by_month, "stamped": stamped, "keywords_edited": keywords_edited, "tiff_edited": tiff_edited, "edit_report": edit_report,
    "makernote_tags": makernote_tags, "detected": detected, "golden_entries": golden_entries, "damaged": damaged,
    "makernote_directories": makernote_directories, "heif_records": heif_records, "heif_edited": heif_edited, "cr3_records": cr3_records, "cr3_edited": cr3_edited, "raw_records": raw_records,
    "raw_edited": raw_edited, "packed_records": packed_records, "webp_edited": webp_edited, "untidy_packets": untidy_packets, "xmp_structures": xmp_structures, "more_keywords": more_keywords, "xmp_cities": xmp_cities,
    "iptc_keywords_added": iptc_keywords_added, "fitness": fitness, "json_records": json_records, "files_read_back": files_read_back, "streamed_catalogue": streamed_catalogue, "well_formed": well_formed,
    "range_records": range_records, "failed_components": failed_components, "stream_edited": stream_edited, "captured_windows": captured_windows,
    "exposure_settings": exposure_settings, "xmp_places": xmp_places, "edited_captures": edited_captures, "raw_makernotes": raw_makernotes, "legacy_text": legacy_text, "edited_thrice": edited_thrice,
}
_PART_TAGS = (
    ("ifd0", "Make", "length(p_brand) + 1"), ("ifd0", "Model", "length(p_name) + 1"), ("ifd0", "Orientation", "1"), ("ifd0", "ExifIFDPointer", "1"), ("exif", "LensModel", "length(p_type) + 1"),
    ("exif", "ISOSpeedRatings", "1"), ("exif", "FNumber", "1"), ("exif", "PixelXDimension", "1"), ("exif", "PixelYDimension", "1"), ("exif", "MeteringMode", "1"), ("exif", "Flash", "1"),
)


def _cases(number: str, texts: dict[int, str]) -> str:
    return f"CASE {number} {' '.join(f'WHEN {k} THEN {chr(39)}{t}{chr(39)}' for k, t in texts.items())} END"


_P = "'p' || p_partkey || '.jpg' AS path"
_PLACE = "CASE WHEN event_id % {m} = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ((event_id % {d})::DOUBLE + (user_id % 60)::DOUBLE / 60 + (event_id % 60)::DOUBLE / 3600)"
_RAW = "CASE p_partkey % 6 WHEN 0 THEN 'NEF' WHEN 1 THEN 'ARW' WHEN 2 THEN 'DNG' WHEN 3 THEN 'CR2' WHEN 4 THEN 'ORF' ELSE 'RW2' END"
ORACLE_SQL = {
    "camera_records": f"SELECT {_P}, 'JPEG' AS format, p_brand AS make, p_name AS model, p_type AS lens, p_size::BIGINT AS iso, round(p_retailprice * 100)::DOUBLE / 100 AS f_number, CASE WHEN p_partkey > 0 AND p_size > 0 THEN p_partkey END::BIGINT AS width, CASE WHEN p_partkey > 0 AND p_size > 0 THEN p_size END::BIGINT AS height FROM part",
    "images_by_make": "SELECT 'JPEG' AS format, p_brand AS make, count(*) AS images, count(DISTINCT p_type) AS lenses, max(p_size)::BIGINT AS most_iso FROM part GROUP BY p_brand",
    "exposure_words": f"SELECT {_P}, {_cases('p_size % 8 + 1', I.ENUMS['orientation'])} AS orientation, {_cases('p_size % 9', I.ENUMS['metering_mode'])} AS metering, p_size % 2 = 1 AS flash_fired FROM part",
    "tags_by_directory": " UNION ALL ".join(f"SELECT '{d}' AS ifd, '{n}' AS name, count(*) AS entries, sum({size})::BIGINT AS \"values\" FROM part" for d, n, size in _PART_TAGS),
    "xmp_records": "SELECT 'c' || c_custkey || '.png' AS path, 'PNG' AS format, c_name AS model, c_name AS creator, c_mktsegment || ';' || c_nationkey AS keywords FROM customer",
    "images_by_keyword": "SELECT keyword, count(*) AS images FROM (SELECT c_mktsegment AS keyword FROM customer UNION ALL SELECT c_nationkey::VARCHAR FROM customer) GROUP BY keyword",
    "gps_places": f"SELECT 'e' || event_id || '.webp' AS path, 'WebP' AS format, {_PLACE.format(m=2, d=90)} AS latitude, {_PLACE.format(m=3, d=180)} AS longitude, CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END * (user_id::DOUBLE / 4) AS altitude FROM events",
    "iptc_records": "SELECT 's' || s_suppkey || '.jpg' AS path, s_name || ' — café' AS caption, s_name || ';' || s_nationkey AS keywords FROM supplier",
    "iptc_dataset_rows": "SELECT 'n' || n_nationkey || '.jpg' AS path, 0 AS pos, 101 AS dataset, 'CountryName' AS name, n_name AS text FROM nation UNION ALL SELECT 'n' || n_nationkey || '.jpg', 1, 120, 'Caption', n_name || 'é' FROM nation",
    "caption_priority": f"SELECT {_P}, CASE WHEN p_size > 25 THEN 'x ' WHEN p_size % 2 = 0 THEN 'i ' ELSE 'e ' END || p_name AS caption, CASE WHEN p_size > 25 THEN 'x ' WHEN p_size % 2 = 0 THEN 'i ' ELSE 'e ' END || p_brand AS copyright FROM part",
    "segment_counts": "SELECT 'JPEG' AS format, count(*) AS exif, count(*) FILTER (p_size % 2 = 0) AS iptc, count(*) FILTER (p_size > 25) AS xmp FROM part",
    "captured_by_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS make, count(*) AS images FROM orders GROUP BY ALL",
    "stamped": f"SELECT {_P}, '(c) ' || p_brand AS copyright, CASE WHEN p_size > 25 THEN 'x ' WHEN p_size % 2 = 0 THEN 'i ' ELSE 'e ' END || p_name AS caption, p_brand AS make, p_name AS model, p_type AS lens, p_size::BIGINT AS iso FROM part",
    "keywords_edited": "SELECT 'c' || c_custkey || '.png' AS path, c_name AS creator, 'edited;' || lower(c_mktsegment) AS keywords FROM customer",
    "tiff_edited": "SELECT 'p' || p_partkey || '.tif' AS path, 'TIFF' AS format, p_brand AS make, p_type AS model, p_type AS lens, least(p_size * 1000, 65535)::BIGINT AS iso, 2.8::DOUBLE AS f_number FROM part",
    "edit_report": "SELECT 'changed' AS status, count(*) AS images FROM part UNION ALL SELECT 'skipped', count(*) FROM customer",
    "makernote_tags": f"SELECT {_P}, 'Canon' AS make, 1 AS tag, p_size::BIGINT AS number FROM part UNION ALL SELECT {_P}, 'Canon', 6, p_size + 1 FROM part",
    "detected": "SELECT c_custkey, format, format IS NOT NULL AS writable FROM (SELECT c_custkey, " + _cases(f"c_custkey % {len(MAGICS)}", {k: f for k, (_, f) in enumerate(MAGICS) if f}) + " AS format FROM customer)",
    "golden_entries": " UNION ALL ".join(f"SELECT r_name || '/{p}' AS path, '{o}' AS byte_order, {t} AS tag, {n}::BIGINT AS number FROM region WHERE r_regionkey % {len(GOLDEN)} = {k}" for k, (p, _, o, t, n) in enumerate(GOLDEN)),
    "damaged": "SELECT 'r' || r_regionkey || '.jpg' AS path, CASE r_regionkey % 3 WHEN 0 THEN 'Corrupt' WHEN 1 THEN 'EmptyInput' ELSE 'UnsupportedFormat' END AS error FROM region",
    "makernote_directories": " UNION ALL ".join(f"SELECT {_P}, {tag} AS tag, {kind} AS type, '{'II' if little else 'MM'}' AS byte_order, p_size::BIGINT AS number FROM part WHERE p_partkey % {len(MAKER_NOTES)} = {n}" for n, (_, head, _, little) in enumerate(MAKER_NOTES) if head for tag, kind in ((2, 3), (9, 5))),
    "heif_records": "SELECT 'p' || p_partkey || '.heic' AS path, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'AVIF' WHEN p_size > 25 THEN 'AVIF' ELSE 'HEIF' END AS format, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'first' END AS make, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS model, CASE WHEN p_partkey % 2 = 0 THEN p_size END::BIGINT AS iso, p_name AS caption, NULL::VARCHAR AS error FROM part",
    "heif_edited": "SELECT 'p' || p_partkey || '.heic' AS path, CASE WHEN p_size > 25 THEN 'AVIF' ELSE 'HEIF' END AS format, 'new ' || p_type AS make, p_type AS caption FROM part",
    "cr3_records": "SELECT 'p' || p_partkey || '.cr3' AS path, 'CR3' AS format, 'Canon' AS make, p_name AS model, p_type AS lens, p_size::BIGINT AS iso, p_brand AS copyright FROM part",
    "cr3_edited": "SELECT 'p' || p_partkey || '.cr3' AS path, 'CR3' AS format, p_name AS model, 3200::BIGINT AS iso, '(c) ' || p_type AS copyright, p_type AS creator FROM part",
    "raw_records": f"SELECT 'p' || p_partkey || '.raw' AS path, {_RAW} AS format, CASE p_partkey % 6 WHEN 0 THEN 'NIKON CORPORATION' WHEN 1 THEN 'SONY' WHEN 2 THEN 'SONY' ELSE p_brand END AS make, p_name AS model, CASE WHEN p_partkey % 6 < 3 THEN p_size END::BIGINT AS iso, CASE WHEN p_partkey % 6 > 2 THEN p_size % 8 + 1 END::BIGINT AS orientation FROM part",
    "raw_edited": f"SELECT 'p' || p_partkey || '.raw' AS path, {_RAW} AS format, p_name AS model, p_type AS lens, 3::BIGINT AS orientation FROM part",
    "packed_records": "SELECT 'c' || c_custkey || '.bin' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'WebP' ELSE 'PNG' END AS format, c_name AS model, c_mktsegment || ';' || c_nationkey AS keywords FROM customer",
    "webp_edited": "SELECT 'c' || c_custkey || '.bin' AS path, 'WebP' AS format, lower(c_mktsegment) AS model, 2 AS keywords FROM customer WHERE c_custkey % 2 = 0",
    "untidy_packets": "SELECT 's' || s_suppkey || '.jpg' AS path, " + ", ".join([f"CASE s_suppkey % {len(UNTIDY)} {' '.join(f'WHEN {n} THEN ' + e.replace('{}', 's_name') for n, (_, c, e) in enumerate(UNTIDY) if c == column)} END AS {column}" for column in ("make", "copyright")]) + f", CASE WHEN s_suppkey % {len(UNTIDY)} = 0 THEN 'M&unknown;' || s_name END AS model, NULL::VARCHAR AS error FROM supplier",
    "xmp_structures": " UNION ALL ".join(f"SELECT 's' || s_suppkey || '.jpg' AS path, '{local}' AS local, {value} AS value FROM supplier" for local, value in (("contact.mail", "s_name"), ("source.id", "s_suppkey::VARCHAR"), ("source.nation", "s_nationkey::VARCHAR"), ("link", "'r'"))),
    "xmp_cities": "SELECT 'c' || c_custkey || '.png' AS path, c_mktsegment AS value FROM customer WHERE c_nationkey % 2 = 0",
    "more_keywords": "SELECT 'c' || c_custkey || '.png' AS path, c_mktsegment || ';' || c_nationkey || ';new;' || lower(c_mktsegment) AS keywords, c_mktsegment AS city FROM customer",
    "iptc_keywords_added": "SELECT 's' || s_suppkey || '.jpg' AS path, s_name AS caption, s_name || ';nation ' || s_nationkey || ';日本' AS keywords FROM supplier",
    "fitness": f"SELECT 's' || s_suppkey || '.jpg' AS path, CASE WHEN s_suppkey % 4 > 0 THEN 'JPEG' END AS format, CASE s_suppkey % 4 WHEN 0 THEN '{UNKNOWN}' WHEN 1 THEN '{NO_DIRECTORY}' WHEN 2 THEN '{NO_PROPERTIES}' END AS problem FROM supplier",
    "json_records": f"SELECT {_P}, 'p' || p_partkey || '.jpg' AS file, p_brand AS make, p_size::BIGINT AS iso, round(p_retailprice * 100)::DOUBLE / 100 AS f_number, NULL::VARCHAR AS caption, 12 - CASE WHEN p_partkey > 0 AND p_size > 0 THEN 0 ELSE 2 END AS fields FROM part",
    "files_read_back": f"SELECT {_P}, 'JPEG' AS format, p_brand AS make, p_name AS model, p_size::BIGINT AS iso FROM part UNION ALL SELECT 'c' || c_custkey || '.png', 'PNG', NULL, c_name, NULL FROM customer",
    "range_records": "SELECT 's' || s_suppkey || '.img' AS path, CASE s_suppkey % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'TIFF' WHEN 2 THEN 'PNG' WHEN 3 THEN 'WebP' ELSE 'HEIF' END AS format, s_name AS make, 'n' || s_nationkey AS model, s_nationkey::BIGINT AS iso, CASE WHEN s_suppkey % 5 IN (0, 4) THEN s_name END AS caption, true AS few_read FROM supplier",
    "failed_components": "SELECT 's' || s_suppkey || '.jpg' AS path, CASE WHEN s_suppkey % 4 < 2 THEN s_name END AS make, CASE WHEN s_suppkey % 4 = 1 THEN s_name END AS model, CASE s_suppkey % 4 WHEN 0 THEN 'xmp' WHEN 1 THEN NULL ELSE 'container' END AS component, CASE s_suppkey % 4 WHEN 1 THEN NULL WHEN 2 THEN 'UnsupportedFormat' ELSE 'Corrupt' END AS kind, CASE WHEN s_suppkey % 4 = 2 THEN '474946383961AABBCCDDEEFF' END AS magic FROM supplier",
    "exposure_settings": "SELECT 'o' || o_orderkey || '.jpg' AS path, o_orderpriority AS software, strftime(o_orderdate, '%Y-%m-%d') AS date_time, CASE WHEN o_orderkey % 13 > 0 THEN '1/' || (o_orderkey % 13) END AS exposure_time, (o_orderkey % 300)::DOUBLE / 10 AS focal_length_mm, (o_orderkey % 2)::BIGINT AS white_balance, (o_orderkey % 3)::BIGINT AS exposure_mode, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 65535 END::BIGINT AS color_space, (o_orderkey % 50)::DOUBLE / 4 AS subject_distance, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 8)::DOUBLE / (o_orderkey % 5) END AS digital_zoom_ratio, (o_orderkey % 3)::INTEGER AS scene_type FROM orders",
    "xmp_places": "SELECT 'e' || event_id || '.jpg' AS path, " + ", ".join(f"CASE WHEN {plus} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * CASE WHEN event_id % 2 = 0 THEN (event_id % {d})::DOUBLE + ((user_id % 60)::DOUBLE + 0.5::DOUBLE) / 60 ELSE (event_id % {d})::DOUBLE + (user_id % 60)::DOUBLE / 60 + 30.0::DOUBLE / 3600 END AS {c}" for c, d, plus in (("latitude", 90, "event_id % 4 < 2"), ("longitude", 180, "event_id % 3 = 0"))) + " FROM events",
    "edited_captures": "SELECT 'o' || o_orderkey || '.jpg' AS path, (o_orderkey % 90)::DOUBLE + 0.5::DOUBLE AS latitude, -((o_orderkey % 180)::DOUBLE + 0.25::DOUBLE) AS longitude, strftime(o_orderdate, '%Y-%m-%d') AS captured_at, " + ", ".join(f"CASE WHEN o_orderkey % 2 = 0 THEN {x} END AS {c}" for c, x in (("exposure_time", "'1/' || (o_orderkey % 1000 + 1)"), ("focal_length_mm", "(o_orderkey % 300)::DOUBLE / 4"), ("width", "nullif(o_orderkey, 0)::BIGINT"), ("height", "CASE WHEN o_orderkey <> 0 THEN o_orderkey % 9 + 1 END::BIGINT"))) + " FROM orders",
    "raw_makernotes": f"SELECT {_P}, {_cases(f'p_partkey % {len(RAW_MAKERS)}', {n: m for n, (m, _) in enumerate(RAW_MAKERS)})} AS make, t.tag, CASE t.tag WHEN 3 THEN p_size ELSE p_partkey END::BIGINT AS number FROM part, (VALUES (3), (8)) t(tag)",
    "legacy_text": "SELECT 'c' || c_custkey || '.png' AS path, 'PNG' AS format, CASE WHEN c_custkey % 4 = 3 THEN lower(c_name) ELSE c_name END AS model, NULL::VARCHAR AS error FROM customer",
    "edited_thrice": f"SELECT {_P}, 'edit 2' AS copyright, p_brand AS make, 102::BIGINT AS iso, p_type AS lens, 0::BIGINT AS grown FROM part",
    "stream_edited": "SELECT 'JPEG' AS format, s_name AS make, 'streamed' AS model, s_nationkey::BIGINT AS iso, 6::BIGINT AS orientation FROM supplier",
    "captured_windows": f"""
WITH o AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN year(o_orderdate) < 1994 THEN 0 WHEN year(o_orderdate) < 1996 THEN 1 ELSE 2 END + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS wave FROM orders
), a AS (
  SELECT o_orderkey, d, wave, true AS first FROM o UNION ALL SELECT o_orderkey, d, wave + 1, false FROM o WHERE o_orderkey % 7 = 0 AND wave + 1 < {WAVES}
), m AS (
  SELECT w.wave, max(a.d) - {LATE_DAYS} AS mark FROM range({WAVES}) w(wave) JOIN a ON a.wave <= w.wave GROUP BY w.wave
), k AS (
  SELECT a.*, coalesce(a.d <= m.mark, false) AS late FROM a LEFT JOIN m ON m.wave = a.wave - 1
), c AS (
  SELECT DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', d) // {WINDOW_DAYS} * {WINDOW_DAYS} AS INTEGER) AS s, count(DISTINCT o_orderkey) AS images FROM k WHERE NOT late GROUP BY 1
)
SELECT strftime(s, '%Y-%m-%d') AS start, 'PNG' AS format, images FROM c WHERE s + {WINDOW_DAYS} <= (SELECT max(mark) FROM m)
UNION ALL SELECT 'late', 'PNG', count(*) FROM k WHERE late""",
    "streamed_catalogue": "SELECT 'JPEG' AS format, s_name AS make, s_nationkey::BIGINT AS iso FROM supplier",
    "well_formed": "SELECT 'p' || p_partkey || '.png' AS path, p_brand AS make, NULL::VARCHAR AS error FROM part WHERE p_partkey % 5 > 0",
}
