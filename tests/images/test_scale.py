"""Work that grows no faster than its input: rows are spread over tasks, and images are made by compiled expressions."""

import datetime as dt
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from photonlake.operators import facts as FACTS
from photonlake.operators import metadata as M
from photonlake.operators import xmp as X
from photonlake.operators.edit import edit_metadata
from photonlake.operators.metadata import flat_metadata, fields_for
from photonlake.plans import builders as B
from photonlake.plans import queries as Q
from photonlake.sources import containers as C
from photonlake.sources.formats import BUILT_IN
from photonlake.sources.images import ROWS_A_TASK, opened, spread

SF = "/root/testdata/sf0.001"
COMPONENTS = ("exif", "iptc", "xmp")


def rows_by_task(rows):
    return [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_rows_of_one_row_group_are_spread_over_tasks(spark, tmp_path):
    n = 20 * ROWS_A_TASK
    pq.write_table(pa.table({"p_partkey": range(n), "p_name": ["n"] * n}), tmp_path / "part.parquet")
    counts = rows_by_task(Q.table(spark, str(tmp_path), "part"))
    assert sum(counts) == n and len(counts) == 20 and max(counts) < 2 * ROWS_A_TASK
    assert spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == 1
    assert spread(spark.range(0)).count() == 0
    repeated = spark.createDataFrame([(None,), (1,), (1,)] * ROWS_A_TASK, "k int").coalesce(1)
    assert {tuple(r) for r in spread(repeated).groupBy("k").count().collect()} == {(None, ROWS_A_TASK), (1, 2 * ROWS_A_TASK)}


def test_no_image_is_made_by_functions_over_arrays(spark):
    made = (Q.part_images, Q.customer_images, Q.event_images, Q.priority_images, Q.order_images, Q.tiff_images, Q.canon_images, Q.setting_images, Q.heif_images, Q.cr3_images, Q.raw_images, Q.packed_images, Q.maker_images)
    for build in made:
        plan = build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan, build.__name__


def test_stored_zlib_streams_are_the_data(spark):
    texts = [b"", b"a", bytes(range(256)) * 200, None]
    rows = spark.createDataFrame([(t,) for t in texts], "d binary").select("d", B.stored_zlib("d").alias("z")).collect()
    assert [r.z if r.z is None else zlib.decompress(r.z) for r in rows] == texts


def test_directories_have_their_values_where_they_say(spark):
    """Texts around the size of a field, and sub-directories after others of any size."""
    rows = spark.createDataFrame([("abc", 1), ("abcd", 2), ("", 3), ("é" * 9, 4), (None, 5)], "t string, n int")
    block = B.exif([B.ascii_entry(0x010F, F.col("t")), B.short_entry(0x0112, F.col("n"))], [B.short_entry(0x8827, F.col("n") * 7), B.ascii_entry(0xA434, F.col("t"))], [B.rational_entry(6, (F.col("n"), 2))])
    got = flat_metadata(rows.select(F.col("n").cast("string").alias("path"), B.jpeg(block).alias("content")), columns=("path", "make", "orientation", "iso", "lens", "altitude")).collect()
    assert {tuple(r) for r in got} == {(str(n), t or None, n, 7 * n, t or None, n / 2) if t is not None else (str(n), None, None, None, None, None) for t, n in (("abc", 1), ("abcd", 2), ("", 3), ("é" * 9, 4), (None, 5))}


def test_micro_batches_do_not_grow_in_number_with_files():
    assert [Q.files_a_batch(n) for n in (0, 40, 320, 321)] == [40, 40, 40, 41]
    assert all(-(-n // Q.files_a_batch(n)) <= Q.BATCHES for n in (1_000, 60_000, Q.BATCHES * Q.MOST_FILES))
    assert Q.files_a_batch(10_000_000) == Q.MOST_FILES


def test_files_are_read_back_without_a_listing(spark, monkeypatch):
    def listing(*_):
        raise AssertionError("files are listed by the driver")

    monkeypatch.setattr(Q, "read_metadata", listing)
    rows = Q.files_read_back(spark, SF)
    assert rows.count() == sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("part", "customer"))
    assert rows.where("format IS NULL").count() == 0


RETURNED = {
    "cr3_edited": ("path", "format", "model", "iso", "copyright", "creator"), "heif_edited": ("path", "format", "make", "caption"), "keywords_edited": ("path", "creator", "keywords"),
    "heif_records": ("path", "format", "make", "model", "iso", "caption", "error"), "cr3_records": ("path", "format", "make", "model", "lens", "iso", "copyright"),
    "raw_edited": ("path", "format", "model", "lens", "orientation"), "raw_records": ("path", "format", "make", "model", "iso", "orientation"),
}


@pytest.mark.parametrize("name", sorted(RETURNED))
def test_no_field_is_read_that_the_query_does_not_return(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(Q, "flat_metadata", lambda images, *args, **more: asked.append(more["columns"]) or flat_metadata(images, *args, **more))
    assert sorted(Q.QUERIES[name](spark, SF).columns) == sorted(RETURNED[name])
    assert [fields_for(c) for c in asked] == [fields_for(RETURNED[name])]


HEAD = "<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description rdf:about='' xmlns:dc='http://purl.org/dc/elements/1.1/'{}>"
PACKETS = (
    HEAD.format("") + "<dc:a>{}</dc:a></rdf:Description></rdf:RDF></x:xmpmeta>", HEAD.format(" dc:own='x>y'") + "{}<dc:a>b</dc:a>", HEAD.format(" dc:open='") + "<dc:a>{}</dc:a>' dc:more='1'>",
    "<!-- " + HEAD.format("") + "<dc:a>no</dc:a> -->" + HEAD.format("") + "<dc:a>{}</dc:a>", HEAD.format("/") + "<dc:a>{}</dc:a>", "<? " + HEAD.format("") + "<dc:a>{}</dc:a> ?>", "{}<rdf:Description", "<rdf:Description>{}",
    HEAD.format("") + "<dc:s><rdf:Seq><rdf:li>{}</rdf:li><rdf:li xml:lang='de'>z</rdf:li></rdf:Seq></dc:s><rdf:Description dc:later='{}'/>",
    HEAD.format("").replace("<rdf:Description", "<dc:s><rdf:Seq><rdf:li>first</rdf:li><rdf:Description") + "<dc:a>{}</dc:a>", "{}", "",
)


def test_what_packets_begin_with_is_read_once_and_changes_nothing():
    def plainly(text):
        reader = X.Reader()
        reader.read(text)
        while reader.stack:
            reader.end()
        return reader.found

    X._begun.cache_clear()
    for form in PACKETS:
        for value in ("1", "", "a &amp; b", "two"):
            text = form.replace("{}", value)
            assert X.properties(text.encode()) == plainly(text), text
    before = X._begun.cache_info()
    for n in range(50):
        assert X.properties(PACKETS[0].format(n).encode()) == {("http://purl.org/dc/elements/1.1/", "a"): str(n)}
    assert X._begun.cache_info().misses == before.misses
    deep = HEAD.format("").replace("<rdf:Description", "<a>" * 120 + "<rdf:Description")
    for _ in range(2):
        with pytest.raises(ValueError):
            X.properties(deep.encode())


def test_instants_are_written_in_utc_whatever_the_session_s_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = spark.createDataFrame([("a", dt.datetime(2020, 7, 1, 12, 30, tzinfo=dt.timezone.utc)), ("b", None)], "path string, t timestamp")
        exif = B.exif([B.ascii_entry(0x010F, F.lit("m"))], [B.ascii_entry(0x9003, F.lit("2000:01:01 00:00:00"))])
        after = edit_metadata(rows.select("path", "t", B.jpeg(exif).alias("content")), {"captured_at": F.col("t")})
        got = flat_metadata(after, columns=("path", "captured_at")).select("path", F.unix_timestamp("captured_at")).collect()
        assert {tuple(r) for r in got} == {("a", 1593606600), ("b", 946684800)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("name, columns", [("priority_images", ("path", "caption", "make")), ("heif_images", ("path", "make", "caption")), ("cr3_images", ("path", "make", "copyright"))])
def test_images_whose_xmp_is_needed_are_walked_once(spark, monkeypatch, name, columns):
    rows, walks = getattr(Q, name)(spark, SF).select("content").limit(20).collect(), []
    monkeypatch.setattr(M, "opened", lambda *args: walks.append(args[0]) or opened(*args))
    fields = fields_for(columns)
    got = [M.record_of(r.content, BUILT_IN.format_of(r.content), frozenset(columns), fields, COMPONENTS) for r in rows]
    assert len(walks) == len(rows) == 20
    for own, r in zip(got, rows):
        found, _ = opened(r.content, BUILT_IN.format_of(r.content))
        assert own["make"] == M.exif_fields(found)["make"]
        assert {k: v for k, v in own.items() if k.startswith("x_")} == (M.xmp_fields(found["xmp"]) if "xmp" in found else {})


def test_damaged_xmp_leaves_what_is_read_without_it(spark):
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    exif = b"II*\0\x08\0\0\0\x01\0\x0f\x01\x02\0\x04\0\0\0abc\0\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"eXIf", exif) + chunk(b"iTXt", b"XML:com.adobe.xmp\0\1\0\0\0no zlib") + chunk(b"IEND", b"")
    columns = ("path", "make", "caption")
    own = M.record_of(png, "PNG", frozenset(columns), fields_for(columns), COMPONENTS)
    assert own["make"] == "abc" and own["failures"][0]["component"] == "container" and own["error"].startswith("Corrupt: compressed text")
    assert M.record_of(b"GIF89a", None, frozenset(columns), fields_for(columns), COMPONENTS)["error"].startswith("UnsupportedFormat")


def test_tables_of_items_are_read_once_a_worker(spark):
    contents = [r.content for r in Q.heif_images(spark, SF).select("content").limit(50).collect()]
    C._short_metadata_items.cache_clear()
    for content in contents:
        assert set(dict(C.heif(content))) == {"exif", "xmp"}
    assert C._short_metadata_items.cache_info().misses == 1


def test_items_of_one_kind_keep_their_order():
    def infe(item, kind):
        return b"\0\0\0\x16infe\x02\0\0\0" + item.to_bytes(2, "big") + b"\0\0" + kind + b"\0\0"

    body = b"\0\0\0\0\0\4" + infe(7, b"Exif") + infe(2, b"hvc1") + infe(9, b"Exif") + infe(3, b"Exif")
    assert C.metadata_items(body) == C._short_metadata_items(body) == ((9, "exif"), (7, "exif"), (3, "exif"))
    many = b"\0\0\0\0\1\0" + b"".join(infe(k, b"Exif") for k in range(1, 256))
    assert len(many) > C.MOST_KEPT and C.metadata_items(many)[-1] == (1, "exif")


class TagsAtOnce:
    """The pattern of tags, which looks for all of them at once and for no single one."""

    findall = X._TAG.findall


def test_tags_are_found_all_at_once_with_equal_properties(monkeypatch):
    texts = [form.replace("{}", v) for form in PACKETS for v in ("1", "a &amp; b", "two")]
    texts += [HEAD.format("") + f"<dc:a x='{'y>' * 3000}' z=\"{'w<' * 3000}\" {'v ' * 3000}>t</dc:a>", HEAD.format(" dc:q=\"never closed <dc:a>1</dc:a>")]

    def properties_by(read):
        reader = X.Reader()
        read(reader)
        while reader.stack:
            reader.end()
        return reader.found

    singly = [properties_by(lambda reader: reader.read_until(t, len(t))) for t in texts]
    monkeypatch.setattr(X, "MOST_AT_ONCE", 0)
    assert [properties_by(lambda reader: reader.read(t)) for t in texts] == singly
    monkeypatch.setattr(X, "MOST_AT_ONCE", 1 << 20)
    monkeypatch.setattr(X, "_TAG", TagsAtOnce)
    assert [properties_by(lambda reader: reader.read(t)) for t in texts] == singly


def test_components_that_are_not_asked_for_are_not_looked_for(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(FACTS, "facts_of", lambda found, components, registry: asked.append(components) or iter(()))
    monkeypatch.setattr(FACTS, "bounded", lambda images: images)

    class Images:
        def select(self, *_):
            return self

        def mapInArrow(self, parse, _):
            return list(parse(iter([pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([b"\xff\xd8\xff\xd9"], pa.binary())], ["path", "content"])])))

    assert [b.num_rows for b in FACTS.facts(Images(), ("xmp",))] == [1]
    assert asked == [("xmp",)]
