"""Files of which ranges are read, the columns that decide which, and formats that a session registers."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from photonlake.functions.image import image_format
from photonlake.operators.facts import facts
from photonlake.operators.metadata import NEEDS, RECORD_COLUMNS, decoded_files, fields_for, files_metadata, flat_metadata, read_metadata
from photonlake.plans.queries import MAGICS
from photonlake.sources import ranges
from photonlake.sources.containers import KINDS, WALKERS, heif
from photonlake.sources.formats import BUILT_IN, Registry, sniffed
from photonlake.sources.ranges import Ranges

from .test_edges import jpeg, little, packet

BIG = 400_000
MAKE = little([(0x010F, 2, 4, b"Acm\0")])


def box(kind, data):
    return struct.pack(">I4s", len(data) + 8, kind) + data


def chunk(kind, data):
    return struct.pack(">I4s", len(data), kind) + data + b"\0\0\0\0"


def heif_file(where=(), items=MAKE):
    """An Exif item behind image data, the meta box inside the boxes named."""
    info = box(b"iinf", b"\0\0\0\0\0\1" + box(b"infe", b"\2\0\0\0\0\1\0\0Exif\0"))
    data = b"\0\0\0\0" + items

    def head(at):
        out = box(b"meta", b"\0\0\0\0" + info + box(b"iloc", b"\0\0\0\0\x44\0\0\1" + struct.pack(">HHH", 1, 0, 1) + struct.pack(">II", at, len(data))))
        for name in reversed(where):
            out = box(b"free", b"") + box(name, (box(b"trak", b"") if name == b"moov" else b"") + out)
        return box(b"ftyp", b"heic\0\0\0\0") + out

    return head(len(head(0)) + 8 + BIG) + box(b"mdat", bytes(BIG) + data)


FILES = {
    "a.jpg": jpeg(MAKE, packet("tiff:Model='M'/>"))[:-2] + bytes(BIG), "b.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", bytes(BIG)) + chunk(b"eXIf", MAKE) + chunk(b"IEND", b""),
    "c.webp": b"RIFF\0\0\0\0WEBP" + b"VP8 " + struct.pack("<I", BIG) + bytes(BIG) + b"EXIF" + struct.pack("<I", len(MAKE)) + MAKE, "d.heic": heif_file(),
    "e.tif": b"II*\0" + struct.pack("<I", BIG) + bytes(BIG - 8) + MAKE[8:], "f.orf": b"IIRO" + MAKE[4:] + bytes(BIG),
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.jpg").write_bytes(FILES["a.jpg"])
    return tmp_path


class File:
    def __init__(self, data):
        self.data, self.calls = data, []

    def read_at(self, n, at):
        self.calls.append((at, n))
        return self.data[at : at + n]


def test_ranges_are_the_bytes():
    import random

    rng = random.Random(5)
    data = rng.randbytes(50_000)
    for _ in range(20):
        file = File(data)
        r = Ranges(file, len(data))
        for _ in range(30):
            a, n = rng.randrange(52_000), rng.choice((0, 1, 8, 5000))
            assert r[a : a + n] == data[a : a + n]
        assert r[49_999] == data[49_999] and bytes(r) == data
        assert sum(n for _, n in file.calls) == len(data) == r.fetched  # nothing twice
    r = Ranges(File(data), len(data)).headed(b"II*\0")
    assert r[:6] == b"II*\0" + data[4:6] and r[2:3] == b"*" and r[3:9] == b"\0" + data[4:9] and r[7:9] == data[7:9]


def test_fetches_grow_while_reads_go_on():
    file = File(bytes(4 << 20))
    r = Ranges(file, 4 << 20)
    for at in range(0, 1 << 19, 512):
        assert len(r[at : at + 512]) == 512
    assert len(file.calls) < 10
    r[4_000_000:4_000_004]
    assert file.calls[-1] == (4_000_000, ranges.LEAST)


@pytest.mark.parametrize("name", sorted(FILES))
def test_ranges_and_bytes_are_walked_alike(name):
    data = FILES[name]
    form = sniffed(data)
    own = {k: bytes(v) for k, v in WALKERS[form](Ranges(File(data), len(data)))}
    assert own == dict(WALKERS[form](data)) and "exif" in own
    for kind in KINDS:
        assert {k: bytes(v) for k, v in WALKERS[form](Ranges(File(data), len(data)), frozenset((kind,)))} == {k: v for k, v in own.items() if k == kind}


def test_under_five_hundredths_of_the_bytes_are_read(spark, folder):
    columns = ("path", "format", "make", "model", "length", "bytes_read", "error")
    rows = {os.path.basename(r.path): r for r in read_metadata(spark, f"file://{folder}", columns).collect()}
    assert {n: (r.format, r.make, r.error) for n, r in rows.items()} == {n: (sniffed(d), "Acm", None) for n, d in FILES.items()}
    assert all(r.length == len(FILES[n]) and r.bytes_read < 0.05 * r.length for n, r in rows.items())
    contents = spark.createDataFrame([(f"file://{folder}/{n}", d) for n, d in FILES.items()], "path string, content binary")
    own = [c for c in RECORD_COLUMNS]
    assert sorted(map(str, read_metadata(spark, str(folder)).select("*").collect())) == sorted(map(str, flat_metadata(contents).collect()))
    assert sorted(map(str, files_metadata(contents.select("path")).select(own).collect())) == sorted(map(str, flat_metadata(contents).collect()))
    assert [os.path.basename(r.path) for r in read_metadata(spark, str(folder), ("path",), ("png",)).collect()] == ["b.png"]


def test_files_that_cannot_be_opened(spark, tmp_path):
    (tmp_path / "empty.jpg").write_bytes(b"")
    rows = spark.createDataFrame([(str(tmp_path / "gone.jpg"), 5), (None, None), (str(tmp_path / "empty.jpg"), 0)], "path string, length long")
    got = {str(r.path).rpartition("/")[2]: r for r in files_metadata(rows, ("path", "error", "failures", "make")).collect()}
    assert got["gone.jpg"].error.startswith("Unreadable") and got["gone.jpg"].failures[0].component == "file" and got["None"].error.startswith("Unreadable") and got["empty.jpg"].error == "EmptyInput"
    assert files_metadata(rows, ("path",), mode="DROPMALFORMED").count() == 0
    (tmp_path / "none").mkdir()
    assert read_metadata(spark, str(tmp_path / "none")).count() == 0


def test_columns_decide_what_is_parsed(spark, folder, monkeypatch):
    assert fields_for(("make",)) == ["make", "x_make"] and set(RECORD_COLUMNS) <= set(NEEDS)
    with pytest.raises(ValueError):
        fields_for(("nothing",))
    plan = flat_metadata(spark.createDataFrame([("p", b"")], "path string, content binary"), columns=("make",))._jdf.queryExecution().executedPlan().toString()
    assert "x_make" in plan and "x_model" not in plan and "iso" not in plan
    parsed = []
    monkeypatch.setattr("photonlake.operators.metadata.xmp_fields", lambda b, fields: parsed.append(b) or {"x_make": "from xmp"})
    files = [(f"file://{folder}/a.jpg", None)]
    assert next(decoded_files(files, ("make",))).to_pydict()["make"] == ["Acm"] and not parsed  # EXIF has it
    next(decoded_files(files, ("iso", "width")))
    assert not parsed
    next(decoded_files(files, ("caption",)))
    next(decoded_files(files, ("make", "error")))
    assert len(parsed) == 2
    (folder / "bare.jpg").write_bytes(jpeg(little([(0x0112, 3, 1, b"\1\0\0\0")]), packet("tiff:Make='X'/>")))
    assert next(decoded_files([(str(folder / "bare.jpg"), None)], ("make",))).to_pydict()["x_make"] == ["from xmp"] and len(parsed) == 3


def test_values_that_no_column_needs_are_not_read():
    far = 300_000
    block = b"II*\0\x08\0\0\0" + struct.pack("<HHHI4sHHII", 2, 0x010F, 2, 4, b"Acm\0", 0x927C, 7, 100_000, far) + b"\0\0\0\0"
    data = block + bytes(far + 100_000 - len(block))
    file = File(data)
    from photonlake.operators.metadata import exif_fields

    assert exif_fields({"exif": Ranges(file, len(data))}, ("make",))["make"] == "Acm" and sum(n for _, n in file.calls) <= ranges.LEAST


def test_heif_meta_at_any_depth():
    for where in ((), (b"moov",), (b"moov", b"udta"), (b"moov", b"trak"), (b"moov", b"trak", b"udta"), (b"moov", b"trak", b"mdia", b"minf")):
        assert dict(heif(heif_file(where)))["exif"] == MAKE, where
    deep = heif_file((b"moov",) + (b"trak",) * 40)
    assert dict(heif(deep)) == {}


def test_both_ways_of_telling_formats_agree(spark):
    heads = [bytes.fromhex(h) for h, _ in MAGICS] + list(FILES.values()) + [b"", b"\xff", b"II*\0", b"MM\0*\0\0\0\x08\0\0", b"RIFF\0\0\0\0WEB", b"\0\0\0\x18ftypav01", b"II*\0\xff\xff\xff\xff\0\0"]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, content binary").select("k", image_format(F.col("content")).alias("f")).collect()
    assert [r.f for r in sorted(rows)] == [sniffed(h) for h in heads]


def test_a_registered_format_and_a_registered_maker(spark, tmp_path):
    def walk(b, kinds):
        if "exif" in kinds:
            yield "exif", b[8 : 8 + int.from_bytes(b[4:8], "big")]

    registry = Registry().with_format("RAWX", [(0, b"RAWX")], walk).with_notes("Acm", lambda make, note, order: {1: note[:2], 2: note[2:]})
    block = little([(0x010F, 2, 4, b"Acm\0")])
    data = b"RAWX" + len(block).to_bytes(4, "big") + block
    rows = spark.createDataFrame([("x", data), ("j", jpeg(MAKE))], "path string, content binary")
    got = {r.path: (r.format, r.make, r.error) for r in flat_metadata(rows, registry=registry).collect()}
    assert got == {"x": ("RAWX", "Acm", None), "j": ("JPEG", "Acm", None)}
    assert {r.path: r.error.split(":")[0] for r in flat_metadata(rows).where("error IS NOT NULL").collect()} == {"x": "UnsupportedFormat"}
    (tmp_path / "x.rawx").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "x.rawx"),)], "path string")
    assert files_metadata(files, ("format", "make"), registry=registry).first()[:] == ("RAWX", "Acm")
    inner = struct.pack("<HHHI4s", 1, 0x927C, 7, 4, b"abcd") + b"\0\0\0\0"
    top = b"II*\0\x08\0\0\0" + struct.pack("<HHHI4sHHII", 2, 0x010F, 2, 4, b"Acm\0", 0x8769, 4, 1, 38) + b"\0\0\0\0" + inner
    noted = spark.createDataFrame([("n", jpeg(top))], "path string, content binary")
    assert {(r.item, bytes(r.value)) for r in facts(noted, ("exif", "makernote"), registry).where("kind = 'makernote'").collect()} == {(1, b"ab"), (2, b"cd")}
    assert facts(noted, ("exif", "makernote")).where("kind = 'makernote'").count() == 0
    with pytest.raises(ValueError):
        Registry().with_format("none", [], walk)
    assert BUILT_IN.format_of(data) is None


def test_a_bad_component_leaves_the_others(spark):
    deep = jpeg(MAKE, packet(">" + "<dc:a>" * 200))
    long = b"\x1c\2\x78\0\3abc" + b"\x1c\2\x78\x80\4" + (2 << 20).to_bytes(4, "big") + bytes(2 << 20)
    block = b"Photoshop 3.0\x008BIM\x04\x04\0\0" + struct.pack(">I", len(long)) + long
    rows = spark.createDataFrame([("deep", deep), ("gif", b"GIF89a-and-more"), ("none", None), ("cut", b"\x89PNG\r\n\x1a\n\0\0")], "path string, content binary")
    got = {r.path: r for r in flat_metadata(rows, columns=("path", "make", "error", "failures")).collect()}
    assert got["deep"].make == "Acm" and got["deep"].error.startswith("Corrupt: xmp: ") and [(f.component, f.kind) for f in got["deep"].failures] == [("xmp", "Corrupt")]
    assert got["gif"].failures[0].magic == b"GIF89a-and-m" and got["gif"].failures[0].kind == "UnsupportedFormat" and got["none"].failures[0].kind == "EmptyInput"
    assert got["cut"].failures[0].component == "container"
    assert {r.path: r.make for r in flat_metadata(rows, columns=("path", "make")).collect()}["deep"] == "Acm"
    from photonlake.operators.metadata import record_of

    own = {"iptc": long}
    record = record_of(b"x", "T", frozenset(("caption", "error")), fields_for(("caption", "error")), ("iptc",), Registry().with_format("T", [(0, b"x")], lambda b, kinds: iter(own.items())))
    assert record["i_caption"] == "abc" and record["error"] == "Corrupt: iptc: a dataset of over 1048576 bytes" and len(block) > 0


def test_places_beyond_any_file_do_not_stop_a_job(spark):
    make = struct.pack("<HHHII", 1, 0x010F, 2, 40, 0xFFFFFFF0) + b"\0\0\0\0"
    heads = [b"II*\0\xff\xff\xff\xff" + bytes(40), b"MM\0*\xff\xff\xff\xff" + bytes(40), b"II*\0\x08\0\0\0" + make, b"II*\0\xfe\xff\xff\x7f\0\0"]
    rows = spark.createDataFrame([(str(k), h) for k, h in enumerate(heads)], "path string, content binary")
    assert {r.format for r in flat_metadata(rows).collect()} == {"TIFF"} == {sniffed(h) for h in heads}
