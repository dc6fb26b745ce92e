"""Awkward images and edits: repeated and null paths, limits, values that no field holds, notes of each maker, error modes."""

import math
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from photonlake.functions.registry import NAMESPACES
from photonlake.operators.edit import edit_metadata, edited, edited_iptc, edited_xmp
from photonlake.operators.exif import directories
from photonlake.operators.facts import facts
from photonlake.operators.iptc import datasets_of
from photonlake.operators.makernote import MAKES, makernote_directory
from photonlake.operators.metadata import NO_DIRECTORY, flat_metadata, validated
from photonlake.operators.xmp import MOST_DEPTH, properties
from photonlake.sources.containers import WALKERS, Damaged, heif, inflated
from photonlake.sources.writers import encoded_xmp, heif_with

DC, TIFF_NS = NAMESPACES["dc"], NAMESPACES["tiff"]


def little(entries):
    """A little-endian TIFF block of one directory with inline values."""
    return b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI4s", t, k, n, v) for t, k, n, v in entries) + b"\0\0\0\0"


def jpeg(exif=None, xmp=None):
    def segment(data):
        return b"\xff\xe1" + struct.pack(">H", len(data) + 2) + data

    return b"\xff\xd8" + (segment(b"Exif\0\0" + exif) if exif else b"") + (segment(b"http://ns.adobe.com/xap/1.0/\0" + xmp) if xmp else b"") + b"\xff\xda\0\2\xff\xd9"


def packet(inner):
    return f"<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description xmlns:dc='{DC}' xmlns:tiff='{TIFF_NS}' {inner}</rdf:RDF>".encode()


def test_every_row_is_an_image_whatever_its_path(spark):
    one, two = jpeg(little([(0x0110, 2, 3, b"A1\0\0")])), jpeg(little([(0x0110, 2, 3, b"B2\0\0")]))
    rows = spark.createDataFrame([(None, one), (None, two), ("p", one), ("p", two), ("e", b""), ("n", None)], "path string, content binary")
    got = sorted((str(r.path), str(r.model), (r.error or "").split(":")[0]) for r in flat_metadata(rows).collect())
    assert got == [("None", "A1", ""), ("None", "B2", ""), ("e", "None", "EmptyInput"), ("n", "None", "EmptyInput"), ("p", "A1", ""), ("p", "B2", "")]
    assert "Exchange" not in flat_metadata(rows)._jdf.queryExecution().executedPlan().toString()
    assert flat_metadata(rows.limit(0)).count() == 0


@pytest.mark.parametrize("inner, want", [
    ("tiff:Model='&#;'/>", {(TIFF_NS, "Model"): "&#;"}), ("tiff:Model='x&#xGG;'/>", {(TIFF_NS, "Model"): "x"}), ("tiff:Model='&amp;&#65;&nope;'/>", {(TIFF_NS, "Model"): "&A&nope;"}),
    ("><tiff:Make>A&#;B</tiff:Make><tiff:Model>M", {(TIFF_NS, "Make"): "A&#;B", (TIFF_NS, "Model"): "M"}),
    ("><q:Make>A</q:Make><tiff:Model>M</wrong></rdf:Description>", {("", "Make"): "A", (TIFF_NS, "Model"): "M"}),
    ("><!-- <dc:x>n</dc:x> --><?pi <dc:y>?><dc:z>v</dc:z>", {(DC, "z"): "v"}), ("x=unquoted tiff:Model='M' tiff:Make=\"N", {(TIFF_NS, "Model"): "M"}),
    ("><dc:subject><rdf:Bag><rdf:li>a</rdf:li><rdf:li/><rdf:li>b</rdf:li></rdf:Bag></dc:subject>", {(DC, "subject"): "a\x1eb"}),
    ("><dc:d><rdf:Alt><rdf:li xml:lang='x-default'>t</rdf:li><rdf:li xml:lang='de'>u</rdf:li></rdf:Alt></dc:d>", {(DC, "d"): "t\x1ede|u"}),
    ("><dc:c rdf:parseType='Resource'><dc:m>v</dc:m></dc:c><dc:s><rdf:Description><dc:i>w</dc:i></rdf:Description></dc:s>", {(DC, "c.m"): "v", (DC, "s.i"): "w"}),
])
def test_untidy_packets(inner, want):
    got = properties(packet(inner))
    assert {k: v for k, v in got.items() if k in want} == want


def test_random_bytes_never_raise():
    import random

    rng = random.Random(1)
    alphabet = [b"<", b">", b"/", b"'", b'"', b"=", b"&#", b";", b"rdf:Description", b"dc:x", b"rdf:li", b" ", b"xmlns:dc", b"<!--", b"?>", b"\xff"]
    for _ in range(500):
        properties(b"".join(rng.choice(alphabet) for _ in range(60)))
        datasets = list(datasets_of(rng.randbytes(80)))
        assert all(r < 10 for r, _, _ in datasets)


def test_nesting_has_a_limit_that_the_row_names(spark):
    deep = jpeg(None, packet(">" + "<dc:a>" * (MOST_DEPTH + 1)))
    rows = spark.createDataFrame([("d", deep)], "path string, content binary")
    assert "nested" in flat_metadata(rows).first().error and "nested" in facts(rows).where("kind = 'head'").first().error


def test_inflating_has_a_limit_and_an_end():
    data = zlib.compress(b"x" * 5000)
    assert inflated(data, 5000) == b"x" * 5000
    for bad, most in ((data, 4999), (data[:-6], 5000), (b"junk", 5000)):
        with pytest.raises(Damaged):
            inflated(bad, most)


def test_values_that_no_field_holds(spark):
    images = spark.createDataFrame([("a", jpeg(little([(0x0112, 3, 1, b"\1\0\0\0")])))], "path string, content binary")
    for fields in ({"f_number": F.lit(math.nan)}, {"f_number": F.lit(math.inf)}, {"orientation": F.lit(-1)}, {"focal_length_mm": F.lit(1e12)}):
        row = edit_metadata(images, fields).first()
        assert row.error and not row.changed and row.content == images.first().content


def test_added_keywords_and_properties():
    own = encoded_xmp({(DC, "subject"): "a\x1eb", ("urn:x", "p"): "old"}, {DC: "dc"})
    got = properties(edited_xmp(own, {"add_keywords": ["c"], "properties": [{"ns": "urn:x", "local": "p", "value": "new"}, {"ns": "urn:y", "local": "q", "value": "z"}]}))
    assert got == {(DC, "subject"): "a\x1eb\x1ec", ("urn:x", "p"): "new", ("urn:y", "q"): "z"}
    assert [v for *_, v in datasets_of(edited_iptc(b"\x1c\2\x19\0\1a", {"add_keywords": ["b"]}))] == [b"a", b"b"]


def test_maker_directories():
    entry = struct.pack("<HHIHH", 2, 3, 1, 9, 0)
    small = struct.pack("<H", 1) + entry + b"\0\0\0\0"
    big = struct.pack(">HHHIHHI", 1, 2, 3, 1, 9, 0, 0)
    notes = {
        "NIKON CORPORATION": b"Nikon\0\2\x10MM\0*\0\0\0\x08" + big, "FUJIFILM": b"FUJIFILM0130\x10\0\0\0" + small, "Olympus": b"OLYMPUS\0II\3\0" + small, "RICOH": b"AOC\0MM" + big,
        "PENTAX Corporation": b"PENTAX \0II\0\0" + small, "Panasonic": b"Panasonic\0\0\0" + small, "Leica": b"LEICA\0\0\0" + small, "SIGMA": b"FOVEON\0\0\1\0" + small,
    }
    for make, note in notes.items():
        (tag, kind, count, value, order), = makernote_directory(make, note, "MM")
        assert (tag, kind, count, int.from_bytes(value[:2], "little" if order == "II" else "big")) == (2, 3, 1, 9), make
    for make in ("Canon", "SONY", "DJI", "SAMSUNG", "CASIO", "Unknown"):
        assert makernote_directory(make, small, "II") == []
    assert len(MAKES) == 22


def test_heif_items_in_pieces_are_not_edited():
    def box(kind, data):
        return struct.pack(">I4s", len(data) + 8, kind) + data

    exif = b"\0\0\0\0" + little([(0x0112, 3, 1, b"\1\0\0\0")])
    info = box(b"iinf", b"\0\0\0\0\0\1" + box(b"infe", b"\2\0\0\0\0\1\0\0Exif\0"))

    def file(extents):
        def place(at):
            each = [at] * extents
            return box(b"iloc", b"\0\0\0\0\x44\0\0\1" + struct.pack(">HHH", 1, 0, extents) + b"".join(struct.pack(">II", x, len(exif)) for x in each))

        head = lambda at: box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0\0\0\0" + info + place(at))
        return head(len(head(0)) + 8) + box(b"mdat", exif)

    assert dict(heif(file(1)))["exif"] == exif[4:] and dict(heif(heif_with(file(1), {"exif": b"new"})))["exif"] == b"new"
    with pytest.raises(Damaged):
        heif_with(file(2), {"exif": b"new"})


def test_error_modes(spark):
    rows = spark.createDataFrame([("good", jpeg(little([(0x0112, 3, 1, b"\1\0\0\0")]))), ("bad", b"\x89PNG\r\n\x1a\n\0\0")], "path string, content binary")
    assert {r.path for r in flat_metadata(rows, mode="DROPMALFORMED").collect()} == {"good"}
    assert flat_metadata(rows).count() == 2
    with pytest.raises(PySparkException):
        flat_metadata(rows, mode="FAILFAST").collect()
    problems = {r.path: r.problem for r in validated(rows.unionByName(spark.createDataFrame([("none", jpeg(b"II*\0\xff\0\0\0"))], rows.schema))).collect()}
    assert problems["good"] is None and problems["bad"].startswith("Corrupt") and problems["none"] == NO_DIRECTORY


def test_edits_keep_what_they_do_not_name():
    block = little([(0x0110, 2, 3, b"A1\0\0"), (0x0112, 3, 1, b"\1\0\0\0")])
    new = dict(WALKERS["JPEG"](edited(jpeg(block), "JPEG", {"orientation": 6})))["exif"]
    assert {t: v for _, _, t, _, _, v, _ in directories(new)} == {0x0110: b"A1\0", 0x0112: b"\6\0"} and len(new) == len(block)
