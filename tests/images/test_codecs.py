"""Readers and writers on bytes laid out by hand."""

import random
import struct

import pytest

from photonlake.functions.registry import NAMESPACES
from photonlake.operators.edit import edited
from photonlake.operators.exif import directories
from photonlake.operators.facts import COMPONENTS, facts, facts_of
from photonlake.operators.iptc import datasets_of
from photonlake.operators.makernote import makernote_entries
from photonlake.operators.metadata import flat_metadata
from photonlake.operators.xmp import properties
from photonlake.sources.containers import WALKERS, Damaged
from photonlake.sources.images import opened
from photonlake.sources.writers import encoded_iptc, encoded_xmp

TIFF = bytes.fromhex("49492A0008000000010000010400010000008002000000000000")
DC = NAMESPACES["dc"]


def packet(inner: str) -> bytes:
    head = "<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description rdf:about='' xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:p='urn:p'>"
    return (head + inner + "</rdf:Description></rdf:RDF></x:xmpmeta>").encode()


def heif(exif: bytes) -> bytes:
    def box(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I4s", len(data) + 8, kind) + data

    infe = box(b"infe", bytes((2, 0, 0, 0)) + struct.pack(">HH4s", 1, 0, b"Exif") + b"\0")
    iinf = box(b"iinf", bytes(4) + struct.pack(">H", 1) + infe)
    item = b"\0\0\0\0" + exif

    def whole(at: int) -> bytes:
        iloc = box(b"iloc", bytes(4) + b"\x44\x00" + struct.pack(">HHHHII", 1, 1, 0, 1, at, len(item)))
        return box(b"ftyp", b"heic" + bytes(4)) + box(b"meta", bytes(4) + iinf + iloc)

    return whole(len(whole(0)) + 8) + box(b"mdat", item)


def cr3(exif: bytes) -> bytes:
    uuid = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
    cmt = struct.pack(">I4s", len(exif) + 8, b"CMT1") + exif
    own = struct.pack(">I4s", len(cmt) + 24, b"uuid") + uuid + cmt
    return struct.pack(">I4s", 16, b"ftyp") + b"crx " + bytes(4) + struct.pack(">I4s", len(own) + 8, b"moov") + own + struct.pack(">I4s", 12, b"mdat") + b"data"


def test_directories_of_either_order():
    big = bytes.fromhex("4D4D002A00000008000101000004000000010000028000000000")
    assert [(e[2], e[6]) for b in (TIFF, big) for e in directories(b)] == [(256, "II"), (256, "MM")]


def test_a_chain_that_goes_in_circles_ends():
    looped = TIFF[:22] + (8).to_bytes(4, "little")
    assert len(list(directories(looped))) == 1


def test_iptc_extended_lengths_and_damage():
    long = "x" * 40_000
    block = encoded_iptc([(2, 120, long.encode()), (2, 25, b"a")])
    assert list(datasets_of(block)) == [(2, 120, long.encode()), (2, 25, b"a")]
    assert list(datasets_of(block[:-1])) == [(2, 120, long.encode())]


def test_xmp_lists_languages_structures_and_references():
    got = properties(packet("<dc:description><rdf:Alt><rdf:li xml:lang='x-default'>A &amp; B</rdf:li><rdf:li xml:lang='de'>C</rdf:li></rdf:Alt></dc:description><p:Info rdf:parseType='Resource'><p:Mail>m</p:Mail></p:Info>"))
    assert got == {(DC, "description"): "A & B\u001ede|C", ("urn:p", "Info.Mail"): "m"}
    assert properties(encoded_xmp(got, {DC: "dc"})) == got


def test_extended_xmp_of_a_jpeg_comes_back_whole():
    long = "word " * 40_000
    b = b"\xff\xd8\xff\xda\0\2\xff\xd9"
    from photonlake.sources.writers import jpeg_with

    made = jpeg_with(b, {"xmp": encoded_xmp({(DC, "rights"): long.strip()}, {DC: "dc"})})
    assert properties(opened(made, "JPEG")[0]["xmp"])[DC, "rights"] == long.strip()


@pytest.mark.parametrize(("form", "image"), [("TIFF", TIFF), ("HEIF", heif(TIFF)), ("CR3", cr3(TIFF)), ("ORF", b"IIRO" + TIFF[4:])])
def test_edits_keep_what_they_do_not_name(form, image):
    after = edited(image, form, {"caption": "new", "iso": 200, "latitude": -1.5, "longitude": 2.0})
    own = {(e[0], e[2]): e[5] for e in directories(opened(after, form)[0]["exif"])}
    assert own["ifd0", 0x0100] == bytes.fromhex("80020000") and own["ifd0", 0x010E] == b"new\0"
    assert own["exif", 0x8827] == b"\xc8\0" and own["gps", 1] == b"S\0"
    if form != "TIFF":
        assert after[-4:] == image[-4:] or b"data" in after or form in ("HEIF", "ORF")


def test_makernotes_by_their_layouts():
    canon = bytes.fromhex("0200" "0100" "0300" "01000000" "05000000" "0600" "0300" "01000000" "07000000")
    assert makernote_entries("Canon", canon) == {1: b"\5\0", 6: b"\7\0"}
    nikon = b"Nikon\0\2\x10" + b"II*\0\x08\0\0\0" + canon
    assert makernote_entries("NIKON CORPORATION", nikon) == {1: b"\5\0", 6: b"\7\0"}
    fuji = b"FUJIFILM0100" + (16).to_bytes(4, "little") + canon
    assert makernote_entries("FUJIFILM", fuji) == {1: b"\5\0", 6: b"\7\0"}
    assert makernote_entries("canon", canon) == {}


def test_random_bytes_raise_nothing_but_damage():
    heads = {"JPEG": b"\xff\xd8\xff\xe1", "PNG": b"\x89PNG\r\n\x1a\n", "WebP": b"RIFF\0\0\0\0WEBP", "HEIF": heif(TIFF)[:60], "CR3": cr3(TIFF)[:50], "TIFF": b"II*\0\x08\0\0\0"}
    r = random.Random(1)
    for k in range(1500):
        form = r.choice(list(heads))
        b = heads[form] + r.randbytes(r.randrange(120))
        try:
            list(facts_of(dict(WALKERS[form](b)), COMPONENTS))
        except Damaged:
            pass


def test_null_empty_and_repeated_images(spark):
    rows = spark.createDataFrame([("a", bytearray(TIFF), 1), ("b", None, 2), ("c", bytearray(b""), 3), ("a", bytearray(TIFF), 4)], "path string, content binary, format long")
    got = {r.path: (r.format, r.error) for r in flat_metadata(rows).collect()}
    assert got == {"a": ("TIFF", None), "b": (None, "EmptyInput"), "c": (None, "EmptyInput")}
    assert flat_metadata(rows.limit(0)).count() == 0
    assert facts(rows).where("kind = 'exif'").count() == 2
