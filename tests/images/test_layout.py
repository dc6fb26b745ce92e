"""EXIF laid out anew, and TIFF files that edits do not make grow."""

import random
import struct

import pytest

from photonlake.operators.edit import edited
from photonlake.operators.exif import directories
from photonlake.sources.containers import WALKERS, Damaged, patched
from photonlake.sources.layout import Unplaceable, laid_out
from photonlake.sources.writers import edited_exif, edited_tiff

from .test_edges import jpeg


def block(order="<", note_at=None, thumbnail=b"", extra=b""):
    """A block with all directories, a MakerNote and, if given, a thumbnail; values stand after their directories."""
    pack = lambda f, *x: struct.pack(order + f, *x)
    parts, at = [b"II*\0" if order == "<" else b"MM\0*", b""], 8
    offsets = {}

    def add(name, data):
        nonlocal at
        offsets[name] = at
        parts.append(data)
        at += len(data)

    def table(entries, after=0):
        return pack("H", len(entries)) + b"".join(pack("HHI", t, k, n) + (v if isinstance(v, bytes) else pack("I", v)) for t, k, n, v in entries) + pack("I", after)

    add("dead", extra)
    add("make", b"A long make\0")
    if note_at:
        add("gap", bytes(note_at - at))
    add("note", b"note that counts from the start")
    add("lens", b"Lens name\0")
    add("lat", pack("IIIIII", 1, 1, 2, 1, 3, 1))
    add("thumbnail", thumbnail)
    add("interop", table([(1, 2, 4, b"R98\0")]))
    add("gps", table([(1, 2, 2, b"N\0\0\0"), (2, 5, 3, offsets["lat"])]))
    add("exif", table([(0x8827, 3, 1, pack("HH", 100, 0)), (0x927C, 7, 31, offsets["note"]), (0xA005, 4, 1, offsets["interop"]), (0xA434, 2, 10, offsets["lens"])]))
    add("ifd1", table([(0x0201, 4, 1, offsets["thumbnail"]), (0x0202, 4, 1, len(thumbnail))] if thumbnail else [(0x0103, 3, 1, pack("HH", 6, 0))]))
    add("ifd0", table([(0x010F, 2, 12, offsets["make"]), (0x0112, 3, 1, pack("HH", 1, 0)), (0x8769, 4, 1, offsets["exif"]), (0x8825, 4, 1, offsets["gps"])], offsets["ifd1"]))
    parts[1] = pack("I", offsets["ifd0"])
    return b"".join(parts), offsets


def content(b):
    """Everything that a block says, without where it stands."""
    order = "little" if b[:2] == b"II" else "big"
    out = {}
    for ifd, k, tag, kind, count, value, mark in directories(b):
        if tag not in (0x8769, 0x8825, 0xA005, 0x0201):
            out[ifd, k, tag] = (kind, count, value)
        if tag == 0x0201:
            size = next(int.from_bytes(v, order) for i, j, t, _, _, v, _ in directories(b) if (i, j, t) == (ifd, k, 0x0202))
            at = int.from_bytes(value, order)
            out[ifd, k, tag] = b[at : at + size]
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("note_at", [None, 300])
def test_nothing_but_the_change_is_lost(order, note_at):
    b, offsets = block(order, note_at, b"\xff\xd8thumbnail\xff\xd9", bytes(50))
    new = laid_out(b, {"ifd0": {0x8298: (2, 9, b"(c) name\0")}, "exif": {0xA434: (2, 3, b"L2\0")}, "gps": {4: (5, 3, bytes(range(24)))}})
    want = content(b) | {("ifd0", 0, 0x8298): (2, 9, b"(c) name\0"), ("exif", 0, 0xA434): (2, 3, b"L2\0")}
    got = content(new)
    lat = got.pop(("gps", 0, 4))
    assert got == want and lat[:2] == (5, 3) and struct.unpack(order + "6I", lat[2]) == struct.unpack(">6I", bytes(range(24)))
    note = next(v for i, _, t, _, _, v, _ in directories(new) if t == 0x927C)
    assert new[offsets["note"] : offsets["note"] + 31] == note == b"note that counts from the start"  # in its place


def test_no_dead_bytes_and_no_growth():
    b, _ = block(extra=bytes(1000), thumbnail=b"\xff\xd8" + bytes(100) + b"\xff\xd9")
    without = next(x for x in [block(thumbnail=b"\xff\xd8" + bytes(100) + b"\xff\xd9")[0]])
    once = laid_out(without, {"ifd0": {0x0112: (3, 1, b"\0\2")}})
    assert len(once) <= len(without) + 8
    image = jpeg(b)
    for k in range(10):
        image = edited(image, "JPEG", {"orientation": k % 8 + 1, "copyright": f"number {k}", "iso": k, "latitude": 1.0 + k, "longitude": 2.0})
        size = size if k else len(image)  # noqa: F821
        assert len(image) == size
    own = dict(WALKERS["JPEG"](image))["exif"]
    assert content(own)["ifd0", 0, 0x8298] == (2, 9, b"number 9\0")
    again = laid_out(own, {"ifd0": {0x0112: (3, 1, b"\0\1")}})
    assert len(again) == len(own)


def tiff_file(order="<"):
    """Image data before and after a directory that addresses it."""
    pack = lambda f, *x: struct.pack(order + f, *x)
    head = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 508)
    rows = [(0x0110, 2, 9, pack("I", 600)), (0x0111, 4, 2, pack("I", 620)), (0x0117, 4, 2, pack("I", 628))]
    table = pack("H", len(rows)) + b"".join(pack("HHI", t, k, n) + v for t, k, n, v in rows) + pack("I", 0)
    return (head + bytes([7] * 500) + table).ljust(600, b"\0") + b"A camera\0".ljust(20, b"\0") + pack("II", 8, 636) + pack("II", 500, 300) + bytes([9] * 300)


@pytest.mark.parametrize("order", ["<", ">"])
def test_ten_edits_of_a_file(order):
    start = tiff_file(order)
    b, sizes = start, []
    for k in range(10):
        b = edited_tiff(b, {"ifd0": {0x0110: (2, 20, f"camera number {k}".encode().ljust(20, b"\0"))}, "exif": {0x8827: (3, 1, bytes((0, k)))}, **({"gps": {1: (2, 2, b"N\0")}} if k == 3 else {})})
        sizes.append(len(b))
        assert b[8:636] == start[8:636] and b[636:936] == start[636:936]
    assert sizes[1:3] == sizes[:2] and len(set(sizes[4:])) == 1 and sizes[-1] < sizes[0] + 60
    tags = {(i, t): v for i, _, t, _, _, v, _ in directories(b)}
    assert tags["ifd0", 0x0110].rstrip(b"\0") == b"camera number 9" and tags["exif", 0x8827] == struct.pack(order + "H", 9) and tags["gps", 1] == b"N\0"
    assert struct.unpack(order + "II", tags["ifd0", 0x0111]) == (8, 636)
    orf = b"IIRO" + tiff_file()[4:]
    assert edited_tiff(orf, {"ifd0": {0x0112: (3, 1, b"\0\3")}})[:4] == b"IIRO"
    assert {t for _, _, t, *_ in directories(patched(edited_tiff(orf, {"ifd0": {0x0112: (3, 1, b"\0\3")}})))} == {0x0110, 0x0111, 0x0112, 0x0117}


def test_blocks_that_are_not_moved():
    data = tiff_file()
    with pytest.raises(Unplaceable):
        laid_out(data, {"ifd0": {0x0112: (3, 1, b"\0\3")}})
    assert edited_exif(data, {"ifd0": {0x0112: (3, 1, b"\0\3")}})[636:936] == data[636:936]
    loop = b"II*\0\x08\0\0\0" + struct.pack("<HHHIII", 1, 0x8769, 4, 1, 8, 0)
    with pytest.raises(Unplaceable):
        laid_out(loop, {})
    cut = b"II*\0\x08\0\0\0" + struct.pack("<HHHIII", 1, 0x010F, 2, 99, 9999, 0)
    with pytest.raises(Unplaceable):
        laid_out(cut, {})
    for bad in (b"", b"II*\0", b"xx*\0\x08\0\0\0"):
        with pytest.raises(Damaged):
            edited_exif(bad, {"ifd0": {0x0112: (3, 1, b"\0\3")}})


def test_random_edits_against_a_model():
    r = random.Random(11)
    for _ in range(60):
        b, _ = block(r.choice("<>"), r.choice((None, 200, 700)), bytes(r.randrange(90)), bytes(r.randrange(99)))
        want = content(b)
        for _ in range(4):
            tag, value = r.choice((0x010F, 0x010E, 0x8298)), bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40))) + b"\0"
            lens = bytes(r.choice(b"xyz") for _ in range(r.randrange(1, 20))) + b"\0"
            b = laid_out(b, {"ifd0": {tag: (2, len(value), value)}, "exif": {0xA434: (2, len(lens), lens)}})
            want |= {("ifd0", 0, tag): (2, len(value), value), ("exif", 0, 0xA434): (2, len(lens), lens)}
            assert content(b) == want
