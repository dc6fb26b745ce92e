"""Where the metadata of one image stands: a small walker for each container family.

A walker yields (kind, payload) for the kinds that are asked for; of payloads of one kind the last counts. Kinds: exif,
exif_ifd (the directory that CR3 keeps apart), iptc and xmp. Reading no more than this is left to Python; types, names,
grouping and priorities are Spark's.

Files come as bytes or as ranges.Ranges, which fetches what is indexed: walkers take slices and lengths, nothing else.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Container, Iterator
from functools import lru_cache
from operator import itemgetter

#: Markers of metadata in JPEG, PNG and ISO containers.
XMP_URI = b"http://ns.adobe.com/xap/1.0/\x00"
XMP_MORE_URI = b"http://ns.adobe.com/xmp/extension/\x00"
PNG_XMP = b"XML:com.adobe.xmp"
CANON = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
MOST_INFLATED = 64 << 20
MOST_ITEM = 256 << 20

Found = Iterator[tuple[str, bytes]]
KINDS = frozenset(("exif", "exif_ifd", "iptc", "xmp"))


class Damaged(ValueError):
    """The container cannot be read to the end; what stands before is kept only where its format says so."""


def jpeg_segments(b: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end of the payload) up to the image data. A file that ends early ends the walk."""
    at, end = 2, len(b)
    while at + 4 <= end and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        else:
            size = int.from_bytes(b[at + 2 : at + 4], "big")
            if marker in (0xD9, 0xDA) or size < 2 or at + 2 + size > end:
                return
            yield marker, at + 4, at + 2 + size
            at += 2 + size


def resource_iptc(b: bytes) -> bytes | None:
    """The IPTC block among Photoshop image resources."""
    at, out = 0, None
    while at + 12 <= len(b) and b[at : at + 4] == b"8BIM":
        kind = int.from_bytes(b[at + 4 : at + 6], "big")
        at += 6 + (b[at + 6] + 2 & ~1)
        size = int.from_bytes(b[at : at + 4], "big")
        if kind == 0x0404 and at + 4 + size <= len(b):
            out = b[at + 4 : at + 4 + size]
        at += 4 + size + (size & 1)
    return out


def spliced(main: bytes, more: bytes) -> bytes:
    """An XMP packet with the descriptions of its extension put before the end of its RDF."""
    inner, cut = re.search(rb"<rdf:RDF[^>]*>(.*)</rdf:RDF>", more, re.S), main.rfind(b"</rdf:RDF>")
    return main[:cut] + inner[1] + main[cut:] if inner and cut >= 0 else main


def jpeg(b: bytes, kinds: frozenset[str] = KINDS) -> Found:
    packet, chunks = None, {}
    for marker, a, z in jpeg_segments(b):
        if marker == 0xE1:
            head = b[a : min(z, a + len(XMP_MORE_URI) + 40)]
            if head.startswith(b"Exif\0\0") and "exif" in kinds:
                yield "exif", b[a + 6 : z]
            elif head.startswith(XMP_URI) and "xmp" in kinds:
                packet = b[a + len(XMP_URI) : z]
            elif head.startswith(XMP_MORE_URI) and "xmp" in kinds and z - a >= len(XMP_MORE_URI) + 40:
                head = head[len(XMP_MORE_URI) :]
                chunks.setdefault((head[:32], int.from_bytes(head[32:36], "big")), {})[int.from_bytes(head[36:40], "big")] = b[a + len(XMP_MORE_URI) + 40 : z]
        elif marker == 0xED and "iptc" in kinds and b[a : min(z, a + 14)] == b"Photoshop 3.0\0" and (own := resource_iptc(b[a + 14 : z])) is not None:
            yield "iptc", own
    if packet is not None:
        for (name, size), own in chunks.items():
            more = b"".join(own[k] for k in sorted(own))
            if len(more) == size and name in packet:
                packet = spliced(packet, more)
        yield "xmp", packet


def png_chunks(b: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 8
    while at < len(b):
        if at + 8 > len(b):
            raise Damaged("a chunk's head is cut off")
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        if at + 12 + size > len(b):
            raise Damaged("a chunk is cut off")
        yield kind, at + 8, at + 8 + size
        if kind == b"IEND":
            return
        at += 12 + size


def inflated(b: bytes, most: int = MOST_INFLATED) -> bytes:
    """A whole zlib stream; Damaged if it is cut off or larger than the limit."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(b, most + 1)
    except zlib.error as e:
        raise Damaged(f"compressed text: {e}") from e
    if len(out) > most:
        raise Damaged(f"compressed text of over {most} bytes")
    if not stream.eof:
        raise Damaged("compressed text is cut off")
    return out


def png(b: bytes, kinds: frozenset[str] = KINDS) -> Found:
    legacy = packet = None
    for kind, a, z in png_chunks(b):
        if kind == b"eXIf" and "exif" in kinds:
            yield "exif", b[a:z]
        elif kind in (b"iTXt", b"tEXt", b"zTXt") and "xmp" in kinds and b[a : min(z, a + len(PNG_XMP) + 1)] == PNG_XMP + b"\0":
            rest = b[a + len(PNG_XMP) + 1 : z]
            if kind == b"iTXt" and len(rest) >= 2:
                text = rest[2:].split(b"\0", 2)
                if rest[0] and rest[1]:
                    raise Damaged("compressed text of an unknown method")
                if len(text) == 3:
                    packet = inflated(text[2]) if rest[0] else text[2]
            elif kind == b"tEXt":
                legacy = legacy or rest
            elif kind == b"zTXt" and not legacy:
                legacy = inflated(rest[1:])
    if packet or legacy:
        yield "xmp", packet or legacy


def webp(b: bytes, kinds: frozenset[str] = KINDS) -> Found:
    at = 12
    while at + 8 <= len(b):
        kind, size = struct.unpack("<4sI", b[at : at + 8])
        if at + 8 + size > len(b):
            raise Damaged("a chunk is cut off")
        if kind == b"EXIF" and "exif" in kinds:
            yield "exif", b[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
        elif kind == b"XMP " and "xmp" in kinds:
            yield "xmp", b[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def boxes(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end of the body) of the boxes of ISO media; a box smaller than its head ends the walk."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def find_box(b: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for kind, a, z in boxes(b, at, end):
        if kind == path[0]:
            return (a, z) if len(path) == 1 else find_box(b, a, z, *path[1:])
    return None


def item_places(b: bytes, a: int, z: int) -> dict[int, tuple[int, int, int, int, int, int, int]]:
    """Offset and length of each item of an iloc box, then where its extent stands, the widths of both fields, the base
    and the number of its extents; of several extents the last counts. Items whose construction is not by file offset
    are left out."""
    if z - a < 8:
        return {}
    begin, b, a, z = a, b[a:z], 0, z - a
    version, sizes, more = b[a], b[a + 4], b[a + 5]
    o, n, base, index = sizes >> 4, sizes & 15, more >> 4, more & 15 if version else 0
    wide = 4 if version == 2 else 2
    number = int.from_bytes
    count, at, out = number(b[a + 6 : a + 6 + wide], "big"), a + 6 + wide, {}
    skipped, step, method, start = wide + (4 if version else 2), index + o + n, 0, 0
    for _ in range(count):
        if at + wide + 4 > z:
            break
        item = number(b[at : at + wide], "big")
        if version:
            method = b[at + wide + 1] & 15
        at += skipped
        if base:
            start = number(b[at : at + base], "big")
            at += base
        extents = number(b[at : at + 2], "big")
        at += 2
        for _ in range(extents):
            if at + step > z:
                return out
            if not method:
                p = at + index
                out[item] = (start + number(b[p : p + o], "big"), number(b[p + o : p + o + n], "big"), begin + p, o, n, start, extents)
            at += step
    return out


def item_kinds(b: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Type and, for mime items, content type of each item of an iinf box, of which b is the body."""
    out = {}
    for kind, s, e in boxes(b, 6 if b[0] == 0 else 8, len(b)):
        if kind == b"infe" and e - s >= 12 and b[s] >= 2:
            wide = 4 if b[s] == 3 else 2
            item, at = int.from_bytes(b[s + 4 : s + 4 + wide], "big"), s + 4 + wide + 2
            rest = b[at + 4 : e].split(b"\0")
            out[item] = (b[at : at + 4], rest[1] if len(rest) > 1 else b"")
    return out


def metadata_items(b: bytes) -> tuple[tuple[int, str], ...]:
    """Number and kind of the Exif and XMP items of an iinf box, of which b is the body, by falling number."""
    out = []
    for item, (kind, content) in sorted(item_kinds(b).items(), reverse=True):
        name = "exif" if kind == b"Exif" else "xmp" if kind == b"mime" and content == b"application/rdf+xml" else None
        if name:
            out.append((item, name))
    return tuple(out)


#: Files of one program name their items alike: boxes of so many bytes at most are read once a worker.
MOST_KEPT = 4096
_short_metadata_items = lru_cache(maxsize=256)(metadata_items)


def primary_item(b: bytes, place: tuple[int, int] | None) -> int | None:
    """The item that a pitm box at a place names."""
    if not place or place[1] - place[0] < 6:
        return None
    start = place[0] + 4
    return int.from_bytes(b[start : start + (4 if b[place[0]] else 2)], "big")


#: Boxes that hold a meta box at any depth, and how deep it is sought.
HOLDERS = (b"moov", b"trak", b"udta", b"mdia", b"minf", b"moof", b"traf", b"meco")
MOST_BOXES_DEEP = 32


def meta_boxes(b: bytes, at: int, end: int, depth: int = 0) -> Iterator[tuple[int, int]]:
    """Where the contents of meta boxes stand, after their version: those of a level before those inside its boxes."""
    inside = []
    for kind, a, z in boxes(b, at, end):
        if kind == b"meta" and z - a > 4:
            yield a + 4, z
        elif kind in HOLDERS:
            inside.append((a, z))
    for a, z in inside if depth < MOST_BOXES_DEEP else ():
        yield from meta_boxes(b, a, z, depth + 1)


def heif_items(b: bytes) -> Iterator[tuple[str, tuple[int, int, int, int, int, int, int]]]:
    """Kind and place of the Exif and XMP items of the first meta box that has any: the primary item last, else the one
    with the lowest number. Items of no bytes are left out; an item beyond the limit makes the file Damaged."""
    for a, z in meta_boxes(b, 0, len(b)):
        inside: dict[bytes, tuple[int, int]] = {}
        for kind, s, e in boxes(b, a, z):
            inside.setdefault(kind, (s, e))
        info, places = inside.get(b"iinf"), inside.get(b"iloc")
        if not info or not places or info[1] - info[0] < 6:
            continue
        first, body = primary_item(b, inside.get(b"pitm")), b[info[0] : info[1]]
        where, found = item_places(b, *places), False
        for item, name in sorted((_short_metadata_items if len(body) <= MOST_KEPT else metadata_items)(body), key=lambda x: x[0] == first):
            if item in where and where[item][1]:
                if where[item][1] > MOST_ITEM:
                    raise Damaged(f"an item of over {MOST_ITEM} bytes")
                found = True
                yield name, where[item]
        if found:
            return


def heif(b: bytes, kinds: frozenset[str] = KINDS) -> Found:
    for kind, (at, size, *_) in heif_items(b):
        if kind not in kinds:
            continue
        if kind == "exif" and at + size <= len(b) and size > 4:
            yield kind, b[at + 4 + int.from_bytes(b[at : at + 4], "big") : at + size].removeprefix(b"Exif\0\0")
        elif kind == "xmp":
            if at + size > len(b):
                raise Damaged("the XMP item is cut off")
            yield kind, b[at : at + size]


def cr3(b: bytes, kinds: frozenset[str] = KINDS) -> Found:
    moov = find_box(b, 0, len(b), b"moov")
    if not moov:
        raise Damaged("no moov box")
    inside = next(((s + 16, e) for kind, s, e in boxes(b, *moov) if kind == b"uuid" and b[s : s + 16] == CANON), moov)
    for kind, s, e in boxes(b, *inside):
        name = {b"CMT1": "exif", b"CMT2": "exif_ifd", b"XMP ": "xmp"}.get(kind)
        if name in kinds:
            yield name, b[s:e]


#: Tags of a file's first directory that hold the other components.
IN_TIFF = {0x83BB: "iptc", 0x02BC: "xmp"}


def tiff(b: bytes, kinds: frozenset[str] = KINDS) -> Found:
    """The whole file is EXIF; two tags of its first directory hold the rest."""
    b = patched(b)
    if len(b) < 8 or b[:2] not in (b"II", b"MM"):
        raise Damaged("no TIFF header")
    if "exif" in kinds:
        yield "exif", b
    own = {tag: name for tag, name in IN_TIFF.items() if name in kinds}
    order = "little" if b[:2] == b"II" else "big"
    for tag, _, _, value in directory(b, order, int.from_bytes(b[4:8], order), own)[0] if own else ():
        if value:
            yield own[tag], value


def patched(b: bytes) -> bytes:
    """ORF and RW2 are TIFF with a magic number of their own."""
    if b[:4] not in (b"IIRO", b"IIU\0"):
        return b
    return b"II*\0" + b[4:] if isinstance(b, bytes) else b.headed(b"II*\0")


ENTRIES = {"little": struct.Struct("<HHI4s"), "big": struct.Struct(">HHI4s")}
TAG = itemgetter(0)
#: Bytes of a value, by TIFF type; values of other types are the four bytes of their field.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def directory(b: bytes, order: str, at: int, tags: Container[int] | None = None) -> tuple[list[tuple[int, int, int, bytes]], int]:
    """The entries (tag, type, count, value) of the directory at an offset, by tag, and the next one's offset.

    A directory whose table is cut off has none; an entry whose value lies outside is left out. If tags are given, only
    their entries are there, and other values are not read.
    """
    if not 0 < at <= len(b) - 2:
        return [], 0
    n = int.from_bytes(b[at : at + 2], order)
    if at + 2 + 12 * n > len(b):
        return [], 0
    table, out = b[at + 2 : at + 6 + 12 * n], []
    for tag, kind, count, raw in ENTRIES[order].iter_unpack(table[: 12 * n]):
        if tags is not None and tag not in tags:
            continue
        width = WIDTHS.get(kind)
        if width is None:
            out.append((tag, kind, count, raw))
        elif (size := width * count) <= 4:
            out.append((tag, kind, count, raw[:size]))
        elif (where := int.from_bytes(raw, order)) + size <= len(b):
            out.append((tag, kind, count, b[where : where + size]))
    out.sort(key=TAG)
    return out, int.from_bytes(table[12 * n :], order)


WALKERS = {"JPEG": jpeg, "PNG": png, "WebP": webp, "HEIF": heif, "AVIF": heif, "CR3": cr3} | dict.fromkeys(("TIFF", "CR2", "NEF", "ARW", "DNG", "ORF", "RW2"), tiff)
