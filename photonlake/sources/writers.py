"""Putting edited metadata back into images: directories, datasets and packets encoded, then one writer a container.

Bytes that hold the image are never moved inside a file that addresses them: directories of TIFF files, items of HEIF
files and the moov box of CR3 files are written anew at the end of the file, and what pointed to the old ones is patched.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

from .containers import CANON, PNG_XMP, WIDTHS, XMP_MORE_URI, XMP_URI, Damaged, boxes, find_box, heif_items, jpeg_segments, patched, png_chunks
from .layout import MAKER_NOTE, POINTERS, Changes, Unplaceable, laid_out, swapped

#: The most bytes of a JPEG segment after its length, and padding of a packet for edits in place.
MOST_SEGMENT = 65533
PADDING = 2048
#: Characters of texts in packets that are written otherwise or, as control characters, not at all.
ESCAPED = {**{k: None for k in range(32) if chr(k) not in "\t\n\r"}, **{ord(c): x for c, x in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\r", "&#xD;"))}}
_TO_ESCAPE = re.compile("[\x00-\x08\x0b-\x1f&<>\"']")
ARRAYS = {"creator": "Seq", "description": "Alt", "rights": "Alt", "title": "Alt"}
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

def edited_exif(block: bytes, changes: Changes) -> bytes:
    """A block of EXIF with entries set: laid out anew, or where that could harm what it addresses, edited as a file is."""
    try:
        return laid_out(block, changes)
    except Unplaceable:
        return edited_tiff(block, changes)


def edited_tiff(block: bytes, changes: Changes) -> bytes:
    """A TIFF file with some entries set; the directories concerned are appended, everything else stays in its place.

    Values that do not change keep their offsets, so MakerNotes, thumbnails and image data stay valid. What stands at the
    end of the file and belongs to these directories alone, as after an earlier edit, is written anew in its place, so
    edits do not make a file grow.
    """
    head = block[:4]
    whole = patched(block)
    order = {b"II": "little", b"MM": "big"}.get(bytes(whole[:2]))
    if len(whole) < 8 or not order:
        raise Damaged("no TIFF header")

    def number(x: bytes) -> int:
        return int.from_bytes(x, order)

    def raw_entries(at: int) -> tuple[dict[int, bytes], int]:
        if not 0 < at <= len(whole) - 2:
            return {}, 0
        n = number(whole[at : at + 2])
        end = at + 2 + 12 * n
        if end > len(whole):
            return {}, 0
        return {number(whole[e : e + 2]): bytes(whole[e : e + 12]) for e in range(at + 2, end, 12)}, number(whole[end : end + 4])

    def extent(entry: bytes) -> tuple[int, int]:
        """Where the value of an entry stands, if not in the entry."""
        size = WIDTHS.get(number(entry[2:4]), 0) * number(entry[4:8])
        at = number(entry[8:12])
        return (at, at + size) if size > 4 and at + size <= len(whole) else (0, 0)

    top, after = raw_entries(number(whole[4:8]))
    starts = {"ifd0": number(whole[4:8]), **{n: number(top[p][8:12]) for n, p in POINTERS.items() if p in top and n in ("exif", "gps")}}
    own = {"ifd0": (top, after), **{n: raw_entries(at) for n, at in starts.items() if n != "ifd0"}}
    extents = [(starts[n], starts[n] + 6 + 12 * len(e)) for n, (e, _) in own.items() if e]
    extents += [x for e, _ in own.values() for tag, entry in e.items() if tag != MAKER_NOTE and (x := extent(entry))[1]]
    cut = len(whole)
    for a, z in sorted(extents, key=lambda x: -x[1]):
        if z >= cut - 1:
            cut = min(cut, a)
    b = bytearray(whole[:cut])

    def put(tag: int, kind: int, count: int, value: bytes) -> bytes:
        if len(value) <= 4:
            field = value.ljust(4, b"\0")
        else:
            b.extend(b"\0" * (len(b) & 1))
            field = len(b).to_bytes(4, order)
            b.extend(value)
        return tag.to_bytes(2, order) + kind.to_bytes(2, order) + count.to_bytes(4, order) + field

    def rewritten(name: str, entries: dict[int, bytes]) -> dict[int, bytes]:
        new = {t: (k, n, swapped(k, v) if order == "little" else v) for t, (k, n, v) in changes.get(name, {}).items()}
        out = {}
        for tag, entry in entries.items():
            a, z = extent(entry)
            out[tag] = put(tag, number(entry[2:4]), number(entry[4:8]), whole[a:z]) if z and a >= cut and tag not in new else entry
        return out | {t: put(t, *v) for t, v in new.items()}

    def append(entries: dict[int, bytes], after: int) -> int:
        b.extend(b"\0" * (len(b) & 1))
        at = len(b)
        b.extend(len(entries).to_bytes(2, order) + b"".join(entries[t] for t in sorted(entries)) + after.to_bytes(4, order))
        return at

    for name in ("exif", "gps"):
        if changes.get(name) or name in own and starts[name] >= cut:
            entries, more = own.get(name, ({}, 0))
            top[POINTERS[name]] = put(POINTERS[name], 4, 1, append(rewritten(name, entries), more).to_bytes(4, order))
    b[4:8] = append(rewritten("ifd0", top), after).to_bytes(4, order)
    return head + bytes(b[4:]) if head in (b"IIRO", b"IIU\0") else bytes(b)


def encoded_iptc(datasets: list[tuple[int, int, bytes]]) -> bytes:
    """An IPTC block; values of 32,768 bytes and more have an extended length."""
    return b"".join(bytes((0x1C, r, d)) + (struct.pack(">H", len(v)) if len(v) < 0x8000 else struct.pack(">HI", 0x8004, len(v))) + v for r, d, v in datasets)


#: What stands before and after the properties of a packet and their namespaces, padding included.
_BEGIN = f'<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description rdf:about=""'.encode()
_END = ("</rdf:Description></rdf:RDF></x:xmpmeta>\n" + " " * PADDING + '<?xpacket end="w"?>').encode()


def _escaped(v: str) -> str:
    return v.translate(ESCAPED) if _TO_ESCAPE.search(v) else v


@lru_cache(maxsize=256)
def _declared(names: tuple[tuple[str, str], ...]) -> str:
    """The declarations of namespaces and their prefixes."""
    return "".join(f' xmlns:{p}="{_escaped(ns)}"' for ns, p in sorted(names))


def encoded_xmp(properties: dict[tuple[str, str], str], prefixes: dict[str, str]) -> bytes:
    """A packet with the properties in order of namespace and name; multiple values are lists, parent.child structures."""
    names = {uri: prefixes.get(uri, f"ns{k}") for k, uri in enumerate(sorted({ns for ns, _ in properties}))}
    text = _escaped

    def element(p: str, local: str, v: str) -> str:
        if "." in local:
            parent, child = local.split(".", 1)
            return f'<{p}:{parent} rdf:parseType="Resource">{element(p, child, v)}</{p}:{parent}>'
        if "\u001e" not in v:
            return f"<{p}:{local}>{text(v)}</{p}:{local}>"
        kind, items = ARRAYS.get(local, "Bag"), []
        for k, item in enumerate(v.split("\u001e")):
            lang, mark, rest = item.partition("|") if kind == "Alt" and k else ("x-default", "", "")
            items.append(f'<rdf:li xml:lang="{text(lang)}">{text(rest if mark else item)}</rdf:li>' if kind == "Alt" else f"<rdf:li>{text(item)}</rdf:li>")
        return f"<{p}:{local}><rdf:{kind}>{''.join(items)}</rdf:{kind}></{p}:{local}>"

    inner = "".join(element(names[ns], local, v) for (ns, local), v in sorted(properties.items()))
    return b"".join((_BEGIN, f"{_declared(tuple(names.items()))}>{inner}".encode(), _END))


def _segment(marker: int, data: bytes) -> bytes:
    if len(data) > MOST_SEGMENT:
        raise Damaged("the metadata does not fit a JPEG segment")
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _xmp_segments(packet: bytes) -> bytes:
    """One segment, or a main packet and chunks named by the packet's own digest, so that reruns write equal bytes."""
    if len(packet) <= MOST_SEGMENT - len(XMP_URI):
        return _segment(0xE1, XMP_URI + packet)
    name = hashlib.md5(packet).hexdigest().upper().encode()
    main = encoded_xmp({("http://ns.adobe.com/xmp/note/", "HasExtendedXMP"): name.decode()}, {"http://ns.adobe.com/xmp/note/": "xmpNote"})
    out, step = [_segment(0xE1, XMP_URI + main)], MOST_SEGMENT - len(XMP_MORE_URI) - 40
    for at in range(0, len(packet), step):
        out.append(_segment(0xE1, XMP_MORE_URI + name + struct.pack(">II", len(packet), at) + packet[at : at + step]))
    return b"".join(out)


def jpeg_with(b: bytes, own: dict[str, bytes]) -> bytes:
    """A JPEG file whose metadata segments are those of own; other segments and the image stay as they are."""
    head, kept, at = [b[:2]], [], 2
    for marker, a, z in jpeg_segments(b):
        part, at = b[a:z], z
        if marker == 0xE1 and part.startswith((b"Exif\0\0", XMP_URI, XMP_MORE_URI)):
            continue
        if marker == 0xED and part.startswith(b"Photoshop 3.0\0"):
            part = b"Photoshop 3.0\0" + other_resources(part[14:])
            if len(part) == 14:
                continue
        kept.append(_segment(marker, part))
    if "exif" in own:
        head.append(_segment(0xE1, b"Exif\0\0" + own["exif"]))
    if "xmp" in own:
        head.append(_xmp_segments(own["xmp"]))
    if "iptc" in own:
        x = own["iptc"]
        head.append(_segment(0xED, b"Photoshop 3.0\x008BIM\x04\x04\0\0" + struct.pack(">I", len(x)) + x + b"\0" * (len(x) & 1)))
    return b"".join(head + kept) + b[at:]


def other_resources(b: bytes) -> bytes:
    """Photoshop image resources without the IPTC block."""
    at, out = 0, b""
    while at + 12 <= len(b) and b[at : at + 4] == b"8BIM":
        data = at + 6 + (b[at + 6] + 2 & ~1)
        size = int.from_bytes(b[data : data + 4], "big")
        end = data + 4 + size + (size & 1)
        if b[at + 4 : at + 6] != b"\x04\x04":
            out += b[at:end]
        at = end
    return out


def png_with(b: bytes, own: dict[str, bytes]) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    out, end = [b[:8]], len(b)
    for kind, a, z in png_chunks(b):
        if kind == b"eXIf" or kind == b"iTXt" and b[a:z].startswith(PNG_XMP + b"\0"):
            continue
        out.append(b[a - 8 : z + 4])
        end = z + 4
        if kind == b"IHDR":
            out += [chunk(b"eXIf", own["exif"])] if "exif" in own else []
            out += [chunk(b"iTXt", PNG_XMP + b"\0\0\0\0\0" + own["xmp"])] if "xmp" in own else []
    return b"".join(out) + b[end:]


def webp_with(b: bytes, own: dict[str, bytes]) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    flags, size, kept, at = 0, None, [], 12
    while at + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, at)
        data = b[at + 8 : at + 8 + n]
        if kind == b"VP8X" and n >= 10:
            flags, size = data[0], data[4:10]
        elif kind not in (b"EXIF", b"XMP "):
            kept.append(chunk(kind, data))
            if size is None and kind == b"VP8 " and n >= 10:
                w, h = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 6))
                size = (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
            elif size is None and kind == b"VP8L" and n >= 5:
                bits = int.from_bytes(data[1:5], "little")
                flags |= 0x10 if bits >> 28 & 1 else 0
                size = (bits & 0x3FFF).to_bytes(3, "little") + (bits >> 14 & 0x3FFF).to_bytes(3, "little")
        at += 8 + n + (n & 1)
    flags = flags & ~0x0C | (0x08 if "exif" in own else 0) | (0x04 if "xmp" in own else 0)
    body = b"WEBP" + chunk(b"VP8X", bytes((flags, 0, 0, 0)) + (size or bytes(6))) + b"".join(kept)
    body += (chunk(b"EXIF", own["exif"]) if "exif" in own else b"") + (chunk(b"XMP ", own["xmp"]) if "xmp" in own else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def heif_with(b: bytes, own: dict[str, bytes]) -> bytes:
    """A HEIF file whose Exif and XMP items, where it has them, stand in a new box at its end; Damaged if one of those
    stands in several pieces."""
    out = bytearray(b)
    for kind, (_, _, field, o, n, base, extents) in dict(heif_items(b)).items():
        if kind in own:
            if extents > 1:
                raise Damaged("the item stands in several pieces")
            data = b"\0\0\0\0" + own[kind] if kind == "exif" else own[kind]
            at = len(out) + 8
            if at - base < 0 or at - base >= 1 << 8 * o or len(data) >= 1 << 8 * n:
                raise Damaged("the item's place does not fit its field")
            out[field : field + o] = (at - base).to_bytes(o, "big")
            out[field + o : field + o + n] = len(data).to_bytes(n, "big")
            out += struct.pack(">I4s", len(data) + 8, b"mdat") + data
    return bytes(out)


def cr3_with(b: bytes, own: dict[str, bytes]) -> bytes:
    """A CR3 file with a new moov box at its end; the old one becomes free space, so that image offsets hold."""
    moov = find_box(b, 0, len(b), b"moov")
    if not moov:
        raise Damaged("no moov box")

    def box(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I4s", len(data) + 8, kind) + data

    def rebuilt(a: int, z: int) -> bytes:
        parts = {b"CMT1": own.get("exif"), b"CMT2": own.get("exif_ifd"), b"XMP ": own.get("xmp")}
        return b"".join(box(k, parts[k] if parts.get(k) is not None else b[s:e]) for k, s, e in boxes(b, a, z))

    if not any(k == b"uuid" and b[s : s + 16] == CANON for k, s, _ in boxes(b, *moov)):
        return b
    body = b"".join(box(k, CANON + rebuilt(s + 16, e) if k == b"uuid" and b[s : s + 16] == CANON else b[s:e]) for k, s, e in boxes(b, *moov))
    name = b.rfind(b"moov", 0, moov[0])
    return b[:name] + b"free" + b[name + 4 :] + box(b"moov", body)


WRITERS = {"JPEG": jpeg_with, "PNG": png_with, "WebP": webp_with, "HEIF": heif_with, "AVIF": heif_with, "CR3": cr3_with}
