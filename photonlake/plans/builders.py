"""Image bytes made of table columns, by expressions that share nothing with the readers.

Sizes and offsets are sums over the parts, and no part is made by a function over arrays, so that Spark compiles the
expressions. Containers name their parts more than once: parts that take work are columns of their own first.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def raw(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def number(n: Column | int, width: int, little: bool = False) -> Column:
    """A number of `width` bytes, big-endian unless `little`."""
    n = F.lit(n) if isinstance(n, int) else n
    digits = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(width - 1, -1, -1)]) if little else digits)


def text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def join(*parts: Column) -> Column:
    return F.concat(*parts)


Entry = tuple  # tag, type, count, value, and the value's size in bytes where it needs no look at the value


def ascii_entry(tag: int, value: Column) -> Entry:
    size = F.octet_length(value) + 1
    return tag, 2, size, join(text(value), raw("00")), size


def short_entry(tag: int, value: Column | int, little: bool = False) -> Entry:
    return tag, 3, F.lit(1), number(value, 2, little), 2


def long_entry(tag: int, value: Column | int, little: bool = False) -> Entry:
    return tag, 4, F.lit(1), number(value, 4, little), 4


def rational_entry(tag: int, *pairs: tuple[Column | int, Column | int], little: bool = False) -> Entry:
    return tag, 5, F.lit(len(pairs)), join(*[number(x, 4, little) for p in pairs for x in p]), 8 * len(pairs)


def outside(entry: Entry) -> Column | int:
    """How many bytes of an entry's value stand outside the table: none if it fits in its field."""
    size = entry[4] if len(entry) > 4 else F.octet_length(entry[3])
    if isinstance(size, int):
        return size if size > 4 else 0
    return F.when(size <= 4, 0).otherwise(size)


def ifd_size(entries: list[Entry]) -> Column | int:
    return sum(map(outside, entries), 2 + 12 * len(entries) + 4)


def ifd(entries: list[Entry], at: Column | int, little: bool = False) -> Column:
    """A directory at an offset, with the values that do not fit in its table after it."""
    free, table, data = at + 2 + 12 * len(entries) + 4, [], []
    for entry in sorted(entries, key=lambda e: e[0]):
        tag, kind, count, value = entry[:4]
        more, place = outside(entry), number(free, 4, little)
        if isinstance(more, int):
            field, rest = (place, [value]) if more else (F.rpad(value, 4, raw("00")), [])
        else:
            field, rest = F.when(more == 0, F.rpad(value, 4, raw("00"))).otherwise(place), [F.when(more == 0, raw("")).otherwise(value)]
        table += [number(tag, 2, little), number(kind, 2, little), number(count, 4, little), field]
        data += rest
        free = free + more
    return join(number(len(entries), 2, little), *table, raw("00000000"), *data)


def exif(ifd0: list[Entry], exif_ifd: list[Entry] | None = None, gps: list[Entry] | None = None) -> Column:
    """A big-endian TIFF block: the sub-directories stand first, so that their places need no other's length."""
    at, bodies, top = 8, [], list(ifd0)
    for tag, entries in ((0x8769, exif_ifd), (0x8825, gps)):
        if entries:
            bodies.append(ifd(entries, at))
            top.append(long_entry(tag, at))
            at = at + ifd_size(entries)
    return join(raw("4D4D002A"), number(at, 4), *bodies, ifd(top, at))


def little_tiff(head: str, entries: list[Entry]) -> Column:
    """A little-endian TIFF file of one directory; head: its first bytes up to the directory, in hexadecimal digits."""
    return join(raw(head), ifd(entries, len(head) // 2, True))


def xmp(inner: Column) -> Column:
    head = "<?xpacket begin='' id='W5M0MpCehiHzreSzNTczkc9d'?><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description rdf:about='' xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:tiff='http://ns.adobe.com/tiff/1.0/' xmlns:exif='http://ns.adobe.com/exif/1.0/'>"
    return text(F.concat(F.lit(head), inner, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end='w'?>")))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))


def listed(name: str, kind: str, *values: Column) -> Column:
    items = [F.concat(F.lit("<rdf:li>"), escaped(v), F.lit("</rdf:li>")) for v in values]
    return F.concat(F.lit(f"<{name}><rdf:{kind}>"), *items, F.lit(f"</rdf:{kind}></{name}>"))


def iptc(*datasets: tuple[int, int, Column]) -> Column:
    return join(*[join(raw("1C"), number(r, 1), number(d, 1), number(F.octet_length(v), 2), v) for r, d, v in datasets])


def _or_nothing(part: Column) -> Column:
    """A part whose content is null is left out."""
    return F.coalesce(part, raw(""))


def jpeg(exif_: Column | None = None, xmp_: Column | None = None, iptc_: Column | None = None) -> Column:
    parts = [raw("FFD8")]
    if exif_ is not None:
        parts.append(join(raw("FFE1"), number(F.octet_length(exif_) + 8, 2), text(F.lit("Exif")), raw("0000"), exif_))
    if xmp_ is not None:
        parts.append(join(raw("FFE1"), number(F.octet_length(xmp_) + 31, 2), text(F.lit("http://ns.adobe.com/xap/1.0/")), raw("00"), xmp_))
    if iptc_ is not None:
        pad = F.when(F.octet_length(iptc_) % 2 == 1, raw("00")).otherwise(raw(""))
        block = join(text(F.lit("8BIM")), raw("04040000"), number(F.octet_length(iptc_), 4), iptc_, pad)
        parts.append(join(raw("FFED"), number(F.octet_length(block) + 16, 2), text(F.lit("Photoshop 3.0")), raw("00"), block))
    return join(*[_or_nothing(p) for p in parts], raw("FFDA0002FFD9"))


def chunk(kind: str, data: Column) -> Column:
    body = join(text(F.lit(kind)), data)
    return join(number(F.octet_length(data), 4), body, number(F.crc32(body), 4))


@F.arrow_udf(BinaryType())
def stored_zlib(data: pa.Array) -> pa.Array:
    """Zlib streams that hold the data as they are; their checksums are over single bytes, for which SQL has no function."""
    return pa.array([None if d is None else zlib.compress(d, 0) for d in data.to_pylist()], pa.binary())


def png(exif_: Column | None = None, xmp_: Column | None = None, compressed: bool = False) -> Column:
    parts = [raw("89504E470D0A1A0A"), chunk("IHDR", raw("00000001000000010802000000"))]
    if exif_ is not None:
        parts.append(chunk("eXIf", exif_))
    if xmp_ is not None:
        parts.append(chunk("iTXt", join(text(F.lit("XML:com.adobe.xmp")), raw("0001000000" if compressed else "0000000000"), stored_zlib(xmp_) if compressed else xmp_)))
    return join(*[_or_nothing(p) for p in parts], chunk("IEND", raw("")))


def webp(exif_: Column | None = None, xmp_: Column | None = None) -> Column:
    def part(kind: str, data: Column) -> Column:
        return join(text(F.lit(kind)), number(F.octet_length(data), 4, True), data, F.when(F.octet_length(data) % 2 == 1, raw("00")).otherwise(raw("")))

    body = [text(F.lit("WEBP")), part("VP8X", raw("0C000000000000000000"))]
    body += [part("EXIF", exif_)] if exif_ is not None else []
    body += [part("XMP ", xmp_)] if xmp_ is not None else []
    whole = join(*[_or_nothing(p) for p in body])
    return join(text(F.lit("RIFF")), number(F.octet_length(whole), 4, True), whole)


def box(kind: str, *data: Column) -> Column:
    """A box of ISO media."""
    return join(number(sum(map(F.octet_length, data), F.lit(8)), 4), text(F.lit(kind)), *data)


def heif(items: list[tuple[int, str, Column]], primary: Column | int, brand: Column | str = "heic") -> Column:
    """A HEIF file of Exif (type Exif) and XMP (type mime) items by number, one of them the primary."""
    names = {"Exif": b"\0", "mime": b"\0application/rdf+xml\0"}
    infe = [raw((len(names[t]) + 20).to_bytes(4).hex() + b"infe".hex() + "02000000" + i.to_bytes(2).hex() + "0000" + t.encode().hex() + names[t].hex()) for i, t, _ in items]
    data = [join(raw("00000000"), d) if t == "Exif" else d for _, t, d in items]
    meta = 8 + 4 + (12 + 2) + (8 + 4 + 2 + sum(len(names[t]) + 20 for _, t, _ in items)) + (8 + 8 + 14 * len(items))
    at, places = F.lit(24 + meta + 8), []
    for (i, _, _), d in zip(items, data):
        places.append(join(number(i, 2), raw("00000001"), number(at, 4), number(F.octet_length(d), 4)))
        at = at + F.octet_length(d)
    inner = [box("pitm", raw("00000000"), number(primary, 2)), box("iinf", raw("00000000"), number(len(items), 2), *infe), box("iloc", raw("000000004400"), number(len(items), 2), *places)]
    return join(box("ftyp", text(F.lit(brand)), raw("00000000"), text(F.lit("mif1heic"))), box("meta", raw("00000000"), *inner), box("mdat", *data))


def cr3(cmt1: Column, cmt2: Column, xmp_: Column) -> Column:
    canon = raw("85c0b687820f11e08111f4ce462b6a48")
    return join(box("ftyp", text(F.lit("crx ")), raw("00000001"), text(F.lit("crx isom"))), box("moov", box("uuid", canon, box("CMT1", cmt1), box("CMT2", cmt2), box("XMP ", xmp_))), box("mdat", raw("00010203")))
