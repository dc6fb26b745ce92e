"""EXIF laid out anew: directories, values and thumbnail placed so that no dead bytes are left.

A block of EXIF is read into directories, edited, and placed again from its header on: each directory's table with its
values after it, the thumbnail last. What other bytes may point into keeps its place: a MakerNote, whose offsets often
count from the block's start. The rest goes around it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .containers import ENTRIES, WIDTHS, Damaged

#: Tags that lead to further directories, to a thumbnail, to image data, and the tag of MakerNotes.
SUB_DIRECTORIES = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
POINTERS = {name: tag for tag, name in SUB_DIRECTORIES.items()}
THUMBNAIL, THUMBNAIL_SIZE, MAKER_NOTE = 0x0201, 0x0202, 0x927C
IMAGE_DATA = frozenset((0x0111, 0x0144, 0x014A, 0x0120))
MOST_DIRECTORIES = 64

Changes = dict[str, dict[int, tuple[int, int, bytes]]]  # by directory and tag: type, count, value in big-endian order


def swapped(kind: int, value: bytes) -> bytes:
    width = {3: 2, 4: 4, 5: 4, 8: 2, 9: 4, 10: 4, 11: 4, 12: 8}.get(kind, 1)
    return b"".join(value[k : k + width][::-1] for k in range(0, len(value), width))


@dataclass(slots=True)
class Entry:
    kind: int
    count: int
    value: bytes  # in the block's byte order
    at: int = 0  # where a value of over four bytes stood


@dataclass(slots=True)
class Directory:
    """A directory's entries by tag, those under it by tag, and the one after it."""

    entries: dict[int, Entry] = field(default_factory=dict)
    under: dict[int, Directory] = field(default_factory=dict)
    after: Directory | None = None
    thumbnail: bytes | None = None
    at: int = 0  # where it stood
    more: int = 0  # the offset of one after it that isn't read


class Unplaceable(Damaged):
    """A block that addresses bytes of which nothing here knows what they mean."""


def order_of(b: bytes) -> str:
    order = {b"II": "little", b"MM": "big"}.get(bytes(b[:2]))
    if len(b) < 8 or not order:
        raise Damaged("no TIFF header")
    return order


def read(b: bytes, order: str, at: int, seen: set[int], chain: bool = True) -> Directory:
    """The directory at an offset with all that it leads to; Unplaceable if some of it cannot be read."""
    if at in seen or len(seen) >= MOST_DIRECTORIES:
        raise Unplaceable("directories lead to each other")
    seen.add(at)
    end = at + 2 + 12 * int.from_bytes(b[at : at + 2], order)
    if not 8 <= at <= len(b) - 2 or end + 4 > len(b):
        raise Unplaceable("a directory is cut off")
    own = Directory(at=at)
    entries = own.entries
    for tag, kind, count, raw in ENTRIES[order].iter_unpack(b[at + 2 : end]):
        size = WIDTHS.get(kind, 0) * count
        if size > 4:
            where = int.from_bytes(raw, order)
            if where + size > len(b):
                raise Unplaceable("a value is cut off")
            if tag not in entries:
                entries[tag] = Entry(kind, count, b[where : where + size], where)
        else:
            if tag not in entries:
                entries[tag] = Entry(kind, count, raw)
            if size == 4 and tag in SUB_DIRECTORIES and tag not in own.under:
                own.under[tag] = read(b, order, int.from_bytes(raw, order), seen, False)
    if THUMBNAIL in own.entries and THUMBNAIL_SIZE in own.entries:
        a, size = (int.from_bytes(own.entries[t].value[: WIDTHS.get(own.entries[t].kind, 4)], order) for t in (THUMBNAIL, THUMBNAIL_SIZE))
        if a + size > len(b):
            raise Unplaceable("a thumbnail is cut off")
        own.thumbnail = b[a : a + size]
    more = int.from_bytes(b[end : end + 4], order)
    if more and chain:
        own.after = read(b, order, more, seen)
    else:
        own.more = more
    return own


def changed(top: Directory, order: str, changes: Changes) -> None:
    """Sets entries, in directories that are there or that come with them."""
    for name in ("ifd0", "exif", "gps"):
        if changes.get(name):
            own = top if name == "ifd0" else top.under.setdefault(POINTERS[name], Directory())
            if name != "ifd0":
                top.entries.setdefault(POINTERS[name], Entry(4, 1, bytes(4)))
            for tag, (kind, count, value) in changes[name].items():
                own.entries[tag] = Entry(kind, count, swapped(kind, value) if order == "little" else value)


class Places:
    """Free room from an offset on, around what keeps its place."""

    def __init__(self, start: int, kept: list[tuple[int, int]]):
        self.free: list[list[int]] = []
        at = start
        for a, z in sorted(kept):
            if a > at:
                self.free.append([at, a])
            at = max(at, z)
        self.free.append([at, 1 << 32])

    def take(self, size: int) -> int:
        """The first room of that size at an even offset."""
        for room in self.free:
            a = room[0] + (room[0] & 1)
            if a + size <= room[1]:
                room[0] = a + size
                return a
        raise Damaged("the block would be of over 4 GiB")


def table_size(d: Directory) -> int:
    return 6 + 12 * len(d.entries)


def written(d: Directory, order: str, places: Places, out: dict[int, bytes], chain: bool = True) -> int:
    """Places a directory with what it leads to, and gives its offset; out gets the pieces by offset."""
    at = places.take(table_size(d))
    rows, moved = [], {}
    for tag in sorted(d.entries):
        e = d.entries[tag]
        value = e.value
        if len(value) > 4:
            where = e.at if tag == MAKER_NOTE and e.at else places.take(len(value))
            out[where] = value
            value = where.to_bytes(4, order)
        rows.append((tag, e.kind, e.count, value))
    for tag, under in d.under.items():
        moved[tag] = written(under, order, places, out, False)
    if d.thumbnail is not None:
        moved[THUMBNAIL] = places.take(len(d.thumbnail))
        out[moved[THUMBNAIL]] = d.thumbnail
    if moved:
        rows = [(r[0], 4, 1, moved[r[0]].to_bytes(4, order)) if r[0] in moved else r for r in rows]
    after = written(d.after, order, places, out) if d.after and chain else d.more
    pack = ENTRIES[order].pack  # fills values of under four bytes with zeros
    out[at] = len(rows).to_bytes(2, order) + b"".join([pack(*r) for r in rows]) + after.to_bytes(4, order)
    return at


def every(d: Directory):
    yield d
    for under in d.under.values():
        yield from every(under)
    if d.after:
        yield from every(d.after)


def laid_out(block: bytes, changes: Changes) -> bytes:
    """A block of EXIF with entries set and all of it placed anew; Unplaceable if it addresses image data."""
    order = order_of(block)
    top = read(block, order, int.from_bytes(block[4:8], order), set())
    own = list(every(top))
    if any(not IMAGE_DATA.isdisjoint(d.entries) for d in own):
        raise Unplaceable("the block addresses image data")
    changed(top, order, changes)
    notes = [(e.at, e.at + len(e.value)) for d in own if (e := d.entries.get(MAKER_NOTE)) and e.at]
    out: dict[int, bytes] = {}
    first = written(top, order, Places(8, notes), out)
    size = max(a + len(x) for a, x in out.items())
    b = bytearray(block[:4] + first.to_bytes(4, order)).ljust(size, b"\0")
    for a, x in out.items():
        b[a : a + len(x)] = x
    return bytes(b)
