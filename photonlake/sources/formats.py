"""Formats by their first bytes, built in and registered, and the parsers that belong to them.

A registry travels with a query to its tasks, so whatever a session registers takes part in detecting formats, in finding
the payloads of a container and in reading MakerNotes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.image import MOST_SNIFFED, SNIFFED, image_format
from .containers import KINDS, WALKERS, Found

Walker = Callable[[bytes, frozenset[str]], Found]
#: make, note and the file's byte order (II or MM) to values by tag.
NoteParser = Callable[[str, bytes, str], Mapping[int, bytes]]


@dataclass(frozen=True)
class Format:
    """A container: its name, what all has to stand at which offset, and its walker."""

    name: str
    magic: tuple[tuple[int, bytes], ...]
    walk: Walker

    def matches(self, b: bytes) -> bool:
        return all(b[at : at + len(m)] == m for at, m in self.magic)

    def matches_column(self, content: Column) -> Column:
        return reduce(lambda a, c: a & c, (F.substring(content, at + 1, len(m)) == F.lit(m) for at, m in self.magic))


@dataclass(frozen=True)
class Registry:
    """Registered formats, which come before the built-in ones, and parsers of MakerNotes by make."""

    formats: tuple[Format, ...] = ()
    notes: Mapping[str, NoteParser] = field(default_factory=dict)

    def with_format(self, name: str, magic: Iterable[tuple[int, bytes]], walk: Walker) -> Registry:
        magic = tuple(magic)
        if not magic or any(at < 0 or not m for at, m in magic):
            raise ValueError("a format needs bytes that tell it")
        return Registry((*self.formats, Format(name, magic, walk)), self.notes)

    def with_notes(self, make: str, parse: NoteParser) -> Registry:
        return Registry(self.formats, {**self.notes, make: parse})

    def format_column(self, content: Column) -> Column:
        """The format of each content; null for unknown ones."""
        own = image_format(content)
        for f in reversed(self.formats):
            own = F.when(f.matches_column(content), f.name).otherwise(own)
        return own

    def format_of(self, b: bytes | None) -> str | None:
        """The same of the bytes of one file, of which no more than the first are looked at."""
        if b is None:
            return None
        return next((f.name for f in self.formats if f.matches(b)), None) or sniffed(b)

    def walk(self, name: str, b: bytes, kinds: frozenset[str] = KINDS) -> Found:
        return (next((f.walk for f in self.formats if f.name == name), None) or WALKERS[name])(b, kinds)


BUILT_IN = Registry()


def sniffed(b: bytes) -> str | None:
    """The built-in format of a file's first bytes, as functions.image.image_format tells it."""
    h, iso = b[:12], b[8:12]
    if h[:2] == b"\xff\xd8":
        return "JPEG"
    if h[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG"
    if h[:4] == b"RIFF" and iso == b"WEBP":
        return "WebP"
    if h[4:8] == b"ftyp":
        return "CR3" if iso == b"crx " else "AVIF" if iso[:3] in (b"avi", b"av0") else "HEIF"
    if h[:4] == b"II*\0" and h[8:10] == b"CR":
        return "CR2"
    if h[:4] in (b"IIRO", b"IIU\0"):
        return "ORF" if h[:4] == b"IIRO" else "RW2"
    return _tiff_kind(b[:SNIFFED]) if h[:4] in (b"II*\0", b"MM\0*") else None


def _tiff_kind(head: bytes) -> str:
    order = "little" if head[:2] == b"II" else "big"

    def at(place: int, n: int) -> int | None:
        part = head[place : place + n]
        return int.from_bytes(part, order) if len(part) == n else None

    start = at(4, 4) or 0
    n = at(start, 2) or 0
    places = [start + 2 + 12 * i for i in range(n)] if n <= MOST_SNIFFED else []
    if any(at(e, 2) == 0xC612 for e in places):
        return "DNG"
    make = next((e for e in places if at(e, 2) == 0x010F), None)
    count, offset = (at(make + 4, 4), at(make + 8, 4)) if make is not None else (None, None)
    if count is None or offset is None:
        return "TIFF"
    where = make + 8 if count <= 4 else offset
    name = head[where : where + count].rstrip(b"\0 ")
    return {b"NIKON CORPORATION": "NEF", b"Nikon": "NEF", b"SONY": "ARW"}.get(name, "TIFF")
