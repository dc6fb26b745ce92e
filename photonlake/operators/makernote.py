"""MakerNotes: where each maker's directory begins, and one reader for all of them."""

from __future__ import annotations

from ..sources.containers import WIDTHS, directory

#: Makes as cameras write them, by maker.
MAKES = {
    "Canon": "canon", "NIKON CORPORATION": "nikon", "Nikon": "nikon", "SONY": "sony", "FUJIFILM": "fujifilm", "OLYMPUS IMAGING CORP.": "olympus", "OLYMPUS CORPORATION": "olympus",
    "Olympus": "olympus", "PENTAX Corporation": "pentax", "Ricoh": "pentax", "RICOH": "pentax", "Panasonic": "panasonic", "LEICA CAMERA AG": "leica", "Leica Camera AG": "leica",
    "LEICA": "leica", "Leica": "leica", "DJI": "dji", "SAMSUNG": "samsung", "SIGMA": "sigma", "CASIO COMPUTER CO.,LTD.": "casio", "Casio Computer Co.,Ltd.": "casio", "CASIO": "casio",
}
#: Layouts by maker, each a magic, the byte order (at: it stands at byte 8; either: little, then big), where
#: the directory begins, the most entries it may have and the fewest.
LAYOUTS = {
    "canon": ((b"", "either", 0, 512, 2),),
    "nikon": ((b"", "big", 0, 512, 1),),
    "sony": ((b"", "either", 0, 1024, 2),),
    "olympus": ((b"OLYMPUS\0", "at", 12, 1024, 0), (b"OLYMP\0", "little", 8, 1024, 0)),
    "pentax": ((b"AOC\0", "big", 6, 1024, 0), (b"PENTAX \0", "at", 12, 1024, 0)),
    "panasonic": ((b"Panasonic\0\0\0", "little", 12, 1024, 0),),
    "leica": ((b"LEICA\0", "little", 8, 1024, 1), (b"", "either", 0, 512, 1)),
    "dji": ((b"", "either", 0, 512, 1),),
    "samsung": ((b"", "either", 0, 512, 1),),
    "sigma": ((b"SIGMA\0\0\0", "little", 10, 512, 1), (b"FOVEON\0\0", "little", 10, 512, 1)),
}

#: Typed directories by maker, each a magic, the fewest bytes of such a note, the byte order (own: that of
#: the TIFF header at the base; at: it stands at byte 8; parent: the file's), where the directory begins (pointer: the
#: number at byte 12; header: the TIFF header says so) and the base that offsets count from. Directories at 0 are in the
#: table for completeness: an offset of 0 points to no directory, so those notes are raw values alone.
DIRECTORIES = {
    "canon": ((b"", 6, "parent", 0, 0),),
    "nikon": ((b"Nikon\0", 18, "own", "header", 8), (b"", 6, "big", 0, 0)),
    "sony": ((b"", 6, "parent", 0, 0),),
    "fujifilm": ((b"FUJIFILM", 16, "little", "pointer", 0),),
    "olympus": ((b"OLYMPUS\0", 14, "at", 12, 0),),
    "pentax": ((b"AOC\0", 8, "big", 6, 0), (b"PENTAX \0", 14, "at", 12, 0)),
    "panasonic": ((b"Panasonic\0\0\0", 14, "little", 12, 0),),
    "leica": ((b"LEICA\0", 8, "little", 8, 0), (b"", 2, "parent", 0, 0)),
    "dji": ((b"", 6, "little", 0, 0),),
    "samsung": ((b"", 6, "parent", 0, 0),),
    "sigma": ((b"SIGMA\0\0\0", 10, "little", 10, 0), (b"FOVEON\0\0", 10, "little", 10, 0)),
    "casio": ((b"", 6, "parent", 0, 0),),
}
ORDERS = {b"II": "little", b"MM": "big"}


def makernote_directory(make: str, note: bytes, parent: str) -> list[tuple[int, int, int, bytes, str]]:
    """(tag, type, count, value, byte order) of a MakerNote that is a directory; parent: the file's own order, II or MM."""
    for magic, least, order, at, base in DIRECTORIES.get(MAKES.get(make, ""), ()):
        if note.startswith(magic) and len(note) >= least:
            block = note[base:]
            order = {"own": ORDERS.get(block[:2], ""), "at": ORDERS.get(note[8:10], ""), "parent": ORDERS[parent.encode()]}.get(order, order)
            if not order or at == "header" and int.from_bytes(block[2:4], order) != 42:
                return []
            start = {"header": int.from_bytes(block[4:8], order), "pointer": int.from_bytes(note[12:16], order)}.get(at, at)
            return [(*e, "II" if order == "little" else "MM") for e in directory(block, order, start)[0]]
    return []


def entries_at(b: bytes, order: str, at: int, most: int) -> dict[int, bytes]:
    """Values by tag of the directory at an offset; unknown types and values outside are left out, the last tag counts."""
    if at + 2 > len(b):
        return {}
    n = int.from_bytes(b[at : at + 2], order)
    if not 0 < n <= most or at + 2 + 12 * n > len(b):
        return {}
    out = {}
    for e in range(at + 2, at + 2 + 12 * n, 12):
        size = WIDTHS.get(int.from_bytes(b[e + 2 : e + 4], order), 0) * int.from_bytes(b[e + 4 : e + 8], order)
        where = e + 8 if size <= 4 else int.from_bytes(b[e + 8 : e + 12], order)
        if size and where + size <= len(b):
            out[int.from_bytes(b[e : e + 2], order)] = b[where : where + size]
    return out


def makernote_entries(make: str, b: bytes) -> dict[int, bytes]:
    """Raw values by tag of a MakerNote; empty for unknown makes, matched exactly, and for notes that cannot be read."""
    maker = MAKES.get(make)
    if maker == "nikon" and b[:6] == b"Nikon\0" and len(b) >= 18:
        block = b[8:]
        order = {b"II": "little", b"MM": "big"}.get(block[:2])
        return entries_at(block, order, int.from_bytes(block[4:8], order), 512) if order else {}
    if maker == "fujifilm":
        return entries_at(b, "little", int.from_bytes(b[12:16], "little"), 1024) if b[:8] == b"FUJIFILM" and len(b) >= 16 else {}
    for magic, order, at, most, least in LAYOUTS.get(maker or "", ()):
        if b.startswith(magic):
            orders = {"either": ("little", "big"), "at": ("little" if b[8:10] == b"II" else "big",)}.get(order, (order,))
            for o in orders:
                found = entries_at(b, o, at, most)
                if len(found) >= max(least, 1):
                    return found
            return {}
    return {}
