"""Files of which only the bytes that are asked for are read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

from pyarrow import fs as pafs

#: The first bytes that a look at a new place fetches, and the most that one fetch takes ahead.
LEAST, MOST = 4096, 1 << 20
#: What a file costs to open, and the most of its own bytes that its metadata is taken to be, in planning.
OPEN_BYTES, METADATA_BYTES = 64 << 10, 64 << 10


class Ranges:
    """A file's bytes by index and slice, fetched in blocks where they are first asked for.

    A fetch takes LEAST bytes; while reads go on where the last fetch ended, each takes twice as many as the one before.
    So a jump over image data costs little, and a long segment takes few fetches.
    """

    def __init__(self, file, length: int, head: bytes = b""):
        self.file, self.length, self.head = file, length, head
        self.parts: list[tuple[int, bytes]] = []
        self.fetched, self.step = 0, LEAST

    def __len__(self) -> int:
        return self.length

    def headed(self, head: bytes) -> Ranges:
        """The same bytes with others at their start."""
        self.head = head
        return self

    def __getitem__(self, key: int | slice) -> int | bytes:
        if isinstance(key, int):
            return self[key : key + 1][0]
        a, z, _ = key.indices(self.length)
        if a >= z:
            return b""
        out = self._bytes(a, z)
        return self.head[a:z] + out[max(len(self.head) - a, 0) :] if a < len(self.head) else out

    def __bytes__(self) -> bytes:
        return self[:]

    def _bytes(self, a: int, z: int) -> bytes:
        out = b""
        while a < z:
            start, data = self._part(a, z)
            own = data[a - start : z - start]
            out, a = out + own, a + len(own)
        return out

    def _part(self, a: int, z: int) -> tuple[int, bytes]:
        """A part that has byte a, fetched if there is none; one that is fetched ends where the next part starts."""
        for start, data in reversed(self.parts):
            if start <= a < start + len(data):
                return start, data
        goes_on = bool(self.parts) and self.parts[-1][0] + len(self.parts[-1][1]) == a
        self.step = min(2 * self.step, MOST) if goes_on else LEAST
        end = min([self.length, max(z, a + self.step), *(s for s, _ in self.parts if s > a)])
        data = self.file.read_at(end - a, a)
        if not data:
            raise OSError(f"no bytes at {a} of {self.length}")
        self.fetched += len(data)
        self.parts.append((a, data))
        return a, data


def uri_of(path: str) -> str:
    """A path as a URI with an authority, which may be empty."""
    if path.startswith("/"):
        return f"file://{path}"
    return "file://" + path[len("file:") :] if path.startswith("file:") and not path.startswith("file://") else path


@lru_cache(maxsize=16)
def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path is in, of which a process has one, and the path there."""
    scheme, _, rest = uri_of(path).partition("://")
    authority, _, key = rest.partition("/")
    where, base = _store(f"{scheme}://{authority}/")
    base = base.rstrip("/")
    return where, f"{base}/{key}"


def listed(path: str, suffixes: Sequence[str] = ()) -> list[tuple[str, int]]:
    """URI and length of every file below a path, in order; hidden folders and files are left out, as Spark does."""
    where, base = located(path)
    base, own = base.rstrip("/"), where.get_file_info(base)
    found = where.get_file_info(pafs.FileSelector(base, recursive=True)) if own.type == pafs.FileType.Directory else [own]
    out = []
    for f in found:
        below = f.path[len(base) :]
        if f.type == pafs.FileType.File and not any(x[:1] in ("_", ".") for x in below.split("/")) and (not suffixes or below.rpartition(".")[2].lower() in suffixes):
            out.append((uri_of(path).rstrip("/") + below, f.size))
    return sorted(out)


def packed(files: list[tuple[str, int]], bytes_a_part: int, parts: int = 1) -> list[list[tuple[str, int]]]:
    """Files in runs of about equal cost: opening one and reading its metadata, whatever the image weighs."""
    costs = [OPEN_BYTES + min(size, METADATA_BYTES) for _, size in files]
    most = max(1, min(bytes_a_part, -(-sum(costs) // max(parts, 1))))
    out, held = [], most
    for file, cost in zip(files, costs, strict=True):
        if held + cost > most:
            out.append([])
            held = 0
        out[-1].append(file)
        held += cost
    return out


def opened_files(files: Iterable[tuple[str, int | None]]) -> Iterator[tuple[str, Ranges | None, str | None]]:
    """Each file's path with its bytes, or with what keeps it from being opened."""
    for path, size in files:
        if path is None:
            yield path, None, "Unreadable: no path"
            continue
        try:
            where, own = located(path)
            file = where.open_input_file(own)
        except (OSError, ValueError) as e:
            yield path, None, f"Unreadable: {e}"
            continue
        with file:
            yield path, Ranges(file, file.size() if size is None else size), None
