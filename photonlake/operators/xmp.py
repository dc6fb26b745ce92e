"""XMP packets as rows, one a property."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import NAMESPACES

RDF = NAMESPACES["rdf"]
MOST_DEPTH = 100
SEPARATOR = "\u001e"
#: The entities that XML defines.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
LISTS = ("Alt", "Seq", "Bag")

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|\?.*?(?:\?>|\Z)|![^>]*+(?:>|\Z)|(/)[^>]*+(?:>|\Z)|([^\s>/=]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))([^<]*+)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)|'([^']*))""")
_REFERENCE = re.compile("&([^;]*);")


def _referred(m: re.Match) -> str:
    """What a reference stands for; one to an unknown entity stays as it is, a number that isn't one is nothing."""
    ref = m[1]
    if len(ref) < 2 or ref[0] != "#":
        return ENTITIES.get(ref, m[0])
    try:
        return chr(int(ref[2:], 16) if ref[1] in "xX" else int(ref[1:]))
    except (ValueError, OverflowError):
        return ""


def unescaped(text: str) -> str:
    return _REFERENCE.sub(_referred, text) if "&" in text else text


def packet(b: bytes) -> bytes:
    """What stands between the packet's marks, or everything where there are none."""
    a = b.find(b"<?xpacket begin=")
    if a < 0:
        return b
    a = b.find(b"?>", a) + 2
    z = b.find(b"<?xpacket end=", a)
    return b[a:z] if z >= 0 else b[a:]


def _attributes(source: str) -> tuple[dict[str, str], dict[str, str]]:
    """Namespaces by prefix that the inside of a tag declares, and its attributes by name; neither is changed."""
    spaces, own = {}, {}
    for m in _ATTRIBUTE.finditer(source):
        value = unescaped(m[2] if m[2] is not None else m[3])
        if m[1].startswith("xmlns:"):
            spaces[m[1][6:]] = value
        elif m[1] != "xmlns":
            own[m[1]] = value
    return spaces, own


#: Tags of texts of so many characters at most are found all at once; there are fewer than that many of them.
MOST_AT_ONCE = 1 << 20
#: Packets of one program begin alike: the insides of so many tags of so many characters at most are read once a worker.
MOST_KEPT = 2048
_short_attributes = lru_cache(maxsize=512)(_attributes)


#: Attributes of a tag without any, and the element that the outermost ones are in.
NO_ATTRIBUTES: dict[tuple[str, str], str] = {}


class Element:
    """An element that is open: what it is to those inside it, its name, what leads theirs, and the items of its list."""

    __slots__ = ("kind", "ns", "local", "prefix", "items")

    def __init__(self, kind: str, ns: str, local: str, prefix: str, items: list[str] | None = None):
        self.kind, self.ns, self.local, self.prefix, self.items = kind, ns, local, prefix, items


OUTSIDE = Element("other", "", "", "")


class Reader:
    """Properties from the tags of a packet, which need not be well-formed.

    Attributes of a description are properties; so are its elements, whose text or list items are their values. A
    structure's fields are named parent.field. Items of a list are joined; one in another language than the default is
    led by it. An end tag closes the element that is open, whatever its name; a prefix that is not declared stands for
    no namespace. An element's text is what stands right after its start tag.
    """

    def __init__(self) -> None:
        self.found: dict[tuple[str, str], str] = {}
        self.spaces: dict[str, str] = {}
        self.stack: list[Element] = []

    def copy(self) -> Reader:
        out = Reader()
        out.found, out.spaces = self.found.copy(), self.spaces.copy()
        out.stack = [Element(e.kind, e.ns, e.local, e.prefix, None if e.items is None else [*e.items]) if e.kind == "property" else e for e in self.stack]  # others never change
        return out

    def resolved(self, name: str) -> tuple[str, str]:
        prefix, colon, local = name.partition(":")
        return (self.spaces.get(prefix, ""), local) if colon else ("", name)

    def attributes(self, source: str) -> dict[tuple[str, str], str]:
        if not source or source == "/":
            return NO_ATTRIBUTES
        spaces, own = _short_attributes(source) if len(source) <= MOST_KEPT else _attributes(source)
        if spaces:
            self.spaces.update(spaces)
        return {self.resolved(n): v for n, v in own.items()} if own else NO_ATTRIBUTES

    def put(self, ns: str, name: str, value: str) -> None:
        if value:
            self.found.setdefault((ns, name), value)

    def put_attributes(self, own: dict[tuple[str, str], str], ns: str | None = None, prefix: str = "") -> None:
        for (space, local), value in own.items():
            if space not in ("", RDF, NAMESPACES["x"]):
                self.put(space if ns is None else ns, prefix + local, value)

    def start(self, tag: str, source: str, text: str) -> None:
        stack = self.stack
        if len(stack) >= MOST_DEPTH:
            raise ValueError("the packet's elements are nested too deeply")
        own = self.attributes(source) if source else NO_ATTRIBUTES
        ns, local = self.resolved(tag)
        up = stack[-1] if stack else OUTSIDE
        kind, prefix = up.kind, up.prefix
        me = Element("other", ns, local, prefix)
        if local == "Description" and ns == RDF and kind in ("other", "property"):
            me.kind = "description"
            if kind == "property":
                me.prefix, me.ns = f"{prefix}{up.local}.", up.ns
                self.put_attributes(own, up.ns, me.prefix)
            else:
                self.put_attributes(own)
        elif kind == "property":
            if ns == RDF and local in LISTS:
                me.kind, up.items = "list", []
        elif kind == "list":
            me.kind = "item"
            if text := unescaped(text.strip(" \t\r\n")):
                lang = next((v for (_, n), v in own.items() if n == "lang"), "") if own else ""
                stack[-2].items.append(text if lang in ("", "x-default") else f"{lang}|{text}")
        elif kind in ("description", "resource"):
            me.kind = "property"
            me.ns = ns or (up.ns if prefix else ns)
            if own:
                self.put(me.ns, prefix + local, own.get((RDF, "resource"), ""))
            if own and own.get((RDF, "parseType")) == "Resource":
                me.kind, me.prefix = "resource", f"{prefix}{local}."
            else:
                if own:
                    self.put_attributes(own, me.ns, f"{prefix}{local}.")
                self.put(me.ns, prefix + local, unescaped(text.strip(" \t\r\n")))
        stack.append(me)

    def end(self) -> None:
        me = self.stack.pop() if self.stack else OUTSIDE
        if me.items:
            self.found[me.ns, me.prefix + me.local] = SEPARATOR.join(me.items)

    def take(self, closing: str | None, tag: str | None, source: str | None, after: str) -> None:
        if closing:
            self.end()
        elif tag:
            self.start(tag, source, after)
            if source[-1:] == "/":
                self.end()

    def read(self, text: str, at: int = 0) -> None:
        """Takes the tags of a text from a place on."""
        for groups in _TAG.findall(text, at) if len(text) <= MOST_AT_ONCE else (m.groups() for m in _TAG.finditer(text, at)):
            self.take(*groups)

    def read_until(self, text: str, until: int) -> int:
        """Takes the tags of a text, those that end after `until` left out; gives the end of the last one taken."""
        at = 0
        for m in _TAG.finditer(text):
            if m.end() > until:
                break
            at = m.end()
            self.take(*m.groups())
        return at


@lru_cache(maxsize=256)
def _begun(head: str) -> Reader | None:
    """The reader of what a packet begins with, if a tag ends there: the next one has to begin for that to be seen."""
    reader = Reader()
    return reader if reader.read_until(head + "<", len(head)) == len(head) else None


def properties(b: bytes) -> dict[tuple[str, str], str]:
    """Values by namespace and name of a packet; ValueError if it is nested more than MOST_DEPTH deep.

    What stands before the properties, up to the first description's start tag, is often the same and read once a worker.
    """
    text = packet(b).decode("utf-8", "replace")
    first = text.find("<rdf:Description")
    at = text.find("<", first + 1) if first >= 0 else -1
    begun = _begun(text[:at]) if 0 < at <= MOST_KEPT else None
    reader = begun.copy() if begun else Reader()
    reader.read(text, at if begun else 0)
    while reader.stack:
        reader.end()
    return reader.found


def xmp_value(properties: DataFrame, ns: Column | str, local: Column | str) -> DataFrame:
    """path and value of one property, from xmp_properties(); images without it have no row."""
    return properties.where((F.col("ns") == ns) & (F.col("local") == local)).select("path", "value")


def xmp_properties(facts: DataFrame) -> DataFrame:
    """A row for each property of the XMP packets of images."""
    return facts.where("kind = 'xmp'").select("path", F.col("space").alias("ns"), F.col("name").alias("local"), F.col("value").cast("string").alias("value"))
