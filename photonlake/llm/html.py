"""Main text of pages: markup says what an article is, and a suffix array of each host finds what its pages repeat.

One pass reads pages' markup into blocks: those of the article (or main element), or of the page where it marks none,
and those outside it, in menus, footers, adverts and the like. The token streams of all pages, host by host, go through
a suffix array, dealt out by the first RUN tokens of its suffixes: suffixes that begin with the same RUN tokens are
neighbours in the array, so such a bucket is a stretch of it with common prefixes of RUN tokens or more. A bucket that
has suffixes of two pages of distinct content marks a repeated run on each of them.

An article that a page marks is its text: authors repeat titles, quotations and phrases, and sites put sentences of
articles into menus and footers, so repetition tells nothing against a block of it. A page that marks no article has its
body, with whatever no name gives away. There the array decides: a run is boilerplate where it stands outside articles
on most of the pages that have it, or on pages with at least as much text of their own, and blocks that such runs cover
go, but for the h1. So only suffixes that begin with a run of some outside or body text are sorted: no other can be
boilerplate.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean, mapped
from .jaccard import BITMAP_BITS, _mixed

#: Tokens of the shortest run that counts as repeated, and the share of a block that such runs must cover.
RUN = 8
COVERED = 0.8
#: Pages of distinct content that must speak for a run.
VOTES = 2
#: Where a page's text stands.
OUTSIDE, ARTICLE, BODY = 0, 1, 2
#: Copies of a page's places, so that very many copies of a page are no single key of a join.
SALTS = 8

#: HTML elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("head nav footer aside form script style noscript template svg math iframe object canvas button select option textarea dialog menu title audio video label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Whole class names and ids that mark what is not the article. In an article classes alone do, and not
#: those of headings.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookie-banner cookie-notice cookies disqus footer gdpr login masthead menu modal nav"
    " navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies respond share sharing sidebar sidebars signup social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Classes of article elements that are no article of the page.
LESSER = frozenset("comment comments comment-body teaser related ad promo".split())

_TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r""">|=\s*["']""")
_AFTER_VALUE = frozenset(" \t\n\r\f/>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)


class Scanner:
    """The tags of a page in order, in time that grows with its length, whatever is left open in it.

    A quoted value is one that follows an equals sign and whose closing quote ends it as markup does, before white space,
    a slash or the tag's end; any other quote is a character like others. So a quote that is never closed takes no more
    than its own tag along.
    """

    def __init__(self, source: str):
        self.source = source
        self.quotes: dict[str, int] = {}

    def _closing(self, quote: str, at: int) -> int:
        """Where the next such quote stands; the last answer holds until it is passed."""
        known = self.quotes.get(quote, -1)
        if known < at:
            known = self.source.find(quote, at)
            self.quotes[quote] = known = len(self.source) if known < 0 else known
        return known

    def _end(self, at: int) -> int:
        """Where the > of a tag stands, or the end of the page."""
        n = len(self.source)
        while m := _STOP.search(self.source, at):
            if m[0] == ">":
                return m.start()
            close = self._closing(m[0][-1], m.end())
            well = close < n and (close + 1 == n or self.source[close + 1] in _AFTER_VALUE)
            at = close + 1 if well else m.end()
        return n

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start and end of the next tag or comment, whether it is an end tag, its name (none for a comment), attributes."""
        m = _TAG.search(self.source, at)
        if not m:
            return None
        n = len(self.source)
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = self.source.find(mark, m.end() if mark == ">" else m.start() + 2)
            return m.start(), n if end < 0 else end + len(mark), False, "", ""
        end = self._end(m.end())
        return m.start(), min(end + 1, n), bool(m[1]), m[2].lower(), self.source[m.end() : end]


def _drops(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element, with all that is in it, is no part of the article."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or attributes == "/":
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
    return False


def _named(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's class or id says that it is no part of the article."""
    if not attributes or attributes == "/" or name in ("html", "body", "main") or in_article and name in HEADINGS:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key == "class" or key == "id" and not in_article:
            names = LESSER if name == "article" else NAMES
            if not names.isdisjoint((m[2] or m[3] or m[4] or "").lower().split()):
                return True
    return False


class Page:
    """A page's blocks in order, which of them are an h1's, whether they are a marked article's, and what is outside."""

    def __init__(self, texts: list[str], headings: list[bool], marked: bool, outside: list[str]):
        self.texts, self.headings, self.marked, self.outside = texts, headings, marked, outside


def blocks(source: str | None) -> tuple[list[str], bool]:
    """A page's blocks of text in order, and whether they are those of a marked article."""
    page = scanned(source)
    return page.texts, page.marked


def scanned(source: str | None) -> Page:
    """A page by its markup.

    Character references are decoded; white space in a block, line breaks included, becomes one space. Elements that
    are left open end with what holds them; markup that is cut off at the end of the page is markup. An article in an
    element that is dropped for its name alone is the page's where there is no other. On a page that marks no article,
    short blocks that are links throughout and short lines about rights are outside.
    """
    source = source or ""
    scanner = Scanner(source)
    held_open: Counter[str] = Counter()
    stack: list[tuple[str, bool, bool, bool]] = []  # name, drops, region, named
    dropping = region = named = hidden = 0  # hidden: regions in elements that are dropped for their names
    text: list[str] = []
    aside: list[str] = []
    linked = heading = False  # whether links hold all text of the block, and whether an h1 is open in it
    out: list[tuple[str, int, bool, bool]] = []  # with 2 in an article, 1 in one within a named element, 0 elsewhere, 3 if dropped

    def add(piece: str) -> None:
        nonlocal linked, heading
        if dropping or named:
            aside.append(piece)
            return
        if not piece.isspace():
            linked = (linked or not any(not t.isspace() for t in text)) and held_open["a"] > 0
            heading = heading or held_open["h1"] > 0
        text.append(piece)

    def flush() -> None:
        nonlocal linked, heading
        for own, level in ((text, 0 if not region else 1 if hidden else 2), (aside, 3)):
            joined = _SPACE.sub(" ", html.unescape("".join(own))).strip() if own else ""
            if joined:
                out.append((joined, level, heading, linked))
            own.clear()
        linked = heading = False

    at = 0
    while tag := scanner.next(at):
        start, end, closes, name, attributes = tag
        if start > at:
            add(source[at:start])
        at = end
        if not name:
            continue
        if closes:
            if name in BLOCKS:
                flush()
            if held_open[name]:
                while True:
                    last, drops, opens, held = stack.pop()
                    held_open[last] -= 1
                    if drops or held:
                        flush()
                    dropping -= drops
                    region -= opens
                    if opens and not region:
                        named, hidden = hidden, 0
                    named -= held
                    if last == name:
                        break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                (aside if dropping or named else text).append(" ")
            continue
        if name in BLOCKS:
            flush()
        drops = _drops(name, attributes, region > 0)
        held = not drops and _named(name, attributes, region > 0)
        opens = not dropping and not drops and not held and not (region and named) and (name in ("article", "main") or "role" in attributes and bool(re.search(r"""role\s*=\s*["']?(?:main|article)\b""", attributes, re.I)))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if name == "xmp" and not drops and not held:
                add(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
            continue
        if not attributes.endswith("/") or name in BLOCKS:
            stack.append((name, drops, opens, held))
            held_open[name] += 1
            dropping += drops
            named += held
            if opens and not region:
                named, hidden = 0, named
            region += opens
    add(source[at:])
    flush()
    best = max((k for _, k, *_ in out if k < 3), default=0)
    plain = lambda t, link: not best and t.count(" ") < RUN - 1 and (link or bool(_RIGHTS.match(t)))
    own = [(t, h) for t, k, h, link in out if k == best and not plain(t, link)]
    return Page([t for t, _ in own], [h for _, h in own], best > 0, [t for t, k, _, link in out if k != best or plain(t, link)])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


_SPOOL = "page_id long, url string, host string, key long, marked boolean, blocks array<string>, headings array<boolean>, outside array<string>"


def parsed(pages: DataFrame, work: Workspace) -> DataFrame:
    """Pages by their markup, written once for all passes; key is what copies of a page have in common."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [scanned(x.as_py()) for x in batch.column("html")]
            keys = [content_key(h.as_py(), [*p.texts, "", *p.outside]) for h, p in zip(batch.column("host"), own)]
            lists = [pa.array([p.texts for p in own], pa.list_(pa.string())), pa.array([p.headings for p in own], pa.list_(pa.bool_())), pa.array([p.outside for p in own], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(keys, pa.int64()), pa.array([p.marked for p in own], pa.bool_()), *lists],
                names=["page_id", "url", "host", "key", "marked", "blocks", "headings", "outside"],
            )

    return work.stage(mapped(pages.select("page_id", "url", host(F.col("url")).alias("host"), "html"), read, _SPOOL), "pages", compression="zstd")


def content_key(own_host: str, own: list[str]) -> int:
    """What copies of a page on one host have in common."""
    return xxhash.xxh64_intdigest("\0".join([own_host, *own])) - (1 << 63)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every token of the texts, and where each text's tokens begin; each distinct token is hashed once."""
    lists = pc.split_pattern(texts, " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    starts = lists.offsets.to_numpy().astype(np.int64)
    return own[coded.indices.to_numpy()], starts - starts[0]


def heads_of(hosts: list[str], texts: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of `run` tokens of the texts: a hash of it and of its text's host, the text's number, and its place.

    Suffixes that begin alike have equal hashes. The last array has the number of tokens of each text.
    """
    h, starts = token_hashes(texts)
    n = np.diff(starts)
    m = max(0, len(h) - run + 1)
    x, factor = np.zeros(m, np.uint64), 1
    for k in range(run):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        x += h[k : k + m] * np.uint64(factor)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)[:m]
    place = np.arange(m) - starts[text]
    whole = place + run <= n[text]
    own = np.fromiter(map(xxhash.xxh64_intdigest, hosts), np.uint64, len(hosts))
    text, place = text[whole], place[whole].astype(np.int32)
    return _mixed(x[whole] + own[text]), text, place, n


Stream = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _streams(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> Iterator[Stream]:
    """Heads, the number of the stream of each and its place; and key, kind and number of tokens of the streams, which are
    the outside, article or body text of the pages. Of copies in a batch one is there."""
    for batch in batches:
        batch = batch.take(pa.array(np.sort(np.unique(batch.column("key").to_numpy(), return_index=True)[1])))
        key, hosts = batch.column("key").to_numpy(), np.array(batch.column("host").to_pylist(), object)
        body = np.where(batch.column("marked").to_numpy(zero_copy_only=False), ARTICLE, BODY)
        each = [(body, batch.column("blocks")), (np.full(len(key), OUTSIDE), batch.column("outside"))]
        kind, texts = np.concatenate([k for k, _ in each]), pa.concat_arrays([pc.binary_join(t, " ") for _, t in each])
        wanted = np.flatnonzero(np.isin(kind, kinds) & (pc.binary_length(texts).to_numpy() > 0))
        if len(wanted):
            page = wanted % len(key)
            head, stream, place, n = heads_of(hosts[page].tolist(), texts.take(pa.array(wanted)))
            yield head, stream, place, key[page], kind[wanted].astype(np.int32), n.astype(np.int32)


#: The leading bytes of a head that are sent to find repeated ones; what they let pass besides is told apart by whole heads.
SENT = 6
#: Heads that a task gathers before it sends them, and those that a bucket may have.
GATHERED, IN_BUCKET = 1 << 20, 1 << 22


def _bucketed(bits: int):
    """The heads of outside and body text by their first bits, sorted, as differences in planes of bytes.

    Of the heads of a page each is there once, and two of each among those that are gathered suffice.
    """

    def sent(heads: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(heads)) if heads else np.zeros(0, np.uint64)
        h = h[np.concatenate([np.ones(min(2, len(h)), bool), h[2:] != h[:-2]])] >> np.uint64(8 * (8 - SENT))
        steps, parts = np.diff(h, prepend=np.uint64(0)), []
        for k, at in zip(*np.unique(h >> np.uint64(8 * SENT - bits), return_index=True)):
            parts.append((int(k), int(at)))
        ends = [at for _, at in parts[1:]] + [len(h)]
        data = []
        for (k, at), end in zip(parts, ends):
            own = steps[at:end].copy()
            own[0] = h[at]
            data.append(own.byteswap().view(np.uint8).reshape(-1, 8)[:, 8 - SENT :].T.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "heads"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for head, stream, *_ in _streams(batches, (OUTSIDE, BODY)):
            order = np.lexsort((stream, head))
            h, s = head[order], stream[order]
            held.append(h[np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (s[1:] != s[:-1])])])
            if sum(map(len, held)) >= GATHERED:
                yield sent(held)
                held = []
        if held:
            yield sent(held)

    return go


def _repeated(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading bytes of the heads of one bucket that are there more than once, as heads that end in zeros."""
    parts = []
    for batch in rows:
        for x in batch.column("heads"):
            planes = np.frombuffer(x.as_py(), np.uint8).reshape(SENT, -1)
            steps = np.zeros((planes.shape[1], 8), np.uint8)
            steps[:, 8 - SENT :] = planes.T
            parts.append(np.cumsum(steps.view(">u8").reshape(-1).astype(np.uint64)))
    h = np.sort(np.concatenate(parts)) << np.uint64(8 * (8 - SENT))
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[1:][h[1:] == h[:-1]]).view(np.int64))], names=["head"])


def _bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap with two bits for each ID, by its first BITMAP_BITS bits and by those that end at its 48th; it may let
    others pass, never drops one."""
    first, second = F.shiftrightunsigned(column, 64 - BITMAP_BITS), F.shiftrightunsigned(column, 16).bitwiseAND((1 << BITMAP_BITS) - 1)
    rows = ids.select(F.explode(F.array(first + 1, second + 1)).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS - 15, 4096), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    def bit(at: np.ndarray) -> np.ndarray:
        return bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1

    return (bit(h >> np.uint64(64 - BITMAP_BITS)) & bit(h >> np.uint64(16) & np.uint64((1 << BITMAP_BITS) - 1))).astype(bool)


_PLACED = "head long, at array<struct<key: long, kind: int, n: int, place: int>>"
#: Repeated heads up to which a bitmap tells them, being at most half full; beyond, they are joined.
MOST_IN_BITMAP = 1 << BITMAP_BITS - 2


def _packed(head: np.ndarray, key: np.ndarray, kind: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A row for each head, so that a head of very many pages has few rows."""
    order = np.argsort(head, kind="stable")
    head, key, kind, n, place = head[order], key[order], kind[order], n[order], place[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(head)), bool), head[1:] != head[:-1]]))
    ends = np.append(first, len(head))
    inner = pa.StructArray.from_arrays([pa.array(key), pa.array(kind), pa.array(n), pa.array(place)], names=["key", "kind", "n", "place"])
    return pa.RecordBatch.from_arrays([pa.array(head[first]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner)], names=["head", "at"])


def repeated_runs(spool: DataFrame, work: Workspace, most: int = MOST_IN_BITMAP) -> DataFrame:
    """head, key, kind, n and place (from 0) of the runs of RUN tokens that two contents of a host have outside articles
    or in bodies.

    Suffixes are dealt by the hash of their first RUN tokens, those of outside and body text first: what is alone in its
    bucket ends there, as about SENT bytes. Only runs that repeat there send their places, and those of articles with
    them. Copies of a page count as one.
    """
    spark = spool.sparkSession
    streams = spool.select("host", "key", "marked", "blocks", "outside")
    size = streams.agg(F.sum(F.aggregate("outside", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)) + F.when(F.col("marked"), 0).otherwise(F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))))).first()[0] or 0
    bits = min(max(8, (size // 6 // IN_BUCKET).bit_length()), 20)  # some six bytes a token
    shared = work.stage(mapped(streams, _bucketed(bits), "bucket int, heads binary").groupBy("bucket").applyInArrow(lean(_repeated), "head long"), "heads")
    few = shared.count() <= most
    bitmap = spark.sparkContext.broadcast(_bits(shared, "head")) if few else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, stream, places, key, kind, n in _streams(batches, (OUTSIDE, ARTICLE, BODY)):
            at = np.flatnonzero(_has(bitmap.value, head)) if bitmap else np.arange(len(head))
            if len(at):
                own = stream[at]
                yield _packed(head[at].view(np.int64), key[own], kind[own], n[own], places[at])

    placed = mapped(streams, place, _PLACED)
    if not few:
        whole = F.shiftleft(F.shiftrightunsigned("head", 8 * (8 - SENT)), 8 * (8 - SENT))
        placed = placed.withColumn("lead", whole).join(shared.withColumnRenamed("head", "lead"), "lead", "left_semi").drop("lead")
    placed = work.stage(placed, "placed", compression="zstd")
    others = placed.select("head", F.inline("at")).where(F.col("kind") != ARTICLE)
    differing = others.groupBy("head").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("head")
    return work.stage(placed.join(differing, "head", "left_semi"), "runs", compression="zstd").select("head", F.inline("at"))


def stretches(places: list[int], n: int, run: int = RUN) -> tuple[list[int], int]:
    """For each of the places in order, the number of tokens of the covered stretch that it is in; and the tokens of the page that no run covers."""
    out, start = [], 0
    for k, p in enumerate(places):
        if k + 1 == len(places) or places[k + 1] > p + run:
            out += [p + run - places[start]] * (k + 1 - start)
            start = k + 1
    covered = sum(out[k] for k, p in enumerate(places) if not k or p > places[k - 1] + run)
    return out, n - covered


def unique_blocks(candidates: list[str], places: list[int] | None, headings: list[bool] | None = None, run: int = RUN, covered: float = COVERED) -> list[str]:
    """The blocks that repeated runs do not cover; those of headings, if given, stay."""
    out, start, ends, marked = [], 0, 0, []  # covered stretches as places of tokens
    for p in sorted(places or ()):
        marked += range(max(p, ends), p + run)
        ends = max(ends, p + run)
    for k, block in enumerate(candidates):
        n = len(block.split(" "))
        if headings and headings[k] or bisect_left(marked, start + n) - bisect_left(marked, start) < covered * n:
            out.append(block)
        start += n
    return out


def evidence(runs: DataFrame) -> DataFrame:
    """head, outside and inside: the contents that have a run outside articles and in a marked one."""
    kinds = runs.select("head", "key", "kind").distinct()
    return kinds.groupBy("head").agg(F.count(F.when(F.col("kind") == OUTSIDE, 1)).alias("outside"), F.count(F.when(F.col("kind") == ARTICLE, 1)).alias("inside"))


def boilerplate(runs: DataFrame, work: Workspace) -> DataFrame:
    """key and places of the runs that count as boilerplate.

    Only runs of bodies do. One is a host's boilerplate where VOTES contents or more have it outside articles, and more
    than have it in one; or where VOTES bodies speak for it: those whose own text is at least as long as the covered
    stretch that the run is in. Pages that share an article have little else, so they don't speak for its runs; pages
    that otherwise differ do for a menu's.
    """
    told = work.stage(evidence(runs).where((F.col("outside") >= VOTES) & (F.col("outside") > F.col("inside"))).select("head"), "told")
    bodies = runs.where(F.col("kind") == BODY)
    by_page = bodies.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("place", "head"))).alias("runs"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, key = [], []
            for k, n, own_runs in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "runs"))):
                long, own = stretches([x["place"] for x in own_runs], n)
                speaks = {x["head"] for x, m in zip(own_runs, long) if m <= own}
                head += speaks
                key += [k] * len(speaks)
            if head:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.int64()), pa.array(key, pa.int64())], names=["head", "key"])

    votes = mapped(by_page, measure, "head long, key long").groupBy("head").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= VOTES).select("head")
    return bodies.join(votes.unionByName(told).distinct(), "head", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of all pages.

    Null and empty html have empty text; a null url is a host of its own; repeated rows give a row each and count as one
    page; an empty table gives no rows; further columns are ignored.
    """
    work = Workspace(pages.sparkSession, "html")
    spool = parsed(pages, work)
    places = work.stage(boilerplate(repeated_runs(spool, work), work), "places", compression="zstd")
    work.drop("heads", "placed", "runs", "told")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = ["\n".join(unique_blocks(*(x.as_py() for x in own))) for own in zip(*(batch.column(c) for c in ("blocks", "places", "headings")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    bitmap = spool.sparkSession.sparkContext.broadcast(_bits(places, "key"))

    def some(covered: bool):
        """Pages that may have places, or the others."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_has(bitmap.value, batch.column("key").to_numpy().view(np.uint64)) == covered))

        return mapped(spool.select("page_id", "url", "key", "blocks", "headings"), go, "page_id long, url string, key long, blocks array<string>, headings array<boolean>")

    plain = some(False).select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = some(True).withColumn("salt", salt).join(salted, ["key", "salt"], "left")
    kept = mapped(open_.select("page_id", "url", "blocks", "headings", "places"), keep, "page_id long, url string, text string")
    return plain.unionByName(kept).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_html": op4_html}
ORACLE_SQL: dict[str, str] = {}
