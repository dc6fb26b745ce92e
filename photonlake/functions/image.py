"""Expressions over image bytes and decoded metadata; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import ENUMS


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a plain reuse would repeat its expression in each place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(digits: Column, big: Column, n: int) -> Column:
    """The number that 2 n hexadecimal digits stand for; null if there are fewer."""
    swapped = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])
    return F.when(F.length(digits) == 2 * n, F.conv(F.when(big, digits).otherwise(swapped), 16, 10).cast("long"))


def unsigned(value: Column, order: Column, at: Column | int = 0, n: int = 2) -> Column:
    """The unsigned number in n bytes from `at`, in the byte order II or MM; null if they are not there."""
    part = value.substr(F.lit(at) + 1, F.lit(n))
    return let(F.hex(part), lambda digits: _number(digits, order == "MM", n))


def signed(value: Column, order: Column, at: Column | int = 0, n: int = 4) -> Column:
    return let(unsigned(value, order, at, n), lambda u: F.when(u >= 1 << 8 * n - 1, u - (1 << 8 * n)).otherwise(u))


#: Bytes of a TIFF file that tell its kind, and the most entries of its first directory.
SNIFFED, MOST_SNIFFED = 1034, 512


def _tiff_kind(h: Column) -> Column:
    """DNG if the first directory has a DNGVersion, else what the Make says; h: hexadecimal digits of the file's head."""
    big = h.startswith("4D4D")

    def digit(place: Column | int) -> Column:
        """Where a byte's digits start; places beyond the head, which may be beyond an int, are at its end."""
        return F.least(F.lit(place).cast("long"), F.lit(SNIFFED)).cast("int") * 2 + 1

    def at(place: Column | int, n: int) -> Column:
        return _number(h.substr(digit(place), F.lit(2 * n)), big, n)

    def kind(start: Column) -> Column:
        def of(n: Column) -> Column:
            places = F.when(n.between(1, MOST_SNIFFED), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: start + 2 + i * 12)).otherwise(F.array().cast("array<bigint>"))
            tags = F.transform(places, lambda e: F.struct(at(e, 2).alias("tag"), at(e + 4, 4).alias("count"), at(e + 8, 4).alias("offset"), e.alias("at")))
            return let(tags, told)

        return let(F.coalesce(at(start, 2), F.lit(0).cast("long")), of)

    def told(tags: Column) -> Column:
        make = F.get(F.filter(tags, lambda e: e["tag"] == 0x010F), F.lit(0))
        name = let(make, lambda m: F.regexp_replace(F.unhex(h.substr(digit(F.when(m["count"] <= 4, m["at"] + 8).otherwise(m["offset"])), F.least(m["count"], F.lit(SNIFFED)).cast("int") * 2)).cast("string"), "[\\x00 ]+$", ""))
        by_make = let(name, lambda x: F.when(x.isin("NIKON CORPORATION", "Nikon"), "NEF").when(x == "SONY", "ARW").otherwise("TIFF"))
        return F.when(F.exists(tags, lambda e: e["tag"] == 0xC612), "DNG").otherwise(by_make)

    return let(F.coalesce(at(4, 4), F.lit(0).cast("long")), kind)


def image_format(content: Column) -> Column:
    """The container by its first bytes, never by its name; TIFF files are refined by IFD0. Unknown is null."""

    def known(h: Column) -> Column:
        iso = F.substring(h, 17, 8)
        return (
            F.when(h.startswith("FFD8"), "JPEG")
            .when(h.startswith("89504E470D0A1A0A"), "PNG")
            .when(h.startswith("52494646") & (iso == "57454250"), "WebP")
            .when(F.substring(h, 9, 8) == "66747970", F.when(iso == "63727820", "CR3").when(iso.rlike("^(617669|617630)"), "AVIF").otherwise("HEIF"))
            .when(h.startswith("49492A00") & (F.substring(h, 17, 4) == "4352"), "CR2")
            .when(h.startswith("4949524F"), "ORF")
            .when(h.startswith("49495500"), "RW2")
            .when(h.startswith("49492A00") | h.startswith("4D4D002A"), let(F.hex(F.substring(content, 1, SNIFFED)), _tiff_kind))
        )

    return let(F.hex(F.substring(content, 1, 12)), known)


def ascii_value(value: Column, kind: Column) -> Column:
    """A text value without its trailing NULs; null unless of type ASCII and not empty."""
    return F.when(kind == 2, F.nullif(F.regexp_replace(value.cast("string"), "\\x00+$", ""), F.lit("")))


def short_value(value: Column, kind: Column, order: Column) -> Column:
    """A SHORT; a value of another type that is there is 0."""
    return F.when(kind.isin(3, 8), F.coalesce(unsigned(value, order, 0, 2), F.lit(0))).otherwise(F.when(value.isNotNull(), 0))


def rational(value: Column, kind: Column, order: Column, i: int = 0) -> Column:
    """num and den of the i-th rational; null for another type or too few bytes."""
    both = F.struct(unsigned(value, order, 8 * i, 4).alias("num"), unsigned(value, order, 8 * i + 4, 4).alias("den"))
    return let(both, lambda r: F.when(kind.isin(5, 10) & r["den"].isNotNull(), r))


def quotient(r: Column) -> Column:
    """num / den, null where den is 0."""
    return F.when(r["den"] != 0, r["num"].cast("double") / r["den"].cast("double"))


def degrees(parts: list[Column], ref: Column, most: int, strict: bool = False) -> Column:
    """A coordinate from degrees, minutes and seconds and its hemisphere; null out of range.

    A part with denominator 0 counts as 0, or makes the coordinate null if strict.
    """
    own = [quotient(p) if strict else F.coalesce(quotient(p), F.lit(0.0)) for p in parts]
    at = own[0] + own[1] / 60 + own[2] / 3600
    return F.when(F.abs(at) <= most, F.when(F.upper(ref).isin("S", "W"), -at).otherwise(at))


def xmp_parts(text: Column) -> Column:
    """The numbers of a coordinate in the form D,M.mR or D,M,SR, as texts; one empty text if it isn't one."""
    return F.split(F.regexp_extract(text, r"^\s*([0-9.]+(?:,[0-9.]+){1,2})[NSEW]\s*$", 1), ",")


def xmp_degrees(parts: Column, text: Column, most: int) -> Column:
    """A coordinate from its numbers, which xmp_parts gives, and its text; null if it isn't one or is out of range."""
    at = F.try_element_at(parts, F.lit(1)).try_cast("double") + F.try_element_at(parts, F.lit(2)).try_cast("double") / 60 + F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(0.0)) / 3600
    return F.when(F.abs(at) <= most, F.when(F.upper(F.substring(F.trim(text), -1, 1)).isin("S", "W"), -at).otherwise(at))


def exif_time(text: Column, offset: Column | None = None) -> Column:
    """The instant of an EXIF date and time, in its offset or else in UTC; null if it isn't one."""
    date = F.when(text.rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"), F.concat(F.replace(F.substring(text, 1, 10), F.lit(":"), F.lit("-")), F.substring(text, 11, 9)))
    zone = F.when(offset.rlike(r"^[+-]\d\d:\d\d$"), offset) if offset is not None else F.lit(None).cast("string")
    return F.try_to_timestamp(F.concat(date, F.coalesce(zone, F.lit("Z"))))


def xmp_time(text: Column) -> Column:
    """The instant of an ISO date and time; one without a zone is in UTC."""
    whole = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
    return F.try_to_timestamp(F.when(whole, F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))))


def first_of(text: Column) -> Column:
    """The first item of a multiple value."""
    return F.nullif(F.split(text, "\u001e")[0], F.lit(""))


def items_of(text: Column) -> Column:
    """All items of a multiple value that are not empty; null if there is none."""
    items = F.filter(F.split(text, "\u001e"), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def described(name: str, number: Column) -> Column:
    """What the standard calls a number; null for others."""
    out = F.lit(None).cast("string")
    for k, text in ENUMS[name].items():
        out = F.when(number == k, text).otherwise(out)
    return out


def flash_fired(number: Column) -> Column:
    return number.bitwiseAND(1) == 1


def exposure_text(r: Column) -> Column:
    """1/den for a unit numerator, else num/den; null where den is 0."""
    return F.when(r["den"] != 0, F.concat(r["num"].cast("string"), F.lit("/"), r["den"].cast("string")))
