"""Catalogue cells, hands, strata, licences and guards as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import collapse, let


def clean(cell: Column) -> Column:
    """A cell without outer and repeated white space; '' for null."""
    return collapse(F.coalesce(cell, F.lit("")))


def _joined(separator: str, *cells: Column) -> Column:
    return F.concat_ws(separator, *(F.nullif(c, F.lit("")) for c in cells))


def _parted(digits: Column, year: int) -> Column:
    """Digits of a date as year[-month[-day]], where 00 ends it."""
    month, day = F.substring(digits, year + 1, 2), F.substring(digits, year + 3, 2)
    return F.concat(F.substring(digits, 1, year), F.when(month == "00", "").otherwise(F.concat(F.lit("-"), month, F.when(day == "00", "").otherwise(F.concat(F.lit("-"), day)))))


def date_cell(ymd: Column, other: Column) -> Column:
    """"YYYY[-MM[-DD]] (YY[-MM[-DD]])": the date and, in parentheses, the other calendar's; what is no date stays as it is."""
    main = let(clean(ymd), lambda d: F.when(F.rlike(d, F.lit(r"^\d{8}$")), _parted(d, 4)).otherwise(d))
    alt = let(clean(other), lambda d: F.when(F.rlike(d, F.lit(r"^\d{1,6}$")), _parted(F.lpad(d, 6, "0"), 2)).otherwise(d))
    return let(F.struct(main.alias("m"), alt.alias("a")), lambda x: F.when((x["m"] != "") & (x["a"] != ""), F.concat(x["m"], F.lit(" ("), x["a"], F.lit(")"))).otherwise(x["m"]))


def number_cell(letters: Column, number: Column, addition: Column) -> Column:
    """"KA 12/b"; '' without a number."""
    head = _joined(" ", clean(letters), clean(number))
    return F.when(clean(number) == "", "").otherwise(_joined("/", head, clean(addition)))


#: Names of bibliographic formats by code; others are the code with a degree sign. Fixed values.
FORMATS = {"2": "2°", "4": "4°", "8": "8°"}


def extent_cell(code: Column, extent: Column, formats: Mapping[str, str] = FORMATS) -> Column:
    """"4°, 6.2 Seiten/Spalten"; zero extents and codes are left out, what is no number stays."""
    names = F.create_map(*(F.lit(x) for kv in formats.items() for x in kv))
    form = let(clean(code), lambda c: F.when(c.isin("", "0"), "").otherwise(F.coalesce(F.try_element_at(names, c), F.concat(c, F.lit("°")))))
    value = F.try_to_number(clean(extent), F.lit("99999999.99999"))
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(value, 2).cast("double")), "0+$", ""), r"\.$", "")
    size = F.when(clean(extent) == "", "").when(value.isNull(), clean(extent)).when(F.round(value, 2) == 0, "").otherwise(F.concat(digits, F.when(digits == "1", " Seite/Spalte").otherwise(" Seiten/Spalten")))
    return _joined(", ", form, size)


def edition_cell(series: Column, volume: Column, number: Column, part: Column, edition: Column) -> Column:
    """"III | 2.045 / a Aufl. 2": series, volume and number to three digits, part and edition where given."""
    n = clean(number)
    padded = F.when(F.rlike(n, F.lit(r"^\d+$")), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0"))).otherwise(n)
    place = F.when((clean(volume) != "") & (n != ""), F.concat(F.lit(" | "), clean(volume), F.lit("."), padded)).otherwise("")
    tail = F.when(clean(part) == "", "").otherwise(F.concat(F.lit(" / "), clean(part)))
    printed = F.when(clean(edition) == "", "").otherwise(F.concat(F.lit(" Aufl. "), clean(edition)))
    return F.when(clean(series) == "", "").otherwise(F.concat(clean(series), place, tail, printed))


# --- hands and strata --------------------------------------------------------------------------------------------

#: Abbreviations of whole documents: "eigh." before one of them is the whole piece. Fixed values.
DOCUMENT_TYPES = ("abf", "konz", "reinschr", "abschr", "ausz", "mf", "entw", "aufz", "notiz", "text", "exz")


def hand(textart: Column) -> Column:
    """own, partial, other or none, from what a catalogue says of a piece's kind."""
    t = F.lower(F.coalesce(textart, F.lit("")))
    parts = F.transform(F.split(F.replace(t, F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p))
    rest = lambda p: F.trim(F.regexp_replace(p, r"^eigh\.*", ""))
    own = F.exists(parts, lambda p: F.startswith(p, F.lit("eigh")) & ((rest(p) == "") | F.regexp_replace(F.element_at(F.split(rest(p), r"\s+"), 1), r"\.+$", "").isin(*DOCUMENT_TYPES)))
    return F.when(F.trim(t) == "", "none").when(~F.contains(t, F.lit("eigh")), "other").when(own, "own").otherwise("partial")


def is_person(name: Column, forms: Sequence[str]) -> Column:
    """Whether a name, without authority marks and trailing commas, is one of ``forms`` in any case."""
    plain = F.rtrim(collapse(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\((?:GND|KorrespDB)\)", " ")), F.lit(","))
    return F.lower(plain).isin(*(f.lower() for f in forms))


def in_own_hand(hand_: Column, sender: Column, forms: Sequence[str]) -> Column:
    return (hand_ == "own") & ((F.coalesce(sender, F.lit("")) == "") | is_person(sender, forms))


#: Keywords of a piece's kind and the stratum they say, first hit first. Fixed values.
STRATUM_WORDS = (
    (("reinschrift", "abfertigung", "ausfertigung"), "fair_copy"),
    (("abschrift", "kopie"), "fair_copy"),
    (("konzept", "entwurf"), "heavy_revision"),
    (("auszug", "exzerpt", "notiz", "aufzeichnung", "fragment"), "scrap"),
)


def stratum_of_kind(textart: Column) -> Column:
    out = F.lit(None).cast("string")
    for words, stratum in reversed(STRATUM_WORDS):
        out = F.when(F.rlike(F.lower(textart), F.lit("|".join(words))), stratum).otherwise(out)
    return out


def stratum_of_page(lines: Column, overlaps: Column, short: Column, cv: Column) -> Column:
    """unknown without lines, scrap for three or fewer, else by how regular, overlapping and short lines are."""
    n = F.when(lines > 0, lines)
    over, brief, var = F.coalesce(overlaps, F.lit(0)) / n, F.coalesce(short, F.lit(0)) / n, F.coalesce(cv, F.lit(0.0))
    signals = sum((t.cast("int") for t in (var >= 0.45, over >= 0.20, brief >= 0.35)), F.lit(0))
    return (
        F.when(F.coalesce(lines, F.lit(0)) <= 0, "unknown")
        .when(lines <= 3, "scrap")
        .when((signals >= 2) | (over >= 0.5), "heavy_revision")
        .when((var <= 0.28) & (over <= 0.05) & (brief <= 0.15), "fair_copy")
        .otherwise("light_revision")
    )


def stratum_of_piece(pages: Column, kind: Column) -> Column:
    """Blends the pages' stratum and the kind's: alone as they are, scrap wins, else the graver but one step from the other."""
    grave = lambda s: F.when(s == "fair_copy", 0).when(s == "heavy_revision", 2).otherwise(1)
    step = F.least(F.greatest(grave(pages), grave(kind)), F.least(grave(pages), grave(kind)) + 1)
    blended = F.when(step == 0, "fair_copy").when(step == 1, "light_revision").otherwise("heavy_revision")
    return F.when(pages.isNull() & kind.isNull(), "unknown").when(pages.isNull(), kind).when(kind.isNull(), pages).when((pages == "scrap") | (kind == "scrap"), "scrap").when(pages == kind, pages).otherwise(blended)


# --- licences ----------------------------------------------------------------------------------------------------


def deposit(channels: Column, bucket: Column, registry: Mapping[str, str | None]) -> Column:
    """open, nc or null: an unknown or closed channel keeps out, one nc channel makes nc, else the bucket must be open."""
    known = F.create_map(*(F.lit(x) for k, v in registry.items() if v for x in (k, v)))
    of = F.transform(F.coalesce(channels, F.array().cast("array<string>")), lambda c: F.try_element_at(known, c))
    return F.when(F.exists(of, lambda d: d.isNull()), None).when(F.exists(of, lambda d: d == "nc"), "nc").when(bucket == "open", "open")


def expired(year: Column, term: Column, today: Column) -> Column:
    """Whether protection of ``term`` years from ``year`` has ended by ``today``, at the turn of the year."""
    return today >= F.make_date(year + term, F.lit(1), F.lit(1))


# --- guards ------------------------------------------------------------------------------------------------------


def leaf_side(label: Column) -> Column:
    """r or v if a label names one side of leaves only."""
    sides = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(r"(?i)\d+\s*([rv])\b"), F.lit(1)), F.lower))
    return F.when(F.size(sides) == 1, F.get(sides, 0))


def sizes_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1024.0), 0.001 * F.greatest(a, b))


def crosses(x: Column, width: Column, fold: Column) -> Column:
    """A box lies across a fold with a fifth of its width on either side."""
    return (width > 0) & (F.least(fold - x, x + width - fold) >= 0.20 * width)


def png_size(data: Column) -> Column:
    """struct(width, height) from a PNG's header, or null."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    png = (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(data, 13, 4)) == "49484452") & (F.length(data) >= 24)
    return F.when(png, F.struct(number(17).alias("width"), number(21).alias("height")))


def sliver_reason(data: Column) -> Column:
    """Why a crop is too thin to read, or null."""
    return let(png_size(data), lambda s: F.when((F.least(s["width"], s["height"]) < 4) | (F.greatest(s["width"], s["height"]) > 100 * F.least(s["width"], s["height"])), F.format_string("sliver_crop:%dx%d", s["width"], s["height"])))


def tiles_of_512(width: Column, height: Column) -> Column:
    """Image tokens by tiles of 512 within 2048 by 2048 and a short side of 768: 85 and 170 a tile."""
    w, h = F.greatest(width, F.lit(1)).cast("double"), F.greatest(height, F.lit(1)).cast("double")
    fit = F.least(F.lit(1.0), 2048 / F.greatest(w, h))
    again = F.least(F.lit(1.0), 768 / (F.least(w, h) * fit))
    return (85 + 170 * F.ceil(w * fit * again / 512) * F.ceil(h * fit * again / 512)).cast("long")


def price(name: Column, prices: Mapping[str, float]) -> Column:
    """The price of the longest prefix of a name."""
    out = F.lit(None).cast("double")
    for prefix in sorted(prices, key=len):
        out = F.when(F.startswith(name, F.lit(prefix)), F.lit(prices[prefix])).otherwise(out)
    return out
