"""Short rules on labels, names, titles and sizes, as expressions; a few in Arrow where decomposition is needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import collapse, let, roman_to_int, signature_key, signature_parts

# Families of shelfmarks, the most particular first.
FAMILIES = (("Marg", r"(?i)\bLeibn\.?\s*Marg"), ("LBr", r"(?i)\bLBr\b"), ("LK", r"(?i)\bLK[-\s]"), ("LH", r"\bLH\b"))


def shelfmark_family(mark: Column) -> Column:
    """The family of a shelfmark, ``other`` of one that has none, null of a blank one."""
    chain = F.when(F.coalesce(F.trim(mark), F.lit("")) == "", F.lit(None).cast("string"))
    for family, pattern in FAMILIES:
        chain = chain.when(F.rlike(mark, F.lit(pattern)), family)
    return chain.otherwise("other")


def best_family(marks: Column) -> Column:
    """The first family in order that any of an array of shelfmarks has; ``other`` or null as for one."""
    found = F.transform(F.coalesce(marks, F.array().cast("array<string>")), shelfmark_family)
    order = [f for f, _ in FAMILIES] + ["other"]
    return F.coalesce(*(F.when(F.array_contains(found, f), F.lit(f)) for f in order))


def split_ref(ref: Column) -> Column:
    """struct(page_id, seq) of a line's reference ``work:page:line``."""
    return F.struct(F.regexp_extract(ref, r"^(.*):[^:]*$", 1).alias("page_id"), F.regexp_extract(ref, r":(\d+)$", 1).try_cast("int").alias("seq"))


def piece_key(piece: Column) -> Column:
    """A piece's number without leading zeros, with its letter."""
    return F.regexp_replace(F.lower(F.trim(piece)), r"^0+(?=\d)", "")


_DIGIT_LOOKS = ("IiloO", "11100")  # letters that a reader takes for digits; fixed values


# What a piece's heading looks like, and the least share of capitals among its letters.
HEADING, HEADING_CAPITALS = r"^([\dIil]{1,3})\s*([a-z])?\s*[.,]\s+([A-ZÄÖÜÉÈÀ].{3,})$", 0.6


def heading(text: Column) -> Column:
    """struct(number, letter) of the heading of a piece (a number, a stop, a title mostly in capitals), or null."""
    line, pattern = F.trim(text), HEADING
    title = F.regexp_extract(line, pattern, 3)
    letters, capitals = (F.length(title) - F.length(F.regexp_replace(title, c, "")) for c in (r"\p{L}", r"\p{Lu}"))
    number = F.regexp_replace(F.translate(F.regexp_extract(line, pattern, 1), *_DIGIT_LOOKS), r"^0+(?=.)", "")
    return F.when(F.rlike(line, F.lit(pattern)) & (letters >= 4) & (capitals >= HEADING_CAPITALS * letters), F.struct(number.alias("number"), F.regexp_extract(line, pattern, 2).alias("letter")))


def convolute(key: Column) -> Column:
    """The shelfmark key of the convolute that a letter's number ("16.2", "I.6.1") belongs to; null for another shape."""
    text = F.trim(key)
    # fixed values: numbers of letters with princes, and of others
    princes, plain = r"^[IVX]+\.(\d+[a-z]?)(?:\.\d+[a-z]?)?$", r"^(\d+[a-z]?)(?:\.\d+[a-z]?)?$"
    raw = F.when(F.rlike(text, F.lit(princes)), F.concat(F.lit("LBr. F "), F.regexp_extract(text, princes, 1))).when(F.rlike(text, F.lit(plain)), F.concat(F.lit("LBr. "), F.regexp_extract(text, plain, 1)))
    return F.when(raw.isNotNull(), signature_key(raw))


def truncated(text: Column, limit: int) -> Column:
    """One line cut at a word's end near ``limit`` with an ellipsis, or inside a word that fills most of it."""

    def cut(line):
        head = F.substring(line, 1, limit + 1)
        at = F.length(head) - F.length(F.regexp_replace(head, "^.* ", "")) - 1
        kept = F.when(at < limit * 0.6, F.substring(line, 1, limit)).otherwise(F.substring(line, F.lit(1), at))
        return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(kept, r"[ ,;:.\-–—/|\[(]+$", ""), F.lit("…")))

    return let(collapse(F.coalesce(text, F.lit(""))), cut)


def section_phrase(title: Column) -> Column:
    """What a manuscript's title says before its shelfmark, without the usual beginning and preposition; null without one."""
    line = collapse(F.coalesce(title, F.lit("")))
    mark = r"\s+LH\s*[0-9IVXLC]"
    head = F.trim(F.element_at(F.split(line, mark, 2), 1))
    bare = F.trim(F.regexp_replace(F.regexp_replace(head, r"(?i)^Leibnit?z\s*[-_ ]\s*Hand?schriften\b\s*", ""), r"^(?:zur|zum|zu)\s+", ""))
    return F.when(F.rlike(line, F.lit(mark)), F.nullif(bare, F.lit("")))


_TAGS = r"(?:\s*\((?:KorrespDB|GND)\))+"  # link texts of the catalogue; fixed values


def cell_names(cell: Column) -> Column:
    """The names in a sender's or addressee's cell, without link texts, doubts and placeholders."""
    pieces = F.split(F.coalesce(cell, F.lit("")), _TAGS)
    clean = lambda p: F.regexp_replace(F.trim(F.regexp_replace(collapse(F.replace(p, F.lit("(?)"), F.lit(" "))), r"\?+$", "")), r",(?=\S)", ", ")
    return F.filter(F.transform(pieces, clean), lambda n: ~n.isin("", "?", "u.a.", "u. a."))


def generic_title(title: Column, phrases: Sequence[str] = ()) -> Column:
    """Whether a title says nothing of the work: it is empty, or one of the library's own phrases (lower case)."""
    return F.lower(collapse(F.coalesce(title, F.lit("")))).isin("", *phrases)


def display_title(title: Column, family: Column, mark: Column, label: Column, phrases: Sequence[str] = ()) -> Column:
    """What names a work whose title is generic: mark and label of a letter convolute, else mark or label; null where the title speaks."""
    some = lambda c: F.nullif(c, F.lit(""))
    letter = (family == "LBr") & some(mark).isNotNull() & (label != mark)
    return F.when(generic_title(title, phrases), F.when(letter, F.concat(mark, F.lit(" · "), label)).otherwise(F.coalesce(some(mark), some(label))))


def catalogue_spelling(mark: Column) -> Column:
    """A shelfmark as the catalogue spells it: its label, single Roman groups as numbers, no leaves or notes; null without a family."""
    labels = F.create_map(*(F.lit(x) for kv in {"LH": "LH", "LBr": "LBr", "Marg": "Leibn. Marg.", "LK": "LK"}.items() for x in kv))

    def spelled(p):
        tail = F.element_at(F.split(p["tail"], r"(?i)\bBl(?:att|\.|\b)", 2), 1)
        groups = F.filter(F.transform(F.split(tail, ","), collapse), lambda g: g != "")
        numbered = F.transform(groups, lambda g: F.coalesce(roman_to_int(g).cast("string"), g))
        first = F.get(numbered, 0)
        princes = (p["family"] == "LBr") & F.rlike(first, F.lit(r"(?i)^F\.?\s*\d"))
        label = F.when(princes, "LBrF").otherwise(F.element_at(labels, p["family"]))
        shown = F.transform(numbered, lambda g, i: F.when(princes & (i == 0), F.regexp_replace(g, r"(?i)^F\.?\s*", "")).otherwise(g))
        return F.when(p["family"].isNotNull() & (F.size(numbered) > 0), F.concat(label, F.lit(" "), F.array_join(shown, ", ")))

    return let(signature_parts(F.regexp_replace(collapse(F.coalesce(mark, F.lit(""))), r"^L[Hh](?=\s*\d)", "LH ")), spelled)


def record_title(metadata: Column) -> Column:
    """A record's title out of its JSON, on one line."""
    found = F.coalesce(F.nullif(F.get_json_object(metadata, "$.titel"), F.lit("")), F.nullif(F.get_json_object(metadata, "$.title"), F.lit("")))
    return collapse(found)


def document_id(page_id: Column) -> Column:
    return F.replace(page_id, F.lit(":"), F.lit("_"))


def file_name(page_id: Column) -> Column:
    return F.concat(document_id(page_id), F.lit(".jpg"))


def piece_group(lang: Column, top: Column) -> Column:
    """de (also mixed led by de), la_fr or other."""
    return F.when((lang == "de") | ((lang == "mixed") & (top == "de")), "de").when(lang.isin("la", "fr"), "la_fr").otherwise("other")


def published_lang(german: Column, lang: Column) -> Column:
    """de of a page flagged German; another page's verdict, unknown where that says de."""
    return F.when(german, "de").when(lang == "de", "unknown").otherwise(lang)


def hand_class(siglum: Column) -> Column:
    return F.when(siglum.isin("L", "l"), "L").otherwise("K/k")


def print_type(lang: Column) -> Column:
    return F.when(lang == "de", "fraktur").otherwise("roman")


def reply_status(stop: Column, text: Column) -> Column:
    """refused, runaway, empty or ok, the first that holds."""
    return F.when(stop == "refusal", "refused").when(stop == "length", "runaway").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("ok")


def stop_kind(raw: Column, kinds: Mapping[str, Sequence[str]]) -> Column:
    """The kind (end, length, refusal) whose lower-cased words hold a stop reason, else ``other:`` and the reason."""
    reason = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(*(F.when(F.lower(reason).isin(*words), F.lit(kind)) for kind, words in kinds.items()), F.concat(F.lit("other:"), reason))


def has_bracket(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\[\]]"))


def ends_in_letter(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{L}\s*$"))


def heavy_layout(lines: Column, overlaps: Column, short: Column, *, overlap_share: float = 0.20, short_share: float = 0.35) -> Column:
    """Whether so many of a page's lines overlap or are short that it holds additions; false without lines."""
    of = lambda c: F.coalesce(c, F.lit(0)) / F.nullif(lines, F.lit(0))
    return F.coalesce((of(overlaps) >= overlap_share) | (of(short) >= short_share), F.lit(False))


def outside_band(ratio: Column, confidence: Column, *, low: Column, high: Column, least: Column) -> Column:
    """Why a line is out of a band: no_reading, ratio_low or ratio_high, and conf_low; an empty array inside."""
    first = F.when(ratio.isNull(), "no_reading").when(ratio < low, "ratio_low").when(ratio > high, "ratio_high")
    return F.array_compact(F.array(first, F.when(confidence < least, "conf_low")))


def flags(tests: Mapping[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))


def first_of(found: Column, order: Sequence[str]) -> Column:
    """The first name in ``order`` that an array has; null if none."""
    return F.coalesce(*(F.when(F.array_contains(found, name), F.lit(name)) for name in order))


def text_gate(volumes: Column, expired: Column, deposit: Column) -> Column:
    """Why a text may not be used, or null: its volumes are known, all expired, and its deposit is open.

    ``volumes`` and ``expired`` are arrays of keys, the latter those of ``volumes`` that are free.
    """
    known = (F.size(volumes) > 0) & ~F.exists(volumes, lambda v: v.isNull())
    return F.when(~known, "no_volume").when(F.size(F.array_except(volumes, expired)) > 0, "not_70_expired").when(deposit == "nc", "nc_channel").when(~deposit.eqNullSafe(F.lit("open")), "channel_not_released")


def fold_verdict(first: Column, second: Column, target: Column) -> Column:
    """Which of two folded readings is the folded target: v1, alt, both_wrong, ambiguous (both) or unfoldable (an empty target)."""
    a, b = first == target, second == target
    return F.when(target == "", "unfoldable").when(a & b, "ambiguous").when(a, "v1").when(b, "alt").otherwise("both_wrong")


def mean_of(values: Column) -> Column:
    """The mean of an array of doubles; null of an empty one."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def mean_token_probability(ids: Column, logs: Column, skip: Sequence[int]) -> Column:
    """The mean probability of tokens that are not in ``skip``; null if none is left."""
    both = F.filter(F.arrays_zip(ids.alias("i"), logs.alias("l")), lambda p: ~p["i"].isin(*skip) if skip else F.lit(True))
    return mean_of(F.transform(both, lambda p: F.exp(p["l"])))


def thumb_distance(a: Column, b: Column) -> Column:
    """The mean absolute difference of two arrays of grey values."""
    return mean_of(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.abs(p["a"].cast("double") - p["b"].cast("double"))))


def tile_tokens(width: Column, height: Column, *, tile: int = 258, small: int = 384) -> Column:
    """Tokens of an image cut into tiles of two thirds of its short side; one tile if small. Fixed values of the rule."""
    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    unit = F.greatest(F.lit(1.0), F.floor(F.least(w, h) / 1.5).cast("double"))
    return F.when((w <= small) & (h <= small), tile).otherwise(tile * F.ceil(w / unit) * F.ceil(h / unit)).cast("long")


#: The groups of zone classes that a name tells; fixed values. Others are told by a table.
ZONE_WORDS = (("formula", ("math", "formula")), ("figure", ("graphic", "figure")))


def zone_group(name: Column, groups: Mapping[str, str]) -> Column:
    """The group of a zone's class: by the table, else by a word in its name, else other."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)), name) if groups else F.lit(None).cast("string")
    worded = [F.when(F.contains(F.lower(name), F.lit(w)), F.lit(g)) for g, words in ZONE_WORDS for w in words]
    return F.coalesce(known, *worded, F.lit("other"))


def home_group(shares: Column, *, least: float = 0.5) -> Column:
    """The group with the largest share of a line in a map of shares, if that is ``least`` or more; else outside."""
    best = F.array_max(F.transform(F.map_entries(shares), lambda e: F.struct(e["value"].alias("s"), e["key"].alias("g"))))
    return F.when(best["s"] >= least, best["g"]).otherwise("outside")


# --- Arrow functions -----------------------------------------------------------------------------------------------


def _decomposed(form: str, drop) -> callable:
    def plain(text: str) -> str:
        return "".join(c for c in unicodedata.normalize(form, text) if not drop(c))

    return plain


def name_fold(text: str) -> str:
    """Without case and marks, for names as typed."""
    return _decomposed("NFKD", unicodedata.combining)(text or "").casefold()


#: Macron, tilde and overline are dropped, hyphen signs and the curly apostrophe made plain; fixed values.
PRINT_MARKS, PRINT_SIGNS = frozenset("\u0304\u0303\u0305"), str.maketrans("¬⸗’", "--'")


def print_fold(text: str) -> str:
    return unicodedata.normalize("NFC", _decomposed("NFD", PRINT_MARKS.__contains__)(text).translate(PRINT_SIGNS))


def model_line(text: str, form: str = "NFC") -> str:
    """A line on a language model's alphabet: composed, without control characters, single spaces."""
    shown = "".join(" " if c.isspace() else c for c in unicodedata.normalize(form, text) if c.isspace() or unicodedata.category(c)[0] != "C")
    return " ".join(shown.split())


#: Names of the model's own tokens; fixed values.
SPACE, RESERVED = "<space>", ("<ctc>", "<space>", "<unk>", "<s>", "</s>")


def model_token(char: str) -> str:
    """A character's name in the model: the space's own, code points of what would be lost, else itself."""
    if char == " ":
        return SPACE
    lost = not char or char in RESERVED or any(c.isspace() or unicodedata.category(c)[0] == "C" for c in char)
    return "<" + "_".join(f"U+{ord(c):04X}" for c in char) + ">" if lost else char


def corpus_line(text: str) -> str:
    return " ".join(map(model_token, text))


_GLYPHS = {"(cid:104)": "⟨", "(cid:105)": "⟩"}  # fixed values of one typeface
# Editorial brackets within a word, on their own, and in angles.
_WITHIN = re.compile(r"(?<=[^\s\[])\[([^\[\]\s]{1,6})\]|\[([^\[\]\s]{1,6})\](?=[^\s\]])")
_INNER, _ANGLE = re.compile(r"\s?\[[^\[\]]*\]"), re.compile(r"\s?⟨[^⟨⟩]*⟩")


def clean_print(text: str) -> str:
    """A text layer's line: known glyph codes as signs, others gone, spacing diaereses composed, single spaces."""
    for code, sign in _GLYPHS.items():
        text = text.replace(code, sign)
    text = re.sub(r"([AEIOUYaeiouy])¨", "\\1\u0308", re.sub(r"\(cid:\d+\)", "", text))
    return " ".join(unicodedata.normalize("NFC", text).split())


def without_brackets(text: str) -> tuple[str, int, int, int, int]:
    """(text, attached, standalone, angle, stray): letters in brackets within a word stay, other brackets go with what they hold."""
    text, angle = _ANGLE.subn("", text)
    text, attached = _WITHIN.subn(lambda m: m[1] or m[2], text)
    standalone, n = 0, 1
    while n:
        text, n = _INNER.subn("", text)
        standalone += n
    text, stray = re.subn(r"[\[\]⟨⟩]", "", text)
    return " ".join(text.split()), attached, standalone, angle, stray


def _of_text(work):
    @F.pandas_udf(T.StringType())
    def apply(text: pd.Series) -> pd.Series:
        return text.map(work, na_action="ignore")

    return apply


fold_names, fold_print, line_for_model, line_of_corpus, clean_layer = map(_of_text, (name_fold, print_fold, model_line, corpus_line, clean_print))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("attached", "standalone", "angle", "stray"))]))
def resolve_brackets(text: pd.Series) -> pd.DataFrame:
    rows = [without_brackets(t) if t is not None else (None,) * 5 for t in text]
    return pd.DataFrame(rows, columns=["text", "attached", "standalone", "angle", "stray"])


def engine_query(words: Sequence[str], phrases: Sequence[Sequence[str]], excluded: Sequence[Sequence[str]]) -> str:
    """A parsed query in the syntax of a search server that reads few terms: exclusions first, phrases, then words, the last of which it completes."""
    quoted = [f'"{" ".join(p)}"' for p in phrases]
    return " ".join([*(f'-"{" ".join(p)}"' if len(p) > 1 else f"-{p[0]}" for p in excluded), *quoted, *words])


# The piece numbers in a running head.
_HEAD, _NUMBER = re.compile(r"\bN\s*[.,]?\s*((?:[\dIil]{1,3}\s*[.,]?\s*)+)"), re.compile(r"[\dIil]{1,3}")


def head_pieces(text: str) -> list[str]:
    """The numbers that a running head lists after ``N.``: letters read for digits are digits, a section's numeral after them is none, a number cut in two is one."""
    found = _HEAD.search(text)
    if not found:
        return []
    listed = found[1]
    if re.match(r"\s*[^\W\d_]", text[found.end() :]):  # a title goes on, so a last numeral of letters is its own
        listed = re.sub(r"(?<=[\dIil])[\s.,]+[Iil]{1,3}[\s.,]*$", "", listed)
    digits = listed.translate(str.maketrans(*_DIGIT_LOOKS))
    if cut := re.fullmatch(r"\s*(\d)(?:[\s.,]+\1)+[\s.,]*", digits):
        digits = cut[1] * len(re.findall(r"\d", digits))
    return [str(int(n)) for n in re.findall(r"\d{1,3}", digits)]


def written_names(cell: str | None) -> list[str]:
    """The names of a cell as they stand, doubts kept: a mark after a link text belongs to the name before it."""
    # the mark is put before the link texts that it follows
    marked = re.sub(rf"(?<!\?)({_TAGS})\s*(?:\(\?\)|\?)(?={_TAGS}|\s*$)", r" ?\1", cell or "")
    spaced = (re.sub(r",(?=\S)", ", ", " ".join(name.split())) for name in re.split(_TAGS, marked))
    return [name for name in spaced if name]


def model_char(char: str) -> str | None:
    """A character on the folded alphabet of a model; None where the fold drops it or makes several of it."""
    from quillmark.functions.unicode import fold

    if char == " ":
        return char
    folded = fold(char)
    return folded if len(folded) == 1 else None


def patch_tokens(width: int, height: int, *, patch: int = 28, edge: int = 2576, most: int = 4784) -> int:
    """Tokens of an image cut into patches, after it is scaled within a long edge and a number of patches. Fixed values of the rule."""
    w, h = max(1, width), max(1, height)
    if max(w, h) > edge:
        w, h = (max(1, round(x * edge / max(w, h))) for x in (w, h))
    while (n := -(-w // patch) * -(-h // patch)) > most:
        shrink = (most / n) ** 0.5 * 0.995
        w, h = max(1, int(w * shrink)), max(1, int(h * shrink))
    return n


def work_ids(url: Column) -> Column:
    """The ids that an address names, by object id, else by catalogue number; each once. The patterns are fixed values."""
    found = lambda p: F.array_distinct(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(p), F.lit(1)))
    by_id = found(r"resolve\?id=([A-Za-z0-9][\w\-]*)")
    return F.when(F.size(by_id) > 0, by_id).otherwise(found(r"resolve\?PPN=([A-Za-z0-9][\w\-]*)"))
