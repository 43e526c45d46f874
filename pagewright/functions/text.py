"""Column helpers that keep whitespace, line breaks and regex classes at their usual Unicode meaning.

Spark's regex engine defaults to ASCII classes and ``trim`` strips only U+0020; the sources are scanned documents
and a latin-1 log, so both matter.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import rules

# ---- fixed values: the characters that count as white space ---------------------------------------
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def java(pattern: str, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """Spell ``pattern`` for Java: Unicode classes, ``\\n`` as the only line end, explicit white-space class."""
    flags = "dU" + ("i" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    return f"(?{flags})" + pattern.replace(r"\s", _SPACE_CLASS)


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(java(pattern, ignore_case))


def any_match(col: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """One pass over the text for a whole list of alternatives, trying them at word starts only where all begin there."""
    if all(p.startswith(r"\b") for p in patterns):
        return matches(col, r"\b(?:" + "|".join(p.removeprefix(r"\b") for p in patterns) + ")", ignore_case)
    return matches(col, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def extract(col: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
    return F.regexp_extract(col, java(pattern, ignore_case), group)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def split_lines(col: Column) -> Column:
    """Lines without their ends; a final line end opens no extra line."""
    parts = F.split(col, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def known(col: Column) -> Column:
    """The value when it says something; NULL for missing and empty."""
    return F.nullif(col, F.lit(""))


def excerpt(col: Column, limit: int) -> Column:
    """The first ``limit`` characters, with dots when something was left out."""
    return F.concat(F.substring(col, 1, limit), F.when(F.length(col) > limit, F.lit("...")).otherwise(F.lit("")))


def escape_unprintable(col: Column) -> Column:
    """Spell every character outside the printable ASCII range as ``\\xNN``. Clean values take the short way."""
    def spell(c: Column) -> Column:
        code = F.lower(F.hex(F.ascii(c)))
        padded = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
        return F.when(c.rlike(r"[^\x20-\x7e]"), F.concat(F.lit("\\x"), padded)).otherwise(c)

    spelled = F.array_join(F.transform(F.split(col, ""), spell), "")
    return F.when(col.rlike(r"[^\x20-\x7e]"), spelled).otherwise(col)


def clean_caption(col: Column) -> Column:
    """Drop the lead-ins a captioning model tends to write, each at most once and in this order."""
    for prefix in rules.CAPTION_PREFIXES:
        col = F.regexp_replace(col, java(prefix, ignore_case=True), "")
    return strip(col)


def tokens(col: Column) -> Column:
    """Distinct search tokens: slash/dot compounds first, then plain runs, in order of first appearance.

    The patterns run without backtracking, and compounds are looked for only in texts that hold an inner slash or dot.
    """
    low = F.lower(col)
    compound = "(?<![a-z0-9])" + rules.COMPOUND_TOKEN.replace("+(", "++(").replace("+)", "++)")
    inner = low.rlike(r"[/.](?<=[a-z0-9][/.])[a-z0-9]")
    compounds = F.when(inner, F.regexp_extract_all(low, F.lit(compound), F.lit(0))).otherwise(
        F.array().cast("array<string>"))
    plain = F.regexp_extract_all(low, F.lit(rules.STANDARD_TOKEN + "+"), F.lit(0))
    return F.array_distinct(F.concat(compounds, plain))


def pad(col: Column, width: int, right: bool = False) -> Column:
    """Fixed-width cell; longer values stay whole."""
    return F.format_string(f"%{'' if right else '-'}{width}s", col)
