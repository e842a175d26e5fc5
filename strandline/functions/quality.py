"""Detectors and cleaners of names: the tagging engine and the stricter one, kept apart as they differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.names import trimmed
from strandline.functions.text import MOJIBAKE, mended, squeezed, title_words, unescape

TAG = "<[^>]+>"
GARBAGE = r"[^\x20-\x7E\u00C0-\u00FF]{3,}"
ENCODING = "&[a-zA-Z]+;|&#\\d+;|\u00c3.|\u00e2\u20ac.|\u00c2"
MOJIBAKE_LEFT = "\u00c3.|\u00e2\u20ac.|\u00c2"
ISSUES = ("html", "garbage", "short", "truncated", "encoding")


def issue_flags(name: Column) -> dict[str, Column]:
    """A test for each issue; a null name has none."""
    found = {
        "html": name.rlike(TAG),
        "garbage": name.rlike(GARBAGE),
        "short": F.length(trimmed(name)) <= 2,
        "truncated": F.regexp_replace(name, r"(?U)\s+$", "").endswith("..."),
        "encoding": name.rlike(ENCODING),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def detect_issues(name: Column) -> Column:
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in issue_flags(name).items())))


def clean_name(name: Column, fix_html: bool = True, remove_garbage: bool = True, fix_encoding: bool = True) -> Column:
    if fix_html:
        name = unescape(F.regexp_replace(name, TAG, ""))
    if fix_encoding:
        name = F.regexp_replace(unescape(name), MOJIBAKE_LEFT, "")
    if remove_garbage:
        name = F.regexp_replace(name, GARBAGE, "")
    return squeezed(name)


def clean_action(name: Column, cleaned: Column) -> Column:
    """delete what is empty or too short afterwards, clean what changed, skip the rest."""
    return F.when(F.length(F.coalesce(cleaned, F.lit(""))) <= 2, "delete").when(cleaned != name, "clean").otherwise("skip")


# The stricter engine.

CSS_BLOCK = r"(?s)\{[^}]*\}"
STYLE = "(?i)style\\s*=\\s*[\"'][^\"']*[\"']"
ENTITY = "&[a-zA-Z]+;|&#\\d+;|&#x[0-9a-fA-F]+;"
# What form fields leave behind.
FORM_TEXT = (
    r"(?iU)^\s*\??\s*(y\s*(or|/)\s*n|yes\s*(or|/)\s*no|n\s*/\s*a|none|see\s+attached|check\s+box|select\s+one|fill\s+in"
    r"|enter\s+name|name\s+of\s+subsidiary|not\s+applicable|same\s+as\s+above)\s*$"
)


def strip_markup(name: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, CSS_BLOCK, ""), STYLE, ""), TAG, " ")
    return trimmed(F.regexp_replace(F.regexp_replace(unescape(name), ENTITY, " "), r"(?U)\s{2,}", " "))


def _count(name: Column, keep: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(name, f"[^{keep}]", ""))


def is_garbage(name: Column) -> Column:
    """Empty, unprintable, letterless or vowelless names."""
    name = trimmed(F.coalesce(name, F.lit("")))
    size, letters = F.length(name), _count(name, r"\p{L}")
    unprintable = F.length(F.regexp_replace(name, r"[^\p{C}\p{Z}]| ", ""))
    return (
        (size <= 1)
        | (unprintable > size * 0.3)
        | ((size > 3) & (letters < size * 0.25))
        | name.rlike(r"^(?U)[\W_]{3,}$")
        | ((_count(name, "a-zA-Z") > 5) & ~name.rlike("(?i)[aeiou]"))
    )


def is_form_text(name: Column) -> Column:
    return F.coalesce(name.rlike(FORM_TEXT), F.lit(False))


def has_markup(name: Column) -> Column:
    return F.coalesce(name.rlike(TAG) | name.rlike(CSS_BLOCK) | name.rlike(STYLE), F.lit(False))


def has_broken_encoding(name: Column) -> Column:
    return F.coalesce(name.rlike("|".join([*(bad for bad, _ in MOJIBAKE), "\ufffd"])), F.lit(False))


def is_truncated(name: Column) -> Column:
    return F.coalesce(name.rlike("(?U)(?:\\.\\.\\.|\u2026)\\s*$"), F.lit(False))


def is_short(name: Column, least: int = 3) -> Column:
    return F.coalesce(F.length(trimmed(name)) < least, F.lit(True))


def normal_name(name: Column) -> Column:
    """Encoding mended, white space squeezed, outer dashes and bullets gone, one-case words in title case."""
    name = F.regexp_replace(mended(trimmed(name)), r"(?U)\s{2,}", " ")
    return title_words(F.regexp_replace(name, "^[-\u2013\u2014\u00b7\u2022 \t]+|[-\u2013\u2014\u00b7\u2022 \t]+$", ""))
