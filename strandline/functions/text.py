"""The few text functions that have no built-in form, as Arrow batches, and those that do."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strandline.functions.names import trimmed

# Broken encodings and what they stood for.
MOJIBAKE = (
    ("\u00e2\u0080\u0093", "\u2013"), ("\u00e2\u0080\u0094", "\u2014"), ("\u00e2\u0080\u0099", "\u2019"), ("\u00e2\u0080\u009c", "\u201c"),
    ("\u00e2\u0080\u009d", "\u201d"), ("\u00c2\u00a0", " "), ("\u00ef\u00bf\u00bd", ""),
)
# Words kept in capitals.
CAPITALS = ("LLC", "LP", "LLP", "INC", "CORP", "CO", "LTD", "NA", "SA", "AG", "NV", "BV", "PLC", "SE", "USA", "UK", "II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "XII", "DE", "DBA")


@pandas_udf(StringType())
def unescape(names: pd.Series) -> pd.Series:
    """HTML entities resolved; the table of named entities has no built-in form."""
    return names.map(html.unescape, na_action="ignore")


def _title(name: str) -> str:
    def word(w: str) -> str:
        if w.upper().rstrip(".,;:") in CAPITALS:
            return w.upper()
        return w.title() if w.isupper() or w.islower() else w

    return " ".join(map(word, name.split()))


@pandas_udf(StringType())
def title_words(names: pd.Series) -> pd.Series:
    """Words in one case to title case, listed ones to capitals; ``initcap`` starts words at blanks only."""
    return names.map(_title, na_action="ignore")


def mended(col: Column) -> Column:
    """Broken encodings replaced."""
    for bad, good in MOJIBAKE:
        col = F.replace(col, F.lit(bad), F.lit(good))
    return col


def squeezed(col: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def year_in(col: Column) -> Column:
    """First four digits in a row as a number; null if there are none."""
    return F.try_to_number(F.nullif(F.regexp_extract(col, r"(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")


def padded_key(col: Column, width: int = 10) -> Column:
    return F.lpad(col.cast("string"), width, "0")


def shortened(col: Column, size: int) -> Column:
    """At most ``size`` characters, the cut marked."""
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit("..."))).otherwise(col)


def json_in(text: Column) -> Column:
    """The JSON object in free text: the text itself, a fenced block, or from the first brace to the last; null if none parses."""
    whole = trimmed(text)
    fenced = trimmed(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1), F.lit("")))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(whole), ok(fenced), ok(braces))


# Word groups that decide an article's event, in order.
EVENT_WORDS = (
    ("External Acquisition", "acquired|acquisition|bought|purchased|merger|takeover"),
    ("Restructuring", "restructur|reorganiz|renamed|rebrand|converted|successor"),
    ("Joint Venture", "joint venture|partnership|jointly owned"),
    ("Spin-off", "spun off|spin-off|spinoff|spun out"),
    ("Internal Creation", "founded|incorporated|established|registered|subsidiary of"),
)
# Parts of words to which a given type is corrected, in order.
TYPE_PARTS = (
    ("External Acquisition", "acqui|bought|purchase"),
    ("Internal Creation", "internal|creat|incorp"),
    ("Restructuring", "restructur|reorg|rename"),
    ("Joint Venture", "joint|jv"),
    ("Spin-off", "spin"),
)
TYPES = ("Internal Creation", "External Acquisition", "Restructuring", "Joint Venture", "Spin-off", "Unknown")


def event_of(article: Column) -> Column:
    """Type by the first group of words that occurs in an article; null if none does."""
    low = F.lower(article)
    return F.coalesce(*(F.when(low.rlike(p), F.lit(t)) for t, p in EVENT_WORDS))


def valid_type(col: Column) -> Column:
    low = F.lower(col)
    return F.when(col.isin(*TYPES), col).otherwise(F.coalesce(*(F.when(low.rlike(p), F.lit(t)) for t, p in TYPE_PARTS), F.lit("Unknown")))


def valid_confidence(col: Column) -> Column:
    return F.when(col.isin("HIGH", "MEDIUM", "LOW"), col).otherwise("MEDIUM")
