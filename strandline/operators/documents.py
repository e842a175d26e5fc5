"""Child names from filed documents: table cells, else lines of the list, else names by their legal ending."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from strandline.functions.names import trimmed
from strandline.functions.text import squeezed

# Starts of lines that are headings, marks that open the list, heads of columns, names by ending and by shape.
NOT_NAMES = r"(?iU)^(exhibit\s*\d|page\s*\d|subsidiaries?\s*of|list\s+of|name\s+of|jurisdiction|state\s+of|incorporated|organized|\*+$|-+$|=+$)"
OPENS = r"(?i)exhibit\s*21|subsidiaries|list of subsidiar"
COLUMN_HEADS = r"(?i)^(name\s+of|jurisdiction|state|country|incorporated)"
BY_ENDING = r"(?im)^[\s\d.)*-]*(.+?(?:LLC|Inc\.?|Corp\.?|Ltd\.?|L\.?P\.?|N\.?V\.?|S\.?A\.?|GmbH|B\.?V\.?|PLC|Limited|Corporation|Company|Co\.|Group|Holdings?))[\s,]*(?:\(.*?\))?\s*$"
BY_SHAPE = r"(?m)^\s*(?:\d+[.)]\s*)?([A-Z][A-Za-z\s&.,'-]+(?:LLC|Inc|Corp|Ltd|LP)\.?)"


class _Rows(HTMLParser):
    """First cells of table rows, and the text with a line for each piece."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables, self.cell, self.firsts, self.pieces = 0, None, [], []
        self.row_done, self.hidden = True, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden = True
        elif tag == "table":
            self.tables += 1
        elif tag == "tr":
            self.close_cell()
            self.row_done = not self.tables
        elif tag in ("td", "th"):
            self.close_cell()
            if not self.row_done:
                self.cell, self.row_done = [], True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag in ("script", "style"):
            self.hidden = False
        if tag == "table":
            self.tables = max(0, self.tables - 1)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.pieces.append(data)
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())

    def close_cell(self) -> None:
        if self.cell is not None:
            self.firsts.append("".join(self.cell))
            self.cell = None


def _parsed(text: str) -> _Rows:
    parser = _Rows()
    parser.feed(text)
    parser.close()
    parser.close_cell()
    return parser


_PAGE = StructType([StructField("cells", ArrayType(StringType())), StructField("lines", ArrayType(StringType())), StructField("text", StringType())])


@pandas_udf(_PAGE)
def parsed(pages: pd.Series) -> pd.DataFrame:
    """First cells of table rows, the lines that aren't blank, and the text; HTML has no built-in parser.

    Text without tags is as it is; of markup each piece of text is a line.
    """

    def one(page: str | None) -> tuple:
        if page is None:
            return None, None, None
        low = page.lower()
        found = _parsed(page) if "<" in page else None
        text = page if found is None else "\n".join(found.pieces)
        cells = found.firsts if found is not None and ("<table" in low or "<tr" in low) else []
        return cells, [x for line in text.split("\n") if (x := line.strip())], text

    rows = [one(p) for p in pages]
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(("cells", "lines", "text"))})


@pandas_udf(ArrayType(StringType()))
def first_spellings(names: pd.Series) -> pd.Series:
    """The first of names that differ in case only, in order; a set of what was seen has no built-in form for arrays."""

    def one(ns: list[str]) -> list[str]:
        seen: dict[str, str] = {}
        for n in ns:
            seen.setdefault(n.lower(), n)
        return list(seen.values())

    return names.map(one, na_action="ignore")


def looks_like_name(text: Column) -> Column:
    text = trimmed(text)
    return F.length(text).between(3, 200) & ~text.rlike(r"(?U)^\d+$") & ~text.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$") & ~text.rlike(NOT_NAMES)


def name_in_line(line: Column) -> Column:
    """The name at the start of a line, without numbering and place; empty if nothing is left."""
    line = F.regexp_replace(line, r"(?U)^\s*[\d.)*\-]+\s*", "")
    line = trimmed(F.get(F.split(line, r"(?U)\s{3,}|\t+", 2), F.lit(0)))
    return trimmed(F.regexp_replace(F.regexp_replace(line, r"(?U)\s*\(.*?\)\s*$", ""), r"(?U)\s+[A-Z]{2}\s*$", ""))


def from_lines(lines: Column) -> Column:
    """Names in the (trimmed) lines after the first one that opens the list; where that gives none, in all lines that look like names."""
    first = F.array_position(F.transform(lines, lambda x: x.rlike(OPENS)), F.lit(True))
    listed = F.filter(F.slice(lines, F.greatest(first.cast("int"), F.lit(1)), F.size(lines)), lambda x: ~x.rlike(OPENS) & ~x.rlike(COLUMN_HEADS))
    names = F.filter(F.transform(listed, name_in_line), lambda n: (n != "") & looks_like_name(n))
    return F.when(first > 0, names).otherwise(F.array().cast("array<string>"))


def from_all_lines(lines: Column) -> Column:
    return F.filter(F.transform(F.filter(lines, looks_like_name), name_in_line), lambda n: n != "")


def from_patterns(text: Column) -> Column:
    pick = lambda p: F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), 1), trimmed), lambda n: F.length(n) > 2)
    named = pick(BY_ENDING)
    return F.when(F.size(named) > 0, named).otherwise(pick(BY_SHAPE))


def distinct_names(names: Column) -> Column:
    """Squeezed names of three characters and more, the first spelling of each, in order."""
    return first_spellings(F.filter(F.transform(names, squeezed), lambda n: F.length(n) >= 3))


def parse_documents(docs: DataFrame, content: str) -> DataFrame:
    """``docs`` with names: cells of tables, else lines, else patterns.

    A page is parsed once, and each array is made once: the two functions over batches
    keep what they return, so later expressions read it instead of repeating it.
    """
    rows = docs.withColumn("__p", parsed(content))
    cells = F.filter("__p.cells", lambda n: (n != "") & looks_like_name(n))
    lines = F.col("__p.lines")
    none = F.array().cast("array<string>")
    or_else = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    names = or_else(cells, or_else(from_lines(lines), or_else(from_all_lines(lines), from_patterns(F.col("__p.text")))))
    return rows.withColumn("names", F.coalesce(distinct_names(names), none)).drop("__p")


def entities(docs: DataFrame, content: str, key: str) -> DataFrame:
    """key, ordinal, sub_name: a row a name."""
    return parse_documents(docs, content).select(key, F.posexplode("names").alias("ordinal", "sub_name"))


def raw_documents(docs: DataFrame, content: str, most: int = 50_000) -> DataFrame:
    """What is stored of a parsed document: text cut to a length, names as JSON (columns cik, accession, filing_date kept)."""
    return docs.withColumn("parsed_subsidiaries", F.to_json("names")).withColumn("raw_text", F.substring(content, 1, most)).drop("names", content)
