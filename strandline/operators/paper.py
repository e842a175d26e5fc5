"""Printable documents (PDF) of parents, made by SQL expressions.

A parent's first children become lines, lines become pages, and every page is two
numbered objects.  An object's place in its file is the sum of the lengths before it, so
the table of places at the end of the file is a running sum over the lengths of all
objects, which tasks have made apart.  Texts are cut as on paper and hold printable ASCII,
other characters become question marks, so that lengths in characters are lengths in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Children of a document, and lines of a page.
MOST, LINES = 200, 40

_HEADER = "%PDF-1.4\n"
_FIRST = 4  # objects before it: catalogue, pages, font


def cut(text: Column, most: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x20-\\x7E]", "?")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def lines_of(subs: DataFrame, most: int = MOST, lines: int = LINES) -> DataFrame:
    """cik, page, line (from 0), text: the first children of every parent by name, cut to their columns."""
    rank = F.row_number().over(Window.partitionBy("cik").orderBy("sub_name", "first_seen", "sub_norm"))
    columns = F.concat_ws(" | ", cut(F.col("sub_name"), 40), "first_seen", "last_seen", cut(F.col("time_in"), 35), cut(F.col("time_out"), 35), "confidence")
    kept = subs.withColumn("r", rank).where(F.col("r") <= most)
    return kept.select("cik", F.floor((F.col("r") - 1) / lines).cast("int").alias("page"), F.pmod(F.col("r") - 1, F.lit(lines)).cast("int").alias("line"), printable(columns).alias("text"))


def documents(subs: DataFrame, companies: DataFrame, most: int = MOST, lines: int = LINES) -> DataFrame:
    """cik, pages, pdf (text whose characters are its bytes): a document a parent that has children."""
    line = lines_of(subs, most, lines)
    drawn = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: F.concat(F.lit("("), _escaped(x["text"]), F.lit(") Tj T*\n"))), "")
    pages = line.groupBy("cik", "page").agg(drawn.alias("drawn"))
    about = F.concat_ws("", F.lit("Report: "), "company_name", F.lit(" - CIK: "), "cik", F.lit(" | Subsidiaries: "), "num_subsidiaries", F.lit(" | Period: "), "first_filing", F.lit(" to "), "last_filing")
    titled = pages.join(companies.select("cik", _escaped(printable(about)).alias("about")), "cik")
    title = F.when(F.col("page") == 0, F.concat(F.lit("/F1 12 Tf ("), F.col("about"), F.lit(") Tj T* /F1 7 Tf\n"))).otherwise("")
    stream = F.concat(F.lit("BT /F1 7 Tf 12 TL 36 570 Td\n"), title, F.col("drawn"), F.lit("ET"))
    number = F.col("page") * 2 + _FIRST
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /MediaBox [0 0 792 612] /Resources << /Font << /F1 3 0 R >> >> /Contents "), (number + 1).cast("string"), F.lit(" 0 R >>"))
    content = F.concat(F.lit("<< /Length "), F.length(stream).cast("string"), F.lit(" >>\nstream\n"), stream, F.lit("\nendstream"))
    bodies = titled.select("cik", F.explode(F.array(F.struct(number.alias("n"), page.alias("body")), F.struct((number + 1).alias("n"), content.alias("body")))).alias("o")).select("cik", "o.*")
    kids = F.array_join(F.transform(F.sequence(F.lit(0), F.col("pages") - 1), lambda p: F.concat((p * 2 + _FIRST).cast("string"), F.lit(" 0 R"))), " ")
    tree = F.concat(F.lit("<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), F.col("pages").cast("string"), F.lit(" >>"))
    fixed = pages.groupBy("cik").agg(F.count("*").cast("int").alias("pages"))
    roots = (F.lit("<< /Type /Catalog /Pages 2 0 R >>"), tree, F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"))
    heads = fixed.select("cik", F.explode(F.array(*(F.struct(F.lit(k).alias("n"), b.alias("body")) for k, b in enumerate(roots, 1)))).alias("o")).select("cik", "o.*")
    objects = bodies.unionByName(heads).select("cik", "n", F.concat(F.col("n").cast("string"), F.lit(" 0 obj\n"), F.col("body"), F.lit("\nendobj\n")).alias("object"))
    before = Window.partitionBy("cik").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = objects.withColumn("at", F.coalesce(F.sum(F.length("object")).over(before), F.lit(0)) + len(_HEADER))
    whole = placed.groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("n", "at", "object"))).alias("o"))
    text = F.array_join(F.transform("o", lambda x: x["object"]), "")
    table = F.array_join(F.transform("o", lambda x: F.concat(F.lpad(x["at"].cast("string"), 10, "0"), F.lit(" 00000 n \n"))), "")
    size = (F.size("o") + 1).cast("string")
    trailer = F.concat(F.lit("trailer\n<< /Size "), size, F.lit(" /Root 1 0 R >>\nstartxref\n"), (F.length(text) + len(_HEADER)).cast("string"), F.lit("\n%%EOF\n"))
    pdf = F.concat(F.lit(_HEADER), text, F.lit("xref\n0 "), size, F.lit("\n0000000000 65535 f \n"), table, trailer)
    return whole.select("cik", ((F.size("o") - _FIRST + 1) / 2).cast("int").alias("pages"), pdf.alias("pdf"))


def read_back(docs: DataFrame) -> DataFrame:
    """cik, pages, objects, sound (every place points at its object, and the end at the table), line, text: what documents say."""
    start = F.regexp_extract("pdf", r"startxref\n(\d+)", 1).cast("int")
    places = F.regexp_extract_all("pdf", F.lit(r"(\d{10}) 00000 n"), 1)
    here = lambda x, i: F.substring("pdf", x.cast("int") + 1, F.length((i + 1).cast("string")) + 6) == F.concat((i + 1).cast("string"), F.lit(" 0 obj"))
    sound = F.forall(F.transform(places, here), lambda x: x) & (F.substring("pdf", start + 1, F.lit(4)) == "xref")
    shown = F.regexp_extract_all("pdf", F.lit(r"(?m)^\((.*)\) Tj T\*$"), 1)
    # Judged before the lines become rows, so once a document.
    rows = docs.select("cik", "pages", F.size(places).alias("objects"), sound.alias("sound"), shown.alias("shown"))
    rows = rows.select("cik", "pages", "objects", "sound", F.posexplode("shown").alias("line", "text"))
    return rows.withColumn("text", F.regexp_replace("text", r"\\([\\()])", "$1"))
