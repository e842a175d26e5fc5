"""Registered queries over scenarios that are planted into the driver's suppliers.

Every supplier gets a scenario of its own: a query's input is the scenario once for each
row of ``supplier``, with the supplier's number where the texts have ``§`` and in the keys,
so that its groups are its own and the work grows with the table.  The SQL states the rows
that must come out, by hand, for every supplier.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import names as fn
from strandline.functions import quality as fq
from strandline.functions import text as tx
from strandline.functions.geography import parse_geography
from strandline.operators import analytics as an
from strandline.operators import classify as cl
from strandline.operators import documents as dc
from strandline.operators import evidence as ev
from strandline.operators import features as ft
from strandline.operators import merge as mg
from strandline.operators import quality as qu
from strandline.operators import timeline as tl
from strandline.plans.catalogue import TYPED, _companies, _dates, _typed, register
from strandline.sources import panel, sinks
from strandline.store import shared_dir

_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
#: What stands for the supplier's number, and how far apart the keys of two suppliers are.
MARK, STEP = "§", 1000


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def _fields(ddl: str) -> list[list[str]]:
    return [c.split(" ", 1) for c in re.split(r", (?![^<]*>)", ddl)]


def expected(ddl: str, rows: list[tuple], keys: tuple[str, ...] = ()) -> str:
    """SQL that gives the rows for every supplier."""
    cols = _fields(ddl)
    marked = {n for k, (n, _) in enumerate(cols) if any(isinstance(r[k], str) and MARK in r[k] for r in rows)}
    own = lambda n: f"replace(CAST({n} AS VARCHAR), '{MARK}', CAST(s_suppkey AS VARCHAR))" if n in marked else f"{n} + {STEP} * s_suppkey" if n in keys else n
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({own(n)} AS {_KINDS[t]}) AS {n}' for n, t in cols)} FROM supplier, (VALUES {values}) AS v({', '.join(n for n, _ in cols)})"


def planted(spark: SparkSession, sf: str, ddl: str, rows: list[tuple], keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows once for every supplier; numeric ``keys`` are moved apart."""
    cols = _fields(ddl)
    text = json.dumps([dict(zip((n for n, _ in cols), r, strict=True)) for r in rows], ensure_ascii=False)
    own = F.replace(F.lit(text), F.lit(MARK), F.col("s_suppkey").cast("string"))
    kind = "array<struct<" + ", ".join(f"{n}:{t}" for n, t in cols) + ">>"
    each = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.explode(F.from_json(own, kind)).alias("r"))
    return each.select(*((F.col(f"r.{n}") + (F.col("s_suppkey") * STEP if n in keys else 0)).cast(t).alias(n) if n in keys else F.col(f"r.{n}") for n, t in cols))


def case(name: str, ddl: str, rows: list[tuple], query: Callable[..., DataFrame], result: str, want: list[tuple], keys: tuple[str, ...] = (), **more: tuple[str, list[tuple]]) -> None:
    """Register what a query makes of planted rows (and of ``more`` planted tables) beside what it must make of them."""
    columns = [c for c, _ in _fields(result)]

    def run(s: SparkSession, d: str) -> DataFrame:
        others = {n: planted(s, d, *t, keys) for n, t in more.items()}
        return query(planted(s, d, ddl, rows, keys), **others).select(*columns)

    register(name, run, expected(result, want, keys))


def mapped(name: str, make: Callable[[Column], Column], kind: str, pairs: list[tuple]) -> None:
    """A column expression over one text column, value by value."""
    rows = [(k, v) for k, (v, _) in enumerate(pairs)]
    case(name, "k int, v string", rows, lambda df: df.select("k", make(F.col("v")).alias("r")), f"k int, r {kind}", [(k, r) for k, (_, r) in enumerate(pairs)], ("k",))


# Timelines of the classic scenarios: one gap, none, two years, a silent parent; always there, late, gone, one filing.
_YEARS = {"A": {"gap": (2019, 2021), "full": (2019, 2020, 2021)}, "B": {"wide": (2019, 2022), "steady": (2020, 2021)}, "C": {"silent": (2019, 2021)}, "D": {"Only LLC": (2020,)}, "E": {"only": (2020,)}, "F": {"old": (2019, 2020, 2021), "late": (2020, 2021), "gone": (2019, 2020)}}
_PANEL = [(f"{c}/§", f"{y}-12-31", f"Parent {c}", n) for c, kids in _YEARS.items() for n, ys in kids.items() for y in ys]
_OBS = "CIK string, FDATE string, COMP_NAME string, SUB_NAME string"
case("gap_scenarios", _OBS, _PANEL, lambda df: tl.gap_fill(panel.observations(df)).select("cik", "sub_name", F.date_format("fdate", "yyyy-MM-dd").alias("fdate")), "cik string, sub_name string, fdate string", [("A/§", "gap", "2020-06-30")])
case(
    "timeline_scenarios", _OBS, _PANEL, lambda df: tl.child_timeline(panel.observations(df)), "cik string, sub_name string, time_in string, time_out string, confidence string",
    [
        # The made-up date counts as a filing of parent A, for its other child too.
        ("A/§", "gap", "On or before 2019-12-31", "Active as of 2021-12-31", "MEDIUM"), ("A/§", "full", "On or before 2019-12-31", "Active as of 2021-12-31", "MEDIUM"),
        ("B/§", "wide", "On or before 2019-12-31", "Active as of 2022-12-31", "MEDIUM"), ("B/§", "steady", "Between 2019-12-31 and 2020-12-31", "Between 2021-12-31 and 2022-12-31", "HIGH"),
        ("C/§", "silent", "On or before 2019-12-31", "Active as of 2021-12-31", "MEDIUM"), ("D/§", "Only LLC", "On or before 2020-12-31", "Active as of 2020-12-31", "HIGH"), ("E/§", "only", "On or before 2020-12-31", "Active as of 2020-12-31", "MEDIUM"),
        ("F/§", "old", "On or before 2019-12-31", "Active as of 2021-12-31", "MEDIUM"), ("F/§", "late", "Between 2019-12-31 and 2020-12-31", "Active as of 2021-12-31", "HIGH"), ("F/§", "gone", "On or before 2019-12-31", "Between 2020-12-31 and 2021-12-31", "MEDIUM"),
    ],
)
case("bad_observations", _OBS, [("1/§", "2020-01-02", "P", " A "), (None, "2020-01-02", "P", "A"), ("1/§", "nonsense", "P", "A"), ("1/§", "2020-01-02", "P", None), ("1/§", "2021-05-06T00:00", "P", "b")], lambda df: panel.observations(df).withColumn("fdate", F.date_format("fdate", "yyyy-MM-dd")), "cik string, fdate string, comp_name string, sub_name string, sub_norm string", [("1/§", "2020-01-02", "P", "A", "a"), ("1/§", "2021-05-06", "P", "b", "b")])
def _growth(s: SparkSession, d: str) -> DataFrame:
    """Growth of the number of high orders by year, where every third year has none."""
    orders = s.read.parquet(f"{d}/orders.parquet").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("n"))
    seen = orders.select("year", F.when(F.col("year") % 3 == 0, 0).otherwise(F.col("n")).cast("long").alias("subsidiaries_seen"))
    return an.fastest_growth(an.timeline_growth(seen)).withColumn("growth_pct", F.col("growth_pct").cast("double"))


register("growth_of_nothing", _growth, """WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN year(o_orderdate) % 3 = 0 THEN 0 ELSE count(*) FILTER (o_orderpriority = '2-HIGH') END AS n FROM orders GROUP BY year(o_orderdate)),
g AS (SELECT year, n, lag(n) OVER (ORDER BY year) AS b FROM o), p AS (SELECT year, CAST(round((n - greatest(b, 1)) * 100.0::DOUBLE / greatest(b, 1), 4) AS DOUBLE) AS growth_pct FROM g WHERE b IS NOT NULL)
SELECT * FROM p ORDER BY growth_pct DESC, year LIMIT 3""")

# Names: every legal ending, types by rule, jurisdictions by form and by name.
_ENDINGS = (
    "LLC", "L.L.C.", "Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "Ltd", "Ltd.", "Limited", "PLC", "P.L.C.", "GmbH", "AG", "SA", "S.A.", "BV", "B.V.", "NV", "N.V.",
    "KG", "SAS", "S.A.S.", "SARL", "S.A.R.L.", "Pty", "LP", "L.P.", "LLP", "L.L.P.", "NA", "N.A.", "Co.", "SE", "AB", "AS", "A/S", "Sdn Bhd", "K.K.", "SpA", "S.p.A.",
)
mapped("entity_endings", fn.has_entity_suffix, "boolean", [(f"Acme§ {e}", True) for e in _ENDINGS] + [(f"acme§ {e.lower()}", True) for e in _ENDINGS] + [("Acme", False), ("AcmeLLC", False), ("LLC Acme", False), ("Acme LLC (Delaware)", False)])
case(
    "type_cases", "k int, s string, p string, a string, b string, n int, x boolean",
    [
        (1, "Alpha Beta Joint Venture", "Gamma Corp", "", "", 0, False), (2, "Shell (JV) Limited", "Gamma Corp", "", "", 0, False), (3, "Delta JV, Inc", "Gamma Corp", "", "", 0, False), (4, "Apple Operations", "Apple Inc", "", "", 0, False),
        (5, "Apple Holdings", "Apple Inc", "", "", 0, False), (6, "Grantor Trust 5", "Gamma Corp", "", "", 0, True), (7, "Zeta Works", "Gamma Corp", "", "", 5, True), (8, "Zeta Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 5, False),
        (9, "Zeta Inc", "Gamma Corp", "2000-01-01", "2000-01-01", 5, False), (10, "Zeta Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 2, False), (11, "Zeta Leasing Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 5, False),
        (12, "Zeta Canada Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 5, False), (13, "", "", "", "", 0, False), (14, "Zeta", "XY", "", "", 12, False), (15, "Zeta", "XY", "", "", 0, False), (16, "Gammatron Group", "Gamma Corp", "", "", 0, False),
    ],
    lambda df: df.select("k", fn.infer_type(*(F.col(c) for c in "spabnx")).alias("type")), "k int, type string",
    list(enumerate(("Joint Venture", "Joint Venture", "Joint Venture", "Internal Creation", "Restructuring", "Internal Creation", "External Acquisition", "External Acquisition", "Internal Creation", "Internal Creation", "Internal Creation", "Internal Creation", "Internal Creation", "External Acquisition", "Internal Creation", "Restructuring"), 1)),
    ("k",),
)
_PLACES = [
    ("Foo§ S. de R.L. de C.V.", "MX"), ("Foo§ S. de R.L.", "MX"), ("Foo§ S.A. de C.V.", "MX"), ("Foo§ K.K.", "JP"), ("Foo§ Kabushiki Kaisha", "JP"), ("Foo§ Yugen Kaisha", "JP"), ("Foo§ Godo Kaisha", "JP"), ("Foo§ S.r.l.", "IT"), ("Foo§ S.p.A.", "IT"),
    ("Foo§ S.A.S.", "FR"), ("Foo§ S.A.R.L.", "FR"), ("Foo§ B.V.", "NL"), ("Foo§ N.V.", "NL"), ("Foo§ GmbH & Co. KG", "DE"), ("Foo§ GmbH", "DE"), ("Foo§ Aktiengesellschaft", "DE"), ("Foo§ AG", "DE"), ("Foo§ KG", "DE"), ("Foo§ Pty. Ltd.", "AU"), ("Foo§ Pty Limited", "AU"),
    ("Foo§ Pty", "AU"), ("Foo§ PLC", "GB"), ("Foo§ Limited", "GB"), ("Foo§ Ltd.", "GB"), ("Foo§ LLP", "GB"), ("Foo§ A/S", "DK"), ("Foo§ ApS", "DK"), ("Foo§ AB", "SE"), ("Foo§ ASA", "NO"), ("Foo§ AS", "NO"), ("Foo§ Oy", "FI"), ("Foo§ Oyj", "FI"), ("Foo§ S.L.", "ES"), ("Foo§ S.L.U.", "ES"),
    ("Foo§ Lda.", "PT"), ("Foo§ Ltda", "BR"), ("Foo§ S/A", "BR"), ("Foo§ Pvt Ltd", "GB"), ("Foo§ Pvt Ltd India", "IN"), ("Foo§ Pte Ltd Branch", "SG"), ("Foo§ DAC", "IE"), ("Foo§ ULC", "IE"), ("Foo§ SPRL", "BE"), ("Foo§ BVBA", "BE"), ("Foo§ s.r.o.x", "CZ"), ("Foo§ a.s.", "CZ"), ("Foo§ Kft.", "HU"), ("Foo§ Zrt.", "HU"), ("Foo§ Nyrt.", "HU"),
    ("Foo§ Inc.", "US"), ("Foo§ Incorporated", "US"), ("Foo§ Corp", "US"), ("Foo§ Corporation", "US"), ("Foo§ LLC", "US"), ("Foo§ L.L.C.", "US"), ("Foo§ LP", "US"), ("Foo§ L.P.", "US"), ("Foo§ N.A.", "US"), ("Foo§ Canada", "CA"), ("Foo§ of Deutschland", "DE"), ("Foo§ British Virgin Islands", "VG"), ("Foo§ Hong Kong", "HK"), ("Foo§ Republic of Korea", "KR"), ("Foo", None), ("", None), (None, None),
]
mapped("jurisdictions", lambda c: parse_geography(c)["country_code"], "string", _PLACES)
mapped("us_states", lambda c: parse_geography(c)["jurisdiction"], "string", [("Foo§ Delaware LLC", "Delaware"), ("Foo§ West Virginia Inc.", "Virginia"), ("New York Foo§ Corp", "New York"), ("Foo§ Inc", None), ("Foo§ Delaware GmbH", None), (None, None)])

# Both quality engines.
mapped("issues_found", lambda c: F.array_join(fq.detect_issues(c), ","), "string", [("<b>Foo</b>", "html"), ("Foo &amp; Co", "encoding"), ("AB", "short"), ("Foo...", "truncated"), ("漢字漢字 Ltd", "garbage"), ("Foo LLC", ""), ("<i>x</i> &#39;...", "html,truncated,encoding"), (None, "")])
mapped("names_cleaned", fq.clean_name, "string", [(" <b>Foo</b>  &amp;amp; Co ", "Foo & Co"), ("A   B", "A B"), ("漢字漢字 Ltd", "Ltd"), ("Foo LLC", "Foo LLC"), ("<i></i>", ""), ("CafÃ© Inc", "Caf Inc")])
mapped("garbage_names", fq.is_garbage, "boolean", [(None, True), ("", True), ("x", True), ("####", True), ("12345 6", True), ("BCDFGHJ", True), ("ab\u0001\u0002\u0003", True), ("Foo Bar", False), ("IBM", False), ("3M 9", False)])
mapped("form_text", fq.is_form_text, "boolean", [("? y or n", True), ("N / A", True), ("See  attached", True), ("yes/no", True), ("Name of Subsidiary", True), ("not applicable ", True), ("Attached Inc", False), ("none of these", False), (None, False)])
mapped("markup_found", fq.has_markup, "boolean", [("<p>", True), ("a {b: c} d", True), ("style = 'x' Foo", True), ("a < b", False), (None, False)])
mapped("markup_stripped", fq.strip_markup, "string", [("<b>Foo</b> {x}Bar", "Foo Bar"), ("Foo &amp; Bar&nbsp;", "Foo & Bar"), ("<i style='a'>Foo</i>", "Foo"), ("Foo", "Foo")])
mapped("encoding_found", fq.has_broken_encoding, "boolean", [("aâ\u0080\u0093b", True), ("�", True), ("aÂ b", True), ("café", False), (None, False)])
mapped("truncated_names", fq.is_truncated, "boolean", [("Foo...", True), ("Foo… ", True), ("Foo.", False), (None, False)])
mapped("short_names", fq.is_short, "boolean", [("ab", True), (" a ", True), ("abc", False), (None, True), ("", True)])
mapped("normal_names", fq.normal_name, "string", [("  acme   widgets llc ", "Acme Widgets LLC"), ("- ACME O'NEIL-SMITH", "Acme O'Neil-Smith"), ("McDonald's Corp", "McDonald's CORP"), ("• foo dba bar iii", "Foo DBA Bar III"), ("aÂ b co., ltd.", "A B CO., LTD.")])
case("strict_plan", "k int, name string", [(1, "<b>Foo</b> llc"), (2, "####"), (3, "n/a"), (4, "Foo Bar Inc"), (5, "Foo Bar INC"), (6, "ann bee cob")], lambda df: qu.strict_plan(df, "name"), "k int, cleaned string, action string", [(1, "Foo LLC", "clean"), (2, "####", "delete"), (3, "N/A", "delete"), (4, "Foo Bar INC", "clean"), (5, "Foo Bar INC", "skip"), (6, "Ann Bee Cob", "clean")], ("k",))
case("clean_plan", "k int, cik string, name string", [(1, "1/§", "<i>x</i>"), (2, "1/§", "<b>Foo LLC</b>"), (3, "1/§", "Foo LLC"), (4, "1/§", "Fine Inc"), (5, "2/§", "Foo LLC..."), (6, "2/§", "ab")], lambda df: qu.apply_clean(qu.clean_plan(df, "name"), "name", ["cik"]), "k int, name string, collision boolean", [(2, "Foo LLC", True), (3, "Foo LLC", False), (4, "Fine Inc", False), (5, "Foo LLC...", False)], ("k",))
case("renamed", "k int, name string", [(1, "a"), (2, "b")], lambda df: qu.renamed(df, "name", F.col("k") % STEP == 2, "c"), "k int, name string", [(1, "a"), (2, "c")], ("k",))

# Documents.
_DOCS = [
    (1, "<html><style>p{}</style><table><tr><th>Name of Subsidiary</th></tr><tr><td>Foo  LLC</td><td>DE</td></tr><tr><td>foo llc</td></tr><tr><td>Bar &amp; Co</td></tr><tr><td>12/31/2001</td></tr></table></html>"),
    (2, "Preamble Corp\nSubsidiaries of the registrant\nName of company\n1. Foo LLC     Delaware\nBar Inc (Nevada)\nBaz Ltd NY\n"), (3, "Lone Company LLC"), (4, ""), (5, None), (6, "Page 1\n***\nAlpha Beta Holdings\t\tOhio\nALPHA BETA HOLDINGS\n"),
]
_NAMES = [(1, 0, "Foo LLC"), (1, 1, "Bar & Co"), (2, 0, "Foo LLC"), (2, 1, "Bar Inc"), (2, 2, "Baz Ltd"), (3, 0, "Lone Company LLC"), (6, 0, "Alpha Beta Holdings")]
case("document_names", "id int, html string", _DOCS, lambda df: dc.entities(df, "html", "id"), "id int, ordinal int, sub_name string", _NAMES, ("id",))
case("document_store", "id int, html string", _DOCS[1:4], lambda df: dc.raw_documents(dc.parse_documents(df, "html"), "html", 9), "id int, raw_text string, parsed_subsidiaries string", [(2, "Preamble ", '["Foo LLC","Bar Inc","Baz Ltd"]'), (3, "Lone Comp", '["Lone Company LLC"]'), (4, "", "[]")], ("id",))
mapped("names_by_pattern", lambda c: F.array_join(dc.from_patterns(c), "|"), "string", [("  1) Foo Widgets LLC, (Delaware)\nnothing here\n", "Foo Widgets LLC"), ("2. Foo Bar Inc of Ohio", "Foo Bar Inc"), ("nothing", "")])
mapped("names_in_lines", dc.name_in_line, "string", [("1. Foo LLC     Delaware", "Foo LLC"), ("Bar Inc (Nevada)", "Bar Inc"), ("Baz Ltd NY", "Baz Ltd"), ("2) *", "*"), ("Qux\tOhio", "Qux")])
mapped("name_shapes", dc.looks_like_name, "boolean", [("Foo LLC", True), ("ab", False), ("12345", False), ("1/2/2003", False), ("Exhibit 21", False), ("Subsidiaries of X", False), ("***", False), ("Delaware", True), ("x" * 201, False)])

# Landed answers, evidence, model answers.
_FILED = {"form": ["10-K", "8-K", "4", "8-K/A", "10-K/A"], "filingDate": ["2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01", "2005-05-01"], "accessionNumber": list("abcde"), "primaryDocument": list("vwxy")}
_SUBMISSION = json.dumps({"cik": "1/§", "tickers": ["ABC", "ABD"], "filings": {"recent": _FILED}}, ensure_ascii=False)
_OLDER = json.dumps({"form": ["10-K", "S-1"], "filingDate": ["2010-01-01", "2011-01-01"], "accessionNumber": ["o-1", "o-2"], "primaryDocument": ["m"]})
case("event_filings", "value string", [(_SUBMISSION,)], panel.filings_of, "cik string, kind int, rank int, form string, accession string, document string", [("1/§", 0, 1, "8-K", "b", "w"), ("1/§", 0, 2, "8-K/A", "d", "y"), ("1/§", 1, 1, "10-K", "a", "v"), ("1/§", 1, 2, "10-K/A", "e", "")])
case("annual_filings", "value string", [(_SUBMISSION,)], lambda df, older: panel.annual_filings(df, 2006, 2025, older), "cik string, filing_date string, accession string, form string", [("1/§", "2020-01-01", "a", "10-K"), ("1/§", "2010-01-01", "o-1", "10-K")], older=("cik string, page int, value string", [("1/§", 1, _OLDER)]))
case("tickers", "value string", [(_SUBMISSION,), ('{"cik": "2/§", "tickers": []}',), ('{"cik": "3/§"}',)], panel.tickers, "cik string, ticker string", [("1/§", "ABC"), ("2/§", None), ("3/§", None)])
_INDEX = [
    ("1", "0-§-2", '<a href="/a/d_ex21.htm">'), ("1", "0-§-3", '<a href="EXHIBIT-21.htm">'), ("1", "0-§-4", '<a href="https://x.y/ex_21_1.htm">'),
    ("0007", "0-§-5", '<tr><td><a href="no.htm">EX-10</a></td></tr><tr><td>EX-21</td>\n<td><a href="list.htm">list</a></td></tr>'), ("1", "0-§-6", '<tr><td> Exhibit 21 </td></tr><tr><td>EXHIBIT21</td><td><A HREF="/q/list.htm"></td></tr>'), ("1", "0-§-7", '<tr><td>EX-99</td><td><a href="x.htm"></td></tr>'),
]
_AT = "https://www.sec.gov"
case(
    "exhibits_found", "cik string, accession string, page string", _INDEX, lambda df: panel.discovered(df.select("cik", "accession", F.lit("2020-01-01").alias("filing_date")), df), "cik string, accession string, exhibit_url string",
    [("1", "0-§-2", f"{_AT}/a/d_ex21.htm"), ("1", "0-§-3", f"{_AT}/Archives/edgar/data/1/0§3/EXHIBIT-21.htm"), ("1", "0-§-4", "https://x.y/ex_21_1.htm"), ("0007", "0-§-5", f"{_AT}/Archives/edgar/data/7/0§5/list.htm"), ("1", "0-§-6", f"{_AT}/q/list.htm")],
)
_CHART = json.dumps({"chart": {"result": [{"timestamp": [86400, 172800], "indicators": {"quote": [{"open": [1.234, 2], "high": [None, 2], "low": [1, 2], "close": [1.5, None], "volume": [None, 3]}]}}]}})
case("quotes", "value string", [(_CHART,)], lambda df: panel.quotes(df).withColumn("date", F.date_format("date", "yyyy-MM-dd")), "date string, open double, high double, low double, close double, volume long", [("1970-01-02", 1.23, 0.0, 1.0, 1.5, 0)])
case("best_hits", "sub_id int, rank int, entity_id string, parent_cik string", [(1, 0, "x", "p"), (1, 3, "p", "p"), (1, 5, "p", "p"), (2, 0, "x", "p"), (2, 11, "p", "p")], panel.best_hits, "sub_id int, rank int", [(1, 3), (2, 0)], ("sub_id",))
case("top_articles", "sub_id int, ordinal int, title string", [(1, k, t) for k, t in enumerate("abacdaefg")], panel.top_articles, "sub_id int, ordinal int, title string", [(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (1, 4, "d"), (1, 6, "e")], ("sub_id",))
case("acquirers", "company string, acquirer string, ordinal int", [(" Foo§ ", "BAR", 1), ("foo§", "Baz", 2), ("ab", "x", 3), ("long name", " ", 4)], panel.acquirers, "company string, acquirer string", [("foo§", "baz")])
mapped("json_in_text", tx.json_in, "string", [('{"a": 1}', '{"a": 1}'), ('Sure:\n```json\n{"a": 2}\n```', '{"a": 2}'), ('so {"a": 3} it is', '{"a": 3}'), ("none", None), ("{broken", None)])
_WHOLE = {"TimeIn": "a", "TimeOut": "b", "Type": "an acquisition", "MainSource": "c", "Confidence": "sure", "Notes": "d"}
case("model_answers", "id int, t string", [(1, json.dumps(_WHOLE)), (2, '{"Type": "x"}'), (3, json.dumps(_WHOLE | {"Type": "odd", "Confidence": "LOW"})), (4, json.dumps(_WHOLE | {"Type": "jv of two"}))], lambda df: ev.answers(df, "t"), "id int, Type string, Confidence string, Notes string", [(1, "External Acquisition", "MEDIUM", "d"), (2, None, None, None), (3, "Unknown", "LOW", "d"), (4, "Joint Venture", "MEDIUM", "d")], ("id",))
_filed = lambda date, url: {"form": "8-K", "date": date, "url": url}
_article = lambda url, snippet, extract: {"url": url, "snippet": snippet, "extract": extract}
_EVIDENCE = "sub_name string, company_name string, filings array<struct<form:string,date:string,url:string>>, articles array<struct<url:string,snippet:string,extract:string>>"
case(
    "evidence_reasoned", _EVIDENCE,
    [
        ("Foo§", "Bar Corp", [_filed("2012-01-01", "u2"), _filed("2010-01-01", "u1/§")], [_article("w0", "nothing", None), _article("w1", "was renamed", ""), _article("w2", "acquired", "")]),
        ("Bar Holdings", "Bar Corp", [], []), ("Qux§", "Bar Corp", [], [_article("w3/§", "", "a merger of two")]),
    ],
    lambda df: ev.reasoned(df), "sub_name string, type string, main_source string",
    [("Foo§", "Restructuring", "SEC EDGAR (8-K filing, 2010-01-01) - u1/§"), ("Bar Holdings", "Restructuring", "SEC Exhibit 21 filing comparison"), ("Qux§", "External Acquisition", "w3/§")],
)
mapped("years_in_text", tx.year_in, "int", [("On or before 2019-12-31", 2019), ("none", None), (None, None), ("a 12345", 1234)])
mapped("padded_keys", tx.padded_key, "string", [("7", "0000000007"), ("1234567890", "1234567890"), ("", "0000000000")])
case("job_counts", "job string, ok boolean", [("a/§", True), ("a/§", False), ("b/§", True)], ev.job_counts, "job string, done long, failed long", [("a/§", 2, 1), ("b/§", 1, 0)])

# Labels, merging, exports.
case(
    "labels_by_known_acquirers", "cik string, sub_name string", [("1/§", "Initech§ Software LLC"), ("1/§", "Other LLC"), ("2/§", "Initech§ Software Europe"), ("3/§", "The Initech§ Software Works"), ("1/§", "xhooli§x"), ("2/§", "Globex§ Trading House Intl Ltd")],
    lambda df, companies, acquirers: ft.labels_from_acquirers(df, companies, acquirers),
    "cik string, sub_name string, label string, origin string", [("1/§", "Initech§ Software LLC", "acquisition", "wikidata"), ("3/§", "The Initech§ Software Works", "acquisition", "wikidata"), ("1/§", "xhooli§x", "acquisition", "wikidata"), ("2/§", "Globex§ Trading House Intl Ltd", "acquisition", "wikidata")],
    companies=("cik string, company_name string", [("1/§", "Acme Industries"), ("2/§", "Umbrella Group"), ("3/§", "Acme Labs")]),
    acquirers=("company string, acquirer string", [("initech§ software", "acme industries"), ("hooli§x", "acme"), ("globex§ trading house international", "umbrella")]),
)
case(
    "labels_by_event_filings", "cik string, sub_name string, first_seen string", [("1/§", "Near Inc", "2010-06-01"), ("1/§", "Edge Inc", "2011-01-01"), ("1/§", "Late Inc", "2011-01-02"), ("1/§", "Early Inc", "2009-01-01"), ("1/§", "Acme Near", "2010-01-01"), ("2/§", "Near Inc", "2010-01-01")],
    lambda df, companies, filings: ft.labels_from_event_filings(df, companies, filings),
    "cik string, sub_name string, origin string", [("1/§", "Near Inc", "edgar_8k"), ("1/§", "Edge Inc", "edgar_8k"), ("1/§", "Early Inc", "edgar_8k")],
    companies=("cik string, company_name string", [("1/§", "Acme Corp"), ("2/§", "Beta Corp")]), filings=("cik string, filing_date string", [("1/§", "2010-01-01")]),
)
_KEYED = "cik string, sub_name string, type string, enriched int"
_KIDS = [("1/§", "a", "Internal Creation", 0), ("1/§", "b", "Joint Venture", 1), ("2/§", "a", None, 0)]
case("enrichments_reset", _KEYED, _KIDS, mg.reset, _KEYED, [("1/§", "a", None, 0), ("1/§", "b", None, 0), ("2/§", "a", None, 0)])
case("types_confirmed", _KEYED, _KIDS, lambda df, evidence: cl.confirmed(df, evidence), "cik string, sub_name string, type string", [("1/§", "a", "Internal Creation"), ("1/§", "b", "External Acquisition"), ("2/§", "a", "External Acquisition")], evidence=("cik string, sub_name string", [("1/§", "b"), ("2/§", "a"), ("2/§", "a"), ("3/§", "x")]))
_STORED = "cik string, sub_name string, source_type string, searched_at string"


_OLD = (_STORED, [("1/§", "a", "old", "2020"), ("2/§", "a", "old", "2020")])
_NEW = (_STORED, [("1/§", "a", "new", "2021"), ("1/§", "b", "new", "2021"), ("2/§", "a", "same time", "2020")])


def _recorded(which: int) -> Callable[..., DataFrame]:
    return lambda df, old, new: mg.record_enrichments(df, old, new, ["cik", "sub_name"], "searched_at")[which]


case("enrichments_recorded", _KEYED, _KIDS, _recorded(1), _STORED, [("1/§", "a", "new", "2021"), ("1/§", "b", "new", "2021"), ("2/§", "a", "same time", "2020")], old=_OLD, new=_NEW)
case("enriched_flags", _KEYED, [*_KIDS, ("3/§", "c", None, 1)], _recorded(0), "cik string, sub_name string, enriched int", [("1/§", "a", 1), ("1/§", "b", 1), ("2/§", "a", 1), ("3/§", "c", 0)], old=_OLD, new=_NEW)


# Exports of the panel's children, some of whose names have quotes and commas.
_quoted = lambda s, d: _typed(s, d).withColumn("sub_name", F.when(F.length("sub_name") % 3 == 0, F.concat(F.lit('a "'), "sub_name", F.lit('", b'))).otherwise(F.col("sub_name")))
QUOTED = TYPED + """, quoted AS (SELECT * REPLACE (CASE WHEN length(sub_name) % 3 = 0 THEN 'a "' || sub_name || '", b' ELSE sub_name END AS sub_name) FROM typed) """
register("sheet_rows", lambda s, d: sinks.sheet(_quoted(s, d)).select("cik", "sub_name", "first_seen", "type", "enriched"), QUOTED + "SELECT cik, sub_name, first_seen, type, CASE WHEN enriched = 1 THEN 'Yes' ELSE 'No' END AS enriched FROM quoted")
register(
    "sheet_widths", lambda s, d: sinks.column_widths(sinks.sheet(_quoted(s, d)).select("cik", "sub_name", "confidence", "time_in", "enriched")),
    QUOTED + "SELECT " + ", ".join(f"CAST(least(greatest(max(length({c})), {len(c)}) + 3, 50) AS INTEGER) AS {c}" for c in ("cik", "sub_name", "confidence", "time_in")) + ", 11 AS enriched FROM quoted",
)


def _exported(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/export"
    sinks.write_csv(_quoted(s, d).select("cik", "sub_name", "first_seen"), path, quote_all=True)
    return s.read.text(path).where("value NOT LIKE '\"cik\",%'")


register("quoted_export", _exported, QUOTED + """SELECT '"' || cik || '","' || replace(sub_name, '"', '""') || '","' || first_seen || '"' AS value FROM quoted""")


def _saved_panel(s: SparkSession, d: str) -> DataFrame:
    """The panel's tables as gzipped CSV, without the fields that have defaults, and read back."""
    folder = shared_dir(s)
    rows = {"companies": _companies(s, d).withColumn("num_filings", F.lit(None).cast("int")), "filing_dates": _dates(s, d), "subsidiaries": _quoted(s, d).select("cik", "sub_name", F.nullif("type", F.lit("Internal Creation")).alias("type"))}
    for name, df in rows.items():
        df.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{folder}/{name}.csv.gz")
    tables = panel.read_tables(s, folder)
    subs = tables["subsidiaries"].select(F.lit("subs").alias("t"), F.concat_ws("/", "cik", "sub_name").alias("k"), F.concat_ws("|", "confidence", "source", "enriched", "type").alias("v"))
    companies = tables["companies"].select(F.lit("companies"), "company_name", F.concat_ws("|", "num_filings", "num_subsidiaries"))
    return subs.union(companies).union(tables["filing_dates"].select(F.lit("dates"), "cik", "fdate"))


register("saved_panel", _saved_panel, QUOTED + """SELECT 'subs' AS t, cik || '/' || sub_name AS k, 'MEDIUM|SEC Exhibit 21 filing comparison|0' || CASE WHEN type = 'Internal Creation' THEN '' ELSE '|' || type END AS v FROM quoted
UNION ALL SELECT 'companies', company_name, '0|' || num_subsidiaries FROM companies UNION ALL SELECT 'dates', cik, fdate FROM dates""")
