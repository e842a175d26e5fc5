"""Quality engines, documents, evidence and landed sources."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import quality as q
from strandline.functions import text as tx
from strandline.operators import documents, evidence, quality
from strandline.sources import panel


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("name", "issues"),
    [("<b>Foo</b>", ["html"]), ("Foo &amp; Co", ["encoding"]), ("AB", ["short"]), ("Foo...", ["truncated"]), ("漢字漢字 Ltd", ["garbage"]), ("Foo LLC", []), (None, [])],
)
def test_issues(spark, name, issues):
    assert one(spark, name, q.detect_issues) == issues


def test_cleaning(spark):
    assert one(spark, " <b>Foo</b>  &amp;amp; Co ", q.clean_name) == "Foo & Co"
    rows = spark.createDataFrame([(1, "<i>x</i>"), (2, "<b>Foo LLC</b>"), (3, "Fine Inc")], "id int, name string")
    plan = quality.clean_plan(rows, "name")
    assert {r.id: r.action for r in plan.collect()} == {1: "delete", 2: "clean", 3: "skip"}
    left = quality.apply_clean(plan.withColumn("cik", F.lit("1")), "name", ["cik"])
    assert {r.name for r in left.collect()} == {"Foo LLC", "Fine Inc"} and left.where("collision").count() == 0


@pytest.mark.parametrize(("name", "bad"), [(None, True), ("x", True), ("####", True), ("12345 6", True), ("BCDFGHJ", True), ("Foo Bar", False), ("IBM", False)])
def test_garbage(spark, name, bad):
    assert one(spark, name, q.is_garbage) is bad


@pytest.mark.parametrize(("name", "bad"), [("? y or n", True), ("N / A", True), ("See  attached", True), ("Attached Inc", False), (None, False)])
def test_form_text(spark, name, bad):
    assert one(spark, name, q.is_form_text) is bad


@pytest.mark.parametrize(("name", "want"), [("  acme   widgets llc ", "Acme Widgets LLC"), ("- ACME O'NEIL-SMITH", "Acme O'Neil-Smith"), ("McDonald's Corp", "McDonald's CORP")])
def test_normal_names(spark, name, want):
    assert one(spark, name, q.normal_name) == want


def test_documents(spark):
    pages = [
        (1, "<html><style>p{}</style><table><tr><th>Name of Subsidiary</th></tr><tr><td>Foo  LLC</td><td>DE</td></tr><tr><td>foo llc</td></tr><tr><td>Bar &amp; Co</td></tr></table></html>"),
        (2, "Preamble Corp\nSubsidiaries of the registrant\nName of company\n1. Foo LLC     Delaware\nBar Inc (Nevada)\nBaz Ltd NY\n"),
        (3, "Lone Company LLC"), (4, ""), (5, None),
    ]
    docs = spark.createDataFrame(pages, "id int, html string")
    got = {r.id: r.names for r in documents.parse_documents(docs, "html").collect()}
    assert got == {1: ["Foo LLC", "Bar & Co"], 2: ["Foo LLC", "Bar Inc", "Baz Ltd"], 3: ["Lone Company LLC"], 4: [], 5: []}
    assert documents.entities(docs, "html", "id").where("id = 2").count() == 3
    stored = documents.raw_documents(documents.parse_documents(docs, "html"), "html", 5).where("id = 3").first()
    assert (stored.raw_text, json.loads(stored.parsed_subsidiaries)) == ("Lone ", ["Lone Company LLC"])


def test_names_by_pattern(spark):
    assert one(spark, "  1) Foo Widgets LLC, (Delaware)\nnothing here\n", documents.from_patterns) == ["Foo Widgets LLC"]


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": 2}\n```', {"a": 2}), ('so {"a": 3} it is', {"a": 3}), ("none", None)])
def test_json_in_text(spark, text, want):
    got = one(spark, text, tx.json_in)
    assert (got and json.loads(got)) == want


def test_answers_are_corrected(spark):
    whole = {"TimeIn": "a", "TimeOut": "b", "Type": "an acquisition", "MainSource": "c", "Confidence": "sure", "Notes": "d"}
    rows = spark.createDataFrame([(1, json.dumps(whole)), (2, '{"Type": "x"}')], "id int, t string")
    got = {r.id: (r.Type, r.Confidence, r.Notes) for r in evidence.answers(rows, "t").collect()}
    assert got == {1: ("External Acquisition", "MEDIUM", "d"), 2: (None, None, None)}


def test_reasoning(spark):
    ddl = "sub_name string, company_name string, filings array<struct<form:string,date:string,url:string>>, articles array<struct<url:string,snippet:string,extract:string>>"
    rows = [
        ("Foo", "Bar Corp", [("8-K", "2012-01-01", "u2"), ("8-K", "2010-01-01", "u1")], [("w0", "nothing", None), ("w1", "was renamed", ""), ("w2", "acquired", "")]),
        ("Bar Holdings", "Bar Corp", [], []),
    ]
    a, b = evidence.reasoned(spark.createDataFrame(rows, ddl)).collect()
    assert (a.type, a.main_source) == ("Restructuring", "SEC EDGAR (8-K filing, 2010-01-01) - u1") and b.type == "Restructuring"


def test_landed_sources(spark):
    filings = {"cik": "1", "filings": {"recent": {"form": ["10-K", "8-K", "4", "8-K/A"], "filingDate": ["2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01"], "accessionNumber": list("abcd"), "primaryDocument": list("wxyz")}}}
    raw = spark.createDataFrame([(json.dumps(filings),)], "value string")
    assert [(r.form, r["rank"]) for r in panel.filings_of(raw).orderBy("kind", "rank").collect()] == [("8-K", 1), ("8-K/A", 2), ("10-K", 1)]
    assert panel.annual_filings(raw, 2020, 2020).count() == 1
    chart = {"chart": {"result": [{"timestamp": [86400, 172800], "indicators": {"quote": [{"open": [1.234, 2], "high": [None, 2], "low": [1, 2], "close": [1.5, None], "volume": [None, 3]}]}}]}}
    (row,) = panel.quotes(spark.createDataFrame([(json.dumps(chart),)], "value string")).collect()
    assert (str(row.date), row.open, row.high, row.close, row.volume) == ("1970-01-02", 1.23, 0.0, 1.5, 0)
    hits = spark.createDataFrame([(1, 0, "x", "p"), (1, 3, "p", "p"), (2, 0, "x", "p")], "sub_id int, rank int, entity_id string, parent_cik string")
    assert {(r.sub_id, r["rank"]) for r in panel.best_hits(hits).collect()} == {(1, 3), (2, 0)}
    known = spark.createDataFrame([(" Foo ", "BAR", 1), ("foo", "Baz", 2), ("ab", "x", 3)], "company string, acquirer string, ordinal int")
    assert [tuple(r) for r in panel.acquirers(known).collect()] == [("foo", "baz")]
    link = lambda c: panel.exhibit_link(c, F.lit("1"), F.lit("0-1"))
    assert one(spark, '<a href="/a/d_ex21.htm">', link) == "https://www.sec.gov/a/d_ex21.htm"
    assert one(spark, '<tr><td>EX-21</td><td><a href="list.htm">list</a></td></tr><a href="/y/other.htm">', link) == "https://www.sec.gov/Archives/edgar/data/1/01/list.htm"
    assert one(spark, '<tr><td>EX-99</td><td><a href="list.htm">list</a></td></tr>', link) is None
