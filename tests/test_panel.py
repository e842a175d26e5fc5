"""Timelines, types and the other operators on tiny panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.functions import names as fn
from strandline.functions.geography import parse_geography
from strandline.operators import merge, timeline
from strandline.sources.panel import observations


def panel(spark, rows):
    return observations(spark.createDataFrame([(c, d, p, n) for c, d, p, n in rows], "CIK string, FDATE string, COMP_NAME string, SUB_NAME string"))


def years(spark, spec, parent="P"):
    return panel(spark, [("1", f"{y}-12-31", parent, n) for n, ys in spec.items() for y in ys])


def test_single_gap_is_filled(spark):
    obs = years(spark, {"A": [2019, 2021], "B": [2019, 2020, 2021]})
    assert [(r.sub_name, r.fdate) for r in timeline.gap_fill(obs).collect()] == [("A", dt.date(2020, 6, 30))]
    full = timeline.filled(obs)
    assert timeline.gap_fill(full).count() == 0


@pytest.mark.parametrize("spec", [{"A": [2019, 2020, 2021]}, {"A": [2019, 2022], "B": [2020, 2021]}, {"A": [2019, 2021]}])
def test_no_gap_wide_gap_or_silent_parent_is_not_filled(spark, spec):
    assert timeline.gap_fill(years(spark, spec)).where("sub_name = 'A'").count() == 0


def test_parents_are_independent(spark):
    rows = [("A", "2019-01-01", "X", "s"), ("A", "2020-01-01", "X", "t"), ("A", "2021-01-01", "X", "s"), ("B", "2019-01-01", "Y", "s"), ("B", "2021-01-01", "Y", "s")]
    assert [r.cik for r in timeline.gap_fill(panel(spark, rows)).collect()] == ["A"]


def of(spark, spec, name):
    return timeline.child_timeline(years(spark, spec)).where(F.col("sub_name") == name).first()


def test_always_present(spark):
    r = of(spark, {"A": [2020, 2021, 2022]}, "A")
    assert "Active" in r.time_out and r.time_in.startswith("On or before")


def test_appears_midway(spark):
    r = of(spark, {"O": [2019, 2020, 2021], "N": [2020, 2021]}, "N")
    assert (r.time_in, r.confidence) == ("Between 2019-12-31 and 2020-12-31", "HIGH")


def test_disappears(spark):
    r = of(spark, {"G": [2019, 2020], "O": [2019, 2020, 2021]}, "G")
    assert r.time_out == "Between 2020-12-31 and 2021-12-31"


def test_suffix_and_single_filing(spark):
    assert of(spark, {"Something LLC": [2020]}, "Something LLC").confidence == "HIGH"
    assert of(spark, {"Something": [2020]}, "Something").confidence == "MEDIUM"


def test_bad_rows_are_dropped_and_dates_read(spark):
    obs = panel(spark, [("1", "2020-01-02", "P", " A "), (None, "2020-01-02", "P", "A"), ("1", "nonsense", "P", "A"), ("1", "2020-01-02", "P", None)])
    assert [(r.sub_name, r.sub_norm, r.fdate) for r in obs.collect()] == [("A", "a", dt.date(2020, 1, 2))]


TYPES = [
    ("Alpha Beta Joint Venture", "Gamma Corp", "", "", 0, False, "Joint Venture"),
    ("Shell (JV) Limited", "Gamma Corp", "", "", 0, False, "Joint Venture"),
    ("Acme Partnership LP", "Gamma Corp", "", "", 5, False, "Internal Creation"),
    ("Apple Operations", "Apple Inc", "", "", 0, False, "Internal Creation"),
    ("Apple Holdings", "Apple Inc", "", "", 0, False, "Restructuring"),
    ("Grantor Trust 5", "Gamma Corp", "", "", 0, True, "Internal Creation"),
    ("Zeta Works", "Gamma Corp", "", "", 5, True, "External Acquisition"),
    ("Zeta Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 5, False, "External Acquisition"),
    ("Zeta Inc", "Gamma Corp", "2000-01-01", "2000-01-01", 5, False, "Internal Creation"),
    ("Zeta Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 2, False, "Internal Creation"),
    ("Zeta Leasing Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 5, False, "Internal Creation"),
    ("Zeta Canada Inc", "Gamma Corp", "2010-01-01", "2000-01-01", 5, False, "Internal Creation"),
    ("", "", "", "", 0, False, "Internal Creation"),
    ("Zeta", "XY", "", "", 12, False, "External Acquisition"),
    ("Zeta", "XY", "", "", 0, False, "Internal Creation"),
]


def test_types_by_rules(spark):
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(TYPES)], "k int, s string, p string, a string, b string, n int, x boolean, want string")
    got = df.select("k", "want", fn.infer_type(*(F.col(c) for c in "spabnx")).alias("got")).collect()
    assert [(r.k, r.got) for r in got if r.got != r.want] == []


GEO = [
    ("Foo B.V.", "NL", None), ("Foo Pty Ltd", "AU", None), ("Foo Pvt Ltd", "GB", None), ("Foo S.a.r.l.", "FR", None), ("Foo Canada", "CA", None),
    ("Foo GmbH & Co. KG", "DE", None), ("Foo Delaware LLC", "US", "Delaware"), ("Foo West Virginia Inc.", "US", "Virginia"), ("Indiana Works", None, None),
    ("Bank of the British Virgin Islands", "VG", None), ("Foo S. de R.L. de C.V.", "MX", None), ("Foo", None, None), ("", None, None), (None, None, None),
]


def test_geography(spark):
    df = spark.createDataFrame([(k, *g) for k, g in enumerate(GEO)], "k int, name string, code string, state string")
    rows = df.withColumn("g", parse_geography(F.col("name"))).collect()
    assert [(r.name, r.g) for r in rows if (r.g and (r.g.country_code, r.g.jurisdiction)) != ((r.code, r.state) if r.code else None)] == []


def test_words_and_similarity(spark):
    row = spark.createDataFrame([("The Foo, Bar (Baz) Inc. S.A.", "Foo Corp")], "a string, b string").select(fn.meaningful_words(F.col("a")).alias("a"), fn.jaccard(fn.meaningful_words(F.col("a")), fn.meaningful_words(F.col("b"))).alias("j"), fn.suffix_type(F.col("b")).alias("t")).first()
    assert row.a == ["foo", "bar", "baz", "s.a"] and row.j == 0.25 and row.t == "inc_corp"


def test_merge_equals_recomputing_all(spark):
    obs = years(spark, {"A": [2018, 2020], "B": [2018, 2019, 2020], "C": [2020], "D": [2018]})
    old, new = obs.where("fdate < '2019-06-01'"), obs.where("fdate >= '2019-06-01'")
    want = {tuple(r) for r in timeline.child_timeline(obs).collect()}
    assert {tuple(r) for r in merge.recomputed(old, new)[0].collect()} == want
    assert {tuple(r) for r in merge.recomputed(new, old)[0].collect()} == want


def test_legacy_merge_leaves_absent_children(spark):
    obs = years(spark, {"A LLC": [2018], "B": [2018, 2019]})
    old, new = obs.where("fdate < '2019-01-01'"), obs.where("fdate >= '2019-01-01'")
    subs = timeline.bounds(timeline.spans(old), timeline.filing_dates(old), suffix_rule=False)
    got = {r.sub_name: r for r in merge.legacy_merge(subs, timeline.filing_dates(old), new).collect()}
    assert got["A LLC"].time_out == "Active as of 2018-12-31" and got["A LLC"].confidence == "MEDIUM"
    assert got["B"].time_out == "Active as of 2019-12-31"


def test_integrity(spark):
    obs = years(spark, {"A": [2018, 2019], "B": [2018]})
    companies, dates, subs = timeline.company_rollup(obs), timeline.filing_dates(obs), timeline.child_timeline(obs)
    checks = merge.integrity(companies, dates, subs)
    assert checks.where("NOT passed").count() == 0
    assert merge.pass_rate(checks).first().pass_rate == 100
    assert merge.integrity(companies.limit(0), dates, subs).where("NOT passed").count() >= 2


def test_a_child_of_the_driver_tables_is_one_row_before_it_is_named(spark):
    from strandline.sources import panel as source

    kids = source.driver_children(spark, "/root/testdata/sf0.001")
    assert kids.count() == kids.select("cik", "sub_norm").distinct().count()
    first = kids.where("size(dates) > 1").first()
    assert first.dates == sorted(set(first.dates)) and all((d.month, d.day) == (1, 1) for d in first.dates)
    plan = source.driver_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Names are made above the only aggregation and below the list of dates.
    assert plan.count("Aggregate") == 1 and plan.index("Generate") < plan.index("Joint Venture") < plan.index("Aggregate")


def test_children_of_several_rows_are_joined(spark):
    day = lambda y: dt.date(y, 1, 1)
    rows = [("1", "a", "A", "P", [day(1999)]), ("1", "a", "a", "O", [day(1950), day(1999)]), ("1", "b", "b", "P", [day(2000)]), ("2", "a", "a", "Q", [day(2001)])]
    parts = spark.createDataFrame(rows, "cik string, sub_norm string, sub_name string, comp_name string, dates array<date>")
    got = sorted(map(tuple, timeline.joined(parts).collect()))
    assert got == [("1", "a", "A", "O", [day(1950), day(1999)]), ("1", "b", "b", "P", [day(2000)]), ("2", "a", "a", "Q", [day(2001)])]


def test_only_names_of_several_parents_are_shared(spark):
    from strandline.operators import classify

    subs = spark.createDataFrame([("1", "Alpha x"), ("2", "Alpha x"), ("1", "Beta y"), ("1", "Beta y"), (None, "Beta y")], "cik string, sub_name string")
    assert [r.sub_norm for r in classify.cross_parent_names(subs).collect()] == ["alpha x"]
    assert [r.brand for r in classify.cross_parent_brands(subs).collect()] == ["alpha"]
    plan = classify.cross_parent_names(subs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_merges_read_the_driver_tables_once(spark):
    from strandline.plans.catalogue import QUERIES

    for name in ("merge_legacy", "merge_incremental"):
        files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("lineitem" in f for f in files)


def test_legacy_merge_of_children_with_dates_equals_that_of_observations(spark):
    obs = years(spark, {"A LLC": [2018], "B": [2018, 2019], "C": [2020], "D": [2017, 2020]})
    cut = "2019-06-01"
    old, new = obs.where(f"fdate < '{cut}'"), obs.where(f"fdate >= '{cut}'")
    subs = timeline.bounds(timeline.spans(timeline.presence(old)), timeline.filing_dates(timeline.presence(old)), suffix_rule=False)
    want = {tuple(r) for r in merge.legacy_merge(timeline.bounds(timeline.spans(old), timeline.filing_dates(old), suffix_rule=False), timeline.filing_dates(old), new).collect()}
    assert {tuple(r) for r in merge.legacy_merge(subs, timeline.filing_dates(timeline.presence(old)), timeline.presence(new)).collect()} == want and len(want) == 4
