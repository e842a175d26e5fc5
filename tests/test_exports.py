"""Workbooks, printed documents, watch lists, long runs and pattern automata."""

import datetime as dt
import random
import re
import threading
import time
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from strandline.functions import geography
from strandline.functions.patterns import Ordered, literal
from strandline.operators import paper, watchlist
from strandline.operators.geography import bottom
from strandline.operators.progress import Run, run_if_due
from strandline.sources import workbook


def test_workbooks_are_a_round_trip(spark, tmp_path):
    rows = [(k, f'n <{k}> & "q" é漢', None if k % 3 else "x\n y ", k / 4 if k % 2 else None, k % 2 == 0) for k in range(250)]
    frame = spark.createDataFrame(rows, "k long, name string, note string, v double, flag boolean").repartition(3)
    folder = str(tmp_path / "books")
    workbook.write_workbooks(frame, folder, "Rows & more", sheet_rows=41)
    books = workbook.books_of(folder)
    assert len(books) == 3 and not [x for x in (tmp_path / "books").iterdir() if x.suffix != ".xlsx"]
    back = workbook.read_workbooks(spark, folder)
    got = sorted((int(r.k), r.name, r.note, r.v and float(r.v), r.flag == "true") for r in back.collect())
    assert got == rows and back.rdd.getNumPartitions() == sum(len([n for n in zipfile.ZipFile(b).namelist() if "worksheets/" in n]) for b in books) >= 7
    with zipfile.ZipFile(books[0]) as book:
        assert book.testzip() is None
        for name in book.namelist():
            ElementTree.fromstring(book.read(name))
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
        assert sheet.count("<row ") <= 41 and 'width="19"' in sheet and '<c r="A1" s="1" t="inlineStr">' in sheet
        assert 'name="Rows &amp; more 2"' in book.read("xl/workbook.xml").decode()
    workbook.write_workbooks(frame.limit(0), folder)
    assert workbook.read_workbooks(spark, folder).count() == 0 and len(workbook.books_of(folder)) == 1
    assert [workbook.letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_workbooks_with_shared_texts_are_read(spark, tmp_path):
    main = workbook._MAIN
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si><si><t>n</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row><row r="3"/></sheetData></worksheet>')
    got = workbook.read_workbooks(spark, str(tmp_path / "a.xlsx")).collect()
    assert [tuple(r) for r in got] == [("two runs", None, "5"), (None, None, None)] and got[0].asDict().keys() == {"name", "column1", "n"}


def test_documents_point_at_their_objects(spark):
    subs = spark.createDataFrame(
        [("1", f"Child ({k}) \\ é" + "x" * 50, f"c{k}", "2001-01-01", None, "On or before 2001-01-01 and much more text", None, "HIGH") for k in range(95)] + [("2", "Only", "only", None, None, None, None, None)],
        "cik string, sub_name string, sub_norm string, first_seen string, last_seen string, time_in string, time_out string, confidence string",
    )
    companies = spark.createDataFrame([(c, f"P ({c})", 5, "2001", "2002") for c in "123"], "cik string, company_name string, num_subsidiaries int, first_filing string, last_filing string")
    docs = {r.cik: r for r in paper.documents(subs, companies, most=90).collect()}
    assert {c: r.pages for c, r in docs.items()} == {"1": 3, "2": 1}
    for r in docs.values():
        data = r.pdf.encode("ascii")
        start = int(re.search(rb"startxref\n(\d+)", data)[1])
        assert data[start : start + 4] == b"xref"
        places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data)]
        assert len(places) == 3 + 2 * r.pages and all(data[at:].startswith(f"{n} 0 obj\n".encode()) for n, at in enumerate(places, 1))
        for length, body in re.findall(rb"/Length (\d+) >>\nstream\n(.*?)\nendstream", data, re.S):
            assert int(length) == len(body)
    back = paper.read_back(spark.createDataFrame(list(docs.values()))).orderBy("cik", "line").collect()
    assert all(r.sound for r in back) and len(back) == 91
    assert back[0].text.startswith("Child (0) \\ ?xxx") and back[0].text.endswith("| 2001-01-01 |  | On or before 2001-01-01 and much mo |  | HIGH".replace("|  | On", "| On"))


REQUESTS = [
    (1, "u", "a", "add", 1), (2, "u", "a", "add", 2), (3, "u", "a", "remove", 3), (4, "u", "a", "remove", 4), (5, "u", "x", "add", 5), (6, "u", "x", "remove", 6), (7, "v", "a", "add", 7), (8, "u", "a", "add", 8), (9, "w", "b", "add", 1), (10, "w", "b", "remove", 9),
]


def test_watch_outcomes_and_alerts(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    requests = spark.createDataFrame([(*r[:4], day(r[4])) for r in REQUESTS], "request long, user_id string, cik string, what string, at timestamp_ntz")
    companies = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "cik string, company_name string, num_subsidiaries int")
    judged = watchlist.outcomes(requests, companies)
    assert {r.request: r.outcome for r in judged.collect()} == {1: "added", 2: "conflict", 3: "removed", 4: "not found", 5: "unknown company", 6: "not found", 7: "added", 8: "added", 9: "added", 10: "removed"}
    held = watchlist.outcomes(requests, companies, spark.createDataFrame([("u", "a"), ("u", "a")], "user_id string, cik string"))
    assert held.where("request = 1").first().outcome == "conflict"
    assert sorted((r.user_id, r.cik, r.company_name) for r in watchlist.watchlist(judged, companies).collect()) == [("u", "a", "A"), ("v", "a", "A")]
    filings = [(20, "a", day(2)), (21, "a", day(3)), (22, "a", day(8)), (23, "b", day(1)), (24, "b", day(9)), (25, "x", day(9))]
    spark.createDataFrame(filings, "filing long, cik string, at timestamp_ntz").repartition(2).write.parquet(str(tmp_path / "in"))
    watching = watchlist.spans(judged)
    for run in range(2):
        stream = spark.readStream.schema("filing long, cik string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watchlist.alert_stream(stream, watching, str(tmp_path / "alerts"), str(tmp_path / f"c{run}")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "alerts")).drop("day")
    assert sorted(r.alert_id for r in kept.collect()) == ["20/u", "22/u", "22/v", "23/w"]
    done, marks = watchlist.marked(kept, spark.createDataFrame([("22/u", "u"), ("22/v", "u"), ("99/u", "u")], "alert_id string, user_id string"))
    assert {r.alert_id: r.read for r in done.collect()} == {"20/u": False, "22/u": True, "22/v": False, "23/w": False}
    assert {r.alert_id: r.outcome for r in marks.collect()} == {"22/u": "read", "22/v": "not found", "99/u": "not found"}


def test_noted_alerts_are_those_written(spark, tmp_path):
    """Listed as they are read, alerts take no disk; filings that come again, also to a stream with other spans, add nothing."""
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rng = random.Random(3)
    rows = [(k, rng.choice("ab"), at(rng.randint(0, 90))) for k in range(60)]
    for part in range(2):
        spark.createDataFrame(rows[part * 20 :], "filing long, cik string, at timestamp_ntz").write.parquet(str(tmp_path / f"in{part}"))
    spans = [[(u, rng.choice("ab"), at(s := rng.randint(0, 60)), rng.choice([None, at(s + 20)])) for u in range(12)] for _ in range(2)]
    kept = {}
    for listed in (True, False):
        folder = str(tmp_path / f"alerts{listed}")
        for run, part in enumerate((1, 0)):
            stream = spark.readStream.schema("filing long, cik string, at timestamp_ntz").parquet(str(tmp_path / f"in{part}"))
            watching = spark.createDataFrame(spans[run], "user_id long, cik string, since timestamp_ntz, until timestamp_ntz")
            watchlist.alert_stream(stream, watching, folder, f"{folder}-c{run}", listed).awaitTermination()
        frame = spark.read.parquet(folder).drop("batch") if listed else watchlist.noted_alerts(spark, folder, day=F.dayofmonth("at")).where("day = day(at)").drop("day")
        kept[listed] = sorted(map(tuple, frame.select("alert_id", "user_id", "cik", "at", "read").collect()))
    assert kept[True] == kept[False] and len(kept[True]) > 100
    assert not list((tmp_path / "alertsFalse").glob("batch=*"))


def test_a_run_reports_and_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(1000)
    run = Run(spark, str(tmp_path / "run"), 4)
    made = []

    def make(part):
        made.append(1)
        if len(made) == 3:
            raise OSError("lost")
        return part.withColumn("even", F.col("id") % 2 == 0)

    with pytest.raises(OSError, match="lost"):
        run.go(rows, ["id"], make, {"even": F.col("even")})
    assert [r.event for r in run.events().orderBy("part").collect()].count("progress") == 2
    run.go(rows, ["id"], make, {"even": F.col("even")})
    events = {(r.event, r.part): r for r in run.events().collect()}
    assert len(made) == 5 and events[("done", 4)].processed == 1000 and events[("done", 4)].counts == '{"even": 500}'
    percents = [events[("progress", k)].percent for k in range(4)]
    assert percents == sorted(percents) and percents[-1] == 100 and run.result().count() == 1000


def test_a_run_can_be_cancelled(spark, tmp_path):
    run, failed = Run(spark, str(tmp_path / "slow"), 1), []

    def work():
        try:
            slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
            run.go(spark.range(0, 4000, 1, 8), ["id"], lambda part: part.select(slow("id").alias("id")), {"some": F.col("id") >= 0})
        except Exception as e:  # the cancelled job's
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(8)
    began = time.time()
    run.cancel()
    thread.join(60)
    assert failed and time.time() - began < 40 and not [r for r in run.events().collect() if r.event == "done"]


def test_run_guard(spark, tmp_path):
    done, at = [], dt.datetime(2024, 1, 1)
    job = lambda: done.append(1)
    folder = str(tmp_path / "guard")
    with pytest.raises(ZeroDivisionError):
        run_if_due(spark, folder, lambda: 1 / 0, at)
    assert run_if_due(spark, folder, job, at) and not run_if_due(spark, folder, job, at + dt.timedelta(hours=23)) and run_if_due(spark, folder, job, at + dt.timedelta(hours=24))
    assert len(done) == 2


def test_patterns_in_one_pass():
    forms = [(re.compile(p, re.IGNORECASE), c) for p, c in geography.LEGAL_FORMS]
    names = [(re.compile(rf"\b{re.escape(a)}\b"), c) for a, c in geography.country_names()]

    def plain(text):
        found = next((c for p, c in forms if p.search(text)), None)
        return found or next((c for p, c in names if p.search(text.lower())), None)

    assert literal(r"\bS\.\s*de\s*R\.L\.\s*de\s*C\.V\.") == "r.l." and literal(r"\bPty\.?\s+Ltd\.?\s*$") == "pty" and literal(r"\bULC\b.*(?:Canada|Alberta|Ontario)") == "ulc"
    machine, rng = Ordered(geography.LEGAL_FORMS, geography.country_names()), random.Random(1)
    pieces = ["Foo", "S.A.", "de", "C.V.", "R.L.", "S.", "GmbH", "& Co. KG", "Pty", "Ltd.", "Limited", "Canada", "Hong Kong", "U.S.", "u.k.", "a.s.", "S.a.r.l.", "S. à r.l.", "Co., Ltd.", "Korea", "ULC", "Ontario", "N.A.", "Inc", "Sp. z o.o.", "x", "A/S", "L.P.", "czech republic", "isle of man"]
    for _ in range(5000):
        text = rng.choice([" ", ""]).join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        assert machine.first(text) == plain(text), text
    assert machine.first(None) is None and machine.first("") is None


def test_bottom_sample_of_samples(spark):
    rows = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    whole = {r.id for r in bottom(rows, ["k"], 50).collect()}
    parts = bottom(rows.where("id < 400"), ["k"], 50).unionByName(bottom(rows.where("id >= 400"), ["k"], 50))
    assert {r.id for r in bottom(parts, ["k"], 50).collect()} == whole and len(whole) == 50
    assert "TakeOrderedAndProject" in bottom(rows, ["k"], 50)._jdf.queryExecution().executedPlan().toString()


def test_counted_alerts_are_those_listed(spark):
    rng, at = random.Random(5), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * n)
    requests = spark.createDataFrame([(k, rng.randint(0, 6), str(rng.randint(0, 2)), rng.choice(["add", "remove"]), at(rng.randint(0, 40))) for k in range(200)], "request long, user_id long, cik string, what string, at timestamp_ntz")
    companies = spark.createDataFrame([("0",), ("1",)], "cik string")
    watching = watchlist.spans(watchlist.outcomes(requests, companies))
    filings = spark.createDataFrame([(k, rng.choice("012"), at(rng.randint(-5, 50))) for k in range(90)] + [(90, "0", None)], "filing long, cik string, at timestamp_ntz")
    listed = watchlist.alerts(filings, watching, 3)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, watchlist.alerts(filings, watching, 1).collect()))
    by_filing = {}
    for r in listed.collect():
        by_filing.setdefault(int(r.alert_id.split("/")[0]), []).append(r.user_id)
    counted = watchlist.alert_counts(filings, watching)
    assert {r.filing: r.alerts for r in counted.collect()} == {k: len(by_filing.get(k, [])) for k in range(91)} and max(map(len, by_filing.values())) > 2
    marks = [(rng.randint(0, 95), rng.randint(0, 6)) for _ in range(300)]
    single = spark.createDataFrame(marks, "filing long, user_id long")
    tried = single.select(watchlist.alert_id(F.col("filing"), F.col("user_id")).alias("alert_id"), "user_id")
    own = listed.where("cast(split(alert_id, '/')[0] AS long) % 3 = 0").select("alert_id", "user_id")
    done, judged = watchlist.marked(listed, tried.unionByName(own))
    want = {("alerts", str(r.read).lower(), r["count"]) for r in done.groupBy("read").count().collect()} | {("marks", r.outcome, r["count"]) for r in judged.groupBy("outcome").count().collect()}
    assert {tuple(r) for r in watchlist.mark_totals(filings, watching, single, F.col("filing") % 3 == 0).collect()} == want and len(want) == 4


def test_registered_exports_have_no_cap(spark):
    from strandline.plans.queries import QUERIES

    plan = QUERIES["export_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
