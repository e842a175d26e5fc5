"""The SAS7BDAT source, approximate search, maintained reports and the cache."""

import datetime as dt
import random
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import names
from strandline.operators import features, fuzzy, maintained, timeline
from strandline.sources import sas
from strandline.sources.panel import read_observations
from strandline.streaming import cache, landing
from tests.test_panel import panel

SCHEMA = T.StructType(
    [T.StructField("CIK", T.StringType()), T.StructField("FDATE", T.DateType()), T.StructField("COMP_NAME", T.StringType()), T.StructField("AMOUNT", T.DoubleType()), T.StructField("AT", T.TimestampNTZType())]
)


def _table(n):
    return pa.table(
        {
            "CIK": [str(i) if i % 7 else None for i in range(n)],
            "FDATE": pa.array([dt.date(1950, 1, 1) + dt.timedelta(days=9 * i) if i % 5 else None for i in range(n)], pa.date32()),
            "COMP_NAME": ["é name " + "x" * (i % 50) + "   " * (i % 3) + "z" for i in range(n)],
            "AMOUNT": pa.array([i * 1.5 - 100 if i % 11 else None for i in range(n)], pa.float64()),
            "AT": pa.array([dt.datetime(2001, 1, 1, 3, 4, 5, 250000) + dt.timedelta(hours=i) if i % 4 else None for i in range(n)], pa.timestamp("us")),
        }
    )


def _read(data, path):
    path.write_bytes(data)
    layout = sas.layout_of(str(path))
    rows = np.concatenate([sas.rows_of(layout, data[layout.header + k * layout.page :][: layout.page]) for k in range(layout.pages)])
    return layout, pa.table({c.name: sas._array(layout, c, rows) for c in layout.columns})


@pytest.mark.parametrize("rle", [False, True])
def test_sas_files_read_as_pandas_reads_them(tmp_path, rle):
    table = _table(1500)
    data = b"".join(sas.encoded(table, SCHEMA, 4096, rle))
    layout, back = _read(data, tmp_path / "a.sas7bdat")
    assert back.equals(table) and layout.rows == 1500 and bool(layout.method) == rle
    other = pd.read_sas(tmp_path / "a.sas7bdat", encoding="utf-8")
    assert list(other.columns) == SCHEMA.names and len(other) == 1500
    assert [None if x != x else x for x in other["AMOUNT"]] == table.column("AMOUNT").to_pylist()
    assert [None if pd.isna(x) else x.date() for x in other["FDATE"]] == table.column("FDATE").to_pylist()
    assert [None if pd.isna(x) else x.to_pydatetime() for x in other["AT"]] == table.column("AT").to_pylist()
    assert [None if pd.isna(x) else x for x in other["CIK"]] == table.column("CIK").to_pylist()


def test_run_length_coding_is_a_round_trip():
    rng = random.Random(1)
    for _ in range(1500):
        row = b"".join(bytes([rng.choice([0, 32, 64, 65])]) * rng.choice([1, 2, 3, 17, 18, 70, 300, 2000]) for _ in range(rng.randint(1, 6)))
        assert sas.unpacked_rle(sas.packed_rle(row), len(row)) == row
    with pytest.raises(ValueError, match="control byte"):
        sas.unpacked_rle(b"\x10", 4)


def test_dictionary_coding():
    # Three literals, a run of 6, a run of 35, a piece 3 back of 4, a piece 40 back of 18.
    row = bytes([0b00011110, 0]) + b"abc" + bytes([0x03]) + b"z" + bytes([0x10, 1]) + b"y" + bytes([0x40, 0]) + bytes([0x25, 2, 2]) + b"q"
    want = b"abc" + b"z" * 6 + b"y" * 35 + b"y" * 4
    want += bytes((want[len(want) - 40 :] + want)[:18])
    assert sas.unpacked_rdc(row, len(want) + 1) == want + b"q"


def test_short_numbers_big_endian_and_mixed_pages(tmp_path):
    """A 32-bit big-endian file whose only page holds its columns and rows; numbers are cut to three bytes."""
    names = b"NUMTXT"
    text = bytes(28) + names.ljust(8, b"\0")
    sign = lambda n: struct.pack(">i", n)
    size = bytearray(sign(0xF7F7F7F7 - (1 << 32)).ljust(480, b"\0"))
    for k, v in ((5, 6), (6, 2), (9, 2), (15, 2)):
        struct.pack_into(">I", size, 4 * k, v)
    column_text = sign(-3) + struct.pack(">H", len(text) + 2) + text
    name = sign(-1) + bytes(8) + struct.pack(">HHHH", 0, 30, 3, 0) + struct.pack(">HHHH", 0, 33, 3, 0) + bytes(8)
    attributes = sign(-4) + bytes(8) + struct.pack(">IIHBB", 0, 3, 0, 1, 0) + struct.pack(">IIHBB", 3, 3, 0, 2, 0) + bytes(8)
    subs = [bytes(size), sign(0xF6F6F6F6 - (1 << 32)) + struct.pack(">II", 2, 0), column_text, name, attributes]
    page = bytearray(2048)
    struct.pack_into(">HHH", page, 16, sas.MIX, 0, len(subs))
    end = 2048
    for k, sub in enumerate(subs):
        end -= len(sub)
        page[end : end + len(sub)] = sub
        struct.pack_into(">IIBB", page, 24 + 12 * k, end, len(sub), 0, 0)
    at = 24 + 12 * len(subs)
    at += at % 8
    page[at : at + 12] = struct.pack(">d", 2.5)[:3] + b"ab " + struct.pack(">d", -8.0)[:3] + b"\xe9  "
    head = bytearray(1024)
    head[: len(sas.MAGIC)] = sas.MAGIC
    head[32] = head[35] = 0x22
    head[70] = 29
    struct.pack_into(">III", head, 196, 1024, 2048, 1)
    layout, back = _read(bytes(head + page), tmp_path / "b.sas7bdat")
    assert not layout.wide and back.to_pydict() == {"NUM": [2.5, -8.0], "TXT": ["ab", "é"]}


def test_sas_source_in_spark(spark, tmp_path):
    sas.registered(spark)
    rows = spark.createDataFrame([(str(k % 9), f"20{k % 30:02}-01-01", "P", f"Child {k} " + "w" * (1 + k % 20)) for k in range(3000)], "CIK string, FDATE string, COMP_NAME string, SUB_NAME string")
    rows = rows.withColumn("FDATE", F.to_date("FDATE")).repartition(3)
    folder = str(tmp_path / "panel")
    write = lambda mode: rows.write.format("sas7bdat").option("pageSize", 4096).option("fileBytes", 15_000).mode(mode).save(folder)
    write("append")
    files = sas.files_of(folder)
    back = spark.read.format("sas7bdat").option("pages", 8).load(folder)
    assert back.rdd.getNumPartitions() > len(files) > 3 and back.schema.simpleString() == "struct<CIK:string,FDATE:date,COMP_NAME:string,SUB_NAME:string>"
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    write("append")
    assert spark.read.format("sas7bdat").load(folder).count() == 6000
    write("overwrite")
    assert read_observations(spark, folder, "sas7bdat").count() == 3000
    assert not [x for x in (tmp_path / "panel").iterdir() if x.suffix != ".sas7bdat"]
    empty = str(tmp_path / "none")
    rows.limit(0).write.format("sas7bdat").mode("append").save(empty)
    assert spark.read.format("sas7bdat").load(empty).count() == 0
    with pytest.raises(Exception, match="can't hold"):
        spark.range(1).select(F.array("id").alias("a")).write.format("sas7bdat").mode("append").save(str(tmp_path / "bad"))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        below = [i + 1]
        for j, y in enumerate(b):
            below.append(min(row[j + 1] + 1, below[j] + 1, row[j] + (x != y)))
        row = below
    return row[-1]


def test_bitap_counts_errors():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in "xy")
        k, whole = rng.randint(0, 4), _distance(a, b)
        part = min(_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert fuzzy.bitap(a, b, k) == (whole if whole <= k else None) and fuzzy.bitap(a, b, k, whole=False) == (part if part <= k else None)
    long = "".join(rng.choice("abcd") for _ in range(300))
    assert fuzzy.bitap(long, long[:100] + "x" + long[101:], 2) == 1


@pytest.mark.parametrize("most", [1, 3, 9])
def test_search_finds_what_brute_force_finds(spark, most):
    rng = random.Random(most)
    names = ["".join(rng.choice("abcab ") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "a", "ab", None, "漢字 holdings", "漢字 holding"]
    asked = rng.sample([n for n in names if n], 40) + ["", "zz", "漢 holdings", None, "x" * 60, "abcabcabcabcabc"]
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {tuple(r) for r in fuzzy.matches(frame(asked, "query"), frame(names, "name"), most=most).collect()}
    want = {(q, n, _distance(q, n)) for q in asked if q is not None for n in names if n is not None and _distance(q, n) <= min(int(len(q) * 0.4), most)}
    assert got == want


def test_search_has_no_cross_join(spark):
    rows = spark.createDataFrame([("abcdefgh",)], "query string")
    plan = fuzzy.matches(rows, rows.withColumnRenamed("query", "name"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    top = fuzzy.best(rows, spark.createDataFrame([(x,) for x in ("abcdefgh", "abcdefgi", "bbcdefgh", "abcdefg")], "name string"), 3)
    assert [tuple(r)[1:] for r in top.orderBy("rank").collect()] == [(1, "abcdefgh", 0), (2, "abcdefg", 1), (3, "abcdefgi", 1)]


def _obs(spark, seed, n=300):
    rng = random.Random(seed)
    return panel(spark, sorted({(str(rng.randint(1, 12)), f"{rng.randint(2000, 2012)}-0{rng.randint(1, 9)}-01", "Parent", f"Child {rng.randint(1, 9)}") for _ in range(n)}))


def _counts(frame):
    return sorted(map(tuple, frame.collect()))


def _whole(obs):
    kids = timeline.presence(obs)
    filings = timeline.all_filings(kids)
    return _counts(maintained.contributions(timeline.timeline_of(kids, filings), filings))


def test_maintained_reports_equal_recomputed_ones(spark, tmp_path):
    kept, sofar = maintained.Maintained(spark, str(tmp_path / "m"), 4), None
    for batch, seed in enumerate((1, 2, 3)):
        new = _obs(spark, seed, 60)
        sofar = new if sofar is None else sofar.unionByName(new)
        kept.apply(batch, new)
        assert _counts(kept.counts()) == _whole(sofar)
    kept.apply(2, _obs(spark, 9))  # a batch that is done
    assert _counts(kept.counts()) == _whole(sofar) and kept.batches() == [1, 2]


def test_a_batch_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    kept, first, second = maintained.Maintained(spark, str(tmp_path / "m"), 4), _obs(spark, 4), _obs(spark, 5)
    kept.apply(0, first)
    publish = maintained.Maintained._publish

    def broken(self, staged, batch):
        rows = self.spark.read.schema(maintained.KIDS).parquet(f"{self.folder}/{staged}/kids")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/kids")
        raise OSError("lost")

    monkeypatch.setattr(maintained.Maintained, "_publish", broken)
    with pytest.raises(OSError, match="lost"):
        kept.apply(1, second)
    assert kept.batches() == [0] and _counts(kept.counts()) == _whole(first)
    monkeypatch.setattr(maintained.Maintained, "_publish", publish)
    kept.apply(1, second)
    assert _counts(kept.counts()) == _whole(first.unionByName(second))


def test_a_batch_reads_the_partitions_of_its_parents(spark, tmp_path):
    kept = maintained.Maintained(spark, str(tmp_path / "m"), 8)
    kept.apply(0, _obs(spark, 6))
    plan = kept.table("kids", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    one = panel(spark, [("5", "2030-01-01", "Parent", "Child 1")])
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "m" / "kids").rglob("*.parquet")}
    kept.apply(1, one)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "m" / "kids").rglob("*.parquet")}
    assert len({f.parent for f in before.keys() - after.keys()}) == 1
    assert maintained.changed(spark.range(3), spark.range(1, 4)).count() == 2


def test_cache_outcomes(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(0), "lookup"), ("a", at(5), "lookup"), ("a", at(6), "other"), ("a", at(12), "lookup"), ("a", at(14), "invalidate"), ("a", at(15), "invalidate"), ("a", at(16), "lookup"), ("b", at(3), "lookup"), ("c", at(40), "other")]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "key string, at timestamp_ntz, what string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("key string, at timestamp_ntz, what string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = cache.served(stream, 10_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.key, (r.at - at(0).replace(tzinfo=r.at.tzinfo)).total_seconds(), r.outcome, r.served) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", 0, "miss", 1), ("a", 5, "hit", 1), ("a", 10, "expired", 1), ("a", 12, "miss", 4), ("a", 14, "invalidated", 5), ("a", 15, "nothing", 6), ("a", 16, "miss", 7), ("a", 26, "expired", 7),
        ("b", 3, "miss", 1), ("b", 13, "expired", 1),
    ]
    tally = {r.key: tuple(r)[1:] for r in cache.tallied(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert tally == {"a": (1, 3, 2, 1, 13), "b": (0, 1, 1, 0, 1)}


def test_landed_pages_go_on_where_they_stopped(spark, tmp_path):
    pages = spark.createDataFrame([(f"h{k % 23:02}/ü", k, f"<p>{k}</p>") for k in range(100)], "parent string, page_id long, html string")
    landing.land(pages, str(tmp_path / "in"))
    seen, fail = [], [2]

    def batch(rows, number):
        if number in fail:
            fail.clear()
            raise InterruptedError
        seen.append((number, sorted((r.parent, r.page_id, r.html) for r in rows.collect())))

    def run(stop=None):
        query = landing.landed(spark, str(tmp_path / "in"), str(tmp_path / "c"), 5).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="InterruptedError"):
        run()
    run()
    run()  # nothing is new
    landing.land(spark.createDataFrame([("z", 999, "late")], "parent string, page_id long, html string"), str(tmp_path / "in"))
    run()
    assert [len({r[0] for r in rows}) for _, rows in seen] == [5, 5, 5, 5, 3, 1] and [n for n, _ in seen] == list(range(6))
    assert sorted(r for _, rows in seen for r in rows) == sorted([*((r.parent, r.page_id, r.html) for r in pages.collect()), ("z", 999, "late")])


def test_alike_names_are_not_all_candidates(spark):
    """Names that differ in few digits share nearly all grams; those that are too far are not compared in Python."""
    names = [f"Supplier#{k:09} Brand#{b} Holdings" for k in range(0, 400, 2) for b in (7, 17)]
    asked = [f"Suplier#{k:09} Brnd#7 Holdings" for k in range(0, 400, 8)]
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    found = fuzzy.candidates(frame(asked, "query"), frame(names, "name"))
    got = {(r.query, r.name) for r in found.collect()}
    assert got == {(q, n) for q in asked for n in names if _distance(q, n) <= 3} and found.count() == len(got)


def test_names_of_one_end_meet_by_the_other_half(spark, monkeypatch):
    """A half that all names and queries share must not pair all of them, and no pair may be lost by it."""
    monkeypatch.setattr(fuzzy, "FEW", 4)
    monkeypatch.setattr(fuzzy, "HOT", 64)
    names = [f"Supplier#{k:09} Brand#7 Holdings" for k in range(0, 6000, 10)]
    asked = [f"Suplier#{k:09} Brnd#7 Holdings" for k in range(0, 6000, 20)]
    rows = lambda texts, key: spark.createDataFrame([(i, 0, t, 3, None) for i, t in enumerate(texts)], f"{key} long, bucket long, text string, k int, was string")
    met = sum(df.count() for df in fuzzy._met(rows(asked, "query_id"), rows(names, "name_id").drop("k")))
    want = {(q, n, e) for q in asked for n in names if (e := fuzzy.bitap(q, n, 3)) is not None}
    assert len(want) <= met < 4 * len(want) < len(asked) * len(names) / 6
    frame = lambda texts, c: spark.createDataFrame([(t,) for t in texts], f"{c} string")
    assert {tuple(r) for r in fuzzy.matches(frame(asked, "query"), frame(names, "name")).collect()} == want


def test_search_is_whole_where_every_key_is_hot(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "FEW", 1)
    monkeypatch.setattr(fuzzy, "HOT", 2)
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(4, 16))) for _ in range(120)})
    asked = rng.sample(names, 30) + ["bbbbbbbbb", "a b a b a b a b"]
    frame = lambda texts, c: spark.createDataFrame([(t,) for t in texts], f"{c} string")
    got = {tuple(r) for r in fuzzy.matches(frame(asked, "query"), frame(names, "name")).collect()}
    assert got == {(q, n, _distance(q, n)) for q in asked for n in names if _distance(q, n) <= min(int(len(q) * 0.4), 3)}


def test_acquirers_meet_names_by_their_whole_start(spark):
    """Starts whose first letters all names share must not pair with all of them, nor may pieces of names be broadcast."""
    known = spark.createDataFrame([(f"initech{k:04} soft", "acme") for k in range(300)], "company string, acquirer string")
    subs = spark.createDataFrame([("1", f"The Initech{k:04} Software initech{k:04} soft") for k in range(0, 600, 2)], "cik string, sub_name string")
    found = features.labels_from_acquirers(subs, spark.createDataFrame([("1", "Acme Industries")], "cik string, company_name string"), known)
    assert sorted(r.sub_name for r in found.collect()) == sorted(f"The Initech{k:04} Software initech{k:04} soft" for k in range(0, 300, 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_acquirers_label_every_child_that_holds_a_start(spark):
    """However many children hold the start of a company, and whichever parents come before the acquirer."""
    known = spark.createDataFrame([("initech", "acme")], "company string, acquirer string")
    subs = spark.createDataFrame([(str(p), f"Initech {k}") for p in (1, 2, 3) for k in range(9)], "cik string, sub_name string")
    companies = spark.createDataFrame([("1", "Other"), ("2", "Acme Industries"), ("3", "Acme Labs")], "cik string, company_name string")
    found = features.labels_from_acquirers(subs, companies, known)
    assert sorted((r.cik, r.sub_name) for r in found.collect()) == [(p, f"Initech {k}") for p in "23" for k in range(9)]


def test_signals_shuffle_no_children_for_small_sides(spark):
    from strandline.operators import classify
    from strandline.store import stored

    subs = stored(spark.createDataFrame([(str(k % 5), f"Brand{k % 3} Inc {k % 7}", "2001-01-01") for k in range(60)], "cik string, sub_name string, first_seen string"))
    companies = stored(spark.createDataFrame([(str(k), f"P {k}", "2001-01-01") for k in range(5)], "cik string, company_name string, first_filing string"))
    rows = classify.signals(subs, companies)
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.batch_size for r in rows.collect()} == {12} and all(r.cross_parent for r in rows.collect())


def test_trimmed_takes_all_white_space(spark):
    texts = [c + "a" + c + "b" + c for c in map(chr, range(1, 0x3100))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.where(~names.trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


@pytest.mark.parametrize("rle", [False, True])
def test_sas_rows_are_encoded_a_slice_at_a_time(tmp_path, monkeypatch, rle):
    whole = b"".join(sas.encoded(_table(1500), SCHEMA, 4096, rle))
    cells, seen = sas._cells, []
    monkeypatch.setattr(sas, "_cells", lambda column, *rest: seen.append(len(column)) or cells(column, *rest))
    monkeypatch.setattr(sas, "BATCH_ROWS", 100)
    assert b"".join(sas.encoded(_table(1500), SCHEMA, 4096, rle)) == whole
    assert max(seen) <= 100 and sum(seen) == 1500 * len(SCHEMA.names)
