"""Streams and registered queries."""

import datetime as dt
import glob
import importlib

import duckdb
import pytest

from strandline.operators import timeline
from strandline.plans import fixtures
from strandline.plans import queries as catalogue
from strandline.sources.panel import driver_observations
from strandline.streaming import ingest, limits

SF = "/root/testdata/sf0.001"


def test_stream_of_filings_equals_a_batch(spark, tmp_path):
    obs = driver_observations(spark, SF).where("cik IN ('1', '2', '3')").select("cik", "fdate", "comp_name", "sub_name")
    late, early = obs.where("year(fdate) % 2 = 0"), obs.where("year(fdate) % 2 = 1")
    landing = str(tmp_path / "landing")
    for part in (late, early):
        part.coalesce(1).write.mode("append").parquet(landing)
        query = ingest.ingest(spark, landing, str(tmp_path / "panel"), str(tmp_path / "state"), files=1)
        query.awaitTermination()
    want = {tuple(r) for r in timeline.child_timeline(driver_observations(spark, SF).where("cik IN ('1', '2', '3')")).collect()}
    got = spark.read.parquet(str(tmp_path / "panel" / "children")).drop("bucket")
    assert {tuple(r) for r in got.collect()} == want


def test_limiter_forgets_what_it_rejects(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=s)) for s in (0, 1, 2, 3, 10, 11, 12)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = limits.limited(stream, most=2, seconds=10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r.allowed for r in spark.sql("SELECT * FROM limited ORDER BY ts").collect()]
    assert got == [True, True, False, False, True, True, False]


OVER_TABLES = (
    "gap_fill", "child_timeline", "company_rollup", "panel_build", "filing_timeline", "timeline_growth", "fastest_growth", "classify_type", "features", "training_file", "geo_countries",
    "ma_events", "merge_legacy", "merge_incremental", "quality_report_pages", "clean_actions_children", "strict_report", "quality_preview", "quality_compared", "integrity_checks", "orphans", "rolling_60s_count",
)
OVER_ROWS = sorted(n for n, q in catalogue.QUERIES.items() if q.__module__ == fixtures.__name__)


@pytest.mark.parametrize("name", [*OVER_TABLES, *OVER_ROWS])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    df = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in names) for r in df.collect()) == key(want.fetchall())


def test_buckets_of_a_panel_are_its_own_and_split_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_ROWS", 100)
    obs = driver_observations(spark, SF).where("cik IN ('1', '2')").select("cik", "fdate", "comp_name", "sub_name")
    folder = str(tmp_path / "panel")
    ingest.merge_batch(spark, folder, obs.where("cik = '1'"), buckets=3)
    ingest.merge_batch(spark, folder, obs, buckets=7)
    ingest.merge_batch(spark, folder, obs)
    got = spark.read.parquet(f"{folder}/children")
    assert got.where("bucket > 2").count() == 0 and ingest.buckets_of(spark, folder) == 3
    assert {tuple(r) for r in got.drop("bucket").collect()} == {tuple(r) for r in timeline.child_timeline(driver_observations(spark, SF).where("cik IN ('1', '2')")).collect()}
    assert len(glob.glob(f"{folder}/observations/bucket=*/*.parquet")) > got.select("bucket").distinct().count()


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_batch_of_filings_that_broke_off_while_it_was_moved_is_finished(spark, tmp_path, monkeypatch):
    from strandline.operators import partitions

    obs = driver_observations(spark, SF).where("cik IN ('1', '2', '3')").select("cik", "fdate", "comp_name", "sub_name")
    folder, replace = str(tmp_path / "panel"), partitions.replace
    ingest.merge_batch(spark, folder, obs.where("fdate >= '1998-01-01'"), buckets=4)

    def broken(session, source, target, files):
        replace(session, source, target, dict(list(files.items())[:1]))
        raise OSError("lost")

    monkeypatch.setattr(partitions, "replace", broken)
    with pytest.raises(OSError, match="lost"):
        ingest.merge_batch(spark, folder, obs.where("fdate < '1998-01-01'"))
    monkeypatch.setattr(partitions, "replace", replace)
    ingest.merge_batch(spark, folder, obs.where("fdate < '1998-01-01'"))
    want = {tuple(r) for r in timeline.child_timeline(driver_observations(spark, SF).where("cik IN ('1', '2', '3')")).collect()}
    got = [tuple(r) for r in spark.read.parquet(f"{folder}/children").drop("bucket").collect()]
    assert len(got) == len(want) and set(got) == want
    kids = spark.read.parquet(f"{folder}/observations")
    assert kids.count() == len(want) and kids.where("bucket > 3").count() == 0


def test_a_batch_is_dealt_once_and_its_files_are_moved(spark, tmp_path):
    from strandline.operators import partitions

    obs = driver_observations(spark, SF).where("cik IN ('1', '2', '3')")
    kids = timeline.presence(obs).withColumn("bucket", partitions.bucket_of(4))
    plan = partitions.merged(kids.limit(0), kids, partitions.sizes(kids))._jdf.queryExecution().executedPlan().toString()
    # After rows are dealt by bucket and child, the aggregation needs no exchange of its own.
    assert plan.index("SortAggregate") < plan.index("Exchange hashpartitioning(bucket") and plan[: plan.index("Exchange hashpartitioning(bucket")].count("Exchange") == 0
    partitions.write(kids, str(tmp_path / "a"))
    files = partitions.listed(spark, str(tmp_path), "a")
    partitions.replace(spark, str(tmp_path / "a"), str(tmp_path / "b"), {b: [f for _, p, f in files if p == b] for _, b, _ in files})
    assert {(p.parent.name, p.name) for p in (tmp_path / "b").rglob("part-*")} == {(b, f) for _, b, f in files} and not list((tmp_path / "a").rglob("part-*"))
