"""Long runs that report as they go, can be cancelled, and don't start too soon again.

A run goes over its table in parts, by hash of a key.  Each part is written while Spark
observes what is counted, so counting costs no further pass (but a table that isn't kept
by that key is read once a part, so parts should be few); after each part a row says
how far the run is.  Parts that are there are not run again, so a run that was cancelled
or broke off goes on where it stopped.  Runs carry a job tag by which any thread, or any
program of the session, can cancel them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EVENTS = "event string, part int, processed long, total long, percent int, counts string"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _there(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


class Run:
    """A transformation of a table, part by part, with events and a tag."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 8, name: str = "run"):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.tag = f"{name}-{uuid.uuid4().hex[:8]}"

    def _say(self, event: str, part: int, processed: int, total: int, counts: dict[str, int]) -> None:
        percent = round(100 * processed / total) if total else 100
        row = [(event, part, processed, total, percent, json.dumps(counts, sort_keys=True))]
        self.spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/events/{event}-{part:06}")

    def go(self, rows: DataFrame, key: list[str], make: Callable[[DataFrame], DataFrame], counted: dict[str, Column]) -> None:
        """Write ``make`` of each part of the rows; ``counted`` are tests over its result, counted on the way."""
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            part_of = F.pmod(F.xxhash64(*key), F.lit(self.parts))
            total = rows.count()
            self._say("start", 0, 0, total, {})
            processed, sums = 0, dict.fromkeys(counted, 0)
            for part in range(self.parts):
                if not _there(self.spark, f"{self.folder}/events/progress-{part:06}/_SUCCESS"):
                    seen = Observation(f"{self.tag}-{part}")
                    tests = [F.count_if(test).alias(name) for name, test in counted.items()]
                    made = make(rows.where(part_of == part)).observe(seen, F.count("*").alias("rows"), *tests)
                    made.write.mode("overwrite").parquet(f"{self.folder}/result/part={part}")
                    found = seen.get
                    processed += found["rows"]
                    sums = {n: sums[n] + found[n] for n in sums}
                    self._say("progress", part, processed, total, sums)
                else:
                    last = self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events/progress-{part:06}").first()
                    processed, sums = last["processed"], json.loads(last["counts"])
            self._say("done", self.parts, processed, total, sums)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        """Stop what the run is doing, from any thread; what it has written stays."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{self.folder}/events")

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/result").drop("part")


def run_if_due(spark: SparkSession, folder: str, job: Callable[[], object], now: dt.datetime, hours: float = 24) -> bool:
    """Run the job unless its last whole run is younger than the hours; the time is kept only once the job has ended."""
    state = f"{folder.rstrip('/')}/last_run"
    if _there(spark, f"{state}/_SUCCESS"):
        last = spark.read.schema("at timestamp_ntz").parquet(state).first()["at"]
        if now - last < dt.timedelta(hours=hours):
            return False
    job()
    spark.createDataFrame([(now,)], "at timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(state)
    return True
