"""Reports kept up to date by signed differences.

The state of a panel is its presence table (a row a child with its dates), its timeline
and what each partition adds to the reports, all in partitions of hashed parents, and the counts of the reports.  A batch of
observations reads the partitions of its parents and nothing else: what they added as they
were counts ``-1``, what they add after the batch ``+1``, what didn't change cancels out, and
the rest is added to the counts.  A filing that arrives late takes back what it corrects,
such as a child that was active, or a span that was shorter.

A batch is computed into a folder of its own, its files are moved from there, and only then are its
counts readable: a run that breaks off at any point is repeated with the same result,
and a batch that is done changes nothing when it comes again.  Readers of the counts see
those of one whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.names import is_active
from strandline.operators.analytics import year_of
from strandline.operators import partitions
from strandline.operators.partitions import KIDS
from strandline.operators.timeline import all_filings, presence, timeline_of
from strandline.sources.panel import observations
from strandline.store import forget, stored

BUCKETS = 64
SUBS = "cik string, sub_norm string, sub_name string, first_seen string, last_seen string, time_in string, time_out string, confidence string, bucket int"
COUNTS = "report string, k string, n long"
#: What each partition adds to the counts.
PARTS = f"{COUNTS}, bucket int"
TABLES = {"kids": KIDS, "subs": SUBS, "parts": PARTS}


def _sized(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").when(n <= 100, "51-100").when(n <= 500, "101-500").otherwise("500+")


def _lasted(years: Column) -> Column:
    return F.when(years == 0, "Single year").when(years <= 2, "1-2 years").when(years <= 5, "3-5 years").otherwise("6+ years")


def contributions(subs: DataFrame, filings: DataFrame, sign: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """report, k, n: what children (a timeline) and filings (cik, fdate) add to each report.

    added and removed (by year), confidence (year/grade), longevity, seen (children whose span
    covers a filing of the year), filing (parents that file in a year), children and divested
    (by parent), sizes (parents by number of children).  ``by`` are columns of both, determined by the parent, to count by.
    """
    # Children that count alike are one row from here on.
    cells = stored(subs.groupBy(*by, "cik", "first_seen", "last_seen", "confidence", (~is_active(F.col("time_out"))).alias("gone")).agg(F.count("*").alias("n")))
    first, last, gone = year_of("first_seen"), year_of("last_seen"), F.col("gone")
    entry = lambda report, key, test=F.lit(True): F.when(test, F.struct(F.lit(report).alias("report"), key.cast("string").alias("k")))
    entries = F.array(
        entry("added", first),
        entry("removed", last, gone),
        entry("confidence", F.concat_ws("/", first, "confidence")),
        entry("longevity", _lasted(last - first)),
        entry("children", F.col("cik")),
        entry("divested", F.col("cik"), gone),
    )
    by_child = cells.select(*by, "n", F.explode(F.array_compact(entries)).alias("e")).groupBy(*by, "e.report", "e.k").agg(F.sum("n").alias("n"))
    # A parent's filings are one row, which is small and written, so that children needn't be shuffled to it.
    parents = stored(filings.groupBy("cik").agg(F.collect_set("fdate").alias("filed")))
    inside = lambda d: (F.to_date("first_seen") <= d) & (F.to_date("last_seen") >= d)
    years = F.array_distinct(F.transform(F.filter("filed", inside), lambda d: F.year(d).cast("long")))
    seen = cells.select(*by, "n", "cik", "first_seen", "last_seen").join(parents, "cik").select(*by, "n", F.explode(years).alias("year"))
    filed = filings.select(*by, "cik", F.year("fdate").cast("long").alias("year")).distinct()
    parts = [
        by_child,
        seen.groupBy(*by, F.lit("seen").alias("report"), F.col("year").cast("string").alias("k")).agg(F.sum("n").alias("n")),
        filed.groupBy(*by, F.lit("filing").alias("report"), F.col("year").cast("string").alias("k")).agg(F.count("*").alias("n")),
        cells.groupBy(*by, "cik").agg(F.sum("n").alias("c")).groupBy(*by, F.lit("sizes").alias("report"), _sized(F.col("c")).alias("k")).agg(F.count("*").alias("n")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("n", F.col("n") * sign)


def summed(*counts: DataFrame) -> DataFrame:
    """Counts of equal reports and keys added up; what is zero goes."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("report", "k").agg(F.sum("n").alias("n")).where("n <> 0")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with ``sign``: those taken back (-1) and those added (+1); equal rows cancel out."""
    names = before.columns
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.select(*names).withColumn("sign", F.lit(1)))
    return both.groupBy(*names).agg(F.sum("sign").alias("sign")).where("sign <> 0")


class Maintained:
    """A panel and its reports in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        files, path = self._path(f"{name}/_SUCCESS")
        return files.exists(path)

    def _drop(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def batches(self) -> list[int]:
        """Numbers of batches whose counts are whole."""
        files, path = self._path("counts")
        found = [int(s.getPath().getName().rpartition("=")[2]) for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if self._there(f"counts/batch={n}"))

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """``kids``, ``subs`` or ``parts``, or the partitions of it that are asked for; None before the first batch."""
        files, path = self._path(name)
        if not files.exists(path):
            return None
        rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def counts(self) -> DataFrame:
        """report, k, n after the last whole batch."""
        return self.spark.read.schema(COUNTS).parquet(f"{self.folder}/counts/batch={self.batches()[-1]}")

    def apply(self, batch: int, new: DataFrame) -> None:
        """Take in observations; batches are numbered in order from 0."""
        if batch not in self.batches():
            self.take(batch, stored(presence(observations(new))))

    def take(self, batch: int, kids: DataFrame) -> None:
        """:meth:`apply` of a stored presence table."""
        if batch in self.batches():
            return
        staged = f"staged/batch={batch}"
        if partitions.finished(self.spark, f"{self.folder}/{staged}") is None:
            self._stage(staged, kids)
        self._publish(staged, batch)

    def _stage(self, staged: str, kids: DataFrame) -> None:
        folder, bucket = f"{self.folder}/{staged}", partitions.bucket_of(self.buckets)
        kids = kids.withColumn("bucket", bucket)
        touched = partitions.sizes(kids)
        read = lambda name: self.spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
        if touched:
            held = None if self.table("kids") is None else self.spark.read.schema(KIDS).parquet(f"{self.folder}/kids")
            partitions.write(partitions.merged(held, kids, touched), f"{folder}/kids")
            after = read("kids")
            filings = stored(all_filings(after))
            partitions.write(timeline_of(after, filings).withColumn("bucket", bucket), f"{folder}/subs")
            partitions.write(contributions(read("subs"), filings.withColumn("bucket", bucket), by=("bucket",)).repartition("bucket"), f"{folder}/parts")
            difference, before = read("parts").drop("bucket"), self.table("parts", list(touched))
            if before is not None:
                difference = difference.unionByName(before.withColumn("n", -F.col("n")))
            forget(filings)
        else:
            difference = self.spark.createDataFrame([], COUNTS)
        summed(difference).write.mode("overwrite").parquet(f"{folder}/difference")
        partitions.finish(self.spark, folder, partitions.listed(self.spark, folder, *TABLES))

    def _publish(self, staged: str, batch: int) -> None:
        folder = f"{self.folder}/{staged}"
        for name, files in partitions.finished(self.spark, folder).items():
            partitions.replace(self.spark, f"{folder}/{name}", f"{self.folder}/{name}", files)
        difference = self.spark.read.schema(COUNTS).parquet(f"{folder}/difference")
        before = self.batches()
        counts = summed(self.counts(), difference) if before else difference
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")
        for old in before[:-1]:  # the one before stays for those who read it now
            self._drop(f"counts/batch={old}")
        self._drop(staged)
