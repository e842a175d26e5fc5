"""New filings as a stream: landed observations or documents into a panel kept by parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators import partitions
from strandline.operators.documents import entities
from strandline.operators.timeline import all_filings, presence, rollup_of, timeline_of
from strandline.sources.panel import OBSERVATION, observations
from strandline.store import forget, stored, there

#: Parents are kept in so many partitions by hash unless the panel says otherwise; a batch rewrites those it touches.
BUCKETS = 64
#: Rows of one file of a bucket: large buckets are several files, written by several tasks.
FILE_ROWS = partitions.FILE_ROWS
TABLES = ("observations", "children", "companies")


def buckets_of(spark: SparkSession, folder: str, wanted: int = BUCKETS) -> int:
    """Number of buckets of a panel: a property stored with it, set when it is first written."""
    if not there(spark, f"{folder}/_buckets"):
        spark.createDataFrame([(wanted,)], "buckets int").coalesce(1).write.parquet(f"{folder}/_buckets")
    return spark.read.parquet(f"{folder}/_buckets").first()["buckets"]


def merge_batch(spark: SparkSession, folder: str, new: DataFrame, buckets: int = BUCKETS) -> None:
    """Merge a batch of observations into ``folder``: observations (a row a child with its dates), children and companies of the partitions it touches are rewritten.

    Spans are minima and maxima, so late filings need no watermark, and a batch that
    is run twice changes nothing.  ``buckets`` counts for a new panel; an old one keeps its own.
    """
    bucket, staged = partitions.bucket_of(buckets_of(spark, folder, buckets)), f"{folder}/_staged"
    publish(spark, folder)  # what a run before left half way
    new = stored(presence(observations(new)).withColumn("bucket", bucket))
    touched = partitions.sizes(new)
    if not touched:
        return
    path, read = f"{folder}/observations", spark.read.schema(partitions.KIDS)
    partitions.write(partitions.merged(read.parquet(path) if there(spark, path) else None, new, touched, FILE_ROWS), f"{staged}/observations")
    kids = read.parquet(f"{staged}/observations")
    dates = stored(all_filings(kids))
    partitions.write(timeline_of(kids, dates).withColumn("bucket", bucket), f"{staged}/children")
    partitions.write(rollup_of(kids, dates).withColumn("bucket", bucket).repartition("bucket"), f"{staged}/companies")
    partitions.finish(spark, staged, partitions.listed(spark, staged, *TABLES))
    publish(spark, folder)
    forget(new, dates)


def publish(spark: SparkSession, folder: str) -> None:
    """Move the partitions of a batch that is whole into the panel; once more, where a run broke off."""
    staged = f"{folder}/_staged"
    files = partitions.finished(spark, staged)
    if files is not None:
        for name in TABLES:
            partitions.replace(spark, f"{staged}/{name}", f"{folder}/{name}", files.get(name, {}))
        partitions.drop(spark, staged)


def ingest(spark: SparkSession, landing: str, folder: str, checkpoint: str, files: int = 50, every: str | None = None) -> StreamingQuery:
    """Start the stream of landed observation files (Parquet); without ``every`` it takes what is there and ends."""
    stream = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files).parquet(landing)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge_batch(df.sparkSession, folder, df))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_documents(spark: SparkSession, landing: str, folder: str, checkpoint: str, files: int = 50) -> StreamingQuery:
    """Like :func:`ingest` from documents (cik, fdate, comp_name, content), parsed on the way."""
    stream = spark.readStream.schema("cik string, fdate date, comp_name string, content string").option("maxFilesPerTrigger", files).parquet(landing)

    def batch(df: DataFrame, _: int) -> None:
        keyed = df.withColumn("doc", F.struct("cik", "fdate", "comp_name"))
        rows = entities(keyed, "content", "doc").select("doc.*", "sub_name")
        merge_batch(df.sparkSession, folder, rows)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
