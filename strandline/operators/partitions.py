"""Tables in partitions of hashed parents: children are merged into the partitions they touch, and new partitions take the place of old ones.

A partition is written once, where nobody reads it, and its files are then moved.  New files come before
old ones go and have names of their own, so that a move that breaks off is repeated with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIDS = "cik string, sub_norm string, sub_name string, comp_name string, dates array<date>, bucket int"
#: Rows of one file of a bucket: large buckets are several files, written by several tasks.
FILE_ROWS = 2_000_000


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cik"), F.lit(buckets)).cast("int")


def sizes(rows: DataFrame) -> dict[int, int]:
    """Rows of each bucket: at most one number a bucket."""
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def merged(held: DataFrame | None, new: DataFrame, touched: dict[int, int], file_rows: int = FILE_ROWS) -> DataFrame:
    """The children of the buckets that ``new`` touches, those that ``held`` has there among them; both have ``bucket``.

    All rows are dealt once, by bucket and child, and stay where they are until they are written; the order
    of the aggregation is that of the partitions.  Neither ``held`` nor ``new`` has a child twice; ``touched`` are :func:`sizes` of ``new``.
    """
    names, most = ["bucket", "cik", "sub_norm", "sub_name", "comp_name"], max(touched.values())
    rows = new.select(*names, "dates")
    if held is not None:
        held = held.where(F.col("bucket").isin(list(touched)))
        before = sizes(held)
        most = max(n + before.get(b, 0) for b, n in touched.items())
        none = F.lit(None).cast("array<date>")
        rows = new.select(*names, "dates", none.alias("old")).unionByName(held.select(*names, none.alias("dates"), F.col("dates").alias("old")))
    parts = -(-most // file_rows)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cik", "sub_norm"), F.lit(parts)).cast("int")).repartition(len(touched) * parts, "bucket", "part")
    if held is None:
        return rows.drop("part")
    rows = rows.groupBy("bucket", "part", "cik", "sub_norm").agg(*(F.min(c).alias(c) for c in names[3:]), F.max("dates").alias("dates"), F.max("old").alias("old"))
    both = F.when(F.col("old").isNull(), F.col("dates")).when(F.col("dates").isNull(), F.col("old")).otherwise(F.sort_array(F.array_union("dates", "old")))
    return rows.select(*names, both.alias("dates"))


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def listed(spark: SparkSession, folder: str, *tables: str) -> list[tuple[str, str, str]]:
    """Table, partition and name of the files of tables that :func:`write` wrote."""
    found = ((t, b, f) for t in tables for b in _names(spark, f"{folder}/{t}") if b.startswith("bucket=") for f in _names(spark, f"{folder}/{t}/{b}"))
    return [x for x in found if x[2].startswith("part-")]


def finish(spark: SparkSession, folder: str, files: list[tuple[str, str, str]]) -> None:
    """Say that the tables below ``folder`` are whole, with the files (table, partition, name) they consist of: a row a file."""
    spark.createDataFrame(files, "name string, bucket string, file string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done")


def finished(spark: SparkSession, folder: str) -> dict[str, dict[str, list[str]]] | None:
    """Files by table and partition of tables that are whole; None of others."""
    if "_SUCCESS" not in _names(spark, f"{folder}/done"):
        return None
    out: dict[str, dict[str, list[str]]] = {}
    for r in spark.read.parquet(f"{folder}/done").collect():
        out.setdefault(r["name"], {}).setdefault(r["bucket"], []).append(r["file"])
    return out


def drop(spark: SparkSession, folder: str) -> None:
    files, path = _files(spark, folder)
    files.delete(path, True)


def replace(spark: SparkSession, source: str, target: str, files: dict[str, list[str]]) -> None:
    """Put the partitions of ``source``, whose ``files`` are by partition, in the place of those of ``target``; may be repeated."""
    at = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    system, _ = _files(spark, target)
    for bucket, names in files.items():
        system.mkdirs(at(f"{target}/{bucket}"))
        for name in names:
            old, new = at(f"{source}/{bucket}/{name}"), at(f"{target}/{bucket}/{name}")
            if system.exists(old):
                system.delete(new, False)
                if not system.rename(old, new):
                    raise OSError(f"{old} can't be moved to {new}")
        for name in set(_names(spark, f"{target}/{bucket}")) - set(names):
            system.delete(at(f"{target}/{bucket}/{name}"), False)
