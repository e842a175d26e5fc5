"""Tables that cut a plan: written once to the folder all executors share, then read by whoever needs them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL = "/tmp/checkpoints/strandline-panel"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or LOCAL
    return f"{base.rstrip('/')}/panel-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written and read back; unlike a cache the files survive the loss of any executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def forget(*tables: DataFrame) -> None:
    """Delete the files of :func:`stored` tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
