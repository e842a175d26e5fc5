"""Landed pages as a stream source with offsets of its own.

Pages land as Parquet files in a folder a parent (``parent=...``).  Parents are taken in the
order of their names, so many to a batch, and the offset is the last name taken: a run
that is stopped, or breaks off, goes on with the parent after it.  What the query has
already planned is read from its own log of offsets when it starts again.  Parents that
land under a name before the offset belong to a new stream, as with any queue.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from strandline.sources.sas import opened

PAGES = "parent string, page_id long, html string"
#: Parents of a batch, and of one task of it.
BATCH, TASK = 50, 8


def parents_of(path: str) -> list[str]:
    """Names of the folders of parents, in order."""
    system, inner = opened(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return []
    found = (i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.Directory)
    return sorted(n for n in found if n.startswith("parent="))


def planned(checkpoint: str) -> str:
    """The last offset that a query has written to its log, or none."""
    system, inner = opened(checkpoint)
    folder = f"{inner}/offsets"
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return ""
    numbers = [int(i.base_name) for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.isdigit()]
    for number in sorted(numbers, reverse=True):
        with system.open_input_stream(f"{folder}/{number}") as file:
            lines = file.read().decode("utf-8").split("\n")
        for line in lines[2:]:
            if line.startswith("{"):
                return json.loads(line).get("last", "")
    return ""


class _Parents(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, batch: int, checkpoint: str):
        self.path, self.batch = path, batch
        self.at = planned(checkpoint) if checkpoint else ""

    def initialOffset(self) -> dict:  # noqa: N802  the interface's names
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        waiting = [n for n in parents_of(self.path) if n > self.at][: self.batch]
        return {"last": waiting[-1] if waiting else self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["last"])
        names = [n for n in parents_of(self.path) if start["last"] < n <= end["last"]]
        return [_Parents(names[k : k + TASK]) for k in range(0, len(names), TASK)]

    def read(self, partition: _Parents) -> Iterator[pa.RecordBatch]:
        system, inner = opened(self.path)
        for name in partition.names:
            parent = unquote(name.partition("=")[2])
            for info in sorted(system.get_file_info(fs.FileSelector(f"{inner}/{name}")), key=lambda i: i.base_name):
                if not info.base_name.endswith(".parquet"):
                    continue
                with system.open_input_file(info.path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(batch_size=256, columns=["page_id", "html"]):
                        who = pa.array([parent] * batch.num_rows, pa.string())
                        yield pa.RecordBatch.from_arrays([who, batch.column("page_id").cast(pa.int64()), batch.column("html").cast(pa.string())], names=["parent", "page_id", "html"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LandedPages(DataSource):
    """The data source ``landed_pages``; options ``path``, ``parents`` (of a batch) and ``checkpoint`` (the query's)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"], int(self.options.get("parents", BATCH)), self.options.get("checkpoint", ""))


def landed(spark: SparkSession, path: str, checkpoint: str, parents: int = BATCH) -> DataFrame:
    """A stream of parent, page_id, html for a query that keeps its state in ``checkpoint``."""
    spark.dataSource.register(LandedPages)
    return spark.readStream.format("landed_pages").option("checkpoint", checkpoint).option("parents", parents).load(path)


def land(pages: DataFrame, path: str) -> None:
    """Write pages (parent, page_id, html) as the source reads them: a folder a parent."""
    pages.select("parent", "page_id", "html").repartition("parent").write.mode("append").partitionBy("parent").parquet(path)
