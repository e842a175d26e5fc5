"""What the corpus operators share: the shared folder, written tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/strandline"
#: Bits of the bitmap of :func:`maybe_in` (2 MB).
FILTER_BITS = 1 << 24
#: Rows with whole texts in one batch.
BATCH_TEXTS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = LOCAL_CHECKPOINTS
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let whole texts go to Python a few at a time: a batch lives in the executor's and the worker's memory at once, several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_TEXTS:
        spark.conf.set(name, str(BATCH_TEXTS))


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    Unlike a cache, the files survive the loss of any executor.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a :func:`written` table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shape(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free digest of two-long-column edges."""
    got = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return got["n"], got["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    ``edges`` has two columns of one sortable type; rows are undirected links,
    self links and nulls are ignored.  Returns ``node, component`` for every
    node that has a link, ``component`` the smallest node reachable.  Each round
    is two grouped minima (combined before their shuffle) and two equi-joins on
    small rows, and ends in a table written to the shared folder, after which the
    round's own input is deleted.  The minima are written before they are joined,
    so that adaptive execution knows their size and can split a hub's rows.  Rounds
    end when the links no longer change, after about the logarithm of the longest
    path.  An empty input gives an empty result.
    """
    a, b = edges.columns[:2]
    cur = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    cur = written(cur)
    seen = shape(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        large = written(large)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        before, cur = cur, written(small)
        now = shape(cur)
        for done in (before, low, large, least):
            forget(done)
        if now == seen:
            break
        seen = now
    stars = cur.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def values(column: pa.Array, size: int = 256) -> Iterator:
    """The column's values as Python objects, a slice of rows at a time, so that a batch isn't held twice."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


def lower_ascii(col: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tiled(filed: DataFrame, tile: int, counts: DataFrame | None = None) -> DataFrame:
    """Deal rows ``key, id, ...`` that share a key (a long) to tasks that compare them.

    Keys of one row are dropped, most before the shuffle.  Keys of up to ``tile`` rows are one unit; larger
    ones are cut into tiles by hashed id, and each pair of tiles is a unit, so no
    unit holds more than about two tiles.  Adds ``t, u`` (the unit within the key)
    and ``side`` (0: compare all, 1 and 2: compare with the other side only), and
    partitions and sorts by key, t, u.  ``counts`` has key, n (rows of a key) where
    they are known, so that costly rows are made once.
    """
    rest = [c for c in filed.columns if c != "key"]
    counts = filed.groupBy("key").agg(F.count("*").alias("n")) if counts is None else counts
    # Written, so that adaptive execution can split a hot key's rows in the join.
    sizes = written(counts.where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    filed = maybe_in(filed, sizes, "key").join(sizes, "key")
    mine = F.pmod(F.xxhash64("id", "key"), F.col("tiles")).cast("int")
    zero = F.lit(0)
    one = filed.where("tiles = 1").select("key", zero.alias("t"), zero.alias("u"), zero.alias("side"), *rest)
    many = (
        filed.where("tiles > 1")
        .select("key", mine.alias("m"), F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("o"), *rest)
        .select("key", F.least("m", "o").alias("t"), F.greatest("m", "o").alias("u"), F.when(F.col("m") == F.col("o"), 0).when(F.col("m") < F.col("o"), 1).otherwise(2).alias("side"), *rest)
    )
    # A fixed number of tasks: units take long for their bytes, by which adaptive execution would put many in one task.
    tasks = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.unionByName(many).repartition(tasks, "key", "t", "u").sortWithinPartitions("key", "t", "u")


def with_maybe(rows: DataFrame, ids: DataFrame, on: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only if the long column ``on`` surely isn't among those of ``ids``.

    A test against a broadcast bitmap of hashed ids, of fixed size.
    """
    spot = F.pmod(F.xxhash64(on), F.lit(FILTER_BITS)) + 1
    bits = (
        ids.select(spot.alias("__spot"))
        .groupBy(F.bitmap_bucket_number("__spot").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__spot")).alias("__bits"))
    )
    rows = rows.withColumn("__spot", spot)
    # At most FILTER_BITS / 32768 rows of 4 KB.
    rows = rows.join(F.broadcast(bits), F.bitmap_bucket_number("__spot") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__spot")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("__byte", byte).withColumn("__pos", (at % 8).cast("int"))
    return rows.withColumn(flag, F.expr("coalesce((shiftright(__byte, __pos) & 1) = 1, false)")).drop("__byte", "__pos", "__spot", "__bucket", "__bits")


def maybe_in(rows: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose long column ``on`` may be among those of ``ids``; some others pass, none is lost.

    It keeps most other rows out of the shuffle of the exact join that follows.
    """
    return with_maybe(rows, ids, on, "__maybe").where("__maybe").drop("__maybe")
