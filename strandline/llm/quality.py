"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of the target
text (labelled good) and one of the raw text (every document), give each n-gram
the log of its target-to-raw ratio.  A document's log weight is the sum over its
n-grams, the log of the ratio of the two models' likelihoods.  Documents are drawn
without replacement by Gumbel top-k: the k largest of log weight plus Gumbel noise
(from the id, so a rerun draws the same).

``k`` is the number of eligible documents whose log weight is at least ``ACCEPT``:
the draw is as large as the part of the corpus that looks like target text.

One rule stands apart from the weight, as a few words can make a long document
unfit: the worst stretch of ``STRETCH`` n-grams, the sum of what their ratios lie
below ``TAIL``, must be at least ``WORST``.  A stretch has the same size in every
document, so none is rejected for its length, and these ratios are shrunk
(``TAIL_SMOOTHING``), as a bucket of which little is expected in target text tells
nothing by being empty.  Documents that break the rule aren't eligible for the draw.

Each n-gram is counted under two hash functions and takes the larger ratio, so a
harmless n-gram suffers only if both its buckets are bad.

Bounds: the target model is fitted on at most ``MAX_TARGET`` labelled documents
(those with the smallest hashed ids); the raw model and the scores cover all
documents.  The broadcast model is 4 x 2 ** ``BITS`` doubles.

Defined results: null texts and texts without words have a null weight and are never
drawn; a null id hashes as such and can't be a target; of several labels of a document
one good label is enough unless another calls it bad; without target documents every
ratio is 0 and all documents with words are drawn; equal keys are ordered by id and rows
equal in both are drawn together; repeated rows count each; a very long text is counted
and scored whole by one task; further columns are
kept by :func:`keep`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import values, written

BITS = 16
MAX_TARGET = 20_000
ACCEPT = -3.0
STRETCH = 200
TAIL = -0.4
WORST = -2.0
SMOOTHING = 1.0
TAIL_SMOOTHING = 8.0
SEED = 17

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = 2
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets (one row for each hash function) of the words and pairs of words of a text."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    one = np.fromiter(map(zlib.crc32, ws), dtype=np.uint64, count=len(ws)) + np.uint64(1)
    grams = np.concatenate([one, one[:-1] * _MIX[2] + one[1:] * _MIX[3]]) if len(one) else one
    out = np.empty((_ROWS, len(grams)), dtype=np.int64)
    for k in range(_ROWS):
        h = (grams ^ (grams >> np.uint64(32))) * _MIX[k]
        h ^= h >> np.uint64(31)
        out[k] = (h * _MIX[k]) >> np.uint64(64 - bits)
    return out


def targets(labels: DataFrame, most: int = MAX_TARGET) -> DataFrame:
    """At most ``most`` ids of documents labelled good and never bad."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 AND coalesce(t, 0) = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").cast("long").alias("__target"))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, most: int = MAX_TARGET) -> np.ndarray:
    """Log ratio of target to raw by hash function and bucket."""
    return models(docs, labels, bits, most)[0]


def models(docs: DataFrame, labels: DataFrame, bits: int = BITS, most: int = MAX_TARGET) -> np.ndarray:
    """Log ratios of target to raw by smoothing (of the weight, of the worst stretch), hash function and bucket."""
    size = 1 << bits
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The target ids are bounded by ``most``.
    flagged = rows.join(F.broadcast(targets(labels, most)), F.col("doc_id") == F.col("__target"), "left").select("text", F.col("__target").isNotNull().alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _ROWS, size), dtype=np.int64)
        for batch in batches:
            for text, target in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                got = buckets(text, bits)
                for k in range(_ROWS):
                    n = np.bincount(got[k], minlength=size) if got.shape[1] * 8 > size else None
                    for model in (0, 1) if target else (0,):
                        if n is None:
                            np.add.at(sums[model, k], got[k], 1)
                        else:
                            sums[model, k] += n
        flat = sums.reshape(-1)
        used = np.flatnonzero(flat)
        for at in range(0, len(used), 50_000):
            some = used[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["cell", "n"])

    totals = flagged.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(2 * _ROWS * size)
    for batch in totals.toArrow().to_batches():  # at most one row a cell of the model
        flat[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    raw, target = flat.reshape(2, _ROWS, size)
    if not target.any():
        return np.zeros((2, _ROWS, size))
    share = raw / max(raw[0].sum(), 1)
    # Smoothed towards the raw model, so that what target text can't tell counts nothing.
    scale = target[0].sum()
    return np.stack([np.log((target + s) / (share * scale + s)) for s in (SMOOTHING, TAIL_SMOOTHING)])


def weights_of(got: np.ndarray, ratios: np.ndarray) -> tuple[float | None, float]:
    """Log weight and worst stretch of a document with these buckets."""
    if not got.shape[1]:
        return None, 0.0
    ratio, shrunk = (np.maximum(table[0][got[0]], table[1][got[1]]) for table in ratios)
    stretches = np.add.reduceat(np.minimum(shrunk - TAIL, 0), np.arange(0, got.shape[1], STRETCH))
    return float(ratio.sum()), float(stretches.min())


def scored(docs: DataFrame, ratios: np.ndarray, bits: int = BITS) -> DataFrame:
    """``doc_id, text`` and ``row`` (a struct of anything) with log_weight, worst_stretch and gumbel_key instead of text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kept = [f for f in docs.schema if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", log_weight double, worst_stretch double"
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [weights_of(buckets(t, bits), shared.value) for t in values(batch.column(at))]
            cols = [pa.array([g[k] for g in got], pa.float64()) for k in (0, 1)]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, *cols], names=[*(f.name for f in kept), "log_weight", "worst_stretch"])

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.mapInArrow(run, ddl).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def drawn(scores: DataFrame, accept: float = ACCEPT, worst: float = WORST) -> DataFrame:
    """``scores`` (read three times, so written before) with selected: whether the row is among the k largest keys of eligible rows.

    The k-th key comes from a range partitioning by key and the row counts of its
    partitions; no task sees all rows, and the driver one row.
    """
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    eligible = F.col("log_weight").isNotNull() & (F.col("worst_stretch") >= worst)
    keys = scores.where(eligible).select("gumbel_key", last.alias("tie"), (F.col("log_weight") >= accept).cast("long").alias("like"))
    k = keys.agg(F.sum("like")).first()[0]
    if not k:
        return scores.withColumn("selected", F.lit(False))
    order = [F.col("gumbel_key").desc(), F.col("tie").asc()]
    placed = written(keys.select("gumbel_key", "tie").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one small row a partition
    before = sizes.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    part, ahead = before.where((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select("part", "before").first()
    cut = placed.where(F.col("part") == part).select("*", F.row_number().over(Window.partitionBy("part").orderBy(*order)).alias("rank"))
    key, tie = cut.where(F.col("rank") == k - ahead).select("gumbel_key", "tie").first()
    ahead_of = (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & (last <= tie))
    return scores.withColumn("selected", F.coalesce(eligible & ahead_of, F.lit(False)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, worst_stretch, gumbel_key, selected: one row a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return drawn(written(scored(rows, models(docs, labels))))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, all columns kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return drawn(written(scored(rows, models(docs, labels)))).where("selected").select("row.*")
