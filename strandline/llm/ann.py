"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``floor((a . x + b) / w)`` for several Gaussian
directions.  A query visits its own bucket and perturbed ones, in the order of
their estimated success: the perturbations (a direction, up or down) are ranked by
the squared distance to the boundary they cross, and sets of ranks are visited by
the expected sum of those squares, which depends on the number of directions alone.
Buckets of all tables are merged and candidates ranked by exact distance.

Equal vectors are one representative with its ``k + 1`` smallest ids, so a vector
that a third of all rows share costs as much as any other.  Buckets with more than
``BUCKET`` representatives are dealt into parts, and queries go to each part.

Fitting: ``SAMPLE`` query vectors are searched exactly; number of directions, width
and number of probes are those of least estimated work whose estimated recall of
these neighbours is ``RECALL``.  Every vector is indexed.  Queries for which the
buckets gave too few neighbours are searched exactly, in blocks.

Defined results: rows whose vector is null, empty, all zero, or holds a null or
non-finite component, and rows without an id, take no part, as query or candidate;
only vectors of equal length are compared; repeated rows count once; rows that
repeat an id with different vectors are candidates each, never for their own id;
ties go to the smaller id; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

K = 10
TABLES = 6
RECALL = 0.985
#: Query vectors (and as many others) searched exactly to fit the index.
SAMPLE = 64
#: Representatives of one bucket held by a task.
BUCKET = 4096
SEED = 11


def probe_sets(directions: int, most: int) -> list[list[int]]:
    """The first ``most`` sets of perturbation ranks (from 0) in order of expected score; the empty one first.

    Rank j and rank 2m - 1 - j are the two boundaries of one direction and exclude each other.
    """
    m = directions
    j = np.arange(1, 2 * m + 1, dtype=np.float64)
    r = 2 * m + 1 - j
    expected = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - r / (m + 1) + r * (r + 1) / (4 * (m + 1) * (m + 2)))

    def ordered() -> Iterator[list[int]]:
        yield []
        heap = [(expected[0], (0,))]
        while heap:
            score, ranks = heapq.heappop(heap)
            if all(2 * m - 1 - x not in ranks for x in ranks):
                yield list(ranks)
            last = ranks[-1] + 1
            if last < 2 * m:
                heapq.heappush(heap, (score + expected[last], (*ranks, last)))
                heapq.heappush(heap, (score - expected[ranks[-1]] + expected[last], (*ranks[:-1], last)))

    return list(islice(ordered(), most))


def deltas(fractions: np.ndarray, sets: list[list[int]]) -> np.ndarray:
    """For each row of positions within the bucket (0 to 1), the perturbation of each direction by each set: rows x sets x directions."""
    n, m = fractions.shape
    order = np.argsort(np.concatenate([fractions, 1 - fractions], axis=1) ** 2, axis=1, kind="stable")
    out = np.zeros((n, len(sets), m), dtype=np.int64)
    rows = np.arange(n)
    for k, ranks in enumerate(sets):
        for x in ranks:
            which = order[:, x]
            out[rows, k, which % m] = np.where(which < m, -1, 1)
    return out


class Hashes:
    """Directions and offsets of all tables, drawn from the seed for each vector length."""

    def __init__(self, directions: int, width: float, probes: int, tables: int = TABLES):
        self.m, self.width, self.tables = directions, width, tables
        self.sets = probe_sets(directions, probes)
        self._drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in self._drawn:
            rng = np.random.default_rng([SEED, dim])
            self._drawn[dim] = rng.standard_normal((dim, self.tables * self.m)), rng.random(self.tables * self.m)
        return self._drawn[dim]

    def _key(self, cells: np.ndarray, table: int, dim: int) -> np.ndarray:
        h = np.full(cells.shape[:-1], (table << 20) + dim, dtype=np.uint64)
        for k in range(self.m):
            h = (h ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def keys(self, x: np.ndarray, probing: bool) -> np.ndarray:
        """Bucket keys: rows x tables, or rows x (tables * probes) for queries."""
        directions, offsets = self._of(x.shape[1])
        at = x @ directions / self.width + offsets
        cells = np.floor(at).astype(np.int64)
        out = []
        for t in range(self.tables):
            span = slice(t * self.m, (t + 1) * self.m)
            mine = cells[:, None, span]
            if probing:
                mine = mine + deltas(at[:, span] - cells[:, span], self.sets)
            out.append(self._key(mine, t, x.shape[1]))
        return np.concatenate(out, axis=1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _filed(reps: DataFrame, hashes: Hashes, probing: bool) -> DataFrame:
    """key, id, v: a row for every bucket of a vector."""
    shared = reps.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes = part.column(1).value_lengths().to_numpy()
                for dim in np.unique(sizes):
                    pick = np.flatnonzero(sizes == dim)
                    sub = part.take(pa.array(pick))
                    keys = shared.value.keys(_matrix(sub.column(1), int(dim)), probing)
                    row = np.repeat(np.arange(len(pick)), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), sub.column(0).take(pa.array(row)), sub.column(1).take(pa.array(row))], names=["key", "id", "v"])

    return reps.select("id", "v").mapInArrow(run, "key long, id long, v array<double>")


def _nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score: for each query and bucket the ``k`` nearest representatives in it; sides are key, id, v."""
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    # Written, so that adaptive execution can split a hot bucket's rows in the joins.
    sizes = written(sizes.select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = index.join(sizes, "key", "left").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("side"), "id", "v")
    right = queries.join(sizes, "key", "left").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("side"), "id", "v")
    both = left.unionByName(right).repartition("key", "part").sortWithinPartitions("key", "part", "side")

    def top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray) -> tuple[list, list, list]:
        # From a point of the bucket, so that a large common offset doesn't drown the distances.
        a, b = q - x[0], x - x[0]
        rough = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
        short = min(2 * k + 16, len(x))  # more than is kept, so that rounding of the rough form doesn't matter
        pick = np.argpartition(rough, short - 1, axis=1)[:, :short]
        exact = np.sqrt(((x[pick] - q[:, None, :]) ** 2).sum(axis=2))
        best = np.lexsort((xid[pick], exact), axis=1)[:, :k]
        return np.repeat(qid, best.shape[1]), np.take_along_axis(xid[pick], best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_x, held_id = None, [], []  # the bucket part that is being read and its representatives
        for batch in batches:
            key, part, side, ids = (batch.column(c).to_numpy() for c in range(4))
            new = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)))
            for lo, hi in zip(new, np.append(new[1:], len(key)), strict=True):
                if at != (key[lo], part[lo]):
                    at, held_x, held_id = (key[lo], part[lo]), [], []
                sub = batch.column(4).slice(lo, hi - lo)
                dim = len(sub[0])
                x = _matrix(sub, dim)
                if side[lo] == 0:
                    held_x.append(x)
                    held_id.append(ids[lo:hi])
                elif held_x:
                    held_x, held_id = [np.concatenate(held_x)], [np.concatenate(held_id)]
                    for a in range(0, len(x), 64):
                        q, i, d = top(x[a : a + 64], ids[lo + a : lo + min(a + 64, hi - lo)], held_x[0], held_id[0])
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d)], names=["query", "id", "score"])

    return both.mapInArrow(run, "query long, id long, score double")


def _blocks(reps: DataFrame, n: int) -> tuple[Column, Column, int]:
    """Keys of an exact search in blocks: the block of a representative, all blocks of a query."""
    blocks = max(1, -(-n // BUCKET))
    dim = F.size("v")
    return F.pmod(F.xxhash64("id"), F.lit(blocks)) * 100_000 + dim, F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * F.lit(100_000).cast("long") + dim), blocks


def _exact(reps: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    one, every, _ = _blocks(reps, n)
    return _nearest(reps.select(one.alias("key"), "id", "v"), queries.select(F.explode(every).alias("key"), "id", "v"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return found.dropDuplicates(["query", "id"]).withColumn("rank", rank).where(F.col("rank") <= k)


def fit(reps: DataFrame, n: int, k: int = K, tables: int = TABLES, recall: float = RECALL) -> Hashes:
    """Choose directions, width and probes from an exact search of a sample."""
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    sample = reps.orderBy(order, "id").limit(2 * SAMPLE).select("id", "v").collect()
    size = max((len(r["v"]) for r in sample), key=[len(r["v"]) for r in sample].count)
    rows = [r for r in sample if len(r["v"]) == size]
    ids = [r["id"] for r in rows[:SAMPLE]]
    near = [r["score"] for r in _best(_exact(reps, reps.where(F.col("id").isin(ids)), n, k + 1), k + 1).where("query <> id").collect()]
    x = np.array([r["v"] for r in rows])
    far = np.sqrt(((x[:SAMPLE, None] - x[None, -SAMPLE:]) ** 2).sum(2))
    far = np.sort(far[far > 0])[:: max(1, far.size // 512)]
    near = np.sort(np.array(near))[:: max(1, len(near) // 512)]
    if not len(near) or not len(far):
        return Hashes(2, 1.0, 9, tables)
    rng = np.random.default_rng(SEED)
    unit = float(np.median(near)) or float(np.median(far))
    best = None
    for m in (4, 6, 8, 10, 12, 14, 16):
        sets = probe_sets(m, 400)
        for width in (0.75, 1.0, 1.5, 2.0, 3.0):
            w = unit * width
            hit = []
            for d in (near, far):
                frac = rng.random((len(d), m))
                step = np.floor(frac + rng.standard_normal((len(d), m)) * d[:, None] / w).astype(np.int64)
                same = (deltas(frac, sets) == step[:, None, :]).all(axis=2)
                hit.append(same.mean(axis=0).cumsum())  # share reached by the first 1, 2, ... probes of one table
            reached, touched = (1 - (1 - h) ** tables for h in hit)
            enough = np.flatnonzero(reached >= recall)
            if len(enough):
                p = int(enough[0]) + 1
                work = touched[p - 1] * n + 20.0 * p * tables
                if best is None or work < best[0]:
                    best = work, m, w, p
    return Hashes(best[1], best[2], best[3], tables) if best else Hashes(2, 3 * unit, 9, tables)


def search(vectors: DataFrame, queries: Column, k: int = K, column: str = "embedding", tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``queries`` (over vec_id) holds."""
    v = F.col("v")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    # Of each vector the k + 1 smallest ids; the rank limit is applied before the shuffle as well.
    small = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    reps = small.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("r").alias("r"))
    reps = written(reps.select(F.xxhash64("v").alias("id"), "v", "ids"))
    asking = written(rows.where(queries).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("id")))
    n = reps.count()
    if n == 0 or asking.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashes = fit(reps, n, k, tables, recall)
    asked = reps.join(asking.select("id").distinct(), "id", "left_semi")
    found = written(_best(_nearest(_filed(reps, hashes, False), _filed(asked, hashes, True), k + 1), k + 1))
    # Enough: k + 1 ids with the query's own, or all there are.
    have = found.join(reps.select("id", F.size("ids").alias("n")), "id").groupBy("query").agg(F.sum("n").alias("n"))
    short = asked.join(have.where(F.col("n") > k), F.col("id") == F.col("query"), "left_anti")
    short = written(short.select("id", "v"))
    if not short.isEmpty():
        found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(_best(_exact(reps, short, n, k + 1), k + 1))
    named = found.join(reps.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = asking.join(named, asking["id"] == named["query"]).where("vec_id <> query_id").dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 100."""
    return search(vectors, F.col("vec_id") % 100 == 0)
