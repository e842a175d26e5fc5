"""SimHash near-duplicates with a bit-sliced comparison.

Every document gets a 64-bit fingerprint of its three-word shingles.  Equal
fingerprints are one row from then on.  Fingerprints within the radius agree on
two at least of five blocks of bits, so each is filed under its ten pairs of
blocks; whoever shares a file is compared.  The comparison keeps the bit planes
vertically: for thousands of candidate pairs at once the XOR of one plane is added
to carry-save counters (a few bitwise operations on packed words), and a block of
pairs is abandoned when all its counters have passed the radius.  A file with more
than ``TILE`` fingerprints is dealt into tiles, a task for each pair of tiles.
Tasks return links that span what they found, not all pairs; components follow.

Defined results: a null text or one without words has fingerprint zero, linked
like any other; rows with a null ``doc_id`` get their fingerprint and their
group's smallest id (null if no row of the group has one); reports have a row for
every row, and rows that repeat an id are linked only by what their texts say;
an empty table gives an empty result; a very long text is hashed whole by one task,
from then on it is 64 bits like any other; further columns are ignored by
:func:`fingerprints` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components, tiled, values, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: First bit and width of the blocks: any two fingerprints within radius 3 agree on two of the five.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one file compared in one task.
TILE = 2048
#: Candidate pairs whose planes are held at once.
PAIRS = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return _hash(joined)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    spans = map(slice, starts[: len(ws) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    count = len(ws) - shingle + 1
    by_byte = np.fromiter(map(_hash, map(joined.__getitem__, spans)), dtype="<u8", count=count).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprinted(rows: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` with the fingerprint (64 bits as a signed long) under ``name`` in place of ``text``."""
    at = rows.columns.index("text")
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in values(batch.column(at))], dtype=np.uint64).view(np.int64)
            cols = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got)], names=[*(f.name for f in kept), name])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` long")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): one row a document."""
    return _fingerprinted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "fp", shingle)


def within(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Flags of the pairs (left, right) of positions in ``fp`` that differ in at most ``radius`` bits."""
    planes = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1).T.copy()  # 64 rows, one a bit
    out = np.zeros(len(left), dtype=bool)
    for lo in range(0, len(left), 8192):
        a, b = left[lo : lo + 8192], right[lo : lo + 8192]
        size = (len(a) + 7) // 8
        counters = [np.zeros(size, dtype=np.uint8) for _ in range(radius.bit_length())]
        over = np.zeros(size, dtype=np.uint8)
        if len(a) % 8:
            over[-1] = (1 << (8 - len(a) % 8)) - 1  # the padding
        for first in range(0, 64, 16):
            differ = np.packbits(planes[first : first + 16, a] ^ planes[first : first + 16, b], axis=1)
            for carry in differ:
                for k, c in enumerate(counters):
                    counters[k], carry = c ^ carry, c & carry
                over |= carry
            if (over == 255).all():
                break
        else:
            total = sum((np.unpackbits(c)[: len(a)].astype(np.int64) << k for k, c in enumerate(counters)), np.zeros(len(a), dtype=np.int64))
            out[lo : lo + 8192] = (total <= radius) & (np.unpackbits(over)[: len(a)] == 0)
    return out


def spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable, after the links (a, b) join what ``labels`` had joined."""
    while True:
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        before = labels.copy()
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def _links(fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the pairs within the radius of each run of equal ``group``; ``side`` 1 and 2 are tiles to compare with each other only."""
    labels = np.arange(len(fp))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal labels, held, waiting
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        fresh = labels[a] != labels[b]
        a, b = a[fresh], b[fresh]
        ok = within(fp, a, b, radius)
        if ok.any():
            labels = spanning(labels, a[ok], b[ok])
        held, waiting = [], 0

    alive, d = np.arange(len(fp)), 1
    while len(alive):
        alive = alive[alive + d < len(fp)]
        alive = alive[group[alive] == group[alive + d]]
        pair = alive[(side[alive] == 0) | (side[alive] != side[alive + d])]
        if len(pair):
            held.append((pair, pair + d))
            waiting += len(pair)
        if waiting >= PAIRS:
            flush()
        d += 1
    if held:
        flush()
    moved = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[moved], fp[labels[moved]]


def near_links(distinct_fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links between different fingerprints of the one-column table that span all pairs within the radius."""
    if not 0 < radius <= 3:
        raise ValueError("five blocks find all pairs for a radius of 1 to 3")
    part = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1) for at, width in BLOCKS]
    keys = [
        (F.lit((5 * i + j) << 26) + F.shiftleft(part[i], 13) + part[j]).cast("long") for i in range(5) for j in range(i + 1, 5)
    ]
    dealt = tiled(distinct_fps.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("id")), tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, t, u, side, fp = cols
            new = np.append(True, (np.diff(key) != 0) | (np.diff(t) != 0) | (np.diff(u) != 0))
            a, b = _links(fp.view(np.uint64), np.cumsum(new), side, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            last = len(same) - int(same.sum())  # the last group may go on in the next batch
            if last:
                yield done([c[:last] for c in cols])
            rest = [c[last:] for c in cols]
        if rest is not None:
            yield done(rest)

    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component (the smallest fp reachable), component_id (the smallest doc_id reachable): one row a document."""
    fps = written(fingerprints(docs))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(near_links(distinct.select("fp"), radius))
    named = distinct.join(linked, distinct["fp"] == linked["node"]).select("fp", "component", "low")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    # Only fingerprints that have links need more than their own smallest id.
    names = named.join(lows, "component").select("fp", "component", "component_id")
    names = distinct.join(names, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    # Written, so that a fingerprint that very many documents share is split in the join.
    names = written(names)
    return fps.join(names, "fp").select("doc_id", "fp", "component", "component_id")


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, all columns kept: one with the group's smallest id.

    Rows that share an id are judged by their own texts, and of equal ones one stays.
    Rows with a null id, which can't be told apart, all stay.
    """
    groups = written(grouped(docs, radius).where("doc_id IS NOT NULL"))
    by_id = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("copy"))
    gone = by_id.where("copy OR n > 1").select(F.col("doc_id").alias("__gone"))
    stays = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    # Ids of several rows: the head of a group is the smallest fingerprint of its smallest id.
    several = written(by_id.where("n > 1").select(F.col("doc_id").alias("__id")))
    if several.isEmpty():
        return stays
    heads = groups.where("doc_id = component_id").groupBy("component", "component_id").agg(F.min("fp").alias("__fp")).select(F.col("component_id").alias("__id"), "__fp")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    rows = _fingerprinted(rows.join(several, "__id", "left_semi"), "__fp").dropDuplicates(["__id", "__fp"])
    return stays.unionByName(rows.join(heads, ["__id", "__fp"], "left_semi").select("row.*"))
