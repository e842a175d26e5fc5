"""URL filters by a cascade of Bloom filters that is exact over the corpus's keys.

A rule names a host and a path; it fits that host and its subdomains where the path
starts with the rule's.  The keys of a url are the suffixes of its host joined with the
beginnings of its path, for the numbers of labels and the path lengths that occur in
rules.  The complete universe of keys is what all urls of the corpus give.

For each list (``block``, ``allow``) the first filter holds the listed keys, the second
those other keys of the universe that the first lets through, the third the listed keys
that the second lets through, and so on until nothing passes wrongly.  A key is decided
by the first filter that doesn't hold it: no key of the corpus is judged wrongly, and
judging joins nothing.  Building reads the corpus twice (to count its keys for the size
of the first filter, and for the keys that pass it); the later filters are built from
what passed, about as many keys as are listed.  The longest listed key of a url wins,
that of the longer host where two are equally long, ``block`` where a key is in both
lists; without one the url is in no list, so the verdict is ``allow``.

Bounds: a cascade holds at most about ``MAX_KEYS`` listed keys (a few bytes each,
broadcast); longer lists are dealt to several by the keys' hashes, and each cascade runs
over all rows and is released before the next.  Keys are known by 128 bits of hash.

Defined results: a null url, or one without ``://``, has an empty host and path and fits
no rule; rules with a null or empty host, or a null path or verdict, are ignored;
repeated rules and rows change nothing; empty tables give empty results, no rules give
``allow`` everywhere; further columns are kept by :func:`keep`.  Very long urls are
judged whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import forget, lower_ascii, written

LISTS = ("block", "allow")
#: Listed keys of one cascade.
MAX_KEYS = 4_000_000

_SEEDS = (1, 2)  # of the two hashes of a key
_SLOTS = 32768  # bits of a bitmap that Spark aggregates


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key) for seed in _SEEDS]


def keyed(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The rows with __host, __path, __keys (longest first), __h1 and __h2 (the keys' hashes).

    ``shapes`` are pairs of a number of labels and a path length.
    """
    rows = pages.withColumns({"__host": host_of(F.coalesce("url", F.lit(""))), "__path": path_of(F.coalesce("url", F.lit("")))})
    host, path = F.col("__host"), F.col("__path")
    all_shapes = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in shapes)) if shapes else F.array().cast("array<struct<n:int,p:int>>")
    fits = F.filter(all_shapes, lambda s: (s["n"] <= _labels(host)) & (s["p"] <= F.length(path)))
    suffix = lambda s: F.call_function("substring_index", host, F.lit("."), -s["n"])
    parts = F.transform(fits, lambda s: F.struct(suffix(s).alias("h"), F.substring(path, F.lit(1), s["p"]).alias("p")))
    ordered = F.sort_array(F.transform(parts, lambda x: F.struct((F.length(x["h"]) + F.length(x["p"])).alias("n"), F.length(x["h"]).alias("m"), F.concat(x["h"], x["p"]).alias("key"))), asc=False)
    rows = rows.withColumn("__keys", F.transform(ordered, lambda x: x["key"]))
    first, second = (F.transform("__keys", hashed) for hashed in (lambda x: _hashes(x)[0], lambda x: _hashes(x)[1]))
    return rows.withColumns({"__h1": first, "__h2": second})


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """One Bloom filter; every level has hash functions of its own."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.size = max(64, math.ceil(keys * self.hashes / math.log(2)))
        self.bits = np.zeros(-(-self.size // 8), dtype=np.uint8)

    def spots(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.hashes):
            salt = np.uint64((self.number * 64 + k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            yield _mixed(_mixed(h1 + salt) ^ h2) % np.uint64(self.size)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for spot in self.spots(h1, h2):
            out &= (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Levels that encode, by turns, keys that are listed and keys that aren't."""

    def __init__(self):
        self.levels: list[Level] = []

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys are listed; exact for keys of the universe it was built over."""
        out = np.zeros(len(h1), dtype=bool)
        if not self.levels:
            return out
        live = np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            passed = level.holds(h1[live], h2[live])
            out[live[~passed]] = depth % 2 == 1
            live = live[passed]
        out[live] = len(self.levels) % 2 == 1
        return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _filled(keys: DataFrame, level: Level) -> Level:
    """Sets the bits of the keys: positions become bitmaps of 4 KB, which are collected, at most one for each of their bits."""
    empty = level  # without bits; tasks only need its hash functions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spot in empty.spots(*map(_unsigned, batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(spot.view(np.int64))], names=["spot"])

    at = F.col("spot") + 1
    maps = keys.select("h1", "h2").mapInArrow(run, "spot long").groupBy(F.bitmap_bucket_number(at).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(-(-len(level.bits) * 8 // _SLOTS) * _SLOTS // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        begin = (row["slot"] - 1) * _SLOTS // 8
        bits[begin : begin + _SLOTS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    filled = Level(level.number, 1, 0.5)
    filled.hashes, filled.size, filled.bits = level.hashes, level.size, bits[: len(level.bits)]
    return filled


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The rows h1, h2 that a level holds."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(*map(_unsigned, batch.columns))))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def _universe_passing(rows: DataFrame, level: Level, mine: tuple[int, int]) -> DataFrame:
    """h1, h2 of the corpus's keys of this part that the first level holds, once a task and batch."""
    shared = rows.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (_unsigned(c.flatten()) for c in batch.columns)
            took = np.unique(np.stack([h1, h2], axis=1)[_dealt(h1, mine)], axis=0)
            took = took[shared.value.holds(took[:, 0], took[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(took[:, k]).view(np.int64)) for k in (0, 1)], names=["h1", "h2"])

    return rows.select("__h1", "__h2").mapInArrow(run, "h1 long, h2 long")


def _dealt(h1: np.ndarray, mine: tuple[int, int]) -> np.ndarray:
    part, parts = mine
    return h1 % np.uint64(parts) == np.uint64(part)


def cascade(listed: DataFrame, rows: DataFrame, universe: int, mine: tuple[int, int] = (0, 1)) -> Cascade:
    """Built from the listed keys (h1, h2, distinct) and the :func:`keyed` rows of the corpus with about ``universe`` keys."""
    out, n = Cascade(), listed.count()
    if n == 0:
        return out
    # As many keys pass the first level wrongly as halves of the listed keys' number, about; each later level halves what is left.
    rate = min(0.5, n / (math.sqrt(2) * max(universe, 1)))
    out.levels.append(_filled(listed, Level(0, n, rate)))
    met = _universe_passing(rows, out.levels[0], mine).select("h1", "h2", F.lit(False).alias("own"))
    met = met.unionByName(listed.select("h1", "h2", F.lit(True).alias("own")))
    held, wrong = listed, written(met.groupBy("h1", "h2").agg(F.max("own").alias("own")).where("NOT own").select("h1", "h2"))
    while (n := wrong.count()) > 0:
        level = _filled(wrong, Level(len(out.levels), n, 0.5))
        out.levels.append(level)
        before, held, wrong = held, wrong, written(_passing(held, level))
        if before is not listed:
            forget(before)
    return out


def _tested(rows: DataFrame, cascades: tuple[Cascade, ...], mine: tuple[int, int]) -> DataFrame:
    """The rows with __found: the place of the first key that a list holds (from 0; null: none) and __list, that list's number."""
    shared = rows.sparkSession.sparkContext.broadcast(cascades)
    kept = [c for c in rows.columns if c not in ("__found", "__list")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept) + ", __found int, __list int"
    again = len(kept) < len(rows.columns)
    h1_at, h2_at = rows.columns.index("__h1"), rows.columns.index("__h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(h1_at)
            sizes = np.diff(lists.offsets.to_numpy())
            h1, h2 = (_unsigned(batch.column(k).flatten()) for k in (h1_at, h2_at))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(h1)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found, which = np.full(len(sizes), 2**31 - 1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            if again:
                old = batch.column(len(kept)).fill_null(2**31 - 1).to_numpy()
                found, which = old.astype(np.int64), batch.column(len(kept) + 1).fill_null(0).to_numpy().astype(np.int64)
            ours = _dealt(h1, mine)
            for number, machine in enumerate(shared.value):
                hit = np.flatnonzero(ours)[machine.holds(h1[ours], h2[ours])]
                best = np.full(len(sizes), 2**31 - 1, dtype=np.int64)
                np.minimum.at(best, row[hit], place[hit])
                better = best < found
                found[better], which[better] = best[better], number
            none = found == 2**31 - 1
            more = [pa.array(found.astype(np.int32), mask=none), pa.array(which.astype(np.int32), mask=none)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *more], names=[*kept, "__found", "__list"])

    return rows.mapInArrow(run, ddl)


def judged(pages: DataFrame, rules: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """The rows of ``pages`` with __host, __path, __rule and __verdict; ``rules`` has host, path and verdict (``block`` or ``allow``)."""
    given = rules.where("host <> '' AND path IS NOT NULL").select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").distinct()
    # At most as many pairs as the longest rule has labels times characters.
    shapes = [(r["n"], r["p"]) for r in given.where(F.col("verdict").isin(*LISTS)).select(_labels(F.col("host")).alias("n"), F.length("path").alias("p")).distinct().collect()]
    rows = keyed(pages, shapes)
    h1, h2 = _hashes(F.concat("host", "path"))
    listed = written(given.select("verdict", h1.alias("h1"), h2.alias("h2")).distinct())
    sizes = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    parts = max(1, math.ceil(max([0, *(sizes.get(x, 0) for x in LISTS)]) / max_keys))
    keys = rows.select("__h1", "__h2")
    universe = rows.select(F.explode("__h1").alias("h")).agg(F.approx_count_distinct("h").alias("n")).first()["n"] if sizes else 0
    done = rows
    for part in range(parts):
        mine = listed.where(F.expr(f"pmod(CAST(conv(hex(h1), 16, 10) AS DECIMAL(20)), {parts}) = {part}")) if parts > 1 else listed
        built = tuple(cascade(mine.where(F.col("verdict") == x).select("h1", "h2"), keys, universe // parts, (part, parts)) for x in LISTS)
        before, done = done, _tested(done, built, (part, parts))
        if part < parts - 1:
            done = written(done)
        if 0 < part < parts - 1:
            forget(before)
    rule = F.get("__keys", F.col("__found"))
    verdict = F.coalesce(F.get(F.array(*map(F.lit, LISTS)), F.col("__list")), F.lit("allow"))
    return done.select(*(F.col(f"`{c}`") for c in pages.columns), "__host", "__path", rule.alias("__rule"), verdict.alias("__verdict"))


def report(pages: DataFrame, rules: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict: a row a page."""
    found = judged(pages.select("page_id", F.col("url").cast("string").alias("url")), rules, max_keys)
    return found.select("page_id", *(F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def keep(pages: DataFrame, rules: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, all columns as they are."""
    return judged(pages, rules, max_keys).where("__verdict = 'allow'").select(*(F.col(f"`{c}`") for c in pages.columns))
