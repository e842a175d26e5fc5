"""Substring dedup: bytes covered by a 400-byte string that also starts elsewhere.

The suffixes of all texts are dealt out so that those with equal prefixes meet, and
each task orders its suffixes by the difference-cover algorithm: sampled triples are
sorted and named, the names are sorted by recursion, the remaining suffixes are
merged in, and the prefixes of neighbours are compared.

The report does so for two lengths: ``LENGTH`` bytes that start anywhere else decide
what is removed; ``PASSAGE`` bytes that another document holds tell which documents
share passages of over 50 words (51 of three letters and a blank are as many bytes),
most of which are shorter than ``LENGTH``.

Dealing: of the blocks of three eighths of the length inside a prefix, the one with the smallest hash (the last of equal ones) is its key.  Equal prefixes have the same
key at the same offset.  A sampled position (the start of such a block) owns a run
of neighbouring suffixes, and what can be settled for a whole run never reaches
the sort:

1. Per document: sampled positions, each with its block's hash and its run's name and place.
2. Blocks that occur once hold no repeated prefix.  The rest is a small part.
3. Runs with equal names are one class; a class of two or more is repeated whole
   (for passages: a class that two documents hold).
4. Blocks with several classes: one text of each class goes to the suffix sort.
   Blocks with many classes are dealt into tiles.
5. The flagged suffixes go back to their documents, where the covered bytes are cut.

The hashes deal out and settle copies (64 bits each, block and name together); the
sort and the comparison work on bytes.

Defined results: a null text is empty; documents shorter than 400 bytes lose
nothing; null and repeated ids are documents like others, a repeated row is another
place where its strings start (but the same document, where passages are shared); an
empty table gives an empty result; further columns are kept by :func:`remove`, ignored
by :func:`report`.  Texts are worked on in pieces of ``PIECE`` suffixes, so a task holds
the longest text and about a hundred bytes for each byte of a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import maybe_in, tiled, written

LENGTH = 400
PASSAGE = 204
#: Suffixes of a text that are sampled at once.
PIECE = 1 << 20
#: Classes of one block compared in one task.
TILE = 2048
#: Bytes of text whose suffixes are sorted at once (a unit of two tiles may be more).
SORT_BYTES = 1 << 20

_rng = np.random.default_rng(7)
_BYTES = _rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_sums(data: bytes) -> np.ndarray:
    """Hashes of the prefixes of a text, from which those of all its strings follow."""
    up = _power(len(data) + 1)[0]
    raw = _BYTES[np.frombuffer(data, dtype=np.uint8)] * up[: len(data)]
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(raw, dtype=np.uint64)])


class Sampled:
    """The sampled positions of a piece of a text: pos, the first and last suffix each owns, key (of the block) and name (of the run).

    The piece holds the first ``limit`` suffixes and, after them, what belongs to their prefixes.
    """

    def __init__(self, data: bytes, length: int, limit: int, sums: np.ndarray | None = None):
        half = max(3 * length // 8, 1)
        self.pos = self.lo = self.hi = np.zeros(0, dtype=np.int64)
        self.key = self.name = np.zeros(0, dtype=np.int64)
        n = len(data)
        if n < length:
            return
        self.down = _power(n + 1)[1]
        self.sums = prefix_sums(data) if sums is None else sums
        blocks = self.hashes(np.arange(n - half + 1), half)
        where = np.arange(len(blocks), dtype=np.uint64)
        low = (blocks & ~_LOW) | (_LOW - (where & _LOW))  # smallest hash, then last position
        span, width = 1, length - half + 1
        while span < width:  # minima over ``width`` blocks by doubling
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        low = low[:limit]
        start = np.arange(len(low))
        at = start + ((_LOW - (low & _LOW)).astype(np.int64) - start) % (1 << 24)
        first = np.flatnonzero(np.append(True, np.diff(at) != 0))
        self.pos, self.lo = at[first], first
        self.hi = np.append(first[1:], len(at)) - 1
        self.key = blocks[self.pos].view(np.int64)
        name = self.spans(self.lo, self.hi + length) ^ ((self.pos - self.lo).astype(np.uint64) * _MIX)
        self.name = ((name ^ (name >> np.uint64(29))) * _MIX).view(np.int64)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64)

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Mixed hashes of the strings of ``size`` bytes at ``starts``."""
        h = self.spans(starts, starts + size)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(31))


def pieces(data: bytes, length: int, sums: np.ndarray | None = None) -> Iterator[tuple[int, Sampled]]:
    """Offset and sampled positions of the pieces of a text, whose runs follow one another; ``sums`` are its prefix sums if it is one piece and they are known."""
    for at in range(0, max(len(data) - length + 1, 1), PIECE):
        yield at, Sampled(data[at : at + PIECE - 1 + length], length, PIECE) if len(data) > PIECE else Sampled(data, length, PIECE, sums)


def covered(flagged: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under flagged suffixes' prefixes."""
    edges = np.diff(np.concatenate(([0], flagged.view(np.int8), [0])))
    a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1 + length
    apart = a[1:] > b[:-1]
    return (a[np.append(True, apart)], b[np.append(apart, True)]) if len(a) else (a, b)


def _source(docs: DataFrame) -> DataFrame:
    """A key of each different row (of id and text), its id, the UTF-8 bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    return rows.select(F.xxhash64("doc_id", "data").alias("doc"), "doc_id", "data")


def _joined(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents' rows with what ``lists`` (doc, ...) has for them; others stay out, most of them before the shuffle."""
    return maybe_in(docs, lists, "doc").join(lists, "doc")


def _sample(source: DataFrame, lengths: list[int]) -> DataFrame:
    """doc, doc_id, n_bytes, sha256 of the whole text, and for each length, of each run, keysN, namesN, losN (its first suffix) and sizesN (how many it has): a row a document, written."""
    names = [f"{c}{k}" for k in range(len(lengths)) for c in ("keys", "names", "los", "sizes")]
    kinds = [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())] * len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                size, sha, lists = [], [], [[] for _ in names]
                for data in part.column(2).to_pylist():
                    size.append(len(data))
                    sha.append(hashlib.sha256(data).hexdigest())
                    sums = prefix_sums(data) if min(lengths) <= len(data) <= PIECE else None
                    for k, length in enumerate(lengths):
                        got = [(p.key, p.name, at + p.lo, p.hi - p.lo + 1) for at, p in pieces(data, length, sums)]
                        for into, values in zip(lists[4 * k : 4 * k + 4], zip(*got, strict=True), strict=True):
                            into.append(np.concatenate(values))
                cols = [pa.array([v.astype(t.value_type.to_pandas_dtype()) for v in x], t) for x, t in zip(lists, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(sha), *cols], names=["doc", "doc_id", "n_bytes", "sha", *names])

    ddl = ", ".join(f"{n} array<{'int' if pa.types.is_int32(t.value_type) else 'long'}>" for n, t in zip(names, kinds, strict=True))
    return written(source.mapInArrow(run, f"doc long, doc_id long, n_bytes long, sha string, {ddl}"))


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover of residues 1 and 2 modulo 3."""
    n = len(values)
    if n < 4:
        return np.array(sorted(range(n), key=lambda k: values[k:].tolist()), dtype=np.int64)
    if values.max() > max(n, 256):
        values = np.unique(values, return_inverse=True)[1] + 1
    s = np.concatenate([values.astype(np.int64), np.zeros(4, dtype=np.int64)])
    # With n = 1 modulo 3 an empty suffix joins residue 1, so that every residue 0 has a successor in the sample.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = int(s.max()) + 1
    if top < 1 << 21:
        key = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
        order = np.argsort(key)
        fresh = np.append(True, np.diff(key[order]) != 0)
    else:
        order = np.lexsort((s[sample + 2], s[sample + 1], s[sample]))
        fresh = np.append(True, np.any([np.diff(s[sample[order] + k]) != 0 for k in range(3)], axis=0))
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(fresh)
    if names[order[-1]] < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 4, dtype=np.int64)  # of sampled suffixes, from 1; 0 past the end
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    wide = len(sample) + 2
    by_one = lambda p: s[p] * wide + rank[p + 1]
    rest = rest[np.argsort(by_one(rest))]
    # Each remaining suffix goes behind the sampled ones that are smaller, by one symbol and a rank or two and a rank.
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    if top * top * wide < 1 << 63:
        by_two = lambda p: (s[p] * top + s[p + 1]) * wide + rank[p + 2]
    else:
        pairs = np.unique(s[:n] * top + s[1 : n + 1])
        by_two = lambda p: np.searchsorted(pairs, s[p] * top + s[p + 1]) * wide + rank[p + 2]
    ahead = np.searchsorted(by_one(ones), by_one(rest)) + np.searchsorted(by_two(twos), by_two(rest))
    out = np.empty(n, dtype=np.int64)
    at = ahead + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = sampled
    return out


def equal_prefixes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes in order: flags of those whose prefix of ``length`` bytes equals that of the one before.

    ``words`` has the eight bytes from each place on.
    """
    same = np.arange(len(at) - 1)  # neighbours that are still equal
    for k in [*range(0, length - 7, 8), max(length - 8, 0)]:
        same = same[words[at[same] + k] == words[at[same + 1] + k]]
    flags = np.zeros(len(at), dtype=bool)
    flags[same + 1] = True
    return flags


def repeated_starts(data: bytes, starts: np.ndarray, length: int, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Flags of the ``starts`` that have a prefix of ``length`` bytes in common with another, or with another document.

    ``first`` and ``last``, where documents count, are the smallest and largest in which a start's run occurs.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    index = np.full(len(raw), -1, dtype=np.int64)
    index[starts] = np.arange(len(starts))
    order = suffix_order(raw.astype(np.int64) + 1)
    order = order[index[order] >= 0]
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(raw) + 1, dtype=np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    new = np.flatnonzero(~equal_prefixes(words, order, length))
    who, sizes = index[order], np.diff(np.append(new, len(order)))
    found = sizes > 1 if first is None else np.minimum.reduceat(first[who], new) != np.maximum.reduceat(last[who], new)
    flags = np.zeros(len(starts), dtype=bool)
    flags[who] = np.repeat(found, sizes)
    return flags


_TEXTS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("text", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])


def _texts_of(source: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """key, id (name), text, first, last: the bytes of one run of each class of ``need`` (doc, key, name, lo, size, first, last)."""
    lists = written(need.groupBy("doc").agg(F.collect_list(F.struct("key", "name", "lo", "size", "first", "last")).alias("want")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [
                    (w["key"], w["name"], data[w["lo"] : w["lo"] + w["size"] - 1 + length], w["first"], w["last"])
                    for data, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for w in want
                ]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(_TEXTS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _TEXTS, strict=True)], schema=_TEXTS)

    return _joined(source, lists).select("data", "want").mapInArrow(run, "key long, id long, text binary, first long, last long")


_MASKS = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("mask", pa.binary())])


def _compared(texts: DataFrame, counts: DataFrame, length: int, across: bool) -> DataFrame:
    """key, name, mask (a bit for each suffix of the run): classes that have something in common with others of the block."""
    dealt = tiled(texts, TILE, counts).select("key", "t", "u", "id", "text", "first", "last")

    def sort(rows: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
        made: list[tuple] = []
        if len(rows) > 1:
            sizes = np.array([len(r[0]) for r in rows.values()])
            counts, ends = sizes - length + 1, np.cumsum(sizes)
            own = np.repeat(np.arange(len(rows)), counts)
            starts = (ends - sizes)[own] + np.arange(len(own)) - (np.cumsum(counts) - counts)[own]
            docs = [np.array([r[k] for r in rows.values()], dtype=np.int64)[own] for k in (1, 2)] if across else []
            flags = repeated_starts(b"".join(r[0] for r in rows.values()), starts, length, *docs)
            for (key, name), mask in zip(rows, np.split(flags, np.cumsum(counts)[:-1]), strict=True):
                if mask.any():
                    made.append((key, name, np.packbits(mask).tobytes()))
        cols = list(zip(*made, strict=True)) if made else [()] * len(_MASKS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MASKS, strict=True)], schema=_MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held = None, {}, 0
        for batch in batches:
            for key, t, u, name, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (key, t, u) and held >= SORT_BYTES:
                    yield sort(rows)
                    rows, held = {}, 0
                at = (key, t, u)
                if (key, name) not in rows:  # once, though tiles repeat it
                    rows[key, name] = tuple(rest)
                    held += len(rest[0])
        yield sort(rows)

    return dealt.mapInArrow(run, "key long, name long, mask binary")


def _decisions(source: DataFrame, sample: DataFrame, k: int, length: int, across: bool = False) -> DataFrame:
    """doc, marks (lo, size, mask; a null mask flags the whole run) of documents that have some, by the k-th length of the sample.

    With ``across`` what counts is that another document holds a prefix too, else that it starts anywhere else.
    """
    fields = {"keys": "key", "names": "name", "los": "lo", "sizes": "size"}
    each = sample.select("doc", F.explode(F.arrays_zip(*(f"{c}{k}" for c in fields))).alias("s")).select("doc", *(F.col(f"s.{c}{k}").alias(name) for c, name in fields.items()))
    again = written(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    runs = written(maybe_in(each, again, "key").join(again, "key", "left_semi"))
    classes = runs.groupBy("key", "name").agg(F.count("*").alias("n"), F.min_by("lo", "doc").alias("lo"), F.min("size").alias("size"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    classes = written(classes.withColumn("whole", F.col("first") != F.col("last") if across else F.col("n") > 1).drop("n"))
    # A block whose classes are all repeated whole needs no sort.
    several = classes.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("all")).where("n > 1 AND NOT all")
    several = written(several.select("key", "n"))
    need = classes.join(several.select("key"), "key").select(F.col("first").alias("doc"), "key", "name", "lo", "size", "first", "last")
    masks = _compared(_texts_of(source, need, length), several, length, across)
    whole = classes.where("whole").select("key", "name", F.lit(None).cast("binary").alias("mask"))
    found = written(whole.unionByName(masks.join(whole.select("key", "name"), ["key", "name"], "left_anti")))
    marks = runs.join(found, ["key", "name"]).groupBy("doc").agg(F.collect_set(F.struct("lo", "size", "mask")).alias("marks"))
    return written(marks)


def _spans(data: bytes, marks: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes of a text under flagged suffixes."""
    flags = np.zeros(max(len(data) - length + 1, 0), dtype=bool)
    for m in marks or ():
        lo, size, mask = m["lo"], m["size"], m["mask"]
        flags[lo : lo + size] |= True if mask is None else np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=size).view(bool)
    return covered(flags, length)


def _kept(data: bytes, spans: tuple[np.ndarray, np.ndarray]) -> Iterator[memoryview]:
    """What is left of a text without the spans."""
    view, end = memoryview(data), 0
    for a, b in zip(*(x.tolist() for x in spans), strict=True):
        yield view[end:a]
        end = b
    yield view[end:]


def _each(rows: DataFrame, ddl: str, at: list[int], make: Callable[..., tuple], keep: int, types: list[pa.DataType], names: list[str]) -> DataFrame:
    """The first ``keep`` columns of ``rows`` and what ``make`` gives for the columns ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = [make(*values) for values in zip(*(part.column(k).to_pylist() for k in at), strict=True)]
                cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *cols], names=names)

    return rows.mapInArrow(run, ddl)


def report(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (bytes in passages that other documents hold too): a row a document."""
    source = _source(docs)
    sample = _sample(source, [length, passage])
    marks = _decisions(source, sample, 0, length)
    shared = _decisions(source, sample, 1, passage, across=True)
    both = written(marks.join(shared.withColumnRenamed("marks", "shared"), "doc", "full_outer"))

    def make(data: bytes, found: list[dict] | None, passages: list[dict] | None) -> tuple[int, int, int, str, int]:
        gone, held = _spans(data, found, length), _spans(data, passages, passage)
        sha = hashlib.sha256()
        for part in _kept(data, gone):
            sha.update(part)
        return len(data), int((gone[1] - gone[0]).sum()), len(gone[0]), sha.hexdigest(), int((held[1] - held[0]).sum())

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"]
    rows = _joined(source, both).select("doc_id", "data", "marks", "shared")
    cut = _each(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long", [1, 2, 3], make, 1, types, names)
    zero = F.lit(0).cast("long")
    rest = sample.join(both.select("doc"), "doc", "left_anti")
    return cut.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), zero.alias("n_shared")))


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with the covered bytes cut from their texts (halves of characters replaced), all columns kept."""
    source = _source(docs)
    marks = _decisions(source, _sample(source, [length]), 0, length)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    data = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(data, F.lit("").cast("binary"))).alias("doc"), row, data.alias("data"))
    rows = rows.join(marks, "doc", "left").select("row", "data", "marks")
    ddl = f"row {rows.schema['row'].dataType.simpleString()}, text string"

    def make(data: bytes | None, found: list[dict] | None) -> tuple[str | None]:
        if data is None or not found:
            return (None if data is None else data.decode("utf-8", "replace"),)
        return (b"".join(_kept(data, _spans(data, found, length))).decode("utf-8", "replace"),)

    cut = _each(rows, ddl, [1, 2], make, 1, [pa.string()], ["row", "text"])
    return cut.select("row.*", "text").select(*(F.col(f"`{c}`") for c in docs.columns))
