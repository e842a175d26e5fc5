"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line of at least ``MIN_WORDS`` words.  Its words (A-Z lowered) are
hashed as five-word shingles, ``BANDS`` bands of ``ROWS`` minima each file it, and
paragraphs that share a file are compared by the exact Jaccard similarity of their
shingle sets.  Equal paragraphs are one from the start.  Files with more than
``TILE`` paragraphs are dealt into tiles, a task for each pair of tiles, and a task
only looks for links to paragraphs its earlier links don't reach.  Of each component
the occurrence that comes first (by document and position) stays, the others go.

At the similarity asked for, a pair shares a band with probability
``1 - (1 - 0.8 ** ROWS) ** BANDS`` (0.998).

A passage that repeats inside lines which differ otherwise, or across line ends, is
no paragraph of its own.  So the word stream of a document is also filed by stretches
of ``MIN_WORDS`` words: one begins at the smallest shingle hash of every ``WINNOW``
neighbouring places, so two documents that share ``MIN_WORDS + WINNOW - 1`` (50) words
in a row share a stretch for certain.  Equal stretches (128-bit digests; their
similarity is 1) are a component as well: the first stays, the words of the others go.

Defined results: a null text has no paragraphs; documents with a null id take no
part and are kept as they are; rows that repeat an id with the same text hold the
same occurrence, so none of them loses it to the other; with different texts each
paragraph is one of the id; texts of fewer than ``MIN_WORDS`` words are never touched;
an empty table gives an empty result; a very long text is cut into its paragraphs and
stretches by one task, none of which is cut short; further columns are kept by :func:`remove`,
ignored by :func:`report`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components, maybe_in, tiled, written

MIN_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.8
ROWS = 3
BANDS = 9
TILE = 1024
WINNOW = 31
#: Documents signed at once.
GROUP = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"\S+")
_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 63, size=ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 1 << 63, size=ROWS * BANDS, dtype=np.uint64)
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def lines_of(text: str | None) -> list[list[bytes]]:
    """Words of each line."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")]


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def _rolled(one: np.ndarray) -> np.ndarray:
    """Hash of the shingle at each place of a stream of at least ``SHINGLE`` word hashes."""
    n = len(one) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + one[k : k + n] * _POWERS[k]
    return h


def shingles(ws: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles of ``MIN_WORDS`` words or more, sorted."""
    return np.unique(_rolled(_hashes(ws)))


def band_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One key a band for each stretch of shingle hashes, from the minima of the hash functions."""
    edges = np.stack([starts, ends], axis=1).ravel()
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    for band in range(BANDS):
        for k in range(ROWS):
            mixed = h * _A[band * ROWS + k] + _C[band * ROWS + k]
            mixed = np.append(mixed ^ (mixed >> np.uint64(32)), np.uint64(0))  # the last stretch may end with the stream
            got = (key[:, band] ^ np.minimum.reduceat(mixed, edges)[::2]) * np.uint64(0x9E3779B97F4A7C15)
            key[:, band] = got ^ (got >> np.uint64(29))
    return key.view(np.int64)


def anchors(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the smallest hash (the first of equal ones) among every ``WINNOW`` neighbouring places of each document.

    A document has ``counts`` places from ``starts`` on; with fewer than ``WINNOW`` of them all are one neighbourhood.
    """
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    low = (mixed & ~_LOW) | (np.arange(len(h), dtype=np.uint64) & _LOW)
    edges = np.stack([starts, starts + counts], axis=1).ravel()
    few = counts < WINNOW
    found = [np.minimum.reduceat(np.append(low, np.uint64(0)), edges)[::2][few]]
    begin = [starts[few]]
    span = 1
    while span < WINNOW:
        step = min(span, WINNOW - span)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        span += step
    many = counts[~few] - WINNOW + 1
    if len(many):
        place = np.repeat(starts[~few] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found.append(low[place])
        begin.append(place)
    begin = np.concatenate(begin)
    return np.unique(begin + ((np.concatenate(found) & _LOW).astype(np.int64) - begin) % (1 << 24))


def stretch_names(one: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the ``MIN_WORDS`` words from each place on."""
    a, b = np.full(len(at), 1, dtype=np.uint64), np.full(len(at), 2, dtype=np.uint64)
    for k in range(MIN_WORDS):
        w = one[at + k]
        a = (a ^ (a >> np.uint64(29)) ^ w) * _POWERS[0]
        b = (b ^ (b >> np.uint64(31)) ^ (w * _POWERS[3])) * _POWERS[1]
    return (a ^ (a >> np.uint64(32))).view(np.int64), (b ^ (b >> np.uint64(32))).view(np.int64)


def _digest(ws: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(ws))


_LISTS = "pnos array<int>, hs array<binary>, keys array<array<bigint>>, ats array<int>, a array<bigint>, b array<bigint>"


def _signed(texts: list[str | None]) -> list[pa.Array]:
    """The columns of ``_LISTS`` for some texts."""
    words: list[bytes] = []
    pnos, hs, begin, end, n_paras = [], [], [], [], []
    starts, counts = [], []
    for text in texts:
        first, n = len(words), 0
        for p, ws in enumerate(lines_of(text)):
            if len(ws) >= MIN_WORDS:
                pnos.append(p)
                hs.append(_digest(ws))
                begin.append(len(words))
                end.append(len(words) + len(ws) - SHINGLE + 1)
                n += 1
            words += ws
        n_paras.append(n)
        starts.append(first)
        counts.append(max(len(words) - first - MIN_WORDS + 1, 0))
    one = _hashes(words)
    keys, at = np.zeros((0, BANDS), dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts, counts = np.array(starts, dtype=np.int64), np.array(counts, dtype=np.int64)
    if counts.any():
        h = _rolled(one)
        keys = band_keys(h, np.array(begin), np.array(end)) if begin else keys
        at = anchors(h, starts[counts > 0], counts[counts > 0])
    a, b = stretch_names(one, at)
    of = np.searchsorted(at, np.append(starts, len(words)))
    offsets = lambda x: pa.array(x, pa.int32())
    paras, places = offsets(np.cumsum([0, *n_paras])), offsets(of)
    each = pa.ListArray.from_arrays(offsets(np.arange(len(keys) + 1) * BANDS), pa.array(keys.ravel()))
    lists = [(paras, pa.array(pnos, pa.int32())), (paras, pa.array(hs, pa.binary())), (paras, each)]
    lists += [(places, pa.array((at - np.repeat(starts, np.diff(of))).astype(np.int32))), (places, pa.array(a)), (places, pa.array(b))]
    return [pa.ListArray.from_arrays(o, v) for o, v in lists]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pnos, hs, keys (of every paragraph), ats, a, b (of every stretch): a row a document with an id, written."""
    names = ["doc_id", *(c.split()[0] for c in _LISTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                yield pa.RecordBatch.from_arrays([part.column(0), *_signed(part.column(1).to_pylist())], names=names)

    return written(_rows(docs).mapInArrow(run, f"doc_id long, {_LISTS}"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, shingles of the paragraphs ``wanted`` (doc_id, pno, id) names."""
    lists = written(wanted.groupBy("doc_id").agg(F.collect_set("pno").alias("pnos")))
    rows = maybe_in(_rows(docs), lists, "doc_id").join(lists, "doc_id").select("text", "pnos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, sets = [], []
                for text, pnos in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ls = lines_of(text)
                    for p in pnos:
                        if p < len(ls) and len(ls[p]) >= MIN_WORDS:
                            ids.append(_digest(ls[p]))
                            sets.append(shingles(ls[p]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return rows.mapInArrow(run, "id binary, shingles array<long>").join(wanted.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def spanning(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that span the pairs of sets with the similarity; ``side`` 1 and 2 are compared with each other only.

    From each set that is reached, the overlaps with all others are counted at once through
    an index of the shingles, and what is similar and not yet reached is reached next.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    new = np.append(True, np.diff(np.concatenate(sets)[order]) != 0)
    holders, first = owner[order], np.append(np.flatnonzero(new), len(order))
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.cumsum(size) - size
    left = np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        todo = [seed] if left[seed] else []
        left[seed] = False
        while todo and left.any():
            i = todo.pop()
            mine = which[at[i] : at[i] + size[i]]
            n = first[mine + 1] - first[mine]
            every = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holders[every], minlength=len(sets))
            near = left & (both >= similarity * (size[i] + size - both)) & ((side == 0) | (side != side[i]))
            for j in np.flatnonzero(near).tolist():
                yield i, j
                todo.append(j)
            left &= ~near


def links(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links that span the pairs of each unit of ``tiled`` rows (key, t, u, side, id, shingles) with the similarity."""

    def compare(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        found = spanning([r[2] for r in rows], np.array([r[0] for r in rows]), similarity)
        return [(rows[i][1], rows[j][1]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            where = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            side, ids, sets = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            for k, w in enumerate(where):
                if w != unit:
                    found += compare(rows)
                    unit, rows = w, []
                rows.append((side[k], ids[k], sets[k].values.to_numpy()))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a, b = zip(*found, strict=True) if (found := compare(rows)) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return members.mapInArrow(run, "a binary, b binary")


def _repeated_lines(docs: DataFrame, occ: DataFrame, similarity: float) -> DataFrame:
    """doc_id, pno, id, head (the first occurrence), shared (whether other documents hold it too) of repeated paragraphs."""
    each = occ.select("doc_id", F.explode(F.arrays_zip("pnos", "hs", "keys")).alias("p")).select("doc_id", F.col("p.pnos").alias("pno"), F.col("p.hs").alias("h"), F.col("p.keys").alias("keys"))
    distinct = each.groupBy("h").agg(F.min(F.struct("doc_id", "pno", "keys")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    distinct = written(distinct.select(F.col("h").alias("id"), "first.doc_id", "first.pno", "first.keys", "last", "n"))
    members = written(tiled(distinct.select(F.explode("keys").alias("key"), "id"), TILE))
    sets = written(_sets(docs, distinct.join(members.select("id").distinct(), "id", "left_semi").select("doc_id", "pno", "id")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(sets, "id").select("key", "t", "u", "side", "id", "shingles").repartition(tasks, "key", "t", "u").sortWithinPartitions("key", "t", "u")
    linked = components(links(dealt, similarity))
    repeated = distinct.join(linked, distinct["id"] == linked["node"], "left").where("n > 1 OR component IS NOT NULL")
    repeated = written(repeated.select("id", F.coalesce("component", "id").alias("component"), F.struct("doc_id", "pno").alias("at"), "last"))
    heads = repeated.groupBy("component").agg(F.min("at").alias("head"), F.max("last").alias("until"))
    named = written(repeated.join(heads, "component").select("id", "head", (F.col("until") != F.col("head.doc_id")).alias("shared")))
    return each.select("doc_id", "pno", F.col("h").alias("id")).join(named, "id")


def _repeated_stretches(occ: DataFrame) -> DataFrame:
    """doc_id, at, a, b, head (the first occurrence), shared of repeated stretches."""
    each = occ.select("doc_id", F.explode(F.arrays_zip("ats", "a", "b")).alias("s")).select("doc_id", F.col("s.ats").alias("at"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    again = written(each.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    some = written(maybe_in(each, again, "a").join(again, "a", "left_semi"))
    heads = some.groupBy("a", "b").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    heads = written(heads.select("a", "b", "head", (F.col("last") != F.col("head.doc_id")).alias("shared")))
    return some.join(heads, ["a", "b"])


def _decided(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The occurrences, and per document with repeated paragraphs or stretches what of it goes and which documents keep it."""
    occ = occurrences(docs)
    none = lambda kind: F.lit(None).cast(kind)
    gone = lambda at: (F.col("head.doc_id") != F.col("doc_id")) | (F.col(f"head.{at}") != F.col(at))
    kept_by = F.when(F.col("head.doc_id") != F.col("doc_id"), F.col("head.doc_id")).alias("keeper")
    lines = _repeated_lines(docs, occ, similarity).select(
        "doc_id", F.lit(True).alias("line"), "shared", kept_by, F.when(gone("pno"), F.struct("pno", F.col("id").alias("h"))).alias("removed"), none("struct<at:int,a:bigint,b:bigint>").alias("cut")
    )
    stretches = _repeated_stretches(occ).select(
        "doc_id", F.lit(False).alias("line"), "shared", kept_by, none("struct<pno:int,h:binary>").alias("removed"), F.when(gone("at"), F.struct("at", "a", "b")).alias("cut")
    )
    number = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    by_doc = lines.unionByName(stretches).groupBy("doc_id").agg(
        number(F.col("line")).alias("n_repeated"),
        number(~F.col("line")).alias("n_stretches"),
        number(F.col("shared")).alias("n_shared"),
        F.collect_set("removed").alias("removed"),
        F.collect_set("cut").alias("cut"),
        F.sort_array(F.collect_set("keeper")).alias("first_docs"),
    )
    return occ, by_doc


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row a document: doc_id, n_paragraphs, n_repeated, n_removed (paragraphs), n_stretches (that repeat), n_cut (of them), n_shared (paragraphs and stretches other documents hold too), first_docs (documents that keep what goes)."""
    occ, by_doc = _decided(docs, similarity)
    counts = {"n_repeated": F.col("n_repeated"), "n_removed": F.size("removed").cast("long"), "n_stretches": F.col("n_stretches"), "n_cut": F.size("cut").cast("long"), "n_shared": F.col("n_shared")}
    by_doc = written(by_doc.select(F.col("doc_id").alias("__doc"), *(c.alias(n) for n, c in counts.items()), "first_docs"))
    zero = F.lit(0).cast("long")
    out = occ.select("doc_id", F.size("pnos").cast("long").alias("n_paragraphs")).join(by_doc, F.col("doc_id") == F.col("__doc"), "left").select(
        "doc_id",
        "n_paragraphs",
        *(F.coalesce(n, zero).alias(n) for n in counts),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), zero.alias("n_paragraphs"), *(zero.alias(n) for n in counts), F.array().cast("array<bigint>").alias("first_docs"))
    return out.unionByName(nameless)


def cut_out(text: str, removed: list[dict], cut: list[dict]) -> str:
    """A text without the removed lines and the words of the cut stretches."""
    drop = {(g["pno"], g["h"]) for g in removed}
    words = lines_of(text)
    one = _hashes([w for ws in words for w in ws])
    gone = np.zeros(len(one), dtype=bool)
    for g in cut:
        if g["at"] + MIN_WORDS <= len(one):
            a, b = stretch_names(one, np.array([g["at"]]))
            if (a[0], b[0]) == (g["a"], g["b"]):
                gone[g["at"] : g["at"] + MIN_WORDS] = True
    kept, first = [], 0
    for p, (line, ws) in enumerate(zip(text.encode("utf-8", "surrogatepass").split(b"\n"), words, strict=True)):
        flags = gone[first : first + len(ws)]
        first += len(ws)
        if drop and (p, _digest(ws)) in drop:
            continue
        if flags.any():
            spans = [m.span() for m in _WORD.finditer(line)]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).tolist()
            end, parts = 0, []
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                parts.append(line[end : spans[a][0]])
                end = spans[b - 1][1]
            line = b"".join([*parts, line[end:]])
        kept.append(line)
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the removed paragraphs (and their line ends) and the words of the cut stretches gone, all columns kept."""
    _, by_doc = _decided(docs, similarity)
    lists = written(by_doc.where((F.size("removed") > 0) | (F.size("cut") > 0)).select(F.col("doc_id").alias("__doc"), F.col("removed").alias("__removed"), F.col("cut").alias("__cut")))
    rows = docs.join(lists, docs["doc_id"].cast("long") == lists["__doc"], "left").drop("__doc")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, (removed, cut) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if (removed or cut) and texts[k] is not None:
                    texts[k] = cut_out(texts[k], removed, cut)
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
