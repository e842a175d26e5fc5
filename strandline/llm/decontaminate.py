"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised to words; the automaton over their word ids is built on
the driver and broadcast.  Each training text streams through it: the state and
the longest match ending at every word give the windows that occur.

The automaton is bounded: items are dealt into shards of at most
``MAX_AUTOMATON_WORDS`` words.  Each shard's automaton is built, broadcast, run over
all texts and released before the next is read, and each pass adds what it finds to
the rows that the one before has written.  One shard is the usual case and needs
neither a written table nor a shuffle.

Defined results: null texts and texts without words have no words and are kept;
null items and items without words match nothing; repeated items count by their
``item_id`` (a null one as the empty string); repeated rows are rows of their
own; an empty table on either side gives no hits; a very long text streams whole
through the automaton in one task; further columns are kept by
:func:`remove` and ignored by :func:`report`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import forget, values, written

WINDOW = 10
#: Words of the items in one broadcast automaton (a few hundred bytes each).
MAX_AUTOMATON_WORDS = 500_000
#: A document is dropped when at least this share of its words is hit; from others the hit spans go.
MAX_COVERAGE = 0.5

_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c > 0x7F or chr(c).isalnum() else 32 for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words in UTF-8: runs of digits, a-z and whatever isn't ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the windows its states stand for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.names = sorted({name for name, _ in coded})
        number = {name: k for k, name in enumerate(self.names)}
        #: state -> items with the window of full size that ends there
        self.full: dict[int, set[int]] = {}
        #: state -> length -> items that are a window of that smaller size
        self.short: dict[int, dict[int, set[int]]] = {}
        for name, ids in coded:
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                at, size = state, min(k + 1, window)
                while self.link[at] >= 0 and self.length[self.link[at]] >= size:
                    at = self.link[at]
                if len(ids) >= window and size == window:
                    self.full.setdefault(at, set()).add(number[name])
                elif len(ids) < window and k + 1 == len(ids):
                    self.short.setdefault(at, {}).setdefault(size, set()).add(number[name])
        #: nearest state with short windows on the way up the links, itself included
        self.up = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.short else self.up[self.link[s]] if s else -1
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)
        pairs = {(a << 32) | b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches whose words, and pairs of adjacent words, all occur in items, if long enough for a window."""
        known = ids >= 0
        if self.least == 0 or not known.any():
            return []
        linked = np.zeros(len(ids), dtype=bool)  # the pair (i - 1, i) occurs
        if len(ids) > 1 and len(self.pairs):
            pair = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked[1:] = (self.pairs[at] == pair) & known[1:] & known[:-1]
        starts = np.flatnonzero(known & ~linked)
        after = np.flatnonzero(known & ~np.append(linked[1:], False)) + 1
        keep = after - starts >= self.least
        return list(zip(starts[keep].tolist(), after[keep].tolist(), strict=True))

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, hit flags of the words, items whose windows occur."""
        ws = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
        hit, found = np.zeros(len(ws), dtype=bool), set()
        for lo, hi in self.runs(ids):
            state = size = 0
            for i in range(lo, hi):
                c = int(ids[i])
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    size += 1
                if size >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    at = state
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    found |= self.full.get(at, set())
                at = self.up[state]
                while at >= 0:
                    for n, who in self.short[at].items():
                        if n <= size:
                            hit[i + 1 - n : i + 1] = True
                            found |= who
                    at = self.up[self.link[at]] if at else -1
        return len(ws), hit, found


def _shards(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in shards of at most ``limit`` words (a longer item is a shard of its own), at least one.

    Read partition by partition, so the driver holds one shard beside the partition being read.
    """
    items, total = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.where(F.col("text").isNotNull()).toLocalIterator():
        ws = words(row["text"])
        if ws and total and total + len(ws) > limit:
            yield items
            items, total = [], 0
        if ws:
            items.append((row["item_id"], ws))
            total += len(ws)
    yield items


def _word_spans(text: str, flags: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of runs of hit words."""
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _runs_of(flags: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).tolist()


_HITS = "n_words long, runs array<long>, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """The rows of ``docs`` with n_words, runs (edges of runs of hit words, in words) and items (ids, sorted)."""
    clash = {"n_words", "runs", "items", "__row"} & set(docs.columns)
    docs = docs.select(*(F.col(f"`{c}`").alias(f"{c}__in" if c in clash else c) for c in docs.columns))
    sc = docs.sparkSession.sparkContext
    shards = _shards(benchmark, limit)
    items, merge = next(shards), False
    while items is not None:
        following = next(shards, None)
        machine = sc.broadcast(Automaton(items, window))
        done = _pass(docs, machine, merge)
        if following is None:
            return done
        # Run and released before the next one is built: one automaton at a time.
        before, docs = docs, written(done)
        machine.unpersist()
        if merge:
            forget(before)
        items, merge = following, True
    return docs


def _pass(docs: DataFrame, automaton, merge: bool) -> DataFrame:
    """One automaton over all rows; with ``merge`` the rows already have the three columns."""
    at = docs.columns.index("text")
    kept = docs.columns[:-3] if merge else docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + ", " + _HITS
    target = docs.sparkSession.createDataFrame([], _HITS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for batch in batches:
            n_words, runs, items = [], [], []
            old = [batch.column(len(kept) + k).to_pylist() for k in range(1, 3)] if merge else None
            for k, text in enumerate(values(batch.column(at))):
                n, flags, found = machine.scan(text)
                names = {machine.names[x] for x in found}
                if old:
                    names |= set(old[1][k])
                    for a, b in zip(old[0][k][::2], old[0][k][1::2], strict=True):
                        flags[a:b] = True
                n_words.append(n)
                runs.append(_runs_of(flags))
                items.append(sorted(names, key=str.encode))
            cols = [*batch.columns[: len(kept)], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *target.names])

    return docs.mapInArrow(run, ddl)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a document."""
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, limit)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: x - acc)  # edges alternate, so this is the sum of lengths
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, limit: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """The rows of ``docs`` without the spans of hit words; rows of which ``max_coverage`` or more is hit are dropped.

    All columns stay; ``text`` loses the spans, everything else is as it was.
    """
    found = hits(docs, benchmark, window, limit)
    names, at = docs.columns, docs.columns.index("text")
    n = len(names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, runs = (batch.column(k).to_pylist() for k in (at, n, n + 1))
            keep = np.ones(len(texts), dtype=bool)
            for k, (text, words_in, edges) in enumerate(zip(texts, total, runs, strict=True)):
                if not edges:
                    continue
                flags = np.zeros(words_in, dtype=bool)
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    flags[a:b] = True
                if flags.sum() >= max_coverage * words_in:
                    keep[k] = False
                    continue
                end, out = 0, []
                for a, b in _word_spans(text, flags):
                    out.append(text[end:a])
                    end = b
                texts[k] = "".join([*out, text[end:]])
            cols = list(batch.columns[:n])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return found.mapInArrow(run, ddl)
