"""Ranked lexical search by Fagin's threshold algorithm.

Documents stay where they are.  One pass over all texts writes the forward index: per
document its number of terms, and the queries' terms in it with their counts.  Corpus
statistics (documents, terms, document frequencies) are sums over that index.  A second
pass reads it in blocks; a block's postings are turned into one list a term, sorted by
impact, and every query runs over them: its lists are read round-robin from the top, a
document met for the first time gets its whole score from the forward index, and reading
ends when the threshold, the score that the next entries of all lists would give
together, falls strictly below the k-th best score of the query so far.  A task keeps a
query's best from block to block, so later blocks stop sooner, and returns at most ``k``
rows a query; the best of all tasks are ranked by a window that is cut to ``k`` rows
before its shuffle.

Bounds: queries are taken in groups of at most ``MAX_TERMS`` terms (a longer query is a
group of its own), each with a forward index of its own; a block holds about ``BLOCK``
postings.  No posting is shuffled, so a frequent term is no hot key.  A worker holds one
slice of texts, a very long one whole.

Defined results: null texts and texts without terms aren't counted and never found;
rows with a null ``doc_id`` count and are ranked after others of the same score; repeated
document rows are documents of their own; null queries and those without a known term
find nothing; repeated query rows are ranked each on its own; documents of equal score
go by ``doc_id``; an empty table on either side gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import values, written
from strandline.llm.decontaminate import words

TOP = 20
#: Term occurrences of the queries that one pass serves (about 100 bytes each, broadcast).
MAX_TERMS = 500_000
#: Postings that a block holds at least before it is searched (about 40 bytes each).
BLOCK = 1 << 20
#: Entries that are read from each list in the first turn; doubled each turn up to 64 times that.
TURN = 32


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What one occurrence of a term in a query takes from a document, before the term's weight."""
    m = 100 - 25 + (25 * n * docs) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Best:
    """The k best (score, document) pairs of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.null = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool))

    @property
    def bound(self) -> int:
        """A document needs at least this score; 1 until k are found."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.bound
        if not keep.any():
            return
        score, doc, null = (np.concatenate(x) for x in ((self.score, score[keep]), (self.doc, doc[keep]), (self.null, null[keep])))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Block:
    """Documents with their forward index, and the lists of their terms by falling impact."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, at: np.ndarray, term: np.ndarray, impacts: np.ndarray):
        self.doc, self.null, self.at, self.term, self.impacts = doc, null, at, term, impacts
        order = np.lexsort((-impacts, term))
        self.list_doc = np.repeat(np.arange(len(doc)), np.diff(at))[order]
        self.list_impact = impacts[order]
        self.present, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.seen = np.zeros(len(doc), dtype=bool)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Random access: whole scores from the forward index."""
        sizes = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.at[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.term[where]] * self.impacts[where], ends - sizes)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """``weights`` has the weight of every term, times its occurrences in the query; zero elsewhere."""
        k = np.searchsorted(self.present, terms)
        k = k[(k < len(self.present)) & (self.present[np.minimum(k, len(self.present) - 1)] == terms)] if len(self.present) else k[:0]
        at, stop = self.starts[k], self.starts[k + 1]
        unit = weights[self.present[k]]
        turn, met = TURN, []
        while len(at):
            new = np.unique(np.concatenate([self.list_doc[a : min(a + turn, z)] for a, z in zip(at.tolist(), stop.tolist(), strict=True)]))
            new = new[~self.seen[new]]
            if len(new):
                self.seen[new] = True
                met.append(new)
                best.add(self.scores(new, weights), self.doc[new], self.null[new])
            at = at + turn
            left = at < stop
            at, stop, unit = at[left], stop[left], unit[left]
            if int((unit * self.list_impact[at]).sum()) < best.bound:
                break
            turn = min(2 * turn, 64 * TURN)
        for new in met:
            self.seen[new] = False


class Queries:
    """The queries of one pass and their vocabulary."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [Counter(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws) for _, ws in items]


def _groups(queries: DataFrame, limit: int) -> Iterator[Queries]:
    """Queries in groups of at most ``limit`` terms, read partition by partition."""
    items, total = [], 0
    for row in queries.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").toLocalIterator():
        ws = words(row["text"])
        if total and total + len(ws) > limit:
            yield Queries(items)
            items, total = [], 0
        if ws:
            items.append((row["item_id"], ws))
            total += len(ws)
    if items:
        yield Queries(items)


def forward(docs: DataFrame, queries) -> DataFrame:
    """doc_id, n, term, tf: the broadcast queries' terms in each document that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value.vocabulary.get
        for batch in batches:
            n, terms, counts = [], [], []
            for text in values(batch.column(1)):
                ws = words(text)
                ids = np.fromiter(map(known, ws, repeat(-1)), dtype=np.int32, count=len(ws))
                term, tf = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(ws))
                terms.append(term)
                counts.append(tf)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array(np.array(n, dtype=np.int64) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _frequencies(index: DataFrame, size: int) -> dict[int, int]:
    """Documents a term is in; a row a term and task is summed, a number a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    return {r["term"]: r["df"] for r in index.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _searched(index: DataFrame, queries, weights, docs: int, terms: int, k: int, block: int) -> DataFrame:
    """item, item_id, doc_id, score: the best of each task."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten())
            if size >= block:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> Block:
        part = pa.Table.from_batches(held).combine_chunks()
        doc, n, term, tf = (part.column(c).chunk(0) for c in range(4))
        sizes = np.diff(term.offsets.to_numpy())
        length = np.repeat(n.to_numpy(), sizes)
        return Block(
            doc.fill_null(0).to_numpy(),
            doc.is_null().to_numpy(zero_copy_only=False),
            np.append(0, np.cumsum(sizes)),
            term.flatten().to_numpy(),
            impact(tf.flatten().to_numpy(), length, docs, terms),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight_of = queries.value, weights.value
        best = [Best(k) for _ in asked.terms]
        dense = np.zeros(len(weight_of), dtype=np.int64)
        for part in blocks(batches):
            for held, counts in zip(best, asked.terms, strict=True):
                mine = np.fromiter(counts, dtype=np.int64, count=len(counts))
                dense[mine] = weight_of[mine] * np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                part.search(np.sort(mine[dense[mine] > 0]), dense, held)
                dense[mine] = 0
        sizes = [len(b.score) for b in best]
        doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
        item = np.repeat(np.arange(len(best)), sizes)
        names = pa.array(asked.names, pa.string()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([pa.array(item), names, doc, pa.array(np.concatenate([b.score for b in best]))], names=["item", "item_id", "doc_id", "score"])

    return index.select("doc_id", "n", "term", "tf").mapInArrow(run, "item long, item_id string, doc_id long, score long")


def report(docs: DataFrame, queries: DataFrame, k: int = TOP, limit: int = MAX_TERMS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query with a score above 0."""
    sc, kind = docs.sparkSession.sparkContext, queries.schema["item_id"].dataType
    found = []
    for asked in _groups(queries, limit):
        shared = sc.broadcast(asked)
        index = written(forward(docs, shared))
        total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = _frequencies(index, len(asked.vocabulary))
        weights = np.zeros(len(asked.vocabulary), dtype=np.int64)
        for term, number in df.items():
            weights[term] = weight(total["docs"], number)
        best = _searched(index, shared, sc.broadcast(weights), total["docs"], total["terms"], k, block)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        found.append(best.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
