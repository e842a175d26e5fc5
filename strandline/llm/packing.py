"""Packing by concatenate and cut.

Pass one tokenises every document once and writes, per document, its ids (two
bytes each, four for a vocabulary of more than 65,536) and its offset among the documents of its task.  The per-task token
totals are one small row a task; their prefix sum turns task offsets into global
offsets.  Pass two cuts every document where its global interval crosses a
multiple of the window; a document that crosses one becomes boundary records.

Defined results: a null text is an empty one; an empty document is the end id
alone; repeated rows, repeated or null ``doc_id`` are documents of their own; an
empty table gives no pieces; further columns are ignored; a very long text is
tokenised whole by one task, which holds it and its ids, and becomes many pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

END_ID = 1
WINDOW = 2048
#: Entries of the word cache of one Python worker (about 150 bytes each); it is emptied when full.
CACHE_ENTRIES = 600_000

# Characters for which the vocabulary's normaliser and pre-tokeniser act on each
# blank-separated word alone: printable ASCII and composed Latin and Cyrillic letters.
_OTHER = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u0410-\u044f]|<\\|")
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017e\u0430-\u044f]+|[^a-z\u00df-\u00f6\u00f8-\u017e\u0430-\u044f\\s]+")
_workers: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str] | None:
    """The words of a text whose ids are the ids of its words, joined; None if that isn't certain.

    Letter runs and runs of other visible characters are always split from each
    other by the vocabulary's pre-tokeniser.  An apostrophe may bind to the
    letters after it: a text that has one is split at blanks alone.  A text with
    characters outside ``_OTHER``'s complement, or the mark of a special token,
    is left to the tokenizer as a whole.
    """
    if _OTHER.search(text):
        return None
    if "'" in text:
        return text.split()
    return _RUNS.findall(text.lower())


def id_form(size: int) -> str:
    """How ids of a vocabulary of so many are kept: two bytes, or four where two can't hold them."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encoder(vocabulary: str):
    """texts -> little-endian unsigned ids (:func:`id_form`), with one cache a worker."""
    if vocabulary not in _workers:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(vocabulary)
        size = max(tok.get_vocab().values()) + 1
        ends = np.zeros(size, dtype=bool)
        for token, i in tok.get_vocab().items():
            ends[i] = token.endswith("</w>")
        _workers[vocabulary] = (tok, ends, {})
    tok, ends, cache = _workers[vocabulary]
    form = id_form(len(ends))
    width = np.dtype(form).itemsize

    def plain(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype=form).tobytes()

    def learn(missing: list[str]) -> None:
        letters = [w for w in missing if w.isalpha()]
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            ids = np.array(tok.encode(" ".join(some), add_special_tokens=False).ids, dtype=form)
            cuts = (width * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) == len(some):  # each letter run is one pre-token, which ends in one marked id
                raw = ids.tobytes()
                cache.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        cache.update((w, plain(w)) for w in missing if w not in cache)

    def encode(texts: list[str]) -> list[bytes]:
        parts = [words_of(t) for t in texts]
        missing = {w for ws in parts if ws for w in ws if w not in cache}
        if len(cache) + len(missing) > CACHE_ENTRIES:
            cache.clear()
            missing = {w for ws in parts if ws for w in ws}
        learn(list(missing))
        return [plain(t) if ws is None else b"".join(map(cache.__getitem__, ws)) for t, ws in zip(texts, parts, strict=True)]

    return encode, form


def tokenised(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, two or four bytes each, with the end id), n, task, start_in_task: written to the shared folder."""
    vocabulary = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("task", pa.int64()), ("start_in_task", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode, form), task, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype=form).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [x + tail for x in encode([t or "" for t in part.column(1).to_pylist()])]
                n = np.array([len(x) // len(tail) for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(ids), task)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], schema=schema
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, task long, start_in_task long, n long, ids binary"))


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of ``tokenised`` rows: doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32."""
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    # One row of 16 bytes a task of pass one, so the side that is broadcast is bounded by the number of tasks; no id is shuffled.
    base = totals.select("task", (F.sum("total").over(Window.orderBy("task")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(base), "task").select("doc_id", (F.col("base") + F.col("start_in_task")).alias("at"), "n", "ids")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]
    schema = pa.schema([(c, pa.int64()) for c in names[:-1]] + [("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, at, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                width = len(ids) // n
                wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    piece = wide[4 * start : 4 * (start + length)]
                    for col, v in zip(cols, (doc, start, length, n, seq, offset, zlib.crc32(piece), ids[width * start : width * (start + length)]), strict=True):
                        col.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", ids binary")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack ``doc_id, text`` rows into windows; one row a piece, each id in exactly one.

    Sequences are numbered from 0 and full but for the last, so at most one is padded.
    """
    return cut(tokenised(docs, vocabulary, end_id), window)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (as in the pieces): the packed sequences themselves, each at most a window."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
