"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text into ``2 ** bits`` buckets;
tasks add up before their shuffle, so what moves is one array of counts a
language, block and task.  The matrix of log probabilities (languages times
buckets) is broadcast, ``MAX_LANGUAGES`` languages at a time, and batches are scored
as a sparse matrix of counts times the dense one (:func:`scores_of`).

Defined results: a null text or one without letters is ``und`` with score 0 and
teaches nothing; rows with null labels aren't learned from; a null ``doc_id``
hashes as the empty string; ties go to the language that sorts first; without any
labelled text all are ``und``; repeated rows count each; further columns are ignored;
a very long text is counted and scored whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import values, written

BITS = 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of one broadcast matrix (8 bytes a language and bucket); more take more passes.
MAX_LANGUAGES = 256
UNKNOWN = "und"

_BLOCK = 4096
#: Rows of the matrix gathered at once.
_GATHER = 1 << 16
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def buckets(text: str, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Buckets of all n-grams of a text, white space folded and lower-cased."""
    text = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * _MULTIPLY[k % 3]
            h ^= h >> np.uint64(29)
        out.append((h * _MULTIPLY[0]) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counted(rows: DataFrame, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """lang, texts, counts (n-grams of each bucket, as pairs k, c): a row a language and block of buckets, written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = [(lang, at, texts[lang] if at == 0 else 0, total[at : at + _BLOCK].tolist()) for lang, total in sums.items() for at in range(0, 1 << bits, _BLOCK)]
            lang, at, n, c = zip(*out, strict=True) if out else ((), (), (), ())
            sums.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.list_(pa.int64()))], names=["lang", "at", "texts", "counts"])

        for batch in batches:
            for text, lang in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                if has_letters(text):
                    if lang not in sums and len(sums) == MAX_LANGUAGES:
                        yield flush()
                    total = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    total += np.bincount(buckets(text, bits, sizes), minlength=1 << bits)
                    texts[lang] = texts.get(lang, 0) + 1
        yield flush()

    parts = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, at long, texts long, counts array<long>")
    # Rows of a task are already sums: at most languages x blocks of them a task.
    summed = (
        parts.select("lang", "at", "texts", F.posexplode("counts").alias("k", "c"))
        .groupBy("lang", "at", "k")
        .agg(F.sum("c").alias("c"), F.sum("texts").alias("texts"))
        .where("c > 0 OR k = 0")
        .groupBy("lang", "at")
        .agg(F.max("texts").alias("texts"), F.collect_list(F.struct("k", "c")).alias("counts"))
    )
    return written(summed)


def models(counts: DataFrame, bits: int = BITS, most: int = MAX_LANGUAGES) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages, in order, and their log-probability matrix (buckets, then the prior), for at most ``most`` languages at a time."""
    total = counts.agg(F.sum("texts")).first()[0]
    after = None
    while True:
        rest = counts.select("lang").distinct()
        rest = rest.where(F.col("lang") > after) if after is not None else rest
        names = [r["lang"] for r in rest.orderBy("lang").limit(most).collect()]
        if not names:
            return
        sums, texts = np.zeros((len(names), 1 << bits)), np.zeros(len(names))
        where = {lang: k for k, lang in enumerate(names)}
        for r in counts.where(F.col("lang").between(names[0], names[-1])).toLocalIterator():
            row = where[r["lang"]]
            texts[row] += r["texts"]
            for k, c in r["counts"]:
                sums[row, r["at"] + k] = c
        logp = np.log(sums + SMOOTHING) - np.log(sums.sum(axis=1, keepdims=True) + SMOOTHING * (1 << bits))
        yield names, np.vstack([logp.T, np.log(texts / total)[None, :]])
        after = names[-1]


def scores_of(texts: Iterable[str | None], n: int, matrix: np.ndarray, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Log scores of ``n`` texts, texts x languages; NaN where a text is null or has no letters.

    The batch is one sparse matrix of counts, kept as runs of (bucket, count) text by
    text, times the dense one: rows of the matrix are gathered in blocks and added up by text.
    """
    out = np.full((n, matrix.shape[1]), np.nan)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        starts = np.cumsum([0, *(len(used) for _, used, _ in held[:-1])])
        used, seen = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        out[[h[0] for h in held]] = np.add.reduceat(matrix[used] * seen[:, None], starts, axis=0) + matrix[-1]

    for k, text in enumerate(texts):
        if has_letters(text):
            used, seen = np.unique(buckets(text, bits, sizes), return_counts=True)
            held.append((k, used, seen))
            size += len(used)
        if held and size >= _GATHER:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


_STATE = "__lang string, __best double, __rest double"


def _scored(rows: DataFrame, model: tuple[list[str], np.ndarray], bits: int, sizes: tuple[int, ...], first: bool) -> DataFrame:
    """``rows`` with the best language so far, its log score, and the log of the sum of exponentials of all scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.columns if first else rows.columns[:-3]
    at = kept.index("text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept) + f", {_STATE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            logs = scores_of(values(batch.column(at)), batch.num_rows, matrix, bits, sizes)
            some = ~np.isnan(logs[:, 0])
            best = np.where(some, np.nan_to_num(logs).argmax(axis=1), 0)
            top = logs[np.arange(len(logs)), best]
            rest = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
            lang = np.array([*names, None], dtype=object)[np.where(some, best, -1)]
            if not first:  # of equal scores the language that sorts first, which an earlier pass had
                old, before, sums = (batch.column(len(kept) + k) for k in range(3))
                before, sums = before.to_numpy(zero_copy_only=False), sums.to_numpy(zero_copy_only=False)
                lang = np.where(some & (top > before), lang, old.to_numpy(zero_copy_only=False))
                top, rest = np.maximum(top, before), np.logaddexp(rest, sums)
            cols = [pa.array(lang, pa.string()), pa.array(top), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *cols], names=[*kept, "__lang", "__best", "__rest"])

    return rows.mapInArrow(run, ddl)


def predict(rows: DataFrame, counts: DataFrame, bits: int = BITS, sizes: tuple[int, ...] = SIZES, most: int = MAX_LANGUAGES) -> DataFrame:
    """``rows`` (whose column ``text`` is read) without it, with lang_pred and score.

    A pass over the rows for every ``most`` languages; one is the usual case.
    """
    out, passes = rows, 0
    pending = models(counts, bits, most)
    model = next(pending, None)
    while model is not None:
        following = next(pending, None)
        out = _scored(out, model, bits, sizes, passes == 0)
        out = out if following is None else written(out)
        model, passes = following, passes + 1
    if not passes:
        out = rows.withColumns({"__lang": F.lit(None).cast("string"), "__best": F.lit(None).cast("double"), "__rest": F.lit(None).cast("double")})
    score = F.when(F.col("__lang").isNotNull(), F.exp(F.col("__best") - F.col("__rest"))).otherwise(0.0)
    return out.withColumns({"lang_pred": F.coalesce("__lang", F.lit(UNKNOWN)), "score": score}).drop("text", "__lang", "__best", "__rest")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from texts whose id hashes outside fold 2 of 4."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 2).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = counted(rows.where("NOT held_out").select("text", "lang"))
    return predict(rows.drop("lang"), counts)
