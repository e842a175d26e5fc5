"""Approximate search over names: a q-gram index with a count filter, then bit-parallel matching.

A query finds the names that few insertions, deletions and substitutions turn into it.
Names and queries are cut into numbered ``q``-grams (the third "an" of a name is another
gram than its first), so that common grams can be counted by equality.  An error
spoils at most ``q`` grams, so of any ``k * q + c`` grams of a query a name within ``k``
errors has ``c`` at least; each query looks up its rarest ``k * q + MORE`` only, and names
of a length within ``k`` that share enough of them are verified by the bitap automaton,
whose state is one number for each count of errors.  Queries that are too short for that bound at ``q = 2`` are looked up by
single characters, and those shorter than their errors by length.

Names that are alike (a few digits apart) share nearly all their grams, so queries of at most
``HALVED`` errors look names up by halves: of that many errors one half of the name has at most one, so it is
equal to a beginning (or end) of the query where a character is taken out of either or both. A half
that very many names and queries share (the end of a name of one kind) leads to the other half, which is halved in its turn.

Different names are one row from the start.  The index is joined by gram, so what grows
with the names is shuffled by gram; a very frequent gram is rarely among a query's rarest
ones, and adaptive execution splits what remains hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.store import stored

#: Errors allowed as a share of the query's length, and at most.
SHARE, MOST = 0.4, 3
#: Grams that a query looks up beyond those that errors can spoil: so many must be shared.
MORE = 6
#: Queries of so many errors at most are looked up by halves, as one half then has one error at most.
HALVED = 3
#: Queries from which, and pairs beyond which, the rows of a half's key meet by the other half too, and how often texts are halved so.
FEW, HOT, LEVELS = 64, 1 << 16, 8


def bitap(pattern: str, text: str, errors: int, whole: bool = True) -> int | None:
    """Fewest errors, up to ``errors``, that turn the pattern into the text, or into a part of it; None if there are more.

    Bit ``i`` of state ``e`` says that the first ``i`` characters of the pattern match, with ``e`` errors, what ends here.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 2 << i
    done = 1 << len(pattern)
    states = [(2 << e) - 1 for e in range(errors + 1)]
    best = next((e for e, s in enumerate(states) if s & done), None) if not whole or not text else None
    for c in text:
        mask = places.get(c, 0)
        fresh = 0 if whole else 1
        before, above = states, []
        for e, s in enumerate(before):
            now = s << 1 & mask | fresh
            if e:
                now |= before[e - 1] | before[e - 1] << 1 | above[e - 1] << 1
            above.append(now)
        states = above
        if not whole:
            found = next((e for e, s in enumerate(states) if s & done), None)
            best = found if best is None else best if found is None else min(best, found)
    return best if not whole else next((e for e, s in enumerate(states) if s & done), None)


def allowed(text: Column, share: float = SHARE, most: int = MOST) -> Column:
    """Errors that a query of this length may have."""
    return F.least(F.floor(F.length(text) * share), F.lit(most)).cast("int")


def numbered(text: Column, q: Column) -> Column:
    """The text's grams of q characters, each with its number among equal ones."""
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.substring(text, i, q))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\0"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda o: o == g)).cast("string")))


def _prepared(queries: DataFrame, share: float, most: int) -> DataFrame:
    """query (different ones), k and q: the errors allowed and the gram size that still bounds them (0: none does)."""
    rows = queries.select("query").where("query IS NOT NULL").distinct().withColumn("k", allowed(F.col("query"), share, most))
    m = F.length("query")
    return rows.withColumn("q", F.when(m - 1 - 2 * F.col("k") >= 1, 2).when(m - F.col("k") >= 1, 1).otherwise(0))


def _without_one(text: Column) -> Column:
    """place, char, rest: the text as it is (place 0), and without the character at each place."""
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("char"), text.alias("rest")))
    cut = lambda i: F.struct(i.alias("place"), F.substring(text, i, 1).alias("char"), F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))).alias("rest"))
    return F.concat(whole, F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), cut)).otherwise(F.array().cast("array<struct<place:int,char:string,rest:string>>")))


def _by_halves(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query, k, name that differ by k at most, for queries of at most ``HALVED`` errors; different pairs."""
    queries = asked.select(F.xxhash64("query").alias("query_id"), F.lit(0).cast("long").alias("bucket"), F.col("query").alias("text"), "k", F.lit(None).cast("string").alias("was"))
    names = known.select(F.xxhash64("name").alias("name_id"), F.lit(0).cast("long").alias("bucket"), F.col("name").alias("text"), F.lit(None).cast("string").alias("was"))
    pairs = reduce(DataFrame.unionByName, _met(queries, names)).distinct()
    rows = pairs.join(asked.select(F.xxhash64("query").alias("query_id"), "query", "k"), "query_id").join(known.select(F.xxhash64("name").alias("name_id"), "name"), "name_id")
    return rows.where(F.levenshtein("query", "name") <= F.col("k")).select("query", "k", "name")


def _met(queries: DataFrame, names: DataFrame, level: int = 1) -> list[DataFrame]:
    """query_id, name_id: texts (query_id, bucket, text, k, was; name_id, bucket, text, was) of one bucket that may differ by k at most.

    A name of n characters is cut in the middle. Its half and the query's piece, of one character more or less at most,
    meet on a hash of what is left; the same place taken out of both is a substitution, so those must have held different
    characters. Texts that may differ by one character at most meet whole. What is left of both texts may differ by the errors that are left. So
    the rows of a key that very many pairs share are a bucket, whose rests meet in the same way: a half that all names share tells nothing alone.
    ``was`` has a substitution's character of the level before.
    """
    m, n, k, side, more = F.length("text"), F.col("n"), F.col("k"), F.col("side"), F.col("more")
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism  # few bytes become many rows
    queries, names = queries.repartition(tasks, "query_id"), names.repartition(tasks, "name_id")
    h = F.floor(n / 2).cast("int")
    key = F.xxhash64("bucket", "side", "n", "v.rest").alias("key")
    sizes = stored(names.select(m.alias("n")).distinct())  # a row a length
    sides = F.when(k <= 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    wanted = queries.withColumn("n", F.explode(F.sequence(F.greatest(m - k, F.lit(0)), m + k))).join(F.broadcast(sizes), "n", "left_semi").withColumn("side", F.explode(sides))
    needed = stored(wanted.select("n", "side").distinct())
    cut = names.withColumn("n", m).join(F.broadcast(needed), "n")
    first, last = F.substring(F.col("text"), F.lit(1), h), F.substring(F.col("text"), h + 1, n)
    cut = cut.withColumn("rest", F.when(side == 0, last).when(side == 1, first).otherwise(""))
    cut = cut.select("*", F.explode(_without_one(F.when(side == 0, first).when(side == 1, last).otherwise(F.col("text")))).alias("v"))
    index = cut.select("name_id", "was", "rest", "side", key, F.col("v.place").alias("place"), F.col("v.char").alias("char"))
    # How many characters more than the name's the query's piece has: none, or one more or less.
    wanted = wanted.withColumn("more", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    wanted = wanted.withColumn("size", F.when(side == 0, h).when(side == 1, n - h).otherwise(n) + more).where((F.col("size") >= 0) & (F.col("size") <= m) & ((side < 2) | (F.col("size") == m)))
    first, last = F.substring(F.col("text"), F.lit(1), F.col("size")), F.substring(F.col("text"), m - F.col("size") + 1, m)
    rest = F.when(side == 0, F.substring(F.col("text"), F.col("size") + 1, m)).when(side == 1, F.substring(F.col("text"), F.lit(1), m - F.col("size"))).otherwise("")
    wanted = wanted.select("*", rest.alias("rest"), F.explode(_without_one(F.when(side == 1, last).otherwise(first))).alias("v"))
    left = k - F.when((more == 0) & (F.col("v.place") == 0), 0).otherwise(1)
    # Of the longer text one character goes, of texts as long none or the same one; the rests' lengths must allow the errors that are left.
    wanted = wanted.where(((more == 1) & (F.col("v.place") > 0)) | ((more == -1) & (F.col("v.place") == 0)) | (more == 0)).where(left >= F.abs(m - n - more))
    lookup = wanted.select("query_id", "was", "rest", "side", "more", left.alias("k"), key, F.col("v.place").alias("place"), F.col("v.char").alias("char"))
    many = stored(lookup.where(side < 2).groupBy("key").agg(F.count("*").alias("asked")).where(F.col("asked") >= FEW))
    hot = stored(index.select("key").join(many, "key").groupBy("key").agg(F.count("*").alias("held"), F.max("asked").alias("asked")).where(F.col("held") * F.col("asked") > HOT).select("key"))
    deeper = level < LEVELS and not hot.isEmpty()
    met = (lookup.join(hot, "key", "left_anti") if deeper else lookup).drop("rest", "side", "k").alias("q").join(index.drop("rest", "side").alias("i"), F.col("q.key") == F.col("i.key"))
    q, i = F.col("q.place"), F.col("i.place")
    met = met.where(F.when(more == 1, i == 0).when(more == -1, i > 0).otherwise((q == i) & ((q == 0) | (F.col("q.char") != F.col("i.char")))))
    met = met.where(F.col("q.was").isNull() | (F.col("q.was") != F.col("i.was"))).select("query_id", "name_id")
    if not deeper:
        return [met]
    # How a pair met is told by its bucket: equal (0), a character taken out of the query's piece (1) or the name's (2), or the same place out of both (3).
    how = F.when(more == 1, 1).when(more == -1, 2).when(F.col("place") == 0, 0).otherwise(3)
    into = lambda rows, how: rows.withColumn("how", how).withColumn("bucket", F.xxhash64("key", "how", F.when(F.col("how") == 3, F.col("place")).otherwise(0))).withColumn("was", F.when(F.col("how") == 3, F.col("char")))
    either = F.explode(F.when(F.col("place") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3))))
    queries = stored(into(lookup.join(hot, "key", "left_semi"), how).select("query_id", "bucket", F.col("rest").alias("text"), "k", "was").distinct())
    names = stored(into(index.join(hot, "key", "left_semi"), either).select("name_id", "bucket", F.col("rest").alias("text"), "was").distinct())
    return [met, *_met(queries, names, level + 1)]


def candidates(queries: DataFrame, names: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """query, k, name: pairs that the index can't rule out."""
    asked = stored(_prepared(queries, share, most))
    known = stored(names.select("name").where("name IS NOT NULL").distinct())
    halved = _by_halves(asked.where(F.col("k") <= HALVED), known)
    return halved if most <= HALVED else halved.unionByName(_by_grams(asked.where(F.col("k") > HALVED), known, most))


def _by_grams(asked: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """query, k, name that share as many grams as names within the errors must."""
    # Single characters only serve queries of at most 2 * most + 1, so names of at most that and their errors.
    single = F.when(F.length("name") <= 3 * most + 1, _of_size(F.col("name"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    index = known.select(F.length("name").alias("n"), "name", F.explode(F.concat(single, _of_size(F.col("name"), F.lit(2)))).alias("gram"))
    index = stored(index)
    lookup = asked.where("q > 0").select("query", "k", "q", F.explode(_of_size(F.col("query"), F.col("q"))).alias("gram"))
    # How many names have a gram, for the grams of queries; unknown ones are the rarest.
    common = index.join(lookup.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
    by_query = Window.partitionBy("query")
    rank = F.row_number().over(by_query.orderBy(F.coalesce("held", F.lit(0)), "gram"))
    rarest = lookup.join(common, "gram", "left").withColumn("r", rank).where(F.col("r") <= F.col("k") * F.col("q") + MORE)
    rarest = stored(rarest.withColumn("need", F.count("*").over(by_query) - F.col("k") * F.col("q")).where("held > 0").select("query", "k", "need", "gram"))
    met = rarest.join(index, "gram").where(F.abs(F.col("n") - F.length("query")) <= F.col("k"))
    met = met.groupBy("query", "k", "need", "name").agg(F.count("*").alias("shared")).where("shared >= need").select("query", "k", "name")
    # Without a gram that must be shared, lengths are at most twice the errors, so these names are few characters long.
    short = asked.where("q = 0").select("query", "k", F.explode(F.sequence(F.greatest(F.length("query") - F.col("k"), F.lit(0)), F.length("query") + F.col("k"))).alias("n"))
    return met.unionByName(short.join(known.select(F.length("name").alias("n"), "name"), "n").select("query", "k", "name"))


def _of_size(text: Column, q: Column) -> Column:
    """The numbered grams of the size, marked with it."""
    return F.when(q == 2, F.transform(numbered(text, F.lit(2)), lambda g: F.concat(F.lit("2"), g))).otherwise(F.transform(numbered(text, F.lit(1)), lambda g: F.concat(F.lit("1"), g)))


def matches(queries: DataFrame, names: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """query, name, errors: every different name (column ``name``) within the errors that the query (column ``query``) may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, k, name = (batch.column(c).to_pylist() for c in range(3))
            errors = pa.array([bitap(a, b, e) for a, e, b in zip(query, k, name, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), errors], names=["query", "name", "errors"]).filter(errors.is_valid())

    return candidates(queries, names, share, most).select("query", "k", "name").mapInArrow(run, "query string, name string, errors int")


def best(queries: DataFrame, names: DataFrame, k: int = 10, share: float = SHARE, most: int = MOST) -> DataFrame:
    """query, rank, name, errors: the k nearest names of each query, ties by name."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("errors", "name"))
    return matches(queries, names, share, most).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "name", "errors")
