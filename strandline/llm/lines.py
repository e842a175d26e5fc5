"""Fuzzy line dedup by MinHash, with built-in functions only.

All lines that aren't blank, trimmed and lower-cased, take part.  Different lines become one
row each first, grouped by their text, whatever their length: such a row has a number of
its own and the first place of the line.  A line's signature are the first of
``BANDS * ROWS`` hash orders over all its shingles of ``SHINGLE`` bytes: ``STEP`` shingles
at a time are a row, whose smallest and largest hashes are combined per line before they
are shuffled.  Each band files the line; per file the smallest and the largest
member are leaders, found by a combined aggregation, and every member is a candidate
with each.  Of those, pairs that agree in at least ``AGREE`` of their hash orders (fewer than
one pair in a thousand of the similarity asked for doesn't) are verified by the exact
Jaccard similarity of their character shingles, and verified links go through distributed contraction to components.  Files
whose members are not one component by then are compared in tiles of ``TILE`` members:
each member with the first of each other component, which joins stars, then, where
several components are left, all pairs but those in one component, with a leader or with such a first.  There,
pairs whose sketches differ too much for the similarity don't leave the join: a sketch has the parities of a line's different shingles
in 1024 places, so two differ in no more places than the sets differ in shingles, and no similar pair is lost.  Of
each component the first occurrence (by document and position) stays.

At the similarity asked for, a pair shares a file with probability
``1 - (1 - 0.8 ** ROWS) ** BANDS`` (0.991), counted in bytes; tests hold the links against
brute force.  The exact similarity is that of shingles of characters.  One changed character costs ``SHINGLE`` shingles on either side, so lines of fewer than
69 characters are near each other only by what is added at an end; lines shorter than a
shingle are equal or different.

Defined results: a null text has no lines; documents with a null id take no part
and are kept as they are; blank lines are never touched; rows that repeat an id
keep what is at a kept position; a document that loses all its lines stays, with
an empty text; ties go to the smaller document id, then position; an empty table
gives an empty result; a very long line is one row like any other, compared whole, and a
document of any length is cut into its lines in its own task; further columns are kept by :func:`keep_first`.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components, forget, maybe_in, tiled, with_maybe, written

SHINGLE = 7
SIMILARITY = 0.8
ROWS = 4
BANDS = 9
#: Shingles of one row on the way to a signature: combining them there costs less than a row each.
STEP = 3
#: Orders in which a pair must agree, of ROWS * BANDS, to be verified: at a similarity of 0.8 a pair that shares a file agrees in 29.6, 2.3 of them up or down.
AGREE = 22
TILE = 1024

_SHINGLES = r"(?s)(?=(.{%d}))" % SHINGLE
#: How tables of hashes are written: nothing makes them smaller.
PLAIN = "uncompressed"

_PLACES = 1 << 31  # positions of a document
_random = random.Random(3)
_MASKS = [_random.getrandbits(64) - (1 << 63) for _ in range((ROWS * BANDS + 1) // 2)]


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def shingles(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_SHINGLES), 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line (normalised) of every line that takes part."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return rows.select("doc_id", "pos", normal(F.col("raw")).alias("line")).where(F.length("line") > 0)


def lines(docs: DataFrame) -> DataFrame:
    """id, line, doc_id, pos (of the first place): a row a different line, written, so that the numbers stay."""
    # Document and position as one number, as a grouped minimum of a pair would have to sort.
    place = F.expr(f"CAST(doc_id AS DECIMAL(20)) * {_PLACES} + pos")
    rows = occurrences(docs).groupBy("line").agg(F.min(place).alias("at"))
    pos = F.expr(f"pmod(at, {_PLACES})")
    return written(rows.select(F.monotonically_increasing_id().alias("id"), "line", F.expr(f"(at - pmod(at, {_PLACES})) DIV {_PLACES}").alias("doc_id"), pos.cast("int").alias("pos")))


def signed(rows: DataFrame) -> DataFrame:
    """id, keys: the band keys of every different line that has a shingle.

    A mask gives two orders, one the reverse of the other: the smallest and the largest masked hash.
    """
    last = F.octet_length("line") - SHINGLE + 1
    cut = rows.select("id", F.col("line").cast("binary").alias("line"), last.alias("last")).where("last > 0")
    cut = cut.select("id", "line", "last", F.explode(F.expr(f"sequence(1, last, {STEP})")).alias("at"))
    hashed = cut.select("id", *(F.expr(f"xxhash64(substring(line, least(at + {k}, last), {SHINGLE}))").alias(f"h{k}") for k in range(STEP)))

    def order(mask: int, of_row, of_line) -> Column:
        return of_line(of_row(*(F.col(f"h{k}").bitwiseXOR(F.lit(mask)) for k in range(STEP))))

    orders = [*(order(m, F.least, F.min) for m in _MASKS), *(order(m, F.greatest, F.max) for m in _MASKS)][: ROWS * BANDS]
    low = hashed.groupBy("id").agg(*(o.alias(f"o{k}") for k, o in enumerate(orders)))
    keys = [F.xxhash64(F.lit(b), *(F.col(f"o{b * ROWS + k}") for k in range(ROWS))) for b in range(BANDS)]
    return low.select("id", F.array(*keys).alias("keys"), *(mark.alias(name) for name, mark in zip(MARKS, _marks(), strict=True)))


#: Columns of a signature's marks: the last 16 bits of four orders each, those of a band.
MARKS = [f"m{k}" for k in range(-(-ROWS * BANDS // 4))]


def _marks() -> list[Column]:
    out = []
    for k in range(len(MARKS)):
        mark = F.lit(0).cast("long")
        for j, o in enumerate(range(4 * k, min(4 * k + 4, ROWS * BANDS))):
            mark = mark.bitwiseOR(F.shiftleft(F.col(f"o{o}").bitwiseAND(F.lit(0xFFFF)), 16 * j))
        out.append(mark)
    return out


def agreeing(a: list[Column], b: list[Column]) -> Column:
    """In how many orders two signatures agree, by their marks."""
    equal = F.lit(0)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        differ = x.bitwiseXOR(y)
        for j in range(min(4, ROWS * BANDS - 4 * k)):
            equal = equal + F.when(F.shiftrightunsigned(differ, 16 * j).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
    return equal


def filed(signatures: DataFrame) -> DataFrame:
    """key, band, id, lo, hi (the smallest and the largest id of the file), marks: each member of the files of several lines."""
    each = signatures.select(F.posexplode("keys").alias("band", "key"), "id", *MARKS)
    leaders = written(each.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi"))
    return maybe_in(each, leaders, "key").join(leaders, "key").select("key", "band", "id", "lo", "hi", *MARKS)


def led(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """a < b: each member of a file with its smallest and its largest member, where they agree in enough orders."""
    heads = written(members.select(F.explode(F.array("lo", "hi")).alias("id")).distinct())
    marks = written(maybe_in(signatures.select("id", *MARKS), heads).join(heads, "id", "left_semi"))
    marks = marks.select(F.col("id").alias("o"), *(F.col(m).alias(f"{m}_o") for m in MARKS))
    pairs = members.select("id", *MARKS, F.explode(F.array("lo", "hi")).alias("o")).where("id <> o").join(marks, "o")
    pairs = pairs.where(agreeing([F.col(m) for m in MARKS], [F.col(f"{m}_o") for m in MARKS]) >= AGREE)
    return pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def candidates(signatures: DataFrame) -> DataFrame:
    """The first candidates, a < b."""
    return led(written(filed(signatures)), signatures)


#: Columns of a sketch: parities, 64 to a number.
PARITIES = [f"s{k}" for k in "abcdefghijklmnop"]


def sketched(texts: DataFrame) -> DataFrame:
    """id, size, parities: how many different shingles a line (id, line) has, and of each place the parity of those that fall there."""
    sets = texts.select("id", F.array_distinct(hashes(F.col("line"))).alias("set")).select("id", F.size("set").cast("long").alias("size"), F.explode_outer("set").alias("h"))
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 4) & 63 AS INT))")
    word = F.expr("h & 15")
    return sets.groupBy("id").agg(F.max("size").alias("size"), *(F.coalesce(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))), F.lit(0)).alias(s) for k, s in enumerate(PARITIES)))


def may_be_similar(similarity: float) -> Column:
    """False only of pairs that surely don't have the similarity, by the sizes and parities of both (the other's columns end in 2)."""
    share = round(similarity * 1000)
    n, m = F.col("size"), F.col("size2")
    differ = F.lit(0)
    for s in PARITIES:
        differ = differ + F.bit_count(F.col(s).bitwiseXOR(F.col(f"{s}2")))
    return (F.least(n, m) * 1000 >= F.greatest(n, m) * share) & (differ * (1000 + share) <= (n + m) * (1000 - share))


def parted(rows: DataFrame, members: DataFrame, linked: DataFrame, sketches: list[DataFrame] | None = None) -> DataFrame:
    """key, band, id, component, first (the smallest id of the component there), marks, sketch: members of files that hold several components besides leaders.

    ``sketches`` keeps the tables of sketches and of firsts from one call to the next: with more links fewer files hold several components, so
    its lines are enough, and who was a component's first there has been compared with all the others.
    """
    sketches = [] if sketches is None else sketches
    members = members.where("id <> lo AND id <> hi")
    if sketches:
        members = members.join(sketches[1], ["key", "id"], "left_anti")
    named = members.join(linked, F.col("id") == F.col("node"), "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"), *MARKS)
    still = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    named = written(named.join(still, "key", "left_semi"), PLAIN)
    firsts = named.groupBy("key", "component").agg(F.min("id").alias("first"))
    if not sketches:
        sketches += written(sketched(_texts(rows, named.select("id").distinct())), PLAIN), written(firsts.select("key", F.col("first").alias("id")))
    parts = written(named.join(firsts, ["key", "component"]).join(sketches[0], "id").select("key", "band", "id", "component", "first", *MARKS, "size", *PARITIES), PLAIN)
    forget(named)
    return parts


def others(parts: DataFrame, whole: bool = True, tile: int = TILE, similarity: float = SIMILARITY) -> DataFrame:
    """a < b: pairs of members of a file that are in two components, may be similar and agree in enough orders, all of them or those with the first of a component."""
    units = written(tiled(parts.withColumn("first", F.col("first") == F.col("id")), tile))
    right = units.where("side <> 1").select("key", "t", "u", *(F.col(c).alias(f"{c}2") for c in ("side", "id", "component", "first", *MARKS, "size", *PARITIES)))
    left, right = units.where("side < 2").alias("l"), right.alias("r")
    near = may_be_similar(similarity) & (agreeing([F.col(m) for m in MARKS], [F.col(f"{m}2") for m in MARKS]) >= AGREE)
    other = F.expr("component <> component2 AND (side = 1 AND side2 = 2 OR side = 0 AND side2 = 0 AND id < id2)")
    if whole:
        # A band's four orders are one mark, so a pair is taken in the first of the files it shares.
        for k, mark in enumerate(MARKS[:-1]):
            other = other & ((F.col("band") <= k) | (F.col(mark) != F.col(f"{mark}2")))
    else:
        other = other & F.expr("first OR first2")
    # One condition of the join, so that no pair leaves it that won't be verified.
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.t") == F.col("r.t")) & (F.col("l.u") == F.col("r.u")) & other & near)
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def grouped(rows: DataFrame, signatures: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """node, component of the lines that have links. ``signatures`` is a written table, deleted when it has been used."""
    members = written(filed(signatures), PLAIN)
    pairs = written(led(members, signatures))
    forget(signatures)
    linked = written(components(verified(rows, pairs, similarity)))
    sketches: list[DataFrame] = []
    for whole in (False, True):
        parts = parted(rows, members, linked, sketches)
        if parts.isEmpty():
            break
        more = verified(rows, written(others(parts, whole, tile, similarity)), similarity)
        forget(parts)
        if not more.isEmpty():
            linked = written(components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    for done in (members, *sketches):
        forget(done)
    return linked


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line of these ids."""
    ids = written(ids)
    return maybe_in(rows.select("id", "line"), ids).join(ids, "id", "left_semi")


def verified(rows: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose lines have the exact similarity over all character shingles, written.

    Neither join side is dealt by hand, so that adaptive execution can split the pairs of a line that leads a large file.
    """
    texts = written(_texts(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    text = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"l{c}"))
    found = written(pairs.join(text("a"), "a").join(text("b"), "b").where(_similar(F.col("la"), F.col("lb"), similarity)).select("a", "b"))
    forget(texts)
    return found


def hashes(line: Column) -> Column:
    """Of all shingles, repeats included; where bytes are characters, they are cut as bytes, which takes a fraction of the time."""
    plain = line.cast("binary")
    starts = F.when(F.length(line) >= SHINGLE, F.sequence(F.lit(1), F.length(line) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda k: F.xxhash64(F.substring(plain, k, F.lit(SHINGLE))))
    wide = F.transform(shingles(line), lambda s: F.xxhash64(s.cast("binary")))
    return F.when(F.octet_length(line) == F.length(line), cut).otherwise(wide)


def _similar(la: Column, lb: Column, similarity: float) -> Column:
    """Whether two lines have the similarity.

    The shingles are fields of a struct that a lambda reads, so each are made once; a filter
    over plain columns would repeat their making at every use. Intersection and union drop repeats themselves.
    """
    share = round(similarity * 1000)  # whole numbers, so that the bound itself counts

    def test(pair: Column) -> Column:
        common, all_of = (F.size(f(pair["a"], pair["b"])).cast("long") for f in (F.array_intersect, F.array_union))
        return common * 1000 >= share * all_of

    return F.get(F.transform(F.array(F.struct(hashes(la).alias("a"), hashes(lb).alias("b"))), test), F.lit(0))


def _lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines: the different positions of lines that take part, over all rows of an id."""
    blank = F.filter(F.transform(F.split("text", "\n"), normal), lambda line: F.length(line) > 0)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.size(blank).cast("long").alias("n"))
    once = rows.groupBy("doc_id").agg(F.max("n").alias("n_lines"), F.count("*").alias("rows")).where("n_lines > 0")
    once = written(once)
    several = once.where("rows > 1").select("doc_id")
    if several.isEmpty():
        return once.select("doc_id", "n_lines")
    places = occurrences(docs).join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.countDistinct("pos").alias("n_lines"))
    return once.where("rows = 1").select("doc_id", "n_lines").unionByName(places)


def _kept(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, kept: positions of the lines that stay, of documents that keep some; written."""
    rows = lines(docs)
    linked = grouped(rows, written(signed(rows), PLAIN), similarity)
    named = rows.select("id", "doc_id", "pos").join(linked, F.col("id") == F.col("node"), "left")
    alone = named.where("component IS NULL").select("doc_id", "pos")
    place = F.expr(f"CAST(doc_id AS DECIMAL(20)) * {_PLACES} + pos")
    heads = named.where("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("at"))
    heads = heads.select(F.expr(f"(at - pmod(at, {_PLACES})) DIV {_PLACES}").alias("doc_id"), F.expr(f"CAST(pmod(at, {_PLACES}) AS INT)").alias("pos"))
    kept = written(alone.unionByName(heads).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("kept")))
    forget(rows)
    return kept


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (that take part), n_removed: a row a document."""
    kept = _kept(docs, similarity).select("doc_id", F.size("kept").alias("stay"))
    counts = written(_lines_of(docs).join(kept, "doc_id", "left").select("doc_id", "n_lines", (F.col("n_lines") - F.coalesce("stay", F.lit(0))).alias("n_removed")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without repeated lines, all columns kept."""
    kept = _kept(docs, similarity)
    changed = written(_lines_of(docs).join(kept, "doc_id", "left").where(F.col("n_lines") > F.coalesce(F.size("kept"), F.lit(0))).select("doc_id", "kept"))
    # Documents that surely lose nothing pass by; the others meet their kept positions.
    keyed = with_maybe(docs.withColumn("__id", F.col("doc_id").cast("long")), changed.select(F.col("doc_id").alias("__id")), "__id", "__changed")
    same = keyed.where("NOT __changed").select(*(F.col(f"`{c}`") for c in docs.columns))
    lists = changed.select(F.col("doc_id").alias("__doc"), F.coalesce("kept", F.array().cast("array<int>")).alias("__kept"))
    joined = keyed.where("__changed").join(lists, F.col("__id") == F.col("__doc"), "left")
    stays = lambda line, i: (F.length(normal(line)) == 0) | F.array_contains(F.col("__kept"), i)
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
    return same.unionByName(joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)))
