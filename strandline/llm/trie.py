"""Prefix trie of conversations.

Turns are known by the MD5 of role and text from the first step on; texts are never
shuffled.  Conversations are rebuilt in one shuffle by the conversation that they begin
with (:func:`rebuilt`), and equal ones become one row with their number, their smallest
id and the digest of their ids (:func:`classes`).  These rows are dealt by the digest of
their first turn.  A subtrie of at most ``LIMIT`` turns goes, with others, to a task that
builds a pointer trie of dictionaries inside ``applyInPandas`` and adds up its nodes in
postorder, without recursion.  A larger one is split: the turns that all its members
share, found from the smallest and the largest of their sequences, become nodes at
once, and the members are dealt again by the turn that follows, round by round until no
subtrie is too large.  The sums of split nodes are taken from their children afterwards,
from the last round to the first.

Bounds: a conversation's digests and sizes (40 bytes a turn) are one row; a bin of
subtries holds about ``LIMIT`` turns, ``LIMIT`` of one subtrie at most unless it is a
single conversation; split nodes are fewer than turns by ``LIMIT`` at any depth.  The ids
of a class are joined in chunks of ``CHUNK`` consecutive ids, whose digest is carried on
from chunk to chunk.

Defined results: a null role or text is empty; turns go by turn (null first), then role,
then digest; repeated rows are turns of their own; rows with a null ``conv_id`` belong to
no conversation; an empty table has no trie, not even a root; texts of any length count
whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

#: Turns of a subtrie that one task builds whole.
LIMIT = 5_000
#: Conversations per base, and the most turns that one takes from its base.
FAMILY, SHARED = 100, 5
#: Consecutive ids in one row of a class's ids.
CHUNK = 1 << 12
#: Rows of split nodes up to which they are broadcast (about 200 bytes each).
SMALL = 10_000
#: Hexadecimal digits of a turn's digest.
WIDTH = 32

_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base, seq: the turns (digest d, code points p) of every conversation in order, a row a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(conv.alias("conv_id"), (conv - conv % FAMILY).alias("base"), "turn", role.alias("r"), digest.alias("d"), F.length(text).alias("p"))
    # By base, which serves the grouping and the window over the family, too; a family is FAMILY conversations (twice that around zero).
    turns = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "r", "d", "p"))).alias("seq"))
    return turns.select("conv_id", "base", F.transform("seq", lambda x: F.struct(x["d"].alias("d"), x["p"].alias("p"))).alias("seq"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, seq: the first h turns of its base conversation, then its own after its first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("seq", 1, SHARED))).over(Window.partitionBy("base"))
    rows = own_turns(conversations).withColumns({"head": head, "h": h})
    first = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("seq", 1, 0)).otherwise(F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    rest = F.slice("seq", F.col("h") + 1, F.size("seq"))
    return rows.select("conv_id", F.concat(first, rest).alias("seq"))


def _ends(ids: DataFrame) -> DataFrame:
    """name, conv_id (the smallest), n, ends: the digest of each name's ids in ascending order.

    ``ids`` has name and conv_id.  The ids of a chunk are joined where they meet, so the
    task that carries a name's digest on reads a row for each chunk.
    """
    chunks = ids.groupBy("name", F.shiftright("conv_id", CHUNK.bit_length() - 1).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("name", "chunk", F.get("ids", F.lit(0)).alias("conv_id"), F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition("name").sortWithinPartitions("name", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, least, number, state = None, None, 0, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if row[0] != name:
                    if name is not None:
                        out.append((name, least, number, state.hexdigest()))
                    name, least, number, state = row[0], row[1], 0, hashlib.sha256()
                else:
                    state.update(b",")
                number += row[2]
                state.update(row[3].encode())
            yield record(out)
        if name is not None:
            yield record([(name, least, number, state.hexdigest())])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["name", "conv_id", "n", "ends"])

    return chunks.select("name", "chunk", "conv_id", "n", "ids").mapInArrow(run, "name string, conv_id long, n long, ends string")


def classes(conversations: DataFrame) -> DataFrame:
    """conv_id (the smallest), n, ends, seq: a row a different rebuilt conversation."""
    rows = written(rebuilt(conversations).withColumn("name", F.sha2(F.array_join(F.transform("seq", lambda x: x["d"]), ""), 256)))
    many = _ends(rows.select("name", "conv_id"))
    return many.select("conv_id", "n", "ends").join(rows.select("conv_id", "seq"), "conv_id")


def _shared(low: Column, high: Column) -> Column:
    """How many leading turns the smallest and the largest sequence, so all between them, share."""
    differs = F.array_position(F.zip_with(low, high, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(low)).cast("int")


def _begin(rows: DataFrame, key: Column, at: Column, up: Column, up_conv: Column) -> DataFrame:
    return rows.select(key.alias("key"), at.cast("int").alias("at"), up.alias("up"), up_conv.alias("up_conv"), "conv_id", "n", "ends", "seq")


def _next(key: Column, at: Column) -> Column:
    """The key of the subtrie below a node: its path's digest."""
    return F.md5(F.concat(key, F.get("seq", at)["d"]).cast("binary"))


def _split(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Members of small subtries, split nodes, and the members below those: the last two are None if no subtrie is too large.

    Members have key (of their subtrie), at (the depth of its top), up and up_conv (key
    and id of the node above), conv_id, n, ends and seq.
    """
    sizes = rows.groupBy("key").agg(F.sum(F.size("seq") - F.col("at") + 1).alias("turns"), F.count("*").alias("members"), F.min("conv_id").alias("top_conv"))
    large = written(sizes.where(f"turns > {limit} AND members > 1").select("key", "top_conv"))
    number = large.count()
    if number == 0:
        return rows, None, None
    # Its size is known; a larger one is shuffled, and adaptive execution can split a hot key's members.
    flagged = rows.join(F.broadcast(large) if number <= SMALL else large, "key", "left")
    small, members = flagged.where("top_conv IS NULL").drop("top_conv"), flagged.where("top_conv IS NOT NULL")
    groups = members.groupBy("key", "at", "up", "up_conv", "top_conv").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.sum("n").alias("n_convs"))
    groups = groups.withColumn("stop", _shared(F.col("low"), F.col("high"))).withColumn("sizes", F.transform(F.expr("slice(low, at, stop - at + 1)"), lambda x: x["p"].cast("long")))
    groups = written(groups.select("key", "at", "stop", "up", "up_conv", F.col("top_conv").alias("conv_id"), "n_convs", "sizes"))
    place = groups.select("key", "stop", F.col("conv_id").alias("top"))
    members = members.drop("top_conv").join(F.broadcast(place) if number <= SMALL else place, "key")
    done = members.where(F.size("seq") == F.col("stop")).select("key", "ends")
    groups = written(groups.join(done, "key", "left"))
    below = members.where(F.size("seq") > F.col("stop"))
    return small, groups, written(_begin(below, _next(F.col("key"), F.col("stop")), F.col("stop") + 1, F.col("key"), F.col("top")))


def subtries(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries in one bin: a pointer trie of dictionaries, added up in postorder without recursion."""
    children: list[dict[str, int]] = []
    depth, conv, count, size, end, parent, above, up = ([] for _ in range(8))

    def node(at: int, owner: int, points: int, under: int, over, key) -> int:
        children.append({})
        for column, value in ((depth, at), (conv, owner), (count, 0), (size, points), (end, _EMPTY), (parent, under), (above, over), (up, key)):
            column.append(value)
        return len(children) - 1

    tops: dict[str, int] = {}
    for row in part.sort_values("conv_id").itertuples(index=False):  # so a node's first member is its smallest
        k = tops.get(row.key)
        if k is None:
            k = tops[row.key] = node(row.at, row.conv_id, int(row.points[row.at - 1]), -1, row.up_conv, row.up)
        count[k] += row.n
        for turn in range(row.at, len(row.points)):
            digest = row.digests[WIDTH * turn : WIDTH * (turn + 1)]
            child = children[k].get(digest)
            if child is None:
                child = children[k][digest] = node(turn + 1, row.conv_id, int(row.points[turn]), k, None, None)
            k = child
            count[k] += row.n
        end[k] = row.ends
    leaves, saved = [int(not c) for c in children], [(n - 1) * s for n, s in zip(count, size, strict=True)]
    for k in range(len(children) - 1, -1, -1):  # children are made after their parents
        if parent[k] >= 0:
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
            above[k] = conv[parent[k]]
    return pd.DataFrame(
        {
            "conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": [len(c) for c in children], "n_leaves": leaves,
            "saved_tokens": saved, "ends_sha256": end, "up": up,
        }
    )


def _built(small: DataFrame, limit: int) -> DataFrame:
    """The nodes of all small subtries; ``up`` is the key of the split node above a top, else null."""
    turns = small.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0)).alias("n")).first()["n"]
    bins = max(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // limit))
    packed = small.select(
        F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), "key", "at", "up", "up_conv", "conv_id", "n", "ends",
        F.array_join(F.transform("seq", lambda x: x["d"]), "").alias("digests"), F.transform("seq", lambda x: x["p"]).alias("points"),
    )
    return written(packed.groupBy("bin").applyInPandas(subtries, _NODE))


def nodes(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node."""
    rows = written(classes(conversations))
    top = rows.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.size("seq") == 0, F.col("ends"))).alias("ends")).where("conv_id IS NOT NULL")
    none = F.lit(None).cast("string")
    root = top.select(F.lit("").alias("key"), F.lit(0).alias("at"), F.lit(0).alias("stop"), none.alias("up"), F.lit(None).cast("long").alias("up_conv"), "conv_id", "n_convs", F.array(F.lit(0).cast("long")).alias("sizes"), "ends")
    root = written(root)
    least = root.first()["conv_id"] if not root.isEmpty() else 0
    below = _begin(rows.where(F.size("seq") > 0), _next(F.lit(""), F.lit(0)), F.lit(1), F.lit(""), F.lit(least).cast("long"))
    rounds, small = [root], []
    while True:
        kept, split, below = _split(below, limit)
        small.append(kept)
        if split is None:
            break
        rounds.append(split)
    together = small[0]
    for more in small[1:]:
        together = together.unionByName(more)
    built = _built(together, limit)
    tops = built.where("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    sums, out = written(tops), built.drop("up")
    under: DataFrame | None = None
    for split in reversed(rounds):
        both = sums if under is None else sums.unionByName(under)
        total = both.groupBy("up").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved"))).withColumnRenamed("up", "key")
        done = split.join(total, "key", "left").withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0)),
                "n_leaves": F.coalesce("n_leaves", F.lit(1)),
                # What is saved at the last node of the shared turns and below it.
                "saved": F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.element_at("sizes", -1),
            }
        )
        done = written(done)
        depth, last = F.col("at") + F.col("i"), F.col("at") + F.col("i") == F.col("stop")
        more = F.aggregate(F.expr("slice(sizes, i + 1, size(sizes) - i - 1)"), F.lit(0).cast("long"), lambda acc, x: acc + x)
        each = done.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("stop") - F.col("at"))))
        out = out.unionByName(
            each.select(
                "conv_id",
                depth.cast("long").alias("depth"),
                F.when(F.col("i") == 0, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                "n_convs",
                F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
                F.col("n_leaves").cast("long").alias("n_leaves"),
                (F.col("saved") + (F.col("n_convs") - 1) * more).alias("saved_tokens"),
                F.coalesce(F.when(last, F.col("ends")), F.lit(_EMPTY)).alias("ends_sha256"),
            )
        )
        whole = F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, x: acc + x)
        under = done.where("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum(F.col("saved") + (F.col("n_convs") - 1) * (whole - F.element_at("sizes", -1))).alias("saved"))
    return out


def report(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return nodes(conversations, limit)


def shared_prefixes(conversations: DataFrame, least: int = 2, limit: int = LIMIT) -> DataFrame:
    """Nodes below the root that at least ``least`` conversations begin with, for prompt caches and for dedup of openings."""
    return nodes(conversations, limit).where((F.col("depth") > 0) & (F.col("n_convs") >= least))
