"""Statistics served from a cache that forgets: after a time, and when told to.

A stream of lookups and invalidations is kept by key with ``transformWithState``.  A lookup
is a hit while the key's entry is younger than the time to live, and is served the number
that was counted when the entry was filled; otherwise it is a miss that counts anew and
fills the entry.  An invalidation empties it.  An entry that reaches its age gives a row
``expired`` once: by a timer when the watermark passes, or, if an event of the key comes
first, before that event.  So the state of a key is one entry and one timer at most, and
a running count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cache(StatefulProcessor):
    """``events`` of a key with at (milliseconds), what (``lookup``, ``invalidate`` or other) become outcomes."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.entry = handle.getValueState("entry", "filled long, n long")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key] * len(rows), **{c: [r[k] for r in rows] for k, c in enumerate(("at", "outcome", "served"))}})

    def _drop(self, filled: int) -> None:
        self.entry.clear()
        self.handle.deleteTimer(filled + self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        n = self.count.get()[0] if self.count.exists() else 0
        held = self.entry.get() if self.entry.exists() else None
        filled, served = (held[0], held[1]) if held else (None, 0)
        first, out = filled, []
        for at, what in pd.concat(rows)[["at", "what"]].sort_values(["at", "what"]).itertuples(index=False):
            n += 1
            if filled is not None and at - filled >= self.ttl:
                out.append((filled + self.ttl, "expired", served))
                filled = None
            if what == "invalidate":
                out.append((at, "invalidated" if filled is not None else "nothing", n))
                filled = None
            elif what == "lookup" and filled is not None:
                out.append((at, "hit", served))
            elif what == "lookup":
                filled, served = at, n
                out.append((at, "miss", served))
        self.count.update((n,))
        if filled != first:
            if first is not None:
                self._drop(first)
            if filled is not None:
                self.entry.update((filled, served))
                self.handle.registerTimer(filled + self.ttl)
        if out:
            yield self._rows(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        filled, served = self.entry.get()
        self.entry.clear()
        yield self._rows(key[0], [(filled + self.ttl, "expired", served)])

    def close(self) -> None:
        pass


def served(events: DataFrame, ttl: int, key: str = "key", at: str = "at", what: str = "what", late: str = "0 seconds") -> DataFrame:
    """key, at, outcome (hit, miss, expired, invalidated, nothing), served, for a stream of events with a timestamp ``at``.

    Events of a key are taken in order of time within a batch, so late ones of up to a batch are in order too.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("time"), F.unix_millis(F.col(at).cast("timestamp")).alias("at"), F.col(what).alias("what"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.withWatermark("time", late).groupBy("key").transformWithStateInPandas(Cache(ttl), f"key {kind}, at long, outcome string, served long", "append", "eventTime")
    return out.select("key", F.timestamp_millis("at").alias("at"), "outcome", "served")


def tallied(outcomes: DataFrame) -> DataFrame:
    """key, hits, misses, expired, invalidated, served: outcomes counted, and the sum of what lookups were given."""
    n = lambda *which: F.sum(F.col("outcome").isin(*which).cast("long"))
    given = F.sum(F.when(F.col("outcome").isin("hit", "miss"), F.col("served")).otherwise(0))
    return outcomes.groupBy("key").agg(n("hit").alias("hits"), n("miss").alias("misses"), n("expired").alias("expired"), n("invalidated").alias("invalidated"), given.alias("served"))
