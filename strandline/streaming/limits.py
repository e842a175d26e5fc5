"""Request limits: daily quotas, counts over the last minute, and the limiter that forgets what it rejects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_quota(events: DataFrame, key: str = "user_id", at: str = "ts", quota: int = 100) -> DataFrame:
    """key, day, requests, over: a tumbling day in UTC; runs on a stream with a watermark too."""
    counted = events.groupBy(key, F.window(at, "1 day").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "requests", (F.col("requests") > quota).alias("over"))


def rolling_count(events: DataFrame, key: str = "user_id", at: str = "ts", seconds: int = 60) -> DataFrame:
    """``events`` with recent: events of the key in the seconds up to and with the event."""
    order = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(order).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(frame))


def usage(events: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """key, total, last_day (events on the last day there is)."""
    last = events.agg(F.max(F.to_date(at)).alias("last"))
    rows = events.join(F.broadcast(last))  # one row
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.sum((F.to_date(at) == F.col("last")).cast("long")).alias("last_day"))


class _Limiter:
    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def admit(self, held: list[float], times: list[float]) -> tuple[list[bool], list[float]]:
        """Which of the times are let in; only those count against later ones."""
        out = []
        for t in times:
            held = [h for h in held if h > t - self.seconds]
            ok = len(held) < self.most
            if ok:
                held.append(t)
            out.append(ok)
        return out, held


def limited(events: DataFrame, key: str = "user_id", at: str = "ts", most: int = 60, seconds: float = 60.0) -> DataFrame:
    """key, at, allowed for a stream: at most so many admitted events in any window of the seconds.

    The state of a key is the admitted times still in the window, at most ``most`` numbers.
    """
    limiter = _Limiter(most, seconds)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values(at)
            allowed, held = limiter.admit(held, [t.timestamp() for t in pdf[at]])
            yield pd.DataFrame({key: [k[0]] * len(pdf), at: pdf[at].to_numpy(), "allowed": allowed})
        state.update((held,))

    kinds = dict(events.select(key, at).dtypes)
    return events.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {at} {kinds[at]}, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)
