"""Watched parents and alerts: requests with outcomes, and new filings that meet who watches.

Whether a pair of user and parent is watched after a request is told by the request
alone, so a request's outcome needs only the one before it of the same pair: all
requests are judged in one window, however many there are.  Watching is kept as spans of
time, which new filings join by parent.
"""

from __future__ import annotations

from hashlib import md5
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from strandline.store import forget, stored, there

#: Tiles that a parent's filings are dealt into before they meet who watches it.
TILES = 32
#: The column that names the spans a noted filing meets.
SPANS = "spans_of"


def outcomes(requests: DataFrame, companies: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """``requests`` (request, user_id, cik, what: add or remove, at) with outcome.

    An addition is ``added``, ``conflict`` if the pair is watched by then, or ``unknown company``;
    a removal is ``removed`` or ``not found``.  ``watched`` has the pairs of before.
    """
    known = companies.select("cik").distinct().withColumn("known", F.lit(True))
    rows = requests.join(known, "cik", "left")
    if watched is not None:
        rows = rows.join(watched.select("user_id", "cik").distinct().withColumn("held", F.lit(True)), ["user_id", "cik"], "left")
    else:
        rows = rows.withColumn("held", F.lit(None).cast("boolean"))
    pair = Window.partitionBy("user_id", "cik").orderBy("at", "request")
    before = F.coalesce(F.lag(F.col("what") == "add").over(pair), F.col("held"), F.lit(False))
    rows = rows.withColumn("before", before)
    outcome = (
        F.when(F.col("known").isNull() & (F.col("what") == "add"), "unknown company")
        .when(F.col("known").isNull(), "not found")
        .when(F.col("what") == "add", F.when(F.col("before"), "conflict").otherwise("added"))
        .otherwise(F.when(F.col("before"), "removed").otherwise("not found"))
    )
    return rows.withColumn("outcome", outcome).drop("known", "held", "before")


def spans(judged: DataFrame) -> DataFrame:
    """user_id, cik, since, until: when pairs were watched, from judged requests; until is null for those still watched."""
    done = judged.where("outcome IN ('added', 'removed')")
    following = F.lead("at").over(Window.partitionBy("user_id", "cik").orderBy("at", "request"))
    return done.withColumn("until", following).where("outcome = 'added'").select("user_id", "cik", F.col("at").alias("since"), "until")


def watchlist(judged: DataFrame, companies: DataFrame) -> DataFrame:
    """user_id, cik, added_at, company_name, num_subsidiaries of what is watched now."""
    return spans(judged).where("until IS NULL").select("user_id", "cik", F.col("since").alias("added_at")).join(companies.select("cik", "company_name", "num_subsidiaries"), "cik", "left")


def _seen() -> Column:
    return (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))


def alerts(filings: DataFrame, watching: DataFrame, tiles: int = TILES, by: tuple[str, ...] = ("cik",), more: tuple[str, ...] = ()) -> DataFrame:
    """alert_id, user_id, cik, at, read, ``more`` (columns of the filing): filings (filing, cik, at; a stream or a table) that someone watches by then.

    The rows are as many as filings times who watches, so a parent's filings are dealt into tiles, each of which meets all its spans.
    ``by`` are the columns that filings and spans must share. Texts are made a filing or a span, not an alert.
    """
    dealt = filings.withColumn("tile", F.pmod(F.xxhash64("filing"), F.lit(tiles))).withColumn("filing", F.col("filing").cast("string")).repartition(8 * tiles, *by, "tile")
    spread = watching.withColumn("user", F.col("user_id").cast("string")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).repartition(8 * tiles, *by, "tile")
    met = dealt.join(spread, [*by, "tile"]).where(_seen())
    return met.select(alert_id(F.col("filing"), F.col("user")).alias("alert_id"), "user_id", "cik", "at", F.lit(False).alias("read"), *more)


def alert_counts(filings: DataFrame, watching: DataFrame) -> DataFrame:
    """``filings`` with alerts: how many they cause, without listing them.

    Spans that began by a filing's time less those that ended by it; the running sums go by hour, and within an hour of a parent.
    """
    keyed = filings.select("cik", "at", F.lit(0).alias("change"), F.struct(*filings.columns).alias("row"))
    began = watching.where("since IS NOT NULL")
    none = F.lit(None).cast(keyed.schema["row"].dataType).alias("row")
    changes = began.select("cik", F.col("since").alias("at"), F.lit(1).alias("change"), none).unionByName(began.where("until IS NOT NULL").select("cik", F.col("until").alias("at"), F.lit(-1).alias("change"), none))
    hours = changes.groupBy("cik", F.date_trunc("hour", "at").alias("hour")).agg(F.sum("change").alias("sum"))
    # An hour without changes has nothing before it here, so the hours of filings are there, too.
    hours = hours.unionByName(filings.where("at IS NOT NULL").select("cik", F.date_trunc("hour", "at").alias("hour"), F.lit(0).cast("long").alias("sum")).distinct()).groupBy("cik", "hour").agg(F.sum("sum").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("cik").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select("cik", "hour", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("cik", "hour").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keyed.unionByName(changes).withColumn("hour", F.date_trunc("hour", "at")).withColumn("within", F.sum("change").over(inside)).where("row IS NOT NULL")
    return rows.join(hours, ["cik", "hour"], "left").select("row.*", F.when(F.col("at").isNotNull(), F.col("before") + F.col("within")).otherwise(0).cast("long").alias("alerts"))


def mark_totals(filings: DataFrame, watching: DataFrame, marks: DataFrame, by_all: Column) -> DataFrame:
    """t (alerts or marks), v (their read flag, or outcome), n: what :func:`marked` makes of the alerts, counted without listing them.

    ``marks`` (filing, user_id) are tries to mark a single alert; every alert of the filings in ``by_all`` is marked by its own user once more.
    A filing's number is its own, so that it and a user name an alert.
    """
    counted = alert_counts(filings.withColumn("whole", F.coalesce(by_all, F.lit(False))), watching)
    sums = counted.agg(F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("alerts"))), F.lit(0)).alias("whole"))
    met = marks.join(filings.withColumn("whole", F.coalesce(by_all, F.lit(False))), "filing").join(watching, ["user_id", "cik"]).where(_seen())
    met = met.groupBy("filing", "user_id", "whole").agg(F.count("*").alias("n"))
    single = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found"), F.count(F.when(~F.col("whole"), 1)).alias("fresh"))
    one = sums.crossJoin(single).crossJoin(marks.agg(F.count("*").alias("marks")))  # a row each
    read = F.col("whole") + F.col("fresh")
    row = lambda t, v, n: F.struct(F.lit(t).alias("t"), F.lit(v).alias("v"), n.alias("n"))
    rows = F.array(row("alerts", "true", read), row("alerts", "false", F.col("alerts") - read), row("marks", "read", F.col("found") + F.col("whole")), row("marks", "not found", F.col("marks") - F.col("found")))
    return one.select(F.inline(rows)).where("n > 0")


def alert_id(filing: Column, user: Column) -> Column:
    """The same for the same filing and user, however often the filing comes."""
    return F.concat_ws("/", filing, user)


def marked(kept: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts with read marks (alert_id, user_id) set, and each mark's outcome: only the user's own alerts can be marked."""
    own = kept.select("alert_id", "user_id").withColumn("there", F.lit(True))
    judged = marks.join(own, ["alert_id", "user_id"], "left").select("alert_id", "user_id", F.when(F.col("there"), "read").otherwise("not found").alias("outcome"))
    done = judged.where("outcome = 'read'").select("alert_id").distinct().withColumn("__mark", F.lit(True))
    return kept.join(done, "alert_id", "left").withColumn("read", F.col("read") | F.coalesce("__mark", F.lit(False))).drop("__mark").select(*kept.columns), judged


def alert_stream(filings: DataFrame, watching: DataFrame, folder: str, checkpoint: str, listed: bool = True) -> StreamingQuery:
    """Start a stream of filings against the watched pairs; filings that come twice add nothing.

    A batch's alerts are a folder of their own, which a repeated batch writes anew; then its filings are noted, and
    no later batch takes those again. So it is filings that are compared, of which there are few, not alerts.
    If not ``listed``, no alerts are written, which are as many as filings times who watches: the spans that the stream was
    started with are kept, and :func:`noted_alerts` lists the alerts of all filings noted.
    """
    run, spans_of = md5(checkpoint.encode()).hexdigest()[:8], f"s{uuid4().hex}"
    if not listed:
        watching.write.parquet(f"{folder}/_watching/{SPANS}={spans_of}")

    def batch(rows: DataFrame, number: int) -> None:
        spark, name = rows.sparkSession, f"batch={run}-{number}"
        noted = f"{folder}/_filings"
        new = rows.dropDuplicates(["filing"])
        if there(spark, noted):
            seen = spark.read.option("basePath", noted).schema(StructType([rows.schema["filing"], StructField("batch", StringType())])).parquet(noted)
            new = new.join(seen.where(F.col("batch") != f"{run}-{number}").select("filing"), "filing", "left_anti")
        if not listed:
            new.withColumn(SPANS, F.lit(spans_of)).write.mode("overwrite").parquet(f"{noted}/{name}")
            return
        new = stored(new)
        alerts(new, watching).write.mode("overwrite").parquet(f"{folder}/{name}")
        new.select("filing").write.mode("overwrite").parquet(f"{noted}/{name}")
        forget(new)

    return filings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def noted_alerts(spark: SparkSession, folder: str, **made: Column) -> DataFrame:
    """The alerts of what streams noted in the folder, each filing by the spans of its own stream; ``made`` are further columns, of filing, cik and at."""
    filings, watching = spark.read.parquet(f"{folder}/_filings").drop("batch"), spark.read.option("basePath", f"{folder}/_watching").parquet(f"{folder}/_watching")
    return alerts(filings.select("*", *(c.alias(n) for n, c in made.items())), watching, by=("cik", SPANS), more=tuple(made))
