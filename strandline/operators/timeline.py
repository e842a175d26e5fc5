"""From observations to the presence timeline of every child.

The observations are read and shuffled once, by parent and child: :func:`presence` is
a row a child with its dates, and everything else follows from that table, which is
stored.  Made-up observations lie between two real ones, so spans don't depend on
them; they only add filing dates to their parents.  Date tables are small and keyed by
parent.  The nearest filing before or after a date is a lookup in the parent's filings, as first and last
dates are filings themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import has_entity_suffix
from strandline.store import forget, stored


def presence(obs: DataFrame) -> DataFrame:
    """cik, sub_norm, sub_name, comp_name (of several spellings the smallest), dates (different ones, in order): a row a child."""
    return obs.groupBy("cik", "sub_norm").agg(F.min("sub_name").alias("sub_name"), F.min("comp_name").alias("comp_name"), F.sort_array(F.collect_set("fdate")).alias("dates"))


def together(rows: DataFrame, *by: str) -> DataFrame:
    """A presence table of rows of its columns that may hold a child several times; ``by`` are columns that the parent and child determine."""
    dates = F.sort_array(F.array_distinct(F.flatten(F.collect_list("dates"))))
    return rows.groupBy(*by, "cik", "sub_norm").agg(F.min("sub_name").alias("sub_name"), F.min("comp_name").alias("comp_name"), dates.alias("dates"))


def joined(parts: DataFrame) -> DataFrame:
    """The stored presence table of rows that are nearly always a child each, their dates in order: only children that may be there twice are grouped."""
    parts = stored(parts.select("cik", "sub_norm", "sub_name", "comp_name", "dates").withColumn("__key", F.xxhash64("cik", "sub_norm")))
    twice = stored(parts.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"))
    if twice.isEmpty():
        return parts.drop("__key")
    once, rest = (parts.join(twice, "__key", how).drop("__key") for how in ("left_anti", "left_semi"))
    whole = stored(once.unionByName(together(rest)))
    forget(parts, twice)
    return whole


def gaps(kids: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """:func:`gap_fill` of a presence table; ``dates`` are its parents' real filings, where they are known."""
    dates = kids.select("cik", F.explode("dates").alias("fdate")) if dates is None else dates
    # A child of one year and the next has no gap.
    rows = kids.where(F.year(F.array_max("dates")) - F.year(F.array_min("dates")) > 1)
    # Dates are in order, so a missing year lies between neighbours two years apart.
    late = F.filter("dates", lambda d, k: (k > 0) & (F.year(d) - F.year(F.get("dates", k - 1)) == 2))
    found = rows.select("cik", "sub_norm", "sub_name", "comp_name", F.explode(late).alias("late")).select("cik", "sub_norm", "sub_name", "comp_name", (F.year("late") - 1).alias("year"))
    filed = dates.select("cik", F.year("fdate").alias("year")).distinct()
    return found.join(filed, ["cik", "year"], "left_semi").select("cik", F.make_date("year", F.lit(6), F.lit(30)).alias("fdate"), "comp_name", "sub_name", "sub_norm")


def gap_fill(obs: DataFrame) -> DataFrame:
    """Observations made up where a child is missing in one year in which its parent filed, and present in the years on both sides.

    cik, fdate (the 30th of June), comp_name, sub_name, sub_norm; of several spellings the smallest.
    """
    return gaps(stored(presence(obs)))


def filled(obs: DataFrame) -> DataFrame:
    return obs.select("cik", "fdate", "comp_name", "sub_name", "sub_norm").unionByName(gap_fill(obs))


def filing_dates(obs: DataFrame) -> DataFrame:
    """cik, fdate of observations or of a presence table."""
    return (obs.select("cik", F.explode("dates").alias("fdate")) if "dates" in obs.columns else obs.select("cik", "fdate")).distinct()


def all_filings(kids: DataFrame) -> DataFrame:
    """cik, fdate of a presence table, made-up dates included."""
    # The real dates are written, as they are few: they say in which years a parent filed, too.
    real = stored(filing_dates(kids))
    return real.unionByName(gaps(kids, real).select("cik", "fdate")).distinct()


def neighbours(dates: DataFrame) -> DataFrame:
    """cik, fdate with the filings before and after, and the first and last of the parent."""
    parent = Window.partitionBy("cik")
    order = parent.orderBy("fdate")
    return dates.select("cik", "fdate", F.lag("fdate").over(order).alias("before"), F.lead("fdate").over(order).alias("after"), F.min("fdate").over(parent).alias("earliest"), F.max("fdate").over(parent).alias("latest"))


def spans(obs: DataFrame) -> DataFrame:
    """cik, sub_norm, sub_name, first_seen, last_seen of every child, of observations or of a presence table."""
    if "dates" in obs.columns:
        return obs.select("cik", "sub_norm", "sub_name", F.array_min("dates").alias("first_seen"), F.array_max("dates").alias("last_seen"))
    return obs.groupBy("cik", "sub_norm").agg(F.min("sub_name").alias("sub_name"), F.min("fdate").alias("first_seen"), F.max("fdate").alias("last_seen"))


def bounds(found: DataFrame, dates: DataFrame, suffix_rule: bool = True) -> DataFrame:
    """``spans`` with time_in, time_out and confidence from the parent's filing dates; dates become ISO text.

    Without ``suffix_rule`` a legal ending doesn't raise the confidence, as in incremental merging of old.
    """
    # A parent's filings are one row, which is small, so the children are shuffled by parent once at most.
    parents = stored(dates.groupBy("cik").agg(F.sort_array(F.collect_set("fdate")).alias("__filings")))
    place = lambda c: F.array_position("__filings", F.col(c)).cast("int")
    rows = found.join(parents, "cik").withColumns({"__a": place("first_seen"), "__b": place("last_seen")}).where("__a > 0 AND __b > 0")
    at = lambda k: F.get("__filings", k)
    rows = rows.select("cik", "sub_norm", "sub_name", "first_seen", "last_seen", at(F.col("__a") - 2).alias("before"), at(F.col("__b")).alias("after"), at(F.lit(0)).alias("earliest"), at(F.size("__filings") - 1).alias("latest"))
    iso = lambda c: F.col(c).cast("string")
    opened = (F.col("first_seen") > F.col("earliest")) & F.col("before").isNotNull()
    active = F.col("last_seen") >= F.col("latest")
    closed = ~active & F.col("after").isNotNull()
    time_in = F.when(opened, F.concat(F.lit("Between "), iso("before"), F.lit(" and "), iso("first_seen"))).when(F.col("first_seen") <= F.col("earliest"), F.concat(F.lit("On or before "), iso("earliest"))).otherwise(F.concat(F.lit("On or before "), iso("first_seen")))
    time_out = F.when(active, F.concat(F.lit("Active as of "), iso("latest"))).when(closed, F.concat(F.lit("Between "), iso("last_seen"), F.lit(" and "), iso("after"))).otherwise(F.concat(F.lit("After "), iso("last_seen")))
    known = F.when(opened & (active | closed), "HIGH").when(~opened & ~active & ~closed, "LOW").otherwise("MEDIUM")
    confidence = F.when(has_entity_suffix(F.col("sub_name")), "HIGH").otherwise(known) if suffix_rule else known
    return rows.select("cik", "sub_norm", "sub_name", iso("first_seen").alias("first_seen"), iso("last_seen").alias("last_seen"), time_in.alias("time_in"), time_out.alias("time_out"), confidence.alias("confidence"))


def timeline_of(kids: DataFrame, dates: DataFrame) -> DataFrame:
    """:func:`child_timeline` of a presence table and its filings."""
    return bounds(spans(kids), dates)


def rollup_of(kids: DataFrame, dates: DataFrame) -> DataFrame:
    """:func:`company_rollup` of a presence table and its filings."""
    filings = dates.groupBy("cik").agg(F.count("*").alias("num_filings"), F.min("fdate").alias("first"), F.max("fdate").alias("last"))
    # Counted by name first, as a smallest text alone would have all children sorted.
    names = kids.groupBy("cik", "comp_name").agg(F.count("*").alias("n")).groupBy("cik").agg(F.min("comp_name").alias("company_name"), F.sum("n").alias("num_subsidiaries"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return names.join(filings, "cik").select("cik", "company_name", "num_filings", iso("first").alias("first_filing"), iso("last").alias("last_filing"), "num_subsidiaries")


def child_timeline(obs: DataFrame) -> DataFrame:
    """The timeline of every child: gaps filled first, so made-up dates count as filings, also for other children."""
    kids = stored(presence(obs))
    return timeline_of(kids, stored(all_filings(kids)))


def company_rollup(obs: DataFrame) -> DataFrame:
    """cik, company_name, num_filings, first_filing, last_filing, num_subsidiaries."""
    kids = stored(presence(obs))
    return rollup_of(kids, stored(all_filings(kids)))
