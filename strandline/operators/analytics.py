"""Aggregates over children (``subs``), parents (``companies``) and filing dates.

``subs`` has cik, sub_name, first_seen, last_seen (ISO text), time_in, time_out,
confidence, type, enriched.  Every report is one grouped pass over a pruned scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import is_active

def _active() -> Column:
    return is_active(F.col("time_out"))


def year_of(date: str) -> Column:
    return F.try_to_number(F.substring(date, 1, 4), F.lit("9999")).cast("long")


def _times(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def overview(subs: DataFrame) -> DataFrame:
    """All counts in one pass; a null end counts as active."""
    active = F.col("time_out").isNull() | _active()
    return subs.agg(
        F.count("*").alias("total"),
        *(_times(F.col("confidence") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")),
        _times(active).alias("active"),
        _times(~active).alias("divested"),
        _times(F.col("enriched") == 1).alias("enriched"),
    )


def filing_timeline(dates: DataFrame, subs: DataFrame) -> DataFrame:
    """year, companies_filing, subsidiaries_seen: children (a row each) whose span covers a filing, by the filing's year.

    A row a parent and year, and a row a child and year of its span, meet by equal keys;
    whether a filing lies inside the span is then a look at the parent's dates of that year.
    """
    filed = dates.groupBy("cik", year_of("fdate").alias("year")).agg(F.collect_set("fdate").alias("filings"))
    span = subs.select("cik", "first_seen", "last_seen", F.explode(F.sequence(year_of("first_seen"), year_of("last_seen"))).alias("year"))
    seen = F.exists("filings", lambda d: (F.col("first_seen") <= d) & (F.col("last_seen") >= d))
    children = span.where("first_seen <= last_seen").join(filed, ["cik", "year"]).where(seen).groupBy("year").agg(F.count("*").alias("n"))
    parents = filed.groupBy("year").agg(F.count("*").alias("companies_filing"))
    return parents.join(children, "year", "left").select("year", "companies_filing", F.coalesce("n", F.lit(0)).alias("subsidiaries_seen"))


def timeline_growth(timeline: DataFrame) -> DataFrame:
    """The timeline (one row a year) with running total, change, growth and shares.

    Growth counts a year before without children as one of one child; the first year has none.
    """
    order = Window.orderBy("year")
    all_years = Window.partitionBy()
    n = F.col("subsidiaries_seen")
    before = F.lag(n).over(order)
    base = F.when(F.coalesce(before, F.lit(0)) == 0, 1).otherwise(before)
    growth = F.when(F.lag("year").over(order).isNotNull(), F.round((n - base) * 100.0 / base, 4))
    return timeline.select(
        "year",
        "subsidiaries_seen",
        F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("running_total"),
        F.coalesce(n - before, F.lit(0)).alias("delta"),
        growth.alias("growth_pct"),
        F.round(n / F.max(n).over(all_years), 6).alias("share_of_max"),
        F.round(n * 100.0 / F.sum(n).over(all_years), 1).alias("share_of_total_pct"),
    )


def fastest_growth(growth: DataFrame, k: int = 3) -> DataFrame:
    """The k years of the fastest growth, by year; of equal growth the earlier years."""
    return growth.where("growth_pct IS NOT NULL").orderBy(F.col("growth_pct").desc(), "year").limit(k).orderBy("year").select("year", "growth_pct")


def churn(subs: DataFrame) -> DataFrame:
    """year, added, removed; years of either, missing counts 0. A null end is no removal."""
    added = subs.where("first_seen IS NOT NULL").groupBy(year_of("first_seen").alias("year")).agg(F.count("*").alias("added"))
    removed = subs.where(F.col("last_seen").isNotNull() & ~_active()).groupBy(year_of("last_seen").alias("year")).agg(F.count("*").alias("removed"))
    return added.join(removed, "year", "full_outer").select("year", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def size_distribution(companies: DataFrame, n: str = "num_subsidiaries") -> DataFrame:
    """bucket, companies, smallest: none at all falls among the largest, as the last arm has it."""
    c = F.col(n)
    bucket = F.when(c == 1, "1").when(c.between(2, 5), "2-5").when(c.between(6, 20), "6-20").when(c.between(21, 50), "21-50").when(c.between(51, 100), "51-100").when(c.between(101, 500), "101-500").otherwise("500+")
    return companies.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("companies"), F.min(c).alias("smallest"))


def confidence_by_year(subs: DataFrame) -> DataFrame:
    rows = subs.where("first_seen IS NOT NULL").groupBy(year_of("first_seen").alias("year"))
    return rows.agg(*(_times(F.col("confidence") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")))


def top_churners(subs: DataFrame, companies: DataFrame, k: int = 15) -> DataFrame:
    """Parents by children no longer active."""
    gone = subs.groupBy("cik").agg(F.count("*").alias("total"), _times(_active()).alias("active"), _times(~_active()).alias("divested")).where("divested > 0")
    return gone.join(companies.select("cik", "company_name"), "cik").orderBy(F.col("divested").desc(), "cik").limit(k)


def longevity(subs: DataFrame) -> DataFrame:
    """bucket, children by whole years between first and last sight; unknown spans fall in the last."""
    years = year_of("last_seen") - year_of("first_seen")
    bucket = F.when(years == 0, "Single year").when(years.between(1, 2), "1-2 years").when(years.between(3, 5), "3-5 years").otherwise("6+ years")
    return subs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("children"))


def type_distribution(subs: DataFrame) -> DataFrame:
    return subs.where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("children"))


def type_by_year(subs: DataFrame, since: int = 1994) -> DataFrame:
    """year, type, children."""
    rows = subs.where(F.col("type").isNotNull() & F.col("first_seen").isNotNull() & (F.length("first_seen") >= 4) & (year_of("first_seen") >= since))
    return rows.groupBy(year_of("first_seen").alias("year"), "type").agg(F.count("*").alias("children"))


def type_maps(by_year: DataFrame) -> DataFrame:
    """year, types: a map of counts."""
    return by_year.groupBy("year").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "children")))).alias("types"))


def profiles(subs: DataFrame, companies: DataFrame, dates: DataFrame, ciks: list[str]) -> DataFrame:
    """Up to four parents side by side; unknown ones are left out. A null end is neither active nor gone."""
    ciks = ciks[:4]
    one = subs.where(F.col("cik").isin(ciks)).groupBy("cik").agg(F.count("*").alias("total"), _times(_active()).alias("active"), _times(~_active()).alias("divested"), _times(F.col("confidence") == "HIGH").alias("high"))
    filings = dates.where(F.col("cik").isin(ciks)).groupBy("cik").agg(F.array_join(F.sort_array(F.collect_list("fdate")), ",").alias("filings"))
    return companies.where(F.col("cik").isin(ciks)).select("cik", "company_name").join(one, "cik", "left").join(filings, "cik", "left")


def profile_years(subs: DataFrame, ciks: list[str]) -> DataFrame:
    """cik, year, children first seen: all years of any of the parents, 0 where there are none."""
    rows = subs.where(F.col("cik").isin(ciks[:4]) & F.col("first_seen").isNotNull()).groupBy("cik", year_of("first_seen").alias("year")).agg(F.count("*").alias("n"))
    axis = rows.select("year").distinct().select("year", F.explode(F.array(*map(F.lit, ciks[:4]))).alias("cik"))
    return axis.join(rows, ["cik", "year"], "left").select("cik", "year", F.coalesce("n", F.lit(0)).alias("children"))


def overlap(subs: DataFrame, one: str, other: str, most: int = 100) -> DataFrame:
    """Children of two parents with equal names but for case."""
    side = lambda cik, p: subs.where(F.col("cik") == cik).select(F.lower("sub_name").alias("name"), F.col("sub_name").alias(f"{p}_name"), F.col("first_seen").alias(f"{p}_first_seen"))
    return side(one, "a").join(side(other, "b"), "name").orderBy("name", "a_name", "b_name").limit(most)


def ma_events(subs: DataFrame, cik: str, each: int = 50, most: int = 100) -> DataFrame:
    """Appearances and disappearances of a parent's children, latest first."""
    rows = subs.where(F.col("cik") == cik)
    took = rows.where("first_seen IS NOT NULL").orderBy(F.col("first_seen").desc(), "sub_name").limit(each)
    took = took.select("sub_name", F.col("first_seen").alias("event_date"), F.lit("acquisition").alias("event_type"), "confidence", "time_in")
    gave = rows.where(F.col("time_out").isNotNull() & ~_active()).orderBy(F.col("last_seen").desc(), "sub_name").limit(each)
    gave = gave.select("sub_name", F.col("last_seen").alias("event_date"), F.lit("divestiture").alias("event_type"), "confidence", "time_out")
    return took.unionByName(gave, allowMissingColumns=True).orderBy(F.col("event_date").desc(), "event_type", "sub_name").limit(most)


def recent_window(dates: DataFrame, cik: str, before: int = 30, after: int = 30, years: int = 5, fallback: int = 5) -> DataFrame:
    """first_day, last_day around the filings of the last years, or the last few filings if there are none (fdate ISO text)."""
    mine = dates.where(F.col("cik") == cik).select(F.to_date("fdate").alias("d"))
    ranked = mine.select("d", F.max("d").over(Window.partitionBy()).alias("last"), F.row_number().over(Window.orderBy(F.col("d").desc())).alias("r"))
    fresh = F.col("d") >= F.date_sub("last", years * 365)
    flagged = ranked.select("*", F.max(fresh).over(Window.partitionBy()).alias("some"))
    kept = flagged.where(F.when(F.col("some"), fresh).otherwise(F.col("r") <= fallback))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return kept.agg(iso(F.date_sub(F.min("d"), before)).alias("first_day"), iso(F.date_add(F.max("d"), after)).alias("last_day"), F.count("*").alias("filings"))


def recent_enrichments(subs: DataFrame, companies: DataFrame, enrichments: DataFrame, k: int = 20) -> DataFrame:
    """The latest enrichment rows with their child and parent (enrichments: cik, sub_name, source_type, searched_at)."""
    joined = enrichments.join(subs.select("cik", "sub_name", "time_in", "time_out"), ["cik", "sub_name"]).join(companies.select("cik", "company_name"), "cik")
    return joined.orderBy(F.col("searched_at").desc(), "cik", "sub_name", "source_type").limit(k)


def recent_of_type(subs: DataFrame, companies: DataFrame, kind: str = "External Acquisition", k: int = 20) -> DataFrame:
    rows = subs.where(F.col("type") == kind).join(companies.select("cik", "company_name"), "cik")
    return rows.orderBy(F.col("first_seen").desc(), "cik", "sub_name").limit(k).select("cik", "company_name", "sub_name", "first_seen", "confidence")
