"""Name search, pages, facets and the graph around a parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import is_active

SORTS = ("num_subsidiaries", "company_name", "num_filings", "cik")


def matches(name: Column, q: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` of the query act as wildcards, a backslash as itself."""
    return name.ilike("%" + q.replace("\\", "\\\\") + "%")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    """A page of ordered rows: a top-k of the rows up to its end."""
    size = max(1, min(size, 100))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def totals(rows: DataFrame, size: int = 25) -> DataFrame:
    """total, pages."""
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def company_page(companies: DataFrame, q: str = "", sort: str = "num_subsidiaries", order: str = "desc", number: int = 1, size: int = 25) -> DataFrame:
    """Parents by name or key; unknown sort columns and orders fall back to the defaults."""
    rows = companies.where(matches(F.col("company_name"), q) | matches(F.col("cik"), q)) if q else companies
    by = F.col(sort if sort in SORTS else SORTS[0])
    return page(rows, [by.asc() if order == "asc" else by.desc(), F.col("cik")], number, size)


def name_search(subs: DataFrame, companies: DataFrame, q: str = "") -> DataFrame:
    rows = subs.where(matches(F.col("sub_name"), q)) if q else subs
    return rows.join(companies.select("cik", "company_name"), "cik")


def name_search_page(subs: DataFrame, companies: DataFrame, q: str = "", number: int = 1, size: int = 25) -> DataFrame:
    return page(name_search(subs, companies, q), [F.col("sub_name"), F.col("cik")], number, size).select("cik", "company_name", "sub_name", "first_seen", "last_seen", "confidence")


def cross_links(subs: DataFrame, companies: DataFrame, q: str, k: int = 50) -> DataFrame:
    """Children of any parent by name."""
    return name_search(subs, companies, q).orderBy("sub_name", "cik").limit(k).select("cik", "company_name", "sub_name", "time_out")


def facets(subs: DataFrame, text: str = "", confidence: str = "", status: str = "", enriched: bool | None = None) -> DataFrame:
    """Children by several filters at once; what has no end counts among the divested here."""
    active = F.coalesce(is_active(F.col("time_out")), F.lit(False))
    rows = subs
    if text:
        rows = rows.where(F.lower("sub_name").contains(text.lower()))
    if confidence:
        rows = rows.where(F.col("confidence") == confidence)
    if status:
        rows = rows.where(active if status == "active" else ~active)
    if enriched is not None:
        rows = rows.where((F.col("enriched") == 1) == F.lit(enriched))
    return rows


def by_confidence(subs: DataFrame) -> list[Column]:
    """HIGH, MEDIUM, LOW, others."""
    c = F.col("confidence")
    return [F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).when(c == "LOW", 2).otherwise(3), F.col("sub_name"), F.col("cik")]


def _shown(subs: DataFrame, cik: str, limit: int) -> DataFrame:
    return subs.where(F.col("cik") == cik).orderBy("first_seen", "sub_name").limit(max(1, min(limit, 200)))


def network_nodes(subs: DataFrame, companies: DataFrame, cik: str, limit: int = 50) -> DataFrame:
    """id, label, kind, active, size: the parent and its first children."""
    active = F.coalesce(is_active(F.col("time_out")), F.lit(False))
    centre = companies.where(F.col("cik") == cik).select(F.lit("company").alias("id"), F.col("company_name").alias("label"), F.lit("company").alias("kind"), F.lit(None).cast("boolean").alias("active"), F.lit(30).alias("size"))
    around = _shown(subs, cik, limit).select(F.concat(F.lit("sub_"), "sub_name").alias("id"), F.col("sub_name").alias("label"), F.lit("subsidiary").alias("kind"), active.alias("active"), F.when(active, 12).otherwise(8).alias("size"))
    return centre.unionByName(around)


def network_edges(subs: DataFrame, cik: str, limit: int = 50) -> DataFrame:
    """source, target, active: a star."""
    active = F.coalesce(is_active(F.col("time_out")), F.lit(False))
    return _shown(subs, cik, limit).select(F.lit("company").alias("source"), F.concat(F.lit("sub_"), "sub_name").alias("target"), active.alias("active"))
