"""What leaves the engine: Parquet tables, CSV exports and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import shortened


def full_refresh(tables: dict[str, DataFrame], folder: str) -> None:
    """Overwrite each table, sorted by parent within files so that a parent's rows can be pruned to."""
    for name, df in tables.items():
        keyed = df.sortWithinPartitions("cik") if "cik" in df.columns else df
        keyed.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; quotes inside fields are doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


EXPORT = ("company_name", "cik", "sub_name", "first_seen", "last_seen", "time_in", "time_out", "confidence", "source", "type", "enriched")


def all_rows(subs: DataFrame, companies: DataFrame) -> DataFrame:
    """Every child with its parent's name, by parent and child; a range-partitioned sort, so files are in order."""
    return subs.join(companies.select("cik", "company_name"), "cik").orderBy("company_name", "sub_name", "cik").select(*(c for c in EXPORT if c in {*subs.columns, "company_name"}))


def capped_rows(subs: DataFrame, companies: DataFrame, most: int = 500_000) -> DataFrame:
    """The first rows of :func:`all_rows`; the cap is the export's."""
    return all_rows(subs, companies).limit(most)


def company_rows(subs: DataFrame, cik: str, by_name: bool = False) -> DataFrame:
    rows = subs.where(F.col("cik") == cik)
    return rows.orderBy("sub_name") if by_name else rows.orderBy("first_seen", "sub_name")


def sheet(subs: DataFrame) -> DataFrame:
    """Display columns of a worksheet, with Yes or No."""
    return subs.select(*(c for c in EXPORT if c in subs.columns and c != "enriched"), F.when(F.col("enriched") == 1, "Yes").otherwise("No").alias("enriched"))


def column_widths(rows: DataFrame, most: int = 50) -> DataFrame:
    """Width of each display column: its longest value, a margin, at most a limit."""
    sizes = rows.agg(*(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in rows.columns))
    return sizes.select(*(F.least(F.greatest(F.col(c), F.lit(len(c))) + 3, F.lit(most)).alias(c) for c in rows.columns))


def print_rows(subs: DataFrame, cik: str, most: int = 200) -> DataFrame:
    """The first children of a parent for print, long fields cut."""
    rows = company_rows(subs, cik, by_name=True).limit(most)
    return rows.select(shortened(F.col("sub_name"), 40).alias("sub_name"), shortened(F.col("time_in"), 35).alias("time_in"), shortened(F.col("time_out"), 35).alias("time_out"), "confidence")
