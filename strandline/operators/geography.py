"""Jurisdictions of children: counts by country, of all or of a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.geography import country_code, country_name, parse_geography


def located(subs: DataFrame) -> DataFrame:
    """``subs`` with geo: code, country and, in the US, the state; null where nothing tells."""
    return subs.withColumn("geo", parse_geography(F.col("sub_name")))


def countries(subs: DataFrame, k: int | None = 50) -> DataFrame:
    """country_code, country_name, children, by number.

    Names repeat across parents, so each different name is parsed once.
    """
    names = subs.groupBy("sub_name").agg(F.count("*").alias("n")).select(country_code(F.col("sub_name")).alias("country_code"), "n")
    out = names.where("country_code IS NOT NULL").groupBy("country_code").agg(F.sum("n").alias("children"))
    out = out.select("country_code", country_name(F.col("country_code")).alias("country_name"), "children")
    return out.orderBy(F.col("children").desc(), "country_code").limit(k) if k else out


def by_company(subs: DataFrame, cik: str) -> DataFrame:
    """country_code, country_name, children, names of one parent's children."""
    rows = located(subs.where(F.col("cik") == cik)).where("geo IS NOT NULL")
    return rows.groupBy("geo.country_code", "geo.country_name").agg(F.count("*").alias("children"), F.sort_array(F.collect_list("sub_name")).alias("names"))


def sampled(subs: DataFrame, n: int = 10_000, k: int = 20, seed: int = 42) -> DataFrame:
    """Countries of a sample of children."""
    return countries(bottom(subs, ["cik", "sub_norm"], n, seed), k)


def bottom(rows: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows whose keys have the smallest hashes: a random sample that stays the same.

    Each task keeps its n smallest, and these are merged; nothing is sorted as a whole, and
    the sample of two tables is the sample of their samples.
    """
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *key).cast("binary")), *key).limit(n)
