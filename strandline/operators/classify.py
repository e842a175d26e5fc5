"""Relationship types for all children at once, and the signals they need.

The signals are keyed aggregates that join back by hash: children per parent and
first date, names and leading words that several parents have.  No side is
broadcast by hand; those that may be small are written first, so that Spark knows their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import brand_token, first_word, infer_type_by_words, norm, words_of_parent
from strandline.store import stored

# Leading words too common to tell a brand.
COMMON_BRANDS = (
    "american", "national", "united", "general", "first", "new", "great", "golden", "western", "eastern", "northern",
    "southern", "central", "pacific", "atlantic", "international", "global", "company", "consolidated", "development",
    "corporate", "capital", "standard", "premier", "advanced", "north", "south", "east", "west", "fashion", "cole",
    "universal", "shanghai", "beijing", "hong", "royal", "imperial", "liberty", "heritage", "summit", "eagle", "harbor",
    "horizon", "phoenix", "alpine", "silver", "diamond", "emerald", "sapphire", "plaza", "tower", "bridge", "river",
    "lake", "valley", "mountain", "island", "metro", "trans", "tri", "mid", "star", "blue", "red", "green", "black",
    "white", "crown", "cross",
)


def batch_sizes(subs: DataFrame) -> DataFrame:
    """cik, first_seen, batch_size: children a parent reported first on a date."""
    return subs.where("first_seen IS NOT NULL").groupBy("cik", "first_seen").agg(F.count("*").alias("batch_size"))


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that rows of several parents have.

    Parents are compared by two hashes, as a smallest and a largest text would have all rows sorted.
    """
    marks = {f"h{k}": F.xxhash64(F.lit(k), "cik") for k in range(2)}
    ends = [end(mark).alias(f"{name}{which}") for name, mark in marks.items() for which, end in (("a", F.min), ("b", F.max))]
    return rows.where("cik IS NOT NULL").groupBy(key).agg(*ends).where("h0a <> h0b OR h1a <> h1b").select(key)


def cross_parent_names(subs: DataFrame) -> DataFrame:
    """sub_norm of names (as written) that several parents have."""
    shared = _several(subs, "sub_name")
    return shared.select(norm(F.col("sub_name")).alias("sub_norm")).distinct()


def cross_parent_brands(subs: DataFrame) -> DataFrame:
    """brand: leading words of four characters and more that children of several parents share."""
    rows = subs.where("length(sub_name) > 3").select(brand_token(F.col("sub_name")).alias("brand"), "cik")
    return _several(rows.where("length(brand) >= 4"), "brand")


def signals(subs: DataFrame, companies: DataFrame, words: bool = False) -> DataFrame:
    """``subs`` with company_name, first_filing, batch_size, cross_parent, and the parent's words in ``parent_words`` if asked for."""
    # Counted with partial aggregation and joined, as a parent's first filing may hold most of the rows.
    day = F.coalesce("first_seen", F.lit(""))
    sizes = subs.groupBy("cik", day.alias("day")).agg(F.count("*").alias("n")).groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("__sizes"))
    # What is small is written first, so that the children are shuffled for large sides only.
    read = [words_of_parent(F.col("company_name")).alias("parent_words")] if words else []
    parents = stored(companies.select("cik", "company_name", "first_filing", *read).join(sizes, "cik"))
    rows = subs.join(parents, "cik").withColumn("batch_size", F.try_element_at("__sizes", day)).drop("__sizes")
    names = stored(cross_parent_names(subs).withColumn("by_name", F.lit(True)))
    distinctive = (F.length("brand") >= 5) & ~F.col("brand").isin(*COMMON_BRANDS)
    brands = stored(cross_parent_brands(subs).where(distinctive).withColumn("by_brand", F.lit(True)))
    rows = rows.withColumn("sub_norm", norm(F.col("sub_name"))).withColumn("brand", first_word(F.col("sub_name")))
    rows = rows.join(names, "sub_norm", "left").join(brands, "brand", "left")
    return rows.withColumn("cross_parent", F.coalesce("by_name", F.lit(False)) | F.coalesce("by_brand", F.lit(False))).drop("by_name", "by_brand", "brand")


def classify(subs: DataFrame, companies: DataFrame, by_brand: bool = True) -> DataFrame:
    """``subs`` with company_name, batch_size, cross_parent and the inferred type in ``type``."""
    rows = signals(subs.drop("type", "sub_norm"), companies, words=True)
    if not by_brand:
        names = cross_parent_names(subs).withColumn("by_name", F.lit(True))
        rows = rows.drop("cross_parent").join(names, "sub_norm", "left").withColumn("cross_parent", F.coalesce("by_name", F.lit(False))).drop("by_name")
    found = infer_type_by_words(F.col("sub_name"), F.col("parent_words"), F.col("first_seen"), F.col("first_filing"), F.col("batch_size"), F.col("cross_parent"))
    return rows.withColumn("type", found).drop("parent_words")


def confirmed(subs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``subs`` with the type of children for which an event filing was found (evidence: cik, sub_name)."""
    found = evidence.select("cik", "sub_name").distinct().withColumn("__found", F.lit(True))
    rows = subs.join(found, ["cik", "sub_name"], "left")
    return rows.withColumn("type", F.when(F.col("__found"), "External Acquisition").otherwise(F.col("type"))).drop("__found")


def to_check(subs: DataFrame, k: int = 50) -> DataFrame:
    """Children to look up in event filings: typed, but not yet as acquisitions."""
    return subs.where("type <> 'External Acquisition'").orderBy("first_seen", "cik", "sub_name").limit(k)
