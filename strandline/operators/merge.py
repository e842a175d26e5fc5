"""New filings into a saved panel, updates by key, and checks of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.timeline import all_filings, bounds, filing_dates, presence, rollup_of, spans, timeline_of
from strandline.store import stored


def merged_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new observations, each (parent, date, child) once; late ones widen spans like any other."""
    cols = ["cik", "fdate", "comp_name", "sub_name", "sub_norm"]
    both = old.select(*cols).unionByName(new.select(*cols))
    return both.groupBy("cik", "fdate", "sub_norm").agg(F.min("comp_name").alias("comp_name"), F.min("sub_name").alias("sub_name")).select(*cols)


def recomputed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Timelines and roll-ups of the parents with new filings, from all their observations."""
    touched = new.select("cik").distinct()
    kids = stored(presence(merged_observations(old.join(touched, "cik", "left_semi"), new)))
    dates = stored(all_filings(kids))
    return timeline_of(kids, dates), rollup_of(kids, dates)


def legacy_merge(subs: DataFrame, dates: DataFrame, new: DataFrame) -> DataFrame:
    """Timelines after a merge that, as of old, fills no gaps, grants no confidence for legal endings and leaves children absent from the new filings as they were.

    ``subs``: cik, sub_norm, sub_name, first_seen, last_seen, time_in, time_out, confidence (ISO text); ``dates``: cik, fdate; ``new``: observations or a presence table.
    """
    all_dates = dates.select("cik", F.to_date("fdate").alias("fdate")).unionByName(filing_dates(new)).distinct()
    seen = spans(new).select("cik", "sub_norm", F.col("sub_name").alias("new_name"), F.col("first_seen").alias("a"), F.col("last_seen").alias("b"))
    # Stored, as both kinds of children are taken out of it.
    joined = stored(subs.join(seen, ["cik", "sub_norm"], "full_outer"))
    first, last = F.to_date("first_seen"), F.to_date("last_seen")
    widened = joined.where("a IS NOT NULL").select("cik", "sub_norm", F.coalesce("sub_name", "new_name").alias("sub_name"), F.least(first, "a").alias("first_seen"), F.greatest(last, "b").alias("last_seen"))
    untouched = joined.where("a IS NULL").select(*subs.columns)
    return untouched.unionByName(bounds(widened, all_dates, suffix_rule=False).select(*subs.columns))


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target and the rows whose keys it lacks, one of each key."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Target with rows of equal keys replaced by later ones; of equal times the new row counts."""
    both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.col(at).desc(), F.col("__new").desc()]).drop("__new")


def record_enrichments(subs: DataFrame, target: DataFrame, rows: DataFrame, keys: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """Children with the enriched flag brought up to date, and the enrichments: those of ``rows`` update or are inserted."""
    merged = upsert(target, rows, keys, at)
    return enriched(subs, merged, keys), merged


def enriched(subs: DataFrame, enrichments: DataFrame, keys: list[str]) -> DataFrame:
    """``subs`` with the enriched flag of children that have an enrichment."""
    have = enrichments.select(*keys).distinct().withColumn("__has", F.lit(1))
    return subs.drop("enriched").join(have, keys, "left").withColumn("enriched", F.coalesce("__has", F.lit(0))).drop("__has")


def reset(subs: DataFrame) -> DataFrame:
    """``subs`` without types and enrichment."""
    return subs.withColumn("type", F.lit(None).cast("string")).withColumn("enriched", F.lit(0))


def orphans(rows: DataFrame, parents: DataFrame, key: str = "cik") -> DataFrame:
    """Rows without a parent."""
    return rows.join(parents.select(key), key, "left_anti")


def miscounted(companies: DataFrame, subs: DataFrame) -> DataFrame:
    """Parents whose stored number of children isn't the number of children."""
    have = subs.groupBy("cik").agg(F.count("*").alias("n"))
    return companies.join(have, "cik", "left").where(F.col("num_subsidiaries") != F.coalesce("n", F.lit(0))).select("cik", "num_subsidiaries", F.coalesce("n", F.lit(0)).alias("counted"))


def integrity(companies: DataFrame, dates: DataFrame, subs: DataFrame) -> DataFrame:
    """check, violations, passed: a row a check."""
    n = lambda name, rows: rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    checks = [
        n("orphan_children", orphans(subs, companies)),
        n("orphan_dates", orphans(dates, companies)),
        n("confidence_domain", subs.where(~F.col("confidence").isin("HIGH", "MEDIUM", "LOW") | F.col("confidence").isNull())),
        n("null_names", subs.where("sub_name IS NULL OR trim(sub_name) = ''")),
        n("child_counts", miscounted(companies, subs)),
        n("span_order", subs.where("first_seen > last_seen")),
        n("repeated_children", subs.groupBy("cik", "sub_norm").count().where("count > 1")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("passed", F.col("violations") == 0)


def pass_rate(checks: DataFrame) -> DataFrame:
    passed = F.sum(F.col("passed").cast("long"))
    return checks.agg(F.count("*").alias("checks"), passed.alias("passed"), F.round(passed * 100.0 / F.count("*"), 1).alias("pass_rate"))
