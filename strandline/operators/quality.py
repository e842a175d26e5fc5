"""Quality reports and cleaning of a column of names, by both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import quality as q
from strandline.operators.analytics import year_of


def issue_report(rows: DataFrame, name: Column) -> DataFrame:
    """total_records, records_with_issues, clean_records, quality_score and a count for each issue, in one pass."""
    flags = q.issue_flags(name)
    some = F.lit(False)
    for f in flags.values():
        some = some | f
    counts = rows.agg(F.count("*").alias("total_records"), F.coalesce(F.sum(some.cast("long")), F.lit(0)).alias("bad"), *(F.coalesce(F.sum(f.cast("long")), F.lit(0)).alias(k) for k, f in flags.items()))
    score = F.bround((1 - F.col("bad") / F.greatest("total_records", F.lit(1))) * 100, 2)
    return counts.select("total_records", F.col("bad").alias("records_with_issues"), (F.col("total_records") - F.col("bad")).alias("clean_records"), score.alias("quality_score"), *q.ISSUES)


def issue_rows(rows: DataFrame, name: str, issue: str = "all") -> DataFrame:
    """Rows with issues, or one issue, with the list of them."""
    tagged = rows.withColumn("issues", q.detect_issues(F.col(name)))
    return tagged.where(F.size("issues") > 0 if issue == "all" else F.array_contains("issues", issue))


def clean_plan(rows: DataFrame, name: str, **fixes: bool) -> DataFrame:
    """``rows`` with cleaned and action (delete, clean or skip; flagged names only are acted on)."""
    cleaned = q.clean_name(F.col(name), **fixes)
    tagged = rows.withColumn("flagged", F.size(q.detect_issues(F.col(name))) > 0).withColumn("cleaned", cleaned)
    return tagged.withColumn("action", F.when(F.col("flagged"), q.clean_action(F.col(name), F.col("cleaned"))).otherwise("skip")).drop("flagged")


def preview(rows: DataFrame, name: str, key: str, limit: int = 50, **fixes: bool) -> DataFrame:
    """key, original, cleaned, action, issues of the first flagged rows in the order of the key: a top-k."""
    first = issue_rows(rows, name).orderBy(key).limit(max(1, min(limit, 200)))
    cleaned = q.clean_name(F.col(name), **fixes)
    planned = first.withColumn("cleaned", cleaned).withColumn("action", q.clean_action(F.col(name), F.col("cleaned")))
    return planned.select(key, F.col(name).alias("original"), "cleaned", "action", "issues")


def clean_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("names"))


def apply_clean(plan: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """What is left after cleaning, with collision where a cleaned name meets another of the same keys."""
    left = plan.where("action <> 'delete'").withColumn(name, F.when(F.col("action") == "clean", F.col("cleaned")).otherwise(F.col(name)))
    same = F.count("*").over(Window.partitionBy(*keys, name)) > 1
    return left.withColumn("collision", same & (F.col("action") == "clean")).drop("cleaned", "action")


def renamed(rows: DataFrame, name: str, key: Column, new: str) -> DataFrame:
    """One record's name set by hand."""
    return rows.withColumn(name, F.when(key, F.lit(new)).otherwise(F.col(name)))


def strict_plan(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with cleaned and action by the stricter engine: markup stripped, names normalised, garbage and form text deleted."""
    raw = F.col(name)
    stripped = F.when(q.has_markup(raw), q.strip_markup(raw)).otherwise(raw)
    out = rows.withColumn("cleaned", q.normal_name(stripped))
    action = F.when(q.is_garbage(raw) | q.is_form_text(raw) | q.is_garbage(F.col("cleaned")), "delete").when(F.col("cleaned") != raw, "clean").otherwise("skip")
    return out.withColumn("action", action)


STRICT = {"html_tags": q.has_markup, "garbage_names": q.is_garbage, "short_names": q.is_short, "truncated_names": q.is_truncated, "encoding_issues": q.has_broken_encoding}


def strict_report(subs: DataFrame, name: str = "sub_name") -> DataFrame:
    """Counts by the stricter engine, confidence counts and a score from 0 to 100."""
    counts = [F.coalesce(F.sum(f(F.col(name)).cast("long")), F.lit(0)).alias(k) for k, f in STRICT.items()]
    grade = F.upper(F.coalesce("confidence", F.lit("MEDIUM")))
    grades = [F.coalesce(F.sum((grade == c).cast("long")), F.lit(0)).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")]
    out = subs.agg(F.count("*").alias("total_records"), *counts, *grades)
    issues = sum((F.col(k) for k in STRICT), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround((1 - issues / F.col("total_records")) * 100).cast("int")))
    return out.withColumn("quality_score", F.when(F.col("total_records") > 0, score).otherwise(0))


def compared(before: DataFrame, after: DataFrame, name: str = "sub_name") -> DataFrame:
    """Both strict reports, told apart by stage."""
    return strict_report(before, name).withColumn("stage", F.lit("before")).unionByName(strict_report(after, name).withColumn("stage", F.lit("after")))


def year_coverage(subs: DataFrame) -> DataFrame:
    """year, endpoints: how many spans begin or end in each year from 1900 to 2100."""
    ends = subs.select(F.explode(F.array(year_of("first_seen"), year_of("last_seen"))).alias("year"))
    return ends.where(F.col("year").between(1900, 2100)).groupBy("year").agg(F.count("*").alias("endpoints"))


def year_gaps(coverage: DataFrame) -> DataFrame:
    """year: those without endpoints between the first and the last with some."""
    span = coverage.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(coverage, "year", "left_anti")
