"""Reasoning over landed evidence for one child: filings, articles, model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import infer_type
from strandline.functions.text import event_of, json_in, valid_confidence, valid_type


def reasoned(rows: DataFrame) -> DataFrame:
    """``rows`` with type, main_source and notes.

    Columns: sub_name, company_name, filings (array of form, date, url), articles (array
    of url, snippet, extract).  The earliest filing is the source; the first article with
    words of an event decides the type (an acquisition also the source); without one the names do.
    """
    filing = F.get(F.array_sort("filings", lambda a, b: F.when(a["date"] < b["date"], -1).when(a["date"] > b["date"], 1).otherwise(0)), F.lit(0))
    cited = F.concat(F.lit("SEC EDGAR ("), filing["form"], F.lit(" filing, "), filing["date"], F.lit(")"), F.coalesce(F.concat(F.lit(" - "), F.nullif(filing["url"], F.lit(""))), F.lit("")))
    text = lambda a: F.concat_ws(" ", F.coalesce(a["snippet"], F.lit("")), F.coalesce(a["extract"], F.lit("")))
    hit = F.get(F.filter("articles", lambda a: event_of(text(a)).isNotNull()), F.lit(0))
    kind = event_of(text(hit))
    empty = F.lit("")
    named = infer_type(F.col("sub_name"), F.col("company_name"), empty, empty, F.lit(0), F.lit(False))
    source = F.coalesce(F.when(kind == "External Acquisition", hit["url"]), cited, F.lit("SEC Exhibit 21 filing comparison"))
    notes = F.when(kind.isNotNull(), F.concat(F.lit("An article suggests: "), F.lower(kind), F.lit(". "), F.substring(hit["snippet"], 1, 200))).otherwise(F.lit("Determined from filing dates. Type inferred from entity naming pattern."))
    return rows.withColumn("type", F.coalesce(kind, named)).withColumn("main_source", source).withColumn("notes", notes)


ANSWER = "TimeIn string, TimeOut string, Type string, MainSource string, Confidence string, Notes string"


def answers(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the fields of a model's free-text answer, corrected to the known values; all null unless every field is there."""
    fields = [f.split()[0] for f in ANSWER.split(", ")]
    parsed = rows.withColumn("__a", F.from_json(json_in(F.col(text)), ANSWER))
    whole = F.col("__a").isNotNull()
    for f in fields:
        whole = whole & F.col(f"__a.{f}").isNotNull()
    value = {f: F.col(f"__a.{f}") for f in fields} | {"Type": valid_type(F.col("__a.Type")), "Confidence": valid_confidence(F.col("__a.Confidence"))}
    return parsed.select(*rows.columns, *(F.when(whole, value[f]).alias(f) for f in fields))


def job_counts(log: DataFrame) -> DataFrame:
    """job, done, failed of a run log (job, ok)."""
    return log.groupBy("job").agg(F.count("*").alias("done"), F.sum((~F.col("ok")).cast("long")).alias("failed"))
