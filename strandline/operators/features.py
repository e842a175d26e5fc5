"""Training labels and features of the relationship classifier, and the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.names import FEATURE_FUNCTIONAL, FEATURE_GEOGRAPHIC, has_any, is_active, jaccard, meaningful_words, norm, suffix_type
from strandline.operators.classify import cross_parent_names
from strandline.store import stored

NUMERIC = ("jaccard", "batch_size", "is_cross_parent", "lag_days", "has_functional", "has_geographic", "token_count", "is_active")


#: Characters of a company's name that a child's name must hold. A fixed value.
START = 20


def labels_from_acquirers(subs: DataFrame, companies: DataFrame, known: DataFrame) -> DataFrame:
    """All children whose name holds the start of a known acquired company, under a parent that shares a long word with the acquirer.

    The substring test would pair all names with all companies, and words or grams of a start may be in most names.
    So names are cut into all pieces as long as a start is, at most 20 lengths, and meet the starts by equality.
    The pieces are far more than the names' size tells, so Spark must not send them to all.
    """
    rows = known.select("company", "acquirer", F.substring("company", 1, START).alias("start")).where("length(start) >= 3")
    sizes = stored(rows.select(F.length("start").alias("size")).distinct())
    names = subs.select("cik", "sub_name", F.lower("sub_name").alias("low"))
    names = names.repartition(4 * subs.sparkSession.sparkContext.defaultParallelism, "sub_name").join(F.broadcast(sizes), F.length("low") >= F.col("size"))
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("size") + 1), lambda i: F.substring("low", i, F.col("size"))))
    pieces = names.select("cik", "sub_name", F.explode(each).alias("start"))
    found = rows.join(pieces.hint("merge"), "start").select("company", "acquirer", "cik", "sub_name")
    found = found.join(companies.select("cik", "company_name").hint("merge"), "cik")
    shared = F.exists(meaningful_words(F.col("acquirer")), lambda w: (F.length(w) >= 4) & F.lower(F.col("company_name")).contains(w))
    return found.where(shared).select("cik", "sub_name", F.lit("acquisition").alias("label"), F.lit("wikidata").alias("origin"))


def labels_from_shared_names(subs: DataFrame, most: int = 20_000) -> DataFrame:
    rows = subs.select("cik", "sub_name", norm(F.col("sub_name")).alias("sub_norm")).join(cross_parent_names(subs), "sub_norm", "left_semi")
    return rows.orderBy("cik", "sub_name").limit(most).select("cik", "sub_name", F.lit("acquisition").alias("label"), F.lit("cross_cik").alias("origin"))


def labels_from_parent_names(subs: DataFrame, companies: DataFrame, parents: int = 200, each: int = 500) -> DataFrame:
    """Children of the largest parents that carry the parent's leading word."""
    largest = companies.orderBy(F.col("num_subsidiaries").desc(), "cik").limit(parents)
    core = F.get(meaningful_words(F.col("company_name")), F.lit(0))
    rows = subs.select("cik", "sub_name").join(largest.select("cik", core.alias("core")).where("length(core) >= 3"), "cik")
    rows = rows.where(F.lower("sub_name").contains(F.col("core")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cik").orderBy("sub_name"))).where(F.col("r") <= each)
    return rows.select("cik", "sub_name", F.lit("internal").alias("label"), F.lit("name_match").alias("origin"))


def labels_from_event_filings(subs: DataFrame, companies: DataFrame, filings: DataFrame, days: int = 365, each: int = 50) -> DataFrame:
    """Children without the parent's leading word, first seen within a year of an event filing (filings: cik, filing_date)."""
    core = F.coalesce(F.get(meaningful_words(F.col("company_name")), F.lit(0)), F.lit(""))
    rows = subs.select("cik", "sub_name", F.to_date("first_seen").alias("d")).join(filings.select("cik", F.to_date("filing_date").alias("f")), "cik")
    rows = rows.where(F.col("d").between(F.date_sub("f", days), F.date_add("f", days))).join(companies.select("cik", core.alias("core")), "cik")
    rows = rows.where(~F.lower("sub_name").contains(F.col("core")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cik", "f").orderBy("sub_name"))).where(F.col("r") <= each)
    return rows.select("cik", "sub_name", F.lit("acquisition").alias("label"), F.lit("edgar_8k").alias("origin"))


def strongest(labels: DataFrame) -> DataFrame:
    """One label a child: event filings before known acquisitions before the rest; ties by origin, then label."""
    strength = F.when(F.col("origin") == "edgar_8k", 3).when(F.col("origin") == "wikidata", 2).otherwise(1)
    order = Window.partitionBy("cik", "sub_name").orderBy(strength.desc(), "origin", "label")
    return labels.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def features(subs: DataFrame, companies: DataFrame) -> DataFrame:
    """The feature row of every child; the same for training and prediction. Batch size stays 0, as in training."""
    rows = subs.select("cik", "sub_name", "first_seen", "time_out").join(companies.select("cik", "company_name", "first_filing"), "cik")
    shared = stored(cross_parent_names(subs).withColumn("shared", F.lit(1)))  # written, so that Spark knows its size
    rows = rows.withColumn("sub_norm", norm(F.col("sub_name"))).join(shared, "sub_norm", "left")
    low = F.lower("sub_name")
    day = lambda c: F.try_to_date(F.substring(c, 1, 10))
    similar = jaccard(F.array_distinct(meaningful_words(F.col("sub_name"))), F.array_distinct(meaningful_words(F.col("company_name"))))
    return rows.select(
        "cik",
        "sub_name",
        "company_name",
        F.round(similar, 6).alias("jaccard"),
        suffix_type(F.col("sub_name")).alias("suffix_type"),
        F.lit(0).alias("batch_size"),
        F.coalesce("shared", F.lit(0)).alias("is_cross_parent"),
        F.coalesce(F.datediff(day("first_seen"), day("first_filing")), F.lit(0)).alias("lag_days"),
        has_any(low, FEATURE_FUNCTIONAL).cast("int").alias("has_functional"),
        has_any(low, FEATURE_GEOGRAPHIC).cast("int").alias("has_geographic"),
        F.size(F.split(F.trim("sub_name"), r"(?U)\s+")).alias("token_count"),
        F.coalesce(is_active(F.col("time_out")) | F.col("time_out").contains("Active"), F.lit(False)).cast("int").alias("is_active"),
    )


def training_table(subs: DataFrame, companies: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the labelled children with label and origin."""
    return features(subs, companies).join(strongest(labels), ["cik", "sub_name"])


def training_rows(table: DataFrame) -> DataFrame:
    """The fourteen columns of the training file (``write_csv`` of ``sources.sinks`` writes it)."""
    return table.select(
        F.concat_ws("/", "cik", "sub_name").alias("sub_id"),
        "sub_name",
        F.col("company_name").alias("parent_name"),
        "label",
        F.col("origin").alias("source"),
        F.col("is_cross_parent").alias("cross_cik"),
        F.round("jaccard", 4).alias("name_similarity"),
        "suffix_type",
        F.col("lag_days").alias("first_seen_lag_days"),
        "batch_size",
        "has_functional",
        "has_geographic",
        "token_count",
        "is_active",
    )


def train(table: DataFrame, rounds: int = 200, depth: int = 6, rate: float = 0.1, share: float = 0.8, seed: int = 42) -> tuple[object, DataFrame]:
    """A fitted gradient-boosted pipeline and its predictions for a held-out fifth, split within each label by hashed key."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = table.withColumn("target", (F.col("label") == "acquisition").cast("double"))
    place = F.percent_rank().over(Window.partitionBy("label", F.pmod(F.xxhash64("cik", "sub_name"), F.lit(64))).orderBy(F.xxhash64(F.lit(seed), "cik", "sub_name")))
    rows = rows.withColumn("place", place)
    steps = [
        StringIndexer(inputCol="suffix_type", outputCol="suffix_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["suffix_index"], outputCols=["suffix"]),
        VectorAssembler(inputCols=[*NUMERIC, "suffix"], outputCol="features"),
        GBTClassifier(labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed),
    ]
    rows = stored(rows)  # read once a tree level
    model = Pipeline(stages=steps).fit(rows.where(F.col("place") < 0.8))
    return model, model.transform(rows.where(F.col("place") >= 0.8))


def evaluation(predicted: DataFrame) -> DataFrame:
    """label, children, accuracy."""
    right = F.avg((F.col("prediction") == F.col("target")).cast("double"))
    return predicted.groupBy("label").agg(F.count("*").alias("children"), F.round(right, 4).alias("accuracy"))


def importances(model: object, spark: SparkSession) -> DataFrame:
    """feature, importance of a fitted pipeline, the dummies of the name's ending added up."""
    weights = model.stages[-1].featureImportances.toArray()  # a few numbers
    rows = [(n, float(w)) for n, w in zip(NUMERIC, weights, strict=False)] + [("suffix_type", float(weights[len(NUMERIC) :].sum()))]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
