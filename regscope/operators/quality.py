"""Data-quality metrics and the rules that turn them into findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regscope.operators.tables import checkpointed


def category_counts(rows: DataFrame, category: str, day: Column, as_of: str, categories: DataFrame | None = None) -> DataFrame:
    """Per category: all rows, those of ``as_of`` and of the seven days up to it; listed categories without rows show 0."""
    last = F.lit(as_of).cast("date")
    found = rows.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(day == last).alias("today"),
        F.count_if(day.between(F.date_sub(last, 6), last)).alias("week"),
        F.max(day).alias("last_day"),
    )
    if categories is None:
        return found
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return categories.join(found, category, "left").select(category, zero("total"), zero("today"), zero("week"), "last_day")


def null_profile(rows: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """``column, n_null, n_empty, percent_null`` (half to even) of each column, in one pass; empty texts are no nulls."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.col(c).cast("string") == "").alias(f"{c}_empty")]
    counted = rows.groupBy(*([group] if group else [])).agg(*aggs)
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_null").alias("n_null"), F.col(f"{c}_empty").alias("n_empty")) for c in columns))
    long = counted.select(*([group] if group else []), "n", F.inline(items))
    return long.withColumn("percent_null", F.when(F.col("n") > 0, F.bround(100.0 * F.col("n_null") / F.col("n"), 1)).otherwise(0.0)).drop("n")


def quality_rules(spark: SparkSession) -> DataFrame:
    """Rules as data: metric, bound, whether below or above it is bad, severities, and the message."""
    rules = [
        ("today", 1.0, "below", "CRITICAL", 1, "no rows today"),
        ("today", 3.0, "below", "WARNING", 2, "fewer than three rows today"),
        ("total", 1.0, "below", "CRITICAL", 1, "no rows at all"),
        ("gov_total", 10.0, "below", "WARNING", 1, "few government bills"),
        ("assembly_total", 50.0, "below", "WARNING", 1, "few assembly bills"),
        ("percent_null", 50.0, "above", "WARNING", 1, "over half of the values are null"),
        ("percent_null", 0.0, "above", "INFO", 2, "some values are null"),
        ("scraped_today", 1.0, "below", "WARNING", 1, "nothing collected today"),
    ]
    return spark.createDataFrame(rules, "metric string, bound double, side string, severity string, rank int, message string")


def quality_report(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``severity, tbl, message, value`` of ``metrics`` (``tbl, metric, value``): per metric the first rule that holds."""
    bad = ((F.col("side") == "below") & (F.col("value") < F.col("bound"))) | ((F.col("side") == "above") & (F.col("value") > F.col("bound")))
    hit = metrics.join(F.broadcast(rules), "metric").where(bad)
    first = hit.groupBy("tbl", "metric").agg(F.min(F.struct("rank", "severity", "message", "value")).alias("f"))
    return first.select("tbl", "metric", F.col("f.severity").alias("severity"), F.col("f.message").alias("message"), F.col("f.value").alias("value"))


def digest_totals(rows: DataFrame, keep: Column, overseas: Column, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a digest, stored, and its counts: home, overseas, bills, and how many rows went.

    The counts are observed while the rows are filtered and written, so the rows are read once.
    """
    spark, before, after = rows.sparkSession, Observation(), Observation()
    kept = rows.observe(before, F.count(F.lit(1)).alias("n")).where(keep)
    kept = kept.observe(after, F.count(F.lit(1)).alias("n"), F.count_if(overseas).alias("overseas"))
    stored = checkpointed(kept)
    n, own = before.get["n"], after.get
    counts = [(own["n"] - own["overseas"], own["overseas"], bills.count(), n - own["n"])]
    return stored, spark.createDataFrame(counts, "n_home long, n_overseas long, n_bills long, n_dropped long")
