"""Joins of the monitor: unsent, restricted, by name, news for bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.functions import text as T
from regscope.operators.tables import checkpointed


def unsent(rows: DataFrame, sent: DataFrame, key: str = "url") -> DataFrame:
    """Rows with a key that is not empty and was not sent yet."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(sent.select(key).distinct(), key, "left_anti")


def restrict(rows: DataFrame, chosen: DataFrame, key: str, all_if_empty: bool = True) -> DataFrame:
    """Rows of the chosen keys; without any, all rows."""
    if all_if_empty and chosen.isEmpty():
        return rows
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def name_contains(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose space-free name contains one of the space-free ``names``; an empty list keeps all."""
    plain = ["".join(n.split()) for n in names if n.strip()]
    return rows.where(T.contains_any(T.space_free(F.col(column)), plain)) if plain else rows


def news_for_bills(bills: DataFrame, news: DataFrame, keywords: list[str], days: int = 7, most: int = 10) -> DataFrame:
    """``bill_id, news_id, rank``: up to ``most`` news per bill, in order of the news.

    ``bills`` has ``bill_id, keyword, day``, ``news`` has ``news_id, text, day``; ``keywords`` lists the bills' keywords, a
    dictionary. News match a bill whose keyword they contain, if their days are at most ``days`` apart; a bill without a day
    takes news of any day, news without a day fit every bill. Of each keyword and day only the first ``most`` news can be
    among a bill's first. For each keyword and day on which a bill stands these lists of the days around it are merged into
    one, so that a bill meets a single list, however many bills share a day.
    """
    listed = F.array(*(F.lit(k) for k in keywords))
    hits = news.select("news_id", F.col("day").alias("news_day"), F.explode(F.filter(listed, lambda k: F.contains(F.col("text"), k))).alias("keyword"))

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("news_id"), F.lit(32)))
        near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("news_id"))).where(F.col("_r") <= most)
        return near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("news_id"))).where(F.col("_r") <= most).drop("_r", "_salt")

    # the first news of each keyword and day (null: undated news), from which all lists are made
    daily = checkpointed(first(hits, ["keyword", "news_day"]))
    dated, always = daily.where("news_day IS NOT NULL"), daily.where("news_day IS NULL").select("keyword", "news_id")
    wanted = checkpointed(bills.where("day IS NOT NULL").select("keyword", "day").distinct())
    around = wanted.select("keyword", "day", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("news_day"))
    near = around.join(dated, ["keyword", "news_day"]).select("keyword", "day", "news_id").unionByName(wanted.join(always, "keyword"))
    any_day = daily.select("keyword", F.lit(None).cast("date").alias("day"), "news_id")
    lists = first(near, ["keyword", "day"]).unionByName(first(any_day, ["keyword", "day"]))
    lists = lists.groupBy(F.col("keyword").alias("_k"), F.col("day").alias("_d")).agg(F.array_sort(F.collect_list("news_id")).alias("list"))
    found = bills.join(checkpointed(lists), (F.col("keyword") == F.col("_k")) & F.col("day").eqNullSafe(F.col("_d")))
    return found.select("bill_id", F.posexplode("list").alias("rank", "news_id")).select("bill_id", "news_id", (F.col("rank") + 1).alias("rank"))


def bill_detail(stored: DataFrame, parsed: DataFrame, key: str, fields: list[str], needed: str = "summary") -> DataFrame:
    """Stored rows where the needed field is there, else with their empty fields filled from a fresh parse."""
    fresh = parsed.select(key, *(F.col(f).alias(f"_n_{f}") for f in fields))
    has = T.nz(F.col(needed)) != ""
    pick: list[Column] = [F.when(has, F.col(f)).otherwise(F.coalesce(F.nullif(F.col(f"_n_{f}"), F.lit("")), F.col(f))).alias(f) if f in fields else F.col(f) for f in stored.columns]
    return stored.join(fresh, key, "left").select(*pick)
