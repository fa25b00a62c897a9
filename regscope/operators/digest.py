"""Ordering, caps and digest texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.functions import text as T
from regscope.operators.tables import checkpointed


def sort_home_first(rows: DataFrame, overseas: Column, day: str = "pub_date", order: str = "ord", limit: int | None = None) -> DataFrame:
    out = rows.withColumn("overseas", overseas).orderBy("overseas", F.desc(day), order)
    return out.limit(limit) if limit else out


def sort_grade_cap(rows: DataFrame, grade: str = "risk_grade", order: str = "ord", n: int = 10) -> DataFrame:
    """The two upper grades, the highest first, capped."""
    return rows.where(F.col(grade).isin("상", "중")).orderBy(F.when(F.col(grade) == "상", 0).otherwise(1), order).limit(n)


def newest(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(n)


def sort_date_desc(rows: DataFrame, day: str = "pub_date", order: str = "ord") -> DataFrame:
    return rows.orderBy(F.desc(F.substring(day, 1, 10)), order)


def _lines(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def _named(label: str, text: Column) -> Column:
    return F.when(T.nz(text) != "", F.concat(F.lit(f"· {label}: "), text))


def article_card(day: Column) -> tuple[Column, Column]:
    """Text of one article before and after its number: title, agency, first paragraph, link."""
    first = F.substring(F.element_at(F.split(T.strip(F.col("body")), "\n"), 1), 1, 240)
    agency = F.concat(F.lit("· 기관: "), F.coalesce(F.nullif(T.strip(F.col("agency")), F.lit("")), F.lit("-")))
    date = F.concat(F.lit("  ("), F.substring(T.nz(day), 1, 10), F.lit(")"))
    return F.lit("🔴 [상]  #"), _lines(date, T.strip(F.col("title")), agency, _named("요약", first), _named("원문", F.col("link")))


def bill_card() -> tuple[Column, Column]:
    dash = lambda c: F.coalesce(F.nullif(T.strip(F.col(c)), F.lit("")), F.lit("-"))
    rest = _lines(F.lit(""), T.strip(F.col("bill_title")), F.concat(F.lit("· 부처: "), dash("ministry")), F.concat(F.lit("· 단계: "), dash("status")), _named("원문", F.col("link")))
    return F.lit("⚖️ [입법]  #"), rest


def title_line() -> tuple[Column, Column]:
    return F.lit(""), F.concat(F.lit(". "), T.strip(F.col("title")), F.when(T.nz(F.col("link")) != "", F.concat(F.lit("\n    "), F.col("link"))).otherwise(""))


SECTIONS = ("국내 동향", "해외 동향", "입법동향", "전체 기사")


def digest_text(rows: DataFrame, day: str = "pub_date", order: str = "ord", most: int = 200, bills: DataFrame | None = None, titles: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Per day a text in chunks (day, n, chunk, text): home and overseas articles and bills, numbered on across sections,
    then all titles, numbered by themselves; empty sections are left out.

    ``rows`` has ``overseas``; ``bills`` has ``bill_title, ministry, status, link``, ``titles`` has ``title, link``, all with
    day and order. Every item is kept: a chunk holds at most ``most`` of them, and a day's chunks one after another are its
    whole text. ``n`` counts the day's items. A day of ``days`` without any has a text that says so.
    """

    def items(of: DataFrame, section: Column, card: tuple[Column, Column]) -> DataFrame:
        return of.select(F.col(day).alias("day"), section.cast("int").alias("section"), F.col(order).alias("o"), card[0].alias("pre"), card[1].alias("post"))

    parts = items(rows, F.when(F.coalesce("overseas", F.lit(False)), 1).otherwise(0), article_card(F.col(day)))
    if bills is not None:
        parts = parts.unionByName(items(bills, F.lit(2), bill_card()))
    if titles is not None:
        parts = parts.unionByName(items(titles, F.lit(3), title_line()))
    # numbers are places within ordered parts of the items, plus the sizes of a day's earlier parts
    placed = checkpointed(parts.repartitionByRange("day", "section", "o").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("day", "section", "part").agg(F.count(F.lit(1)).alias("size"))
    whole, own = Window.partitionBy("day"), Window.partitionBy("day", "section")
    earlier = F.sum("size").over(whole.orderBy("section", "part").rowsBetween(Window.unboundedPreceding, -1))
    sections = F.sum("size").over(whole.orderBy("section").rangeBetween(Window.unboundedPreceding, -1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = sizes.select(
        F.col("day").alias("_day"),
        F.col("section").alias("_section"),
        F.col("part").alias("_part"),
        zero(earlier).alias("before"),
        zero(sections).alias("above"),
        F.sum("size").over(own).alias("many"),
        F.sum("size").over(whole).alias("n"),
    )
    local = placed.withColumn("place", F.row_number().over(Window.partitionBy("part", "day", "section").orderBy("o")))
    same = F.col("day").eqNullSafe(F.col("_day")) & (F.col("section") == F.col("_section")) & (F.col("part") == F.col("_part"))
    made = local.join(starts, same).withColumn("no", F.col("before") + F.col("place"))
    name = F.element_at(F.array(*(F.lit(x) for x in SECTIONS)), F.col("section") + 1)
    head = F.concat(F.when(F.col("no") > 1, "\n\n").otherwise(""), name, F.lit(" ("), F.col("many").cast("string"), F.lit("건)\n"))
    lead = F.when(F.col("no") == F.col("above") + 1, head).otherwise("\n")
    number = F.when(F.col("section") == 3, F.col("no") - F.col("above")).otherwise(F.col("no")).cast("string")
    cards = made.select("day", "n", "no", F.floor((F.col("no") - 1) / most).alias("chunk"), F.concat(lead, "pre", number, "post").alias("card"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "card"))), lambda x: x["card"]), "")
    out = cards.groupBy("day", "n", "chunk").agg(text.alias("text"))
    if days is not None:
        none = days.select(F.col(day).alias("day")).distinct().join(out.select("day").distinct(), "day", "left_anti")
        zero_day = none.select("day", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chunk"), empty_digest(F.col("day")).alias("text"))
        out = out.unionByName(zero_day)
    return out.withColumnRenamed("day", day)


def empty_digest(day: Column) -> Column:
    return F.concat(day, F.lit(": 오늘 신규 의미있는 AML 동향이 없습니다."))
