"""Words on pages to lines, columns and article pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.operators.tables import checkpointed

ARTICLE_HEAD = r"^\s*제\s*(\d+)\s*(?:-\s*\d+\s*)?조"


def column_band(mid: Column) -> Column:
    """act, enforce or regulation by the middle of a word."""
    return F.when(mid < 290, "act").when(mid < 540, "enforce").otherwise("regulation")


def cluster_lines(words: DataFrame, reach: float = 5.0) -> DataFrame:
    """``line`` of each word (``doc, page, text, top, x0, x1``): in order of top and x0, a word joins the current line if it
    lies within ``reach`` of the line's first word.

    Only the different heights of a page decide. They are sorted within partitions and walked as a stream that remembers
    one height, so a page may have any number of them; a word without height has no line.
    """
    heights = words.select("doc", "page", "top").distinct().repartition("doc", "page").sortWithinPartitions("doc", "page", "top")
    kinds = {f.name: f.dataType.simpleString() for f in heights.schema}
    named = heights.mapInArrow(_walk(reach), f"_doc {kinds['doc']}, _page {kinds['page']}, _top {kinds['top']}, line long")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")) & F.col("top").eqNullSafe(F.col("_top"))
    return words.join(named, same).drop("_doc", "_page", "_top")


def _walk(reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the lines of sorted heights; the current page, anchor and line go from batch to batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchor, line = None, None, -1
        for batch in batches:
            lines = []
            for doc, page, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (doc, page):
                    at, anchor, line = (doc, page), None, -1
                if top is not None and (anchor is None or not top - anchor < reach):
                    anchor, line = top, line + 1
                lines.append(None if top is None else line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], ["_doc", "_page", "_top", "line"])

    return work


def line_texts(words: DataFrame) -> DataFrame:
    """One row per line with the text of each column band: ``doc, page, line, act, enforce, regulation``."""
    banded = cluster_lines(words).withColumn("band", column_band((F.col("x0") + F.col("x1")) / 2))
    def text(band: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("band") == band, F.struct("x0", "text"))))
        return F.array_join(F.transform(own, lambda x: x["text"]), " ").alias(band)
    return banded.groupBy("doc", "page", "line").agg(text("act"), text("enforce"), text("regulation"))


def carry_forward_pairs(lines: DataFrame, doc: str, order: list[str], left: Column, right: Column, filled: Column) -> DataFrame:
    """Distinct ``doc, left, right``: the last seen left and right values on each line where both exist and ``filled`` holds.

    A segmented scan: lines fall into ranges of documents and order, each range carries its values by itself, and the last
    values of the ranges before it are carried into it. A document of any length is cut over many tasks; only one row per
    range and document is looked at across ranges.
    """
    spark = lines.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = lines.select(doc, *order, left.alias("_left"), right.alias("_right"), filled.alias("_filled"))
    dealt = rows.repartitionByRange(parts, doc, *order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    own = Window.partitionBy("_part", doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w).alias(c)
    seen = checkpointed(dealt.select(doc, "_part", "_filled", last("_left", own), last("_right", own), F.row_number().over(Window.partitionBy("_part", doc).orderBy(*(F.desc(c) for c in order))).alias("_end")))
    ends = seen.where("_end = 1").select(doc, "_part", "_left", "_right")
    before = Window.partitionBy(doc).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(doc).alias("_doc"), F.col("_part").alias("_at"), F.last("_left", ignorenulls=True).over(before).alias("_l"), F.last("_right", ignorenulls=True).over(before).alias("_r"))
    found = seen.where("_filled").join(ends.where("_l IS NOT NULL OR _r IS NOT NULL"), F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_part") == F.col("_at")), "left")
    found = found.select(doc, F.coalesce("_left", "_l").alias("left"), F.coalesce("_right", "_r").alias("right"))
    return found.where("left IS NOT NULL AND right IS NOT NULL").distinct()


def layout_pairs(words: DataFrame) -> DataFrame:
    """Regulation and act article numbers that stand next to each other in a document's columns."""
    lines = line_texts(words)
    number = lambda c: F.when(F.col(c).rlike(ARTICLE_HEAD), F.regexp_extract(c, ARTICLE_HEAD, 1).cast("int"))
    return carry_forward_pairs(lines, "doc", ["page", "line"], number("act"), number("regulation"), (F.col("act") != "") | (F.col("regulation") != ""))
