"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort places equal texts next to each other, and the
window operator compares neighbours in full. A splitter holds a bounded prefix and a hash of a text, never a whole
text, so what the sampling sends to the driver stays small. Equal texts are neighbours in one run.

Only a hot text, which holds more rows than half a partition's share, is cut into several runs, by a hash of the
identifier: a count of hashes finds these texts, of which there can be twice as many as partitions at most. One row of
each such run brings its full text, and the runs whose texts are equal are merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.llm.common import lower_ascii, shuffle_width, stored

PREFIX_CHARS = 24


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normal: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if their normalised forms are identical; by default A-Z are lower-cased and a null counts as empty.
    ``keep`` is ``smallest`` or ``largest``: the identifier that stays. Other columns are ignored, whatever their names.
    A null identifier stays only where its whole group has none. Of rows that repeat the kept identifier one is kept.
    Empty input gives no rows; very long texts are compared whole.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best, order = (F.min, F.asc_nulls_last) if keep == "smallest" else (F.max, F.desc_nulls_last)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (lower_ascii(text) if normal is None else normal).alias("body"))
    width = shuffle_width(docs)
    rows = rows.withColumn("tail", F.xxhash64("body"))
    hot = hot_texts(rows, width)
    runs = text_runs(rows.join(F.broadcast(hot), "tail", "left"), width, best, order)
    runs = stored(runs)
    # the runs of a hot text meet by their full texts, one row each; there are about four times as many as partitions
    first = runs.where("place = 1 AND pieces > 1").select("body", "salt", "run_size", "run_best", "text_sha256")
    total = first.groupBy("body").agg(
        best("run_best").alias("keep_id"), F.sum("run_size").alias("group_size"), F.min("salt").alias("null_salt"), F.collect_list(F.struct("salt", "text_sha256")).alias("runs")
    )
    total = stored(total.select("keep_id", "group_size", "null_salt", F.inline("runs")))
    whole = runs.where("pieces = 1").select("doc_id", "place", "salt", "text_sha256", F.col("run_best").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("salt").alias("null_salt"))
    cut = runs.where("pieces > 1").select("doc_id", "place", "salt", "text_sha256").join(F.broadcast(total), ["salt", "text_sha256"])
    same = (F.col("place") == 1) & (
        (F.col("doc_id") == F.col("keep_id"))
        | (F.col("keep_id").isNull() & F.col("doc_id").isNull() & (F.col("salt") == F.col("null_salt")))
    )
    return whole.unionByName(cut).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), F.coalesce(same, F.lit(False)).alias("kept"), "text_sha256"
    )


def hot_texts(rows: DataFrame, width: int) -> DataFrame:
    """``tail, pieces``: hashes that more than half a partition's share of the rows have, and how many such halves they fill.
    There are fewer than twice ``width``."""
    half = rows.count() / (2 * width)
    counts = rows.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1.0, half))
    found = [(r["tail"], int(r["n"] // max(1.0, half)) + 1) for r in counts.collect()]
    return rows.sparkSession.createDataFrame(found, "tail long, pieces int")


def text_runs(rows: DataFrame, width: int, best: Callable, order: Callable) -> DataFrame:
    """Every row with its run: ``doc_id, place, run_size, run_best, salt, pieces, text_sha256``, and ``body`` in the first row of
    a hot text's run. Rows have ``doc_id, body, tail, pieces``."""
    rows = rows.select(
        "doc_id",
        "body",
        F.substring("body", 1, PREFIX_CHARS).alias("head"),
        "tail",
        F.coalesce("pieces", F.lit(1)).alias("pieces"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int").alias("salt"),
    )
    run = Window.partitionBy("head", "tail", "salt", "body")
    return (
        rows.repartitionByRange(width, "head", "tail", "salt")
        .withColumn("place", F.row_number().over(run.orderBy(order("doc_id"))))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
        .withColumn("run_best", best("doc_id").over(run))
        .withColumn("text_sha256", F.sha2("body", 256))
        .withColumn("body", F.when((F.col("pieces") > 1) & (F.col("place") == 1), F.col("body")))
    )
