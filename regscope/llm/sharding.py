"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together. They are far too many to place one by one, so small groups are first gathered into
a fixed number of parcels by hash; a group larger than a parcel stands alone, and one with more bytes than ``cut_above``
times a shard's fair share is cut into pieces (at 1, the default, nothing else can balance it). The number of items placed one by one is therefore bounded by the
parameters, not by the data. Items go largest first to the shard where the dot product of the item's sizes with the
shard's residual capacities is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regscope.llm.common import shuffle_width, stored

PARCELS = 2048


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``items`` has one row per item and one column per dimension, as shares of the total.

    Largest item first (by its largest share), to the shard with the highest dot product with the residual capacity;
    a shard that the item would overfill counts only where it overfills every shard. Ties go to the first shard.
    """
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))):
        fits = (residual >= items[i] - 1e-12).all(axis=1)
        score = residual @ items[i]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        else:
            score = (residual - items[i]).min(axis=1)
        out[i] = int(score.argmax())
        residual[out[i]] -= items[i]
    return out


def pack(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", parcels: int = PARCELS, cut_above: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the text's UTF-8 bytes (null: none) plus 1; the law is ``bytes``, so ``grown_shard`` is null. Slots count
    from 0 in each shard without gaps, in no promised order but equal on every run over the same rows. A null text
    counts as empty and groups with empty texts; rows that repeat an identifier are rows of their own. A text of any length
    is one row of its shard. ``cut_above``: how many times a shard's fair share of bytes a group of equal texts may hold
    and stay whole. Other columns are ignored. Empty input gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    width = shuffle_width(docs)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("same"),
            (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long").alias("tokens"),
        )
    )
    total = rows.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.sum("n").alias("n")]
    groups = rows.groupBy("same").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    share = F.greatest(*(F.col(k) / F.lit(float(max(1, total[k] or 0))) for k in ("b", "t", "n")))
    # a group above 1/parcels of any total stands alone: at most 3 x parcels of them exist
    large = groups.withColumn("share", share).where(F.col("share") > 1.0 / parcels)
    # more bytes than a shard's fair share: no whole placement is near equal
    bulk = F.col("b") / F.lit(float(max(1, total["b"] or 0)))
    large = large.withColumn("pieces", F.when(bulk > cut_above / shards, F.ceil(bulk * (4 * shards))).otherwise(1))
    large = stored(large)
    marked = rows.join(large.select("same", "pieces"), "same", "left")
    parcel = F.pmod(F.xxhash64("same"), F.lit(parcels))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    marked = marked.select(
        "doc_id",
        "size",
        "text_crc32",
        "tokens",
        F.when(F.col("pieces").isNull(), F.format_string("p%d", parcel))
        .otherwise(F.format_string("g%s.%d", F.col("same"), piece))
        .alias("item"),
    )
    marked = stored(marked.withColumn("n", F.lit(1)))
    items = marked.groupBy("item").agg(*sums).orderBy("item").collect()  # bounded: parcels, large groups and their pieces
    sizes = np.array([[x["b"], x["t"], x["n"]] for x in items], float).reshape(-1, 3)
    where = place(sizes / np.maximum(1.0, [total["b"] or 0, total["t"] or 0, total["n"] or 0]), shards)
    placed = spark.createDataFrame([(x["item"], int(k)) for x, k in zip(items, where, strict=True)], "item string, shard int")
    dealt = marked.join(F.broadcast(placed), "item").withColumn("strip", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(4 * width)))
    # slots: one small window per strip of a shard, and a prefix sum over the strips' counts
    strips = dealt.groupBy("shard", "strip").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32")
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(strips.select("shard", "strip", "base"), ["shard", "strip"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
