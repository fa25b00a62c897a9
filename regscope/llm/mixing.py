"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets an exponential key, divided by its quality weight: taking documents by ascending key draws them
without replacement with chances in proportion to their weights. A source whose target is e times its size and a rest
takes every document e times and then fills the rest from the key order by prefix sums.

The prefix sums run in levels, so that no task holds a source: keys fall into ordered buckets and these into as many
ranges as a range has buckets. A window sums a source's ranges, the next one the buckets of the range in which the budget
ends, and only the one bucket in which it ends is sorted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 200
CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float = 1.0, cap: int = CAP) -> DataFrame:
    """Targets of sources ``source, source_size``: ``source, source_size, target``.

    Sources in code-point order (null last) get ``weights``, repeating. ``share`` of all sizes is dealt by weight; no
    target passes ``cap`` times its source's size, and what is over is dealt again by weight until none is above. That
    fill has a closed form: in ascending order of cap by weight the capped sources come first, and the others share what
    is left by one level. One row per source, so the windows over all sources stay small.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    at = (F.row_number().over(by_name) - 1) % len(weights)
    rows = (
        sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at + 1).cast("int")))
        .withColumn("most", (F.col("source_size") * cap).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("dealt", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("dealt")) / (F.col("weights") - F.col("gone")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    # cap * share below the total cannot hold: then every source stops at its cap
    open_target = F.col("weight") * F.col("level")
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", open_target)).alias("target"))


def crossing(parts: DataFrame, by: str) -> DataFrame:
    """Of ``parts`` (``source, held, rest`` and an order), the one in which a source's sum of ``held`` passes ``rest``."""
    before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))
    parts = parts.where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("held") > F.col("rest")))
    return parts.select(F.col("source").alias("s"), F.col(by).alias("last"), (F.col("rest") - F.col("below")).alias("room"))


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    seed: int = 17,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, copies``; with ``carry`` the row itself follows as a
    struct ``row``, which is decided where it lies: only rows of buckets in which a budget ends move.

    Size counts words (runs of other than ASCII white space; null: 0). ``copies`` is how often the mix holds the
    document, ``taken`` is ``copies * size``; documents are taken whole. After the document at which the budget would be
    passed, later documents of that bucket that still fit are taken, and the passed one is taken if that ends nearer to
    the target. ``quality`` must be positive, and buckets grow with the ratio of its extremes; by default it is 1, or 0.25 where the mean word length is unusual.
    Documents without words are taken only in complete epochs. Equal seeds give equal mixes, whatever the partitioning;
    rows that repeat an identifier and text share a key and are interchangeable. A null source is a source. Other
    columns are ignored. A text of any length is one document, taken whole or not at all. Empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.char_length(text) if quality is None else quality).alias("q"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.octet_length(text)).alias("draw"),
        F.xxhash64(text).alias("tie"),
        *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []),
    )
    if quality is None:
        rows = rows.withColumn("q", F.when(F.col("q").between(4 * F.col("size"), 13 * F.col("size")), 1.0).otherwise(0.25))
    unit = (F.shiftrightunsigned("draw", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = stored(rows.withColumn("key", -F.log(unit) / F.col("q")).drop("draw"), compression="zstd" if carry else "snappy")

    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.min("q").alias("slow"))
    targets = source_targets(counts.select("source", "source_size"), weights, share)
    targets = targets.join(counts.select(F.col("source").alias("s"), "rows", "slow"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(CAP).cast("long")))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # ranges, and buckets of each
    targets = targets.withColumn("many", F.ceil(F.sqrt(F.col("rows") / BUCKET_ROWS)).cast("long")).drop("rows")
    targets = stored(targets.withColumnRenamed("source", "s"))

    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # ordered buckets: any rising function of the key will do, this one spreads even the slowest keys over all
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("slow"))) * F.col("many") * F.col("many")).cast("long")
    rows = rows.withColumn("bucket", bucket).drop("q", "slow")
    filled = stored(rows.groupBy("source", "bucket", "many", "rest").agg(F.sum("size").alias("held")).withColumn("range", F.floor(F.col("bucket") / F.col("many"))))
    ends = crossing(filled.groupBy("source", "range", "rest").agg(F.sum("held").alias("held")), "range")
    inner = filled.drop("rest").join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("last"))).drop("s", "last")
    last = stored(crossing(inner.withColumnRenamed("room", "rest"), "bucket"))
    rows = rows.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("edge", F.coalesce(F.col("bucket") == F.col("last"), F.lit(False)) & (F.col("size") > 0))

    one = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie")
    whole = Window.partitionBy("source")
    edge = rows.where("edge").withColumn("upto", F.sum("size").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("fits", F.col("upto") <= F.col("room"))
    edge = edge.withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(whole), F.lit(0)))
    for k in range(3):  # later documents that fit into what is left, by prefix sums among those small enough
        small = ~F.col("fits") & (F.col("size") <= F.col("gap"))
        edge = edge.withColumn("sum", F.sum(F.when(small, F.col("size"))).over(one.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.withColumn("more", F.coalesce(small & (F.col("sum") <= F.col("gap")), F.lit(False)))
        edge = edge.withColumn("gap", F.col("gap") - F.coalesce(F.max(F.when(F.col("more"), F.col("sum"))).over(whole), F.lit(0)))
        edge = edge.withColumn("fits", F.col("fits") | F.col("more"))
    over = F.min(F.when(~F.col("fits"), F.struct("size", "key", "doc_id"))).over(whole)
    edge = edge.withColumn("next", over)
    near = (F.struct("size", "key", "doc_id") == F.col("next")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    edge = edge.withColumn("copies", F.col("epochs") + (F.col("fits") | F.coalesce(near, F.lit(False))).cast("long"))
    early = F.when(F.col("rest") <= 0, False).when(F.col("last").isNull(), True).otherwise(F.col("bucket") < F.col("last"))
    others = rows.where("not edge").withColumn("copies", F.col("epochs") + (early & (F.col("size") > 0)).cast("long"))
    out = ["doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["row"] if carry else [])]
    return others.select(*out).unionByName(edge.select(*out))
