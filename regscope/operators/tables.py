"""Tables as state: shared checkpoints, numbering, upserts, patches and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 10_000


def shared_path(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a temporary folder serves on a local master, as in tests; a cluster has no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("regscope.local.checkpoint", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("regscope.local.checkpoint", root)
    return f"{root.rstrip('/')}/regscope-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again: its lineage ends there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """``row_no`` from 1 in ``order`` (unique), without one task that sorts all rows: counts of order ranges come first."""
    keys = [group] if group else []
    if group:
        return rows.withColumn("row_no", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    base = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order)))
    return local.join(F.broadcast(base), "_part").withColumn("row_no", F.col("_base") + F.col("_at")).drop("_part", "_base", "_at")


def latest_snapshot(rows: DataFrame, key: str, ts: str, payload: str, schema: str | None = None) -> DataFrame:
    """The newest payload of each key, its JSON array (or array column) unnested into rows."""
    newest = rows.groupBy(key).agg(F.max_by(payload, ts).alias("_payload"))
    if schema:
        newest = newest.withColumn("_payload", F.from_json("_payload", f"array<struct<{schema}>>"))
    return newest.select(key, F.inline("_payload"))


def pick_source(primary: DataFrame, fallback: DataFrame, mode: str = "on_empty") -> DataFrame:
    """Primary rows, or fallback rows where the primary is empty (``on_empty``) or smaller (``larger``)."""
    counts = primary.agg(F.count(F.lit(1)).alias("_p")).crossJoin(fallback.agg(F.count(F.lit(1)).alias("_f")))
    use = {"on_empty": F.col("_p") > 0, "larger": F.col("_p") >= F.col("_f")}[mode]
    flag = F.broadcast(counts.select(use.alias("_use")))
    both = primary.withColumn("_side", F.lit(True)).unionByName(fallback.withColumn("_side", F.lit(False)), allowMissingColumns=True)
    return both.join(flag, F.col("_side") == F.col("_use")).drop("_side", "_use")


def filtered_scan(rows: DataFrame, where: Column | None = None, columns: list[str] | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
    out = rows if where is None else rows.where(where)
    out = out.orderBy(*order) if order else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*columns) if columns else out


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Last write wins by key; only columns that the updates carry are overwritten, new keys are added."""
    given = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in given))
    joined = target.join(new, key, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
    return joined.select(*(pick(c) if c != key else F.col(key) for c in target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Target rows and the rows of unseen keys, one of each new key (the least row)."""
    fresh = rows.join(target.select(key).distinct(), key, "left_anti")
    least = fresh.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("_row")).select(key, "_row.*")
    return target.unionByName(least.select(*target.columns))


def replace_partition(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only those partitions of the table at ``path`` that ``rows`` hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def patch_nonempty(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Overwrite with the patch's fields that are not empty; patches without key or any field change nothing."""
    fields = [c for c in patch.columns if c != key]
    some = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in fields)).isNotNull()
    usable = patch.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & some)
    usable = usable.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in fields))
    joined = target.join(usable, key, "left")
    new = lambda c: F.when(F.col(f"_n_{c}").cast("string") != "", F.col(f"_n_{c}"))
    return joined.select(*(F.coalesce(new(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns))


def append_history(history: DataFrame, rows: DataFrame, order: str, most: int = 200) -> DataFrame:
    """History and new rows, newest first, at most ``most``."""
    return history.unionByName(rows).orderBy(F.desc(order)).limit(most)


def preserve_enriched(new: DataFrame, old: DataFrame, local: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New rows with the old value of each field that is empty in them; the store's value goes before the local one."""
    def named(side: DataFrame, mark: str) -> DataFrame:
        picked = side.groupBy(key).agg(*(F.max(F.col(c)).alias(f"{mark}{c}") for c in fields))
        return picked

    joined = new.join(named(old, "_o_"), key, "left").join(named(local, "_l_"), key, "left")
    full = lambda c: F.when(c.cast("string") != "", c)
    return joined.select(*(F.coalesce(full(F.col(c)), full(F.col(f"_o_{c}")), full(F.col(f"_l_{c}")), F.col(c)).alias(c) if c in fields else F.col(c) for c in new.columns))


def next_ids(existing: DataFrame, new: DataFrame, column: str, order: str, prefix: str = "P") -> DataFrame:
    """Rows with identifiers after the highest number in use, three digits at least."""
    number = F.regexp_extract(F.col(column), rf"^{prefix}(\d+)$", 1).try_cast("long")
    top = existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    out = numbered(new, order).crossJoin(F.broadcast(top))
    return out.withColumn(column, F.concat(F.lit(prefix), F.lpad((F.col("_top") + F.col("row_no")).cast("string"), F.greatest(F.lit(3), F.char_length((F.col("_top") + F.col("row_no")).cast("string"))), F.lit("0")))).drop("_top", "row_no")
