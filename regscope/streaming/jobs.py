"""Structured Streaming jobs of the monitor: unseen addresses, late data, one post a day, freshness, hit counts.

Each job takes a streaming DataFrame. ``available_now`` drives one to its end over the rows that are there, which is how
the tests and the registered queries compare streams with batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regscope.operators import joins, simjoin, tables


def file_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A stream over the Parquet files at ``path``, a few files at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def unseen(stream: DataFrame, key: str = "url", ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """The first row of each address within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def first_in_order(stream: DataFrame, key: str = "url", ts: str = "ts", ident: str = "event_id", days: int = 3, groups: int = 512) -> DataFrame:
    """``key, ident, ts``: the first row of each address in order of time and identifier; ``days`` after it the address is new
    again. Rows come out once the watermark, ``days`` behind the latest row, has passed them, and rows behind it are cut.

    Keyed state with event-time timers: a group of addresses (by a hash, one of ``groups``) holds the time of each address's
    last row given out and the rows the watermark has not passed yet, which are taken in order when its timer fires. So the
    result doesn't depend on how rows fall into batches, as long as none comes too late. An address without waiting rows is
    forgotten when it is new again. A call of the worker costs milliseconds, so addresses are not called one by one; a call
    holds its group's share of a batch and of ``days`` days.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    span = days * 86_400_000

    def packed(frame: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(frame, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def work(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, parts = {}, []
        if state.exists:
            told, waiting = (pa.ipc.open_stream(x).read_pandas() for x in state.get)
            last = dict(zip(told["key"], told["last"].tolist(), strict=True))
            parts.append(waiting)
        if not state.hasTimedOut:
            parts += [pd.DataFrame({"key": pdf[key], "at": pdf[ts].astype("datetime64[ns]").astype("int64"), "id": pdf[ident]}) for pdf in frames]
        rows = pd.concat(parts, ignore_index=True)
        mark = state.getCurrentWatermarkMs()
        due = rows["at"] // 1_000_000 + 1
        waiting = rows[due >= mark]
        passed = rows[due < mark].sort_values(["at", "id"])
        out = []
        for name, at, i in zip(passed["key"].tolist(), passed["at"].tolist(), passed["id"].tolist(), strict=True):
            if at // 1_000 > last.get(name, -1 << 60):
                out.append((name, i, pd.Timestamp(at)))
                last[name] = at // 1_000 + span * 1_000
        still = set(waiting["key"])
        last = {name: to for name, to in last.items() if to // 1_000 + 1 > mark or name in still}
        if last or len(waiting):
            state.update((packed(pd.DataFrame({"key": list(last), "last": pd.Series(list(last.values()), dtype="int64")})), packed(waiting)))
            timers = [to // 1_000 + 1 for name, to in last.items() if name not in still]
            state.setTimeoutTimestamp(max(min([*timers, *([int(due[waiting.index].min())] if len(waiting) else [])]), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, ident, ts])

    dated = stream.select(key, ident, ts).withWatermark(ts, f"{days} days").withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    out = f"{key} {fields[key]}, {ident} {fields[ident]}, {ts} {fields[ts]}"
    return dated.groupBy("_group").applyInPandasWithState(work, out, "last binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def freshness(stream: DataFrame, category: str = "category", ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """Rows per category and day; a day is final once the watermark has passed it."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), category).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), category, "n")


def hit_counts(stream: DataFrame, key: str = "cache_key") -> DataFrame:
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


def split_undated(stream: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Dated rows for the watermark, and undated rows, which the batch rule keeps, on a path of their own."""
    return stream.where(F.col(ts).isNotNull()), stream.where(F.col(ts).isNull())


def batch_writer(log_path: str, work: Callable[[DataFrame], DataFrame], key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds ``work``'s rows of unseen keys to the table at ``log_path``.

    The batch number is part of the path that is overwritten, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = work(batch)
        try:
            before = spark.read.parquet(log_path).where(F.col("batch") < number)
            done = joins.unsent(done, before, key)
        except Exception as e:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        least = F.struct(*(c for c in done.columns if c != key))
        once = done.groupBy(key).agg(F.min(least).alias("r")).select(key, "r.*")
        once.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log_path)

    return write


def logged(spark: SparkSession, log_path: str, schema: str) -> DataFrame:
    """What :func:`batch_writer` wrote to ``log_path``; without rows, as when each batch dropped all of its own, an empty table."""
    blank = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(log_path).select(*blank.columns)
    except AnalysisException as e:  # no batch ran
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return blank


def unlike_yesterday(static: DataFrame, **rule: object) -> Callable[[DataFrame], DataFrame]:
    """For ``batch_writer``: drop rows that are similar to the stored day."""
    return lambda batch: simjoin.drop_similar(batch, static, **rule)


def available_now(stream: DataFrame, mode: str = "append", writer: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over what is there and stop; the path of the written table (with ``writer``: of its checkpoint)."""
    out, state = tables.shared_path(stream.sparkSession), tables.shared_path(stream.sparkSession)
    put = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if writer:
        job = put.foreachBatch(writer).start()
    elif mode == "append":
        job = put.outputMode("append").format("parquet").option("path", out).start()
    else:
        # the last value of each key wins: batches are numbered partitions, and one that runs again replaces itself
        numbered = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        job = put.outputMode(mode).foreachBatch(numbered).start()
    job.awaitTermination()
    return out
