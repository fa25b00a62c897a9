"""Registered streaming queries: each runs its stream over the stored events and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regscope import bindings as B
from regscope import catalog as K
from regscope.functions import text as T
from regscope.operators import classify as C
from regscope.operators import tables
from regscope.streaming import jobs


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, through a written table of the binding."""
    rows = tables.checkpointed(B.view(spark, d, B.STREAM_ROWS))
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    return jobs.file_stream(spark, path)


@K.query("SELECT 'u/' || CAST(user_id AS STRING) || '/' || event_type AS url FROM {events} GROUP BY 1")
def j1_unseen_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses never logged before, through the exact log."""
    log = tables.shared_path(spark)
    jobs.available_now(events(spark, d), writer=jobs.batch_writer(log, lambda b: b.select("url"), "url"))
    return jobs.logged(spark, log, "url string")


@K.query("SELECT category, day, n FROM (SELECT event_type AS category, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n, (SELECT max(ts) FROM {events}) AS last, CAST(ts AS DATE) AS d FROM {events} GROUP BY 1, 2, CAST(ts AS DATE)) WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= last - INTERVAL 3 DAY")
def j4_freshness(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.available_now(jobs.freshness(events(spark, d)))
    return spark.read.schema("day date, category string, n long").parquet(out).select(F.col("day").cast("string").alias("day"), "category", "n")


@K.query(f"SELECT ord, {K.GRADE} AS grade FROM {K.KR}")
def j5_grade_stream(spark: SparkSession, d: str) -> DataFrame:
    """The batch grade as a stream function: the same Columns."""
    rows = tables.checkpointed(K.kr(spark, d))
    stream = jobs.file_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0])
    out = jobs.available_now(stream.select("ord", C.priority_grade(F.col("title"), F.col("body")).alias("grade")))
    return spark.read.schema("ord long, grade string").parquet(out)


@K.query("SELECT 'u/' || CAST(user_id AS STRING) || '/' || event_type AS url, count(*) AS hits FROM {events} GROUP BY 1")
def j7_hit_counter(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.available_now(jobs.hit_counts(events(spark, d), "url"), "update")
    return jobs.logged(spark, out, "url string, hits long").groupBy("url").agg(F.max("hits").alias("hits"))


@K.query("""
WITH RECURSIVE e AS (SELECT 'u/' || CAST(user_id AS STRING) || '/' || event_type AS url, event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts FROM {events}),
p AS MATERIALIZED (SELECT * FROM e WHERE ts IS NOT NULL AND epoch_ms(ts) + 1 < (SELECT epoch_ms(max(ts)) FROM e) - 3 * 86400000),
r AS (SELECT url, event_id, ts FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts, event_id) = 1
UNION ALL SELECT p.url, p.event_id, p.ts FROM r JOIN p ON p.url = r.url AND p.ts > r.ts + INTERVAL 3 DAY QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY p.ts, p.event_id) = 1)
SELECT url, event_id, true AS dated FROM r UNION ALL SELECT url, event_id, false FROM e WHERE ts IS NULL""")
def j2_late_cut(spark: SparkSession, d: str) -> DataFrame:
    """First rows of each address by timers three days behind, and the undated rows, which count as recent and are all kept,
    on a path of their own."""
    rows = tables.checkpointed(B.view(spark, d, B.STREAM_ROWS).withColumn("ts", F.when(F.col("event_id") % 13 != 0, F.col("ts"))))
    stream = lambda: jobs.file_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], 1000)
    dated, undated = jobs.split_undated(stream())
    first = jobs.available_now(jobs.first_in_order(dated).select("url", "event_id"))
    rest = jobs.available_now(undated.select("url", "event_id"))
    read = lambda path, is_dated: spark.read.schema("url string, event_id long").parquet(path).withColumn("dated", F.lit(is_dated))
    return read(first, True).unionByName(read(rest, False))


@K.query("SELECT CAST(CAST(ts AS DATE) AS STRING) AS post_date FROM {events} GROUP BY 1")
def j3_one_post_a_day(spark: SparkSession, d: str) -> DataFrame:
    log = tables.shared_path(spark)
    work = lambda b: b.groupBy(F.to_date("ts").cast("string").alias("post_date")).agg(F.count(F.lit(1)).alias("total_items"))
    jobs.available_now(events(spark, d), writer=jobs.batch_writer(log, work, "post_date"))
    return jobs.logged(spark, log, "post_date string")


def _unlike_sql() -> str:
    from regscope.plans import composites as Q

    sets = f"{Q._tokens_sql("coalesce(title, '')")} AS tt, {Q._tokens_sql("coalesce(title, '') || ' ' || substr(coalesce(body, ''), 1, 1200)")} AS tb"
    day = lambda where: f"(SELECT *, {sets} FROM {K.KR} WHERE pub_date {where})"
    return f"SELECT ord, substr(coalesce(title, ''), 1, 80) AS title FROM {day("LIKE '1997-03-1_'")} f WHERE NOT EXISTS (SELECT 1 FROM {day("= '1997-03-09'")} y WHERE {Q._similar_sql('f', 'y')} OR (trim(f.link) <> '' AND f.link = y.link))"


@K.query(_unlike_sql())
def j6_unlike_yesterday(spark: SparkSession, d: str) -> DataFrame:
    """A stream of articles against a stored day, in batches."""
    rows = tables.checkpointed(K.kr(spark, d).where("pub_date LIKE '1997-03-1_'"))
    static = tables.checkpointed(K.kr(spark, d).where("pub_date = '1997-03-09'"))
    stream = jobs.file_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], 1000)
    log = tables.shared_path(spark)
    keyed = lambda b: jobs.unlike_yesterday(static)(b).select(F.col("ord").cast("string").alias("key"), "ord", T.prefix(F.col("title"), 80).alias("title"))
    jobs.available_now(stream, writer=jobs.batch_writer(log, keyed, "key"))
    return jobs.logged(spark, log, "ord long, title string")
