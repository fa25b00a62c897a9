"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, drop documents that hold benchmark
items, mix the sources, and write token ids. Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regscope.llm import decontaminate, mixing, near_dedup, token_output, toxicity
from regscope.llm.common import stored
from regscope.llm.queries import END_ID, held_out, read, vocabulary
from regscope.operators.tables import shared_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled rows among ``docs``."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out())
    return toxicity.accepted_rows(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. The mix carries the rows, so they are not joined with its decisions."""
    taken = mixing.mixed(docs, carry=True).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as read back from the token file: ``doc_id, start, n_tokens, ids_crc32``."""
    path = shared_path(spark)
    token_output.write_tokens(docs, path, vocabulary, END_ID)
    return token_output.read_tokens(spark, path, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark_documents),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: SQL can't express the classifier, the sampling keys or the tokenizer; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
