"""Readers of block texts, JSON records and statutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regscope.functions import text as T
from regscope.functions.register import ARTICLE

BODY_CHARS = 5000


def read_block_records(spark: SparkSession, path: str, fields: dict[str, str], require: str | None = None) -> DataFrame:
    """Records of files with ``===== name N =====`` blocks and one ``field: value`` line per field.

    ``fields`` maps output columns to labels. What stands before the first block is dropped, missing fields are empty;
    with ``require`` rows whose column is empty are dropped.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^=====.*\d+\s*=====\s*$")).alias("pos", "block")).where("pos > 0")
    rows = blocks.select(F.col("pos").alias("ord"), *(T.strip(F.regexp_extract("block", rf"(?m)^{label}: (.+)$", 1)).alias(name) for name, label in fields.items()))
    return rows.where(F.col(require) != "") if require else rows


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file as a table."""
    return spark.read.schema(schema).json(path, multiLine=True)


def flatten_statute(rows: DataFrame, column: str = "doc", key: str = "law_id") -> DataFrame:
    """Articles of statute JSON: ``law_id, pos, jo_label, jo_title, body``.

    Units may be a list or one object, paragraphs a list of objects or of texts; paragraph texts follow the body on lines of
    their own; empty bodies are dropped and long ones cut.
    """
    unit = F.expr(f"try_variant_get(try_parse_json({column}), '$.법령.조문.조문단위')")
    listed = F.coalesce(F.try_variant_get(unit, "$", "array<variant>"), F.array(unit))
    rows = rows.select(key, F.posexplode(listed).alias("pos", "unit")).where("unit IS NOT NULL")
    get = lambda name: T.strip(F.try_variant_get("unit", f"$.{name}", "string"))
    paragraphs = F.coalesce(F.try_variant_get("unit", "$.항", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(F.transform(paragraphs, lambda p: T.strip(F.coalesce(F.try_variant_get(p, "$.항내용", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))), lambda x: x != "")
    body = F.array_join(F.concat(F.filter(F.array(get("조문내용")), lambda x: x != ""), texts), "\n")
    label = F.when(get("조문번호").startswith("제"), get("조문번호")).when(get("조문번호") != "", F.concat(F.lit("제"), get("조문번호"), F.lit("조"))).otherwise("")
    return rows.select(key, "pos", label.alias("jo_label"), get("조문제목").alias("jo_title"), F.substring(body, 1, BODY_CHARS).alias("body")).where("body <> ''")


def split_articles(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """Articles of rule texts: ``key, pos, number, title, body``.

    A text with line breaks has its headings at line starts; a text in one line has only headings with a title in brackets.
    What precedes the first heading is dropped, as are headings without a body.
    """
    plain = T.strip(text)
    lined = F.contains(plain, F.lit("\n"))
    head_line = rf"(?U)^\s*{ARTICLE}\s*(?:\(([^)]*)\))?"
    head_blob = rf"(?U)^\s*{ARTICLE}\s*\(([^)]+)\)"
    pieces = F.when(lined, F.split(plain, rf"(?Um)(?=^\s*{ARTICLE})")).otherwise(F.split(plain, rf"(?U)(?={ARTICLE}\s*\([^)]+\))"))
    cut = rows.select(key, lined.alias("lined"), F.posexplode(pieces).alias("pos", "piece"))
    head = lambda k: F.when(F.col("lined"), F.regexp_extract("piece", head_line, k)).otherwise(F.regexp_extract("piece", head_blob, k))
    rest = F.when(F.col("lined"), F.regexp_replace("piece", head_line, "")).otherwise(F.regexp_replace("piece", head_blob, ""))
    number = F.concat(head(1), F.when(head(2) != "", F.concat(F.lit("-"), head(2))).when(head(3) != "", F.concat(F.lit("-"), head(3))).otherwise(""))
    return cut.select(key, "pos", number.alias("number"), T.strip(head(4)).alias("title"), T.strip(rest).alias("body")).where("number <> '' AND body <> ''")
