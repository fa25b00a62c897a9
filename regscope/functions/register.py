"""SQL names of the functions, for use in ``spark.sql``: SQL functions and table functions that Catalyst inlines, no Python
behind them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from regscope.functions.text import BLANKS

TOKENS = r"array_distinct(regexp_extract_all(coalesce(a, ''), '[가-힣A-Za-z0-9]+', 0))"

_BLANKS = "'" + "".join(f"\\u{ord(x):04x}" for x in BLANKS) + "'"

#: name: (parameters, result type, SQL)
FUNCTIONS = {
    "squeeze": ("a STRING", "STRING", r"regexp_replace(coalesce(a, ''), '(?U)\\s+', ' ')"),
    "space_free": ("a STRING", "STRING", r"regexp_replace(coalesce(a, ''), '(?U)\\s+', '')"),
    "strip_text": ("a STRING", "STRING", f"btrim(coalesce(a, ''), {_BLANKS})"),
    "norm_heading": ("a STRING", "STRING", r"regexp_replace(coalesce(a, ''), '(?U)[\\s·ㆍ・‧]+', '')"),
    "normalize_question": ("a STRING", "STRING", "lower(squeeze(strip_text(a)))"),
    "word_set": ("a STRING", "ARRAY<STRING>", TOKENS),
    "set_jaccard": ("x ARRAY<STRING>, y ARRAY<STRING>", "DOUBLE", "CASE WHEN size(x) > 0 AND size(y) > 0 THEN size(array_intersect(x, y)) / size(array_union(x, y)) ELSE 0D END"),
    "word_jaccard": ("x STRING, y STRING", "DOUBLE", "set_jaccard(word_set(x), word_set(y))"),
    "cache_key": ("question STRING, laws ARRAY<STRING>", "STRING", "sha1(concat_ws(':', 'v3', normalize_question(question), array_join(array_sort(coalesce(laws, array())), ',')))"),
    "norm_bill_date": ("a STRING", "STRING", r"CASE WHEN a RLIKE '(?U)(\\d{4})[.\\s-]+(\\d{1,2})[.\\s-]+(\\d{1,2})' THEN concat(regexp_extract(a, '(?U)(\\d{4})[.\\s-]+(\\d{1,2})[.\\s-]+(\\d{1,2})', 1), '.', lpad(regexp_extract(a, '(?U)(\\d{4})[.\\s-]+(\\d{1,2})[.\\s-]+(\\d{1,2})', 2), 2, '0'), '.', lpad(regexp_extract(a, '(?U)(\\d{4})[.\\s-]+(\\d{1,2})[.\\s-]+(\\d{1,2})', 3), 2, '0'), '.') ELSE coalesce(a, '') END"),
    "safe_name": ("a STRING", "STRING", r"""regexp_replace(a, '[\\\\/:*?"<>|]', '')"""),
    "percent_of": ("part DOUBLE, whole DOUBLE", "DOUBLE", "bround(part * 100 / whole, 1)"),
    "article_number": ("a STRING", "INT", r"coalesce(try_cast(nullif(regexp_extract(coalesce(a, ''), '(\\d+)', 1), '') AS INT), 0)"),
}

#: An article's heading: number, branch or second number.
ARTICLE = r"제\s*(\d+)\s*(?:[-\s]\s*(\d+))?\s*(?:조의\s*(\d+))?\s*조"
_PLAIN = f"btrim(coalesce(a, ''), {_BLANKS})"

#: name: (parameters, columns, query); for use as ``FROM rows, LATERAL name(column)``
TABLE_FUNCTIONS = {
    "split_articles": (
        "a STRING",
        "pos INT, number STRING, title STRING, body STRING",
        rf"""SELECT pos, concat(h1, CASE WHEN h2 <> '' THEN concat('-', h2) WHEN h3 <> '' THEN concat('-', h3) ELSE '' END), strip_text(h4), strip_text(rest)
        FROM (SELECT pos, regexp_extract(piece, head, 1) AS h1, regexp_extract(piece, head, 2) AS h2, regexp_extract(piece, head, 3) AS h3, regexp_extract(piece, head, 4) AS h4, regexp_replace(piece, head, '') AS rest
        FROM (SELECT pos, piece, CASE WHEN contains({_PLAIN}, chr(10)) THEN r'(?U)^\s*{ARTICLE}\s*(?:\(([^)]*)\))?' ELSE r'(?U)^\s*{ARTICLE}\s*\(([^)]+)\)' END AS head
        FROM posexplode(CASE WHEN contains({_PLAIN}, chr(10)) THEN split({_PLAIN}, r'(?Um)(?=^\s*{ARTICLE})') ELSE split({_PLAIN}, r'(?U)(?={ARTICLE}\s*\([^)]+\))') END) AS t(pos, piece)))
        WHERE h1 <> '' AND strip_text(rest) <> ''""",
    ),
    "text_lines": (
        "a STRING",
        "pos INT, line STRING",
        "SELECT pos, line FROM posexplode(split(coalesce(a, ''), chr(10))) AS t(pos, line)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` in this session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [*FUNCTIONS, *TABLE_FUNCTIONS]
