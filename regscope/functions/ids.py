"""Keys, addresses and small conversions, Column to Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regscope.functions.dicts import CACHE_VERSION, SOURCE_LABELS
from regscope.functions.text import normalize_question


def cache_key(question: Column, laws: Column, kind: str | None = None, document: Column | None = None) -> Column:
    """SHA-1 of version, normalised question and sorted laws; the document form adds its kind and the document's SHA-256."""
    parts = [F.lit(CACHE_VERSION)]
    if kind is not None:
        parts += [F.lit(kind), F.sha2(F.coalesce(document, F.lit("")), 256)]
    parts += [normalize_question(question), F.array_join(F.array_sort(F.coalesce(laws, F.array().cast("array<string>"))), ",")]
    return F.sha1(F.concat_ws(":", *parts))


def short_id(*parts: Column) -> Column:
    """The first 12 hex digits of the MD5 of the first part that is not empty."""
    first = F.coalesce(*(F.nullif(p, F.lit("")) for p in parts), F.lit(""))
    return F.substring(F.md5(first), 1, 12)


def absolute_url(link: Column, base: str) -> Column:
    link = F.coalesce(link, F.lit(""))
    return F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link)


def url_host(link: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(link, F.lit("HOST")), F.lit("")))


def blocked_host(link: Column, hosts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hosts:
        out = out | url_host(link).contains(h)
    return out


def url_parameter(link: Column, name: str) -> Column:
    return F.try_parse_url(link, F.lit("QUERY"), F.lit(name))


def source_label(source: Column) -> Column:
    out = F.lit("사례")
    for key, label in SOURCE_LABELS.items():
        out = F.when(F.lower(F.coalesce(source, F.lit(""))) == key, label).otherwise(out)
    return out


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, rounded half to even."""
    return F.bround(part * 100.0 / whole, digits)


def json_array(text: Column) -> Column:
    """Strings of a JSON array; what is none is an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "")


def article_number(text: Column) -> Column:
    """The first digits of a label; branch numbers are lost, none is 0."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def decode_text(raw: Column) -> Column:
    """Bytes as text by the first encoding that fits: UTF-8 (a byte order mark goes), else CP949, else UTF-8 with marks for
    what is no text. Valid UTF-8 never reaches a Python worker's decoder."""
    plain = raw.cast("string")
    valid = F.is_valid_utf8(plain)
    return F.when(valid, F.regexp_replace(plain, "^\ufeff", "")).otherwise(_legacy(F.when(~valid, raw)))


@F.pandas_udf(StringType())
def _legacy(raw: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("cp949")
        except UnicodeDecodeError:
            return bytes(b).decode("utf-8", errors="replace")

    return raw.map(one)
