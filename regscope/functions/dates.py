"""Date rules, Column to Column. Each rule is its own; what is no calendar date becomes null or stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regscope.functions.dicts import WEEKDAYS

SPACED = r"(?U)(\d{4})[.\s-]+(\d{1,2})[.\s-]+(\d{1,2})"
TIGHT = r"(?U)(\d{4})\D?(\d{1,2})\D?(\d{1,2})"


def _parts(text: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]


def _joined(text: Column, pattern: str, sep: str, end: str = "") -> Column:
    y, m, d = _parts(text, pattern)
    return F.concat(y, F.lit(sep), F.lpad(m, 2, "0"), F.lit(sep), F.lpad(d, 2, "0"), F.lit(end))


def norm_bill_date(text: Column) -> Column:
    """``YYYY.MM.DD.`` of the first spaced, dotted or dashed date; other texts unchanged, null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(SPACED), _joined(text, SPACED, ".", ".")).otherwise(text)


def norm_case_date(text: Column) -> Column:
    """As above with at most one sign between the parts, so 20250925 is a date and '2025. 9. 25.' is left alone."""
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(TIGHT), _joined(text, TIGHT, ".", ".")).otherwise(text)


def norm_reply_date(text: Column) -> Column:
    """Dashes to dots and a dot at the end; nothing is padded."""
    dotted = F.translate(F.trim(F.coalesce(text, F.lit(""))), "-", ".")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(dotted.endswith("."), dotted).otherwise(F.concat(dotted, F.lit(".")))


def event_date(status: Column, proposed: Column) -> Column:
    """ISO text of the date in brackets in the status, else of the proposal date, else null."""
    bracket = r"(?U)\((\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})"
    status, proposed = F.coalesce(status, F.lit("")), F.coalesce(proposed, F.lit(""))
    return F.when(status.rlike(bracket), _joined(status, bracket, "-")).when(proposed.rlike(SPACED), _joined(proposed, SPACED, "-"))


def display_date(text: Column) -> Column:
    """``2026-04-23`` as ``'26.4.23(목)``; what is no such date stays."""
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))
    name = F.element_at(F.array(*(F.lit(x) for x in WEEKDAYS)), (F.weekday(day) + 1).cast("int"))
    shown = F.concat(F.lit("'"), F.substring(F.year(day).cast("string"), 3, 2), F.lit("."), F.month(day), F.lit("."), F.dayofmonth(day), F.lit("("), name, F.lit(")"))
    return F.coalesce(shown, text)


def press_date(text: Column, as_of: Column) -> Column:
    """``20YYMMDD`` of the first heading line with ``'YY. M. D``, else ``as_of`` as YYYYMMDD."""
    pattern = r"(?U)'(\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})"
    found = F.try_element_at(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.startswith("◆") & x.rlike(pattern)), F.lit(1))
    return F.coalesce(F.concat(F.lit("20"), _joined(found, pattern, "")), F.date_format(as_of, "yyyyMMdd"))


def proposal_date(text: Column) -> Column:
    """The date in brackets inside the proposer's text, normalised; none: empty."""
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\((\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.?)\)", 1)
    return norm_bill_date(inner)


def age_date(text: Column) -> Column:
    """Date of a leading ``Y.M.D`` (or - or /); null where it is none or not in the calendar."""
    pattern = r"^\s*(\d{4})[./-](\d{1,2})[./-](\d{1,2})"
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(pattern), _joined(text, pattern, "-").try_cast("date"))


def is_recent(text: Column, as_of: Column, days: int = 3) -> Column:
    """Age of at most ``days``; dates that are missing or unreadable count as recent, future ones too."""
    return F.coalesce(F.datediff(as_of, age_date(text)) <= days, F.lit(True))


def news_date(text: Column) -> Column:
    """The sender's local date of an RFC 822 time; bad texts null."""
    plain = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{1,2} [A-Z][a-z]{2} \d{4}) \d{2}:\d{2}:\d{2}", 1)
    padded = F.when(plain.rlike(r"^\d "), F.concat(F.lit("0"), plain)).otherwise(plain)
    return F.try_to_timestamp(F.nullif(padded, F.lit("")), F.lit("dd MMM yyyy")).cast("date")
