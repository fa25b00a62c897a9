"""Grading, filters and risk rules over articles (``title, body, agency, pub_date, link``), as Columns and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regscope.functions import dates, text as T
from regscope.functions import dicts as D
from regscope.operators.automaton import count_hits, hit_terms, with_hits

#: All words of the risk rules, in the order of their numbers.
RISK_WORDS = tuple(dict.fromkeys((*D.REGULATORY_WORDS, *D.REPUTATION_WORDS, *(w for words in D.AREA_WORDS.values() for w in words))))


def full_text(title: Column, body: Column) -> Column:
    return F.concat(T.nz(title), F.lit(" "), T.nz(body))


def priority_grade(title: Column, body: Column) -> Column:
    """상 from three points (a law's name or alias gives three, an action word one), 하 for low words without points, else 중."""
    text = full_text(title, body)
    points = 3 * T.count_words(text, D.LAW_NAMES + D.LAW_ALIASES) + T.count_words(text, D.ACTION_WORDS)
    low = T.count_words(text, D.LOW_WORDS)
    return F.when(points >= 3, "상").when((points == 0) & (low >= 1), "하").otherwise("중")


def grade_by_dictionary(articles: DataFrame, dictionary: DataFrame, key: str = "ord") -> DataFrame:
    """The grade from a dictionary table (``term, weight, class``), which may grow beyond what an expression can hold.

    One automaton finds all terms in one pass over each text.
    """
    terms = dictionary.where("class IN ('law', 'action', 'low') AND term <> ''").select("term", "weight", "class")
    hits = hit_terms(articles, full_text(F.col("title"), F.col("body")), terms, key).join(terms, "term")
    sums = hits.groupBy(key).agg(F.sum(F.when(F.col("class") != "low", F.col("weight"))).alias("points"), F.count_if(F.col("class") == "low").alias("low"))
    joined = articles.select(key).join(sums, key, "left")
    points, low = F.coalesce("points", F.lit(0)), F.coalesce("low", F.lit(0))
    return joined.select(key, F.when(points >= 3, "상").when((points == 0) & (low >= 1), "하").otherwise("중").alias("grade"))


def is_noise(title: Column, body: Column, agency: Column) -> Column:
    text = F.concat(T.nz(title), F.lit(" "), T.prefix(body, 500))
    return text.rlike(T.U + D.NOISE) | text.rlike(T.U + D.OFF_TOPIC) | T.strip(agency).isin(*D.BLOCKED_AGENCIES) | ~T.nz(title).rlike(T.U + D.TOPIC)


def is_overseas(title: Column, body: Column) -> Column:
    """Foreign words without a home context in title and the body's first 400 characters."""
    text = F.concat(T.nz(title), F.lit(" "), T.prefix(body, 400))
    return text.rlike(T.U + D.FOREIGN) & ~text.rlike(T.U + D.HOME)


def is_relevant(title: Column) -> Column:
    return ~T.contains_any(T.nz(title), D.BRIEFING_WORDS) & T.contains_any(T.nz(title), D.RELEVANT_WORDS)


def with_risk_hits(articles: DataFrame) -> DataFrame:
    """Articles with the numbers of the risk words in title and body, found in one pass: ``hits``."""
    return with_hits(articles, full_text(F.col("title"), F.col("body")), RISK_WORDS)


def impacted_areas(hits: Column) -> Column:
    """Areas with a word among the hits of :func:`with_risk_hits`, in dictionary order."""
    any_of = lambda words: F.arrays_overlap(hits, F.array(*(F.lit(RISK_WORDS.index(w)) for w in words)))
    return F.filter(F.array(*(F.when(any_of(words), F.lit(area)) for area, words in D.AREA_WORDS.items())), lambda x: x.isNotNull())


def risk_by_rule(hits: Column) -> tuple[Column, Column]:
    """Risk type and grade from the hits of :func:`with_risk_hits`: word counts and areas."""
    rules, harm = count_hits(hits, RISK_WORDS, D.REGULATORY_WORDS), count_hits(hits, RISK_WORDS, D.REPUTATION_WORDS)
    kind = F.when(rules >= 2, "규제").when(harm >= 2, "평판").when(rules >= 1, "규제").when(harm >= 1, "평판").otherwise("무관")
    score = F.when(kind == "규제", rules).when(kind == "평판", harm).otherwise(0)
    some = F.size(impacted_areas(hits)) > 0
    grade = F.when(~some, "무관").when(score >= 3, "상").when(score >= 1, "중").otherwise("하")
    return kind, grade


def category_of(title: Column) -> Column:
    """The first category with a word in the title, else null."""
    return F.coalesce(*(F.when(T.contains_any(T.nz(title), words), F.lit(name)) for name, words in D.CATEGORY_WORDS.items()))


def target_law(title: Column, body: Column) -> Column:
    """The law whose first fitting alias is longest: per law, the first alias in the text that beats the best so far ends
    the law's turn. A fold over the ordered aliases."""
    text = F.concat(T.nz(title), F.lit(" "), T.prefix(body, 1500))
    entries = F.array(*(F.struct(F.lit(law).alias("law"), F.lit(alias).alias("alias")) for law, aliases in D.LAW_DETECTION for alias in aliases))
    start = F.struct(F.lit("").alias("best"), F.lit(0).alias("size"), F.lit("").alias("done"))
    hit = lambda s, e: (s["done"] != e["law"]) & F.contains(text, e["alias"]) & (F.char_length(e["alias"]) > s["size"])
    take = lambda e: F.struct(e["law"].alias("best"), F.char_length(e["alias"]).alias("size"), e["law"].alias("done"))
    return F.aggregate(entries, start, lambda s, e: F.when(hit(s, e), take(e)).otherwise(s), lambda s: s["best"])


def attachment_only(text: Column) -> Column:
    return T.nz(text).rlike(T.U + D.ATTACHMENT_ONLY) | (F.char_length(T.strip(text)) < 80)


def title_still_matches(title: Column, law: Column) -> Column:
    return F.contains(T.space_free(title), F.substring(T.space_free(law), 1, 6))


def date_window(day: Column, as_of: str, days: int) -> Column:
    """The first 10 characters lie from ``as_of`` - (days-1) to ``as_of``, both in."""
    last = F.lit(as_of).cast("date")
    return F.substring(day, 1, 10).between(F.date_sub(last, days - 1).cast("string"), F.lit(as_of))


def legislation_today(bills: DataFrame, as_of: str, order: str = "ord") -> DataFrame:
    """Bills (``status, propose_date, target_law, bill_title``) whose stage falls on ``as_of``, first of each law and title."""
    from regscope.operators.firstwins import first_wins

    day = dates.event_date(F.col("status"), F.col("propose_date"))
    found = bills.where(T.contains_any(T.nz(F.col("status")), D.STAGE_WORDS) & (day == as_of))
    return first_wins(found, F.concat_ws("|", T.nz(F.col("target_law")), T.nz(F.col("bill_title"))), order)


def unmapped(rows: DataFrame) -> DataFrame:
    """Regulation rows (``body, jo_title``) that cite no act."""
    text = full_text(F.col("body"), F.col("jo_title"))
    return rows.where((F.col("law_type") == "regulation") & ~text.rlike(T.U + D.NAMED_LAW) & ~text.rlike(T.U + D.SHORT_LAW))


def allowed_sources(rows: DataFrame, types: list[str], column: str = "source", default: tuple[str, ...] = D.DEFAULT_SOURCES) -> DataFrame:
    return rows.where(F.col(column).isin(*(types or default)))


def normalise_risk(rows: DataFrame) -> DataFrame:
    """Risk records in their valid form: enums, cut texts, at most four changes without quotations or a repeated summary;
    without areas the record is irrelevant and has no action. Texts end in noun forms."""
    enum = lambda c, known: F.when(T.strip(F.col(c)).isin(*known), T.strip(F.col(c))).otherwise("무관")
    areas = F.filter(F.transform(F.coalesce("impacted_areas", F.array().cast("array<string>")), T.strip), lambda x: x != "")
    changes = F.coalesce(F.when(F.size("key_changes") > 0, F.col("key_changes")), F.col("key_points"), F.array().cast("array<string>"))
    changes = T.drop_quotes(F.filter(F.transform(changes, T.strip), lambda x: x != ""))
    # named columns, since a text that a later rule names twice would be made twice
    rows = rows.select(
        *[c for c in rows.columns if c not in ("policy_name", "summary", "future_plan", "risk_grade", "risk_type", "impacted_areas", "key_changes", "key_points", "recommended_action")],
        F.substring(T.strip_brackets(F.col("policy_name")), 1, 80).alias("policy_name"),
        F.substring(T.strip(F.col("summary")), 1, 140).alias("_summary"),
        F.substring(T.strip(F.col("future_plan")), 1, 200).alias("_plan"),
        enum("risk_grade", D.GRADES).alias("_grade"),
        enum("risk_type", D.TYPES).alias("_type"),
        areas.alias("impacted_areas"),
        changes.alias("_changes"),
        T.strip(F.col("recommended_action")).alias("_action"),
    )
    repeated = (F.col("_summary") != "") & (F.size("_changes") > 0) & F.coalesce(T.word_similar(F.col("_summary"), F.try_element_at("_changes", F.lit(1))), F.lit(False))
    rows = rows.withColumn("_changes", F.slice(F.when(repeated, F.slice("_changes", 2, 4)).otherwise(F.col("_changes")), 1, 4))
    void = (F.size("impacted_areas") == 0) & (F.col("_grade") != "무관")
    keep = [c for c in rows.columns if not c.startswith("_")]
    final = F.transform("_changes", T.noun_ending)
    return rows.select(
        *keep,
        T.noun_ending(F.col("_summary")).alias("summary"),
        T.noun_ending(F.col("_plan")).alias("future_plan"),
        F.when(void, "무관").otherwise(F.col("_grade")).alias("risk_grade"),
        F.when(void, "무관").otherwise(F.col("_type")).alias("risk_type"),
        final.alias("key_changes"),
        final.alias("key_points"),
        F.when(void, "").otherwise(T.noun_ending(F.col("_action"))).alias("recommended_action"),
    )


def risk_records(articles: DataFrame) -> DataFrame:
    """Rule-based risk records of articles, empty fields filled from title and body.

    Articles that fail the relevance gate are irrelevant and carry empty fields.
    """
    title, body = F.col("title"), F.col("body")
    columns, articles = articles.columns, with_risk_hits(articles)
    kind, grade = risk_by_rule(F.col("hits"))
    gate = is_relevant(title)
    quoteless = T.strip_brackets(F.regexp_replace(T.strip(title), "[\"“”'‘’][^\"“”'‘’]+[\"“”'‘’]", " "))
    plain = T.strip_brackets(title)
    minimal = T.strip(F.regexp_replace(T.strip(title), r"(?U)^\s*\[[^\]]{1,15}\]\s*", ""))
    long = F.filter(F.array(quoteless, plain), lambda x: F.char_length(x) >= 6)
    name = F.substring(F.coalesce(F.try_element_at(long, F.lit(1)), F.nullif(minimal, F.lit("")), T.strip(title)), 1, 60)
    rows = articles.select(
        *columns,
        gate.alias("gate"),
        F.when(gate, kind).otherwise("무관").alias("risk_type"),
        F.when(gate, grade).otherwise("무관").alias("risk_grade"),
        F.when(gate, impacted_areas(F.col("hits"))).otherwise(F.array().cast("array<string>")).alias("impacted_areas"),
        F.when(gate, name).otherwise("").alias("policy_name"),
        F.when(gate, T.key_sentences(body, 8, 20, 110)).otherwise(F.array().cast("array<string>")).alias("_points"),
        F.try_element_at(T.key_sentences(body, 1, 20, 80), F.lit(1)).alias("_first"),
    )
    summary = F.coalesce("_first", F.nullif(T.title_summary(F.col("title")), F.lit("")), "policy_name")
    rows = rows.withColumn("_summary", F.when(F.col("gate"), summary).otherwise(""))
    points = T.first_by_prefix(F.filter("_points", lambda s: ~T.word_similar(F.col("_summary"), s, 0.5)), 3)
    named = F.array_join(F.slice("impacted_areas", 1, 2), ", ")
    action = F.concat(named, F.when(F.col("risk_type") == "규제", D.DEFAULT_ACTIONS["규제"]).when(F.col("risk_type") == "평판", D.DEFAULT_ACTIONS["평판"]).otherwise(D.DEFAULT_ACTIONS[""]))
    changes = F.transform(points, T.noun_ending)
    return rows.select(
        *columns,
        "risk_grade",
        "risk_type",
        "impacted_areas",
        "policy_name",
        T.noun_ending(F.col("_summary")).alias("summary"),
        changes.alias("key_changes"),
        F.when(F.size("impacted_areas") > 0, T.noun_ending(action)).otherwise("").alias("recommended_action"),
        F.when(F.col("gate"), "rule").otherwise("pre-gate").alias("source_of_risk"),
    )
