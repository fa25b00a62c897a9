"""Statute cross-reference between acts, enforcement decrees and regulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.functions import dicts as D
from regscope.functions import text as T
from regscope.operators.firstwins import first_wins


def cited_articles(rows: DataFrame) -> DataFrame:
    """Rows with ``refs``: act articles that body and title cite by name or in short."""
    text = F.concat(T.nz(F.col("body")), F.lit(" "), T.nz(F.col("jo_title")))
    return rows.withColumn("refs", F.array_union(T.citations_in(text, D.NAMED_LAW, "」"), T.citations_in(text, D.SHORT_LAW, "법"))).withColumn("decree_refs", T.citations_in(text, D.DECREE, "영"))


def delegated(column: Column) -> Column:
    """Act articles of ``법§N`` entries at their head."""
    numbers = F.transform(column, lambda d: F.regexp_extract(d, r"^법§(\d+)", 1).try_cast("int"))
    return F.filter(F.coalesce(numbers, F.array().cast("array<int>")), lambda n: n.isNotNull())


def crosswalk(enforce: DataFrame, regulation: DataFrame) -> DataFrame:
    """``side, id, jo_no, act_no`` of decree and regulation rows (``id, jo_no, jo_title, body, delegation_refs``).

    Decree rows without a citation stand at their own number. Regulation rows may also reach acts through the decree
    articles that they cite; without any way they have a null ``act_no`` (unmapped).
    """
    e = cited_articles(enforce)
    e = e.withColumn("acts", F.array_union("refs", delegated(F.col("delegation_refs"))))
    through = e.select(F.col("jo_no").alias("decree"), F.explode("refs").alias("act_no")).distinct()
    own = e.select(F.lit("enforce").alias("side"), "id", "jo_no", F.explode(F.when(F.size("acts") > 0, F.col("acts")).otherwise(F.array("jo_no"))).alias("act_no"))
    # texts are read once: a row's ways are act articles and decree articles, and the first way (or none) stands for the row
    r = cited_articles(regulation).withColumn("acts", F.array_union("refs", delegated(F.col("delegation_refs"))))
    no = F.lit(None).cast("int")
    ways = F.concat(F.transform("acts", lambda x: F.struct(x.alias("act"), no.alias("decree"))), F.transform("decree_refs", lambda x: F.struct(no.alias("act"), x.alias("decree"))))
    r = r.select("id", "jo_no", F.posexplode_outer(ways).alias("at", "way")).select("id", "jo_no", F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0).alias("row"), "way.act", "way.decree")
    reached = r.join(through, "decree", "left").select("id", "jo_no", "row", F.coalesce("act", "act_no").alias("act_no"))
    # one exchange by id serves both steps
    once = reached.repartition("id").groupBy("id", "jo_no", "act_no").agg(F.sum("row").alias("rows"))
    once = once.withColumn("mapped", F.count("act_no").over(Window.partitionBy("id")) > 0)
    times = F.when(F.col("act_no").isNotNull(), 1).when(F.col("mapped"), 0).otherwise(F.col("rows")).cast("int")
    mapped = once.select("id", "jo_no", F.explode(F.array_repeat("act_no", times)).alias("act_no"))
    return own.unionByName(mapped.withColumn("side", F.lit("regulation")).select("side", "id", "jo_no", "act_no"))


def cells(mapped: DataFrame, rows: DataFrame, order: str = "order_idx") -> DataFrame:
    """Per side and act article: labels and titles joined by `` / ``, formatted bodies by a blank line, in source order."""
    full = mapped.where("act_no IS NOT NULL").join(rows.select("id", order, "jo_label", "jo_title", "body"), "id")
    piece = F.struct(order, "id", T.nz(F.col("jo_label")).alias("label"), T.nz(F.col("jo_title")).alias("title"), T.format_statute_body(T.strip(F.col("body"))).alias("body"))
    rows_of = F.sort_array(F.collect_list(piece))
    join = lambda field, sep: F.array_join(F.filter(F.transform("items", lambda x: x[field]), lambda x: x != ""), sep)
    return full.groupBy("side", "act_no").agg(rows_of.alias("items")).select("side", "act_no", join("label", " / ").alias("label"), join("title", " / ").alias("title"), join("body", "\n\n").alias("body"))


def chapter_rows(acts: DataFrame, order: str = "order_idx") -> DataFrame:
    """Act rows as ``chapter`` or ``article``; rows with neither title nor body go, articles repeat by number, title and
    the body's first 80 characters only once."""
    title, body = T.strip(F.col("jo_title")), T.strip(F.col("body"))
    rows = acts.withColumn("title_", title).withColumn("body_", body).where("title_ <> '' OR body_ <> ''")
    head = T.U + D.CHAPTER
    rows = rows.withColumn("type", F.when((F.col("title_") == "") & F.col("body_").rlike(head), "chapter").otherwise("article"))
    rows = rows.withColumn("_key", F.when(F.col("type") == "chapter", F.lit("")).otherwise(F.concat_ws("|", "jo_no", "title_", F.substring("body_", 1, 80))))
    kept = first_wins(rows, "_key", order, keep_empty=True)
    label = F.when(F.col("type") == "chapter", T.space_free(F.regexp_extract("body_", head, 1))).otherwise(T.nz(F.col("jo_label")))
    shown = F.when(F.col("type") == "chapter", T.strip(F.regexp_extract("body_", head, 2))).otherwise(F.col("title_"))
    return kept.select("id", "jo_no", F.coalesce(F.col(order), F.col("jo_no")).alias("ord"), "type", label.alias("label"), shown.alias("title"), F.when(F.col("type") == "article", T.format_statute_body(F.col("body_"))).alias("body"))


def comparison(acts: DataFrame, enforce: DataFrame, regulation: DataFrame) -> DataFrame:
    """Rows of the three-level comparison in the order of the act: ``ord, type, jo_no, act, enforce, regulation``."""
    mapped = crosswalk(enforce, regulation)
    cell = cells(mapped, enforce.unionByName(regulation, allowMissingColumns=True))
    part = lambda side: cell.where(F.col("side") == side).select(F.col("act_no").alias("jo_no"), F.struct("label", "title", "body").alias(side))
    rows = chapter_rows(acts).withColumn("act", F.struct("label", "title", "body"))
    article = F.when(F.col("type") == "article", F.col("jo_no")).alias("jo_no")
    rows = rows.select("id", "ord", "type", article, "act")
    return rows.join(part("enforce"), "jo_no", "left").join(part("regulation"), "jo_no", "left").select("ord", "id", "type", "jo_no", "act", "enforce", "regulation")


def law_lookup(rows: DataFrame, name: str, column: str = "law_name") -> DataFrame:
    """Rows by name: contained; else, for a name without blanks, space-free containment among rows that share its first four
    characters; else, for a name with blanks, the name without them."""
    low = F.lower(F.col(column))
    tiers = [F.when(low.contains(name.lower()), 1)]
    if " " not in name and len(name) >= 4:
        tiers.append(F.when(low.contains(name[:4].lower()) & T.space_free(F.col(column)).contains(name), 2))
    if " " in name:
        tiers.append(F.when(low.contains(name.replace(" ", "").lower()), 3))
    found = rows.withColumn("_tier", F.coalesce(*tiers)).where("_tier IS NOT NULL")
    best = F.broadcast(found.agg(F.min("_tier").alias("_best")))
    return found.join(best, F.col("_tier") == F.col("_best")).drop("_tier", "_best")


def attach_children(rows: DataFrame, corpus: DataFrame, key: str = "id", law: str = "law_id", parent: str = "parent_law_id") -> DataFrame:
    """Rows and those of the corpus whose parent is one of the rows' laws, each identifier once."""
    children = corpus.join(rows.select(F.col(law).alias(parent)).distinct(), parent, "left_semi")
    return rows.unionByName(children.join(rows.select(key), key, "left_anti").select(*rows.columns))


def collect_refs(pairs: DataFrame, regulation: str, act: str) -> DataFrame:
    return pairs.where(F.col(act).isNotNull()).groupBy(regulation).agg(F.array_sort(F.collect_set(act)).alias("acts"))


def apply_mapping(regulations: DataFrame, mapping: DataFrame, key: str = "jo_no") -> DataFrame:
    """Add ``법§N`` entries of the mapping (``key, acts``) to ``delegation_refs``, order kept, each once."""
    joined = regulations.join(mapping, key, "left")
    old = F.coalesce("delegation_refs", F.array().cast("array<string>"))
    new = F.transform(F.coalesce("acts", F.array().cast("array<int>")), lambda n: F.concat(F.lit("법§"), n.cast("string")))
    return joined.withColumn("delegation_refs", F.array_distinct(F.concat(old, new))).select(*regulations.columns)
