"""Main text of web pages by site style trees (Yi, Liu and Li, "Eliminating Noisy Information in Web Pages for Data Mining",
KDD 2003).

The pages of a host are merged into one tree. A node stands for the elements of one path of tags, classes and identifiers.
Its presentation importance is the entropy of the sequences of children that pages give it, to the base of the number of
pages that have it; a leaf's content importance is 1 less the mean entropy of its texts, links and images over those
pages. A node's composite importance weighs its own against its children's, level by level from the deepest. A branch in
which nothing is important repeats from page to page and is removed from each of them. Pages of a host that say the same
count once, as copies of an article don't make it a template. A host with one page has no low branch.

Elements whose names state a role, such as navigation, forms or an article, are judged by it first: their role is a
presentation that is the same on all sites. See :mod:`regscope.llm.markup` for the roles and what the main part of a page is.

Each page is read once; only pages with low branches are read again. A third of all pages may be of one host: counts are
taken before and after the shuffle, and no task holds a host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regscope.llm import markup
from regscope.llm.common import hash_strings, slices, stored

LEAST = 0.25  # importance below which a branch is a template's
DAMPING = 0.9  # by which each style of a node moves weight from its children to itself
ROWS = "array<struct<key: long, parent: long, depth: int, kind: int, value: long, share: double>>"


def with_page(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, html, host, page``: the address's host (empty if it has none) and the html's hash."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.withColumn("host", host).withColumn("page", F.xxhash64("html"))


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, page, body, text, rows, open``: what a page says by its roles, its part of its host's tree, and the
    branches that its roles leave open.

    ``body`` is the hash of that text. A page without a host has no part in a tree.
    """
    fields = ["key", "parent", "depth", "kind", "value", "share"]
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = markup.Keys()
        for batch in slices(batches, "html"):
            texts, upto, rows, left = [], [0], markup.TreeRows(), []
            for html, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
                page = markup.read_page(html or "")
                texts.append(markup.main_text(page, frozenset(), keys))
                left.append(markup.removable(page, keys) if host and html else [])
                if host and html:
                    rows.add(page, keys)
                upto.append(len(rows.key))
            values = hash_strings(pa.array(rows.value, pa.string())).view(np.int64)
            columns = [pa.array(rows.key, pa.int64()), pa.array(rows.parent, pa.int64()), pa.array(rows.depth, pa.int32()), pa.array(rows.kind, pa.int32()), pa.array(values), pa.array(rows.share, pa.float64())]
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(columns, fields))
            text = pa.array(texts, pa.string())
            body = pa.array(hash_strings(text).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "page")), body, text, lists, pa.array(left, pa.list_(pa.int64()))], ["page_id", "url", "host", "page", "body", "text", "rows", "open"])

    return pages.select("page_id", "url", "host", "page", "html").mapInArrow(work, f"page_id {kind}, url string, host string, page long, body long, text string, rows {ROWS}, open array<long>")


def node_table(seen: DataFrame) -> DataFrame:
    """``host, key, parent, depth, pages, styles, leaf, importance, share`` of every node of the hosts' trees."""
    once = seen.groupBy("host", "body").agg(F.min_by("rows", "page").alias("rows"))
    each = once.select("host", F.inline("rows")).groupBy("host", "key", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    style, n = F.col("kind") == 0, F.col("n")
    node = each.groupBy("host", "key").agg(
        F.min("parent").alias("parent"),
        F.min("depth").alias("depth"),
        F.sum(F.when(style, n)).alias("pages"),
        F.count_if(style).alias("styles"),
        F.sum(F.when(style, n * F.log(n.cast("double")))).alias("style_logs"),
        F.count_if(~style).alias("features"),
        F.sum(F.when(~style, F.log(n.cast("double")))).alias("feature_logs"),
        F.sum("share").alias("share"),
    )
    log = F.log(F.col("pages").cast("double"))
    content = 1 - F.col("feature_logs") / (F.col("features") * log)
    presentation = (log - F.col("style_logs") / F.col("pages")) / log
    importance = F.when(F.col("pages") < 2, 1.0).when(F.col("features") > 0, content).otherwise(presentation)
    return node.select("host", "key", "parent", "depth", "pages", "styles", (F.col("features") > 0).alias("leaf"), importance.alias("importance"), "share")


def composite(nodes: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, key, parent, depth, composite, peak``: composite importance, and the greatest of a node's branch.

    A node on one page has importance 1, and so has all below it; the others are taken a level at a time.
    """
    columns = ["host", "key", "parent", "depth", "share", "composite", "peak"]
    single = nodes.where("pages < 2").withColumn("composite", F.lit(1.0)).withColumn("peak", F.lit(1.0)).select(*columns)
    several = nodes.where("pages >= 2")
    deepest = several.agg(F.max("depth")).first()[0]
    done, below = single, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = several.where(F.col("depth") == depth)
        under = single.where(F.col("depth") == depth + 1)
        under = under if below is None else under.unionByName(below)
        sums = under.groupBy("host", F.col("parent").alias("key")).agg(F.sum(F.col("share") * F.col("composite")).alias("held"), F.max("peak").alias("under_peak"))
        keep = F.pow(F.lit(damping), F.col("styles"))
        whole = F.when(F.col("leaf") | F.col("held").isNull(), F.col("importance")).otherwise((1 - keep) * F.col("importance") + keep * F.col("held") / F.col("pages"))
        level = level.join(sums, ["host", "key"], "left").withColumn("composite", whole)
        below = stored(level.withColumn("peak", F.greatest("composite", F.coalesce("under_peak", F.lit(0.0)))).select(*columns))
        done = done.unionByName(below)
    return done


def low_branches(seen: DataFrame, least: float = LEAST, damping: float = DAMPING) -> DataFrame:
    """``host, key`` of nodes whose branch is unimportant throughout, in hosts where not everything is."""
    found = composite(stored(node_table(seen)), damping)
    low = found.where((F.col("peak") < least) & (F.col("depth") > 0)).select("host", "key")
    apart = found.where((F.col("depth") == 0) & (F.col("peak") >= least)).select("host").distinct()
    return low.join(apart, "host", "left_semi")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, damping: float = DAMPING) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    ``text`` holds the blocks of the page's main text in page order, joined by line feeds: character references decoded, white
    space inside a block turned into one space, blocks trimmed, empty ones left out. Line breaks and table cells are white space inside
    a block. Roles and low branches of the host's tree decide what is left out; nothing else is dropped or cut. Null and empty pages,
    and pages without main text, have an empty text. A page without a host in its address is judged by roles only. Html of any length and any brokenness is
    read to its end; a tag or script that nothing closes is no text. Equal rows give equal results, repeated identifiers
    are rows of their own. Other columns are ignored. Empty input gives no rows.
    """
    rows = with_page(pages, id_col, url_col, html_col)
    seen = stored(read_pages(rows), compression="zstd")
    low = stored(low_branches(seen, least, damping))
    marks = seen.select("host", "page", F.explode("open").alias("key")).join(low, ["host", "key"])
    marks = stored(marks.groupBy("host", "page").agg(F.collect_set("key").alias("low")))  # at most a page's elements
    kind = rows.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = markup.Keys()
        for batch in slices(batches, "html"):
            texts = []
            for html, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
                texts.append(markup.main_text(markup.read_page(html), frozenset(low), keys))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    plain = seen.join(marks.select("host", "page"), ["host", "page"], "left_anti").select("page_id", "url", "text")
    again = rows.join(marks, ["host", "page"]).select("page_id", "url", "html", "low").mapInArrow(work, f"page_id {kind}, url string, text string")
    return plain.unionByName(again).withColumn("n_chars", F.char_length("text").cast("long"))
