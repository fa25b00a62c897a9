"""First-wins operators: results depend on a total order, which every operator takes as a column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.functions.text import nz, space_free
from regscope.operators.tables import checkpointed

FINISH = 100_000


def first_wins(rows: DataFrame, key: Column | str, order: str = "ord", keep_empty: bool = False) -> DataFrame:
    """The first row of each key in ``order``. Rows with an empty key are dropped, or all kept with ``keep_empty``.

    The least order value of each key is found by a partial aggregation, so a hot key is a few rows in the shuffle.
    """
    key = F.col(key) if isinstance(key, str) else key
    named = rows.withColumn("_key", key.cast("string"))
    filled = named.where("_key IS NOT NULL AND _key <> ''")
    first = filled.groupBy("_key").agg(F.min(order).alias(order))
    kept = filled.join(first, ["_key", order], "left_semi")
    if keep_empty:
        kept = kept.unionByName(named.where("_key IS NULL OR _key = ''"))
    return kept.drop("_key")


def leaders(rows: DataFrame, edges: DataFrame, order: str = "ord") -> DataFrame:
    """Leader grouping: in ``order``, a row joins the earliest group whose leader is adjacent, else leads a group.

    ``edges`` holds pairs ``a, b`` of order values. The leaders are the lexicographically first maximal independent set,
    found in rounds: a row is dropped once an earlier neighbour is kept, and kept once all its earlier neighbours are
    dropped (Blelloch, Fineman and Shun, SPAA 2012). Each round works on the edges that are still open; a long chain takes
    a round for each link, so once at most ``FINISH`` edges are open one task walks them in order. Returns ``ord, leader``;
    a leader leads itself. Every round is a written table.
    """
    every = edges.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).where("early <> late").distinct()
    every = checkpointed(every)
    # 1 kept, 0 open, -1 dropped; rows without an earlier neighbour lead from the start
    late = every.select(F.col("late").alias(order)).distinct()
    state = checkpointed(rows.select(order).join(late.withColumn("open", F.lit(True)), order, "left").select(order, F.when(F.col("open"), 0).otherwise(1).alias("kept")))
    both = every
    while True:
        own = state.where("kept = 0").select(F.col(order).alias("late"))
        near = state.where("kept >= 0").select(F.col(order).alias("early"), F.col("kept").alias("near"))
        both = checkpointed(both.select("early", "late").join(own, "late").join(near, "early"))
        few = both.count() <= FINISH
        if few:
            kind = state.schema[order].dataType.simpleString()
            decided = both.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_walked, f"late {kind}, now int")
        else:
            decided = both.groupBy("late").agg(F.when(F.max("near") == 1, -1).otherwise(0).alias("now"))
        joined = state.join(decided.withColumnRenamed("late", order), order, "left")
        # an open row without open edges is kept
        state = checkpointed(joined.select(order, F.when(F.col("kept") != 0, F.col("kept")).otherwise(F.coalesce("now", F.lit(1))).alias("kept")))
        if few:
            break
    heads = state.where("kept = 1").select(F.col(order).alias("early"))
    joined = every.join(heads, "early").groupBy("late").agg(F.min("early").alias("leader")).withColumnRenamed("late", order)
    return state.join(joined, order, "left").select(order, F.when(F.col("kept") == 1, F.col(order)).otherwise(F.col("leader")).alias("leader"))


def _walked(edges: pa.Table) -> pa.Table:
    """The open rows of a bounded set of edges in order: dropped (-1) beside an earlier kept row, else kept (1)."""
    late = edges.column("late").to_pylist()
    earlier: dict = {k: [] for k in sorted(set(late))}
    for k, e, near in zip(late, edges.column("early").to_pylist(), edges.column("near").to_pylist(), strict=True):
        earlier[k].append((e, near))
    now: dict = {}
    for k, own in earlier.items():
        now[k] = -1 if any(near == 1 or now.get(e, 1) == 1 for e, near in own) else 1
    return pa.table({"late": pa.array(list(now), edges.schema.field("late").type), "now": pa.array(list(now.values()), pa.int32())})


def first_wins_multi(rows: DataFrame, order: str = "ord", link: str = "link", title: str = "title") -> DataFrame:
    """Rows of which neither the link nor the space-free title stood on an earlier kept row; dropped rows mark nothing.

    Seen as edges between links and titles, the kept rows are the lexicographically first maximal matching. Each round
    keeps the rows that are least among the open ones of both their link and their title, and drops the open rows that
    share one with them, so a link's or title's rows are never paired. Every round is a written table.
    """
    keyed = rows.select(order, nz(F.col(link)).alias("_l"), space_free(F.col(title)).alias("_t"))
    plain = keyed.where("_l = '' AND _t = ''").select(order)
    # of equal pairs only the first can be kept
    state = checkpointed(keyed.where("_l <> '' OR _t <> ''").groupBy("_l", "_t").agg(F.min(order).alias(order)))
    kept = []
    while not state.isEmpty():
        least = lambda k: state.where(F.col(k) != "").groupBy(k).agg(F.min(order).alias(f"{k}_min"))
        ranked = state.join(least("_l"), "_l", "left").join(least("_t"), "_t", "left")
        free = lambda k: (F.col(k) == "") | (F.col(order) == F.col(f"{k}_min"))
        now = checkpointed(ranked.where(free("_l") & free("_t")).select(order, "_l", "_t"))
        kept.append(now.select(order))
        for k in ("_l", "_t"):
            state = state.join(now.where(F.col(k) != "").select(k).distinct(), k, "left_anti")
        state = checkpointed(state.join(now.select(order), order, "left_anti").select("_l", "_t", order))
    for k in kept:
        plain = plain.unionByName(k)
    return rows.join(plain, order, "left_semi")


def representatives(rows: DataFrame, group: str, body: str = "body", agency: str = "agency", order: str = "ord") -> DataFrame:
    """One row per group: longest body, then the most trusted agency, then the first."""
    from regscope.functions.text import agency_rank

    rank = F.struct((-F.char_length(nz(F.col(body)))).alias("n"), agency_rank(F.col(agency)).alias("r"), F.col(order).alias("o"))
    best = rows.groupBy(group).agg(F.min(rank).alias("best")).select(F.col("best.o").alias(order))
    return rows.join(best, order, "left_semi")


def top_k(rows: DataFrame, score: Column, k: int, order: str = "ord") -> DataFrame:
    """The ``k`` best rows of positive score, ties in order."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), order).limit(k).where("score > 0")


def order_index(rows: DataFrame, keys: list[str], order: str, body: str = "body") -> DataFrame:
    """1..n in each group of keys after rows with empty bodies are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.where(nz(F.col(body)) != "").withColumn("order_idx", F.row_number().over(w))


def batch_number(rows: DataFrame, order: str, n: int = 5, group: str | None = None) -> DataFrame:
    """Batches of ``n`` rows in order. Rows are numbered in ranges of the order column: counts per range are summed, and
    each range is numbered by itself, so no task sorts all rows."""
    from regscope.operators.tables import numbered

    return numbered(rows, order, group).withColumn("batch", F.floor((F.col("row_no") - 1) / n).cast("long")).drop("row_no")
