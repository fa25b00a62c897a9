"""Search: token index, scores, caches, context blocks and citations, for many requests at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regscope.functions import text as T
from regscope.functions.ids import cache_key, source_label
from regscope.operators.tables import checkpointed, shared_path

SHARD_TOKENS = 4_000_000  # tokens of a shard or of a block of requests: 32 MB
POSTED = 8192  # postings, and items, of a piece of a shard
SLACK = 1e-12


def union_corpora(cases: DataFrame, statutes: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Two tables under one schema; columns that a side lacks get their default."""
    both = cases.unionByName(statutes, allowMissingColumns=True)
    return both.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in both.columns))


def build_index(items: DataFrame, key: str, tokens: Column, shards: int | None = None) -> DataFrame:
    """A stored inverted index: ``shard, piece, keys, sizes, tokens, counts, places``.

    Items fall into shards of about ``SHARD_TOKENS`` tokens by a hash of their keys. A shard's items have a place each, in
    the order of their keys; its postings are the places of each token's items, token after token. Both are cut into pieces of
    ``POSTED``, a row each: ``keys`` and ``sizes`` (of their token sets) of a piece's items, and its ``tokens``, of which each has
    so many (``counts``) of its ``places``. Items without tokens are left out. 64-bit hashes stand for tokens.
    """
    rows = checkpointed(items.select(F.col(key).alias("key"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("own"))).where(F.size("own") > 0)
    if shards is None:
        total = rows.agg(F.sum(F.size("own").cast("long"))).first()[0] or 0
        shards = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TOKENS))
    kind = rows.schema["key"].dataType.simpleString()

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("key")
        keys = shard.column("key").combine_chunks()
        lists = shard.column("own").combine_chunks().cast(pa.list_(pa.int64()))
        size = np.diff(lists.offsets.to_numpy())
        token = lists.flatten().to_numpy()
        order = np.argsort(token, kind="stable")
        token, place = token[order], np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        pieces = max(-(-len(place) // POSTED), -(-len(size) // POSTED))
        parts: dict[str, list] = {"keys": [], "sizes": [], "tokens": [], "counts": [], "places": []}
        for a in range(0, pieces * POSTED, POSTED):
            own = token[a : a + POSTED]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            for name, x in (("keys", keys[a : a + POSTED]), ("sizes", size[a : a + POSTED]), ("tokens", own[first]), ("counts", np.diff(np.append(first, len(own)))), ("places", place[a : a + POSTED])):
                parts[name].append(x)

        def column(name: str, t: pa.DataType) -> pa.Array:
            ends = np.append(0, np.cumsum([len(x) for x in parts[name]])).astype(np.int32)
            flat = pa.concat_arrays(parts[name]) if name == "keys" else pa.array(np.concatenate(parts[name]), t)
            return pa.ListArray.from_arrays(pa.array(ends), flat)

        return pa.table({
            "shard": pa.array(np.full(pieces, shard.column("shard")[0].as_py(), np.int32)),
            "piece": pa.array(np.arange(pieces, dtype=np.int32)),
            "keys": column("keys", keys.type),
            **{name: column(name, pa.int64() if name == "tokens" else pa.int32()) for name in ("sizes", "tokens", "counts", "places")},
        })

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(build, f"shard int, piece int, keys array<{kind}>, sizes array<int>, tokens array<long>, counts array<int>, places array<int>")
    path = shared_path(items.sparkSession)
    index.write.option("parquet.block.size", 1 << 24).parquet(path)  # rows are long: a reader holds many at once
    return items.sparkSession.read.schema(index.schema).parquet(path)


class Shard:
    """One shard of the index, in arrays."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("piece")
        flat = lambda name: rows.column(name).combine_chunks().flatten()
        self.keys = flat("keys")
        self.size = flat("sizes").to_numpy().astype(np.int64)
        self.places = flat("places").to_numpy()
        token, count = flat("tokens").to_numpy(), flat("counts").to_numpy()
        # a token that two pieces share has its postings one after another
        new = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        self.token = token[new]
        self.bounds = np.append(np.append(0, np.cumsum(count, dtype=np.int64))[:-1][new], len(self.places))

    def best(self, tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best items of a set of tokens by Jaccard, ties by key.

        All postings of the tokens are counted in one pass, so every shared token counts. An item that shares c of m tokens
        scores at most c / m, so with the k-th best score of the ``k`` items that share most, only those that share enough to
        reach it get a score.
        """
        m = len(tokens)
        at = np.searchsorted(self.token, tokens)
        held = at < len(self.token)
        at = at[held][self.token[at[held]] == tokens[held]]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        shared = np.bincount(np.concatenate([self.places[i:j] for i, j in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist(), strict=True)]), minlength=len(self.size))
        need = 1
        if len(shared) > k:
            top = np.argpartition(shared, len(shared) - k)[len(shared) - k :]
            least = float((shared[top] / (self.size[top] + m - shared[top])).min())
            need = max(1, math.ceil((least - SLACK) * m))
        on = np.flatnonzero(shared >= need)
        score = shared[on] / (self.size[on] + m - shared[on])
        if len(on) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            on, score = on[near], score[near]
        # places follow the keys' order
        first = np.lexsort((on, -score))[:k]
        return on[first], score[first]


def top_matches(items: DataFrame, requests: DataFrame, key: str, request: str, item_tokens: Column, request_tokens: Column, k: int) -> DataFrame:
    """``request, key, score, rank``: of each request the ``k`` best items by Jaccard of token sets, ties by key; items that
    share no token are absent. See :func:`build_index` and :func:`search_index`."""
    return search_index(build_index(items, key, item_tokens), requests, request, request_tokens, k).withColumnRenamed("key", key)


def search_index(index: DataFrame, requests: DataFrame, request: str, tokens: Column, k: int) -> DataFrame:
    """``request, key, score, rank`` of all requests against a stored index.

    Requests are a table too: they fall into blocks of about ``SHARD_TOKENS`` tokens, and each block meets each shard in one
    task, which holds these two and keeps the ``k`` best of each request. Neither is on the driver or in a closure.
    """
    asked = checkpointed(requests.select(F.col(request).alias("request"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("tokens"))).where(F.size("tokens") > 0)
    total = asked.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // SHARD_TOKENS))
    kinds = asked.schema["request"].dataType.simpleString(), index.schema["keys"].dataType.elementType.simpleString()
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))
    last = index.agg(F.max("shard")).first()[0] or 0
    right = asked.select("request", "tokens", F.pmod(F.xxhash64("request"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"))

    def meet(shard: pa.Table, asked: pa.Table) -> pa.Table:
        names, items, scores = [], [], []
        kinds = asked.schema.field("request").type, shard.schema.field("keys").type.value_type
        if shard.num_rows and asked.num_rows:
            lists = asked.column("tokens").combine_chunks()
            own = Shard(shard)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            bounds = bounds - bounds[0]
            for j in range(asked.num_rows):
                on, score = own.best(flat[bounds[j] : bounds[j + 1]], k)
                names.append(np.full(len(on), j))
                items.append(on)
                scores.append(score)
        if not names:
            return pa.table({"request": pa.nulls(0, kinds[0]), "key": pa.nulls(0, kinds[1]), "score": pa.nulls(0, pa.float64())})
        return pa.table({"request": asked.column("request").take(pa.array(np.concatenate(names))), "key": own.keys.take(pa.array(np.concatenate(items))), "score": pa.array(np.concatenate(scores))})

    out = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, f"request {kinds[0]}, key {kinds[1]}, score double")
    return ranked(out.withColumnRenamed("request", request), request, "key", k)


def ranked(found: DataFrame, request: str, key: str, k: int) -> DataFrame:
    """The best ``k`` per request, ties by key: a partial top-k first, so no request's rows gather in one task."""
    top = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
    parts = found.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    near = parts.withColumn("_r", F.row_number().over(Window.partitionBy(request, "_salt").orderBy(top))).where(F.col("_r") <= k)
    w = Window.partitionBy(request).orderBy(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_salt", "_r")


def clamp_limit(n: Column) -> Column:
    return F.least(F.greatest(n, F.lit(1)), F.lit(200))


def search(items: DataFrame, question: str, k: int, key: str, text: Column, pattern: str = r"[가-힣]{2,}", stop: tuple[str, ...] = ()) -> DataFrame:
    """Items by Jaccard of their and the question's tokens, best first; without question tokens the first ``k`` items."""
    spark = items.sparkSession
    asked = spark.range(1).select(T.tokens(F.lit(question), pattern, stop).alias("q"))
    if asked.where(F.size("q") > 0).isEmpty():
        return items.withColumn("score", F.lit(0.0)).orderBy(key).limit(k)
    own = T.tokens(text, pattern, stop)
    query = T.tokens(F.lit(question), pattern, stop)
    # positive scores come first, so the test after the limit gives the same rows and no score is computed twice
    return items.withColumn("score", T.jaccard(own, query)).orderBy(F.desc("score"), key).limit(k).where("score > 0")


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """The cache after ``requests`` (``question, laws``): hits counted and dated, misses added with count 1."""
    asked = requests.select(cache_key(F.col("question"), F.col("laws")).alias("cache_key"), "question", F.array_join(F.array_sort("laws"), ",").alias("law_ids"))
    asked = asked.groupBy("cache_key").agg(F.count(F.lit(1)).alias("hits"), F.min("question").alias("q"), F.min("law_ids").alias("l"))
    both = cache.join(asked, "cache_key", "full_outer")
    return both.select(
        "cache_key",
        F.coalesce("question", "q").alias("question"),
        F.coalesce("law_ids", "l").alias("law_ids"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("hit_count"),
        F.when(F.col("hits").isNotNull(), as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def context_block(rank: Column, source: Column, title: Column, agency: Column, day: Column, summary: Column, body: Column, summary_chars: int = 600, body_chars: int = 800) -> Column:
    """One numbered block of a candidate; empty parts are left out."""
    s, b = T.prefix(T.strip(summary), summary_chars), T.prefix(T.strip(body), body_chars)
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), source_label(source), F.lit(") "), T.strip(title), F.lit("\n    기관: "), T.strip(agency), F.lit(" | 일자: "), T.strip(day), F.lit("\n"))
    return F.concat(head, F.when(s != "", F.concat(F.lit("    질의/요지: "), s, F.lit("\n"))).otherwise(""), F.when(b != "", F.concat(F.lit("    회신/판결: "), b, F.lit("\n"))).otherwise(""))


def context_blocks(candidates: DataFrame, request: str, most: int = 20) -> DataFrame:
    """One text per request: blocks of the candidates (``rank`` up to ``most``) in rank order."""
    cols = [F.coalesce(F.col(c), F.lit("")) if c in candidates.columns else F.lit("") for c in ("source", "title", "agency", "decided_at", "summary", "body")]
    made = candidates.where(F.col("rank") <= most).select(request, "rank", context_block(F.col("rank"), *cols).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return made.groupBy(request).agg(F.array_join(blocks, "\n").alias("context"), F.count(F.lit(1)).alias("n_blocks"))


def resolve_citations(answers: DataFrame, candidates: DataFrame, request: str, most: int = 20, pattern: str = r"\[(\d+)\]", answer: str = "answer") -> DataFrame:
    """``request, idx`` and the candidate's columns of every marker whose rank is in the list."""
    marks = answers.select(request, F.explode(T.markers(F.col(answer), pattern, most)).alias("idx"))
    return marks.join(candidates.withColumnRenamed("rank", "idx"), [request, "idx"])
