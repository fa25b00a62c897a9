"""Target-distribution importance resampling on hashed word features (Xie et al., "Data Selection for Language Models via
Importance Resampling", NeurIPS 2023).

Features are runs of consecutive words; a feature's bucket is the CRC-32 of its bytes. Each slice of texts finds its
distinct features, puts features of equal length into one matrix of bytes and runs all their checksums forward column by
column; the buckets are then scattered back to the places where the features stand. Texts stream through the tasks twice:
once for the counts of buckets, which a task sums before it sends them, and once for the scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import share, shared, shuffle_width, slices, stored

BUCKETS = 10_000
LONGEST = 2  # words of a feature
PERCENT, LEAST_WORDS = 25, 20
SEED = "7:"
POLYNOMIAL = 0xEDB88320


def crc_table() -> np.ndarray:
    """The effect of each byte on a reflected CRC-32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


CRC = crc_table()


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte runs of ``data`` at ``start``: one matrix for each length."""
    out = np.zeros(len(start), np.uint32)
    if not len(start):
        return out
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, own in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        table = np.lib.stride_tricks.sliding_window_view(data, size)[start[own]] if size else np.zeros((len(own), 0), np.uint8)
        state = np.full(len(own), 0xFFFFFFFF, np.uint32)
        for column in range(size):
            state = CRC[(state ^ table[:, column]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        out[own] = ~state
    return out


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lowered, start and end of every word, and each text's bounds among the words.

    Words are runs of digits, a-z and everything beyond ASCII.
    """
    text = pc.fill_null(text, "").cast(pa.binary())
    # a separator of one byte after each text keeps words of different texts apart
    joined = pc.binary_join_element_wise(text, pa.scalar(b" "), pa.scalar(b""))
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, start, end, np.searchsorted(start, offsets - offsets[0])


def feature_buckets(text: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of all texts, the text of each, and the number of words of each text."""
    data, start, end, bounds = words_of(text)
    n = np.diff(bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    # equal words get one number, their bytes go into one run of distinct words
    ends = np.concatenate(([0], np.cumsum(end - start)))
    at = np.repeat(start - ends[:-1], end - start) + np.arange(ends[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).dictionary_encode()
    number, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
    offset = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    book = np.frombuffer(distinct.buffers()[2], np.uint8)
    size = np.diff(offset)
    doc = np.repeat(np.arange(len(n)), n)
    found = [(checksums(book, offset[:-1], size) % np.uint32(buckets)).astype(np.int64)[number]]
    owner = [doc]
    run, first = number, np.arange(len(distinct))[:, None]  # the words of each distinct run so far
    for width in range(2, longest + 1):
        within = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
        both = run[within] * len(distinct) + number[within + width - 1]
        pair, back = np.unique(both, return_inverse=True)
        parts = np.concatenate((first[pair // len(distinct)], (pair % len(distinct))[:, None]), axis=1)
        total = size[parts].sum(axis=1) + width - 1
        upto = np.concatenate(([0], np.cumsum(total)))
        joined = np.full(upto[-1], 32, np.uint8)
        place = upto[:-1].copy()
        for k in range(width):
            many = size[parts[:, k]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            joined[np.repeat(place, many) + step] = book[np.repeat(offset[parts[:, k]], many) + step]
            place += many + 1
        found.append((checksums(joined, upto[:-1], total) % np.uint32(buckets)).astype(np.int64)[back])
        owner.append(doc[within])
        run, first = np.full(len(number), -1), parts
        run[within] = back
    return np.concatenate(found), np.concatenate(owner), n


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends a row per bucket at most, the driver gets ``buckets``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            count += np.bincount(feature_buckets(batch.column("text"), buckets, longest)[0], minlength=buckets)
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(count[on])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    parts = rows.select(F.col(text_col).alias("text")).mapInArrow(work, "bucket int, n long")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets, in doubles."""
    s, t = have.astype(np.float64), want.astype(np.float64)
    size = float(len(have))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, seed: str) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, tie`` of each row."""
    source = rows.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    held = share(rows, gain)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_features", "n_words", "weight", "score", "tie"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared(held)
        for batch in slices(batches, "text"):
            bucket, doc, words = feature_buckets(batch.column("text"), len(gain), longest)
            n = np.bincount(doc, minlength=len(words))
            order = np.argsort(doc, kind="stable")
            total = np.zeros(len(words), np.int64)
            if len(order):
                total[n > 0] = np.add.reduceat(gain[bucket[order]], (np.cumsum(n) - n)[n > 0])
            weight = total // np.maximum(n, 1)
            drawn = [int(hashlib.sha256(f"{seed}{i}".encode()).hexdigest()[:8], 16) for i in pc.fill_null(batch.column("name"), "").to_pylist()]
            lot = np.floor(-1000 * np.log(-np.log((np.array(drawn, np.float64) + 0.5) / 4294967296.0))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (n, words, weight, weight + lot)), batch.column("tie")], names)

    return source.mapInArrow(work, f"doc_id {kind}, n_features long, n_words long, weight long, score long, tie long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank``.

    Words are runs of digits, letters a-z (A-Z lowered) and signs beyond ASCII of the whole text; features are all runs of
    1 to ``longest`` words, each as often as it stands. ``weight`` is the floored mean gain of a text's features (none: 0),
    ``score`` adds a Gumbel draw of the identifier, so that the highest scores are a sample without replacement in
    proportion to exp(weight / 1000). Of the texts of ``least_words`` words or more the ``percent`` highest scores (rounded
    down) are drawn and ranked from 1; ties go to smaller identifiers (null last), then to the texts' hashes. A null text
    has no words, a null identifier draws as an empty one. Rows that repeat an identifier are rows of their own. Other
    columns are ignored. Empty input gives no rows, an empty target leaves only what the texts say.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    rows = stored(weighed(docs, gain, id_col, text_col, longest, seed))
    enough = F.col("n_words") >= least_words
    draws = rows.where(enough).count() * percent // 100
    # ranks without a task that sorts all rows: ranges of the order, sorted each, and the ranges' sizes
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = rows.where(enough).repartitionByRange(shuffle_width(rows), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    base = rows.sparkSession.createDataFrame(list(before.items()), "part int, base long")
    ranked = dealt.withColumn("part", part.cast("int")).join(F.broadcast(base), "part").withColumn("rank", F.col("base") + within + 1)
    rank = F.when(F.col("rank") <= draws, F.col("rank")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(rows.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
