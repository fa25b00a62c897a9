"""What the operators of this subpackage share: shared tables, hashing and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regscope.operators.tables import shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE_WORDS = 5
SLICE_BYTES = 2 << 20


def stored(df: DataFrame, *partition_by: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a new shared table and read it back: lineage ends there and a lost executor loses nothing."""
    path = shared_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def share(df: DataFrame, value: object) -> Broadcast:
    """Broadcast an object of this package, class included; :func:`shared` gives it back in a task."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held: Broadcast) -> object:
    return cloudpickle.loads(held.value)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is right and fast for ASCII texts, ``translate`` for the others."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Steele, Lea and Flood's SplitMix): equal inputs give equal outputs on every machine."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column`` (or one row), to bound a task's memory. At the end
    what the task held goes back to the machine, as Python workers live on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Unused memory of this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def word_lists(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of letters and digits, lower-cased) of all texts one after another, and each text's bounds."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\pL\pN]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    words = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # an empty text gives one empty word
        kept = np.concatenate(([0], np.cumsum(full)))
        words, bounds = words.filter(pa.array(full)), kept[bounds]
    return words, bounds


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; every distinct string is hashed once."""
    if not len(values):
        return np.zeros(0, np.uint64)
    coded = values.dictionary_encode()
    unique = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return unique[coded.indices.to_numpy()]


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, and each text's bounds among them.

    A text of 1 to ``width - 1`` words has one shingle, of all its words; a text without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(count)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    start = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    short = np.repeat(n < width, count)
    left = np.repeat(n, count) if short.any() else None
    total = np.zeros(out[-1], np.uint64)
    for k in range(width):
        word = padded[start + k]
        if left is not None:
            word = np.where(short & (k >= left), np.uint64(k + 1), word)
        total = total * np.uint64(0x9FB21C651E98DF25) + word
    return mix(total), out
