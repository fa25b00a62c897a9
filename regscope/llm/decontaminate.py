"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window as long as an item is compared with that item; where a text has fewer words than the item, the whole text is its
one window. Every window that can reach the similarity shares a shingle with the item, so windows are taken around the
positions of item shingles; that leaves none out. An item of fewer than five words is one shingle of all its words, and its
windows are all runs of as many words. A window's 64-bit SimHash (Charikar 2002) is looked up by four 16-bit blocks. By the
pigeonhole principle an item within the radius differs in at most ``radius // 4`` bits of one block (Norouzi, Punjani and
Fleet, CVPR 2012); half of those bits are changed in the index of the items, the other half in the question, which keeps
the index small. Whatever it gives is verified by the exact weighted Jaccard similarity of shingle counts.

Documents stream through the tasks without a shuffle. The items are the query set; they go to the tasks in blocks of at
most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes, each block against all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import SHINGLE_WORDS, hash_strings, share, shared, shingle_hashes, slices, word_lists

SIMILARITY = 0.8
RADIUS = 19
BLOCK_ITEMS = 16_000
BLOCK_BYTES = 16 << 20
PARTS = 4
BLOOM_BITS = 22
ASKED = 4000
WINDOWS = 20_000  # whose fingerprints are taken at once
CHECKED = 1 << 20  # shingles of candidates that are verified at once


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs, +1 or -1, for each shingle."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int16) * 2 - 1


def prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def changes(bits: int) -> np.ndarray:
    """All 16-bit values with at most ``bits`` bits set."""
    return np.array([0] + [sum(1 << k for k in c) for n in range(1, bits + 1) for c in combinations(range(16), n)], np.uint64)


def runs_of(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words (fewer than a shingle's), as those of texts of ``n`` words, and each text's bounds."""
    count = np.maximum(0, np.diff(bounds) - n + 1)
    upto = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(bounds[:-1] - upto[:-1], count) + np.arange(upto[-1])
    one = np.concatenate([words[start[:, None] + np.arange(n)].reshape(-1), np.zeros(0, np.uint64)])
    return shingle_hashes(one, np.arange(len(start) + 1) * n)[0], upto


class Items:
    """Items of one block with their fingerprints and index."""

    def __init__(self, ids: list, texts: list[str], radius: int) -> None:
        words, bounds = word_lists(pa.array(texts, pa.string()))
        shingles, upto = shingle_hashes(hash_strings(words), bounds)
        full = np.diff(upto) > 0  # an item without words has no window
        self.ids = [i for i, ok in zip(ids, full, strict=True) if ok]
        self.radius = radius
        self.words = np.diff(bounds)[full]
        each = [shingles[a:b] for a, b in zip(upto, upto[1:], strict=False) if b > a]
        self.sizes = np.array([len(s) for s in each], np.int64)
        self.prints = np.array([prints(bit_signs(s).sum(axis=0, keepdims=True))[0] for s in each], np.uint64)
        # how often each item holds each shingle, as one sorted list of (item, shingle)
        self.keys, back = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(each)), self.sizes)
        self.held, self.times = np.unique(owner * max(1, len(self.keys)) + back, return_counts=True)
        # the sizes of the items of each shingle, equal ones once; short items have windows of their own
        long = np.repeat(self.words >= SHINGLE_WORDS, self.sizes)
        pairs = np.unique(np.stack((np.repeat(self.sizes, self.sizes)[long], back[long]), axis=1), axis=0) if long.any() else np.zeros((0, 2), np.int64)
        cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        self.by_size = [(int(part[0, 0]), part[:, 1]) for part in np.split(pairs, cuts)] if len(pairs) else []
        self.maybe = np.zeros(1 << BLOOM_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] = True
        self.short = {n: np.unique([each[i][0] for i in np.flatnonzero(self.words == n)]) for n in range(1, SHINGLE_WORDS) if (self.words == n).any()}
        # multi-index: the items of each value of each 16-bit block, by half of the bits that may differ
        bits = radius // PARTS
        near, self.asked = changes(bits // 2), changes(bits - bits // 2)
        self.index = []
        for part in range(PARTS):
            value = ((self.prints >> np.uint64(16 * part)) & np.uint64(0xFFFF))[:, None] ^ near[None, :]
            item = np.repeat(np.arange(len(each)), len(near))
            order = np.argsort(value.reshape(-1), kind="stable")
            at = np.searchsorted(value.reshape(-1)[order], np.arange((1 << 16) + 1, dtype=np.uint64))
            self.index.append((at.astype(np.int32), item[order].astype(np.int32)))

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (fingerprint, item, distance) within the radius."""
        both = [np.zeros(0, np.int64)]
        for a in range(0, len(marks), ASKED):
            own = marks[a : a + ASKED]
            for part, (at, item) in enumerate(self.index):
                value = (((own >> np.uint64(16 * part)) & np.uint64(0xFFFF))[:, None] ^ self.asked[None, :]).astype(np.int64)
                n = (at[value + 1] - at[value]).reshape(-1)
                on = np.flatnonzero(n)
                n, first = n[on], at[value.reshape(-1)[on]]
                row = np.repeat(on // len(self.asked), n)
                found = item[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                close = np.bitwise_count(own[row] ^ self.prints[found]) <= self.radius
                both.append(np.unique((row[close] + a) * len(self.prints) + found[close]))
        both = np.unique(np.concatenate(both))
        row, item = both // max(1, len(self.prints)), both % max(1, len(self.prints))
        return row, item, np.bitwise_count(marks[row] ^ self.prints[item]).astype(np.int64)


def windows(items: Items, shingles: np.ndarray, upto: np.ndarray, n_words: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first shingle and size of every window that is as long as an item with which it shares a shingle.

    A document with fewer words than such an item is one window, unless it is too short to reach the similarity.
    """
    maybe = np.flatnonzero(items.maybe[(shingles >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.keys, shingles[maybe]), max(0, len(items.keys) - 1))
    hit = items.keys[at] == shingles[maybe] if len(items.keys) else np.zeros(0, bool)
    place, key = maybe[hit], at[hit]
    doc = np.searchsorted(upto, place, side="right") - 1
    many = np.diff(upto)
    found = [np.zeros((0, 3), np.int64)]
    for size, keys in items.by_size:
        on = np.isin(key, keys)
        p, d = place[on], doc[on]
        short = n_words[d] < size + SHINGLE_WORDS - 1
        whole = np.unique(d[short & (many[d] >= similarity * size * (1 - 1e-9))])
        found.append(np.stack((whole, upto[whole], many[whole]), axis=1))
        # the hit may be the window's first to last shingle; windows end with the document, those of several hits count once
        p, d = p[~short], d[~short]
        low, high = np.maximum(p - size + 1, upto[d]), np.minimum(p, upto[d + 1] - size)
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        n = np.maximum(high - low + 1, 0)
        start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        found.append(np.stack((np.repeat(d, n), start, np.full(len(start), size)), axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


def similarities(items: Items, shingles: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each window and item: the sum of minima of counts by that of maxima."""
    out = np.zeros(len(start))
    many = max(1, len(items.keys))
    upto = np.cumsum(size)
    cuts = [0, *np.flatnonzero(np.diff(upto // CHECKED)) + 1, len(start)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = size[a:b]
        if not len(n):
            continue
        pair = np.repeat(np.arange(len(n)), n)
        own = shingles[np.repeat(start[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = np.minimum(np.searchsorted(items.keys, own), many - 1)
        known = items.keys[key] == own
        both, count = np.unique(pair[known] * many + key[known], return_counts=True)
        pair = both // many
        asked = item[a:b][pair] * many + both % many
        at = np.minimum(np.searchsorted(items.held, asked), len(items.held) - 1)
        same = np.bincount(pair, np.where(items.held[at] == asked, np.minimum(items.times[at], count), 0), len(n))
        out[a:b] = same / (n + items.sizes[item[a:b]] - same)
    return out


def find(items: Items, text: pa.Array, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, first word, words, distance, similarity) of the best window of every text and item that has one."""
    words, bounds = word_lists(text)
    shingles, upto = shingle_hashes(hash_strings(words), bounds)
    if not len(shingles) or not items.ids:
        return []
    n_words = np.diff(bounds)
    doc, start, size = windows(items, shingles, upto, n_words, similarity)
    rows = [np.zeros((0, 5))]  # text, item, first shingle, distance, similarity
    hashes = hash_strings(words) if items.short else None
    for n, keys in items.short.items():
        runs, at = runs_of(hashes, bounds, n)
        place = np.flatnonzero(np.isin(runs, keys))
        own = np.searchsorted(at, place, side="right") - 1
        row, item, distance = items.near(runs[place])  # the fingerprint of one shingle is the shingle
        same = items.words[item] == n
        row, item, distance = row[same], item[same], distance[same]
        near = similarities(items, runs, place[row], np.ones(len(row), np.int64), item)
        rows.append(np.stack((own[row], item, place[row] - at[own[row]], distance, near), axis=1)[near >= similarity])
    for a in range(0, len(doc), WINDOWS):
        d, s, n = doc[a : a + WINDOWS], start[a : a + WINDOWS], size[a : a + WINDOWS]
        # sums of signs of all windows from the sums up to each place that a window covers
        first, last = s.min(), (s + n).max()
        edge = np.bincount(s - first, minlength=last - first + 1) - np.bincount(s + n - first, minlength=last - first + 1)
        covered = np.cumsum(edge)[:-1] > 0
        at = np.concatenate(([0], np.cumsum(covered)))
        sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bit_signs(shingles[first:last][covered]), axis=0, dtype=np.int32)))
        row, item, distance = items.near(prints(sums[at[s + n - first]] - sums[at[s - first]]))
        same = (items.sizes[item] == n[row]) | (n_words[d[row]] < items.words[item]) & (n[row] == np.diff(upto)[d[row]])
        row, item, distance = row[same], item[same], distance[same]
        near = similarities(items, shingles, s[row], n[row], item)
        rows.append(np.stack((d[row], item, s[row] - upto[d[row]], distance, near), axis=1)[near >= similarity])
        if sum(map(len, rows)) > WINDOWS:
            rows = [best_windows(np.concatenate(rows))]
    found = best_windows(np.concatenate(rows))
    t, i, first, distance = (found[:, k].astype(np.int64) for k in range(4))
    return list(zip(t.tolist(), i.tolist(), first.tolist(), np.minimum(items.words[i], n_words[t]).tolist(), distance.tolist(), found[:, 4].tolist(), strict=True))


def best_windows(rows: np.ndarray) -> np.ndarray:
    """Of the rows (text, item, first shingle, distance, similarity) the best of each text and item, the earliest of equals."""
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 4], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, radius: int) -> Iterator[Items]:
    """The items in blocks, none of which passes the limits of size (a longer item is a block by itself)."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // (BLOCK_ITEMS // 2)), -(-(size["b"] or 0) // (BLOCK_BYTES // 2)))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for k in range(blocks):
        ids, texts, held = [], [], 0
        for r in rows.where(block == k).toLocalIterator():
            if ids and (len(ids) >= BLOCK_ITEMS or held + len(r["text"]) * 4 > BLOCK_BYTES):
                yield Items(ids, texts, radius)
                ids, texts, held = [], [], 0
            ids.append(r["id"])
            texts.append(r["text"])
            held += len(r["text"]) * 4
        if ids:
            yield Items(ids, texts, radius)


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, distance, similarity``: the best window of each row and item that matches.

    Words are runs of letters and digits, lower-cased; shingles are five words. An item of one to four words matches where
    its words stand together in a text. A text with fewer words than an item is compared as a whole. A window matches if
    its fingerprint is within ``radius`` bits and the weighted Jaccard similarity of shingle counts is ``similarity`` or
    more; ties go to the earliest window. Texts of any length are read whole. Null, empty and wordless texts
    and items match nothing. Rows that repeat an identifier are searched as rows of their own, equal items each match.
    Identifiers may be null. Other columns are ignored. Without documents or items there are no rows. At similarity 0.8
    a fingerprint passes the radius with a chance of about 0.0003, at 0.9 below 10^-8.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_kind = source.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, first_word long, n_words long, distance int, similarity double"

    def against(items: Items) -> Callable:
        held = share(docs, items)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared(held)
            for batch in slices(batches, "text"):
                found = find(items, batch.column("text"), similarity)
                doc, item, first, n_words, distance, near = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc, pa.int64())),
                        pa.array([items.ids[i] for i in item], {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind)),
                        pa.array(first, pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array(distance, pa.int32()),
                        pa.array(near, pa.float64()),
                    ],
                    ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                )

        return work

    out = None
    for items in item_blocks(benchmark, item_col, item_text, radius):
        part = source.mapInArrow(against(items), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which no window matches an item, with all their columns; see :func:`contaminations`."""
    for items in item_blocks(benchmark, item_col, item_text, radius):
        held = share(docs, items)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = shared(held)
            for batch in slices(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in find(items, batch.column(text_col), similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
