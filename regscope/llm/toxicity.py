"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings. It is fitted on a bounded sample of labelled rows: Spark counts each
feature's toxic and other documents, the features that tell most become the model's, and only those of the sampled rows
reach the driver, as packed sparse rows. Each sampled text gives one counterfactual pair: a text that names a group against
the same text with its identity terms swapped for others of the same list, any other text with a term put into it against
the same text with the list's next term there (a sum over words has no word order, so the place does not matter). The fit
penalises the squared change of the score's logit between the two, so that a neutral mention of one group does not score
above that of another (Garg et al., "Counterfactual fairness in text classification through robustness", AIES 2019).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import hash_strings, mix, share, shared, slices, word_lists

SAMPLE_ROWS = 6000
FEATURES = 1500  # at most, and at most half the sampled rows: more overfit
PREFIXES = (4, 5, 6, 7, 8)
RATE = 0.005
THRESHOLD = 0.7
SLICE = 2 << 20

#: Identity terms by list; a term is swapped for the next of its list.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


@dataclass
class Rows:
    """Sparse rows: each row's columns and values, one row after another."""

    upto: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @classmethod
    def unpacked(cls, cells: list[tuple[bytes, bytes]]) -> Rows:
        column, value = (np.frombuffer(b"".join(c[k] for c in cells), kind) for k, kind in ((0, np.uint16), (1, np.float32)))
        return cls(np.cumsum([0] + [len(c[0]) // 2 for c in cells]), column.astype(np.int32), value)

    def times(self, w: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.upto) - 1), np.diff(self.upto))
        return np.bincount(row, weights=w[self.column] * self.value, minlength=len(self.upto) - 1)

    def back(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, weights=np.repeat(v, np.diff(self.upto)) * self.value, minlength=size)

    def gram(self, weight: np.ndarray, size: int, block: int = 256) -> np.ndarray:
        """Sum of weight * row * row', from a few dense rows at a time; the last column is a constant 1."""
        total = np.zeros((size, size), np.float32)
        dense = np.zeros((block, size), np.float32)
        for a in range(0, len(self.upto) - 1, block):
            b = min(a + block, len(self.upto) - 1)
            own = slice(self.upto[a], self.upto[b])
            dense[:] = 0
            dense[np.repeat(np.arange(b - a), np.diff(self.upto[a : b + 1])), self.column[own]] = self.value[own]
            dense[: b - a, -1] = 1
            dense[: b - a] *= np.sqrt(weight[a:b, None])
            total += dense.T @ dense
        return total


def swaps(lists: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {w: own[(k + 1) % len(own)] for own in lists for k, w in enumerate(own)}


def identity_features(lists: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """The features of all identity terms. They are always among the model's, so that a swap cannot go unseen."""
    terms = sorted({w for own in lists for w in own})
    found = np.unique(word_features(pa.array(terms, pa.string()))) if terms else np.zeros(0, np.uint64)
    return found[found != 0]


def pairs(text: pa.Array, lists: tuple[tuple[str, ...], ...]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Two versions of each text that differ in identity terms, and which texts name a group by themselves."""
    swap = swaps(lists)
    words, bounds = word_lists(text)
    term = pc.is_in(words, value_set=pa.array(list(swap), pa.string())).to_numpy(zero_copy_only=False)
    named = np.zeros(len(text), bool)
    named[np.repeat(np.arange(len(text)), np.diff(bounds))[term]] = True
    one, two = [], []
    every = list(swap)
    for t, own in zip(text.to_pylist(), named.tolist(), strict=True):
        if own:
            one.append(t)
            two.append(t)
        else:
            w = every[zlib.crc32((t or "").encode()) % len(every)]
            one.append(f"{w} {t or ''}")
            two.append(f"{swap[w]} {t or ''}")
    return pa.array(one, pa.string()), pa.array(two, pa.string()), named


def word_features(words: pa.Array) -> np.ndarray:
    """Hashes of the features of each word: the word and its beginnings (0: the word is too short)."""
    length = pc.utf8_length(words).to_numpy()
    out = [hash_strings(words)]
    for k in PREFIXES:
        out.append(np.where(length > k, mix(hash_strings(pc.utf8_slice_codeunits(words, 0, k)) + np.uint64(k)), np.uint64(0)))
    return np.stack(out, axis=1)


def document_features(text: pa.Array, known: np.ndarray | None = None, swap: dict[str, str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of each text's distinct features.

    A value rises with the feature's share of the text's words and stays below 1. With ``known`` (sorted) only those
    features count and are given by number. With ``swap`` the texts' identity terms are swapped first.
    """
    words, bounds = word_lists(text)
    n = np.diff(bounds)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64) if known is None else none, np.zeros(0)
    coded = words.dictionary_encode()
    unique, code = coded.dictionary, coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(n)), n)
    if swap is not None:
        unique = pa.array([swap.get(w, w) for w in unique.to_pylist()], pa.string())
    table = word_features(unique)
    if known is not None:
        at = np.minimum(np.searchsorted(known, table), max(0, len(known) - 1))
        hit = (known[at] == table) if len(known) else np.zeros(table.shape, bool)
        some = hit.any(axis=1)[code]
        doc, code = doc[some], code[some]
        on, number = hit[code], at[code]
    else:
        on, number = (table != 0)[code], table[code]
    doc = np.repeat(doc, on.sum(axis=1))
    feature = number[on]
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    first = np.flatnonzero(new)
    rate = np.diff(np.concatenate((first, [len(doc)]))) / n[doc[first]]
    return doc[first], feature[first], rate / (rate + RATE)


def change(one: tuple, two: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value of ``two`` less that of ``one``) where they differ."""
    key = np.concatenate((two[0] * size + two[1], one[0] * size + one[1]))
    at, back = np.unique(key, return_inverse=True)
    value = np.bincount(back, weights=np.concatenate((two[2], -one[2])), minlength=len(at))
    on = np.abs(value) > 1e-12
    return at[on] // size, at[on] % size, value[on]


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, features: int = FEATURES, fairness: float = 10.0, ridge: float = 0.01, identity: tuple = IDENTITY) -> Model:
    """Fit on at most ``rows`` labelled rows, those with the least hash of their identifier; labels 1 and 0.

    ``usable`` is a condition on ``labels``. Null labels and identifiers are no labels; of labels that repeat an identifier
    the largest counts; rows that repeat a labelled identifier each teach. Ties in a feature's gain go to the lesser hash.
    Without labels, without texts, or with labels of one kind only, the model scores everything alike. Long texts are
    read whole. Identifiers may be of any type that both tables share.
    """
    spark = docs.sparkSession
    usable = F.lit(True) if usable is None else usable
    chosen = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    kind = chosen.schema["id"].dataType.simpleString()
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows).collect()  # bounded by rows
    picked = spark.createDataFrame([(r["id"], r["y"]) for r in chosen], f"id {kind}, y int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            doc, feature, _ = document_features(batch.column("text"))
            key, back = np.unique(feature, return_inverse=True)
            y = batch.column("y").to_numpy()[doc]
            toxic = np.bincount(back, weights=y, minlength=len(key)).astype(np.int64)
            total = np.bincount(back, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(toxic), pa.array(total)], ["feature", "toxic", "total"])

    n = len(chosen)
    p = sum(r["y"] for r in chosen)
    counts = texts.mapInArrow(count, "feature long, toxic long, total long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("total").alias("t"))
    # log-likelihood ratio of feature and label
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, t = F.col("a"), F.col("t")
    share = (p + 0.5) / (n + 1)
    gain = term(a, t * share) + term(t - a, t * (1 - share)) + term(p - a, (n - t) * share) + term((n - t) - (p - a), (n - t) * (1 - share))
    most = min(features, n // 2)
    best = counts.where("t >= 3").withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(most).collect()  # bounded by features
    named = identity_features(identity)
    known = np.union1d(np.array([r["feature"] for r in best], np.int64).view(np.uint64), named)
    if len(known) >= 1 << 16:
        raise ValueError("features: at most 65,535 with the identity terms' own")
    swap = swaps(identity)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            text, size = batch.column("text"), len(known)
            found = [document_features(text, known)]
            if swap:
                one, two, own = pairs(text, identity)
                second = document_features(two, known)
                if own.any():
                    swapped = document_features(two, known, swap)
                    second = tuple(np.concatenate((x[~own[second[0]]], y[own[swapped[0]]])) for x, y in zip(second, swapped, strict=True))
                found.append(change(document_features(one, known), second, size))
            else:
                found.append(tuple(x[:0] for x in found[0]))
            packed = []
            for doc, column, value in found:
                upto = np.searchsorted(doc, np.arange(len(text) + 1))
                packed += [pa.array([x.astype(k)[a:b].tobytes() for a, b in zip(upto, upto[1:], strict=False)], pa.binary()) for x, k in ((column, np.uint16), (value, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *packed], ["y", "f", "v", "cf", "cv"])

    got = texts.mapInArrow(extract, "y int, f binary, v binary, cf binary, cv binary").collect()  # bounded by rows x features
    got = sorted((r["y"], *(bytes(r[k]) for k in ("f", "v", "cf", "cv"))) for r in got)  # sums in one order, however rows arrive
    x, y = Rows.unpacked([r[1:3] for r in got]), np.array([r[0] for r in got], float)
    moved = Rows.unpacked([r[3:] for r in got if r[3]])
    return fit(known, x, y, moved, fairness, ridge)


def fit(known: np.ndarray, x: Rows, y: np.ndarray, moved: Rows, fairness: float, ridge: float, steps: int = 30) -> Model:
    """Newton's method for the balanced log loss + ridge * |w|^2 / (2 sqrt(n)) + fairness * mean((w . change)^2) / 2.

    Toxic and other rows weigh the same in sum, so rare toxic rows aren't scored down. Rows stay sparse; what is dense is
    one square matrix of the features."""
    if not len(y) or y.min() == y.max():
        return Model(known, np.zeros(len(known)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    size = len(known) + 1
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    penalty = np.zeros((size, size), np.float32)
    if len(moved.upto) > 1:
        n = len(moved.upto) - 1
        penalty[:-1, :-1] = fairness * moved.gram(np.full(n, 1 / n), size)[:-1, :-1]
    np.fill_diagonal(penalty, penalty.diagonal() + np.append(np.full(len(known), ridge / np.sqrt(len(y))), 1e-9))
    w = np.zeros(size)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + w[-1], -30, 30)))
        off = balance * (p - y)
        slope = x.back(off, size) + penalty @ w
        slope[-1] += off.sum()
        step = np.linalg.solve(x.gram(balance * p * (1 - p), size) + penalty, slope)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return Model(known, w[:-1], float(w[-1]))


def scores(model: Model, text: pa.Array) -> np.ndarray:
    doc, feature, value = document_features(text, model.features)
    logit = model.bias + np.bincount(doc, weights=model.weights[feature] * value, minlength=len(text))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row: every whole text, no shuffle. Null, empty and wordless texts get the
    model's score of a text without features. Repeated rows are scored alike; other columns are ignored."""
    held = share(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(held)
        for batch in slices(batches, "text", SLICE):
            found = scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    held = share(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(held)
        for batch in slices(batches, text_col, SLICE):
            yield batch.filter(pa.array(scores(model, batch.column(text_col)) < threshold))

    return docs.mapInArrow(work, docs.schema)
