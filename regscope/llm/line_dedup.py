"""Line dedup over sharded cuckoo filters, backed by exact reference-count tables.

State is three tables: ``postings`` (which document holds which key), ``refs`` (for each key its first and last document
and how many postings it has) and ``filters`` (per shard of the keys, a cuckoo filter of the keys that repeat). A line is
first asked for in its shard's filter; only lines that may repeat meet the exact table, which alone decides. Documents
can be added and taken away: counts and filters follow, so a line that was dropped comes back when it is single again.
A change appends to these tables what it touches, and all is rewritten only once the changes weigh half as much as the base.

A key is named by the SHA-256 of its bytes. Keys are counted before the shuffle, so a line that is everywhere is one row
from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import slices, stored
from regscope.llm.cuckoo import CuckooFilter

MIN_CHARS = 10
SHARD_KEYS = 20_000
FILTER_LIMIT = 32 << 20
ASKED_ROWS = 400_000
NO_ID = (1 << 63) - 1


@dataclass
class LineState:
    """The tables as first written (turn 0) and what each change appended: a key's and a shard's latest row holds, a posting
    holds unless its document went at a later turn."""

    posted: DataFrame  # key, doc_id, turn
    counted: DataFrame  # key, first_doc, last_doc, n_docs (0: nobody holds the key), turn
    built: DataFrame  # shard, bits, turn
    shards: int
    repeating: int
    gone: DataFrame | None = None  # doc_id, turn
    turn: int = 0

    @property
    def postings(self) -> DataFrame:
        """``key, doc_id``"""
        if self.gone is None:
            return self.posted.select("key", "doc_id")
        until = self.gone.groupBy("doc_id").agg(F.max("turn").alias("until"))
        return self.posted.join(until, "doc_id", "left").where("until IS NULL OR turn > until").select("key", "doc_id")

    @property
    def refs(self) -> DataFrame:
        """``key, first_doc, last_doc, n_docs, shard``"""
        rows = self.counted
        if self.turn:
            latest = F.max_by(F.struct("first_doc", "last_doc", "n_docs"), "turn").alias("now")
            rows = rows.groupBy("key").agg(latest).select("key", "now.*").where("n_docs > 0")
        return rows.select("key", "first_doc", "last_doc", "n_docs", shard_of(self.shards).alias("shard"))

    @property
    def filters(self) -> DataFrame:
        """``shard, bits``"""
        if not self.turn:
            return self.built.select("shard", "bits")
        return self.built.groupBy("shard").agg(F.max_by("bits", "turn").alias("bits"))


def line_keys(text: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, list[bytes | None]]:
    """Lines of all texts one after another, each text's bounds, and the key's digest of each line (None: too short)."""
    lists = pc.split_pattern(pc.fill_null(text, ""), "\n")
    lines, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(lines))
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_pylist()
    keys = pc.cast(keys, pa.binary()).to_pylist()
    return lines, bounds - bounds[0], [hashlib.sha256(k).digest() if ok else None for k, ok in zip(keys, long, strict=True)]


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def number(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct ``key, doc_id`` of the lines of each row. A null identifier stands for one document after all others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, bounds, keys = line_keys(batch.column("text"), min_chars)
            out_keys, out_docs = [], []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                own = set(keys[a:b])
                own.discard(None)
                out_keys += own
                out_docs += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_docs, pa.int64())], ["key", "doc_id"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "key binary, doc_id long")


def count_references(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"))


def build_filters(refs: DataFrame) -> DataFrame:
    """One filter per shard, of the keys that at least two documents hold."""

    def build(group: pa.Table) -> pa.Table:
        bits = CuckooFilter.of(number(group.column("key").to_pylist())).to_bytes()
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    return refs.where("first_doc < last_doc").select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, bits binary")


def _based(rows: DataFrame, refs: DataFrame) -> LineState:
    """State of stored postings and counts. Shards grow in number with the repeating keys, so that each stays small."""
    repeating = refs.where("first_doc < last_doc").count()
    shards = max(16, -(-repeating // SHARD_KEYS))
    filters = stored(build_filters(refs.withColumn("shard", shard_of(shards))))
    rows, refs, filters = (x.withColumn("turn", F.lit(0)) for x in (rows, refs, filters))
    return LineState(rows, refs, filters, shards, repeating)


def build_state(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineState:
    """State of ``docs``."""
    rows = stored(postings(docs, id_col, text_col, min_chars))
    return _based(rows, stored(count_references(rows)))


def insert_documents(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineState:
    """State with ``docs`` added: their postings are appended, their keys' counts and shards' filters written anew.

    Rows of an identifier that is there already belong to the same document: only keys that it lacks are added, so that
    inserting a document twice changes nothing.
    """
    rows = stored(postings(docs, id_col, text_col, min_chars).distinct())
    held = state.postings.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = stored(rows.join(held, ["key", "doc_id"], "left_anti"))
    counts = count_references(rows)
    before = state.refs.join(counts.select("key"), "key", "left_semi").select(*counts.columns)
    after = before.unionByName(counts).groupBy("key").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("n_docs").alias("n_docs"))
    return _changed(state, after, rows, None)


def delete_documents(state: LineState, gone: DataFrame, id_col: str = "doc_id") -> LineState:
    """State without the documents named in ``gone`` (others are ignored): their keys are counted anew, and keys that no
    longer repeat leave the filters. A document may come back later."""
    ids = gone.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
    ids = stored(state.postings.select("doc_id").distinct().join(ids, "doc_id", "left_semi"))
    touched = stored(state.postings.join(ids, "doc_id", "left_semi").select("key").distinct())
    left = state.postings.join(ids, "doc_id", "left_anti").join(touched, "key", "left_semi")
    after = touched.join(count_references(left), "key", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long")))
    return _changed(state, after, None, ids)


def compacted(state: LineState) -> LineState:
    """The same state in one piece, with as many shards as its keys need."""
    return _based(stored(state.postings), stored(state.refs.drop("shard")))


def _changed(state: LineState, after: DataFrame, rows: DataFrame | None, ids: DataFrame | None) -> LineState:
    """State with the counts ``after`` of touched keys, new postings or gone documents; only shards with a key that has begun
    or ceased to repeat are written. Once changes are half as many rows as the base's postings or shards are twice too full, all is written in one piece.
    """
    turn = F.lit(state.turn + 1).alias("turn")
    after = stored(after.select("key", "first_doc", "last_doc", "n_docs"))
    was = state.refs.where("first_doc < last_doc").select("key", F.lit(True).alias("was"))
    now = F.coalesce(F.col("first_doc") < F.col("last_doc"), F.lit(False))
    change = after.join(was, "key", "left").select("key", now.alias("add"), F.coalesce("was", F.lit(False)).alias("was"))
    change = stored(change.where("add <> was").select(shard_of(state.shards).alias("shard"), "key", "add"))
    repeating = state.repeating + (change.agg(F.sum(F.when(F.col("add"), 1).otherwise(-1))).first()[0] or 0)
    append = lambda had, new: had if new is None else new.select("*", turn) if had is None else had.unionByName(new.select("*", turn))
    grown = LineState(append(state.posted, rows), append(state.counted, after), state.built, state.shards, repeating, append(state.gone, ids), state.turn + 1)
    base = state.posted.where("turn = 0").count()
    added = grown.posted.where("turn > 0").count() + grown.counted.where("turn > 0").count()
    if 2 * added > base or repeating > 2 * SHARD_KEYS * state.shards:
        return compacted(grown)

    def update(had: pa.Table, changed: pa.Table) -> pa.Table:
        shard = changed.column("shard")[0].as_py()
        add = changed.column("add").to_numpy()
        keys = number(changed.column("key").to_pylist())
        made = CuckooFilter.from_bytes(had.column("bits")[0].as_py()) if had.num_rows else CuckooFilter(len(keys))
        made.remove(keys[~add])
        bits = made.to_bytes() if made.add(keys[add]) else None  # None: too full, to be built anew
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([bits], pa.binary())})

    had = state.filters.join(change.select("shard").distinct(), "shard", "left_semi")
    made = stored(had.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(update, "shard int, bits binary"))
    full = made.where("bits IS NULL").select("shard")
    again = stored(build_filters(grown.refs.join(full, "shard", "left_semi")))
    grown.built = append(state.built, made.where("bits IS NOT NULL").unionByName(again))
    return grown


def maybe_repeated(state: LineState, limit: int = FILTER_LIMIT, rows: int = ASKED_ROWS) -> DataFrame:
    """Postings that pass their shard's filter. Filters of up to ``limit`` bytes in all go to the postings by broadcast;
    beyond that postings go to their shard's filter, at most about ``rows`` of a shard to one copy of it."""
    asked = state.postings.select("key", "doc_id").withColumn("shard", shard_of(state.shards))
    size = state.filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if size > limit:
        return _asked_by_shard(state, asked, rows)
    sc = state.postings.sparkSession.sparkContext
    held = sc.broadcast({r["shard"]: bytes(r["bits"]) for r in state.filters.collect()})  # bounded by limit

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.from_bytes(v) for k, v in held.value.items()}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            keys = number(batch.column("key").to_pylist())
            order = np.argsort(shard, kind="stable")
            keep = np.zeros(len(shard), bool)
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and (found := filters.get(int(shard[part[0]]))):
                    keep[part] = found.contains(keys[part])
            yield batch.filter(pa.array(keep)).select(["key", "doc_id"])

    return asked.mapInArrow(probe, "key binary, doc_id long")


def _asked_by_shard(state: LineState, asked: DataFrame, rows: int) -> DataFrame:
    copies = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("copies"))
    copies = stored(copies)
    dealt = asked.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id"), "copies").cast("int"))
    filters = state.filters.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def probe(one: pa.Table, two: pa.Table) -> pa.Table:
        one = one.select(["key", "doc_id"])
        if not one.num_rows or not two.num_rows:
            return one.slice(0, 0)
        found = CuckooFilter.from_bytes(two.column("bits")[0].as_py()).contains(number(one.column("key").to_pylist()))
        return one.filter(pa.array(found))

    sides = (dealt.select("shard", "copy", "key", "doc_id"), filters.select("shard", "copy", "bits"))
    one, two = (x.groupBy("shard", "copy") for x in sides)
    return one.cogroup(two).applyInArrow(probe, "key binary, doc_id long")


def dedup_lines(docs: DataFrame, state: LineState | None = None, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_lines, n_dropped``, with repeated lines gone from ``text``.

    A key is the line without ASCII white space at its ends, A-Z lower-cased; keys of ``min_chars`` code points or more
    that at least two documents of ``state`` (default: of ``docs``) hold lose all their lines except in the smallest
    identifier that holds them. A document's own repeats stay. A null or empty text is one empty line. Rows that repeat an
    identifier are one document; a null identifier counts as the largest. Identifiers are whole numbers. Texts may be of
    any length. Other columns are ignored. Empty input gives no rows.
    """
    state = state or build_state(docs, id_col, text_col, min_chars)
    refs = state.refs.where("first_doc < last_doc").select("key", "first_doc")
    lost = maybe_repeated(state).join(refs, "key").where("first_doc < doc_id")
    lost = lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost")).withColumnRenamed("doc_id", "at")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(lost, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("at"), "left").drop("at")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, bounds, keys = line_keys(batch.column("text"), min_chars)
            sets = [frozenset(x) if x else frozenset() for x in batch.column("lost").to_pylist()]
            keep = np.ones(len(keys), bool)
            for i, own in enumerate(sets):
                if own:
                    a, b = bounds[i], bounds[i + 1]
                    keep[a:b] = [k not in own for k in keys[a:b]]
            upto = np.concatenate(([0], np.cumsum(keep)))[bounds]
            kept = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lines.filter(pa.array(keep)))
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_join(kept, "\n"), pa.array(n, pa.int64()), pa.array(n - np.diff(upto), pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(drop, f"doc_id {kind}, text string, n_lines long, n_dropped long")
