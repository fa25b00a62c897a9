"""Token-ID output in patched frame-of-reference blocks.

The file format: a table of segments, each a run of whole documents in ascending identifier order. ``payload`` holds the
segment's ids in blocks of ``BLOCK``:

* header: ``PFOR``, number of ids, number of blocks (little-endian unsigned 32-bit), then where each block starts;
* block: least id (u32), bit width (u8), unused (u8), number of exceptions (u16), the low ``width`` bits of id minus
  least id in 64-bit words (value j of each 64 takes bits j*width on), positions (u16) and high parts (u32) of exceptions.

The width is that of the ``PERCENTILE`` of a block's differences; larger ones are exceptions. A segment starts with a
document, so each is read by itself; ``doc_ids`` and ``n_tokens`` say what it holds. Spark writes the table, so a lost task
is written again and leaves nothing behind.
"""

from __future__ import annotations

import itertools
import json
import re
import threading
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regscope.llm.common import give_back, shuffle_width, slices

BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
MAGIC = b"PFOR"
SLICE = 3 << 20
REST_SECONDS = 10


def bit_width(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids (below 2^32) as the bytes of a segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint64)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1) if blocks else np.zeros(0, np.uint64)
    delta = rows - least[:, None]
    bits = bit_width(delta)
    width = np.partition(bits, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))].astype(np.int64)
    odd = bits > width[:, None]
    n_odd = odd.sum(axis=1)
    size = 8 + width * (BLOCK // 8) + 6 * n_odd
    start = 12 + 4 * blocks + np.cumsum(size) - size
    out = np.zeros(12 + 4 * blocks + int(size.sum()), np.uint8)
    out[:12] = np.frombuffer(MAGIC + np.array([n, blocks], "<u4").tobytes(), np.uint8)
    out[12 : 12 + 4 * blocks] = start.astype("<u4").view(np.uint8)
    head = np.zeros((blocks, 8), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4] = width
    head[:, 6:] = n_odd.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[start[:, None] + np.arange(8)] = head
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        low = (delta[own] & np.uint64((1 << int(w)) - 1)).reshape(-1, 64).T
        packed = np.zeros((int(w), low.shape[1]), np.uint64)
        for j in range(64):
            at, shift = divmod(j * int(w), 64)
            packed[at] |= low[j] << np.uint64(shift)
            if shift + w > 64:
                packed[at + 1] |= low[j] >> np.uint64(64 - shift)
        raw = np.ascontiguousarray(packed.T).astype("<u8").view(np.uint8).reshape(len(own), -1)
        out[start[own][:, None] + 8 + np.arange(raw.shape[1])] = raw
    if n_odd.any():
        row, place = np.nonzero(odd)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
        base = (start + 8 + width * (BLOCK // 8))[row]
        out[(base + 2 * rank)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
        high = (delta[row, place] >> width[row].astype(np.uint64)).astype("<u4")
        out[(base + 2 * n_odd[row] + 4 * rank)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def decode_ids(raw: bytes) -> np.ndarray:
    """The ids of a segment."""
    data = np.frombuffer(raw, np.uint8)
    if raw[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = (int(x) for x in data[4:12].view("<u4"))
    start = data[12 : 12 + 4 * blocks].view("<u4").astype(np.int64)
    head = data[start[:, None] + np.arange(8)] if blocks else np.zeros((0, 8), np.uint8)
    least = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(-1).astype(np.uint64)
    width = head[:, 4].astype(np.int64)
    n_odd = np.ascontiguousarray(head[:, 6:]).view("<u2").reshape(-1).astype(np.int64)
    delta = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        raw_words = np.ascontiguousarray(data[start[own][:, None] + 8 + np.arange(int(w) * BLOCK // 8)])
        packed = np.ascontiguousarray(raw_words.view("<u8").reshape(-1, int(w)).T)
        low = np.zeros((64, packed.shape[1]), np.uint64)
        for j in range(64):
            at, shift = divmod(j * int(w), 64)
            low[j] = packed[at] >> np.uint64(shift)
            if shift + w > 64:
                low[j] |= packed[at + 1] << np.uint64(64 - shift)
        delta[own] = (low & np.uint64((1 << int(w)) - 1)).T.reshape(len(own), BLOCK)
    if n_odd.any():
        row = np.repeat(np.arange(blocks), n_odd)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
        base = (start + 8 + width * (BLOCK // 8))[row]
        place = np.ascontiguousarray(data[(base + 2 * rank)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        high = np.ascontiguousarray(data[(base + 2 * n_odd[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        delta[row, place] |= high.astype(np.uint64) << width[row].astype(np.uint64)
    return (delta + least[:, None]).reshape(-1)[:n].astype(np.uint32)


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct run of letters once.

    For a tokenizer that lower-cases, drops white space and splits letters from other signs, a text's ids are those of its
    runs of non-blanks one after another, and those of a run of letters with punctuation after it are those of its two parts.
    Runs are cut in Arrow, so that Python meets only distinct parts. Parts that were seen are remembered, up to ``limit`` of
    them; a worker process keeps what it knows for its next tasks, and forgets it once no task has asked for
    ``REST_SECONDS``, as other stages need the memory.
    """

    TAIL = ",.!?;:%&*$#@~^+=-_/()[]{}\"'`"  # no sign of "<|endoftext|>" or its like, which are one token
    WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ƺƼ-ƿǄ-ɏ]+")
    LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | frozenset(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)]))  # lower-casing U+0130 adds a sign that is no letter

    def __init__(self, path: str, limit: int = 800_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary for words of letters parted by a blank: no other cut can apply to them, nor any composition
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = limit
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values(), default=0) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._clear()

    @staticmethod
    def held_by_worker() -> dict:
        """What this worker process keeps between tasks."""
        import sys
        import types

        return sys.modules.setdefault("regscope_worker_state", types.ModuleType("regscope_worker_state")).__dict__

    @staticmethod
    def of_worker(path: str) -> ChunkEncoder | WholeEncoder:
        """This worker's encoder of the vocabulary, from an earlier task if there was one."""
        held = ChunkEncoder.held_by_worker()
        if timer := held.pop("timer", None):
            timer.cancel()
        encoders = held.setdefault("encoders", {})
        if path not in encoders:
            encoders[path] = ChunkEncoder(path) if splits_at_blanks(path) else WholeEncoder(path)
        return encoders[path]

    @staticmethod
    def rest(seconds: float = REST_SECONDS) -> None:
        """Forget the worker's encoders unless a task asks for one within ``seconds``."""

        def forget() -> None:
            ChunkEncoder.held_by_worker().pop("encoders", None)
            give_back()

        timer = threading.Timer(seconds, forget)
        timer.daemon = True
        ChunkEncoder.held_by_worker()["timer"] = timer
        timer.start()

    def _clear(self) -> None:
        self.parts: dict[str, int] = {"": 0}  # numbers of parts, whose ids stand one after another
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)

    def _split(self, run: str) -> tuple[str, str]:
        head = run.rstrip(self.TAIL)
        if not head or head[-1] not in self.LETTERS:
            head = run
        return (head.lower() if head.isascii() and "|" not in head else head), run[len(head) :]

    def _encode_parts(self, parts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts and how many each has. Runs of letters are one word each, so many go through the library as one text,
        parted again at word ends."""
        if words:
            ids = np.array(self.plain.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(parts):
                return ids, np.diff(ends, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _numbers(self, parts: list[str], words: bool = False) -> np.ndarray:
        """The numbers of distinct parts; new ones are learnt."""
        number = np.array(list(map(self.parts.get, parts, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(number < 0)
        for k in range(0, len(new), 5000):
            own = [parts[i] for i in new[k : k + 5000].tolist()]
            ids, size = self._encode_parts(own, words)
            first, last = len(self.parts), len(self.parts) + len(own)
            if last + 1 > len(self.at):
                self.at = np.concatenate((self.at, np.zeros(max(len(self.at), last + 1), np.int64)))
            end = self.at[first] + np.cumsum(size)
            if end[-1] > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), int(end[-1])), np.uint32)))
            self.ids[self.at[first] : end[-1]] = ids
            self.at[first + 1 : last + 1] = end
            self.parts.update(zip(own, range(first, last), strict=True))
            number[new[k : k + 5000]] = np.arange(first, last)
        return number

    def _coded(self, parts: pa.Array, words: bool = False) -> np.ndarray:
        coded = parts.dictionary_encode()
        return self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), words)[coded.indices.to_numpy()]

    def _halves(self, runs: pa.Array) -> np.ndarray:
        """Numbers of the two parts of each run, a row for each."""
        out = np.zeros((len(runs), 2), np.int64)
        head = pc.ascii_rtrim(runs, characters=self.TAIL)
        over = pc.subtract(pc.binary_length(runs), pc.binary_length(head)).to_numpy()
        plain = pc.match_substring_regex(head, f"^{self.WORD.pattern}$").to_numpy(zero_copy_only=False) & (over < 2)
        out[plain, 0] = self._coded(pc.ascii_lower(head.filter(pa.array(plain))), words=True)
        signed = plain & (over == 1)
        out[signed, 1] = self._coded(pc.utf8_slice_codeunits(runs.filter(pa.array(signed)), -1))
        if not plain.all():
            halves = [self._split(x) for x in runs.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()]
            parts = list(dict.fromkeys(itertools.chain.from_iterable(halves)))
            number = dict(zip(parts, self._numbers(parts).tolist(), strict=True))
            out[~plain] = [(number[a], number[b]) for a, b in halves]
        return out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        coded = lists.flatten().dictionary_encode()
        if len(self.parts) > self.limit:
            self._clear()
        halves = self._halves(coded.dictionary)
        size = (self.at[halves + 1] - self.at[halves]).reshape(-1)
        ids = self.ids[spread(self.at[halves].reshape(-1), size)]
        bound = np.concatenate(([0], np.cumsum(size)))[::2]
        run = coded.indices.to_numpy()
        size = np.diff(bound)[run]
        upto = np.concatenate(([0], np.cumsum(size)))
        bounds = lists.offsets.to_numpy()
        return ids[spread(bound[run], size)], np.diff(upto[bounds - bounds[0]])


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``first, first + 1, ...`` of runs of ``size``, one run after another."""
    upto = np.cumsum(size)
    return np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


def splits_at_blanks(path: str) -> bool:
    """Whether a vocabulary file's own settings are those that :class:`ChunkEncoder` relies on."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    parts = lambda x, name: (x or {}).get(name) or ([x] if x else [])
    forms = [x.get("type") for x in parts(held.get("normalizer"), "normalizers")]
    cuts = parts(held.get("pre_tokenizer"), "pretokenizers")
    pattern = [x.get("pattern", {}).get("Regex", "") for x in cuts if x.get("type") == "Split"]
    whole = [x for x in cuts if x.get("type") == "ByteLevel" and (x.get("add_prefix_space") or x.get("use_regex", True))]
    return "Lowercase" in forms and len(pattern) == 1 and r"[\p{L}]+" in pattern[0] and r"[^\s\p{L}\p{N}]+" in pattern[0] and not whole and held["model"].get("end_of_word_suffix") == "</w>"


class WholeEncoder:
    """Encodes whole texts, for tokenizers to which white space matters."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(pc.fill_null(text, "").to_pylist(), add_special_tokens=False)
        size = np.array([len(e.ids) for e in found], np.int64)
        return np.fromiter((i for e in found for i in e.ids), np.uint32, int(size.sum())), size


def write_tokens(docs: DataFrame, path: str, tokenizer: str | Callable[[], str], end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts to a new table at ``path``: ``part, segment, first, doc_ids, n_tokens, payload``.

    ``tokenizer`` is the vocabulary file or a function that finds it on the executor; where its settings allow, runs of
    non-blanks are encoded once each, else whole texts are. ``end_id`` ends each document. Identifiers are whole numbers.
    Documents stand in ascending identifier order (null first; equal identifiers by a hash of their texts); a null text
    counts as empty and has the end id only. Rows that repeat are written each time. Other columns are ignored. An empty
    input writes no segments. A text longer than a segment is a segment by itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = tokenizer if isinstance(tokenizer, str) else tokenizer()
        encoder = ChunkEncoder.of_worker(where)
        part = TaskContext.get().partitionId()
        held, docs_in, sizes, total, first, segment = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = encode_ids(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([docs_in], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                ["part", "segment", "first", "doc_ids", "n_tokens", "payload"],
            )

        for batch in slices(batches, "text", SLICE):
            ids, size = encoder.encode(batch.column("text"))
            ends = np.cumsum(size)
            ids = np.insert(ids, ends, np.uint32(end_id))
            size = size + 1
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), size.tolist(), strict=True):
                if total and total + n > SEGMENT_IDS:
                    yield flush()
                    first += total
                    segment += 1
                    held, docs_in, sizes, total = [], [], [], 0
                held.append(ids[at : at + n])
                docs_in.append(doc)
                sizes.append(n)
                total += n
                at += n
        ChunkEncoder.rest()
        if total:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_width(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = "part int, segment int, first long, doc_ids array<long>, n_tokens array<long>, payload binary"
    rows.select("doc_id", "text").mapInArrow(work, schema).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents read back from a table: ``doc_id, start, n_tokens, ids_crc32, ids`` (without ``with_ids``, ids are null).

    ``start`` counts the ids of all documents before. The prefix sum over parts is one row per part.
    """
    table = spark.read.parquet(path)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)
    parts = table.groupBy("part").agg(F.sum(size).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_ids(batch.column("payload")[k].as_py())
                size = np.array(batch.column("n_tokens")[k].as_py(), np.int64)
                bounds = np.concatenate(([0], np.cumsum(size)))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(size), batch.column("part")[k].as_py()), pa.int32()),
                        pa.array(bounds[:-1] + batch.column("first")[k].as_py(), pa.int64()),
                        batch.column("doc_ids")[k].values,
                        pa.array(size, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(len(size), pa.list_(pa.int32())),
                    ],
                    ["part", "at", "doc_id", "n_tokens", "ids_crc32", "ids"],
                )

    docs = table.select("part", "first", "doc_ids", "n_tokens", "payload").mapInArrow(work, "part int, at long, doc_id long, n_tokens long, ids_crc32 long, ids array<int>")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
