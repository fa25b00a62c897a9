"""Near-duplicate detection by BagMinHash: unbiased signatures of weighted Jaccard similarity over shingle counts.

After Ertl, "BagMinHash - Minwise Hashing Algorithm for Weighted Sets" (KDD 2018). A shingle's weight is its count. The
weight axis is cut into the dyadic intervals (0,1], (1,2], (2,4], ...; each (shingle, interval) has a Poisson process
whose rate is the interval's length, with points that carry a signature component and a weight level. Points up to a
document's count are its own; the least point of each component is the signature. Points come in rising order and stop
once they pass the document's largest component, so that the work does not grow with components times shingles.

Documents with the same shingle counts become one node at once. Nodes that share a band meet their bucket's hub, the node
with most copies, and pairs are verified on all shingles; members that do not join the hub's class are then compared with
all others of the bucket. Every two nodes of a bucket end up compared or in one class. In large buckets that is done by
blocks of at most about ``BLOCK`` odd members and ``BLOCK_BYTES`` of text against such blocks of members: a task compares
two blocks and gives the links that join classes, so a group's pairs are never listed. Classes are the connected components
of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import hash_strings, mix, shingle_hashes, slices, stored, word_lists

BANDS, ROWS = 24, 5
SIMILARITY = 0.8
SLICE = 2 << 20
BLOCK, BLOCK_BYTES, LISTED = 256, 8 << 20, 400
LINK = "a binary, b binary, similarity double"


def bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text with their counts, one text after another, and each text's bounds."""
    words, bounds = word_lists(text)
    shingles, upto = shingle_hashes(hash_strings(words), bounds)
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    order = np.lexsort((shingles, doc))
    shingles = shingles[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return shingles[at], np.diff(np.concatenate((at, [len(shingles)]))), np.concatenate(([0], np.cumsum(new)))[upto]


def unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(shingles: np.ndarray, counts: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash signatures, a row of ``size`` values for each text; all infinite for a text without shingles."""
    texts = len(bounds) - 1
    out = np.full((texts, size), np.inf)
    top = int(counts.max(initial=0))
    of = np.repeat(np.arange(texts), np.diff(bounds))
    seed, doc, low, rate, weight = [], [], [], [], []
    level = 0
    while (0 if level == 0 else 1 << (level - 1)) < top:
        floor = 0 if level == 0 else 1 << (level - 1)
        own = np.flatnonzero(counts > floor)
        seed.append(mix(shingles[own] + np.uint64(level + 1)))
        doc.append(of[own])
        low.append(np.full(len(own), floor))
        rate.append(np.full(len(own), max(1, floor)))
        weight.append(counts[own])
        level += 1
    if not seed:
        return out
    seed, doc, low, rate, weight = (np.concatenate(x) for x in (seed, doc, low, rate, weight))
    when = np.zeros(len(seed))
    limit = np.full(texts, np.inf)
    flat = out.reshape(-1)
    while len(seed):
        seed = mix(seed)
        when = when - np.log(unit(seed)) / rate
        on = when <= limit[doc]
        seed, doc, low, rate, weight, when = (x[on] for x in (seed, doc, low, rate, weight, when))
        pick = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        part = (pick >> np.uint64(32)) % np.uint64(size)
        height = low + 1 + np.where(rate > 1, (pick & np.uint64(0xFFFFFFFF)).astype(np.int64) % rate, 0)
        mine = height <= weight  # thinning: the point lies above the document's count
        np.minimum.at(flat, doc[mine] * size + part[mine].astype(np.int64), when[mine])
        touched = np.unique(doc)
        limit[touched] = out[touched].max(axis=1)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band; the last bits of a value are rounded off, as machines may differ in them."""
    value = (signature.view(np.uint64) + np.uint64(1 << 9)) >> np.uint64(10)
    key = np.zeros((len(value), bands), np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(3) + value[:, r::rows][:, :bands])
    return mix(key + np.arange(bands, dtype=np.uint64))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_hash, bytes, node, bands`` of each row; ``node`` names the shingle counts, ``bands`` holds the band keys."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            shingles, counts, bounds = bags(batch.column("text"))
            keys = band_keys(signatures(shingles, counts, bounds, bands * rows), bands, rows).view(np.int64)
            raw = np.stack((shingles, counts.astype(np.uint64)), axis=1)
            names = [hashlib.blake2b(raw[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
            keys = keys[np.diff(bounds) > 0]
            upto = np.concatenate(([0], np.cumsum((np.diff(bounds) > 0) * bands)))
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("bytes"), pa.array(names, pa.binary()), lists], ["doc_id", "text_hash", "bytes", "node", "bands"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, text_hash long, bytes long, node binary, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima by sum of maxima of two bags of sorted shingles and counts; 1 for two empty bags."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (total - least)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b, similarity``: pairs ``a, b`` of nodes whose texts (``node, text``) are at least so similar. A common node's rows are one skewed
    join key, which adaptive execution splits."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", SLICE), "text_b", SLICE):
            first = batch.column("text_a").dictionary_encode()
            bag_a, bag_b = bags(first.dictionary), bags(batch.column("text_b"))
            one = lambda bag, i: (bag[0][bag[2][i] : bag[2][i + 1]], bag[1][bag[2][i] : bag[2][i + 1]])
            near = np.array([weighted_jaccard(one(bag_a, i), one(bag_b, k)) for k, i in enumerate(first.indices.to_pylist())], float)
            yield batch.select(["a", "b"]).append_column("similarity", pa.array(near)).filter(pa.array(near >= similarity))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, LINK)


def block_links(a: tuple, b: tuple, class_a: list, class_b: list, similarity: float) -> list[tuple[int, int, float]]:
    """Places (in ``a``, in ``b``) and similarities of links between two blocks of bags that join their classes into one, a
    spanning forest.

    One document of ``a`` at a time meets all of ``b`` through ``b``'s sorted shingles.
    """
    order = np.argsort(b[0], kind="stable")
    shingles, counts = b[0][order], b[1][order]
    doc = np.repeat(np.arange(len(b[2]) - 1), np.diff(b[2]))[order]
    weight = np.bincount(doc, weights=counts, minlength=len(b[2]) - 1)
    parent = {c: c for c in [*class_a, *class_b]}

    def root(c: object) -> object:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, (x, y) in enumerate(zip(a[2], a[2][1:], strict=False)):
        own, many = a[0][x:y], a[1][x:y]
        low, high = np.searchsorted(shingles, own), np.searchsorted(shingles, own, side="right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = np.bincount(doc[at], weights=np.minimum(np.repeat(many, n), counts[at]), minlength=len(weight))
        total = many.sum() + weight - same
        for k in np.flatnonzero((same >= similarity * total) & (total > 0)):
            if same[k] / total[k] >= similarity and (p := root(class_a[i])) != (q := root(class_b[k])):
                parent[p] = q
                out.append((i, int(k), float(same[k] / total[k])))
    return out


def links_by_blocks(odd: DataFrame, members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b, similarity`` between odd members and members of buckets (``key, node, class, f, m``; f and m: blocks of both)."""
    place = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["key", "fb", "mb", "node", "class", "text"]
    left = stored(odd.join(texts, "node").select("*", place(F.col("f")).alias("fb"), every("m").alias("mb")).select(*columns))
    right = members.join(texts, "node").select("*", place(F.col("m")).alias("mb"), every("f").alias("fb")).select(*columns)

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and two.num_rows:
            text = lambda x: x.column("text").combine_chunks()
            pick = lambda x: x.column("class").to_pylist()
            found = block_links(bags(text(one)), bags(text(two)), pick(one), pick(two), similarity)
        a, b = one.column("node").to_pylist(), two.column("node").to_pylist()
        places, partners, near = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array([a[i] for i in places], pa.binary()), "b": pa.array([b[k] for k in partners], pa.binary()), "similarity": pa.array(near, pa.float64())})

    keys = ("key", "fb", "mb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, LINK)


def components(links: DataFrame) -> DataFrame:
    """``node, class`` of all nodes in ``links`` (``a, b``): least nodes spread along links, with pointer jumping, until
    nothing changes. Each round is a written table."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("class")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("class").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("class").alias("old"), F.least("class", "c").alias("class"))
        jump = label.select(F.col("node").alias("at"), F.col("class").alias("next"))
        new = stored(step.join(jump, F.col("class") == F.col("at"), "left").select("node", "old", F.least("class", "next").alias("class")))
        label = new.select("node", "class")
        if new.where("old <> class").isEmpty():
            return label


def node_texts(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, text`` of the wanted rows (``node, at, text_hash``). These grow with the table, so they are not broadcast at any size."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    own = rows.join(wanted.hint("merge"), ["text_hash"]).where(F.col("at").eqNullSafe(F.col("doc_id")))
    return own.select("node", "text").dropDuplicates(["node"])


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, class_id, class_size, kept, twins, partner_id, similarity``.

    Words are runs of letters and digits, lower-cased; shingles are five words (shorter texts: one shingle of all words).
    Documents whose shingle counts have a weighted Jaccard similarity of ``similarity`` or more are linked; ``class_id`` is
    the least identifier of those that links join and ``kept`` marks one row of each class (``twins``: how often that row
    is repeated). ``partner_id`` is the least identifier of the document with other shingles that a row was found most similar
    to, at ``similarity``; both are null where no such link exists. These links hold each class together. Texts of any length are read whole. Null, empty and wordless texts are one class. A null identifier is never
    the least unless its class has no other; rows that repeat an identifier are rows of their own. Other columns are
    ignored. Empty input gives no rows. Bands find a pair at similarity 0.8 with a chance of 0.99993, one at 0.9 always but
    for 1 in 10^9.
    """
    slim = stored(nodes(docs, id_col, text_col, bands, rows))
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    node = stored(slim.groupBy("node").agg(F.min(one).alias("first"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
    spread = node.select("node", "n", "bytes", F.explode("bands").alias("key"))
    most = F.min(F.struct((-F.col("n")).alias("n"), "node"))["node"]
    bucket = stored(spread.groupBy("key").agg(most.alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    member = stored(spread.join(bucket.select("key", "hub"), "key"))
    wanted = node.join(member.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("at"), F.col("first.text_hash").alias("text_hash"))
    texts = stored(node_texts(docs, wanted, id_col, text_col))
    first = member.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(first, texts, similarity))
    classes = components(links)
    # members that did not join their hub's class meet all others of the bucket
    named = lambda side: classes.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class"))
    known = member.join(named("node"), "node", "left").join(named("hub"), "hub", "left")
    known = stored(known.select("key", "node", "hub", "bytes", F.coalesce("node_class", "node").alias("class"), (F.coalesce("node_class", "node") != F.coalesce("hub_class", "hub")).alias("odd")))
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    one, size = F.lit(1), F.col("bytes")
    both = F.count_if("odd") * F.count(one)
    sizes = known.groupBy("key").agg(both.alias("pairs"), blocks(F.count_if("odd"), F.sum(F.when(F.col("odd"), size))).alias("f"), blocks(F.count(one), F.sum(size)).alias("m"))
    known = stored(known.join(sizes.where("pairs > 0"), "key").where("node <> hub"))
    few = F.col("pairs") <= LISTED
    odd = known.where(F.col("odd") & few).select("key", F.col("node").alias("a"), F.col("class").alias("a_class"))
    rest = odd.join(known.where(few), "key").where("class <> a_class AND (NOT odd OR a < node)")
    rest = rest.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    more = verified(rest, texts, similarity)
    large = known.where(~few)
    more = stored(more.unionByName(links_by_blocks(large.where("odd"), large, texts, similarity)))
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links)
    found = node.select("node", "first", "n").join(classes, "node", "left")
    found = stored(found.select("node", F.coalesce("class", "node").alias("class"), "first", "n"))
    total = stored(found.groupBy("class").agg(F.min(F.struct("first", "node")).alias("top"), F.sum("n").alias("class_size")))
    found = stored(found.join(total, "class").select("node", F.col("top.first").alias("first"), (F.col("top.node") == F.col("node")).alias("leads"), "class_size"))
    # one row of the class's first document stays, also where its row is repeated
    each = links.select(F.col("a").alias("node"), F.col("b").alias("partner"), "similarity").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("partner"), "similarity"))
    each = each.groupBy("node").agg(F.max(F.struct("similarity", "partner")).alias("link")).select("node", "link.similarity", "link.partner")
    names = node.select(F.col("node").alias("partner"), F.col("first.doc_id").alias("partner_id"))
    found = stored(found.join(stored(each.join(names, "partner").drop("partner")), "node", "left"))  # grows with the rows: not to be broadcast
    out = slim.select("doc_id", "text_hash", "node").withColumn("row", F.monotonically_increasing_id())
    lead = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    out = stored(out.join(found, "node").withColumn("lead", lead))
    # only rows of first documents are joined again, so a class of many copies stays spread
    stays = out.where("lead").groupBy("node").agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("twins")).withColumnRenamed("node", "stays_node")
    first = out.where("lead").join(stays, F.col("node") == F.col("stays_node")).withColumn("kept", F.col("row") == F.col("stays"))
    rest = out.where("NOT lead").withColumn("kept", F.lit(False)).withColumn("twins", F.lit(None).cast("long"))
    columns = ["doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), F.col("class_size").cast("long"), "kept", "twins", "partner_id", "similarity"]
    return first.select(*columns).unionByName(rest.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    The names of these grow with the table, so they are not broadcast at any size, and a task holds those of its partition.
    """
    held = stored(near_classes(docs, id_col, text_col, similarity).where("kept"))
    names = held.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text_col) == F.col("_kept_hash"))
    left = docs.join(names.hint("shuffle_hash"), same, "left_semi")
    if held.where("twins > 1").isEmpty():
        return left
    return left.withColumn("_digest", digest).dropDuplicates([id_col, "_digest"]).drop("_digest")
