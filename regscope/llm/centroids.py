"""Centroid clustering: Lloyd rounds in whole numbers, assignment by a vantage-point tree over the centroids.

The tree (Yianilos 1993) is rebuilt from a round's centroids on the driver, which holds ``k`` vectors, and broadcast. Each
vector searches it best first: the open node with the least lower bound is next, a node is left out only if its bound lies
above the best distance so far, so that ties are found too, and every distance to a centroid is an exact whole number. The
vectors of a batch take their steps together, each on its own frontier. Tasks send a sum per centroid, not vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regscope.llm.common import share, shared, stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
SEED = "2:"
FAR = 1 << 26  # components stop there, so that a squared distance fits 64 bits
SLACK = 1e-9  # by which bounds give way to the rounding of square roots


class Tree:
    """A vantage-point tree over whole vectors; every node holds one of them and up to two children."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.vantage: list[int] = []
        self.child: list[list[int]] = []
        self.low: list[list[float]] = []
        self.high: list[list[float]] = []
        todo = [(np.arange(len(points)), -1, 0)] if len(points) else []
        while todo:
            own, parent, side = todo.pop()
            node = len(self.vantage)
            if parent >= 0:
                self.child[parent][side] = node
            rest = own[1:]
            far = np.sqrt(((points[rest] - points[own[0]]) ** 2).sum(axis=1).astype(np.float64))
            self.vantage.append(int(own[0]))
            self.child.append([-1, -1])
            self.low.append([0.0, 0.0])
            self.high.append([0.0, 0.0])
            if not len(rest):
                continue
            inner = far <= np.median(far)
            for side, part in enumerate((inner, ~inner)):
                if part.any():
                    self.low[node][side], self.high[node][side] = float(far[part].min()), float(far[part].max())
                    # the farthest point first: its distances tell the others apart best
                    todo.append((rest[part][np.argsort(-far[part], kind="stable")], node, side))
        self.vantage = np.array(self.vantage, np.int64)
        self.child, self.low, self.high = (np.array(x).reshape(-1, 2) for x in (self.child, self.low, self.high))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest point of each row of ``x`` (ties: the smaller number), its squared distance, and how many distances
        were taken in all."""
        who, best = np.full(len(x), len(self.points)), np.full(len(x), np.iinfo(np.int64).max)
        active, taken = np.arange(len(x)), 0
        bound = np.full((len(x), len(self.vantage)), np.inf)
        bound[:, :1] = 0.0
        while len(active) and len(self.vantage):
            node = bound.argmin(axis=1)
            least = bound[np.arange(len(active)), node]
            on = least <= np.sqrt(best[active].astype(np.float64)) * (1 + SLACK) + SLACK
            on &= np.isfinite(least)
            if not on.all():
                active, bound, node, least = active[on], bound[on], node[on], least[on]
                if not len(active):
                    break
            point = self.vantage[node]
            squared = ((x[active] - self.points[point]) ** 2).sum(axis=1)
            taken += len(active)
            nearer = (squared < best[active]) | ((squared == best[active]) & (point < who[active]))
            best[active[nearer]], who[active[nearer]] = squared[nearer], point[nearer]
            row = np.arange(len(active))
            bound[row, node] = np.inf
            far = np.sqrt(squared.astype(np.float64))
            for side in (0, 1):
                child = self.child[node, side]
                has = child >= 0
                gap = np.maximum(self.low[node, side] - far, far - self.high[node, side]) * (1 - SLACK) - SLACK
                bound[row[has], child[has]] = np.maximum(gap, least)[has]
        return who, best, taken


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, v`` of the vectors that count, in whole numbers."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    number = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(float(FAR))), F.lit(float(-FAR))).cast("int")
    kept = rows.where((F.size(vector_col) == dimensions) & ~odd)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, number).alias("v"))


def matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def next_centroids(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """The floored means of the vectors nearest to each of ``points``; a point without vectors stays."""
    held, k, dimensions = share(vectors, Tree(points)), *points.shape
    names = [f"s{i}" for i in range(dimensions)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared(held)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, dimensions)
                who = tree.nearest(x)[0]
                order = np.argsort(who, kind="stable")
                there, first = np.unique(who[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(who, minlength=k)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[on]), *(pa.array(sums[on, i]) for i in range(dimensions))], ["cluster", "n", *names])

    parts = vectors.select("v").mapInArrow(work, ", ".join(["cluster int", "n long", *(f"{s} long" for s in names)]))
    points = points.copy()
    for row in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():  # k rows at most
        points[row["cluster"]] = [row[s] // row["n"] for s in names]
    return points


def clusters(
    rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Only vectors of ``dimensions`` components count, none of which is null or not finite; others give no row. A component
    x becomes the whole number ``floor(scale * x)``, at most ``FAR`` either way. The first centroids are the ``k`` vectors
    whose identifiers, put behind ``seed``, have the smallest SHA-256, in that order (null identifiers last, equal ones by
    components); with fewer vectors there are fewer centroids. After ``rounds`` of assignment and floored means the vectors
    are assigned once more. Ties go to the smaller number. Equal vectors, also repeated rows, each have their row. A sum of
    distances beyond 64 bits is null. Other columns are ignored. Empty input gives no rows. What tasks send and the
    driver holds is ``k`` vectors, whatever the table's size.
    """
    vectors = stored(whole_vectors(rows, id_col, vector_col, dimensions, scale))
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("digest")
    first = vectors.select(digest, "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    points = np.array([r["v"] for r in first], np.int64).reshape(-1, dimensions)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if len(points):
        for _ in range(rounds):
            points = next_centroids(vectors, points)
    held = share(vectors, Tree(points))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared(held)
        for batch in batches:
            who, distance, _ = tree.nearest(matrix(batch, dimensions))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("held")).collect()  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(int(r["held"]) for r in sums))
    name = lambda c: hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest()
    about = [(r["cluster"], fits(int(r["held"])), total, name(r["cluster"])) for r in sums]
    about = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
