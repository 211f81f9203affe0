"""Centroid clustering in whole numbers: Lloyd rounds in which a vantage-point tree over the centroids finds each vector's nearest one.

Components become floor(256 x), so that every distance, sum and mean is exact and reruns agree on any cluster. Before each round the tree
is rebuilt from the k centroids and broadcast; k * components is bounded by MAX_NUMBERS, whatever the number of vectors. A node holds a
vantage point, itself a centroid, and two children with the smallest and largest distance of their members from it; a leaf holds up to
LEAF centroids. Each vector searches best first: of the nodes on its list, the one with the smallest lower bound is opened, its centroids
are compared by exact 64-bit distances, and its children get bounds by the triangle inequality. The search ends when the smallest bound
is beyond the best distance; a bound that equals it is still opened, so that ties find the smaller number. All vectors of a block
take their steps together in numpy, each on its own list.

A round moves no vector: tasks read the table, add up their vectors by centroid, and one row for each (centroid, component) and task is
exchanged. The driver holds the k centroids only.

Cases: vectors that are null or of another length, or hold null or non-finite components, take no part; neither do vectors beyond a norm of
2^30 after scaling, whose distances may not fit 64 bits. With fewer vectors than k each is a centroid of its own; equal hashes (repeated ids) are
ordered by their components; a null id hashes as `2:`; a centroid without vectors stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.common import cut, prepare

#: Fixed values of the query: centroids, rounds, components, scale, and the prefix of the hash that orders the first centroids.
CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Centroids of a leaf; numbers that the broadcast tree may hold; vectors of a block.
LEAF, MAX_NUMBERS, BLOCK = 4, 4 << 20, 8192
#: Squared norm of the longest vector that takes part.
MAX_NORM2 = 2.0**60


def whole_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their whole components) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    usable = np.flatnonzero((np.diff(starts) == dims) & ~np.asarray(column.is_null()))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    found = np.asarray(values)[starts[usable][:, None] + np.arange(dims)]
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * found)
        fine = np.isfinite(scaled).all(1) & ((scaled * scaled).sum(1) <= MAX_NORM2)
    return usable[fine], scaled[fine].astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    gap = vectors - centroids
    return np.einsum("ij,ij->i", gap, gap)


class VantageTree:
    """Nodes as arrays: `points` of node i are its centroids (one vantage point, or those of a leaf), `children` its two subtrees."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.points: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.ranges: list[np.ndarray | None] = []
        self._grow(np.arange(len(centroids)))
        self.inner = np.array([c is not None for c in self.children])
        width = max(map(len, self.points))
        self.members = np.array([np.pad(p, (0, width - len(p)), constant_values=-1) for p in self.points])

    def _grow(self, members: np.ndarray) -> int:
        node = len(self.points)
        leaf = len(members) <= LEAF
        self.points.append(members if leaf else members[:1])
        self.children.append(None)
        self.ranges.append(None)
        if not leaf:
            rest = members[1:]
            gaps = distances(self.centroids[rest], self.centroids[members[:1]])
            order = np.argsort(gaps, kind="stable")
            half = len(rest) // 2
            parts = order[:half], order[half:]
            self.children[node] = tuple(self._grow(np.sort(rest[p])) for p in parts)
            self.ranges[node] = np.sqrt(np.array([[gaps[p].min(), gaps[p].max()] for p in parts], float))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
        n = len(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        cluster = np.full(n, len(self.centroids))
        bounds = np.full((n, len(self.points)), np.inf)
        bounds[:, 0] = 0
        active = np.arange(n)
        while len(active):
            node = bounds[active].argmin(1)
            bound = bounds[active, node]
            # the factor outweighs the rounding of square roots, so that no bound that equals the best distance is cut off
            open_ = np.isfinite(bound) & (bound * bound <= best[active] * (1 + 1e-9))
            active, node = active[open_], node[open_]
            bounds[active, node] = np.inf
            gaps = np.zeros(len(active), np.int64)
            for place in range(self.members.shape[1]):
                point = self.members[node, place]
                at = np.flatnonzero(point >= 0)
                gaps[at] = distances(vectors[active[at]], self.centroids[point[at]])
                rows = active[at]
                closer = (gaps[at] < best[rows]) | ((gaps[at] == best[rows]) & (point[at] < cluster[rows]))
                best[rows[closer]], cluster[rows[closer]] = gaps[at][closer], point[at][closer]
                if place == 0:
                    first = np.sqrt(gaps.astype(float))
            for i in np.unique(node[self.inner[node]]):
                rows = active[node == i]
                gap = first[node == i]
                for child, (low, high) in zip(self.children[i], self.ranges[i], strict=True):
                    slack = 1e-12 * (gap + high)
                    bounds[rows, child] = np.maximum(0, np.maximum(low - gap, gap - high) - slack)
        return cluster, best


def _blocks(batches: Iterable[pa.RecordBatch], vectors: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            rows, whole = whole_vectors(part.column(vectors), dims)
            if len(rows):
                yield part, rows, whole


def first_centroids(table: DataFrame, k: int, dims: int, vec_id: str, vectors: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id: a top-k of the whole table."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("whole", T.ArrayType(T.LongType()))])

    def kept(batches):
        for part, rows, whole in _blocks(batches, vectors, dims):
            ids = part.column("_id").to_pylist()
            keys = [hashlib.sha256(f"{SEED}{'' if ids[r] is None else ids[r]}".encode()).hexdigest() for r in rows.tolist()]
            take = np.argsort(np.array(keys), kind="stable")[:k + 1]
            last = keys[take[min(k, len(take)) - 1]]  # all rows of the last key stay, so that ties are settled below
            chosen = [i for i, key in enumerate(keys) if key <= last]
            yield pa.RecordBatch.from_pydict({"key": [keys[i] for i in chosen], "whole": [whole[i].tolist() for i in chosen]},
                                             schema=pa.schema([("key", pa.string()), ("whole", pa.list_(pa.int64()))]))

    source = table.select(F.col(vec_id).cast("string").alias("_id"), vectors)
    top = source.mapInArrow(kept, schema).orderBy("key", "whole").limit(k).collect()
    return np.array([r.whole for r in top], np.int64).reshape(-1, dims)


def centroid_clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, vec_id: str = "vec_id",
                      vectors: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids)."""
    if k * dims > MAX_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components are over the bound of {MAX_NUMBERS} numbers")
    spark = table.sparkSession
    prepare(spark)
    centroids = first_centroids(table, k, dims, vec_id, vectors)

    def sums(tree):
        def add(batches):
            total, count = np.zeros((len(tree.value.centroids), dims), np.int64), np.zeros(len(tree.value.centroids), np.int64)
            for _, _, whole in _blocks(batches, vectors, dims):
                cluster, _ = tree.value.nearest(whole)
                order = np.argsort(cluster, kind="stable")
                found, starts, n = np.unique(cluster[order], return_index=True, return_counts=True)
                total[found] += np.add.reduceat(whole[order], starts)
                count[found] += n
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seen, dims)), pa.array(np.tile(np.arange(dims), len(seen))),
                                              pa.array(total[seen].ravel()), pa.array(np.repeat(count[seen], dims))], ["cluster", "place", "s", "n"])
        return add

    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        added = table.select(vectors).mapInArrow(sums(tree), "cluster long, place long, s long, n long")
        means = added.groupBy("cluster", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # k * dims rows
        for r in means:
            centroids[r.cluster, r.place] = r.s // r.n
        tree.destroy()

    tree = spark.sparkContext.broadcast(VantageTree(centroids)) if len(centroids) else None
    out = T.StructType([T.StructField(vec_id, table.schema[vec_id].dataType), T.StructField("cluster", T.IntegerType()),
                        T.StructField("distance", T.LongType())])

    def assign(batches):
        for part, rows, whole in _blocks(batches, vectors, dims) if tree else ():
            cluster, gap = tree.value.nearest(whole)
            yield pa.RecordBatch.from_arrays([part.column(vec_id).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(gap)],
                                             [vec_id, "cluster", "distance"])

    return table.select(vec_id, vectors).mapInArrow(assign, out), centroids


def cluster_report(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = table.sparkSession
    assigned, centroids = centroid_clusters(table, **options)
    assigned = cut(assigned)
    inertia = F.sum(F.col("distance").cast("decimal(20,0)"))
    by_cluster = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(inertia.alias("s")).collect()}  # k rows
    total = sum(by_cluster.values())
    rows = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in by_cluster.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(options.get("vec_id", "vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                                                               "centroid_sha256")
