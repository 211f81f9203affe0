"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a unit vector hashes to the nearest signed axis of the
rotated space. A table joins the hashes of two or more rotations, the last one over so many axes that buckets have a few rows. Queries probe the
buckets whose axes are nearest in every table; what lies there is ranked by exact inner products in double precision.

Vectors are dealt to bands of norms, BANDS to each halving of the largest one. Every band has buckets of its own and is probed by every
query. Inside a band, vectors of different norms get one more coordinate that makes their norms equal, so that the largest inner product
is the smallest angle; as the norms of a band differ little, the coordinate is small and does not gather the vectors in a few buckets.

Work is laid out by (table, cell): a cell holds whole buckets of about CELL_BYTES of vectors, meets the queries that probe them, and
answers each with its k best, so no pair is ever a row. A bucket larger than a cell is split by a hash of the vector and asked in all
its parts. Equal vectors are one entry with its k + 1 smallest ids, found from salted groups: a vector that a third of all rows share
is one entry of a bucket. Nothing is capped; recall is what the probes reach (see README).

Cases: vectors that are null, empty, zero, hold null or non-finite components or have another length than most take no part,
neither as queries nor as candidates; with fewer candidates than k all found are returned; ties go to the smaller id; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.llm.common import cut, gather_ranges, prepare

#: Tables, share of the buckets of a table that a query probes (times the square root of the number of vectors), entries of a bucket.
TABLES, PROBE_RATE, BUCKET_ROWS = 24, 1.6, 3
#: Bands of norms to each factor of two.
BANDS = 4
#: Bytes of vectors in a cell.
CELL_BYTES = 32 << 20
#: Bytes that the probes of a run of queries take while they are ranked.
PROBE_BYTES = 64 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(rows, n)
        half *= 2
    return x / math.sqrt(n)


def directed(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the base 2 logarithms of the norms (which may be beyond what a square holds)."""
    largest = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / largest
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / length, (np.log2(largest) + np.log2(length))[:, 0]


@dataclass(frozen=True)
class CrossPolytope:
    """The hash family for a band of vectors of `dims` components; `top` is the logarithm of its largest norm, None if its norms are alike.

    Families of one width turn points alike; `first` is the number of the band's first bucket.
    """

    dims: int
    width: int
    top: float | None
    axes: tuple[int, ...]  # axes of each rotation of a table
    tables: int
    probes: int
    first: int = 0
    seed: int = 7

    def placed(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, :self.dims], norms = directed(vectors)
        if self.top is not None and not query:
            share = np.exp2(np.minimum(norms - self.top, 0))
            out[:, :self.dims] *= share[:, None]
            out[:, self.dims] = np.sqrt(1 - share ** 2)
        return out

    def rotated(self, points: np.ndarray, table: int, turn: int) -> np.ndarray:
        signs = np.random.default_rng([self.seed, table, turn]).integers(0, 2, (3, self.width)) * 2 - 1
        for row in signs:
            points = hadamard(points * row)
        return points

    def buckets(self, points: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(points), np.int64)
        for turn, axes in enumerate(self.axes):
            x = self.rotated(points, table, turn)[:, :axes]
            at = np.abs(x).argmax(1)
            code = code * (2 * axes) + 2 * at + (x[np.arange(len(x)), at] > 0)
        return code + self.first

    def probed(self, turned: list[np.ndarray]) -> np.ndarray:
        """The `probes` buckets of each point whose axes lie nearest, by the sum of squared shortfalls; turned: the points in each rotation of a table."""
        codes, loss = np.zeros((len(turned[0]), 1), np.int64), np.zeros((len(turned[0]), 1))
        for axes, x in zip(self.axes, turned, strict=False):
            x = x[:, :axes]
            signed = np.concatenate([-x, x], 1)  # column j: -axis j, column axes + j: +axis j
            order = np.argsort(-signed, 1)[:, :self.probes]
            short = (np.take_along_axis(signed, order[:, :1], 1) - np.take_along_axis(signed, order, 1)) ** 2
            code = 2 * (order % axes) + (order >= axes)
            loss = (loss[:, :, None] + short[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * (2 * axes) + code[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, 1, kind="stable")[:, :self.probes]
            loss, codes = np.take_along_axis(loss, best, 1), np.take_along_axis(codes, best, 1)
        return codes + self.first


def families(bands: list[tuple[int, int, float, float]], dims: int, tables: int = TABLES, probe_rate: float = PROBE_RATE) -> dict[int, CrossPolytope]:
    """The family of each band, from (band, vectors, lowest and highest logarithm of a norm).

    A band has buckets in proportion to the number of its vectors, probes to its square root.
    """
    uneven = [high - low > 1.5e-6 for _, _, low, high in bands]
    width, out, first = 1 << max(0, (dims + any(uneven) - 1).bit_length()), {}, 0
    for (band, n, _, high), mixed in zip(bands, uneven, strict=True):
        wanted, axes = max(2, n // BUCKET_ROWS), []
        while wanted >= 2 and len(axes) < 8:
            axes.append(min(width, 1 << max(0, (wanted // 2).bit_length() - 1)))
            wanted //= 2 * axes[-1]
        total = math.prod(2 * a for a in axes)
        probes = max(1, min(total, math.ceil(probe_rate * total / math.sqrt(n))))
        out[band] = CrossPolytope(dims, width, high if mixed else None, tuple(axes), tables, probes, first)
        first += total
    return out


def all_buckets(hashing: dict[int, CrossPolytope], vectors: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The bucket of each vector in every table."""
    tables = next(iter(hashing.values())).tables
    codes = np.zeros((len(vectors), tables), np.int64)
    for band in np.unique(bands):
        mine, family = bands == band, hashing[int(band)]
        at = family.placed(vectors[mine], query=False)
        codes[mine] = np.stack([family.buckets(at, t) for t in range(tables)], 1)
    return codes


def all_probes(hashing: dict[int, CrossPolytope], points: np.ndarray, table: int) -> np.ndarray:
    """The buckets of every band that each placed query probes in a table, sorted."""
    some, codes, known = next(iter(hashing.values())), [], {}
    turned = [some.rotated(points, table, turn) for turn in range(max(len(f.axes) for f in hashing.values()))]
    for family in hashing.values():
        kind = (family.axes, family.probes)
        if kind not in known:
            known[kind] = family.probed(turned) - family.first
        codes.append(known[kind] + family.first)
    return np.sort(np.concatenate(codes, 1), 1)


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector has the most frequent length (of equally frequent ones the larger), no null, only finite components and
    is not zero; v as array<double>."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    out = rows.select(F.col(key).alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    usual = out.groupBy(F.size("v").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("m")).first().m
    return out.filter(F.size("v") == (usual["size"] if usual else 0))


def nearest(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
            probe_rate: float = PROBE_RATE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query` (a Column over `key`) the k rows of largest inner product found."""
    spark = rows.sparkSession
    prepare(spark)
    points = cut(usable_vectors(rows, key, vector).withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumn(
        "raw", F.array_join(F.transform("v", lambda c: (c + 0.0).cast("string")), ",")).withColumn(
        "raw", F.sha2("raw", 256)))
    # equal vectors: their k + 1 smallest ids, first within salts, then over the salts
    salted = points.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    small = lambda df, by: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("id"))).filter(F.col("n") <= k + 1)
    ids = small(small(salted.select("raw", "salt", "id"), ["raw", "salt"]), ["raw"])
    members = cut(ids.groupBy("raw").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    asking = points.filter("asks").join(members.select("raw", "rep"), "raw").select(F.col("id").alias("query_id"), "rep")
    entries = points.join(members.select("raw", F.col("rep").alias("id")), ["raw", "id"]).dropDuplicates(["raw"]).select(F.col("id").alias("rep"), "v")
    largest = F.array_max(F.transform("v", F.abs))
    norm = F.log2(largest) + F.log2(F.aggregate(F.transform("v", lambda c: c / largest), F.lit(0.0), lambda a, c: a + c * c)) / 2
    entries = cut(entries.withColumn("norm", norm))
    n, dims, top = entries.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    entries = entries.withColumn("band", F.floor((F.lit(top) - F.col("norm")) * BANDS).cast("int"))
    bands = entries.groupBy("band").agg(F.count("*"), F.min("norm"), F.max("norm"))  # a few thousand at most, as exponents are bounded
    hashing = families(sorted(map(tuple, bands.collect())), dims or 1, tables, probe_rate)
    cells = max(1, math.ceil(n * (dims or 1) * 8 / CELL_BYTES))
    cell_rows = CELL_BYTES // (8 * (dims or 1))

    def stack(vectors: pd.Series) -> np.ndarray:
        return np.stack([np.asarray(v, np.float64) for v in vectors])

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = all_buckets(hashing, stack(batch["v"]), batch["band"].to_numpy())
                yield pd.DataFrame({"rep": batch["rep"], "v": batch["v"], "codes": list(codes)})

    coded = cut(entries.mapInPandas(hashed, "rep long, v array<double>, codes array<long>"))
    cell = F.pmod(F.col("bucket") + 7919 * F.col("t"), F.lit(cells)).cast("int")
    index = coded.select("rep", "v", F.posexplode("codes").alias("t", "bucket")).withColumn("cell", cell)
    filled = index.groupBy("t", "cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).cast("int").alias("parts"))
    parts = cut(filled.filter("parts > 1"))  # cells with a crowded bucket
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    index = index.join(parts, ["t", "cell"], "left").select("t", "cell", part.alias("part"), "bucket", "rep", "v")

    def probing(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        widest = max(f.probes * (2 * max(f.axes, default=1) + f.probes) for f in hashing.values()) if hashing else 1
        step = max(1, PROBE_BYTES // (16 * widest))
        for batch in (whole.iloc[first:first + step] for whole in batches for first in range(0, len(whole), step)):
            at = next(iter(hashing.values())).placed(stack(batch["v"]), query=True)
            for t in range(tables):
                codes = all_probes(hashing, at, t)
                places, rows, found = (codes + 7919 * t) % cells, [], []
                for row in range(len(batch)):
                    for c in np.unique(places[row]):
                        rows.append((row, c))
                        found.append(codes[row][places[row] == c])
                rows = np.array(rows)
                yield pd.DataFrame({"rep": batch["rep"].to_numpy()[rows[:, 0]], "t": np.int32(t), "cell": rows[:, 1].astype(np.int32),
                                    "buckets": found, "v": batch["v"].to_numpy()[rows[:, 0]]})

    # a row for each cell that a query probes, not for each bucket
    asked = entries.join(asking.select("rep").distinct(), "rep", "left_semi")
    probes = asked.mapInPandas(probing, "rep long, t int, cell int, buckets array<long>, v array<double>").join(parts, ["t", "cell"], "left")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def answer(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(queries):
            found = found.sort_values("bucket", kind="stable")
            buckets, reps, x = found["bucket"].to_numpy(), found["rep"].to_numpy(), stack(found["v"])
            for rep, probe, v in zip(queries["rep"], queries["buckets"], queries["v"], strict=True):
                probe = np.asarray(probe)
                first = np.searchsorted(buckets, probe, "left")
                rows = gather_ranges(first, np.searchsorted(buckets, probe, "right") - first)
                if not len(rows):
                    continue
                score = x[rows] @ np.asarray(v, np.float64)
                if len(rows) > k + 1:
                    keep = score >= np.partition(score, -(k + 1))[-(k + 1)]
                    rows, score = rows[keep], score[keep]
                best = np.lexsort((reps[rows], -score))[:k + 1]
                out.append(pd.DataFrame({"rep": rep, "near": reps[rows[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["t", "cell", "part"]
    found = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(answer, "rep long, near long, score double")
    # the same pair comes from several tables; its product may differ in the last bit with the block's shape, so one value is kept
    pairs = found.groupBy("rep", "near").agg(F.max("score").alias("score"))
    best = pairs.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "near"))).filter(F.col("n") <= k + 1)
    listed = best.join(members.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias("vec_id"))
    lists = listed.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(
        F.col("n") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    ranked = asking.join(lists, "rep").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return ranked.select("query_id", F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
