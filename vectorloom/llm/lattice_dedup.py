"""Near duplicates of vectors by lattice hashing: every link of cosine LIMIT or more that the tables find, and its components.

1. Equal vectors are one class with its number of rows.
2. Crowds: vectors within half the limit's angle of one pivot are all linked with each other (angles add up), so they form a ball, whose
   inner links are counted and not looked for. A pivot is a member of the fullest lattice cell within a wider one; ROUNDS name the
   cells of each round. What is in no ball is an entry of its own.
3. Every class names its cell in each of several tables of E8 points, and probes the neighbouring points next to it. A bitmap of the
   occupied cells, of a fixed largest size, drops most probes of empty cells before the exchange. What remains is (cell, entry),
   once for a ball however large it is.
4. Entries that meet in a cell are compared in double precision. Two entries are linked whole, not at all, or, if one is a ball, in part,
   as the angle of their pivots and their radii tell; the members of entries that may be linked in part are compared.
5. Links between entries give components by star contraction; numbers of links are sums over entries.

Cells with more than BLOCK entries are compared block by block, and so are the members of balls, so that a task holds two blocks. No pair
inside a class or a ball is ever formed; a row of a pair is a verified link between two entries. Recall is that of the tables (README).

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component; so do vectors
of a length that no other has, as only equal lengths are compared; a null id takes part, its component is the smallest id that is not
null; repeated ids are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import lattice
from vectorloom.llm.common import cut, prepare, small_enough
from vectorloom.llm.components import components

#: Cosine of a link.
LIMIT = 0.9
#: (rows from which on it holds, blocks of a cell, tables) and neighbouring cells that a vector probes in each table; size of a lattice cell.
LAYOUTS, PROBES, WIDTH = ((0, 2, 10), (20_000, 3, 18), (2_000_000, 4, 32)), 16, 2.0
#: Rounds of balls as (blocks, width of the wider cell; the narrower has half of it), and the vectors of a narrow cell that make a crowd.
ROUNDS, CROWD = ((2, 4.0), (2, 2.8), (3, 2.8)), 16
#: Entries, or members, that are compared at once with as many others; bits of the largest bitmap of occupied cells.
BLOCK, MAX_BITS = 512, 1 << 26
#: Radians by which an angle must clear the limit to count without a comparison.
CLEAR = 1e-6


def usable(vector: F.Column) -> F.Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of rows of one length; scaled by the largest component first, so that no square overflows or vanishes."""
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    found = found / np.abs(found).max(1, keepdims=True)
    return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def _by_length(batch: pa.RecordBatch, vectors: str, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length in the batch, at most so many at a time."""
    column = batch.column(vectors)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), most):
            part = rows[at:at + most]
            yield part, _matrix(column.take(pa.array(part)))


def cosines(left: np.ndarray, right: np.ndarray, limit: float) -> np.ndarray:
    """Cosines of unit vectors; those next to the limit are summed without rounding."""
    found = left @ right.T
    for i, j in zip(*np.nonzero(np.abs(found - limit) < 1e-12), strict=True):
        found[i, j] = math.fsum(left[i] * right[j])
    return found


# ---------------------------------------------------------------- classes and balls
def classes_of(rows: DataFrame) -> DataFrame:
    """(eid, k1, k2, vector, n, least) of the distinct usable vectors in `rows` (vec_id, vector, k1, k2)."""
    found = rows.filter(usable(F.col("vector"))).groupBy("k1", "k2").agg(
        F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return cut(cut(found).withColumn("eid", F.monotonically_increasing_id()))


def _ball_codes(blocks: int, width: float, seed: int):
    def run(batches):
        for batch in batches:
            fine, wide = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, units in _by_length(batch, "vector"):
                wide[rows] = lattice.cells(units, seed, blocks, width)[:, 0]
                fine[rows] = lattice.cells(units, seed, blocks, width / 2)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("eid"), batch.column("vector"), pa.array(wide), pa.array(fine)],
                                             ["eid", "vector", "wide", "fine"])
    return run


def _inside(angle: float):
    def run(batches):
        for batch in batches:
            same = np.asarray(batch.column("vector").value_lengths()) == np.asarray(batch.column("middle").value_lengths())
            batch = batch.filter(pa.array(same))
            gaps = np.zeros(batch.num_rows)
            for rows, units in _by_length(batch, "vector"):
                gaps[rows] = np.arccos(np.clip(np.einsum("ij,ij->i", units, _matrix(batch.column("middle").take(pa.array(rows)))), -1, 1))
            own = np.asarray(batch.column("eid")) == np.asarray(batch.column("entry"))
            gaps[own] = 0
            at = pa.array(np.flatnonzero(gaps <= angle))
            yield pa.RecordBatch.from_arrays([batch.column("eid").take(at), batch.column("entry").take(at), pa.array(gaps).take(at)],
                                             ["eid", "entry", "gap"])
    return run


def balls_of(classes: DataFrame, limit: float, dims: int) -> DataFrame:
    """(eid, entry, gap): the ball of each class, named by its pivot, and the angle to it; a class without a ball is its own entry."""
    kind = classes.schema["vector"].dataType.simpleString()
    radius = math.acos(limit) / 2 - CLEAR
    open_, found = classes.select("eid", "vector"), []
    for seed, (blocks, width) in enumerate(ROUNDS):
        coded = open_.mapInArrow(_ball_codes(blocks, width, 1000 + seed), f"eid long, vector {kind}, wide long, fine long")
        crowds = coded.groupBy("wide", "fine").agg(F.count("*").alias("n"), F.min("eid").alias("eid")).filter(F.col("n") >= CROWD)
        pivots = crowds.groupBy("wide").agg(F.max_by("eid", F.struct("n", "eid")).alias("entry"))
        pivots = cut(pivots.join(classes.select(F.col("eid").alias("entry"), F.col("vector").alias("middle")), "entry"))
        if pivots.isEmpty():
            continue
        near = F.broadcast(pivots) if small_enough(pivots, 16 * dims + 64) else pivots
        members = cut(coded.join(near, "wide").select("eid", "vector", "entry", "middle").mapInArrow(_inside(radius), "eid long, entry long, gap double"))
        found.append(members)
        open_ = cut(open_.join(members.select("eid"), "eid", "left_anti"))
    alone = open_.select("eid", F.col("eid").alias("entry"), F.lit(0.0).alias("gap"))
    for members in found:
        alone = alone.unionByName(members)
    return cut(alone)


# ---------------------------------------------------------------- meetings in cells
def _bitmap(stores: DataFrame, count: int) -> tuple[np.ndarray, int] | None:
    """One bit for each hashed cell, if `count` cells leave it sparse; the driver gets at most MAX_BITS bits."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * count - 1).bit_length()))
    if count > bits // 2:
        return None
    place = F.pmod("cell", F.lit(bits))
    words = stores.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64), bits


def _cells(blocks: int, tables: int, probes: int, held):
    """Rows (cell, entry, store): of every vector its own cells, or with `probes` those that it asks and that may be occupied."""
    def run(batches):
        for batch in batches:
            entries = np.asarray(batch.column("entry"))
            for rows, units in _by_length(batch, "vector"):
                for table in range(tables):
                    names = lattice.cells(units, table, blocks, WIDTH, probes)
                    names = names[:, 1:] if probes else names
                    owner = np.repeat(entries[rows], names.shape[1])
                    names = names.ravel()
                    if held:
                        bitmap, bits = held.value
                        place = names & (bits - 1)
                        seen = (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                        names, owner = names[seen], owner[seen]
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(owner), pa.array(np.full(len(names), not probes))],
                                                     ["cell", "entry", "store"])
    return run


def meetings(members: DataFrame, rows: int, layout: tuple[int, int] | None = None) -> DataFrame:
    """(cell, entry) of the cells that an entry lies in and another one lies in or asks, from (entry, vector) of all classes."""
    blocks, tables = layout or [x[1:] for x in LAYOUTS if rows >= x[0]][-1]
    kind = "cell long, entry long, store boolean"
    stores = cut(members.mapInArrow(_cells(blocks, tables, 0, None), kind).distinct())
    bitmap = _bitmap(stores, stores.count())
    held = members.sparkSession.sparkContext.broadcast(bitmap) if bitmap else None
    asks = members.mapInArrow(_cells(blocks, tables, PROBES, held), kind)
    both = cut(stores.unionByName(asks).groupBy("cell", "entry").agg(F.max("store").alias("store")))
    crowded = both.groupBy("cell").agg(F.count("*").alias("n"), F.max("store").alias("met")).filter((F.col("n") > 1) & F.col("met"))
    return cut(both.select("cell", "entry").join(crowded.select("cell", "n"), "cell"))


def _units(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a group of `n` dealt to blocks, and each to the pairs of blocks (i <= j) that its own is part of."""
    slots = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64(key, F.lit(3)), slots).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slots - 1)))
    return own.select(*[c for c in rows.columns if c != "n"], "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, first row of each group) from batches that are sorted by `keys`, cut anew so that no group is split."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        names = np.stack([np.asarray(batch.column(k)) for k in keys])
        starts = np.concatenate([[0], np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1])
        held = batch.slice(starts[-1])
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _sorted_units(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of a bounded number of rows, many to a task: most have two or three, too few for a call each."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _row_cosines(left: np.ndarray, right: np.ndarray, limit: float) -> np.ndarray:
    found = np.einsum("ij,ij->i", left, right)
    for i in np.flatnonzero(np.abs(found - limit) < 1e-12):
        found[i] = math.fsum(left[i] * right[i])
    return found


def _entry_links(limit: float):
    """Links (a, b, whole) of the units (cell, i, j): in small ones all pairs of all units at once, in large ones block by block."""
    widest = math.acos(limit)

    def judged(found: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.arccos(np.clip(found, -1, 1))
        whole = np.where(reach > 0, gap + reach <= widest - CLEAR, found >= limit)
        return whole, ~whole & (reach > 0) & (gap - reach <= widest + CLEAR)

    def rows(a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(whole)], ["a", "b", "whole"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, ["cell", "i", "j"]):
            entry, radius, own, i, j = (np.asarray(batch.column(c)) for c in ("entry", "radius", "own", "i", "j"))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            for at, units in _by_length(batch, "vector", batch.num_rows):
                first = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1]))
                size = np.diff(np.append(first, len(at)))
                one_block = i[at[first]] == j[at[first]]
                small = (size <= 32) & one_block
                for n in np.unique(size[small]):
                    p, q = np.triu_indices(n, 1)
                    base = first[small & (size == n)]
                    left, right = ((base[:, None] + side[None]).ravel() for side in (p, q))
                    for cut_at in range(0, len(left), 1 << 15):
                        x, y = left[cut_at:cut_at + (1 << 15)], right[cut_at:cut_at + (1 << 15)]
                        whole, some = judged(_row_cosines(units[x], units[y], limit), radius[at[x]] + radius[at[y]])
                        keep = whole | some
                        yield rows(entry[at[x[keep]]], entry[at[y[keep]]], whole[keep])
                for start, n, same in zip(first[~small], size[~small], one_block[~small]):
                    mine = np.arange(start, start + n)
                    x, y = mine[own[at[mine]] == i[at[start]]], mine[own[at[mine]] == j[at[start]]]
                    whole, some = judged(cosines(units[x], units[y], limit), radius[at[x]][:, None] + radius[at[y]][None])
                    keep = (whole | some) & (np.tri(len(x), dtype=bool).T & ~np.eye(len(x), dtype=bool) if same else True)
                    p, q = np.nonzero(keep)
                    yield rows(entry[at[x[p]]], entry[at[y[q]]], whole[p, q])
    return run


def _member_links(limit: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole_groups(batches, ["a", "b", "i", "j"]):
            a, b, side, eid, n = (np.asarray(batch.column(c)) for c in ("a", "b", "side", "eid", "n"))
            links = np.zeros(batch.num_rows, np.int64)
            for start, stop in zip(starts, np.append(starts[1:], batch.num_rows)):
                mine = np.arange(start, stop)
                left, right = mine[side[mine] == 0], mine[side[mine] == 1]
                if len(left) and len(right):
                    units = _matrix(batch.column("vector").slice(start, stop - start))
                    found = cosines(units[left - start], units[right - start], limit) >= limit
                    links[left], links[right] = found @ n[right], found.T @ n[left]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (a, b, eid, links)], ["a", "b", "eid", "links"])
    return run


def part_links(pairs: DataFrame, members: DataFrame, limit: float) -> DataFrame:
    """(a, b, eid, links): rows that each member of two entries links with in the other one; `pairs` (a, b), `members` (entry, eid, vector, n)."""
    sizes = members.groupBy("entry").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"))
    size = lambda side: sizes.select(F.col("entry").alias(side), F.col("slots").alias(f"slots_{side}"))
    sized = cut(pairs.join(size("a"), "a").join(size("b"), "b"))
    own = F.xxhash64("eid", F.lit(5))
    sides = []
    for side, (mine, other) in enumerate((("a", "b"), ("b", "a"))):
        rows = sized.join(members.withColumnRenamed("entry", mine), mine)
        rows = rows.withColumn("here", F.pmod(own, F.col(f"slots_{mine}")).cast("int"))
        rows = rows.withColumn("there", F.explode(F.sequence(F.lit(0), F.col(f"slots_{other}") - 1)))
        i, j = ("here", "there") if side == 0 else ("there", "here")
        sides.append(rows.select("a", "b", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "eid", "vector", "n"))
    units = _sorted_units(sides[0].unionByName(sides[1]), ["a", "b", "i", "j"])
    return units.mapInArrow(_member_links(limit), "a long, b long, eid long, links long")


# ---------------------------------------------------------------- the whole
def near_duplicates(table: DataFrame, limit: float = LIMIT, vec_id: str = "vec_id", vectors: str = "embedding",
                    layout: tuple[int, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (see the top of this file)."""
    spark = table.sparkSession
    prepare(spark)
    vector = F.col(vectors)
    rows = table.select(F.col(vec_id).alias("vec_id"), vector.alias("vector"), F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(7), vector).alias("k2"))
    classes = classes_of(rows)
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    balls = balls_of(classes, limit, facts.dims or 1)
    members = cut(classes.join(balls, "eid").select("eid", "vector", "n", "least", "entry", "gap"))
    entries = members.groupBy("entry").agg(F.sum("n").alias("rows"), F.min("least").alias("least"), F.max("gap").alias("radius"))
    # a null id counts for nothing here: a component takes its smallest id that is not null
    entries = cut(entries.join(members.filter("eid = entry").select("entry", "vector"), "entry"))

    met = meetings(members.select("entry", "vector"), facts.n, layout)
    units = _units(met.join(entries.select("entry", "vector", "radius"), "entry"), "entry")
    links = _sorted_units(units, ["cell", "i", "j"]).mapInArrow(_entry_links(limit), "a long, b long, whole boolean")
    links = cut(links.groupBy("a", "b").agg(F.max("whole").alias("whole")))
    whole = links.filter("whole").select("a", "b")
    part = cut(part_links(links.filter("not whole").select("a", "b"), members.select("entry", "eid", "vector", "n"), limit))

    edges = whole.unionByName(part.select("a", "b").distinct())
    named = components(edges)
    labels = entries.select("entry", "least", "rows").join(named.withColumnRenamed("node", "entry"), "entry", "left")
    labels = labels.withColumn("component", F.coalesce("component", "entry"))
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    both = whole.select(F.col("a").alias("entry"), F.col("b").alias("other")).unionByName(whole.select(F.col("b").alias("entry"), F.col("a").alias("other")))
    outer = both.join(entries.select(F.col("entry").alias("other"), "rows"), "other").groupBy("entry").agg(F.sum("rows").alias("outer"))
    told = cut(labels.join(least, "component").join(outer, "entry", "left").select(
        "entry", "component_id", (F.col("rows") - 1 + F.coalesce("outer", F.lit(0))).alias("base")))

    extra = part.groupBy("eid").agg(F.sum("links").alias("extra"))
    by_class = classes.select("eid", "k1", "k2").join(members.select("eid", "entry"), "eid").join(told, "entry").join(extra, "eid", "left")
    by_class = cut(by_class.select("k1", "k2", "component_id", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("n_links")))
    keyed = rows.select("vec_id", F.when(usable(F.col("vector")), F.col("k1")).alias("k1"), "k2")
    by_class = F.broadcast(by_class) if small_enough(by_class, 48) else by_class
    done = keyed.join(by_class, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select(F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))
