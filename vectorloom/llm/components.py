"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import BROADCAST_BYTES, cut

#: Bytes of a row (node, smallest neighbour) in a broadcast table.
ROW_BYTES = 32


def _stars(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Every node sends its neighbours, the larger ones or the smaller ones and itself, to the smallest of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(F.broadcast(least) if few else least, "a")
    linked = joined.filter(F.col("b") > F.col("a")) if large else joined
    out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    out = out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return out if large else out.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a long, b long) reaches.

    The edges (larger node, smaller node) end as stars around the smallest nodes. A round is a large star and a small star; the number
    of rounds grows with the logarithm of the number of nodes. The table of smallest neighbours is broadcast while the counted
    edges show it to be small, and joined by a shuffle beyond that.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    for _ in range(most_rounds):
        if not state[0]:
            break
        few = 2 * state[0] * ROW_BYTES <= BROADCAST_BYTES
        now = cut(_stars(_stars(now, True, few), False, few))
        before, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
