"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of the mix, but at most `most` times its own size; what a full source cannot take
goes to the others by weight until none is above. A source whose target is r times its size takes floor(r) certain whole copies of each
document. The rest of the target is a fixed-size sample with unequal probabilities: document i has inclusion odds
f / (1 - f) * (size_i / mean size) ** size_power, f being the fraction of r, a uniform number U_i, and the rank
(U_i / (1 - U_i)) / odds_i; documents enter in the order of their ranks until the words nearest to the target are taken.

The order is global (range partitions with one running total per partition), so a source with a third of all rows is spread like any
other. Uniform numbers are hashes of the id and a seed: reruns and recomputed tasks agree.

Cases: a null text has size 0 and gets the certain copies only, which hold no words; the null source is the last one; rows with
one id are documents of their own whose ties break by size; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.llm.common import WORD, cut, prepare, small_enough, text_of
from vectorloom.runtime import dense_ids

#: Weights of the sources in code-point order, repeating; the mix's size as a share of all words; most copies of a source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Exponent of a document's size in its inclusion odds: 0 gives every document of a source one probability, 1 proportional odds.
SIZE_POWER = 0.25


def word_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.regexp_count(text_of(F.col("text")), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): weights by code point, full sources capped, the excess reshared.

    The cap level rises until no further source is full; each step is one aggregate over the table of sources.
    """
    if share > most:
        raise ValueError("the mix cannot be larger than all sources at their most")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = dense_ids(per, [F.col("source").asc_nulls_last()], "_i")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", "n_docs", weight.alias("_w")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    room, level, full = F.col("source_size") * most, None, -1
    for _ in range(table.count() + 1):  # each step but the last fills a source
        is_full = F.lit(False) if level is None else room <= F.col("_w") * level
        n_full, filled, open_weight = table.agg(F.count_if(is_full), F.sum(F.when(is_full, room)),
                                                F.sum(F.when(~is_full, F.col("_w")))).first()
        if n_full == full or not open_weight:
            break
        full, level = n_full, (share * total - (filled or 0.0)) / open_weight
    target = F.when(room <= F.col("_w") * (level or 0.0), room).otherwise(F.col("_w") * (level or 0.0))
    return table.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def pareto_mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
               size_power: float = SIZE_POWER) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of `docs` (doc_id, source, text); doc_id may be any long."""
    prepare(docs.sparkSession)
    sizes = cut(word_sizes(docs, "doc_id", "source"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_s")
    if small_enough(targets, 512):
        targets = F.broadcast(targets)
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    tilt = F.pow((F.col("size") + 1) * F.col("n_docs") / (F.col("source_size") + F.col("n_docs")), F.lit(size_power))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = sizes.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", F.floor(ratio).alias("certain"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("rest"), (uniform / (1 - uniform) / tilt).alias("rank"))
    # Running totals in the order of the ranks: partitions of the global sort first, then the rows of each partition.
    order = [F.col("source").asc_nulls_last(), "rank", "doc_id", "size"]
    ordered = cut(keyed.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftrightunsigned("_slot", 33))
    sums = ordered.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    before = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), (F.sum("_sum").over(
        W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_sum")).alias("_start"))
    inside = F.sum("size").over(W.partitionBy("_part", "source").orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = ordered.withColumn("_in", inside).join(before, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    start = F.col("_start") + F.col("_in") - F.col("size")
    chosen = (start + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0) & (F.col("certain") < most)
    return joined.withColumn("copies", (F.col("certain") + chosen.cast("long")).cast("long")).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
