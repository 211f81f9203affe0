"""Packing documents into fixed-length sequences by minimum bin slack.

Documents become token ids and an end id; only longer ones than a sequence are cut. What is to be packed is then described by a histogram
with at most `capacity` lengths, so the plan is made from it alone: per bin the largest available length is the seed, and subset-sum
dynamic programming over the available lengths, the reachable sums being the bits of one integer, finds the fullest feasible
combination. It is removed as often as the counts allow, since the next bins would choose it again. Each combination uses up a length,
so the number of combinations is bounded by the capacity, not by the corpus.

Pieces find their place by rank among the pieces of their length. Ranks are row numbers within (length, salt) plus the counts of earlier
salts, so that a length which a third of all pieces have is spread over many tasks.

Cases: a null text is empty and has the end id only; repeated rows are documents of their own; an empty table gives an empty result;
very long texts give many pieces from one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.llm.common import cut, prepare, texts_in_blocks
from vectorloom.llm.tokens import VOCABULARY, tokenizer

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Pieces that one task numbers for one length.
GROUP_ROWS = 5_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document of `docs` (doc_id, text); with_ids adds the ids themselves."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut_texts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in texts_in_blocks(batch.column("text")):
                rows: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32", "ids")}
                for row, data in enumerate(words.encode([t.decode("utf-8", "replace") for t in texts])):
                    data += end
                    for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                        part = data[4 * start:4 * (start + capacity)]
                        for name, value in zip(rows, (first + row, piece, start, len(part) // 4, zlib.crc32(part), part), strict=True):
                            rows[name].append(value)
                columns = [ids.take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()),
                           pa.array(rows["length"], pa.int64()), pa.array(rows["ids_crc32"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows["ids"]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut_texts, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Multiplicities of the lengths with the largest sum of at most `room`; `available`: (length, count), longest first.

    Bit s of `reach` tells that some choice sums to s. Counts enter in powers of two; the search ends when `room` itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in available:
        left, part = min(count, room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << (part * length) & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= part * length
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination of lengths, number of bins): bins with the least slack first found, seeded by the largest remaining length."""
    left, plan = dict(sorted(((k, v) for k, v in histogram.items() if v), reverse=True)), []
    while left:
        seed = next(iter(left))
        rest = [(k, v - (k == seed)) for k, v in left.items() if v > (k == seed)]
        combination = fullest([x for x in rest if x[0] <= capacity - seed], capacity - seed)
        combination[seed] = combination.get(seed, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        plan.append((dict(sorted(combination.items(), reverse=True)), times))
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For ranges of ranks of each length: first rank, first sequence, how many a sequence holds, and their offset there."""
    rows, used, sequence = [], {}, 0
    for combination, times in plan:
        offset = 0
        for length, n in combination.items():
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
    return dict(zip(("length", "rank", "sequence", "n", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """All columns of `pieces` (length from 1 to capacity, `order` columns), with sequence_id and offset."""
    spark = pieces.sparkSession
    prepare(spark)
    rows = cut(pieces)
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max(1, -(-sum(histogram.values()) // GROUP_ROWS))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").count()
    before = counts.select("length", "_salt", (F.sum("count").over(
        W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("count")).alias("_before"))
    ranked = salted.withColumn("_row", F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order)) - 1).join(
        before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row"))
    places, names = spark.sparkContext.broadcast(_places(slack_plan(histogram, capacity))), pieces.columns

    def place(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        t = places.value
        keys = t["length"] << 44 | t["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            turn = rank - t["rank"][at]
            yield batch[names].assign(sequence_id=t["sequence"][at] + turn // t["n"][at],
                                               offset=t["offset"][at] + turn % t["n"][at] * length)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_rank").mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
                   with_ids: bool = False) -> DataFrame:
    return pack(token_pieces(docs, capacity, end_id, vocabulary, with_ids), capacity)
