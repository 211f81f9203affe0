"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.runtime import cut, ensure_checkpoint_dir, ship_package

__all__ = ["cut", "ensure_checkpoint_dir", "prepare", "held_out", "text_of", "WORD", "SPACE", "texts_in_blocks", "encoded", "small_enough",
           "with_mark", "marked"]

#: Words and what separates them, as the contracts of the queries define them (ASCII blanks only).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of one Arrow batch: texts reach 100 KB and more, so that a batch of the default 10,000 rows could fill a worker.
BATCH_BYTES = 8 << 20

#: Texts that one vectorised step takes together, in bytes (a longer text is a step of its own).
BLOCK_BYTES = 1 << 20

#: Bytes that a table may have to be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

#: Places of a bitmap of hashes for each value: a sixteenth of the other values passes it.
MARKS = 16


def prepare(spark: SparkSession) -> None:
    """Executors get the package, batches of long texts stay small, checkpoints have their shared folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) != f"{BATCH_BYTES}b":
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from: crc32 of the id's text mod 5 is 0 (null: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def texts_in_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of successive runs of rows with about `limit` bytes; null counts as empty."""
    block, size, start = [], 0, 0
    for row, text in enumerate(column.cast(pa.large_binary())):
        value = text.as_py() or b""
        if block and size + len(value) > limit:
            yield start, block
            block, size, start = [], 0, row
        block.append(value)
        size += len(value)
    if block:
        yield start, block


def encoded(batches: Iterable[pa.RecordBatch], columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if `df`, of rows of at most `row_bytes`, may be broadcast; counts no further than the limit."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def with_mark(df: DataFrame, place: Column, marks: DataFrame, name: str, how: str = "left") -> DataFrame:
    """`df` with `name`: whether its `place` is one of marks.place. The marks travel as bitmaps of 32768 places (4 KB) each."""
    own = "_" * (1 + max(map(len, df.columns)))  # names that no column of `df` has
    bits = marks.groupBy(F.bitmap_bucket_number("place").alias(own + "n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(own))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(own, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col(own + "n"), how)
    return found.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(own, own + "n")


def marked(df: DataFrame, place: Column, marks: DataFrame) -> DataFrame:
    """The rows of `df` whose `place` is one of marks.place."""
    return with_mark(df, place, marks, "_marked", "inner").filter("_marked").drop("_marked")
