"""Token counts of the documents in flat token files without an index.

A token file is nothing but ids of a fixed width, each document ended by one separator id. The files are listed with their lengths, byte
ranges of one block each are dealt to tasks, and a task reads its ranges only, so that a file may be of any length. Inside a
block one vectorised comparison finds the separators. Documents run across blocks: each block reports its separators, and the tokens
before its first and after its last one; a prefix scan over the blocks of a file (running numbers of separators, running tokens since
the last separator) gives every document its number and the tokens that it has in earlier blocks. Blocks are rows, so that the scan
sees one row per block.

Ranges are read through pyarrow's file systems (local, S3, GCS, HDFS, ABFS). Files in a store that only Spark's readers can open are
read by Spark as wholes, up to Spark's 2 GB a file.

Cases: an empty file has no documents; two separators in a row end a document of 0 tokens; tokens after the last separator are a
document that is not ended (`ended` is false); a trailing part of a token is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.llm.common import prepare, texts_in_blocks
from vectorloom.llm.tokens import VOCABULARY, tokenizer

#: Bytes of a token, its separator, tokens of a block, and documents of a file that `write_token_files` makes.
WIDTH, SEPARATOR, BLOCK_TOKENS, FILE_DOCS = 2, 0, 1 << 18, 2000
#: Bytes of the ranges of a task.
TASK_BYTES = 4 << 20


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_docs: int = FILE_DOCS) -> None:
    """Flat files of 16-bit ids under `path`: id + 1 of every token, separator 0 after every document.

    Spark's text sink writes them, as it puts a column's bytes down as they are and ends each row by a line separator of one's choice:
    here the two zero bytes of the separator id. So any file system that Spark reaches will do.
    """
    prepare(docs.sparkSession)

    def as_bytes(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        for batch in batches:
            for _, texts in texts_in_blocks(batch.column("text")):
                ids = [(np.frombuffer(x, "<u4") + 1).astype("<u2").tobytes() for x in words.encode([t.decode("utf-8", "replace") for t in texts])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["tokens"])

    rows = docs.select("text").mapInArrow(as_bytes, "tokens binary").select(F.col("tokens").cast("string").alias("value"))
    rows.write.option("lineSep", "\0" * WIDTH).option("maxRecordsPerFile", file_docs).text(path)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + quote(rest, safe="/:@"))


def _seekable(path: str) -> bool:
    try:
        system, name = located(path)
        return system.get_file_info(name).type == fs.FileType.File
    except (OSError, ValueError, NotImplementedError):
        return False


def report(tokens: np.ndarray, separator: int) -> tuple[int, int, int, int, list[int]]:
    """(n_separators, n_tokens, head, tail, inner) of a block."""
    at = np.flatnonzero(tokens == separator)
    head, tail = (int(at[0]), int(len(tokens) - at[-1] - 1)) if len(at) else (len(tokens), len(tokens))
    return len(at), len(tokens), head, tail, (np.diff(at) - 1).tolist()


def scan_blocks(spark: SparkSession, path: str, width: int = WIDTH, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n_separators, n_tokens, head, tail, inner): inner holds the token counts between separators of one block."""
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", "length").filter("length > 0")  # without `content` nothing is read, and a file may be of any length
    names = ("file", "block", "n_separators", "n_tokens", "head", "tail", "inner")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    schema = "file string, block long, n_separators long, n_tokens long, head long, tail long, inner array<long>"
    block_bytes = block_tokens * width

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    def whole(file: str, length: int) -> None:
        if length % width:
            raise ValueError(f"{file}: not a whole number of tokens")

    def scan_ranges(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ranges: dict[str, list[tuple[int, int]]] = {}
            for row in batch.to_pylist():
                whole(row["path"], row["length"])
                ranges.setdefault(row["path"], []).append((row["block"], min(block_bytes, row["length"] - row["block"] * block_bytes)))
            for file, blocks in ranges.items():
                system, name = located(file)
                with system.open_input_file(name) as source:
                    for block, n in sorted(blocks):
                        data = source.read_at(n, block * block_bytes)
                        if len(data) != n:
                            raise OSError(f"{file}: block {block} has {len(data)} bytes of {n}")
                        yield as_batch([(file, block, *report(np.frombuffer(data, f"<u{width}"), separator))])

    def scan_files(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                whole(file, len(data))
                tokens = np.frombuffer(data, f"<u{width}")
                if len(tokens):
                    yield as_batch([(file, block, *report(tokens[first:first + block_tokens], separator))
                                    for block, first in enumerate(range(0, len(tokens), block_tokens))])

    size, some = listed.agg(F.sum("length"), F.min("path")).first()
    if some is not None and not _seekable(some):
        return files.select("path", "content").mapInArrow(scan_files, schema)
    blocks = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    return blocks.repartition(max(1, -(-(size or 0) // TASK_BYTES)), "path", "block").mapInArrow(scan_ranges, schema)


def stitch(blocks: DataFrame) -> DataFrame:
    """(file, doc, n_tokens, ended) from the blocks' reports.

    Tokens since the last separator before a block are a difference of two running sums: all tokens so far, and all tokens up to the
    last block that has a separator, less that block's tail.
    """
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scanned = blocks.withColumns({
        "first_doc": F.coalesce(F.sum("n_separators").over(earlier), F.lit(0)), "so_far": F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))})
    ended_at = F.when(F.col("n_separators") > 0, F.col("so_far") + F.col("n_tokens") - F.col("tail"))
    carried = scanned.withColumn("ended_at", ended_at).withColumn(
        "carry", F.col("so_far") - F.coalesce(F.last("ended_at", ignorenulls=True).over(earlier), F.lit(0)))
    whole = carried.filter("n_separators > 0").select(
        "file", "first_doc", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("i", "n_tokens"))
    ends = whole.select("file", (F.col("first_doc") + F.col("i")).alias("doc"), "n_tokens", F.lit(True).alias("ended"))
    open_ends = carried.groupBy("file").agg(F.sum("n_separators").alias("doc"), (F.sum("n_tokens") - F.coalesce(F.max("ended_at"), F.lit(0))).alias("n_tokens"))
    return ends.unionByName(open_ends.filter("n_tokens > 0").withColumn("ended", F.lit(False)))


def token_counts(spark: SparkSession, path: str, width: int = WIDTH, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    return stitch(scan_blocks(spark, path, width, separator, block_tokens))
