"""Removal of every byte that a long repeated substring covers, by a distributed difference-cover suffix sort.

Two suffixes matter to each other only if their first `length` bytes are equal, so the suffixes are first dealt to cells in which all equal
ones meet, and runs of suffixes that need no sorting are settled on the way:

1. Deal. Of every REACH successive k-grams the one with the least hash is chosen. What a suffix chooses depends on its first `length` bytes
   only, so suffixes that agree in them choose alike. A chosen position owns a run of consecutive suffixes and is the key of its cell.
2. Settle. A run is named by a 128-bit hash of all bytes that decide about its suffixes. Runs are sorted by position and name and compared
   with their neighbours: equal names settle whole runs as repeated, a position without a second one settles its run as unique.
3. Sort. What remains are the runs in which a repeat begins or ends, with one settled run of each name that could match them. The bytes
   of a cell are one string whose suffixes are ranked by the difference cover modulo 3 (difference_cover.py): sampled triples are
   sorted and named, the names are sorted by recursion until they span `length` bytes, the other suffixes are merged, and the first
   `length` bytes of neighbours are compared.
4. Remove. The repeated starts of each document give the removed bytes in one scan of its text.

Rows that move are runs (one for about 60 bytes), never bytes or suffixes. Equal texts of one task send their runs twice at most. A sampled
position in very many unsettled runs is not put into one cell: its suffixes are counted by name over all tasks.

Cases: a null text is empty; texts shorter than `length` keep all bytes; matches never cross documents; repeated rows remove each other;
an empty table gives an empty result. The input must be a scan that gives the same rows in the same partitions when it is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.anchors import Substrings, window_picks
from vectorloom.llm.common import cut, gather_ranges, prepare, small_enough, texts_in_blocks
from vectorloom.llm.difference_cover import repeated_prefixes
from vectorloom.llm.shingles import mixed

#: Bytes of a repeat, of the k-grams that choose positions, and successive k-grams of which one is chosen.
LENGTH, GRAM, REACH = 200, 16, 150
#: Runs of one cell, and unsettled runs of one position from which its suffixes are counted by name.
CELL_RUNS, CROWD = 3000, 3000


def runs_of(data: np.ndarray, sizes: list[int], length: int) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, chosen, substrings, base) of the runs of concatenated texts: suffixes lo..hi (in `data`) choose one position."""
    reach = min(REACH, length - GRAM + 1)
    bounds = np.cumsum(sizes)
    hashes = Substrings(data)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, hashes, bounds
    at = np.arange(len(data) - GRAM + 1)
    keys = mixed((hashes.running[0][GRAM:] - hashes.running[0][:-GRAM]) * hashes.inverse[at])
    chosen = window_picks(keys, reach)
    starts = np.arange(len(chosen))
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(chosen)]
    inside = starts + length <= bounds[text]
    starts, chosen, text = starts[inside], chosen[inside], text[inside]
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))) if len(starts) else starts
    last = np.concatenate((first[1:], [len(starts)])) - 1 if len(starts) else first
    return text[first], starts[first], starts[last], chosen[first], hashes, bounds


def _rows(docs: DataFrame) -> DataFrame:
    """(row, text, kept): the scan's partition and place number the rows; kept holds the other columns, whose names cannot clash there."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"), others.alias("kept"))


def named_runs(rows: DataFrame, length: int) -> DataFrame:
    """(row, of, run, core, name1, name2, known): runs packed as lo << 18 | suffixes << 9 | offset; rows with `of` are copies of that row.

    known: 1 for a run whose name occurs again in its block of texts, 2 for those further occurrences, which are settled and get a
    place of their own in the shuffle, so that text that repeats itself thousands of times makes no hot position.
    """
    def name(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for first, texts in texts_in_blocks(batch.column("text")):
                numbers, copies, sent = ids[first:first + len(texts)], [], []
                for at, text in enumerate(texts):
                    if len(text) >= length:
                        held = seen.setdefault(xxhash.xxh3_128_digest(text), [int(numbers[at]), 0])
                        held[1] += 1
                        if held[1] > 1:
                            copies.append((int(numbers[at]), held[0]))
                        if held[1] <= 2:  # a second copy tells that all is repeated, further ones add nothing
                            sent.append((held[0], text))
                data = np.frombuffer(b"".join(t for _, t in sent), np.uint8)
                text, lo, hi, chosen, hashes, bounds = runs_of(data, [len(t) for _, t in sent], length)
                base = bounds[text] - np.array([len(t) for _, t in sent], np.int64)[text] if len(text) else text
                reach = min(REACH, length - GRAM + 1)
                owner = np.array([r for r, _ in sent], np.int64)[text] if len(text) else text
                run, core = (lo - base) << 18 | (hi - lo + 1) << 9 | (chosen - lo), hashes.hashes(chosen, chosen + length - reach + 1)
                one, two = hashes.hashes(lo, hi + length), hashes.hashes(lo, hi + length, 1)
                # equal names of a block settle each other here; only the first of them is compared with other blocks
                order = np.lexsort((two, one))
                again = np.concatenate(([False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])))[:len(order)]
                known = np.zeros(len(order), np.int32)
                known[order] = np.where(again, 2, np.append(again[1:], False).astype(np.int32)) if len(order) else known
                apart = mixed((owner * 0x9E3779B1 ^ run).astype(np.uint64)).view(np.int64)
                extra = np.full(len(copies), -1, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((owner, np.array([c for c, _ in copies], np.int64)))),
                    pa.array([None] * len(owner) + [o for _, o in copies], pa.int64()),
                    pa.array(np.concatenate((run, extra))), pa.array(np.concatenate((np.where(known == 2, apart, core), extra))),
                    pa.array(np.concatenate((one, extra))), pa.array(np.concatenate((two, extra))),
                    pa.array(np.concatenate((known, extra.astype(np.int32))))],
                    names=["row", "of", "run", "core", "name1", "name2", "known"])

    return rows.select("row", "text").mapInArrow(name, "row long, of long, run long, core long, name1 long, name2 long, known int")


def settle(runs: DataFrame) -> DataFrame:
    """(row, runs): of each row its runs that may be repeated, with state run << 2 | s: 0 open, 1 repeated, 2 repeated and asked as a witness."""
    order = W.partitionBy("core").orderBy("name1", "name2")
    same = lambda step: (step("name1").over(order) == F.col("name1")) & (step("name2").over(order) == F.col("name2"))
    compared = runs.select("row", "run", "core", "name1", "name2", "known").withColumns({
        "before": F.coalesce(same(F.lag), F.lit(False)), "after": F.coalesce(same(F.lead), F.lit(False)),
        "alone": F.lag("row").over(order).isNull() & F.lead("row").over(order).isNull() & (F.col("known") == 0)})
    repeated = F.col("before") | F.col("after") | (F.col("known") > 0)
    kept = compared.filter("not alone").withColumn("open", F.max((~repeated).cast("int")).over(W.partitionBy("core")) == 1)
    state = F.when(~repeated, 0).when(F.col("open") & ~F.col("before") & (F.col("known") < 2), 2).otherwise(1)
    packed = kept.select("row", (F.shiftleft("run", 2) + state).alias("run"))
    return packed.groupBy("row").agg(F.sort_array(F.collect_set("run")).alias("runs"))  # the runs of one text


def _near(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts whose row is in `asked` (row distinct, ...), joined with it; only those texts are shuffled if the rows fit a broadcast."""
    if small_enough(asked.select("row"), 16):
        texts = texts.join(F.broadcast(asked.select("row")), "row", "left_semi")
    return texts.join(asked, "row")


def open_suffixes(texts: DataFrame, settled: DataFrame, length: int) -> DataFrame:
    """(core, row, lo, n, part): the bytes of open runs and their witnesses."""
    asked = settled.select("row", F.filter("runs", lambda r: F.pmod(r, F.lit(4)) != 1).alias("runs")).filter(F.size("runs") > 0)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        reach = min(REACH, length - GRAM + 1)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("core", "row", "lo", "n", "part")}
            for row, text, runs in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs"), strict=True):
                runs = runs.values.to_numpy()
                lo, n, offset = runs >> 20, runs >> 11 & 511, runs >> 2 & 511
                hashes = Substrings(np.frombuffer(text, np.uint8))
                out["core"] += hashes.hashes(lo + offset, lo + offset + length - reach + 1).tolist()
                out["row"] += [row] * len(runs)
                # a witness only lends its suffixes: it is known to be repeated
                out["lo"] += np.where(runs & 3 == 2, -1, lo).tolist()
                out["n"] += n.tolist()
                out["part"] += [text[a:a + m + length - 1] for a, m in zip(lo.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "part" else pa.int64()) for k, v in out.items()], names=list(out))

    return _near(texts, asked).select("row", "text", "runs").mapInArrow(extract, "core long, row long, lo long, n long, part binary")


def _suffixes(frame: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the frame, place in the run, two hashes of the first `length` bytes) of every suffix of the runs of a frame."""
    sizes = np.array([len(p) for p in frame["part"]])
    hashes = Substrings(np.frombuffer(b"".join(frame["part"]), np.uint8))
    n = frame["n"].to_numpy(np.int64)
    starts = gather_ranges(np.cumsum(sizes) - sizes, n)
    run = np.repeat(np.arange(len(frame)), n)
    return run, gather_ranges(np.zeros(len(n), np.int64), n), hashes.hashes(starts, starts + length), hashes.hashes(starts, starts + length, 1)


def merged(opened: DataFrame, length: int) -> DataFrame:
    """(row, start, n): stretches of repeated suffixes in open runs."""
    crowded = cut(opened.groupBy("core").count().filter(F.col("count") > CROWD).select("core"))
    total = opened.count()
    cells = max(1, total // CELL_RUNS)

    def stretches(rows: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((starts, rows))
        rows, starts = rows[order], starts[order]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(rows) else rows
        return pd.DataFrame({"row": rows[first], "start": starts[first], "n": np.diff(np.append(first, len(rows)))})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["n"].to_numpy(np.int64)
        sizes = np.array([len(p) for p in frame["part"]])
        starts, place = gather_ranges(np.cumsum(sizes) - sizes, n), gather_ranges(np.zeros(len(n), np.int64), n)
        hit = repeated_prefixes(np.frombuffer(b"".join(frame["part"]), np.uint8), starts, length)
        run = np.repeat(np.arange(len(frame)), n)
        lo = frame["lo"].to_numpy(np.int64)[run]
        hit &= lo >= 0
        return stretches(frame["row"].to_numpy(np.int64)[run[hit]], lo[hit] + place[hit])

    def spread(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                frame = batch.iloc[first:first + 512]
                run, place, a, b = _suffixes(frame, length)
                lo = frame["lo"].to_numpy(np.int64)[run]
                yield pd.DataFrame({"a": a, "b": b, "row": frame["row"].to_numpy(np.int64)[run], "start": np.where(lo < 0, -1, lo + place)})

    usual = opened.join(F.broadcast(crowded) if small_enough(crowded, 16) else crowded, "core", "left_anti")
    found = usual.groupBy(F.pmod(F.xxhash64("core"), F.lit(cells)).alias("cell")).applyInPandas(
        lambda frame: compare(frame), "row long, start long, n long")
    if crowded.isEmpty():
        return found
    suffixes = cut(opened.join(crowded, "core", "left_semi").mapInPandas(spread, "a long, b long, row long, start long"))
    twice = suffixes.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").select("a", "b")
    hits = suffixes.filter("start >= 0").join(twice, ["a", "b"], "left_semi").select("row", "start", F.lit(1).cast("long").alias("n"))
    return found.unionByName(hits)


def removed_spans(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of bytes covered by `length` bytes from each of `counts` successive starts."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + counts + length - 1)[order])
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The numbered rows of `docs` (row, text, kept), and (row, starts, counts): stretches of repeated starts of the rows that have any."""
    prepare(docs.sparkSession)
    if length < GRAM + 1:
        raise ValueError(f"repeats have more than {GRAM} bytes")
    rows = _rows(docs)
    runs = named_runs(rows, length)
    settled = cut(settle(runs.filter("of is null")))
    found = cut(merged(cut(open_suffixes(rows, settled, length)), length))
    own = settled.select("row", F.explode(F.filter("runs", lambda r: F.pmod(r, F.lit(4)) != 0)).alias("r")).select(
        "row", F.shiftright("r", 20).alias("start"), F.shiftright("r", 11).bitwiseAND(F.lit(511)).cast("long").alias("n"))
    gathered = own.unionByName(found).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("s"))  # of one text
    spans = cut(gathered.select("row", F.col("s.start").alias("starts"), F.col("s.n").alias("counts")))
    copies = _copies(rows, length)
    return rows, cut(spans.unionByName(copies.join(spans.withColumnRenamed("row", "of"), "of").select("row", "starts", "counts")))


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """(row, of): rows with a text that their scan partition had before, as `named_runs` finds them."""
    def find(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                raw = text.as_buffer()
                if raw.size >= length:
                    of = seen.setdefault(xxhash.xxh3_128_digest(raw), row)
                    if of != row:
                        out.append((row, of))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([o for _, o in out], pa.int64())], names=["row", "of"])

    return rows.select("row", "text").mapInArrow(find, "row long, of long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of `docs`, the text without its repeats, and n_bytes, n_removed, n_spans and kept_sha256.

    kept_sha256 is of the remaining bytes; a character that a removal has cut in two is left out of the text.
    """
    rows, spans = repeated_spans(docs, length)
    found = ("n_bytes", "n_removed", "n_spans")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*found, "kept_sha256", "text")}
            for text, starts, counts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts"), batch.column("counts"), strict=True):
                left, n_spans = text, 0
                if starts.is_valid and len(starts):
                    begin, end = removed_spans(starts.values.to_numpy(), counts.values.to_numpy(), length)
                    n_spans = len(begin)
                    left = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True))
                row = (len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *[pa.array(out[k], pa.int64()) for k in found],
                                              pa.array(out["kept_sha256"], pa.string()), pa.array(out["text"], pa.string())],
                                             names=["kept", *found, "kept_sha256", "text"])

    schema = T.StructType([rows.schema["kept"], *[T.StructField(k, T.LongType()) for k in found],
                           T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())])
    if small_enough(spans.select("row"), 16):
        ids = F.broadcast(spans.select("row"))
        none = F.lit(None).cast("array<long>")
        whole = rows.join(ids, "row", "left_anti").withColumns({"starts": none, "counts": none})
        joined = rows.join(ids, "row", "left_semi").join(spans, "row").select(*whole.columns)
        done = whole.mapInArrow(finish, schema).unionByName(joined.mapInArrow(finish, schema))
    else:
        done = rows.join(spans, "row", "left").mapInArrow(finish, schema)
    return done.select(*[F.col("text") if c == "text" else F.col(f"kept.`{c}`") for c in docs.columns], *found, "kept_sha256")
