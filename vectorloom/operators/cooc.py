"""Context windows, n-way co-occurrence counts and (P)PMI tensors in coordinate form.

Indices of a tensor row ascend (i < j < k < l); `symmetrize` writes out the permutations when they are wanted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.runtime import broadcast_if_small, cut, dense_ids, draw48, fits

MODES = ["i", "j", "k", "l"]
#: Rows (a word or an id with a number) of a table that goes to every task; it is bounded by bytes too (`runtime.fits`).
LOOKUP_ROWS = 1 << 20
#: About so many combinations of ids leave a task at a time.
COMBINED_ROWS = 1 << 16


def to_ids(docs: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, ids): each document as its known tokens' ids in text order; documents without a known token go.

    A vocabulary that is counted below the bound is looked up beside the texts, so that no occurrence becomes a row. A larger one is joined.
    """
    v = vocab.select("token", "term_id")
    if not fits(v, LOOKUP_ROWS):
        occurrences = docs.select(doc_id, F.posexplode(tokens).alias("pos", "token")).join(v, "token")
        ordered = F.sort_array(F.collect_list(F.struct("pos", "term_id")))
        return occurrences.groupBy(doc_id).agg(ordered.alias("_o")).select(doc_id, F.col("_o.term_id").alias("ids"))
    known = v.toArrow()  # counted above
    shared = docs.sparkSession.sparkContext.broadcast((known["token"].combine_chunks().cast(pa.string()), known["term_id"].to_numpy()))
    kind, number = docs.schema[doc_id].dataType.simpleString(), v.schema["term_id"].dataType.simpleString()

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words, ids = shared.value
        for batch in batches:
            lists = batch.column(1)
            at = pc.index_in(lists.flatten().cast(pa.string()), value_set=words)
            found = at.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(found)))[ends].astype(np.int32)
            values = ids[at.drop_null().to_numpy(zero_copy_only=False)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[doc_id, "ids"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return docs.select(doc_id, tokens).mapInArrow(look_up, f"{doc_id} {kind}, ids array<{number}>")


# ---------------------------------------------------------------- windows
def context_windows(docs: DataFrame, window: int, fixed_size: bool = True, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, target, context[]); with fixed_size only positions with a full window on both sides."""
    a, n = F.col(ids), F.size(ids)
    first, last = (F.lit(window), n - window - 1) if fixed_size else (F.lit(0), n - 1)
    at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def one(p: Column) -> Column:
        lo = F.greatest(p - window, F.lit(0))
        return F.struct(p.alias("pos"), F.get(a, p).alias("target"),
                        F.concat(F.slice(a, lo + 1, p - lo), F.slice(a, p + 2, F.lit(window))).alias("context"))

    return docs.select(doc_id, F.explode(F.transform(at, one)).alias("_w")).select(doc_id, "_w.*")


def chunk_sentences(docs: DataFrame, window: int, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """Consecutive non-overlapping chunks of 2*window+1 ids; a shorter tail is kept."""
    step, n = 2 * window + 1, F.size(ids)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s: F.slice(ids, s + 1, F.lit(step)))
    return docs.select(doc_id, F.posexplode(parts).alias("chunk", "ids"))


def skipgram_pairs(docs: DataFrame, window: int, seed: int = 1, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(target, context) rows with a window shrunk per position by a hash of (document, position, seed)."""
    a, n = F.col(ids), F.size(ids)

    def drawn(p: Column) -> Column:  # once a position: the draw is used three times below
        return F.struct(p.alias("pos"), (F.lit(window) - F.pmod(draw48(doc_id, p, seed=seed), F.lit(window)).cast("int")).alias("reach"))

    def near(s: Column) -> Column:
        p, reach = s["pos"], s["reach"]
        lo = F.greatest(p - reach, F.lit(0))
        around = F.concat(F.slice(a, lo + 1, p - lo), F.slice(a, p + 2, reach))
        return F.transform(around, lambda c: F.struct(p.alias("pos"), F.get(a, p).alias("target"), c.alias("context")))

    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return docs.select(doc_id, F.explode(F.flatten(F.transform(F.transform(at, drawn), near))).alias("_p")).select(doc_id, "_p.*")


def count_with_context(windows: DataFrame, n: int = 2) -> DataFrame:
    """Ordered counts (target, context) or (target, context, context'), the second including equal positions."""
    if n == 2:
        rows = windows.select(F.col("target").alias("i"), F.explode("context").alias("j"))
        return rows.groupBy("i", "j").agg(F.count("*").alias("count"))
    # The count of (i, j, k) is that of (i, k, j): only j <= k is exchanged, two places with one id count twice, each place once with itself.
    entry = lambda x, y, n: F.struct(x.alias("j"), y.alias("k"), n.cast("long").alias("n"))
    pairs = F.flatten(F.transform(F.sort_array("context"), lambda x, p: F.concat(F.array(entry(x, x, F.lit(1))), F.transform(
        F.slice(F.sort_array("context"), p + 2, F.greatest(F.size("context") - p - 1, F.lit(0))),
        lambda y: entry(x, y, F.when(x == y, 2).otherwise(1))))))  # one window: (2*window)*(2*window+1)/2 entries at most
    rows = windows.select(F.col("target").alias("i"), F.explode(pairs).alias("_c")).select("i", "_c.*")
    counts = rows.groupBy("i", "j", "k").agg(F.sum("n").alias("count"))
    both = F.when(F.col("j") < F.col("k"), F.array(F.struct("j", "k"), F.struct(F.col("k").alias("j"), F.col("j").alias("k")))).otherwise(
        F.array(F.struct("j", "k")))
    return counts.select("i", F.explode(both).alias("_c"), "count").select("i", "_c.j", "_c.k", "count")


# ---------------------------------------------------------------- n-gram counts
def _ascending(s: Column, n: int, chosen: tuple = ()) -> Column:
    """All ascending n-combinations of a sorted array as structs (nested array functions, no rows)."""
    if len(chosen) == n - 1:
        return F.transform(s, lambda x: F.struct(*[c.alias(m) for c, m in zip((*chosen, x), MODES)]))
    return F.flatten(F.transform(
        s, lambda x, p: _ascending(F.slice(s, p + 2, F.greatest(F.size(s) - p - 1, F.lit(0))), n, (*chosen, x))))


def distinct_chunks(chunks: DataFrame, n: int, ids: str = "ids") -> DataFrame:
    return chunks.withColumn("_s", F.sort_array(F.array_distinct(F.col(ids)))).filter(F.size("_s") >= n)


def ngram_cooccurrence(chunks: DataFrame, n: int = 2, ids: str = "ids") -> DataFrame:
    """Counts of ascending n-combinations of the distinct ids of each chunk; chunks with fewer are skipped.

    A chunk has at most 2*window+1 ids, so its combinations are bounded. Equal chunks, which copies of a text give, are counted before
    they are taken apart; equal combinations are merged before the shuffle.
    """
    sets = distinct_chunks(chunks, n, ids).groupBy("_s").agg(F.count("*").alias("_c"))
    kind = sets.schema["_s"].dataType.elementType.simpleString()
    rows = sets.mapInArrow(_combinations(n), ", ".join([*(f"{m} {kind}" for m in MODES[:n]), "_c long"]))
    return rows.groupBy(*MODES[:n]).agg(F.sum("_c").alias("count"))


def _combinations(n: int):
    """Arrow batches (sorted set, count) -> a row for each ascending n-combination; sets of one size are taken apart together."""
    def combine(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sets, counts = batch.column(0), batch.column(1).to_numpy()
            ids, sizes = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                chosen, places = np.flatnonzero(sizes == size), np.array(list(itertools.combinations(range(size), n)))
                for part in np.array_split(chosen, -(-len(chosen) * len(places) // COMBINED_ROWS)):
                    found = ids[starts[part][:, None, None] + places].reshape(-1, n)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found.T), pa.array(np.repeat(counts[part], len(places)))], names=[*MODES[:n], "_c"])

    return combine


def chunk_unigrams(chunks: DataFrame, n: int = 2, ids: str = "ids") -> DataFrame:
    """Per id, the number of accepted chunks holding it; the grand total of these counts is |D|."""
    rows = distinct_chunks(chunks, n, ids).select(F.explode("_s").alias("term_id"))
    return rows.groupBy("term_id").agg(F.count("*").alias("count"))


def prune_ngrams(counts: DataFrame, min_count: int = 1) -> DataFrame:
    return counts.filter(F.col("count") > min_count)


def _modes(df: DataFrame) -> list[str]:
    return [m for m in MODES if m in df.columns]


def pmi(counts: DataFrame, unigrams: DataFrame, valid_above: int = 5) -> DataFrame:
    """log2 #(x..) + (n-1) log2 |D| - sum log2 #(x_i); 0 where the tuple count is not above `valid_above`."""
    modes = _modes(counts)
    unigrams = cut(unigrams)  # read once a mode
    out = counts.join(F.broadcast(unigrams.agg(F.sum("count").alias("_d"))))  # one row
    unigrams = broadcast_if_small(unigrams, LOOKUP_ROWS)  # a row an id: the counts then stay where they are
    value = F.log2(F.col("count").cast("double")) + (len(modes) - 1) * F.log2(F.col("_d").cast("double"))
    for m in modes:
        out = out.join(unigrams.select(F.col("term_id").alias(m), F.log2(F.col("count").cast("double")).alias(f"_u{m}")), m)
        value = value - F.col(f"_u{m}")
    return out.select(*modes, "count", F.when(F.col("count") > valid_above, value).otherwise(0.0).alias("value"))


def ppmi_tensor(counts: DataFrame, unigrams: DataFrame, positive: bool = True, shift: float = 0.0,
                use_pmi: bool = True, valid_above: int = 5) -> DataFrame:
    """Shifted (positive) PMI, or plain counts, in coordinate form."""
    modes = _modes(counts)
    if use_pmi and positive and shift <= 0:  # rarer tuples have value 0 before the shift
        counts = counts.filter(F.col("count") > valid_above)
    base = pmi(counts, unigrams, valid_above) if use_pmi else counts.withColumn("value", F.col("count").cast("double"))
    out = base.select(*modes, (F.col("value") + shift).alias("value"))
    return out.filter("value > 0") if positive else out


def limit_large_vals(tensor: DataFrame, frequent: int = 15) -> DataFrame:
    """Drop tuples with two or more of the most frequent ids."""
    hits = sum((F.col(m) < frequent).cast("int") for m in _modes(tensor))
    return tensor.filter(hits <= 1)


def add_zero_samples(tensor: DataFrame, counts: DataFrame, vocab_size: int, share: float, seed: int = 1) -> DataFrame:
    """Of share * nnz drawn sorted tuples the distinct ones that repeat no index and were never counted, with value 0."""
    modes = _modes(tensor)
    draws = int(share * tensor.count())
    picks = F.sort_array(F.array(*[
        F.pmod(draw48("id", F.lit(m), seed=seed), F.lit(vocab_size)) for m in range(len(modes))]))
    drawn = tensor.sparkSession.range(draws).select(picks.alias("_p")).select(
        *[F.get("_p", F.lit(n)).alias(m) for n, m in enumerate(modes)]).distinct()
    for a, b in zip(modes, modes[1:]):
        drawn = drawn.filter(F.col(a) < F.col(b))
    absent = drawn.join(counts.select(*modes), modes, "left_anti").withColumn("value", F.lit(0.0))
    return tensor.select(*modes, "value").unionByName(absent)


def symmetrize(tensor: DataFrame) -> DataFrame:
    """All permutations of every index tuple."""
    modes = _modes(tensor)
    orders = F.array(*[F.struct(*[F.col(c).alias(m) for m, c in zip(modes, p)]) for p in itertools.permutations(modes)])
    return tensor.select(F.explode(orders).alias("_t"), "value").select("_t.*", "value")


def top_tuples(tensor: DataFrame, vocab: DataFrame, k: int, value: str = "value", digits: int = 6) -> DataFrame:
    """The k largest entries with their words."""
    modes = _modes(tensor)
    best = (tensor.withColumn(value, F.round(value, digits))
            .orderBy(F.col(value).desc(), *modes).limit(k))
    for m in modes:
        best = best.join(vocab.select(F.col("term_id").alias(m), F.col("token").alias(f"word_{m}")), m)
    return best.select(*[f"word_{m}" for m in modes], value)


def batch_slice(tensor: DataFrame, batch_chunks: DataFrame, ids: str = "ids") -> DataFrame:
    """Entries whose tuple occurs in the given chunks."""
    modes = _modes(tensor)
    seen = distinct_chunks(batch_chunks, len(modes), ids).select(
        F.explode(_ascending(F.col("_s"), len(modes))).alias("_t")).select("_t.*").distinct()
    return tensor.join(seen, modes, "left_semi")


def vocab_for(counts: DataFrame, min_count: int) -> DataFrame:
    """Ids by descending count for words above a minimum count."""
    return dense_ids(counts.filter(F.col("count") >= min_count), [F.col("count").desc(), F.col("token").asc()], "term_id")


