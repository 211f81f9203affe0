"""Quality rules with thresholds that adapt to each language and source.

One scan turns each text into integer signals. KLL quantile sketches of the signals are built per (language, source), with
map-side partial sketches, so that a source with a third of all rows is as cheap as a small one. Sketches merge: a group with few
documents takes the sketch of its language, a language with few documents the sketch of the corpus. The fences read from the
sketches are joined back and decide. All of it is DataFrame functions.

Cases: a null text has no words and fails the base rules; null language or source is a group of its own; repeated rows are judged
each for itself; an empty table gives an empty result. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import SPACE, cut, small_enough, text_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, and the largest percentage of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Items of a sketch's largest level; the rank error falls as about 2 / K.
SKETCH_K = 2048
#: A group with fewer documents takes the sketch of the next wider group.
MIN_GROUP = 200


@dataclass(frozen=True)
class Fence:
    """A document leaves if its signal is over q(0.75) + max(spread * (q(0.75) - q(0.25)), slack), or, for side "both", under the
    mirror image. `slack` keeps groups whose documents hardly differ from losing normal ones."""

    signal: str
    side: str
    spread: int
    slack: int


#: Signals are in thousandths; the slack is the smallest distance that people would call unusual.
FENCES = (Fence("mean_length", "both", 6, 700), Fence("symbol_share", "high", 6, 100), Fence("line_share", "high", 6, 500),
          Fence("repeat_share", "high", 6, 250))


def signals(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long) of each row.

    Windows of eight words are hashed in their row. Most texts have no equal windows and end there; in the others the hashes are
    sorted with their positions, neighbours of equal hash give the repeated positions, and sorted positions give the words covered.
    """
    text = text_of(F.col("text"))
    narrow = docs.select(*keep, text.alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = narrow.select(*keep, words.alias("words"), lines.alias("lines"),
                          F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                          (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counted = first.select(
        *keep, "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ranked = counted.withColumn("windows", F.when(twice, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i")))
    beside = F.arrays_zip(F.col("windows").alias("at"), F.concat(none, "windows").alias("before"),
                          F.concat(F.slice("windows", 2, F.size("windows")), none).alias("after"))
    positions = F.sort_array(F.transform(
        F.filter(beside, lambda x: (x["at"]["h"] == x["before"]["h"]) | (x["at"]["h"] == x["after"]["h"])), lambda x: x["at"]["i"]))
    placed = ranked.withColumn("windows", F.when(F.col("windows").isNotNull(), positions))
    following = F.concat(F.slice("windows", 2, F.size("windows")), F.array(F.lit(None).cast("int")))
    covered = F.aggregate(F.zip_with("windows", following, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
                          F.lit(0), lambda total, x: total + x)
    repeated = F.when(F.size("windows") > 0, covered).otherwise(0).cast("long")
    return placed.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def shares(df: DataFrame) -> DataFrame:
    """The signals that the fences judge, in whole thousandths."""
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1)))
    return df.withColumns({"mean_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"),
                           "line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")})


def thresholds(scored: DataFrame, fences: tuple[Fence, ...] = FENCES, k: int = SKETCH_K, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <signal>_low, <signal>_high): the fences of each group of `scored`, from merged quantile sketches."""
    names = [f.signal for f in fences]
    own = cut(scored.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_bigint(s, k).alias(s) for s in names]))
    wider = lambda keys, tag: own.groupBy(*keys).agg(
        F.sum("n").alias(f"{tag}_n"), *[F.kll_merge_agg_bigint(s, k).alias(f"{tag}_{s}") for s in names])
    joined = own.withColumnRenamed("lang", "own_lang").join(wider(["lang"], "l"), F.col("own_lang").eqNullSafe(F.col("lang"))).drop("lang")
    joined = joined.join(F.broadcast(wider([], "a")))  # one row
    out = joined.select(F.col("own_lang").alias("lang"), "source", *[
        F.when(F.col("n") >= min_group, F.col(s)).when(F.col("l_n") >= min_group, F.col(f"l_{s}")).otherwise(F.col(f"a_{s}")).alias(s)
        for s in names])
    quartile = lambda s, q: F.kll_sketch_get_quantile_bigint(s, F.lit(q))
    for f in fences:
        low, high = quartile(f.signal, 0.25), quartile(f.signal, 0.75)
        reach = F.greatest((high - low) * f.spread, F.lit(f.slack))
        out = out.withColumns({f"{f.signal}_high": high + reach, f"{f.signal}_low": (low - reach) if f.side == "both" else F.lit(None).cast("long")})
    return out.drop(*names)


def quality_filter(docs: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """The signals of every document with base_failed and kept; thresholds come from all documents that pass the base rules."""
    scored = cut(shares(signals(docs)).withColumn("base_failed", base_failed()))
    limits = thresholds(scored.filter(~F.col("base_failed")), fences).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if small_enough(limits, 256):
        limits = F.broadcast(limits)
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = ~F.col("base_failed")
    for f in fences:
        inside &= F.col(f.signal) <= F.coalesce(F.col(f"{f.signal}_high"), F.col(f.signal))
        inside &= F.col(f.signal) >= F.coalesce(F.col(f"{f.signal}_low"), F.col(f.signal))
    return joined.withColumn("kept", inside).drop("_lang", "_source")
