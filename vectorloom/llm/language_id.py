"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of a letter trigram binds the permuted vectors of its letters,
rotate(a, 2) * rotate(b, 1) * c; a text's vector bundles (adds) the vectors of all its trigrams, and a language's prototype bundles the
vectors of its training documents, each of one length, so that no document outweighs the others. A document gets the language whose prototype has the largest cosine with it; the cosine is its score.

Texts are lower-cased and every run of other characters than letters is one boundary. Trigrams are counted per text, so that bundling
is one matrix product of counts and trigram vectors per block of texts. Prototypes are integer sums: tasks add up what they read, one
aggregate adds up the tasks, and (languages x dims) numbers reach the driver.

Cases: a null text or one without letters is `und` with score 0; null languages teach nothing; equal cosines go to the language that
is first by code point; without training rows everything is `und`; one very long text is a block of its own; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.common import held_out, prepare, texts_in_blocks

#: Dimensions of the vectors, and the most languages that a model may have (the prototypes are held by every task).
DIMS, MAX_LANGUAGES = 1024, 2000
#: Length of a training document's vector, in whole numbers so that sums do not depend on their order.
ONE = 1 << 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=100_000)
def letter_vector(code: int, dims: int) -> np.ndarray:
    """The +1/-1 vector of a code point (0: a boundary), drawn from a generator seeded by it."""
    return (np.random.default_rng([code, dims]).integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram, triples): for each trigram occurrence its text and the index of its three code points in `triples`."""
    decoded = ["\n" + t.decode("utf-8", "replace").lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, decoded), np.int64, len(decoded))
    codes = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    symbols, rows = np.where(letter, codes, 0)[keep], rows[keep]
    present = np.flatnonzero(np.bincount(symbols, minlength=1))
    place = np.zeros(int(present[-1]) + 1, np.int64)
    place[present] = np.arange(len(present))
    dense, n = place[symbols], len(present)
    same = rows[2:] == rows[:-2]
    packed = ((dense[:-2] * n + dense[1:-1]) * n + dense[2:])[same]
    if n**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(packed, minlength=1))
        index = np.zeros(n**3, np.int32)
        index[found] = np.arange(len(found), dtype=np.int32)
        trigram = index[packed]
    else:
        found, trigram = np.unique(packed, return_inverse=True)
    triples = present[np.stack([found // (n * n), found // n % n, found % n], 1)] if len(found) else np.zeros((0, 3), np.int64)
    return rows[:-2][same], trigram, triples


def trigram_vectors(triples: np.ndarray, dims: int) -> np.ndarray:
    codes, inverse = np.unique(triples, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dims) for c in codes]) if len(codes) else np.zeros((0, dims), np.int8)
    a, b, c = inverse.reshape(triples.shape).T
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def _bundles(texts: list[bytes], group: np.ndarray, n_groups: int, dims: int) -> np.ndarray:
    """Sum of the trigram vectors of the texts of each group, exact in float32 up to 2**24 trigrams of a group and block."""
    rows, trigram, triples = trigram_counts(texts)
    out = np.zeros((n_groups, dims), np.float64)
    k = len(triples)
    if not k:
        return out
    vectors = trigram_vectors(triples, dims).astype(np.float32)
    step = max(1, (1 << 22) // k)  # groups whose counts are held at once
    at = group[rows]
    for first in range(0, n_groups, step):
        part = (at >= first) & (at < first + step)
        width = min(step, n_groups - first)
        counts = np.bincount((at[part] - first) * k + trigram[part], minlength=width * k).reshape(width, k)
        out[first:first + width] = counts.astype(np.float32) @ vectors
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prototypes: np.ndarray  # a unit vector for each language


def fit_languages(docs: DataFrame, dims: int = DIMS) -> LanguageModel:
    """Prototypes from all rows of `docs` (text, lang) with a language."""
    prepare(docs.sparkSession)

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            for first, texts in texts_in_blocks(batch.column("text")):
                vectors = _bundles(texts, np.arange(len(texts)), len(texts), dims)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                whole, mine = np.rint(vectors / np.where(norms > 0, norms, 1) * ONE).astype(np.int64), codes[first:first + len(texts)]
                for code in np.unique(mine):
                    name, row = str(names[code]), whole[mine == code].sum(0)
                    sums[name] = sums[name] + row if name in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                                             names=["lang", "bundle"])

    parts = docs.filter(F.col("lang").isNotNull()).select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        bundle, "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))  # dims entries a language
    found = rows.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((r["lang"], [x["value"] for x in r["v"]]) for r in found)
    prototypes = np.array([v for _, v in found], np.float64).reshape(len(found), dims)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel([name for name, _ in found], prototypes / np.where(norms > 0, norms, 1))


def identify(docs: DataFrame, model: LanguageModel, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs`, and the predicted language with its cosine (0 to 1)."""
    spark = docs.sparkSession
    prepare(spark)
    known = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = known.value
        dims = model.prototypes.shape[1]
        for batch in batches:
            names, scores = [], []
            for _, texts in texts_in_blocks(batch.column("text")):
                vectors = _bundles(texts, np.arange(len(texts)), len(texts), dims)
                norms = np.linalg.norm(vectors, axis=1)
                if not model.languages:
                    norms[:] = 0
                cosines = vectors @ model.prototypes.T / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(1) if model.languages else np.zeros(len(texts), int)
                for row, at in enumerate(best):
                    names.append(model.languages[at] if norms[row] > 0 else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cosines[row, at]))) if norms[row] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, language, score])

    return docs.mapInArrow(predict, schema)


def language_id(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): prototypes from the documents that are not held out, predictions for all."""
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))), dims)
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
