"""Toxicity by weak supervision.

1. Voters. Lexicon voters are words, or beginnings of words, that occur mostly in documents labelled toxic; they are mined from a bounded
   sample of the labelled training rows so that each toxic row is covered several times. Pattern voters look at shouting, runs of marks,
   masked words and an insult beside a second person. A voter fires on a text or not.
2. Label model. A generative model of the votes is fitted by expectation maximisation: each voter has an accuracy, whose prior are the
   counts that proposed it, and abstains where it does not fire. Voters that still go together within a class are correlated; the
   residual correlations discount their evidence, so that five forms of one word do not count five times. The result is a posterior
   label for each sampled row.
3. Classifier. A logistic regression over the votes, trained on the posterior labels, scores every whole text in one scan with an
   automaton for all lexicon voters.

Labels are read only for rows that are not held out, and only to propose voters; language, source and id are no inputs of a score.

Cases: null and empty texts fire no voter and get the classifier's base score; null labels are skipped; a text is scored alike wherever
it stands; without labels (or without voters) every score is the base rate of a model with no evidence; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import held_out, prepare, texts_in_blocks

#: Bounds of what is fitted on: labelled rows, proposed units, voters, and how often the voters cover a toxic row.
SAMPLE_ROWS, PROPOSED, VOTERS, COVER = 20_000, 3000, 256, 4
#: A unit is proposed if so many toxic rows have it, and so large a share of the rows that have it are toxic.
MIN_TOXIC, MIN_SHARE = 3, 0.75
#: Posterior of a text on which no voter fires.
BASE = 0.02
#: Lengths of the word beginnings that are tried beside whole words.
STEMS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@#$%]{2,}[^\W\d_]?")
_UPPER = bytes(range(65, 91))
_LETTER = bytes(range(65, 91)) + bytes(range(97, 123))
_SECOND = re.compile(r"\b(?:you|your|du|dein|tu|toi|vous|usted|eres)\b")
PATTERNS = ("shouting", "marks", "masked", "addressed")


def units_of(text: str) -> set[str]:
    """Words (ending in a blank) and beginnings of words of a text."""
    words = set(_WORD.findall(text.lower()))
    return {w + " " for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}


class Votes:
    """Fires lexicon units and patterns on texts; built inside a task from the units."""

    def __init__(self, units: list[str]):
        import ahocorasick

        self.n = len(units)
        self.automaton = ahocorasick.Automaton()
        for at, unit in enumerate(units):
            word = unit.rstrip(" ")
            held = self.automaton.get(word, ())
            self.automaton.add_word(word, (*held, (at, len(word), unit.endswith(" "))))
        if self.n:
            self.automaton.make_automaton()

    def fired(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        lower, out = text.lower(), set()
        if self.n:
            for end, found in self.automaton.iter(lower):
                for at, size, whole in found:
                    start = end - size
                    if (start < 0 or not lower[start].isalpha()) and not (whole and end + 1 < len(lower) and lower[end + 1].isalpha()):
                        out.add(at)
        lexicon = bool(out)
        letters = len(raw) - len(raw.translate(None, _LETTER))
        if letters >= 20 and 10 * (len(raw) - len(raw.translate(None, _UPPER))) > 6 * letters:
            out.add(self.n)
        if "!!" in text or "??" in text:
            out.add(self.n + 1)
        if _MASKED.search(text):
            out.add(self.n + 2)
        if lexicon and _SECOND.search(lower):
            out.add(self.n + 3)
        return sorted(out)


@dataclass(frozen=True)
class ToxicityModel:
    units: list[str]
    weights: np.ndarray  # of the units, then of the patterns
    bias: float


def sampled_labels(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """(text, toxic) of about `rows` labelled rows that are not held out, chosen by a hash of the id."""
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("text", "toxic")


def propose_units(sample: DataFrame) -> list[str]:
    """Units by falling number of toxic rows, of those that are frequent and specific enough."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                units = units_of(text)
                seen.update(units)
                if label:
                    toxic.update(units)
        names = list(seen)
        for first in range(0, len(names), 50_000):
            part = names[first:first + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[u] for u in part], pa.int64()),
                                              pa.array([toxic[u] for u in part], pa.int64())], names=["unit", "seen", "toxic"])

    counts = sample.mapInArrow(count, "unit string, seen long, toxic long").groupBy("unit").agg(
        F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    kept = counts.filter((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= MIN_SHARE * F.col("seen")))
    best = kept.orderBy((F.col("toxic") * F.col("toxic") / F.col("seen")).desc(), "unit").limit(PROPOSED)
    return [r["unit"] for r in best.collect()]


def collected_votes(sample: DataFrame, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of votes (rows x units and patterns) and the labels of the bounded sample."""
    known = sample.sparkSession.sparkContext.broadcast(units)

    def fire(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        votes = Votes(known.value)
        for batch in batches:
            yield pd.DataFrame({"fired": [votes.fired(t.encode()) for t in batch["text"]], "toxic": batch["toxic"].to_numpy()})

    rows = sample.mapInPandas(fire, "fired array<int>, toxic int").collect()
    out = np.zeros((len(rows), len(units) + len(PATTERNS)), np.float32)
    for row, r in enumerate(rows):
        out[row, r["fired"]] = 1
    return out, np.array([r["toxic"] for r in rows], np.int64)


def choose_voters(votes: np.ndarray, toxic: np.ndarray, units: list[str]) -> list[int]:
    """Greedy multiple cover of the toxic rows: the unit that covers most rows not yet covered COVER times, other rows counting against it.

    Of a word and its beginnings only one is taken, the longest of those that cover alike.
    """
    n, longer = len(units), np.array([0.02 * len(u) for u in units])
    ill, well = votes[toxic == 1, :n], votes[toxic == 0, :n].sum(0)
    need, chosen, closed = np.full(len(ill), COVER), [], np.zeros(n, bool)
    while n and len(chosen) < VOTERS:
        gain = ill.T @ (need > 0).astype(np.float32) - 2 * well + longer
        gain[closed] = -np.inf
        at = int(gain.argmax())
        if gain[at] < 2:
            break
        chosen.append(at)
        need[ill[:, at] > 0] -= 1
        word = units[at].strip()
        closed |= np.array([u.strip().startswith(word) or word.startswith(u.strip()) for u in units])
    return chosen


def label_model(votes: np.ndarray, hits: np.ndarray, fired: np.ndarray, n_units: int, base: float = BASE, steps: int = 200,
                tolerance: float = 1e-6) -> np.ndarray:
    """Posterior probability of the toxic class for each row.

    A voter that does not fire abstains. Its accuracy, the share of toxic rows among those that it fires on, is estimated by expectation
    maximisation from a Beta prior (`hits` of `fired`). `base` is the posterior of a row on which nothing fires.
    """
    if not len(votes):
        return np.zeros(0)
    logit = lambda p: np.log(p / (1 - p))
    n = votes.sum(0)
    posterior = np.where(votes[:, :n_units].any(1), 0.9, base)
    for _ in range(steps):
        accuracy = np.clip((posterior @ votes + hits + 0.5 * base) / (n + fired + 0.5), 1e-3, 1 - 1e-3)
        # what the classes leave of the voters' correlations discounts the evidence of those that fire together
        on, off = posterior @ votes / posterior.sum(), (1 - posterior) @ votes / max(1e-9, (1 - posterior).sum())
        left = votes - posterior[:, None] * on - (1 - posterior[:, None]) * off
        scale = np.sqrt((left**2).mean(0)) + 1e-9
        correlation = np.clip((left.T @ left) / len(votes) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(correlation, 0)
        beside = votes @ np.where(correlation > 0.2, correlation, 0)
        prior = np.clip(posterior.mean(), base, 0.5)  # a voter no better than the prior says nothing
        evidence = (votes * (logit(accuracy) - logit(prior)) / (1 + beside)).sum(1)
        updated = 1 / (1 + np.exp(-np.clip(logit(base) + evidence, -40, 40)))
        change, posterior = np.abs(updated - posterior).max(), updated
        if change < tolerance:
            break
    return posterior


def train_classifier(votes: np.ndarray, target: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps with an L2 penalty."""
    x = np.hstack([votes.astype(np.float64), np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * max(1, len(votes)) * 0.01)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (target - p) - ridge * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-12))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    prepare(docs.sparkSession)
    sample = sampled_labels(docs, labels, rows).persist()
    try:
        proposed = propose_units(sample)
        votes, toxic = collected_votes(sample, proposed)
    finally:
        sample.unpersist()
    chosen = choose_voters(votes, toxic, proposed)
    votes = np.hstack([votes[:, chosen], votes[:, len(proposed):]])
    fired = votes.sum(0)
    hits = votes[toxic == 1].sum(0) if len(votes) else fired
    target = label_model(votes, hits, fired, len(chosen))
    if not len(target):
        return ToxicityModel([], np.zeros(len(PATTERNS)), -3.0)
    weights, bias = train_classifier(votes, target)
    return ToxicityModel([proposed[i] for i in chosen], weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = known.value
        votes = Votes(model.units)
        for batch in batches:
            logits = [model.bias + float(model.weights[votes.fired(t)].sum()) for _, texts in texts_in_blocks(batch.column("text")) for t in texts]
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels))
