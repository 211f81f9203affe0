"""Lookup-factor training: CP tensor factorisation (plain, symmetric, joint), GloVe, skip-gram, CBOW, document vectors.

Models of coordinate rows are trained in strata (`strata`): blocks of rows meet blocks of factors, with many updates a pass. The full-batch
step below serves streams and CBOW: join the rows with the factor rows of their indices, form each mode's gradient, sum per factor row
(partial sums first), update the factor table by a join. Factors stay distributed; they are broadcast only while a count
shows them small. State is written after every step.

`tensor(i, j[, k, l], value)`; `state(f, idx, vec, m, v)` with f naming the factor.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vectors as vx
from vectorloom.operators.cooc import MODES
from vectorloom.operators.spectral import gram, times
from vectorloom.operators.strata import CELL_ROWS, descend, least_squares, packed_cells, settled
from vectorloom.runtime import Kept, cut, fits, hash01

# Optimiser settings.
RATES = {"adam": 1e-3, "sgd": 1.0, "adagrad": 0.05}
#: Training ends when the best loss of some passes is better than before by a smaller share than this.
TOLERANCE = 5e-3
#: Rows of a cell of `reconstruction_error`, and rows of it whose vectors are multiplied together.
GRID_ROWS, GRID_BATCH = 1 << 18, 1 << 14


@dataclass(frozen=True)
class Settings:
    rank: int
    optimizer: str = "adam"
    rate: float | None = None
    nonnegative: bool = False
    l1: float = 0.0
    l2: float = 0.0
    bias: bool = False
    seed: int = 0

    @property
    def width(self) -> int:
        return self.rank + (1 if self.bias else 0)

    @property
    def step(self) -> float:
        return RATES[self.optimizer] if self.rate is None else self.rate


def modes_of(tensor: DataFrame) -> list[str]:
    return [m for m in MODES if m in tensor.columns]


# ---------------------------------------------------------------- initial factors
def _normal(size: int, seed: int, *keys) -> Column:
    def u(i, salt):
        return hash01(*[F.col(k) for k in keys], i, F.lit(salt), seed=seed) + 2.0 ** -53

    return F.transform(F.sequence(F.lit(1), F.lit(size)),
                       lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1)))


def random_embedding(words: DataFrame, dim: int, kind: str = "normal", scale: float = 1.0, seed: int = 0, key: str = "word") -> DataFrame:
    """Baseline vectors drawn from a hash of the word: the same word always gets the same vector."""
    if kind == "normal":
        v = _normal(dim, seed, key)
    else:
        v = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: 2 * hash01(F.col(key), i, seed=seed) - 1)
    return words.withColumn("vector", F.transform(v, lambda x: x * scale))


def initial_state(ids: DataFrame, settings: Settings, mean: float, std: float) -> DataFrame:
    """`ids(f, idx)` -> state with vectors drawn around `mean`."""
    draw = F.transform(_normal(settings.rank, settings.seed, "f", "idx"), lambda x: mean + std * x)
    draw = F.transform(draw, lambda x: F.greatest(x, F.lit(0.0))) if settings.nonnegative else draw
    vec = F.concat(draw, F.array(F.lit(0.0))) if settings.bias else draw
    zero = F.array_repeat(F.lit(0.0), settings.width)
    return cut(ids.select("f", F.col("idx").cast("long").alias("idx")).distinct().select(
        "f", "idx", vec.alias("vec"), zero.alias("m"), zero.alias("v")))


def start_from_tensor(tensor: DataFrame, factors: dict[str, str], settings: Settings) -> DataFrame:
    """Factors whose products have about the mean of the tensor: N(mu, mu/5), mu = (mean/rank)^(1/modes)."""
    mean = tensor.agg(F.avg("value")).first()[0] or 0.0
    mu = (abs(mean) / settings.rank) ** (1 / len(factors)) or 0.1
    ids = None
    for mode, f in factors.items():
        part = tensor.select(F.lit(f).alias("f"), F.col(mode).alias("idx")).distinct()
        ids = part if ids is None else ids.unionByName(part)
    return initial_state(ids, settings, mu, mu / 5)


# ---------------------------------------------------------------- gradients and updates
def _lookup(rows: DataFrame, state: DataFrame, factors: dict[str, str]) -> DataFrame:
    small = fits(state)
    for mode, f in factors.items():
        side = state.filter(F.col("f") == f).select(F.col("idx").alias(mode), F.col("vec").alias(f"_{mode}"))
        rows = rows.join(F.broadcast(side) if small else side, mode)  # broadcast only below the counted bound
    return rows


def _product(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = F.zip_with(out, c, lambda x, y: x * y)
    return out


def predict(rows: DataFrame, state: DataFrame, factors: dict[str, str], settings: Settings) -> DataFrame:
    """rows + `pred`, with each mode's vector as `_i`, `_j`, ..."""
    out = _lookup(rows, state, factors)
    parts = [F.slice(f"_{m}", 1, settings.rank) for m in factors]
    pred = vx.total(_product(parts))
    if settings.bias:
        for m in factors:
            pred = pred + F.get(f"_{m}", F.lit(settings.rank))
    return out.withColumn("pred", pred)


def _slopes(kind: str, mean_of: int) -> tuple[Column, Column]:
    """(d loss / d prediction, loss) per row."""
    if kind == "square":
        e = F.col("pred") - F.col("value")
        w = F.col("weight") / float(mean_of)
        return 2 * e * w, e * e * w
    if kind == "logistic":  # value = label in {0,1}, weight = how often the row was seen
        p = 1 / (1 + F.exp(-F.col("pred")))
        w = F.col("weight") / float(mean_of)
        loss = -(F.col("value") * F.log(p + 1e-12) + (1 - F.col("value")) * F.log(1 - p + 1e-12))
        return (p - F.col("value")) * w, loss * w
    raise ValueError(kind)


def gradients(rows: DataFrame, state: DataFrame, factors: dict[str, str], settings: Settings, kind: str = "square",
              mean_of: int = 1) -> DataFrame:
    """(f, idx, grad): summed per factor row; the row f='_loss' carries the loss of the same pass."""
    slope, loss = _slopes(kind, mean_of)
    scored = predict(rows, state, factors, settings).withColumn("_g", slope).withColumn("_loss", loss)
    parts = []
    for mode, f in factors.items():
        others = [F.slice(f"_{m}", 1, settings.rank) for m in factors if m != mode]
        grad = F.transform(_product(others), lambda x: x * F.col("_g"))
        grad = F.concat(grad, F.array("_g")) if settings.bias else grad
        parts.append(F.struct(F.lit(f).alias("f"), F.col(mode).cast("long").alias("idx"), grad.alias("grad")))
    parts.append(F.struct(F.lit("_loss").alias("f"), F.lit(0).cast("long").alias("idx"), F.array("_loss").alias("grad")))
    return sum_gradients(scored.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*"))


def sum_gradients(rows: DataFrame) -> DataFrame:
    return rows.groupBy("f", "idx").agg(Summarizer.sum(array_to_vector("grad")).alias("_s")).select(
        "f", "idx", vector_to_array("_s").alias("grad"))


def loss_of(grads: DataFrame) -> float:
    row = grads.filter("f = '_loss'").first()
    return float(row["grad"][0]) if row else 0.0


def update(state: DataFrame, grads: DataFrame, settings: Settings, t: int) -> DataFrame:
    """One optimiser step for every factor row; rows without a gradient only feel the penalty."""
    zero = F.array_repeat(F.lit(0.0), settings.width)
    s = state.join(grads, ["f", "idx"], "left").withColumn("g", F.coalesce("grad", zero)).drop("grad")
    if settings.l2:
        s = s.withColumn("g", F.zip_with("g", "vec", lambda g, x: g + settings.l2 * x))
    if settings.l1:
        s = s.withColumn("g", F.zip_with("g", "vec", lambda g, x: g + settings.l1 * F.signum(x)))
    rate = settings.step
    if settings.optimizer == "adam":
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        s = s.withColumn("m", F.zip_with("m", "g", lambda m, g: 0.9 * m + 0.1 * g))
        s = s.withColumn("v", F.zip_with("v", "g", lambda v, g: 0.999 * v + 0.001 * g * g))
        move = F.zip_with("m", "v", lambda m, v: rate * (m / c1) / (F.sqrt(v / c2) + 1e-8))
    elif settings.optimizer == "adagrad":
        s = s.withColumn("v", F.zip_with("v", "g", lambda v, g: v + g * g))
        move = F.zip_with("g", "v", lambda g, v: rate * g / (F.sqrt(v + 0.1)))
    else:
        move = F.transform("g", lambda g: rate * g)
    s = s.withColumn("vec", F.zip_with("vec", move, lambda x, d: x - d))
    if settings.nonnegative:
        s = s.withColumn("vec", F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))))
    return s.select("f", "idx", "vec", "m", "v")


def train(parts: list[tuple[DataFrame, dict[str, str], float]], settings: Settings, steps: int, kind: str = "square",
          state: DataFrame | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """Stratified training over weighted terms sharing factors: `parts` = [(rows, factors, term weight)].

    `steps` passes at most, each of many updates (`strata.descend`); ends when the loss has settled within `tolerance`.
    """
    ready = []
    for rows, factors, weight in parts:
        rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
        rows = cut(rows.withColumn("weight", F.col("weight") * weight))
        ready.append((rows, factors, max(1, rows.count())))
    if state is None:
        state = start_from_tensor(ready[0][0], ready[0][1], settings)
        for rows, factors, _ in ready[1:]:
            more = start_from_tensor(rows, factors, settings)
            state = cut(state.unionByName(more.join(state.select("f", "idx"), ["f", "idx"], "left_anti")))
    return descend(ready, state, settings, steps, kind, tolerance)


def factor_table(state: DataFrame, f: str = "U") -> DataFrame:
    return state.filter(F.col("f") == f).select("idx", F.col("vec").alias("vector"))


# ---------------------------------------------------------------- CP factorisations
def cp_decompose(tensor: DataFrame, rank: int, steps: int = 50, tolerance: float = TOLERANCE, **options) -> tuple[DataFrame, list[float]]:
    """One factor per mode (U, V, W, X)."""
    factors = dict(zip(modes_of(tensor), "UVWX"))
    return train([(tensor, factors, 1.0)], Settings(rank, **options), steps, tolerance=tolerance)


def cp_symmetric(tensor: DataFrame, rank: int, steps: int = 50, nonnegative: bool = False, tolerance: float = TOLERANCE,
                 **options) -> tuple[DataFrame, list[float]]:
    """One factor for all modes; `nonnegative` keeps it at or above zero."""
    factors = {m: "U" for m in modes_of(tensor)}
    return train([(tensor, factors, 1.0)], Settings(rank, nonnegative=nonnegative, **options), steps, tolerance=tolerance)


def cp_joint_symmetric(tensors: list[tuple[DataFrame, float]], rank: int, steps: int = 50, **options) -> tuple[DataFrame, list[float]]:
    """Tensors of different order share one factor; the loss is the weighted sum of their mean squared errors."""
    return train([(t, {m: "U" for m in modes_of(t)}, w) for t, w in tensors], Settings(rank, **options), steps)


def nnse(tensor: DataFrame, rank: int, steps: int = 50, **options) -> tuple[DataFrame, list[float]]:
    """Sparse non-negative embedding of a two-way tensor."""
    return cp_decompose(tensor, rank, steps, nonnegative=True, l1=5e-6, **options)


def glove(counts: DataFrame, rank: int, steps: int = 50, symmetric: bool = False, top: float = 100.0, power: float = 0.75,
          optimizer: str = "adagrad", **options) -> tuple[DataFrame, list[float]]:
    """Log counts with a bias per word, weighted by min(1, (count/top)^power)."""
    n = F.col("count").cast("double")
    rows = counts.select(*modes_of(counts), F.log(n).alias("value"), F.least(F.lit(1.0), F.pow(n / top, F.lit(power))).alias("weight"))
    names = modes_of(counts)
    factors = {m: "U" for m in names} if symmetric else dict(zip(names, "UVWX"))
    return train([(rows, factors, 1.0)], Settings(rank, optimizer=optimizer, bias=True, **options), steps)


def cp_als(tensor: DataFrame, rank: int, steps: int = 10, sequential: bool = True, ridge: float = 1e-3, seed: int = 0,
           decay: float = 0.25) -> tuple[DataFrame, list[float]]:
    """Damped alternating least squares: U <- (1-e) U + e M ((V'V * W'W) + ridge I)^-1, e = 1/(1+t^decay).

    M is the tensor times the other factors; only rank x rank Gram matrices reach the driver. `sequential` uses each new factor at once,
    otherwise all move together. Rows are packed into cells once, as those of the other models (`strata`), and each pass sends sums by
    factor row. A pass also returns the loss of the factors that it was given, so that of a step comes with the first pass of the next one.
    """
    factors = dict(zip(modes_of(tensor), "UVWX"))
    settings = Settings(rank, seed=seed)
    rows = cut(tensor.withColumn("weight", F.lit(1.0)))
    n = max(1, rows.count())
    start = start_from_tensor(rows, factors, settings)
    packed, place = packed_cells([(rows, factors, n)], n, math.ceil(4 * n / CELL_ROWS))  # their number changes no result
    if packed.isEmpty():
        return start, [0.0]
    state, kept, losses = start.select("f", "idx", "vec"), Kept(rows.sparkSession, "als"), []
    groups = [[m] for m in factors] if sequential else [list(factors)]
    grams = {f: gram(factor_table(state, f)) for f in factors.values()}
    for t in range(1, steps + 2):
        eta = 1 / (1 + t ** decay)
        for group in groups:
            solvers = {m: np.linalg.inv(math.prod(grams[f] for o, f in factors.items() if o != m) + ridge * np.eye(rank)) for m in group}
            found = least_squares(packed, place, state, factors, solvers, rank).withColumnRenamed("vector", "_new")
            vec = F.when(F.col("_new").isNull(), F.col("vec")).when(F.col("vec").isNull(), F.col("_new")).otherwise(
                F.zip_with("vec", "_new", lambda a, b: (1 - eta) * a + eta * b))
            moved = kept.put(state.join(found, ["f", "idx"], "full").select("f", "idx", vec.alias("vec")))
            if t > 1 and group is groups[0]:
                losses.append(sum(r.vec[0] for r in moved.filter("f = '_loss'").collect()) / n)  # one row a cell
                if t > steps or settled(losses, TOLERANCE):
                    return _with_moments(state, settings), losses
            state = moved.filter("f <> '_loss'")
            grams.update({factors[m]: gram(factor_table(state, factors[m])) for m in group})
    return start, [0.0]


def _with_moments(state: DataFrame, settings: Settings) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), settings.width)
    return state.select("f", "idx", "vec", zero.alias("m"), zero.alias("v"))


def reconstruction_error(tensor: DataFrame, factors: dict[str, DataFrame], bias: bool = False) -> DataFrame:
    """One row: root mean squared error; `factors` maps each mode to its (idx, vector) table.

    Rows are dealt to a grid of cells by a hash of each mode's index, about GRID_ROWS to a cell. A vector travels once to each cell that
    names it, not once for each row. Rows without a number or a vector of the others' length take no part, as in a sum over joined rows.
    """
    modes = list(factors)
    rows = cut(tensor.select(*[F.col(m).cast("long").alias(m) for m in modes], F.col("value").cast("double").alias("value")).dropna("any"))
    side = math.ceil(max(1.0, rows.count() / GRID_ROWS) ** (1 / len(modes)))
    cell = sum(F.pmod(F.xxhash64(m, F.lit(at)), F.lit(side)) * side ** at for at, m in enumerate(modes))
    rows = rows.withColumn("cell", cell)
    looked = None
    for m, table in factors.items():
        named = rows.select(F.col("cell").alias("to"), F.col(m).alias("idx")).distinct()
        known = table.select(F.col("idx").cast("long").alias("idx"), vx.as_double(F.col("vector")).alias("vector"))
        known = known.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
        part = named.join(known, "idx").select("to", F.lit(m).alias("mode"), "idx", "vector")
        looked = part if looked is None else looked.unionByName(part)

    def errors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        vectors, met = right["vector"], left
        for m in modes:  # a join: an index that is listed twice counts twice
            mine = right.loc[right["mode"] == m, "idx"]
            met = met.merge(pd.DataFrame({m: mine.to_numpy(), f"_{m}": mine.index}), on=m)
        sizes = vectors.str.len().to_numpy()
        long = [sizes[met[f"_{m}"]] for m in modes]
        total, count = 0.0, 0
        for size in np.unique(sizes):
            same = np.flatnonzero(np.logical_and.reduce([x == size for x in long]))
            of_size = np.flatnonzero(sizes == size)
            held = np.stack(vectors.iloc[of_size].to_list()).reshape(len(of_size), int(size))
            for part in np.array_split(same, 1 + len(same) // GRID_BATCH):
                product = np.ones((len(part), int(size)))
                for m in modes:
                    product *= held[np.searchsorted(of_size, met[f"_{m}"].to_numpy()[part])]
                total += float(((met["value"].to_numpy()[part] - product.sum(1)) ** 2).sum())
            count += len(same)
        return pd.DataFrame({"total": [total], "n": [count]})

    found = rows.groupBy("cell").cogroup(looked.groupBy("to")).applyInPandas(errors, "total double, n long")
    return found.agg(F.sum("total").alias("t"), F.sum("n").alias("n")).select(F.when(F.col("n") > 0, F.sqrt(F.col("t") / F.col("n"))).alias("rmse"))


# ---------------------------------------------------------------- skip-gram, HOSG, CBOW
def draw_negatives(rows: DataFrame, keys: list[str], cumulative: DataFrame, per_row: int, seed: int = 1, domain: int = 2**31 - 1) -> DataFrame:
    """`per_row` words per row with chance share^power; `cumulative(term_id, upper)` is the running table.

    The number line is cut into as many buckets as there are words: each word is listed in the buckets it covers, each draw lands in
    one, so the range join is an equality join that meets about two words a draw, whatever the vocabulary's size.
    """
    buckets = max(1, cumulative.count())
    width = domain // buckets + 1
    spans = cumulative.select("term_id", F.col("lower"), "upper").filter("upper > lower")
    listed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lower") / width), F.floor((F.col("upper") - 1) / width))))
    draws = rows.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    draws = draws.withColumn("_u", F.floor(hash01(*[F.col(k) for k in keys], F.col("_draw"), seed=seed) * domain).cast("long"))
    draws = draws.withColumn("_b", F.floor(F.col("_u") / width))
    return draws.join(listed, "_b").filter((F.col("_u") >= F.col("lower")) & (F.col("_u") < F.col("upper"))).drop(
        "_b", "_u", "lower", "upper", "_draw").withColumnRenamed("term_id", "negative")


def sampling_spans(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """(term_id, lower, upper) from (token, term_id, count)."""
    from vectorloom.operators.vocab import negative_sampling_table

    table = negative_sampling_table(counts.select("token", "count"), power)
    return table.join(counts.select("token", "term_id"), "token").select("term_id", "lower", "upper")


def sgns_rows(pairs: DataFrame, counts: DataFrame, negatives: int = 5, seed: int = 1) -> DataFrame:
    """(i, j, value, weight): counted positive pairs and drawn negative ones."""
    positive = pairs.groupBy(F.col("target").alias("i"), F.col("context").alias("j")).agg(F.count("*").cast("double").alias("weight"))
    drawn = draw_negatives(pairs, ["doc_id", "pos", "target", "context"], sampling_spans(counts), negatives, seed)
    negative = drawn.filter(F.col("negative") != F.col("context")).groupBy(
        F.col("target").alias("i"), F.col("negative").alias("j")).agg(F.count("*").cast("double").alias("weight"))
    return positive.withColumn("value", F.lit(1.0)).unionByName(negative.withColumn("value", F.lit(0.0)))


def sgns(pairs: DataFrame, counts: DataFrame, rank: int, steps: int = 20, negatives: int = 5, rate: float = 0.05, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """Skip-gram with negative sampling: factors U (words) and V (contexts) under the logistic loss."""
    rows = cut(sgns_rows(pairs, counts, negatives, seed))
    settings = Settings(rank, rate=rate, seed=seed)
    ids = rows.select(F.lit("U").alias("f"), F.col("i").alias("idx")).unionByName(rows.select(F.lit("V").alias("f"), F.col("j").alias("idx")))
    state = initial_state(ids, settings, 0.0, 1 / math.sqrt(rank))
    return train([(rows, {"i": "U", "j": "V"}, 1.0)], settings, steps, "logistic", state)


def hosg_rows(near: DataFrame, counts: DataFrame, negatives: int = 5, seed: int = 1) -> DataFrame:
    """(i, j, k, value, weight) for `hosg` from `near(doc_id, pos, target, k, context)`: seen triples, and drawn words at the same offset."""
    positive = near.groupBy(F.col("target").alias("i"), F.col("context").alias("j"), F.col("k").cast("long").alias("k")).agg(
        F.count("*").cast("double").alias("weight"))
    drawn = draw_negatives(near, ["doc_id", "pos", "k"], sampling_spans(counts), negatives, seed).filter(F.col("negative") != F.col("context"))
    negative = drawn.groupBy(F.col("target").alias("i"), F.col("negative").alias("j"), F.col("k").cast("long").alias("k")).agg(
        F.count("*").cast("double").alias("weight"))
    return cut(positive.withColumn("value", F.lit(1.0)).unionByName(negative.withColumn("value", F.lit(0.0))))


def hosg(triples: DataFrame, rank: int, steps: int = 20, rate: float = 0.05, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """Skip-gram with a relation vector per position offset: `triples(i, j, k, value, weight)`, k = offset id."""
    settings = Settings(rank, rate=rate, seed=seed)
    ids = None
    for mode, f in zip("ijk", "UVR"):
        part = triples.select(F.lit(f).alias("f"), F.col(mode).alias("idx"))
        ids = part if ids is None else ids.unionByName(part)
    state = initial_state(ids, settings, 0.0, rank ** (-1 / 3))
    return train([(triples, dict(zip("ijk", "UVR")), 1.0)], settings, steps, "logistic", state)


def cbow(windows: DataFrame, counts: DataFrame, rank: int, steps: int = 10, negatives: int = 5, rate: float = 0.05,
         mean: bool = True, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """Mean (or sum) of the context vectors predicts the target against drawn negatives.

    `windows(doc_id, pos, target, context[])`; factors C (inputs) and O (outputs). Examples are packed into cells once; in each step a
    cell pulls the vectors of its own ids and returns one gradient for each of them, so that nothing is exchanged for an example.
    """
    settings = Settings(rank, rate=rate, seed=seed)
    examples = cut(windows.filter(F.size("context") > 0).select("doc_id", "pos", F.col("target").cast("long").alias("target"),
                                                                F.col("context").cast("array<bigint>").alias("context")))
    cells = max(1, math.ceil(examples.count() / CELL_EXAMPLES))
    drawn = draw_negatives(examples.select("doc_id", "pos", "target"), ["doc_id", "pos", "target"], sampling_spans(counts), negatives, seed)
    own = examples.select("doc_id", "pos", F.explode(F.concat(
        F.transform("context", lambda j: F.struct(F.lit("C").alias("f"), j.alias("idx"), F.lit(0.0).alias("value"))),
        F.array(F.struct(F.lit("O").alias("f"), F.col("target").alias("idx"), F.lit(1.0).alias("value"))))).alias("_r")).select("doc_id", "pos", "_r.*")
    rows = own.unionByName(drawn.filter("negative <> target").select(
        "doc_id", "pos", F.lit("O").alias("f"), F.col("negative").cast("long").alias("idx"), F.lit(0.0).alias("value")))
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(cells))).repartition(4 * cells, "cell")
    packed = cut(dealt.groupBy("cell").applyInPandas(_pack_examples, CBOW_PACKED).repartition(4 * cells, "cell"))  # stays where it is
    named = F.explode(F.concat(F.transform("c_ids", lambda i: F.struct(F.lit("C").alias("f"), i.alias("idx"))),
                               F.transform("o_ids", lambda i: F.struct(F.lit("O").alias("f"), i.alias("idx")))))
    place = cut(packed.select(F.col("cell").alias("to"), named.alias("_n")).select("to", "_n.*"))  # a row a cell and factor row
    total = float(packed.agg(F.sum("outputs")).first()[0] or 1)
    state, kept = initial_state(place.select("f", "idx"), settings, 0.0, 1 / math.sqrt(rank)), Kept(examples.sparkSession, "cbow")
    step = _cbow_step(total, mean)
    losses = []
    for t in range(1, steps + 1):
        here = place.join(state.select("f", "idx", "vec"), ["f", "idx"])
        found = packed.groupBy("cell").cogroup(here.groupBy("to")).applyInPandas(step, "f string, idx long, grad array<double>")
        grads = cut(sum_gradients(found))
        losses.append(loss_of(grads))
        state = kept.put(update(state, grads.filter("f <> '_loss'"), settings, t))
        if settled(losses, TOLERANCE):
            break
    return state, losses


#: Examples of a cell of `cbow`: they are visited in one task.
CELL_EXAMPLES = 100_000
CBOW_PACKED = "cell long, c_ids array<long>, o_ids array<long>, outputs long, i binary, i_ex binary, o binary, o_ex binary, value binary"


def _pack_examples(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a cell: the distinct ids of both factors, and each input and output as (place of its id, example), by example."""
    rows = rows.sort_values(["doc_id", "pos", "f", "idx"], kind="stable", ignore_index=True)
    new = (rows["doc_id"] != rows["doc_id"].shift()) | (rows["pos"] != rows["pos"].shift())
    ex, inputs = (np.cumsum(new.to_numpy()) - 1).astype(np.int32), rows["f"].to_numpy() == "C"
    idx = rows["idx"].to_numpy(np.int64)
    (c, i), (o, to) = (np.unique(idx[side], return_inverse=True) for side in (inputs, ~inputs))
    return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "c_ids": [c], "o_ids": [o], "outputs": [len(to)],
                         "i": [i.astype(np.int32).tobytes()], "i_ex": [ex[inputs].tobytes()], "o": [to.astype(np.int32).tobytes()],
                         "o_ex": [ex[~inputs].tobytes()], "value": [rows["value"].to_numpy(float)[~inputs].tobytes()]})


def _sums(rows: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by key, 0 to n - 1."""
    return np.stack([np.bincount(key, column, n) for column in rows.T], 1)


def _cbow_step(total: float, mean: bool):
    def step(cell: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(cell):
            return pd.DataFrame({"f": [], "idx": [], "grad": []})
        row = cell.iloc[0]
        i, i_ex, o, o_ex = (np.frombuffer(row[c], np.int32) for c in ("i", "i_ex", "o", "o_ex"))
        value = np.frombuffer(row["value"])
        state = state.sort_values(["f", "idx"], ignore_index=True)  # the order of the packed places
        both = np.stack(state["vec"].to_numpy())
        c, out = both[:len(row["c_ids"])], both[len(row["c_ids"]):]
        n = int(o_ex[-1]) + 1  # every example has its target
        share = (1 / np.bincount(i_ex, minlength=n))[:, None] if mean else np.ones((n, 1))
        hidden = _sums(c[i], i_ex, n) * share
        p = 1 / (1 + np.exp(-(hidden[o_ex] * out[o]).sum(1)))
        slope = ((p - value) / total)[:, None]
        loss = -(value * np.log(p + 1e-12) + (1 - value) * np.log(1 - p + 1e-12)).sum() / total
        back = _sums(out[o] * slope, o_ex, n) * share
        grads = np.vstack([_sums(back[i_ex], i, len(c)), _sums(hidden[o_ex] * slope, o, len(out))])
        return pd.DataFrame({"f": [*state["f"], "_loss"], "idx": [*state["idx"], 0], "grad": [*grads, np.array([loss])]})

    return step


def word2vec(docs: DataFrame, dim: int = 100, window: int = 5, min_count: int = 5, iterations: int = 1, rate: float = 0.025,
             seed: int = 1, tokens: str = "tokens") -> DataFrame:
    """Hierarchical-softmax skip-gram of Spark ML: (word, vector). Its weights are broadcast, so cap by min_count."""
    from pyspark.ml.feature import Word2Vec

    parts = docs.sparkSession.sparkContext.defaultParallelism  # the corpus is trained in as many parts, averaged after each pass
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=iterations, stepSize=rate, seed=seed,
                     numPartitions=parts, inputCol=tokens, outputCol="_v").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


# ---------------------------------------------------------------- documents
def infer_vectors(docs: DataFrame, outputs: DataFrame, rank: int, steps: int = 10, rate: float = 0.1, min_rate: float = 0.0001,
                  negatives: int = 5, seed: int = 1, doc_id: str = "doc_id", ids: str = "ids", noise: int = 1 << 16) -> DataFrame:
    """(doc_id, vector): document vectors that predict the document's words while the word side stays frozen.

    `outputs(idx, vector[, count])` may be of any size: a document is joined with the vectors of its own words (unknown ones drop out),
    and negatives come from one table of `noise` words drawn in proportion to count^0.75 (evenly without counts), the only thing that is
    broadcast. Documents without a known word keep their start vector.
    """
    counted = outputs if "count" in outputs.columns else outputs.withColumn("count", F.lit(1))
    named = counted.select(F.col("idx").cast("string").alias("token"), F.col("idx").alias("term_id"), "count")
    draws = docs.sparkSession.range(noise).withColumnRenamed("id", "draw")
    drawn = draw_negatives(draws, ["draw"], sampling_spans(named), 1, seed).select(F.col("negative").alias("idx"), "draw")
    table = drawn.join(outputs.select("idx", "vector"), "idx").orderBy("draw").select("vector").collect()  # at most `noise` rows
    shared = docs.sparkSession.sparkContext.broadcast(np.array([r["vector"] for r in table], float).reshape(len(table), rank))
    known = docs.select(doc_id, F.posexplode(ids).alias("pos", "idx")).join(outputs.select("idx", "vector"), "idx").groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("_w"))  # the words of one document
    held = docs.select(doc_id).join(known, doc_id, "left").select(doc_id, F.col("_w.vector").alias("_w"))

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = shared.value
        for pdf in batches:
            vectors = []
            for key, words in zip(pdf[doc_id], pdf["_w"]):
                rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
                v = (rng.random(rank) - 0.5) / rank
                true = np.stack(words) if words is not None and len(words) else np.zeros((0, rank))
                step = rate
                for t in range(steps if len(true) else 0):
                    x = np.concatenate([true, matrix[rng.integers(0, len(matrix), len(true) * negatives)]])
                    label = np.arange(len(x)) < len(true)
                    v = v + step * ((label - 1 / (1 + np.exp(-x @ v))) @ x) / len(true)
                    step = (step - min_rate) / (steps - t) + min_rate
                vectors.append(v)
            yield pd.DataFrame({doc_id: pdf[doc_id], "vector": vectors})

    t = docs.schema[doc_id].dataType.simpleString()
    return held.mapInPandas(infer, f"{doc_id} {t}, vector array<double>")


def doc_vectors(docs: DataFrame, counts: DataFrame, rank: int, steps: int = 10, negatives: int = 5, rate: float = 0.05, seed: int = 1,
                doc_id: str = "doc_id", ids: str = "ids") -> tuple[DataFrame, list[float]]:
    """Joint training of document vectors (factor D) and word outputs (factor V): the document predicts its words."""
    pairs = docs.select(doc_id, F.posexplode(ids).alias("pos", "context")).select(
        F.col(doc_id).alias("doc_id"), "pos", F.col(doc_id).alias("target"), F.col("context").cast("long").alias("context"))
    rows = cut(sgns_rows(pairs, counts, negatives, seed))
    settings = Settings(rank, rate=rate, seed=seed)
    names = rows.select(F.lit("D").alias("f"), F.col("i").alias("idx")).unionByName(rows.select(F.lit("V").alias("f"), F.col("j").alias("idx")))
    return train([(rows, {"i": "D", "j": "V"}, 1.0)], settings, steps, "logistic", initial_state(names, settings, 0.0, 1 / math.sqrt(rank)))


def doc_vectors_dm(windows: DataFrame, counts: DataFrame, rank: int, steps: int = 10, mean: bool = True, doc_id: str = "doc_id",
                   **options) -> tuple[DataFrame, list[float]]:
    """Distributed-memory document vectors: the mean (or sum) of a document's vector and its context words predicts the target.

    `windows(doc_id, pos, target, context[])`. Documents are further inputs of `cbow` under the ids -(doc_id + 1), so factor C holds words
    (idx >= 0) and documents (idx < 0), and O the outputs.
    """
    own = F.array((-(F.col(doc_id) + 1)).cast("bigint"))
    joined = windows.withColumn("context", F.concat(F.col("context").cast("array<bigint>"), own))
    return cbow(joined, counts, rank, steps, mean=mean, **options)


def document_table(state: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, vector) of a state of `doc_vectors_dm`."""
    return state.filter((F.col("f") == "C") & (F.col("idx") < 0)).select((-F.col("idx") - 1).alias(doc_id), F.col("vec").alias("vector"))


def sentence_log_prob(pairs: DataFrame, words: DataFrame, contexts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, log_prob): sum over (target, context) pairs of log sigmoid(u.v)."""
    u = words.select(F.col("idx").alias("target"), F.col("vector").alias("_u"))
    v = contexts.select(F.col("idx").alias("context"), F.col("vector").alias("_v"))
    x = vx.dot(F.col("_u"), F.col("_v"))
    each = F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))  # never exp of a large number
    if fits(u) and fits(v):  # vectors go to every task: pairs stay beside their document, and only its sums are exchanged
        scored = pairs.join(F.broadcast(u), "target").join(F.broadcast(v), "context")
        return scored.groupBy(doc_id).agg(F.sum(each).alias("log_prob"))
    counted = pairs.groupBy(doc_id, "target", "context").agg(F.count("*").alias("_n"))
    return counted.join(u, "target").join(v, "context").groupBy(doc_id).agg(F.sum(F.col("_n") * each).alias("log_prob"))
