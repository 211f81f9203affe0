"""URL rules decided by Bloom filter cascades.

A rule names a host, with all its subdomains, and the beginning of a path. A page can only fit rules whose key is (a suffix of its
host at a label boundary) + (a beginning of its path of a length that some rule has): its candidate keys. The distinct candidate keys
of all pages are the complete universe of what will ever be asked. Level 1 of a cascade is a Bloom filter of the listed keys; the keys
of the universe that pass it wrongly make level 2, the listed keys that pass that one make level 3, and so on until a level lets
nothing through wrongly. Every key of the universe is then answered exactly, from filters whose bits are in proportion to the list,
and pages are judged in their row, without a join.

Cases: a null URL or one without "://" has an empty host and path, fits no rule and is allowed; equal URLs are judged alike; an empty
table gives an empty result; of rules with one key the last one given holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import cut

#: Most rules of a list: the first level's bits and the listed keys are held by every task.
MAX_RULES = 2_000_000
#: Levels after which a cascade would not be converging.
MAX_LEVELS = 40


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Bloom:
    """A Bloom filter over 64-bit keys with double hashing."""

    def __init__(self, keys: np.ndarray, rate: float, salt: int):
        self.salt = salt
        self.hashes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, keys: np.ndarray):
        # fixed values: the multipliers of a 64-bit finaliser
        x = keys.astype(np.uint64) + np.uint64((self.salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        step = (x * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        for i in range(self.hashes):
            yield ((x + np.uint64(i) * step) % np.uint64(self.size)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
        return out


def in_cascade(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: the first level that a key does not pass tells the side that it is on."""
    answer, asked = np.zeros(len(keys), bool), np.arange(len(keys))
    for depth, level in enumerate(levels):
        passed = level.holds(keys[asked])
        answer[asked[~passed]] = depth % 2 == 1
        asked = asked[passed]
    answer[asked] = len(levels) % 2 == 1
    return answer


def hashed_keys(keys: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def build_cascade(universe: DataFrame, listed: list[str]) -> list[Bloom]:
    """Levels that answer "is this key listed?" exactly for every row of `universe` (key string, distinct).

    The first rate is chosen so that the keys that pass wrongly are about as many as the listed ones, whatever the universe's size: what
    reaches the driver is in proportion to the list, which MAX_RULES bounds.
    """
    if len(listed) > MAX_RULES:
        raise ValueError(f"a list of more than {MAX_RULES} keys")
    inside = np.unique(hashed_keys(listed))
    others = universe.count()
    if not len(inside) or not others:
        return [Bloom(inside, 0.5, 1)] if len(inside) else []
    levels = [Bloom(inside, min(0.5, len(inside) / others / math.sqrt(2)), 1)]
    known = universe.sparkSession.sparkContext.broadcast((levels[0], inside))

    @F.pandas_udf("boolean")
    def wrongly(key: pd.Series) -> pd.Series:
        first, listed_keys = known.value
        hashes = hashed_keys(key)
        return pd.Series(first.holds(hashes) & ~np.isin(hashes, listed_keys))

    rows = universe.filter(wrongly("key")).limit(MAX_RULES + 1).toPandas()
    if len(rows) > MAX_RULES:
        raise ValueError("the first level lets too many keys through")
    encode, against = np.unique(hashed_keys(rows["key"])), inside
    while len(encode):
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not converge")
        levels.append(Bloom(encode, 0.5, len(levels) + 1))
        encode, against = against[levels[-1].holds(against)], encode
    return levels


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of host suffixes at label boundaries, each joined with the path's beginnings of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    starts = F.filter(F.array(*[F.substring(path, 1, n) for n in lengths]), lambda s: F.length(s) > 0)
    return F.when(host != "", F.array_distinct(F.flatten(F.transform(
        suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p)))))).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of each page under `rules` of (action, host, path): the longest rule that fits decides.

    Two cascades are asked: whether a candidate key is a rule, and whether it is a blocking rule. Without a rule a page is allowed.
    """
    if not all(path.startswith("/") for _, _, path in rules):
        raise ValueError("a rule's path begins with /")
    by_key = {host + path: action for action, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules}) or [1]
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    asked = parts.select(key, "host", "path", candidate_keys(F.col("host"), F.col("path"), lengths).alias("keys"))
    universe = cut(asked.select(F.explode("keys").alias("key")).distinct())
    listed = build_cascade(universe, list(by_key))
    blocked = build_cascade(universe, [k for k, action in by_key.items() if action == "block"])
    known = pages.sparkSession.sparkContext.broadcast((listed, blocked))

    def decide(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        rules_of, blocks = known.value
        for batch in batches:
            counts = np.fromiter((len(x) for x in batch["keys"]), np.int64, len(batch))
            flat = [k for x in batch["keys"] for k in x]
            hashes = hashed_keys(flat)
            hit = np.flatnonzero(in_cascade(rules_of, hashes))
            row = np.repeat(np.arange(len(batch)), counts)
            rule: list[str | None] = [None] * len(batch)
            verdict = ["allow"] * len(batch)
            for at, is_block in zip(hit, in_cascade(blocks, hashes[hit]), strict=True):
                r = row[at]
                if rule[r] is None or len(flat[at]) > len(rule[r]):
                    rule[r], verdict[r] = flat[at], "block" if is_block else "allow"
            yield batch[[key, "host", "path"]].assign(rule=pd.Series(rule, index=batch.index, dtype=object), verdict=verdict)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return asked.mapInPandas(decide, f"{fields}, rule string, verdict string")
