"""Alignment of two public tokenizers: which ids stand for the same bytes, and in how many documents.

Byte offsets where tokens of both tokenizers end cut a document's tokens into groups; all pairs of a group are linked. Texts are encoded
once; their ids, two bytes each, are written beside the checkpoints and aligned in each of two passes. The first one gives each task's
distinct id pairs with their numbers of documents. The pairs are dealt to SHARDS shards by a hash of their A id, and per shard

1. trees of FAN rows unite the tasks' keys to the distinct ones, over which a minimal perfect hash is built (`PerfectHash`);
2. the tasks' counts become dense vectors indexed by that hash, which trees of FAN rows add up;
3. the vector, the keys in hash order (a looked-up key is compared with the key at its place) and whether a pair has the highest
   count of its A id (all pairs of an A id are in one shard) make the shard's table.

A second pass aligns every document again and looks its pairs up. If the tables take at most TABLE_BYTES they are broadcast; beyond,
the documents' pairs go to their shards, FAN blocks of documents at a time, and sums come back by document. The number of pairs is
bounded by the two vocabularies, not by the corpus; a shard by (ids of A in it) x (ids of B).

Cases: a text that is null, empty or whose joined token bytes differ from a space and the text has no tokens: zeros and an empty digest;
special tokens' strings are plain text; equal rows and null ids are documents like any other; an empty table gives an empty result. Whole
texts are aligned; memory grows with one text and its distinct pairs. A group of more than GROUP_LINKS links is counted by distinct ids.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.common import cut, gather_ranges, prepare, texts_in_blocks

#: Vocabulary files of the query.
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Shards of the id pairs, rows that one step of a tree adds up, keys that a task holds before it hands them on.
SHARDS, FAN, HELD_KEYS = 256, 32, 2_000_000
#: Bytes of all tables up to which they are broadcast; links of one group that are listed one by one; links that a step looks at.
TABLE_BYTES, GROUP_LINKS, STEP_LINKS = 48 << 20, 1 << 12, 1 << 20
#: Positions for each key and level of the perfect hash, and its levels; keys that are left then are listed.
GAMMA, LEVELS = 1.6, 48

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_table() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies (printable bytes stand for themselves, the rest follow from 256 on)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, file_a: str = FILE_A, file_b: str = FILE_B):
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(file_a), encoding="utf-8") as file:
            whole = json.load(file)
        entries, added = whole["model"]["vocab"], {token["content"] for token in whole["added_tokens"]}
        byte = _byte_table()
        ranks = {bytes(byte[c] for c in token): i for token, i in entries.items() if token not in added}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file_b))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, table)), np.int64) for table in (self.bytes_a, self.bytes_b))
        written = lambda n, mark: np.array([f"{i}{mark}".encode() for i in range(n)], object)
        self.text_a = [written(len(self.bytes_a), mark) for mark in ",|"]
        self.text_b = [written(len(self.bytes_b), mark) for mark in ",;"]

        # ids are kept in two bytes where they fit
        self.kinds = ["<u2" if len(table) <= 1 << 16 else "<u4" for table in (self.bytes_a, self.bytes_b)]

    def ids(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of both for each text, or none if the joined bytes of either are not a space and the text."""
        strings = [t.decode() for t in texts]
        for text, string, b in zip(texts, strings, self.b.encode(strings, num_threads=1), strict=True):
            whole, a = b" " + text, self.a.encode_to_numpy(f" {string}", disallowed_special=())
            same = text and b"".join([self.bytes_b[i] for i in b]) == whole and b"".join([self.bytes_a[i] for i in a.tolist()]) == whole
            yield (a.astype(self.kinds[0]).tobytes(), np.array(b, self.kinds[1]).tobytes()) if same else (b"", b"")


@lru_cache(maxsize=1)
def aligner(file_a: str = FILE_A, file_b: str = FILE_B) -> Aligner:
    return Aligner(file_a, file_b)


@dataclass
class Block:
    """Aligned tokens of some texts, one after the other; groups are numbered through."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_doc: np.ndarray
    docs: int
    starts_a: np.ndarray
    starts_b: np.ndarray
    width: int

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.group_doc)
        return np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, key, how often) of the links; key = A id * entries of B + B id. Few rows at a time, groups with very many links by distinct ids."""
        in_a, in_b = self.sizes()
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        large = in_a * in_b > GROUP_LINKS
        small = np.flatnonzero(~large[self.group_a])
        turn = np.cumsum(in_b[self.group_a[small]]) // STEP_LINKS
        for each in np.split(small, np.flatnonzero(np.diff(turn)) + 1) if len(small) else ():
            partner = in_b[self.group_a[each]]
            left = np.repeat(each, partner)
            right = gather_ranges(first_b[self.group_a[each]], partner)
            yield self.group_doc[self.group_a[left]], self.a[left] * self.width + self.b[right], np.ones(len(left), np.int64)
        for g in np.flatnonzero(large):
            a, m = np.unique(self.a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            b, n = np.unique(self.b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            step = max(1, STEP_LINKS // len(b))
            for at in range(0, len(a), step):
                keys = (a[at:at + step, None] * self.width + b[None]).ravel()
                yield np.full(len(keys), self.group_doc[g]), keys, (m[at:at + step, None] * n[None]).ravel()

    def digests(self, tools: Aligner) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text; empty without tokens."""
        in_a, in_b = self.sizes()
        last = lambda groups: np.append(groups[1:] != groups[:-1], True) if len(groups) else np.zeros(0, bool)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        parts = np.empty(len(self.a) + len(self.b), object)
        for ids, groups, shift, texts in ((self.a, self.group_a, before_b, tools.text_a), (self.b, self.group_b, before_a, tools.text_b)):
            place = np.arange(len(ids)) + shift[groups]
            ends = last(groups)
            parts[place] = texts[0][ids]
            parts[place[ends]] = texts[1][ids[ends]]
        bounds = self.starts_a + self.starts_b
        return [hashlib.sha256(b"".join(parts[s:e].tolist())[:-1]).hexdigest() if e > s else "" for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def align(pairs: list[tuple[bytes, bytes]], tools: Aligner) -> Block:
    """A block of the texts whose ids are given."""
    found = [[np.frombuffer(p[side], tools.kinds[side]) for p in pairs] for side in (0, 1)]
    n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in found)
    a, b = (np.concatenate(side).astype(np.int64) if side else np.zeros(0, np.int64) for side in found)
    ends_a, ends_b = np.cumsum(tools.size_a[a]), np.cumsum(tools.size_b[b])
    mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool)
    mark[ends_a] = True
    common = ends_b[mark[ends_b]]
    starts_a, starts_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    group_b = np.searchsorted(common, ends_b)
    group_doc = np.zeros(len(common), np.int64)
    group_doc[group_b] = np.repeat(np.arange(len(pairs)), n_b)
    return Block(a, b, np.searchsorted(common, ends_a), group_b, group_doc, len(pairs), starts_a, starts_b, len(tools.bytes_b))


# ---------------------------------------------------------------- minimal perfect hash
def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 64 bits of each key (fixed values: the finaliser of SplitMix64)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 .. n - 1 of n distinct keys: on each level the keys that have a position for themselves set its bit, the others go on.

    The number of a key is the count of set bits before its own. Keys without a bit after LEVELS levels are listed.
    """

    def __init__(self, keys: np.ndarray):
        self.sizes, words, left = [], [], keys
        while len(left) and len(self.sizes) < LEVELS:
            size = 64 * int(np.ceil(GAMMA * len(left) / 64))
            place = (_mixed(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            self.sizes.append(size)
            left = left[~alone[place]]
        self.words = np.concatenate(words) if words else np.zeros(0, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.rest = np.sort(left)
        self.n = len(keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; a key that was not hashed gets any number, or n."""
        out = np.full(len(keys), self.n)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[place[hit] >> 6] + below
            open_, base = open_[~hit], base + size
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.before[-1] + at[found]
        return out

    def ordered(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        out[self(keys)] = keys
        return out


@dataclass
class Table:
    """A shard: perfect hash, keys in its order, numbers of documents, and whether a pair has the highest number of its A id."""

    hash: PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.hash(keys)
        known = place < self.hash.n
        if not known.all() or not (self.keys[place] == keys).all():
            raise RuntimeError("a pair of the second pass was not met in the first one")
        return self.counts[place], self.best[place]


def shard_of(keys: np.ndarray, width: int, shards: int) -> np.ndarray:
    return (_mixed(keys // width, 1 << 20) % np.uint64(shards)).astype(np.int64)


def _by_shard(keys: np.ndarray, width: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys) of every shard that has some."""
    own = shard_of(keys, width, shards)
    order = np.argsort(own, kind="stable")
    found, starts = np.unique(own[order], return_index=True)
    for shard, places in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        yield shard, places


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(counts[order], starts)


def distinct_pairs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the distinct links of each text."""
    top = np.int64(1) << 40
    parts = [np.unique(doc * top + key) for doc, key, _ in block.links()]
    both = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int64)
    return both // top, both % top


# ---------------------------------------------------------------- passes over the documents
def encoded(docs: DataFrame, doc_id: str, text: str, files: tuple[str, str]) -> DataFrame:
    """(doc_id, a, b): the ids of each text as bytes."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(*files)
        for batch in batches:
            for at, texts in texts_in_blocks(batch.column(1)):
                a, b = zip(*tools.ids(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema.names)

    return cut(docs.select(doc_id, text).mapInArrow(run, schema))


def _pairs_in_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
    """(first row, ids of both) of runs of rows with about a megabyte of ids; the last two columns hold them."""
    a, b = (batch.column(batch.num_columns - side) for side in (2, 1))
    size = np.cumsum(pc.binary_length(a).to_numpy() + pc.binary_length(b).to_numpy()) // (1 << 20)
    for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size)) + 1) if batch.num_rows else ():
        yield int(rows[0]), [(a[i].as_py(), b[i].as_py()) for i in rows.tolist()]


def task_counts(tokens: DataFrame, shards: int, files: tuple[str, str]) -> DataFrame:
    """(part, shard, keys, counts): every task's distinct pairs and in how many of its documents they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(*files)
        keys, counts, held, turn = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def rows(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            own = list(_by_shard(found, len(tools.bytes_b), shards))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 20) + turn] * len(own), pa.int64()), pa.array([s for s, _ in own], pa.int32()),
                 pa.array([found[at].tobytes() for _, at in own], pa.binary()), pa.array([n[at].tobytes() for _, at in own], pa.binary())],
                ["part", "shard", "keys", "counts"])

        for batch in batches:
            for _, pairs in _pairs_in_blocks(batch):
                _, found = distinct_pairs(align(pairs, tools))
                found, n = np.unique(found, return_counts=True)
                keys.append(found)
                counts.append(n.astype(np.int64))
                held += len(found)
                if held > HELD_KEYS:
                    found, n = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [found], [n], len(found)
                    if held > HELD_KEYS // 2:
                        yield rows(found, n)
                        keys, counts, held, turn = [], [], 0, turn + 1
        if held:
            yield rows(*summed(np.concatenate(keys), np.concatenate(counts)))

    return tokens.select("_a", "_b").mapInArrow(run, "part long, shard int, keys binary, counts binary")


def _most(rows: DataFrame) -> int:
    """The largest number of rows of a shard."""
    return rows.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _dealt(rows: DataFrame, most: int, key: str = "part") -> tuple[DataFrame, int]:
    """Rows with a slot so that a (shard, slot) has about FAN of them."""
    slots = max(1, -(-most // FAN))
    return rows.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")), slots


def _tree(rows: DataFrame, merge, columns: list[str]) -> DataFrame:
    """One row a shard: `merge` unites the rows of a (shard, slot) until a shard has one slot. `columns` are binary."""
    kind = "part long, shard int, " + ", ".join(f"{c} binary" for c in columns)

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(frame["part"].min()), int(frame["shard"].iloc[0]), *merge(frame))], columns=["part", "shard", *columns])

    while True:
        dealt, slots = _dealt(rows, _most(rows))
        rows = cut(dealt.groupBy("shard", "slot").applyInPandas(step, kind))
        if slots == 1:
            return rows


def _united(frame: pd.DataFrame) -> tuple[bytes]:
    return (np.unique(np.concatenate([np.frombuffer(k, np.int64) for k in frame["keys"]])).tobytes(),)


def _added(frame: pd.DataFrame) -> tuple[bytes]:
    total = np.frombuffer(frame["counts"].iloc[0], np.int64).copy()
    for other in frame["counts"].iloc[1:]:
        total += np.frombuffer(other, np.int64)
    return (total.tobytes(),)


def pair_tables(parts: DataFrame, width: int) -> DataFrame:
    """(shard, table): a pickled `Table` for each shard that has pairs, from the rows of `task_counts`."""
    keys = _tree(parts.select("part", "shard", "keys"), _united, ["keys"])

    def build(batches):
        for frame in batches:
            frame["hash"] = [pickle.dumps(PerfectHash(np.frombuffer(k, np.int64))) for k in frame["keys"]]
            yield frame[["shard", "hash", "keys"]]

    hashes = cut(keys.mapInPandas(build, "shard int, hash binary, keys binary"))

    def dense(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"part": [], "shard": [], "counts": []})
        number = pickle.loads(right["hash"].iloc[0])
        total = np.zeros(number.n, np.int64)
        for k, n in zip(left["keys"], left["counts"], strict=True):
            total[number(np.frombuffer(k, np.int64))] += np.frombuffer(n, np.int64)  # keys of a row are distinct
        return pd.DataFrame([(int(left["part"].min()), int(left["shard"].iloc[0]), total.tobytes())], columns=["part", "shard", "counts"])

    dealt, slots = _dealt(parts, _most(parts))
    every = hashes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    vectors = dealt.groupBy("shard", "slot").cogroup(every.groupBy("shard", "slot")).applyInPandas(dense, "part long, shard int, counts binary")
    totals = _tree(cut(vectors), _added, ["counts"])

    def finish(batches):
        for frame in batches:
            out = []
            for h, k, c in zip(frame["hash"], frame["keys"], frame["counts"], strict=True):
                number, counts = pickle.loads(h), np.frombuffer(c, np.int64)
                ordered = number.ordered(np.frombuffer(k, np.int64))
                _, owner = np.unique(ordered // width, return_inverse=True)
                top = np.zeros(owner.max() + 1, np.int64)
                np.maximum.at(top, owner, counts)
                out.append(pickle.dumps(Table(number, ordered, counts, counts == top[owner])))
            yield pd.DataFrame({"shard": frame["shard"], "table": out})

    return cut(hashes.join(totals.select("shard", "counts"), "shard").mapInPandas(finish, "shard int, table binary"))


def _aligned(batch: pa.RecordBatch, at: int, pairs: list[tuple[bytes, bytes]], tools: Aligner) -> tuple[Block, dict[str, pa.Array]]:
    """A block and its columns but for the looked-up ones; the document's own columns come first in `batch`, its ids last."""
    block = align(pairs, tools)
    in_a, in_b = block.sizes()
    own = lambda values: pa.array(np.bincount(block.group_doc, weights=values, minlength=block.docs).astype(np.int64))
    columns = {batch.schema.names[i]: batch.column(i).slice(at, len(pairs)) for i in range(batch.num_columns - 2)}
    columns |= {"n_a": pa.array(np.diff(block.starts_a)), "n_b": pa.array(np.diff(block.starts_b)), "n_groups": own(np.ones(len(in_a))),
                "n_links": own((in_a * in_b).astype(float)), "groups_sha256": pa.array(block.digests(tools), pa.string())}
    return block, columns


def _summed_by_doc(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, docs, values)
    return out


def align_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", files: tuple[str, str] = (FILE_A, FILE_B), shards: int = SHARDS,
                    table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document (see the top of this file)."""
    spark = docs.sparkSession
    prepare(spark)
    width = len(aligner(*files).bytes_b)
    source = encoded(docs, doc_id, text, files)
    tables = pair_tables(cut(task_counts(source, shards, files)), width)
    head = [T.StructField(doc_id, docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
            T.StructField("groups_sha256", T.StringType())]
    size = tables.agg(F.sum(F.length("table").cast("long"))).first()[0] or 0
    if size <= table_bytes:
        # the counted size bounds what the driver and every task hold
        held = spark.sparkContext.broadcast({r.shard: r.table for r in tables.collect()})
        return _broadcast_lookup(source, held, head, width, shards, files)
    return _shard_lookup(source, tables, head, width, shards, files, doc_id)


def _broadcast_lookup(source: DataFrame, held, head: list, width: int, shards: int, files: tuple[str, str]) -> DataFrame:
    schema = T.StructType([*head, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = schema.names

    def run(batches):
        tools, opened = aligner(*files), {}
        for batch in batches:
            for at, pairs in _pairs_in_blocks(batch):
                block, columns = _aligned(batch, at, pairs, tools)
                best, total = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                for doc, key, often in block.links():
                    found, back = np.unique(key, return_inverse=True)
                    counts, top = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
                    for shard, places in _by_shard(found, width, shards):
                        if shard not in opened:
                            opened[shard] = pickle.loads(held.value[shard])
                        counts[places], top[places] = opened[shard](found[places])
                    total += _summed_by_doc(doc, often * counts[back], len(pairs))
                    best += _summed_by_doc(doc, often * top[back], len(pairs))
                columns |= {"n_best": pa.array(best), "count_sum": pa.array(total)}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return source.mapInArrow(run, schema)


def _shard_lookup(source: DataFrame, tables: DataFrame, head: list, width: int, shards: int, files: tuple[str, str], doc_id: str) -> DataFrame:
    """The second pass without a broadcast: blocks' distinct pairs meet their shard's table, sums are joined back by a row number."""
    extra = [T.StructField("part", T.LongType()), T.StructField("shard", T.IntegerType()),
             *[T.StructField(c, T.BinaryType()) for c in ("rows", "keys", "often")]]
    schema = T.StructType([*head, *extra])
    names = schema.names

    def run(batches):
        tools, number = aligner(*files), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, pairs in _pairs_in_blocks(batch):
                block, columns = _aligned(batch, at, pairs, tools)
                rows = number + np.arange(len(pairs))
                number += len(pairs)
                whole = {"part": pa.array(rows)} | columns
                yield _filled(whole, schema)
                for doc, key, often in block.links():
                    pair, n = summed(doc * (np.int64(1) << 40) + key, often)
                    doc, key = pair >> 40, pair & ((1 << 40) - 1)
                    own = list(_by_shard(key, width, shards))
                    yield _filled({"part": pa.array([int(rows[0])] * len(own), pa.int64()), "shard": pa.array([s for s, _ in own], pa.int32()),
                                   "rows": pa.array([rows[doc[p]].tobytes() for _, p in own]), "keys": pa.array([key[p].tobytes() for _, p in own]),
                                   "often": pa.array([n[p].tobytes() for _, p in own])}, schema)

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"part": [], "n_best": [], "count_sum": []})
        table = pickle.loads(right["table"].iloc[0])
        rows, keys, often = (np.concatenate([np.frombuffer(v, np.int64) for v in left[c]]) for c in ("rows", "keys", "often"))
        counts, top = table(keys)
        found, back = np.unique(rows, return_inverse=True)
        return pd.DataFrame({"part": found, "n_best": _summed_by_doc(back, often * top, len(found)),
                             "count_sum": _summed_by_doc(back, often * counts, len(found))})

    both = cut(source.mapInArrow(run, schema))
    pieces = both.filter("shard IS NOT NULL").select("part", "shard", "rows", "keys", "often")
    dealt, slots = _dealt(pieces, _most(pieces))
    every = tables.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    sums = dealt.groupBy("shard", "slot").cogroup(every.groupBy("shard", "slot")).applyInPandas(look, "part long, n_best long, count_sum long")
    sums = sums.groupBy("part").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = both.filter("shard IS NULL").join(sums, "part", "left")
    filled = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(doc_id, *COUNTS, "groups_sha256", filled("n_best"), filled("count_sum"))


def _filled(columns: dict[str, pa.Array], schema: T.StructType) -> pa.RecordBatch:
    """A batch of the schema with nulls in the columns that are not given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n = len(next(iter(columns.values())))
    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in target], target.names)
