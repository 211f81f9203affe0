"""Cross-tokenizer alignment against brute force; the perfect hash; both ways of looking up."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import edge_rows, prose

from vectorloom.llm import token_alignment as ta

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts() -> list[str]:
    rng = random.Random(3)
    return ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ under ▁▁ lines", "a" * 3000, " " * 700 + "x", "\x00\x01 nul   \xa0", "日本語のテキスト " * 20,
            "😀👍🏽 é ﬁ Ⅷ", "don't we'll I'M they're", " lead and trail ", "\n\n\n", "".join(rng.choice("ab日é😀 \n") for _ in range(2000)),
            "".join(chr(rng.randrange(0x400, 0x3000)) for _ in range(800)), "<0x0A>", "x" * 50 + "1234567" * 30]


def brute(texts):
    """The contract, word by word, with the vocabulary files' own libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def groups(text):
        whole = f" {text}".encode()
        a = a_tool.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_tool.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return []
        ends = [set(), set()]
        for side, parts in enumerate((a_bytes, b_bytes)):
            at = 0
            for part in parts:
                at += len(part)
                ends[side].add(at)
        common = sorted(ends[0] & ends[1])
        out = defaultdict(lambda: ([], []))
        for side, (ids, parts) in enumerate(((a, a_bytes), (b, b_bytes))):
            at = 0
            for i, part in zip(ids, parts):
                at += len(part)
                out[bisect_left(common, at)][side].append(i)
        return [out[e] for e in sorted(out)]

    aligned = [groups(t) for t in texts]
    count = Counter(p for g in aligned for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for g in aligned:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links),
                     sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    number = ta.PerfectHash(keys)
    assert sorted(number(keys).tolist()) == list(range(len(keys)))
    assert (number.ordered(keys)[number(keys)] == keys).all()
    assert (number(np.array([1 << 41, (1 << 41) + 7])) <= len(keys)).all()


def test_keys_without_a_level_are_listed(monkeypatch):
    monkeypatch.setattr(ta, "LEVELS", 1)
    keys = np.arange(0, 9000, 3)
    number = ta.PerfectHash(keys)
    assert len(number.rest) and sorted(number(keys).tolist()) == list(range(len(keys)))
    table = ta.Table(number, number.ordered(keys), np.ones(len(keys), np.int64), np.ones(len(keys), bool))
    table(keys)
    with pytest.raises(RuntimeError):
        table(np.array([4]))


def test_groups_with_many_links(monkeypatch):
    texts = [t.encode() for t in odd_texts() + [prose(random.Random(1), 300)]]
    pairs = list(ta.aligner().ids(texts))
    block = ta.align(pairs, ta.aligner())
    plain = Counter()
    for doc, key, often in block.links():
        for d, k, m in zip(doc.tolist(), key.tolist(), often.tolist()):
            plain[d, k] += m
    monkeypatch.setattr(ta, "GROUP_LINKS", 3)
    monkeypatch.setattr(ta, "STEP_LINKS", 5)
    counted = Counter()
    for doc, key, often in ta.align(pairs, ta.aligner()).links():
        for d, k, m in zip(doc.tolist(), key.tolist(), often.tolist()):
            counted[d, k] += m
    assert plain == counted and sum(plain.values()) > 1000


@pytest.mark.parametrize("shards, table_bytes", [(ta.SHARDS, ta.TABLE_BYTES), (7, 0)])
def test_alignment_equals_brute_force(spark, written, monkeypatch, shards, table_bytes):
    monkeypatch.setattr(ta, "FAN", 2)  # several levels of the trees
    rng = random.Random(9)
    texts = odd_texts() + [prose(rng, rng.randrange(1, 120), i % 2) for i in range(60)] + ["", None, "same text", "same text"]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, "another text of one id")]
    docs = written([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part long, keys int").repartition(5)
    path = f"{spark.sparkContext.getCheckpointDir()}/align-{shards}"
    docs.write.mode("overwrite").parquet(path)
    got = ta.align_documents(spark.read.parquet(path), shards=shards, table_bytes=table_bytes)
    assert got.columns[0] == "doc_id" and set(got.columns) == set(COLUMNS)
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in got.select(COLUMNS).collect()], key=key) == sorted(want, key=key)


def test_edges(edges, nothing):
    rows = ta.align_documents(edges).collect()
    assert len(rows) == len(edge_rows())
    told = {r.doc_id: r for r in rows}
    assert all(told[i].n_links == 0 and told[i].groups_sha256 == "" for i in (100, 101)) and told[106].n_a > 30_000
    assert ta.align_documents(nothing).count() == 0


def test_a_wrong_key_is_found():
    keys = np.arange(100, 200)
    number = ta.PerfectHash(keys)
    table = ta.Table(number, number.ordered(keys), np.ones(100, np.int64), np.ones(100, bool))
    assert table(keys)[0].sum() == 100
    with pytest.raises(RuntimeError):
        table(np.array([5]))
