import hashlib
import random
from collections import Counter

from conftest import edge_rows, prose

from vectorloom.llm import suffix_dedup


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())


def test_edges_and_other_columns(edges):
    assert found(edges) == brute([r[1] for r in edge_rows()])
    kept = suffix_dedup.remove_repeats(edges)
    assert kept.columns[:len(edges.columns)] == edges.columns


def test_planted_passages_at_all_offsets(written, monkeypatch):
    rng = random.Random(1)
    passage = prose(rng, 120)
    texts = [prose(rng, rng.randint(1, 90)) + passage[rng.randint(0, 300):rng.randint(350, len(passage))] + prose(rng, rng.randint(0, 60)) for _ in range(40)]
    texts += ["xy" * 300, "z" * 199, "z" * 200, "q" * 201, "äöü" * 120, "äöü" * 90 + "w"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = written(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(texts)
    assert found(docs) == want
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)  # positions in many runs: counted by name over all tasks
    assert found(docs) == want


def test_no_rows(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_ranks():
    import numpy as np

    from vectorloom.llm.difference_cover import repeated_prefixes, suffix_ranks

    rng = random.Random(3)
    for _ in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))
        need = rng.choice([1, 2, 5, 9, 100])
        ranks = suffix_ranks(np.frombuffer(text, np.uint8).astype(np.int64) + 1, need)
        for i in range(len(text)):
            for j in range(len(text)):
                if text[i:i + need] < text[j:j + need]:
                    assert ranks[i] < ranks[j]
        starts = np.array([i for i in range(len(text)) if i + need <= len(text)], np.int64)
        want = [sum(text[i:i + need] == text[j:j + need] for j in starts) > 1 for i in starts]
        assert repeated_prefixes(np.frombuffer(text, np.uint8), starts, need).tolist() == want
