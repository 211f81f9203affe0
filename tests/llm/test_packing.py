import itertools
import random
import zlib

import numpy as np
from conftest import edge_rows

from vectorloom.llm import packing, tokens


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        items = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 9))), reverse=True)
        room = rng.randint(0, 90)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        counts = {x: items.count(x) for x in items}
        got = packing.fullest(list(counts.items()), room)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 60)}
    plan = packing.slack_plan(histogram, 100)
    used = {}
    for combination, times in plan:
        assert sum(k * n for k, n in combination.items()) <= 100
        for k, n in combination.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram
    rooms = []  # first fit, longest first
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(100 - length)
        else:
            rooms[at] -= length
    assert sum(t for _, t in plan) <= len(rooms)


def test_tokenizer_equals_the_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    plain.encode_special_tokens = True
    odd = ["", "Don't we'll I'M '''s x'sy 's", "İstanbul ΣΑΣ ﬁ ẞ", "a\tb\x0bc\x85d\u2003e\x1cf", "ªº²³ 12a3", "日本語 тест", "<|endoftext|>", "é café \u0301x"]
    texts = odd + [r[1] or "" for r in edge_rows()]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.WordTokenizer().encode(texts)] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences(edges, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 5)
    rows = packing.pack_documents(edges, with_ids=True).collect()
    words = tokens.WordTokenizer()
    want = sorted((r[0] if r[0] is not None else -1, words.encode([r[1] or ""])[0] + bytes(4)) for r in edge_rows())
    texts, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        data = np.array(r.ids, "<u4").tobytes()
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(data) and r.start == 2048 * r.piece
        texts.setdefault((r.doc_id if r.doc_id is not None else -1, r.piece), []).append(data)
    assert sorted(d for (_, _), v in texts.items() for d in v) == sorted(x[i:i + 8192] for _, x in want for i in range(0, len(x), 8192))
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert [o for o, _ in places] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_no_rows(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_added_tokens_keep_their_ids(written):
    """The ids of the queries equal those of the file's tokenizer as it is loaded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b\n\n<|startoftext|>Don't", "<|endoftext|><|endoftext|>", "<|EndOfText|> <|endoftext |>", "",
             "日本語<|startoftext|> é x"] + [r[1] or "" for r in edge_rows()]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.tokenizer().encode(texts)] == want and 49407 in want[0]
    rows = packing.pack_documents(written(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*ids, packing.END_ID] for i, ids in enumerate(want)}
