"""Token ids of whole texts with a public tokenizer's vocabulary file, inside tasks.

The file (its name is a parameter; nothing is copied or trained) drops white space and splits words before its merges, so that the
ids of a text are the ids of its pieces, one after the other. Pieces repeat: each Python worker keeps the ids of the pieces that it
has met in a bounded table and asks the tokenizer for new ones only, many at a time. Texts with characters outside the plain Latin
ranges, whose normal form and lower case could depend on their neighbours, go to the tokenizer unsplit.

The file's added tokens (<|startoftext|>, <|endoftext|>) are matched on the raw text and may touch other words: texts that hold one go
to the tokenizer as a whole, which gives it its own id. With `plain_text` they are text like any other.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: The vocabulary file of the queries and the pieces that one worker remembers.
VOCABULARY, REMEMBERED = "word_bpe_49k.json", 600_000

#: Chunks of these characters (ASCII and letters of Latin-1, without feminine and masculine signs) are split here.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
#: Fixed value: the piece pattern of the file, for such chunks in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordTokenizer:
    """ids(text) as unsigned 32-bit little-endian bytes, equal to the file's own encoding without special tokens around it."""

    def __init__(self, name: str = VOCABULARY, plain_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        if plain_text:
            self.tokenizer.encode_special_tokens = True
        added = [] if plain_text else list(self.tokenizer.get_added_tokens_decoder().values())
        # as the file has them, added tokens are looked for in the raw text; the empty string is in every text
        self.added = ["" if token.normalized else token.content for token in added]
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Every piece of a plain chunk ends in one end-of-word token, by which the ids of joined pieces are cut again."""
        for first in range(0, len(pieces), 4096):
            part = pieces[first:first + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                for piece in part:
                    self.pieces[piece] = self._whole(piece)
                continue
            data, at = ids.tobytes(), 0
            for piece, stop in zip(part, stops.tolist(), strict=True):
                self.pieces[piece] = data[4 * at:4 * stop]
                at = stop

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        known = self.chunks
        whole = {i: self._whole(text) for i, text in enumerate(texts) if any(token in text for token in self.added)}
        split = [[] if i in whole else text.replace("\n", " ").split(" ") for i, text in enumerate(texts)]
        new = {c for chunks in split for c in chunks if c not in known}
        plain = {c: _PIECE.findall(c.lower()) for c in new if _PLAIN.match(c)}
        self._learn_pieces([p for p in {p for parts in plain.values() for p in parts} if p not in self.pieces])
        for chunk in new:
            known[chunk] = b"".join([self.pieces[p] for p in plain[chunk]]) if chunk in plain else self._whole(chunk)
        return [whole[i] if i in whole else b"".join([known[c] for c in chunks]) for i, chunks in enumerate(split)]


@lru_cache(maxsize=2)
def tokenizer(name: str = VOCABULARY) -> WordTokenizer:
    """The worker's tokenizer; it lives as long as the Python worker."""
    return WordTokenizer(name, plain_text=False)
