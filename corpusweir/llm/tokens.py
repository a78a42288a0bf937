"""Token ids of whole texts by a public tokenizer file, word by word.

The tokenizers used here drop white space and never merge across it, so the ids of a
text are those of its white-space separated pieces in order.  Pieces repeat, so each
worker keeps the ids of those it has met; a full store is emptied.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

#: Pieces and words a worker keeps; when full, the half it met last goes, as frequent ones come early.
STORE = 400_000
#: Pieces longer than this are encoded each time and not kept.
LONGEST_KEPT = 64
#: Marks that may end a piece.  After a letter or a digit they are tokens of their own.
MARKS = ".,!?;:*#&$%|"
#: White space to Python alone.
CONTROL = re.compile("[\x1c-\x1f\x85]")


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where a tokenizer file of the installed package lies; any file of the same library will do."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read where the driver runs; a few megabytes that travel to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


@lru_cache(maxsize=2)
def word_tokens(definition: str) -> WordTokens:
    """One store per worker process, kept from task to task."""
    return WordTokens(definition)


def foldable(text: str) -> bool:
    """Whether lowering a text before the tokenizer does it changes nothing."""
    if "<|" in text:
        return False  # may be the name of a special token
    if text.isascii():
        return not CONTROL.search(text)
    low = text.lower()
    return (
        "\u03a3" not in text and len(low) == len(text) and unicodedata.is_normalized("NFC", text)
        and unicodedata.is_normalized("NFC", low) and not CONTROL.search(text)
    )


class WordTokens:
    """Ids as little-endian 32-bit bytes."""

    def __init__(self, definition: str):
        self.tokenizer = _tokenizer(definition)
        self.pieces: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def fresh(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of every text; the pieces that are new in any of them are learnt together."""
        split = [t.lower().split() if foldable(t) else None for t in texts]
        kept = self.pieces
        new = set().union(*[words for words in split if words]).difference(kept)
        if new:
            self.learn(list(new))
        out = [
            self.fresh([t])[0] if words is None else b"".join(map(kept.__getitem__, words))
            for t, words in zip(texts, split, strict=True)
        ]
        if new:
            for w in new:
                if len(w) > LONGEST_KEPT:
                    del kept[w]
            for store in (kept, self.cores):
                if len(store) > STORE:
                    for w in list(store)[STORE // 2 :]:
                        del store[w]
        return out

    def learn(self, new: list[str]) -> None:
        """Ids of pieces: those of the word and of the marks that end it."""
        cores = self.cores
        plain, tailed = [], []
        for piece in new:
            core = piece.rstrip(MARKS)
            if len(core) < len(piece) and core and core[-1].isalnum():
                tailed.append((piece, core))
            else:
                plain.append(piece)
        wanted = set(plain)
        wanted.update([core for _, core in tailed])
        wanted.update([piece[len(core) :] for piece, core in tailed])
        missing = list(wanted.difference(cores))
        cores.update(zip(missing, self.fresh(missing), strict=True))
        self.pieces.update(zip(plain, map(cores.__getitem__, plain), strict=True))
        for piece, core in tailed:
            self.pieces[piece] = cores[core] + cores[piece[len(core) :]]
        for core in missing:
            if len(core) > LONGEST_KEPT:
                del cores[core]
