"""Token ids of a public vocabulary, one text at a time, inside tasks."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np
import public_tokenizers
import regex

WORD_BPE = "word_bpe_49k.json"
# Words kept by a worker; when full, the memory starts anew.
REMEMBERED = 500_000

# How this vocabulary splits text, and the characters that stand for bytes in byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[int, int]:
    """The character of each byte: printable ones stand for themselves, the others follow from 256 on."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {b: b for b in PRINTABLE} | {b: 256 + k for k, b in enumerate(rest)}


class _Words(dict):
    """Ids of words, as little-endian 32-bit numbers, found when first asked for."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.ids_of(word)
        return found


class WordBpe:
    """The ids that the library gives for a text, remembered by word.

    The vocabulary drops white space and no token spans it, so a text's ids are those of its words in order.  A word
    of Latin letters goes to the library's model directly; any other goes through the library's whole chain.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(PIECES)
        self.characters = byte_characters()
        self.plain = _Words(self._plain_ids)
        self.any = _Words(self._any_ids)

    def _plain_ids(self, word: str) -> bytes:
        if not word.isalpha():
            parts = self.pieces.findall(word)
            if parts != [word]:
                return b"".join(self.plain[p] for p in parts)
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _any_ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` without special tokens, as little-endian unsigned 32-bit numbers."""
        if _is_plain(text):
            return b"".join(map(self.plain.__getitem__, text.lower().split()))
        # Composition first, as it could reach over no white space anyway but is cheaper once.
        return b"".join(map(self.any.__getitem__, _BLANK.split(unicodedata.normalize("NFC", text))))


_BLANK = re.compile(r"[ \t\n\r\f\v]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]|<\|")


def _is_plain(text: str) -> bool:
    """Latin-1 text has one lower-case form whatever stands around, and is composed already."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return _SEPARATORS.search(text) is None


@cache
def word_bpe(path: str | None = None) -> WordBpe:
    """The worker's encoder for the vocabulary file at ``path``."""
    return WordBpe(path or public_tokenizers.path(WORD_BPE))
