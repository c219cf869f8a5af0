"""Fast exact encoding by a tokenizers file that splits texts into words first (NFC, lower case, byte-level word pieces).

Texts made of ASCII and Latin letters go through a cached table of words; any other text, and any that holds
a special token's string, is encoded by the library itself. Both give the same ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Words kept in a worker's table before it starts anew: bounds memory to some 150 MB.
CACHE_WORDS = 600_000

# What the file's own split pattern matches among the characters of the fast path, after lower-casing.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\t-\\r \xa0a-z0-9ªµºß-öø-ſ²³¹¼-¾]+")
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
# Characters that leave the fast path.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7e\xa0-įı-ſ]")
_ODD = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """encode(text): the ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = [x.lower() for x in special]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = split[0].get("pattern", {}).get("Regex", "")
        # only this kind of file has the fast path
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d|")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.table: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isalnum() and word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return np.asarray([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        low = text.lower()
        if not self.fast or any(map(low.__contains__, self.special)):
            return self._slow(text)
        if text.isascii():
            if any(map(low.__contains__, _ODD)):
                return self._slow(text)
            words = _ASCII.findall(low)
        elif _OTHER.search(text):
            return self._slow(text)
        else:
            words = _WORD.findall(low)
        table = self.table
        try:
            return b"".join(map(table.__getitem__, words))
        except KeyError:
            if len(table) > CACHE_WORDS:
                table.clear()
            for w in set(words).difference(table):
                table[w] = self._word(w)
            return b"".join(map(table.__getitem__, words))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
