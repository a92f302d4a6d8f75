"""Words and their hashes, as the text operators see them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
#: Word hashes that a worker holds.
MEMO = 1_000_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """63-bit hashes of words, computed once per worker; emptied when it holds ``MEMO``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A strong 64-bit mixing of unsigned integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash per run of ``size`` words; a shorter text is one run, an empty one has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out ^ words[i : len(words) - size + 1 + i], i + 1)
    return out


#: Runs of the letters a to z, digits, and all that is not ASCII, in UTF-8.
_PLAIN = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text whose words are held at once.
BLOCK = 1 << 20


def plain_words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in blocks; only A to Z are lower-cased."""
    text, at = (text or b"").lower(), 0
    while at < len(text):
        found = _BREAK.search(text, min(at + BLOCK, len(text)))
        end = found.start() if found else len(text)
        words = _PLAIN.findall(text, at, end)
        if words:
            yield words
        at = end
