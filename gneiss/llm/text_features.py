"""Hashed features of texts, with a bounded memory of word hashes."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Words, and runs of punctuation.
TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Odd constants that tell the kinds of n-gram apart.
PAIR, SKIP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
MEMORY = 500_000


class Hashes(dict):
    """crc32 by word; forgets everything when it holds too much."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Words(Hashes):
    """By word the crc32 of its lower-cased form, and above it two bits: all capitals, all letters."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) | word.isupper() << 32 | word.isalpha() << 33
        return h


LOW = np.uint64(0xFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def ngram_ids(h: np.ndarray, dims: int, skip: bool) -> np.ndarray:
    """Distinct buckets of unigrams and bigrams, and with ``skip`` of pairs around one word."""
    parts = [mixed(h), mixed(h[:-1] * PAIR + h[1:])]
    if skip:
        parts.append(mixed(h[:-2] * SKIP + h[2:] * PAIR))
    return np.unique((np.concatenate(parts) & np.uint64(dims - 1)).astype(np.int32))


def style_bins(text: str, codes: np.ndarray) -> list[int]:
    """One bin, of eight, for each trait of a text's surface; ``codes`` are those of ``Words``."""
    n, m = max(len(text), 1), max(len(codes), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    upper, plain = np.count_nonzero(codes >> np.uint64(32) & np.uint64(1)), np.count_nonzero(codes >> np.uint64(33))
    h = codes & LOW
    same, ordered = np.count_nonzero(h[1:] == h[:-1]), np.sort(h)
    kinds = np.count_nonzero(ordered[1:] != ordered[:-1]) + (len(h) > 0)
    shares = [
        upper / m,
        1 - plain / m,
        same / m,
        1 - kinds / m,
        1 - len(set(lines)) / max(len(lines), 1),
        n / m / 32,
        min(np.log2(m) / 20, 1.0),
    ]
    return [8 * i + min(int(s * 8), 7) for i, s in enumerate(shares)]


#: Number of style features.
STYLES = 56
