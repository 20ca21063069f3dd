"""Normalised tokens of whole batches of texts as 64-bit numbers, computed with numpy.

A Han character is a token, a run of other letters and digits is one. Case, width forms, traditional characters, white
space and punctuation make no difference.
"""

from __future__ import annotations

import unicodedata

import numpy as np

R = np.uint64(0x9E3779B97F4A7C15)
R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
HAN = 1 << 30
STOPS = np.array([ord(x) for x in "。！？!?\n."], np.uint32)


def char_table(simplify: dict[str, str]) -> np.ndarray:
    """For each character its normal form: 0 separates, Han characters have the HAN bit."""
    out = np.zeros(0x30000, np.uint32)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        n = unicodedata.normalize("NFKC", ch).lower()
        if len(n) != 1:
            n = ch.lower() if len(ch.lower()) == 1 else ch
        n = simplify.get(n, n)
        o = ord(n)
        if 0x3400 <= o <= 0x9FFF or 0x20000 <= o < 0x30000:
            out[c] = o | HAN
        elif n.isalnum():
            out[c] = o
    return out


class Tokens:
    """Token hashes of a batch with the text each belongs to and its span of characters in that text."""

    def __init__(self, texts: list[str | None], table: np.ndarray):
        texts = [t or "" for t in texts]
        raw = [t.encode("utf-32-le", "replace") for t in texts]
        lens = np.fromiter((len(r) // 4 + 1 for r in raw), np.int64, len(raw))
        begin = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lens, out=begin[1:])
        code = np.frombuffer(b"\0\0\0\0".join(raw) + b"\0\0\0\0", np.uint32)
        c = table[np.minimum(code, len(table) - 1)]
        word = c > 0
        han = c >= HAN
        first = word.copy()
        first[1:] &= ~(word[:-1] & ~han[:-1] & ~han[1:])
        last = word.copy()
        last[:-1] &= ~(word[1:] & ~han[1:] & ~han[:-1])
        a, z = np.flatnonzero(first), np.flatnonzero(last)
        value = c.astype(np.uint64) * MIX
        value ^= value >> np.uint64(29)
        power = np.full(len(c), R, np.uint64)
        if len(power):
            power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(value * power, out=total[1:])
        inverse = np.full(len(c), R_INV, np.uint64)
        if len(inverse):
            inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        h = (total[z + 1] - total[a]) * inverse[a]
        h ^= h >> np.uint64(32)
        h *= MIX
        self.hash = h ^ (h >> np.uint64(29))
        self.han = c[a] >= HAN
        self.text = np.searchsorted(begin, a, "right") - 1
        self.start, self.end = a - begin[self.text], z + 1 - begin[self.text]
        stop = np.isin(code, STOPS)
        stop[begin[1:] - 1] = True  # a text ends a sentence too
        self.sentence = np.cumsum(stop)[a]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n tokens within a text, and the place of the first token of each."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = self.hash[:k].copy()
        for j in range(1, n):
            g *= R
            g += self.hash[j : j + k]
        g ^= g >> np.uint64(31)
        at = np.flatnonzero(self.text[:k] == self.text[n - 1 :])
        return g[at], at

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words and of pairs of neighbouring Han characters, and the first token of each."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pair = np.zeros(n, bool)
        pair[:-1] = self.han[:-1] & self.han[1:] & (self.text[:-1] == self.text[1:]) & (self.end[:-1] == self.start[1:])
        f = self.hash.copy()
        f[:-1] = np.where(pair[:-1], self.hash[:-1] * R + self.hash[1:], f[:-1])
        at = np.flatnonzero(pair | ~self.han)
        return f[at], at
