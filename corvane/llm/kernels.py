"""Text kernels in numpy: whole batches at once, no Python loop over characters or words."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit (Unicode L or N); its lower case, where that is one code point."""
    n = sys.maxunicode + 1
    word = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(n)), bool, n)
    low = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(word):
        c = chr(i).lower()
        if len(c) == 1:
            low[i] = ord(c)
    return word, low


@cache
def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2^64."""
    out = np.full(n, _GOLD, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by a line end, and where each text starts (one more at the end)."""
    texts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum(lengths)])


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (maximal runs of letters and digits, lower-cased) and each text's first word's index."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    is_word, low = tables()
    cp, starts = code_points(texts)
    ok = is_word[cp]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1]
    at = np.flatnonzero(begin)  # where words begin
    per_text = np.searchsorted(at, starts)
    if not len(at):
        return np.empty(0, np.uint64), per_text
    chars = low[cp[ok]]
    first = np.flatnonzero(begin[ok])
    lengths = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    value = (chars.astype(np.uint64) + np.uint64(0x51ED27)) * powers(1 << max(6, int(lengths.max() - 1).bit_length()))[place]
    return mix(np.add.reduceat(value, first) ^ (lengths.astype(np.uint64) * _M2)), per_text


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct runs of ``size`` words as sorted 64-bit hashes, and where each text's start.

    A text of fewer words is one run of all of them; a text without a word has none.
    """
    w, first = words(texts)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), counts)
    offset = np.concatenate([[0], np.cumsum(counts)])
    at = first[owner] + (np.arange(len(owner)) - offset[owner])
    h = np.zeros(len(owner), np.uint64)
    for i in range(size):
        has = at + i < first[owner + 1]
        step = np.where(has, w[np.minimum(at + i, max(len(w) - 1, 0))] if len(w) else np.uint64(0), np.uint64(0x1234567 + i))
        h = mix(h * _GOLD + step)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))
