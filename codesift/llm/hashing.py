"""Hashes of words and word runs, a batch of texts at a time.

The hash of a word is a polynomial over random values of its bytes, taken from
one running sum over the whole batch, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * _M1
        x = x ^ (x >> np.uint64(27))
        x = x * _M2
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _M3)


def _class_table(keep: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(low) : ord(high) + 1] = True
    if keep == "word":
        table[ord("_")] = True
    return table


_TABLES = {keep: _class_table(keep) for keep in ("alnum", "word")}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """BASE ** 0..n modulo 2**64."""
    global _powers
    while len(_powers) <= n:
        with np.errstate(over="ignore"):
            step = _powers[-1] * BASE
            _powers = np.concatenate([_powers, _powers * step])
    return _powers


def flat_word_hashes(texts: list[str], keep: str, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    inside = _TABLES[keep][data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]  # the last byte is never inside
    values = BYTE_VALUES[_FOLD[data] if fold else data]
    total = np.zeros(len(starts), dtype=np.uint64)
    lengths = ends - starts
    # words are short: one step per byte position over the words that are that long
    order = np.argsort(-lengths, kind="stable")
    ranked, begin = lengths[order], starts[order]
    running = np.zeros(len(order), dtype=np.uint64)
    with np.errstate(over="ignore"):
        alive, at = len(order), 0
        while alive and at < 64:
            running[:alive] = running[:alive] * BASE + values[begin[:alive] + at]
            at += 1
            alive = int(np.searchsorted(-ranked, -at, side="left"))
    total[order] = running
    for i in np.flatnonzero(lengths > 64):  # the rest of long words
        rest = values[starts[i] + 64 : ends[i]]
        power = _power(len(rest))
        with np.errstate(over="ignore"):
            total[i] = total[i] * power[len(rest)] + np.sum(rest * power[len(rest) - 1 :: -1][: len(rest)], dtype=np.uint64)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return mix(total), np.diff(np.searchsorted(starts, bounds), prepend=0)


def word_hashes(texts: list[str], keep: str = "word", fold: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """The word hashes of each text, and their numbers."""
    flat, counts = flat_word_hashes(texts, keep, fold)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else [], counts


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, in order."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _M3 + words[j : j + len(out)]
    return mix(out)
