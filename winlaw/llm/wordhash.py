"""64-bit hashes of all words of a batch of texts, computed on whole Arrow buffers.

A word's hash is a polynomial of its bytes modulo 2^64, taken as a difference of
running sums, times the inverse power that makes it independent of its place,
and then mixed. No Python string is made.
"""

from __future__ import annotations

import numpy as np

from .common import worker_cache

BASE = 0xD6E8FEB86659FD93
ROW = np.uint64(0x9E3779B97F4A7C15)
SPACE = [0x20, *range(0x09, 0x0E)]
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and all of UTF-8 beyond ASCII; and the rest but white space.
ALNUM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
KINDS = {
    "space": ~np.isin(np.arange(256), SPACE),
    "alnum": np.isin(np.arange(256), ALNUM),
    "marks": ~np.isin(np.arange(256), [*SPACE, *ALNUM]),
}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: shifts, xors and odd multipliers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xCA9B0C7EBA1DA115)
    return x ^ (x >> np.uint64(29))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, dict]:
    cache = worker_cache("wordhash")
    if len(cache.get("pow", ())) < n:
        size = max(n, (1 << 18) + (1 << 16))
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            cache[name] = np.multiply.accumulate(p)
        low = np.arange(1, 257, dtype=np.uint64)
        low[65:91] += np.uint64(32)
        cache["low"], cache["same"] = low, np.arange(1, 257, dtype=np.uint64)
    return cache["pow"], cache["inv"], cache


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the values between offsets, words being runs of bytes of KINDS[kind]: hash of each word, first word of each value (n + 1), start and end byte of each word in data."""
    o0, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    p, inv, cache = _tables(n + 1)
    b = data[o0 : o0 + n]
    w = np.zeros(n + 2, bool)
    w[1:-1] = KINDS[kind][b]
    brk = np.zeros(n + 1, bool)
    brk[offsets - o0] = True
    starts = np.flatnonzero(w[1:] & (brk | ~w[:-1]))
    ends = np.flatnonzero(w[:-1] & (brk | ~w[1:]))
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(cache["low" if lower else "same"][b] * p[:n], out=run[1:])
    h = mix((run[ends] - run[starts]) * inv[starts])
    return h, np.searchsorted(starts, offsets - o0), starts + o0, ends + o0


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; the caller masks those that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= ROW
        acc += h[j : j + n]
    return mix(acc)


def long_grams(h: np.ndarray, k: int) -> np.ndarray:
    """As grams(), by differences of running sums: the same work for every k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv, _ = _tables(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=run[1:])
    return mix((run[k:] - run[:-k]) * inv[:n] + np.uint64(k))
