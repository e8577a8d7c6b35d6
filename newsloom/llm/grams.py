"""Sets of neighbouring characters of many short texts at once, and sketches of them.

All functions take a batch of keys and work on flat arrays; nothing loops over the characters of a text in Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WIDTH = 3
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Grams:
    """Distinct grams of a batch: hashes by text, where each text's begin, and how many it has (at least one)."""

    hashes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def grams_of(keys: list[str], width: int = WIDTH) -> Grams:
    """Distinct grams of keys, each of at least `width` characters."""
    flat = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    lengths = np.fromiter(map(len, keys), "int64", len(keys))
    h = np.zeros(len(flat) - width + 1, "uint64")
    for i in range(width):
        h = mix(h * np.uint64(31) + flat[i : len(flat) - width + 1 + i] + np.uint64(i + 1))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(keys)), lengths)
    at = np.arange(len(h))
    inside = at + width <= ends[owner[: len(h)]]
    h, owner = h[inside], owner[: len(h)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    counts = np.bincount(owner, minlength=len(keys))
    return Grams(h, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)


@lru_cache(maxsize=16)
def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))


def minhash(g: Grams, n: int) -> np.ndarray:
    """n 32-bit MinHash values of each text, as an array (n, texts)."""
    out = np.empty((n, len(g.starts)), "uint32")
    for i, s in enumerate(_seeds(n)):
        x = (g.hashes ^ s) * (s | np.uint64(1))
        out[i] = np.minimum.reduceat(((x ^ (x >> np.uint64(29))) * _M1 >> np.uint64(32)).astype("uint32"), g.starts)
    return out


def odd_sketch(g: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmap of 128 bits of each text's grams, as two halves; their XOR is the bitmap of 64 bits.

    The bitmaps of two texts differ in at most as many bits as their sets differ in grams, for a gram that both have
    flips the same bit in both. So the number of differing bits is a lower bound of the sets' difference.
    """
    h = mix(g.hashes ^ np.uint64(0x5851F42D4C957F2D))
    bit, high = np.uint64(1) << (h >> np.uint64(58)), (h & np.uint64(1)).astype(bool)
    zero = np.uint64(0)
    return np.bitwise_xor.reduceat(np.where(high, zero, bit), g.starts), np.bitwise_xor.reduceat(np.where(high, bit, zero), g.starts)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """32-bit keys of bands of `rows` MinHash values each, as an array (bands, texts)."""
    bands = len(values) // rows
    out = np.empty((bands, values.shape[1]), "uint32")
    for b in range(bands):
        x = np.full(values.shape[1], b + 1, "uint64")
        for v in values[b * rows : (b + 1) * rows]:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + v.astype("uint64"))
        out[b] = (x >> np.uint64(32)).astype("uint32")
    return out


def similarity(a: str, b: str, width: int = WIDTH) -> float:
    """Jaccard similarity of the gram sets of two keys."""
    s, t = ({k[i : i + width] for i in range(len(k) - width + 1)} for k in (a, b))
    both = len(s & t)
    return both / (len(s) + len(t) - both) if s or t else 0.0
