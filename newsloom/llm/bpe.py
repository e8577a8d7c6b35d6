"""Byte-level BPE over many pieces of text at once.

A piece is encoded by merging, again and again, its leftmost neighbouring pair of the smallest rank. A segment tree over
the piece's byte positions holds the smallest (rank, position) of every range, so the root names the next merge and a
merge changes three leaves, each by updates along one path to the root. The trees of all pieces of one size are rows of
one array: a step performs the next merge of every piece that has one, in a fixed number of array operations.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import regex

#: How the tokenizer cuts a text into pieces; no merge crosses a cut.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int64(2**62)
_POS_BITS = 32
#: Cells of the trees that are worked on at once.
CELLS = 1 << 21


class Bpe:
    """Encoder of a vocabulary of ranked byte strings (file of lines "base64 rank")."""

    def __init__(self, path: str, memory: int = 400_000) -> None:
        lines = map(bytes.split, Path(path).read_bytes().splitlines())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], "int64")
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a << 20 | b] = rank
        codes = np.fromiter(pairs, "int64", len(pairs))
        order = np.argsort(codes)
        values = np.fromiter(pairs.values(), "int64", len(pairs))
        self._build(codes[order], values[order])
        self.cut = regex.compile(PIECES)
        self.memory = memory
        self._forget()

    def _build(self, codes: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of pair -> rank that is probed for whole arrays."""
        bits = int(len(codes) * 2.5).bit_length()
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._vals = np.full(1 << bits, -1, "int64"), np.full(1 << bits, NEVER, "int64")
        at, todo = self._slot(codes), np.arange(len(codes))
        while len(todo):
            free = todo[self._keys[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self._keys[at[won]], self._vals[at[won]] = codes[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self._mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype("int64")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; NEVER where the vocabulary has no such pair."""
        codes = left << 20 | right
        at = self._slot(codes)
        got = self._keys[at]
        out = np.where(got == codes, self._vals[at], NEVER)
        todo = np.flatnonzero((got != codes) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self._mask
            got = self._keys[at[todo]]
            hit = got == codes[todo]
            out[todo[hit]] = self._vals[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        sizes = np.fromiter(map(len, pieces), "int64", len(pieces))
        width = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype("int64"))
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            for lo in range(0, len(at), max(1, CELLS // int(w))):
                own = at[lo : lo + max(1, CELLS // int(w))]
                for i, ids in zip(own, self._merge_rows([pieces[i] for i in own], int(w))):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], w: int) -> list[np.ndarray]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), "int64", n)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), "u1")]
        rows = np.repeat(np.arange(n), sizes)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = np.full((n, w + 1), -1, "int64")
        tok[rows, cols] = flat
        after = np.arange(1, w + 1, dtype="int64") + np.zeros((n, 1), "int64")  # next live position
        before = np.arange(-1, w - 1, dtype="int64") + np.zeros((n, 1), "int64")
        tree = np.full((n, 2 * w), NEVER, "int64")
        has = np.flatnonzero(cols + 1 < np.repeat(sizes, sizes))
        r = self.rank(flat[has], flat[has + 1])
        tree[rows[has], w + cols[has]] = np.where(r == NEVER, NEVER, r << _POS_BITS | cols[has])
        for level in range(w.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        ft, fk, fa, fb = tree.ravel(), tok.ravel(), after.ravel(), before.ravel()
        live = np.flatnonzero(tree[:, 1] != NEVER)
        depth = w.bit_length() - 1
        while len(live):
            top = ft[live * 2 * w + 1]
            pos, rank = top & ((1 << _POS_BITS) - 1), top >> _POS_BITS
            kbase, lbase, tbase = live * (w + 1), live * w, live * 2 * w + w
            gone = fa[lbase + pos]
            nxt = fa[lbase + gone]
            fk[kbase + pos] = rank
            fk[kbase + gone] = -1
            fa[lbase + pos] = nxt
            inner = nxt < w
            fb[lbase[inner] + nxt[inner]] = pos[inner]
            prev = fb[lbase + pos]
            # the pairs that begin at the merged token, at its left neighbour and at the token that is gone
            right = fk[kbase + np.minimum(nxt, w)]
            ok = inner & (right >= 0)
            new = np.full(len(live), NEVER, "int64")
            r = self.rank(rank[ok], right[ok])
            new[ok] = np.where(r == NEVER, NEVER, r << _POS_BITS | pos[ok])
            ft[tbase + pos] = new
            ft[tbase + gone] = NEVER
            ok = prev >= 0
            r = self.rank(fk[kbase[ok] + prev[ok]], rank[ok])
            ft[tbase[ok] + prev[ok]] = np.where(r == NEVER, NEVER, r << _POS_BITS | prev[ok])
            root = live * 2 * w
            paths = [w + pos, w + gone, w + np.where(ok, prev, pos)]
            for _ in range(depth):
                for k, p in enumerate(paths):
                    p = paths[k] = p >> 1
                    i = root + p
                    ft[i] = np.minimum(ft[root + 2 * p], ft[root + 2 * p + 1])
            live = live[ft[live * 2 * w + 1] != NEVER]
        keep = tok[:, :w] >= 0
        ends = np.cumsum(keep.sum(1))
        ids = tok[:, :w][keep].astype("int32")
        return np.split(ids, ends[:-1])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, "int32"), np.zeros(1, "int64")

    def _learn(self, new: list[str]) -> None:
        """Adds pieces with their ids to what is known."""
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        whole = [self.ranks.get(b) for b in raw]
        merged = iter(self.merge([b for b, r in zip(raw, whole) if r is None]))
        parts = [next(merged) if r is None else np.array([r], "int32") for r in whole]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)))
        self.flat, self.starts = np.concatenate([self.flat, *parts]), np.concatenate([self.starts, ends])

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts: one more than there are). Null and empty texts have none."""
        find = self.cut.findall
        cut = [find(t) if t else [] for t in texts]
        if len(self.known) > self.memory:
            self._forget()
        known = self.known
        if new := [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in known]:
            self._learn(new)
        counts = np.fromiter(map(len, cut), "int64", len(cut))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), "int64", int(counts.sum()))
        first, sizes = self.starts[which], self.starts[which + 1] - self.starts[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=4)
def encoder(path: str) -> Bpe:
    """The encoder of a vocabulary file, one per worker."""
    return Bpe(path)
