"""A compressed full-text index of short texts: the Burrows-Wheeler transform with sampled counts and places.

Built and searched with NumPy, many patterns at a time: one step of backward search takes all patterns one letter further.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np

#: Letters between two sampled counts, and between two sampled places.
COUNT_EVERY, PLACE_EVERY = 64, 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s (small non-negative integers) in order; at the end of the text counts as less than anything."""
    n = len(s)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    bits = max(1, int(s.max() + 1).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):  # the first k letters at once
        key <<= bits
        if j < n:
            key[: n - j] |= s[j:].astype(np.int64) + 1
    while True:
        order = np.argsort(key, kind="stable")
        k_sorted = key[order]
        new = np.empty(n, dtype=bool)
        new[0] = False
        np.not_equal(k_sorted[1:], k_sorted[:-1], out=new[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if int(rank[order[-1]]) == n - 1 or k >= n:
            return order
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        k *= 2


class FMIndex:
    """Texts, each closed by a separator (code 0). Codes of letters start at 1."""

    def __init__(self, texts: list[str]) -> None:
        letters = sorted(set().union(*map(set, texts))) if texts else []
        self.letters = letters
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        parts = [self.encode(t) for t in texts]
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1].astype(np.int64)
        kind = np.uint8 if len(letters) < 255 else np.uint16 if len(letters) < 65535 else np.uint32
        self.text = np.zeros(int((self.length + 1).sum()), dtype=kind)
        for at, p in zip(self.start, parts):
            self.text[at : at + len(p)] = p
        sa = suffix_array(self.text)
        self.bwt = self.text[sa - 1] if len(sa) else self.text
        # the first letter of each text is marked too: ranks of separators don't lead back over the end of the text before
        marked = (sa % PLACE_EVERY == 0) | (self.bwt == 0)
        self.marks, self.places = np.packbits(marked), sa[marked].astype(np.int32)
        self._prepare()

    def encode(self, t: str) -> np.ndarray:
        """Codes; letters that the index lacks get the code behind the last."""
        none = len(self.code) + 1
        get = self.code.get
        return np.fromiter((get(c, none) for c in t), dtype=np.int64, count=len(t))

    def _prepare(self) -> None:
        n, sigma = len(self.bwt), len(self.code) + 2
        blocks = n // COUNT_EVERY + 1
        padded = np.full(blocks * COUNT_EVERY, sigma, dtype=np.int64)
        padded[:n] = self.bwt
        flat = np.repeat(np.arange(blocks, dtype=np.int64), COUNT_EVERY)[:n] * sigma + padded[:n]
        per = np.bincount(flat, minlength=blocks * sigma).reshape(blocks, sigma)
        self.before = np.zeros((blocks, sigma), dtype=np.int32)
        np.cumsum(per[:-1], axis=0, out=self.before[1:])
        self.block = padded.astype(np.uint32 if sigma > 65000 else np.uint16 if sigma > 250 else np.uint8).reshape(blocks, COUNT_EVERY)
        self.first = np.concatenate(([0], np.cumsum(per.sum(axis=0)))).astype(np.int64)
        mark = np.unpackbits(self.marks, count=n).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        self.mark = mark.astype(bool)
        self.mark_rank = np.concatenate(([0], np.cumsum(mark)))

    def dumps(self) -> bytes:
        """The transform, the samples and the lengths; the texts aren't kept beside them."""
        return zlib.compress(pickle.dumps((self.letters, self.length, self.bwt, self.marks, self.places), 5), 3)

    @classmethod
    def loads(cls, raw: bytes) -> FMIndex:
        x = cls.__new__(cls)
        x.letters, x.length, x.bwt, x.marks, x.places = pickle.loads(zlib.decompress(raw))
        x.code = {c: i + 1 for i, c in enumerate(x.letters)}
        x.start = np.concatenate(([0], np.cumsum(x.length + 1)))[:-1].astype(np.int64)
        x._prepare()
        x.text = x._restored()
        return x

    def _restored(self) -> np.ndarray:
        """The texts out of the transform: all of them are walked back from their ends at once."""
        text = np.zeros(len(self.bwt), dtype=self.bwt.dtype)
        row = np.arange(len(self.length))  # suffixes that begin with a separator come first
        at = self.locate(row) - 1
        while len(row):
            c = self.bwt[row]
            live = c != 0
            row, at, c = row[live], at[live], c[live].astype(np.int64)
            text[at] = c
            row, at = self.first[c] + self.rank(c, row), at - 1
        return text

    def decode(self, i: int) -> str:
        """The text with number i."""
        a = int(self.start[i])
        return "".join([self.letters[c - 1] for c in self.text[a : a + int(self.length[i])].tolist()])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i letters of the transform are c."""
        out = np.empty(len(i), dtype=np.int64)
        for a in range(0, len(i), 65_536):
            ci, ii = c[a : a + 65_536], i[a : a + 65_536]
            b, r = ii // COUNT_EVERY, ii % COUNT_EVERY
            inside = (self.block[b] == ci[:, None]) & (np.arange(COUNT_EVERY) < r[:, None])
            out[a : a + 65_536] = self.before[b, ci] + inside.sum(axis=1)
        return out

    def intervals(self, codes: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the patterns codes[end - size : end], the intervals of suffixes that start with them."""
        lo = np.zeros(len(end), dtype=np.int64)
        hi = np.full(len(end), len(self.bwt), dtype=np.int64)
        lo[size == 0] = hi[size == 0] = 0
        known = len(self.code) + 1
        for step in range(int(size.max()) if len(size) else 0):
            live = np.nonzero((size > step) & (lo < hi))[0]
            if not len(live):
                break
            c = codes[end[live] - 1 - step]
            ok = c < known
            lo[live[~ok]] = hi[live[~ok]] = 0
            live, c = live[ok], c[ok]
            base = self.first[c]
            lo[live], hi[live] = base + self.rank(c, lo[live]), base + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes, given by their rows, walking back to sampled ones."""
        at, out, walked = rows.copy(), np.full(len(rows), -1, dtype=np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            r = at[open_]
            hit = self.mark[r]
            out[open_[hit]] = self.places[self.mark_rank[r[hit]]] + walked
            open_, r = open_[~hit], r[~hit]
            c = self.bwt[r].astype(np.int64)
            at[open_] = self.first[c] + self.rank(c, r)
            walked += 1
        return out % max(1, len(self.bwt))
