"""Exact byte-level BPE ids of whole texts by dynamic programming over prefixes.

For every prefix of a piece of text the last token of its encoding is unique, so one pass that stores that token for each prefix
is enough. An automaton over the vocabulary (a trie with suffix links) gives, at each byte, all tokens that end there; of these,
the one that is compatible with the last token of the prefix before it is the prefix's own. Back-pointers from the end then emit
the ids. Two tokens are compatible when merging their joined bytes gives these two again, which is read off the two merge trees
along their seam. Work is linear in the length, whatever the text, and no merge queue is kept.

Pieces (words, numbers, runs of blanks) don't depend on each other, so each worker remembers the ids of pieces it has met.

Defined results: null and empty texts give an empty list; strings that name special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the published pattern that cuts text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers before it starts afresh, and the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64


def _byte_of_char() -> dict[str, int]:
    """The published mapping of bytes to printable characters: printable Latin-1 stands for itself, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _cutters():
    """PIECES for ASCII texts, for texts of the basic plane, and for all. The first two are for the standard library's matcher,
    which is faster, with the classes of letters, numbers and blanks written out from the Unicode tables of `regex`."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))

    def ranges(cls: str) -> str:
        return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(cls + "+", every))

    def pattern(letter: str, number: str, blank: str) -> re.Pattern:
        s, x = f"[{blank}]", f"[^{blank}]"
        return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{blank}{letter}{number}]+|{s}+(?!{x})|{s}+")

    plane = pattern(ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s"))
    return pattern("A-Za-z", "0-9", r"\t-\r\x20").findall, plane.findall, regex.compile(PIECES).findall


class PrefixEncoder:
    """Ids of texts, as bytes of little-endian int32."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = _byte_of_char()
        vocab: dict[str, int] = model["vocab"]
        self.cut_ascii, self.cut_plane, self.cut_any = _cutters()
        self.known: dict[str, bytes] = {}
        self.find = self.known.__getitem__
        # merged token -> (rank, left, right); pairs -> rank
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.made.setdefault(z, (r, x, y))
        self.auto = ahocorasick.Automaton()
        for word, i in vocab.items():
            if len(word) == 1 or i in self.made:
                raw = "".join(chr(back[c]) for c in word)
                self.auto.add_word(raw, (i, len(raw)))
        self.auto.make_automaton()
        self.agree: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the seam between a and b alone.

        Along the seam stand, in the order in which merging forms them, the last parts of a and the first parts of b. A part
        lasts until its parent is formed. Two parts that meet are merged if their pair's rank comes before both parents'; on
        equal ranks the leftmost pair goes first, which is a's own parent on the left and the seam on the right."""
        key = (a, b)
        got = self.agree.get(key)
        if got is not None:
            return got
        never = 1 << 40
        made, rank = self.made, self.rank
        left_end, right_end = never, never  # ranks at which the parents of the two parts are formed
        ok = True
        while True:
            r = rank.get((a, b))
            if r is not None and r < left_end and r <= right_end:
                ok = False
                break
            da, db = made.get(a), made.get(b)
            if da is None and db is None:
                break
            # undo whichever of the two was formed last
            if db is None or (da is not None and da[0] > db[0]):
                left_end, a = da[0], da[2]
            else:
                right_end, b = db[0], db[1]
        if len(self.agree) > 4_000_000:
            self.agree.clear()
        self.agree[key] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8").decode("latin-1")
        n = len(raw)
        last = [-1] * (n + 1)  # the last token of each prefix
        size = [0] * (n + 1)
        for end, (token, length) in self.auto.iter(raw):
            start = end + 1 - length
            if last[end + 1] >= 0:
                continue
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                last[end + 1], size[end + 1] = token, length
        out = []
        while n > 0:
            if last[n] < 0:
                raise ValueError("a prefix has no token; the vocabulary lacks single bytes")
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = (self.cut_ascii if text.isascii() else self.cut_plane if max(text) < "\U00010000" else self.cut_any)(text)
        try:
            return b"".join(map(self.find, pieces))
        except KeyError:
            return self._with_new(pieces)

    def _with_new(self, pieces: list[str]) -> bytes:
        known, here = self.known, {}
        if len(known) >= REMEMBERED:
            known.clear()
        for p in set(pieces):
            if p not in known:
                ids = self.encode_piece(p)
                raw = struct.pack(f"<{len(ids)}i", *ids)
                (known if len(p) <= LONGEST else here)[p] = raw
        return b"".join([known[p] if p in known else here[p] for p in pieces])

    def encode(self, text: str | None) -> list[int]:
        raw = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(raw) // 4}i", raw))

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary file."""
    return PrefixEncoder(path)


def encode_corpus(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, in one pass without a shuffle. The vocabulary is read by each worker from `path`."""
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        e = encoder(path)
        for b in batches:
            ids = [e.encode_bytes(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            flat = np.frombuffer(b"".join(ids), dtype="<i4")
            arr = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), arr], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, path: str, keep: list[str], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """(keep..., n_tokens) of every row; the ids themselves aren't sent back to the JVM."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(name, T.LongType(), False)])

    def run(batches):
        import pyarrow as pa

        e = encoder(path)
        for b in batches:
            n = pa.array([e.count(t) for t in b.column(len(keep)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, name])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
