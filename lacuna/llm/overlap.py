"""Records of evaluation splits that training records repeat, exactly or almost.

Two texts match if at most a tenth of the longer one's letters must be put in, left out or replaced. Distinct evaluation texts
are sharded by length band, and each shard gets a compressed full-text index (`fmindex`). Distinct training texts are streamed
through the shards whose lengths they can match: a text of n letters can differ by n // 9 letters from its match at most, so of
n // 9 + 1 disjoint pieces one stands in the match unchanged and at nearly the same place. Backward search finds all places of
each piece; those at a possible distance and length are counted letter by letter (each edit changes two letter counts at most),
and for those that are left the pieces are extended to maximal matches, which are merged to spans.

The merged spans decide: d edits leave all but d of the pieces unchanged, so a match has at least the letters of the others in
its spans, and a pair with fewer is given up. What the spans accept is confirmed by the exact edit distance. None of the steps
can lose a match.

A band of one shard gets all training texts that can match it. In a band of several, texts are sent only to the shards that have
a gram of one of their pieces at a possible place, by a join on hashes of (gram, place), so the work doesn't grow with shards
times texts. Shards and training blocks are bounded by letters, whatever the distribution of lengths; a text that very many
records share is searched once. Matches of texts are expanded to pairs of records over distinct pairs of the places where the
texts stand, in joins that spread hot texts and places.

Defined results: null and empty texts and those under `least` letters match nothing; blanks don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join

#: Lengths in a band differ by this factor at most; letters in an index shard, and in a block of training texts.
BAND, SHARD, BLOCK = 1.15, 1_500_000, 3_000_000
#: Places that are looked at together, and letters of training texts that are searched together.
HITS, CHUNK = 1_000_000, 400_000


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def _gram(n: Column) -> Column:
    """Letters that each piece of a text of n letters has at least (n // (n // 9 + 1), for n from 20 on)."""
    return F.when(n < 36, 6).when(n < 72, 7).otherwise(8)


def _room(band: Column) -> Column:
    """A place differs by no more than this between texts of a band and what can match them."""
    return (F.floor(F.pow(F.lit(BAND), band + 1) / 9) + 1).cast("int")


def _build(keys, pdf):
    import pandas as pd

    from .fmindex import FMIndex

    texts = sorted(pdf["letters"])  # equal inputs give equal shards
    return pd.DataFrame({"band": [keys[0]], "sub": [keys[1]], "index": [FMIndex(texts).dumps()]})


def _counts(codes, starts, lengths, sigma: int):
    """Letter counts of each text, one row each. Beyond 64 letters several share a column, which can only hide differences."""
    import numpy as np

    sigma = min(sigma, 64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.concatenate([codes[s : s + n] for s, n in zip(starts, lengths)]) if len(lengths) else np.zeros(0, dtype=np.int64)
    flat = np.bincount(rows * sigma + at % sigma, minlength=len(lengths) * sigma)
    return flat.reshape(len(lengths), sigma).astype(np.int32)


def search(index, train: list[str]) -> Iterator[tuple[str, str, int, list[tuple[int, int]]]]:
    """(training text, evaluation text, letters of the former in merged maximal matches, merged spans of the latter) of all
    pairs whose spans are as large as those of a match must be."""
    a = letters = 0
    for b, t in enumerate(train):
        letters += len(t)
        if letters >= CHUNK:
            yield from _search(index, train[a : b + 1])
            a, letters = b + 1, 0
    if a < len(train):
        yield from _search(index, train[a:])


def _search(index, train: list[str]) -> Iterator[tuple[str, str, int, list[tuple[int, int]]]]:
    import numpy as np

    parts = [index.encode(t) for t in train]
    codes = np.concatenate(parts)
    length = np.array([len(p) for p in parts], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(length)))[:-1].astype(np.int64)
    # pieces: one more than the edits that there can be, as even as can be
    n = length // 9 + 1
    owner = np.repeat(np.arange(len(train)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    lo_at = place * length[owner] // n[owner]
    hi_at = (place + 1) * length[owner] // n[owner]
    lo, hi = index.intervals(codes, start[owner] + hi_at, hi_at - lo_at)
    sigma = len(index.code) + 2
    of_train = _counts(codes, start, length, sigma)
    of_eval = _counts(index.text.astype(np.int64), index.start, index.length, sigma)
    hits: list = []
    todo = np.nonzero(hi > lo)[0]
    sizes = np.cumsum((hi - lo)[todo])
    cuts = np.searchsorted(sizes, np.arange(HITS, int(sizes[-1]) + HITS, HITS)) if len(todo) else []
    a = 0
    for b in [*[int(c) + 1 for c in cuts]]:
        p = todo[a:b]
        a = b
        if not len(p):
            continue
        for piece, rows in _slices(p, lo, hi):
            at = index.locate(rows)
            e = np.searchsorted(index.start, at, side="right") - 1
            t = owner[piece]
            d = np.maximum(length[t], index.length[e]) // 10
            off = at - index.start[e]
            keep = (np.abs(off - lo_at[piece]) <= d) & (np.abs(length[t] - index.length[e]) <= d)
            t, e, piece, off, d = t[keep], e[keep], piece[keep], off[keep], d[keep]
            for x in range(0, len(t), 200_000):
                s = slice(x, x + 200_000)
                close = np.abs(of_train[t[s]] - of_eval[e[s]]).sum(axis=1) <= 2 * d[s]
                hits.append(np.stack([v[s][close] for v in (t, e, piece, off)]))
    if not hits:
        return
    t, e, piece, off = np.concatenate(hits, axis=1)
    order = np.lexsort((piece, e, t))
    t, e, piece, off = t[order], e[order], piece[order], off[order]
    edges = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (e[1:] != e[:-1]), [True]))) if len(t) else [0]
    for i, j in zip(edges[:-1], edges[1:]):
        x, y = int(t[i]), int(e[i])
        own, other = codes[start[x] : start[x] + length[x]], index.text[index.start[y] : index.start[y] + index.length[y]]
        d = max(len(own), len(other)) // 10
        found = {_maximal(own, other, int(lo_at[p]), int(o)) for p, o in zip(piece[i:j], off[i:j])}
        matched = sum(v - u for u, v in merged((u, u + k) for u, _, k in found))
        if matched >= (int(n[x]) - d) * (len(own) // int(n[x])):
            yield train[x], index.decode(y), matched, merged((v, v + k) for _, v, k in found)


def _slices(pieces, lo, hi) -> Iterator:
    """(piece, suffix row) of all places of the pieces, at most HITS at a time."""
    import numpy as np

    n = (hi - lo)[pieces]
    if int(n.sum()) <= 2 * HITS:
        rows = np.repeat(lo[pieces] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.repeat(pieces, n), rows
        return
    for p in pieces:
        for x in range(int(lo[p]), int(hi[p]), HITS):
            rows = np.arange(x, min(int(hi[p]), x + HITS))
            yield np.full(len(rows), p), rows


def _maximal(own, other, a: int, b: int) -> tuple[int, int, int]:
    """(place in own, place in other, letters) of the maximal match on the diagonal through own[a] and other[b], which are equal."""
    import numpy as np

    back = min(a, b)
    u, v = a - back, b - back
    size = min(len(own) - u, len(other) - v)
    apart = np.flatnonzero(own[u : u + size] != other[v : v + size])
    k = int(np.searchsorted(apart, back))
    lo = int(apart[k - 1]) + 1 if k else 0
    hi = int(apart[k]) if k < len(apart) else size
    return u + lo, v + lo, hi - lo


def merged(spans) -> list[tuple[int, int]]:
    """Spans without overlaps, in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _routes(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """(tid, band, sub): the shards that have a gram of a piece of a training text at a possible place. train(tid, band,
    letters), held_out(band, sub, letters)."""
    n = F.length("letters")
    pieces = (F.floor(n / 9) + 1).cast("int")
    room = _room(F.col("band"))
    at = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.floor(i * n / pieces).cast("int"))
    key = lambda p, q, slot: F.xxhash64(F.substring("letters", p + 1, q), q, slot, F.col("band"))
    q = _gram(n)
    t = train.select("tid", F.explode(F.transform(at, lambda p: key(p, q, F.floor(p / (2 * room)).cast("int")))).alias("k")).distinct()

    def grams(size: Column) -> Column:
        def one(p: Column) -> Column:
            slots = F.array(*[F.floor(F.greatest(p + s * room, F.lit(0)) / (2 * room)).cast("int") for s in (-1, 1)])
            return F.transform(slots, lambda x: key(p, size, x))

        return F.flatten(F.transform(F.sequence(F.lit(0), n - size), one))

    sizes = F.array_distinct(F.array(_gram(F.floor(n * 0.9)), _gram(F.ceil(n / 0.9))))
    e = held_out.select("band", "sub", F.explode(F.flatten(F.transform(sizes, grams))).alias("k")).distinct()
    return t.join(e, "k").select("tid", "band", "sub").distinct()


def matching_texts(train: DataFrame, held_out: DataFrame, work, least: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(a, b, matched, spans): pairs of a distinct training text and a distinct held-out text, both in column `letters`, that
    differ by at most a tenth of the longer one, with the letters of a that stand in b and their merged spans (from, to) in b.
    Equal texts are a pair too."""
    spark = work.spark
    size = F.length("letters")
    h = F.xxhash64("letters")
    least = max(least, 20)  # the pieces of shorter texts are too short for the grams
    e = work.save(held_out.select("letters").where(size >= least).distinct().withColumn("band", _band(size)), "held-out")
    t = train.select("letters").where(size >= least).distinct()
    # the lengths that a training text of n letters can match: from n - n / 10 to n + n / 9
    span = F.sequence(_band(F.ceil(size * 0.9)), _band(F.floor(size / 0.9)))
    t = work.save(t.withColumn("band", F.explode(span)), "train")
    total = lambda d, by: {r[0]: -(-int(r[1]) // by) for r in d.groupBy("band").agg(F.sum(size)).collect()}  # noqa: E731, one row for each band
    subs, blocks = total(e, shard), total(t, block)
    plan = [(b, n, blocks[b]) for b, n in subs.items() if b in blocks]
    plan_df = F.broadcast(spark.createDataFrame(plan, "band int, subs int, blocks int"))
    e = e.join(plan_df, "band").withColumn("sub", F.pmod(h, F.col("subs")).cast("int"))
    index = work.save(e.groupBy("band", "sub").applyInPandas(_build, "band int, sub int, index binary"), "index")
    t = t.join(plan_df, "band").withColumn("tid", h)
    sent = t.where("subs = 1").select("band", F.lit(0).alias("sub"), "letters", F.pmod("tid", F.col("blocks")).cast("int").alias("block"))
    index_of = index.join(plan_df, "band").where("subs = 1").select("band", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "index")
    if any(n > 1 for n in subs.values()):
        several = t.where("subs > 1")
        routes = _routes(several, e.where("subs > 1"))
        more = work.save(several.join(routes, ["tid", "band"]).select("band", "sub", "letters", "tid"), "routed")
        n = more.groupBy("band", "sub").agg(F.ceil(F.sum(size) / block).cast("int").alias("n"))
        more = more.join(n, ["band", "sub"]).select("band", "sub", "letters", F.pmod("tid", F.col("n")).cast("int").alias("block"))
        sent = sent.unionByName(more)
        index_of = index_of.unionByName(index.join(n, ["band", "sub"]).select("band", "sub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "index"))

    def run(left, right):
        import pandas as pd

        from .fmindex import FMIndex

        out = []
        if len(left) and len(right):
            out = [(a, b, m, [{"s": x, "e": y} for x, y in spans]) for a, b, m, spans in search(FMIndex.loads(right["index"].iloc[0]), list(left["letters"]))]
        return pd.DataFrame(out, columns=["a", "b", "matched", "spans"]).astype({"matched": "int32"})

    by = ("band", "sub", "block")
    found = sent.groupBy(*by).cogroup(index_of.groupBy(*by)).applyInPandas(run, "a string, b string, matched int, spans array<struct<s:int,e:int>>")
    # each pair is found once: a text is in one shard, and sent to it once. How far apart at most is a tenth of the longer text
    return work.save(found.where("levenshtein(a, b, int(greatest(length(a), length(b)) div 10)) >= 0"), "matches")


class Overlap:
    """Matching texts of rows(key, split, place...) in train and in a held-out split, given texts(place..., letters)."""

    def __init__(self, rows: DataFrame, texts: DataFrame, place: list[str], work, split: str = "split", train: str = "train", held_out: tuple[str, ...] = ("val", "test"), least: int = 20) -> None:
        self.place, self.train = place, train
        self.rows = work.save(rows.where(F.col(split).isin(train, *held_out)).select("key", F.col(split).alias("split"), *place).distinct(), "rows")
        places = self.rows.groupBy(*place).agg(F.bool_or(F.col("split") == train).alias("in_train"), F.bool_or(F.col("split") != train).alias("in_eval"))
        self.here = work.save(texts.where(F.length("letters") >= least).select("letters", *place).distinct().join(places, place), "texts")
        self.matches = matching_texts(self.here.where("in_train"), self.here.where("in_eval"), work, least)

    def pairs(self) -> DataFrame:
        """(train_key, eval_key): pairs of rows that have a matching text."""
        place = self.place
        side = lambda x, flag: self.here.where(flag).select(F.col("letters").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in place])
        on = lambda x: [f"{c}_{x}" for c in place]
        both = salted_join(side("a", "in_train"), self.matches.select("a", "b"), ["a"], on("a"), "inner")
        both = salted_join(side("b", "in_eval"), both.drop("a"), ["b"], on("b"), "inner").select(*on("a"), *on("b")).distinct()
        at = lambda x, cond, name: self.rows.where(cond).select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{x}") for c in place])
        both = salted_join(at("a", F.col("split") == self.train, "train_key"), both, on("a"), ["train_key"], "inner")
        both = salted_join(at("b", F.col("split") != self.train, "eval_key"), both, on("b"), ["eval_key"], "inner")
        return both.select("train_key", "eval_key").distinct()

    def spans(self) -> DataFrame:
        """(place..., letters, matches, covered): of each held-out text the training texts that match it, and how many of its
        letters stand in merged maximal matches with any of them."""
        s = self.matches.select(F.col("b").alias("letters"), F.inline("spans")).distinct()  # an end and a start for each letter, at most
        w = Window.partitionBy("letters").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        gain = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(w), F.lit(0))))
        covered = s.withColumn("gain", gain).groupBy("letters").agg(F.sum("gain").alias("covered"))
        n = self.matches.groupBy(F.col("b").alias("letters")).agg(F.count("*").alias("matches")).join(covered, "letters")
        out = salted_join(self.here.where("in_eval").select("letters", *self.place), n, ["letters"], self.place)
        return out.select(*self.place, "letters", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matches", "covered")])


def overlapping_rows(rows: DataFrame, texts: DataFrame, place: list[str], work, **options) -> DataFrame:
    """(train_key, eval_key) of rows in train and in a held-out split that have a matching text."""
    return Overlap(rows, texts, place, work, **options).pairs()
