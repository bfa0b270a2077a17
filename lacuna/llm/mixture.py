"""Mixing sources to target shares of all tokens, with a cap on repeats.

Weights come from temperature mixing: source shares are raised to an exponent and normalised, and the exponent is bisected to
meet a target entropy (`flatten`) or the repetition limits. With target shares given, the exponent moves the weights from the
targets (exponent 0) towards the sources' own sizes (1), by the smallest step at which no source needs more repeats than it may
have. Without a stated budget the largest one is taken that the targets themselves allow, so the targets are met as they are; a
budget can also be stated in tokens, or as a place between that one (`stretch` 0) and all sources with all repeats (1). The
weights are then realised as budgets: whole passes over a source, and for the rest a prefix of one more pass, each pass in a
hash order of its own (a block permutation).

Defined results: documents without a source in the targets, or without tokens (null and empty texts), aren't drawn; sources
without documents give nothing, and the other targets are scaled up; a null or negative share counts as 0 and a null or
negative cap as 0; a source listed twice has its shares added and its smaller cap. Repeated rows are documents of their own.
A source's total misses its budget by half a document at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import running_total
from .encode import token_counts

#: More sources than this aren't planned on the driver.
MAX_SOURCES = 100_000


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and normalised; empty sources stay empty."""
    top = max(shares.values(), default=0)
    raw = {s: math.exp(exponent * math.log(p / top)) if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()} if total else raw


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def exponent_for_entropy(shares: dict[str, float], target: float, steps: int = 60) -> float:
    """The exponent in [0, 64] at which the tempered shares have the target entropy (which falls as the exponent grows)."""
    lo, hi = 0.0, 64.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(tempered(shares, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def weights_within_limits(
    targets: dict[str, float], sizes: dict[str, int], caps: dict[str, int], budget: float, steps: int = 60
) -> tuple[dict[str, float], float]:
    """The weights nearest the targets at which `budget` needs no more repeats than allowed, and their exponent. Raises if
    even the sources' own sizes can't give the budget."""
    use = {s: t for s, t in targets.items() if t > 0 and sizes.get(s, 0) > 0 and caps.get(s, 0) > 0}
    room = {s: sizes[s] * caps[s] for s in use}

    def at(x: float) -> dict[str, float]:
        raw = {s: t * (room[s] / t) ** x for s, t in use.items()}
        total = sum(raw.values())
        return {s: v / total for s, v in raw.items()}

    fits = lambda w: all(v * budget <= room[s] * (1 + 1e-12) for s, v in w.items())
    if not use or fits(at(0.0)):
        return at(0.0) if use else {}, 0.0
    if not fits(at(1.0)):
        raise ValueError("the budget is more than all sources with all their repeats")
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(at(mid)) else (mid, hi)
    return at(hi), hi


@dataclass
class Plan:
    """What is drawn from each source."""

    source: str
    target: float
    weight: float
    cap: int
    tokens: int
    budget: float
    passes: int
    rest: float
    exponent: float


def plan(targets: list[tuple[str, float, int]], sizes: dict[str, int], budget: float | None = None, flatten: float | None = None, stretch: float = 0.0) -> list[Plan]:
    """What to draw. With `flatten` the targets are the sources' own sizes, tempered to the entropy that lies at this part of
    the way from theirs (0) to that of even shares (1)."""
    share: dict[str, float] = {}
    cap: dict[str, int] = {}
    for s, t, r in targets:
        if s is None:
            continue
        share[s] = share.get(s, 0.0) + max(0.0, t or 0.0)
        cap[s] = min(cap.get(s, 1 << 30), max(0, r or 0))
    use = {s: t for s, t in share.items() if t > 0 and sizes.get(s, 0) > 0 and cap[s] > 0}
    exponent = 0.0
    if flatten is not None and use:
        own = tempered({s: float(sizes[s]) for s in use}, 1.0)
        exponent = exponent_for_entropy(own, entropy(own) + flatten * (math.log(len(own)) - entropy(own)))
        use = tempered(own, exponent)
        share = {s: use.get(s, 0.0) for s in share}
    total = sum(use.values())
    if budget is None:
        least = min((cap[s] * sizes[s] * total / t for s, t in use.items()), default=0.0)
        budget = least + stretch * (sum(cap[s] * sizes[s] for s in use) - least)
    weights, towards = weights_within_limits(share, sizes, cap, budget)
    out = []
    for s in sorted(share):
        n, w = sizes.get(s, 0), weights.get(s, 0.0)
        want = w * budget
        k = min(cap[s], int(want / n + 1e-9)) if n else 0
        out.append(Plan(s, share[s], w, cap[s], n, want, k, max(0.0, want - k * n) if k < cap[s] else 0.0, exponent if flatten is not None else towards))
    return out


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, work, budget: float | None = None, flatten: float | None = None, stretch: float = 0.0, seed: int = 0) -> tuple[DataFrame, list[Plan]]:
    """(doc_id, source, copy, place, n_tokens): the drawn documents; sorting a source's copy by `place` gives its permutation.
    For budget, flatten and stretch see `plan`."""
    want = [tuple(r) for r in targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MAX_SOURCES + 1).collect()]
    if len(want) > MAX_SOURCES:
        raise ValueError("too many sources to plan")
    names = sorted({s for s, t, r in want if s is not None and t and t > 0 and r and r > 0})
    sized = work.save(token_counts(docs.where(F.col("source").isin(names)), tokenizer, ["doc_id", "source"]).where("n_tokens > 0"), "sizes")
    sizes = {r[0]: int(r[1]) for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
    plans = plan(want, sizes, budget, flatten, stretch)
    by = sized.sparkSession.createDataFrame([(p.source, p.passes, p.rest) for p in plans], "source string, passes int, rest double")
    d = sized.join(F.broadcast(by), "source")  # at most MAX_SOURCES rows
    place = lambda copy: F.xxhash64(F.lit(seed), copy, F.col("doc_id"))
    whole = d.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    whole = whole.withColumn("place", place(F.col("copy")))
    part = d.where("rest > 0").withColumn("copy", F.col("passes") + 1).withColumn("place", place(F.col("copy")))
    part = running_total(part, ["source"], F.shiftright("place", 50), ["place", "doc_id", "n_tokens"], F.col("n_tokens"), "before")
    part = part.where(F.col("before") + F.col("n_tokens") / 2 <= F.col("rest"))
    cols = ["doc_id", "source", "copy", "place", "n_tokens"]
    return whole.select(*cols).unionByName(part.select(*cols)), plans


def shares(drawn: DataFrame, plans: list[Plan]) -> DataFrame:
    """Target and reached share of each source, its tokens, and the most times that one document was used."""
    spark = drawn.sparkSession
    used = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn"), F.count("*").alias("documents"), F.max("copy").alias("repeats"))
    table = spark.createDataFrame(
        [(p.source, p.target, p.weight, p.exponent, p.cap, p.tokens, p.budget) for p in plans],
        "source string, target_share double, weight double, exponent double, max_repeats int, available long, budget double",
    )
    out = table.join(used, "source", "left").fillna(0, ["drawn", "documents", "repeats"])
    total = F.sum("drawn").over(Window.partitionBy(F.lit(0)))  # one row for each source
    return out.select(
        "source", "target_share", F.coalesce(F.try_divide("drawn", total), F.lit(0.0)).alias("share"), "weight", "exponent", "max_repeats", "repeats", "documents", "available", "budget", "drawn"
    )
