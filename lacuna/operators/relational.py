"""Joins and set operators of record linkage, as DataFrame compositions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import distributed_rank

#: A dimension up to this many bytes, as Spark estimates it, is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate is under the bound."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last one in the order given, which should be total. Aggregated before the shuffle, so a key
    with very many rows is one row of each task."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def merge_right_wins(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both; of a key in both, the right one's."""
    return right.unionByName(left.join(right.select(*key), list(key), "left_anti"))


def fallback_join(left: DataFrame, right: DataFrame, key: str, first: Column, second: Column, allowed: Column, link_first: Column, link_second: Column) -> DataFrame:
    """left ⋈ right by `first`; rows of left without a match there (and for which `allowed` holds) by `second`."""
    a = left.join(right, first, "inner").withColumn("link", link_first).where("link is not null")
    rest = left.where(allowed).join(a.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    b = rest.join(right, second, "inner").withColumn("link", link_second).where("link is not null")
    return a.unionByName(b)


def shared_pairs(df: DataFrame, at: Sequence[str], owner: str, mark: Column, least: int = 2, examples: int = 4) -> DataFrame:
    """(a, b, overlap, shared, rate, examples): owners that stand at the same places, at how many of them `mark` is non-null and
    equal, the share of these, and the first places in their order; pairs with at least `least` of them.

    Owners at one place are first brought down to one row each, so a place has as many rows as owners, and pairs are counted
    within tasks before the shuffle. Examples are cut within tasks too."""
    d = df.groupBy(*at, owner).agg(F.max_by(mark, F.struct(*[F.col(c) for c in df.columns if c not in (*at, owner)])).alias("_m"))
    x = d.select(*at, F.col(owner).alias("a"), F.col("_m").alias("ma"))
    y = d.select(*at, F.col(owner).alias("b"), F.col("_m").alias("mb"))
    j = x.join(y, list(at)).where("a < b")
    n = j.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.count_if(F.col("ma") == F.col("mb")).alias("shared")).where(F.col("shared") >= least)
    n = n.withColumn("rate", F.round(F.col("shared") / F.col("overlap"), 3))
    some = top_per_group(j.where("ma = mb"), ["a", "b"], [F.col(c) for c in at], examples, "_r")
    some = some.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(" ", *[F.col(c).cast("string") for c in at]).alias("t")))).alias("_e"))
    return n.join(some, ["a", "b"]).select("a", "b", "overlap", "shared", "rate", F.col("_e.t").alias("examples"))


def ratio_band(queries: DataFrame, controls: DataFrame, q: str, c: str, ratio: float = 1.5, extra: Column | None = None) -> DataFrame:
    """queries ⋈ controls with |ln(c/q)| <= ln(ratio), as an equi-join on logarithmic buckets instead of a nested loop: a
    bucket is as wide as the band's half, so a control lies in the query's bucket or a neighbour."""
    w = math.log(ratio)
    qb = queries.where(F.col(q) > 0).withColumn("_b", F.explode(F.array(*[F.floor(F.log(F.col(q).cast("double")) / w) + d for d in (-1, 0, 1)])))
    cb = controls.where(F.col(c) > 0).withColumn("_b", F.floor(F.log(F.col(c).cast("double")) / w))
    near = F.abs(F.log(F.col(c) / F.col(q))) <= F.lit(w + 1e-12)
    j = qb.join(cb, "_b").where(near if extra is None else near & extra)
    return j.drop("_b")


def nearest_by_ratio(queries: DataFrame, controls: DataFrame, key: str, q: str, c: str, ckey: str, k: int = 20) -> DataFrame:
    """The k controls nearest in log length to each query, with `rank`. Of equal distances shorter controls come first, and
    of equal lengths those next to the query in the order of (length, key).

    Controls are ranked once by (length, key); the k nearest of a query are among the k ranks before and after its own place,
    so it is joined to 2k ranks and not to all controls."""
    have = controls.where(F.col(c) > 0)
    top = float(have.agg(F.max(c)).first()[0] or 1)
    bucket = F.floor(F.col(c).cast("double") * 256 / top)
    ranked = distributed_rank(have.withColumn("_all", F.lit(0)), ["_all"], bucket, [c, ckey], "_r").drop("_all")
    # how many controls are shorter than each distinct query length
    n = have.groupBy(F.col(c).cast("double").alias("_l")).agg(F.count("*").alias("_n"))
    want = queries.where(F.col(q) > 0).select(F.col(q).cast("double").alias("_l")).distinct().withColumn("_n", F.lit(None).cast("long"))
    w = Window.partitionBy(F.lit(0)).orderBy("_l", F.col("_n").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # distinct lengths only
    place = n.unionByName(want).withColumn("_at", F.coalesce(F.sum("_n").over(w), F.lit(0))).where("_n is null").select("_l", "_at")
    d = queries.where(F.col(q) > 0).join(place, F.col(q).cast("double") == F.col("_l")).drop("_l")
    d = d.withColumn("_r", F.explode(F.sequence(F.col("_at") - k, F.col("_at") + k - 1))).drop("_at")
    j = d.join(ranked, "_r").withColumn("_d", F.round(F.abs(F.log(F.col(c) / F.col(q))), 12)).withColumn("_below", F.col(c) < F.col(q))
    order = [F.col("_d"), F.desc("_below"), F.when(F.col("_below"), -F.col("_r")).otherwise(F.col("_r"))]
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k).drop("_r", "_d", "_below")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups within tasks before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def not_done(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What is left of the work, given what an earlier run wrote."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def matched_totals(queries: DataFrame, controls: DataFrame, key: str, q: str, c: str, ckey: str, ratio: float = 1.5, least: int = 20) -> DataFrame:
    """(key, near, n, total): how many `matched_controls` each query has and their summed length, without a row for each pair.
    Lengths decide, so controls in the band are counted by length, and each distinct length of queries once."""
    sizes = controls.where(F.col(c) > 0).groupBy(F.col(c).alias("_c")).agg(F.count("*").alias("_k"))
    asked = queries.where(F.col(q) > 0)
    band = ratio_band(asked.select(F.col(q).alias("_q")).distinct(), sizes, "_q", "_c", ratio)
    band = band.groupBy("_q").agg(F.sum("_k").alias("n"), F.sum(F.col("_c").cast("long") * F.col("_k")).alias("total")).where(F.col("n") >= least).withColumnRenamed("_q", q)
    near = nearest_by_ratio(asked.join(band, q, "left_anti"), controls, key, q, c, ckey, least)
    near = near.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(c).cast("long")).alias("total")).withColumn("near", F.lit(True))
    # rows of one key are one query, as in counting its pairs
    many = asked.join(band, q).groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("near", F.lit(False))
    return many.unionByName(near).select(key, "near", "n", "total")


def matched_controls(queries: DataFrame, controls: DataFrame, key: str, q: str, c: str, ckey: str, ratio: float = 1.5, least: int = 20) -> DataFrame:
    """queries ⋈ controls of similar length, with `near` False; of a query with fewer than `least` of them instead the `least`
    nearest ones, with `near` True."""
    band = ratio_band(queries, controls, q, c, ratio)
    # lengths decide, so controls are counted by length and not pair by pair
    sizes = controls.groupBy(F.col(c).alias("_c")).agg(F.count("*").alias("_k"))
    n = ratio_band(queries.select(F.col(q).alias("_q")).distinct(), sizes, "_q", "_c", ratio).groupBy("_q").agg(F.sum("_k").alias("_n"))
    enough = n.where(F.col("_n") >= least).select(F.col("_q").alias(q))
    near = nearest_by_ratio(queries.join(enough, q, "left_anti"), controls, key, q, c, ckey, least).drop("rank")
    out = band.join(enough, q, "left_semi").withColumn("near", F.lit(False))
    return out.unionByName(near.withColumn("near", F.lit(True)))
