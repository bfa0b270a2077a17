"""Profiles, margins, robust statistics, ranks and agreement measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import WorkDir
from .skew import rank_bucket, running_total


def named_subsets(df: DataFrame, subsets: dict[str, Column], aggs: Sequence[Column], least: int = 10) -> DataFrame:
    """One row for each named subset (they may overlap) with at least `least` rows. Rows are tagged with all their subsets, so
    the input is read once."""
    tags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in subsets.items()]), lambda x: x.isNotNull())
    d = df.withColumn("subset", F.explode(tags))
    return d.groupBy("subset").agg(F.count("*").alias("n"), *aggs).where(F.col("n") >= least)


def with_margins(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column], total: str = "all") -> DataFrame:
    """Grouping sets; a column outside a set shows `total`."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    d = df.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(f"_g_{c}") for c in cols])
    g = d.groupingSets([[F.col(f"_g_{c}") for c in s] for s in sets], *[F.col(f"_g_{c}") for c in cols]).agg(*aggs)
    return g.select(*[F.coalesce(f"_g_{c}", F.lit(total)).alias(c) for c in cols], *[c for c in g.columns if not c.startswith("_g_")])


def robust_outliers(df: DataFrame, group: Sequence[str], value: str, least: int = 5, limit: float = 3.5) -> DataFrame:
    """Adds median, z = (x - median) / (1.4826 MAD + 1) and flag, for groups of at least `least` rows; smaller ones go.
    Medians come from counts of distinct values, so a group of any size is compact before it is sorted."""
    x = F.col(value).cast("double")
    g = list(group)
    counted = df.where(x.isNotNull()).groupBy(*g, x.alias("_x")).agg(F.count("*").alias("_n"))
    med = counted.groupBy(*g).agg(F.sum("_n").alias("n"), F.expr("percentile(_x, 0.5D, _n)").alias("median")).where(F.col("n") >= least)
    dev = counted.join(med, g).withColumn("_d", F.abs(F.col("_x") - F.col("median")))
    mad = dev.groupBy(*g, "median").agg(F.expr("percentile(_d, 0.5D, _n)").alias("mad"))
    out = df.join(mad, g)
    z = (x - F.col("median")) / (F.col("mad") * 1.4826 + 1.0)
    return out.withColumn("z_score", F.round(z, 2)).withColumn("flag", F.abs(F.round(z, 2)) >= limit).drop("mad")


def control_z(real: DataFrame, controls: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Adds z against the group's controls: mean and population deviation + 1e-6."""
    s = controls.groupBy(*group).agg(F.avg(score).alias("_mu"), F.stddev_pop(score).alias("_sd"))
    return real.join(s, list(group), "left").withColumn("z", (F.col(score) - F.col("_mu")) / (F.col("_sd") + 1e-6)).drop("_mu", "_sd")


def ordinal_rank(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Adds `name`: the place of each row by value, ties by key, from 0; sorted between quantiles of the value, not in one task.
    Rows without a value go."""
    d = df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
    return running_total(d, ["_all"], rank_bucket(d, value, key), [value, key], F.lit(1), name).drop("_all")


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Correlation of ordinal ranks (ties by key, no averaging); one row."""
    d = df.where(f"{a} is not null and {b} is not null")
    d = ordinal_rank(ordinal_rank(d, a, key, "ra"), b, key, "rb")
    return d.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def auc(df: DataFrame, positive: Column, score: str, group: Sequence[str] = ()) -> DataFrame:
    """P(pos > neg) + P(equal) / 2 for each group, from counts at distinct scores; null where a side is empty."""
    g = list(group)
    d = df.where(F.col(score).isNotNull()).withColumn("_p", F.coalesce(positive, F.lit(False)).cast("int"))
    c = d.groupBy(*g, score).agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg"))
    w = Window.partitionBy(*(g or [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    s = c.groupBy(*g).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return s.select(*g, "n_pos", "n_neg", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


def quality_flag(area: Column, density: Column, blobs: Column, preserved: Column, limit: Column) -> Column:
    """The first reason that holds to doubt a picture's link, or null."""
    return (
        F.when((area < 1e4) & (preserved > 0), "no_parchment_found")
        .when(density > limit, "too_many_letters_for_area")
        .when((preserved >= 20) & (blobs < preserved * 0.1), "letters_without_ink")
        .when((blobs >= 60) & (preserved <= 3), "ink_without_letters")
    )


def letter_frequency(df: DataFrame, text: Column, group: Sequence[str] = ()) -> DataFrame:
    """(group, letter, n, share): counts of the characters of a text column. Characters are counted within tasks."""
    g = list(group)
    c = df.select(*g, F.explode(F.split(text, "")).alias("letter")).where("letter <> ''").groupBy(*g, "letter").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*(g or [F.lit(0)]))  # one row for each letter
    return c.withColumn("share", F.col("n") / F.sum("n").over(w))


# The weights of orders 0 to 3 and the count added to every letter.
LM_WEIGHTS, LM_ALPHA = (0.05, 0.15, 0.3, 0.5), 0.1


def letter_model(df: DataFrame, text: Column, alphabet: str, barrier: str = "|", unseen: bool = False) -> DataFrame:
    """(ctx, letter, p): a letter model of order 3, each order smoothed by LM_ALPHA and mixed by LM_WEIGHTS, for the contexts
    seen, or with `unseen` for all contexts of letters and barriers. `text` has a barrier wherever something is missing; a context reaches over it, a target can't be it.

    Every text begins with three barriers. Grams are counted within tasks; the counts are bounded by the alphabet."""
    v = len(alphabet)
    padded = F.concat(F.lit(barrier * 3), text)
    i = F.sequence(F.lit(1), F.length(text))
    grams = F.transform(F.when(F.length(text) > 0, i), lambda k: F.substring(padded, k, F.lit(4)))
    g = df.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    # anything else is a barrier too, so contexts are bounded by the alphabet
    g = g.groupBy(F.regexp_replace("g", f"[^{alphabet}{barrier}]", barrier).alias("g")).agg(F.sum("n").alias("n"))
    g = WorkDir(df.sparkSession, "letters").save(g, "grams")  # as each order counts them
    g = g.where(~F.substring("g", 4, 1).isin(barrier)).select(F.substring("g", 1, 3).alias("ctx"), F.substring("g", 4, 1).alias("letter"), "n")
    letters = F.explode(F.array(*[F.lit(c) for c in alphabet])).alias("letter")

    def order(k: int, name: str) -> DataFrame:
        at = F.substring("ctx", 4 - k, k) if k else F.lit("")
        n = g.groupBy(at.alias("c"), "letter").agg(F.sum("n").alias("n"))
        t = n.groupBy("c").agg(F.sum("n").alias("t"))
        full = t.select("c", "t", letters).join(n, ["c", "letter"], "left")
        return full.select(F.col("c").alias(f"c{k}"), "letter", ((F.coalesce("n", F.lit(0)) + LM_ALPHA) / (F.col("t") + v * LM_ALPHA)).alias(name))

    if unseen:
        every = F.array(*[F.lit(c) for c in [*alphabet, barrier]])
        three = df.sparkSession.range(1).select(F.explode(every).alias("a"), F.lit(every).alias("e")).select("a", F.explode("e").alias("b"), "e").select(F.concat("a", "b").alias("ab"), F.explode("e").alias("c"))
        out = three.select(F.concat("ab", "c").alias("ctx"), letters)
    else:
        out = g.select("ctx").distinct().select("ctx", letters)
    out = out.select("ctx", "letter", *[(F.substring("ctx", 4 - k, k) if k else F.lit("")).alias(f"c{k}") for k in range(4)])
    for k in range(4):
        out = out.join(F.broadcast(order(k, f"p{k}")), [f"c{k}", "letter"], "left")  # at most 23**k contexts for Hebrew
    # a context that isn't there has nothing but what each letter is given
    return out.select("ctx", "letter", sum((F.coalesce(F.col(f"p{k}"), F.lit(1.0 / v)) * w for k, w in enumerate(LM_WEIGHTS)), F.lit(0.0)).alias("p"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Counts in bins between the edges; the last bin holds its upper edge too, and values outside are left out."""
    x = F.col(value).cast("double")
    n = len(edges) - 1
    b = F.lit(None).cast("int")
    for i in reversed(range(n)):
        inside = (x >= edges[i]) & ((x <= edges[i + 1]) if i == n - 1 else (x < edges[i + 1]))
        b = F.when(inside, i).otherwise(b)
    return df.withColumn("bin", b).where("bin is not null").groupBy(*group, "bin").agg(F.count("*").alias("n"))


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    return [math.exp(math.log(lo) + (math.log(hi) - math.log(lo)) * i / n) for i in range(n + 1)]


def prune_worst(df: DataFrame, loss: str, key: str, share: float) -> DataFrame:
    """Adds `kept`: all but the share of rows with the greatest loss (ties by key). Rows without a loss go."""
    d = df.withColumn("_neg", -F.col(loss))
    n = d.where("_neg is not null").count()
    d = ordinal_rank(d, "_neg", key, "_place")
    return d.withColumn("kept", F.col("_place") >= int(share * n)).drop("_neg", "_place")
