"""Joins and ranks that keep no unbounded group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01, least: int = 50_000) -> list:
    """Keys with more than `share` of all rows (and more than `least`): at most 1/share of them, whatever the input. One job:
    the total is a grouping set of its own, counted within tasks like the keys."""
    keys = list(keys)
    n = df.select(*keys).groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(F.count("*").alias("_n"), F.grouping_id().alias("_set"))
    top = n.where((F.col("_set") > 0) | (F.col("_n") > least)).orderBy(F.desc("_set"), F.desc("_n")).limit(int(1 / share) + 2).collect()
    total = sum(r["_n"] for r in top if r["_set"])
    return [tuple(r[k] for k in keys) for r in top if not r["_set"] and r["_n"] > share * total]


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = 32,
    share: float = 0.01,
    least: int = 50_000,
) -> DataFrame:
    """big ⋈ small where a key may hold any share of big's rows. Rows of hot keys are spread by a hash of the columns `spread`
    over `salts` groups, and only the few hot keys' rows of small are repeated. `how` is 'left' or 'inner'. Nothing is
    dropped: without hot keys it is the plain join. Salts come from a hash, so a task run again makes the same rows."""
    on = list(on)
    hot = hot_keys(big, on, share, least)
    if not hot:
        return big.join(small, on, how)
    spark = big.sparkSession
    marks = F.broadcast(spark.createDataFrame(hot, big.select(*on).schema).withColumn("_hot", F.lit(True)))  # <= 1/share rows
    b = big.join(marks, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    s = small.join(marks, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def crossed(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_parts: int, right_parts: int) -> DataFrame:
    """(_l, _r): each part of the left rows with each part of the right rows, as arrays of structs, a pair to a row. Parts are
    dealt by the hash of a key; a part is gathered once and sent once for each part of the other side, never as a pair."""
    n = 4 * left_parts * right_parts  # hashed: with as many partitions as pairs, some would get three or four

    def parts(df: DataFrame, key: str, size: int, own: str, other: str, others: int, name: str) -> DataFrame:
        g = df.groupBy(F.pmod(F.xxhash64(key), F.lit(size)).cast("int").alias(own)).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        return g.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(n, "_a", "_b")

    a = parts(left, left_key, left_parts, "_a", "_b", right_parts, "_l")
    return a.hint("merge").join(parts(right, right_key, right_parts, "_b", "_a", left_parts, "_r"), ["_a", "_b"]).select("_l", "_r")


def running_total(
    df: DataFrame,
    part: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    value: Column,
    name: str,
) -> DataFrame:
    """Adds `name`: the sum of `value` over all earlier rows of the part, itself excluded. `bucket` must not fall along
    `order`. Only one bucket of a part is in one task; the buckets' sums, one row each, carry the totals over."""
    d = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    parts = list(part)
    sums = d.groupBy(*parts, "_bucket").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    for k in [*parts, "_bucket"]:
        before = before.withColumnRenamed(k, f"_k_{k}")
    own = Window.partitionBy(*parts, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = d.withColumn("_inner", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    hit = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*parts, "_bucket"]]
    cond = hit[0]
    for h in hit[1:]:
        cond = cond & h
    out = inner.join(before, cond, "left").withColumn(name, F.col("_inner") + F.coalesce("_before", F.lit(0)))
    return out.drop("_bucket", "_value", "_inner", "_before", *[f"_k_{k}" for k in [*parts, "_bucket"]])


def distributed_rank(df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds `name`: the row's place in its part, from 0, in the order given (which must be total)."""
    return running_total(df, part, bucket, order, F.lit(1), name)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it has fewer partitions than the session has cores (a few small files before costly work per row).
    Larger inputs have more partitions than that and stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """df hashed into a fixed number of partitions. Adaptive execution joins small partitions by their bytes, which would put
    costly work per row into a few tasks; it leaves this number alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def rank_bucket(df: DataFrame, value: str, key: str, parts: int = 256) -> Column:
    """A bucket for `distributed_rank` by (value, key), key a string: between two of the quantiles of value, so that outliers or
    a skewed distribution don't put all rows into a few; a quantile itself, which many rows can share, is a bucket of its own,
    cut further by the first letters of the key. Quantiles are rough; only the sizes of the buckets hang on them."""
    got = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 2 * parts)).first()[0]
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(got or []))]).cast("array<double>")
    x = F.col(value).cast("double")
    on = F.array_contains(cuts, x)
    place = F.size(F.filter(cuts, lambda c: c < x)) * 2 + on.cast("int")
    head = F.rpad(F.hex(F.encode(F.substring(F.col(key).cast("string"), 1, 8), "UTF-8")), 12, "0")
    return F.struct(place.alias("place"), F.when(on, F.coalesce(F.substring(head, 1, 12), F.lit(""))).otherwise("").alias("head"))
