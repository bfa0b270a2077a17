"""References to rows that are missing, deleted or not yet there.

Parents and references are merged into one order, by key and then by time, and each reference takes what stands before it.

On the key axis parents are compressed to runs. Sorted integer keys become runs (lo, hi) of consecutive keys, cut at the edges of
blocks; string keys get dense codes within their block, in sorted order, and their runs are told apart by codes that no parent
has. A reference is matched as-of to the run that starts at or before it, and beyond that run's end its key is missing. On the
time axis a key's rows are events on the microsecond axis: a row begins, and it comes in force or goes out of force. A reference
takes the sums of the events before it: nothing begun is late, nothing in force is deleted. Both axes are read in the same sorted
pass, so references are shuffled once and joined to nothing.

A block's references may be any share of all of them: hot blocks are found by one small aggregation, their references are spread
by a hash and only the block's parents are repeated. A key with very many parent rows is cut into days, each of which begins with
the sums of the days before.

Defined results: a null key refers to nothing; a parent row with a null loaded_at was never in force and isn't later than
anything; one whose deleted_at isn't after loaded_at was never in force either; a reference without a time finds nothing in
force ('missing' or 'deleted'). Repeated references are reported each. Other columns of the references stay; one named `reason` is
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import hot_keys

#: Keys in one block of the integer axis: runs are cut at its edges, so a block is all that a task must sort at once.
BLOCK = 1 << 12
SALTS = 32
_NEVER = -(1 << 62)
_DAY_US = 86_400_000_000


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def key_runs(parents: DataFrame, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, block, lo, hi): maximal runs of consecutive integer keys within blocks."""
    g = list(groups)
    d = parents.where(F.col(key).isNotNull()).select(*g, F.col(key).cast("long").alias("k")).distinct()
    d = d.withColumn("block", F.floor(F.col("k") / BLOCK))
    w = Window.partitionBy(*g, "block").orderBy("k")
    d = d.withColumn("run", F.col("k") - F.row_number().over(w))
    return d.groupBy(*g, "block", "run").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).drop("run")


def _events(parents: DataFrame, cols: list[str], start: str, end: str, mark: bool) -> DataFrame:
    """(cols, _t, _begin, _force): rows that begin, and the change of the number of rows in force, at each time of each key;
    with `mark` a key is there before all time too."""
    s, e = _us(start), _us(end)
    never = s.isNull() | (e.isNotNull() & (e <= s))
    at = lambda t, begin, force: F.struct(t.cast("long").alias("_t"), F.lit(begin).cast("long").alias("_begin"), force.cast("long").alias("_force"))
    first = at(F.coalesce(s, F.lit(_NEVER)), 1, F.when(never, 0).otherwise(1))
    last = F.when(~never & F.col(end).isNotNull(), at(e, 0, F.lit(-1)))
    marks = [at(F.lit(_NEVER), 0, F.lit(0))] if mark else []
    d = parents.select(*cols, F.inline(F.filter(F.array(*marks, first, last), lambda x: x.isNotNull())))
    return d.groupBy(*cols, "_t").agg(F.sum("_begin").alias("_begin"), F.sum("_force").alias("_force"))


def _by_day(events: DataFrame, refs: DataFrame, on: list[str], hot: list) -> tuple[DataFrame, DataFrame]:
    """Both with `_day`: 0, but for the few hot keys, which have very many events, the day. Such a key's days, which are one
    row each, begin with the sums of the days before."""
    zero = F.lit(0).cast("long").alias("_day")
    if not hot:
        return events.select("*", zero), refs.select("*", zero)
    marks = F.broadcast(events.sparkSession.createDataFrame(hot, events.select(*on).schema).withColumn("_hot", F.lit(True)))  # at most 1 / share
    day = F.when(F.col("_hot"), F.floor(F.coalesce("_t", F.lit(_NEVER)) / _DAY_US)).otherwise(0).cast("long")
    split = lambda d: d.join(marks, on, "left").withColumn("_day", day)
    e, r = split(events), split(refs)
    sums = e.where("_hot").groupBy(*on, "_day").agg(F.sum("_begin").alias("_begin"), F.sum("_force").alias("_force"))
    asked = r.where("_hot").select(*on, "_day", F.lit(0).cast("long").alias("_begin"), F.lit(0).cast("long").alias("_force"))
    days = sums.unionByName(asked.distinct()).groupBy(*on, "_day").agg(F.sum("_begin").alias("_begin"), F.sum("_force").alias("_force"))
    before = Window.partitionBy(*on).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*on, "_day", F.lit(_NEVER).cast("long").alias("_t"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_begin", "_force")])
    return e.drop("_hot").unionByName(carried), r.drop("_hot")


def judged(
    refs: DataFrame,
    parents: DataFrame,
    keys: Sequence[str],
    at: str,
    spread: Sequence[str],
    integer_key: str | None = None,
    start: str = "loaded_at",
    end: str = "deleted_at",
    share: float = 0.01,
    least: int = 50_000,
) -> DataFrame:
    """All rows of refs that refer to something, with `reason`: null if a row of parents is in force at time `at`, or else
    'missing', 'late' (all the key's rows start later) or 'deleted'. With an integer key its runs of consecutive keys are
    matched. `spread` names columns that tell rows of a hot key apart."""
    spark = refs.sparkSession
    known = " and ".join(f"{k} is not null" for k in keys)
    if integer_key:
        fixed = [k for k in keys if k != integer_key]
        part, axis = [f"_g{i}" for i in range(len(fixed))] + ["_block"], ["_k"]
        cols = [*[F.col(k).alias(f"_g{i}") for i, k in enumerate(fixed)], F.floor(F.col(integer_key).cast("long") / BLOCK).alias("_block"), F.col(integer_key).cast("long").alias("_k")]
    else:
        blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part, axis = ["_block"], [f"_k{i}" for i in range(len(keys))]
        cols = [F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(blocks)).alias("_block"), *[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]]
    r = refs.where(known).select(*cols, _us(at).alias("_t"), F.xxhash64(*spread).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in refs.columns if c != "reason"]).alias("_row"))
    p = parents.where(known).select(*cols, start, end)
    many = hot_keys(p, [*part, *axis], share, least)
    e, r = _by_day(_events(p, [*part, *axis], start, end, not integer_key), r, [*part, *axis], many)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    # 0 is a run, 1 an event, 2 a reference, in this order at equal places
    e = e.select(*part, *axis, "_day", "_t", F.lit(1).alias("_kind"), "_begin", "_force", none.alias("_end"))
    if integer_key:
        k = key_runs(p.select(*part[:-1], "_k"), "_k", part[:-1]).withColumnRenamed("block", "_block").withColumnRenamed("lo", "_k")
        days = e.select(*part, "_day").where("_day <> 0").distinct()
        k, own = k.withColumn("_day", zero), k
        k = k.unionByName(own.join(days, part)) if many else k
        k = k.select(*part, "_k", "_day", F.lit(_NEVER - 1).alias("_t"), F.lit(0).alias("_kind"), zero.alias("_begin"), zero.alias("_force"), F.col("hi").alias("_end"))
        e = e.unionByName(k)
    hot = hot_keys(r, [*part, "_day"], share, least)
    salt = F.lit(0)
    if hot:
        marks = F.broadcast(spark.createDataFrame(hot, r.select(*part, "_day").schema).withColumn("_hot", F.lit(True)))  # at most 1 / share
        r = r.join(marks, [*part, "_day"], "left")
        e = e.join(marks, [*part, "_day"], "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
        salt = F.when(F.col("_hot"), F.pmod("_h", F.lit(SALTS))).otherwise(0).cast("int")
    else:
        e = e.withColumn("_salt", F.lit(0))
    r = r.select(*part, *axis, "_day", "_t", F.lit(2).alias("_kind"), zero.alias("_begin"), zero.alias("_force"), none.alias("_end"), salt.alias("_salt"), "_row")
    both = e.withColumn("_row", F.lit(None).cast(r.schema["_row"].dataType)).unionByName(r)
    whole = [*part, "_day", "_salt"]
    upto = Window.partitionBy(*whole).orderBy(*axis, F.asc_nulls_last("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    code = F.col("_k") if integer_key else F.dense_rank().over(Window.partitionBy(*whole).orderBy(*axis)).cast("long")
    last = F.col("_end") if integer_key else F.when(F.col("_kind") == 1, F.col("_code"))
    within = Window.partitionBy(*whole, *axis).orderBy(F.asc_nulls_last("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("_code", code).withColumn("_last", F.last(last, ignorenulls=True).over(upto))
    d = d.withColumn("_begun", F.sum("_begin").over(within)).withColumn("_live", F.sum("_force").over(within)).where("_kind = 2")
    reason = (
        F.when(F.col("_last").isNull() | (F.col("_code") > F.col("_last")), "missing")
        .when(F.col("_t").isNull(), "deleted")
        .when(F.col("_live") > 0, None)
        .when(F.col("_begun") == 0, "late")
        .otherwise("deleted")
    )
    return d.select("_row.*", reason.alias("reason"))


def orphans(refs: DataFrame, parents: DataFrame, keys: Sequence[str], at: str, spread: Sequence[str], integer_key: str | None = None, **options) -> DataFrame:
    """The rows of `judged` that have a reason."""
    return judged(refs, parents, keys, at, spread, integer_key, **options).where(F.col("reason").isNotNull())
