"""Operators on positions: runs, diagonals, chains of lines, spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import WorkDir
from .skew import crossed

#: Letters of queries and of targets that are compared in one task for common runs.
RUN_GROUP, RUN_BLOCK = 6_000_000, 12_000_000
NO_LETTER = 0xFFFFFFFF

#: Values of the order that a task takes together: groups of any size are cut into such stretches.
STRETCH = 1 << 14


def islands(df: DataFrame, group: Sequence[str], order: str, state: Column) -> DataFrame:
    """(group, state, first, last, length): maximal runs of rows with the same state. `order` is a whole number. Runs are made in
    stretches of it; the first and the last run of each stretch are then joined over the edges."""
    g = list(group)
    d = df.select(*g, F.col(order).alias("_o"), state.alias("state")).withColumn("_c", F.floor(F.col("_o") / STRETCH))
    w = Window.partitionBy(*g, "_c").orderBy("_o")
    d = d.withColumn("_new", (~F.col("state").eqNullSafe(F.lag("state").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    d = d.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*g, "_c", "state", "_id").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("length"))
    runs = runs.withColumn("_n", F.max("_id").over(Window.partitionBy(*g, "_c")))
    edge = runs.where((F.col("_id") == 1) | (F.col("_id") == F.col("_n")))  # two for each stretch
    v = Window.partitionBy(*g).orderBy("first")
    joins = F.col("state").eqNullSafe(F.lag("state").over(v)) & (F.col("_id") == 1) & (F.lag("_c").over(v) != F.col("_c"))
    edge = edge.withColumn("_isl", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*g, "state", "_isl").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"))
    cols = [*g, "state", "first", "last", "length"]
    out = runs.where((F.col("_id") > 1) & (F.col("_id") < F.col("_n"))).select(*cols).unionByName(edge.select(*cols))
    return out


def median_step(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """(group, n, pitch): the median difference of consecutive values, in stretches of the order, whose edges are joined."""
    g = list(group)
    d = df.select(*g, F.col(order).alias("_o"), F.col(value).alias("_v")).withColumn("_c", F.floor(F.col("_o") / STRETCH))
    steps = d.select(*g, (F.col("_v") - F.lag("_v").over(Window.partitionBy(*g, "_c").orderBy("_o"))).alias("_d"))
    ends = d.groupBy(*g, "_c").agg(F.min_by("_v", "_o").alias("_a"), F.max_by("_v", "_o").alias("_b"))
    over = ends.select(*g, (F.col("_a") - F.lag("_b").over(Window.partitionBy(*g).orderBy("_c"))).alias("_d"))
    n = steps.unionByName(over).where("_d is not null").groupBy(*g, F.col("_d").cast("double").alias("_d")).agg(F.count("*").alias("_n"))
    return n.groupBy(*g).agg(F.sum("_n").alias("n"), F.expr("percentile(_d, 0.5D, _n)").alias("pitch"))


def windows_of(df: DataFrame, keep: Sequence[str], text: str, size: int, chunk: int = 256) -> DataFrame:
    """(keep..., pos, gram): all windows of a text, from chunks that overlap, as substrings of long texts are slow."""
    n = F.length(text)
    d = df.where(n >= size).select(*keep, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), F.floor((n - size) / chunk).cast("int"))).alias("_c"))
    d = d.select(*keep, (F.col("_c") * chunk).alias("_at"), F.substring("_t", F.col("_c") * chunk + 1, F.lit(chunk + size - 1)).alias("_b"))
    grams = F.transform(F.sequence(F.lit(0), F.length("_b") - size), lambda i: F.struct((F.col("_at") + i).alias("pos"), F.substring(F.col("_b"), i + 1, F.lit(size)).alias("gram")))
    return d.select(*keep, F.inline(grams))


def common_runs(queries: DataFrame, targets: DataFrame, qkey: str, tkey: str, text: str, size: int, apart: tuple[str, str] | None = None, group: int = RUN_GROUP, block: int = RUN_BLOCK) -> DataFrame:
    """(qkey, tkey, q_start, t_start, length): maximal runs of at least `size` letters that a query and a target share. `apart`
    names a column of the queries and one of the targets that must differ, and not be null. Keys are strings or numbers.

    Parts of about `group` and `block` letters of both meet in tasks of their own, in which places with equal seeds are merged,
    those that begin a run are kept and are followed to its end: neither seeds nor their pairs are sent about or written."""
    of_q, of_t = apart or (None, None)
    cols = lambda df, key, of: df.where(F.length(text) >= size).select(F.col(key).alias("k"), F.col(text).alias("s"), (F.col(of) if of else F.lit(None)).cast("string").alias("f"))
    work = WorkDir(queries.sparkSession, "runs")
    q, t = work.save(cols(queries, qkey, of_q), "queries"), work.save(cols(targets, tkey, of_t), "targets")
    letters = lambda df: int(df.agg(F.sum(F.length("s"))).first()[0] or 0)
    groups, n = max(1, -(-letters(q) // group)), letters(t)
    blocks = max(1, -(-n // block), min(-(-2 * q.sparkSession.sparkContext.defaultParallelism // groups), -(-n // 50_000)))
    schema = T.StructType([T.StructField(qkey, q.schema["k"].dataType), T.StructField(tkey, t.schema["k"].dataType), *T._parse_datatype_string("q_start int, t_start int, length int").fields])
    kinds = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x in range(batch.num_rows):
                left, right = (pa.concat_arrays([batch.column(i)[x].values]) for i in (0, 1))
                for i, j, a, b, n in merged_runs(left.field(1), right.field(1), size, (left.field(2), right.field(2)) if apart else None):
                    yield pa.RecordBatch.from_arrays([left.field(0).take(pa.array(i)), right.field(0).take(pa.array(j)), *(pa.array(v, pa.int32()) for v in (a, b, n))], schema=kinds)

    return crossed(q, t, "k", "k", groups, blocks).mapInArrow(run, schema)


def merged_runs(left, right, size: int, of=None, piece: int = 1 << 20):
    """Maximal common runs of the texts of two Arrow arrays, in batches: (indexes of left, of right, starts in both, lengths).
    Seeds are compared by a number that other letters could give too, so a run is followed from its first letter on."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def laid(texts):
        """(letters, each text with a letter of its own side after it; text and place of each letter; numbers of seeds)."""
        n = pc.utf8_length(texts).to_numpy().astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(n + 1)))
        codes = np.full(int(starts[-1]) + size, NO_LETTER, dtype=np.uint32)
        which = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        inner = np.arange(int(starts[-1])) != np.repeat(starts[1:] - 1, n + 1)
        codes[: len(inner)][inner] = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
        seeds = np.zeros(len(inner), dtype=np.uint64)
        for i in range(size):
            seeds = seeds * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(inner)]
        at = np.flatnonzero(np.repeat(starts[1:] - 1, n + 1) - np.arange(len(inner)) >= size)  # a seed doesn't leave its text
        return codes, which, starts, seeds[at] ^ (seeds[at] >> np.uint64(29)), at

    a = laid(left)
    if of:
        x = pa.concat_arrays([o.cast(pa.string()) for o in of]).dictionary_encode().indices.fill_null(-1).to_numpy()
        family = x[: len(left)], x[len(left) :]
    oa = np.argsort(a[3])
    known, first, many = np.unique(a[3][oa], return_index=True, return_counts=True)
    cut = np.cumsum(pc.utf8_length(right).to_numpy()) // (2 * piece)
    for base, end in zip(*(np.searchsorted(cut, np.unique(cut), side=s) for s in ("left", "right"))) if len(known) else []:
        b = laid(right.slice(base, end - base))
        b[0][b[0] == NO_LETTER] -= 1  # what follows or precedes a text is equal to nothing
        ob = np.argsort(b[3])
        i = np.minimum(np.searchsorted(known, b[3][ob]), len(known) - 1)
        hit = known[i] == b[3][ob]
        places, i = b[4][ob[hit]], i[hit]
        # the places of each seed, in pieces of about as many pairs
        cuts = np.cumsum(many[i]) // piece
        for lo, hi in zip(*(np.searchsorted(cuts, np.unique(cuts), side=s) for s in ("left", "right"))):
            n = many[i[lo:hi]]
            q = a[4][oa[np.repeat(first[i[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
            t = np.repeat(places[lo:hi], n)
            begins = (a[0][q - 1] != b[0][t - 1]) | (q == 0) | (t == 0)
            q, t = q[begins], t[begins]
            if of:
                f, g = family[0][a[1][q]], family[1][base + b[1][t]]
                far = (f != g) & (f >= 0) & (g >= 0)
                q, t = q[far], t[far]
            length, on = np.zeros(len(q), dtype=np.int32), np.arange(len(q))
            while len(on):
                on = on[a[0][q[on] + length[on]] == b[0][t[on] + length[on]]]
                length[on] += 1
            good = length >= size
            q, t, length = q[good], t[good], length[good]
            for k in range(0, len(q), 1 << 16):
                s = slice(k, k + (1 << 16))
                i_q, i_t = a[1][q[s]], b[1][t[s]]
                yield i_q, base + i_t, q[s] - a[2][i_q], t[s] - b[2][i_t], length[s]


def chain_lines(scores: DataFrame, group: Sequence[str], line: str, pos: str, score: str, lines: int, lo: int = 15, hi: int = 140) -> DataFrame:
    """(group, pos, score): the score of a chain of lines that starts at each position. Each line starts lo to hi positions
    after the one before it and adds max(score, 0), so a line may be skipped; a line past the end adds 0. Lines are numbered
    from 0; every group must have a row for each line and position."""
    g = list(group)
    wide = scores.groupBy(*g, pos).agg(*[F.max(F.when(F.col(line) == k, F.greatest(F.col(score), F.lit(0.0)))).alias(f"_s{k}") for k in range(lines)])
    # a group is cut into stretches, each with as much of the next one as a chain can reach
    halo = hi * max(0, lines - 1)
    size = max(STRETCH, halo)
    own = F.floor(F.col(pos) / size)
    wide = wide.withColumn("_own", own).withColumn("_c", F.explode(F.array_compact(F.array(own, F.when(F.col(pos) - own * size < halo, own - 1)))))
    w = Window.partitionBy(*g, "_c").orderBy(pos).rangeBetween(lo, hi)
    d = wide.withColumn("_t", F.coalesce(f"_s{lines - 1}", F.lit(0.0)))
    for k in reversed(range(lines - 1)):
        d = d.withColumn("_t", F.coalesce(f"_s{k}", F.lit(0.0)) + F.coalesce(F.max("_t").over(w), F.lit(0.0)))
    return d.where("_own = _c").select(*g, pos, F.col("_t").alias(score))


def suppressed(df: DataFrame, query: str, key: str, pos: str, score: str, apart: int = 50, top: int = 200, keep: int = 5, within: bool = False) -> DataFrame:
    """Of each query's best `top` rows, the best that are at least `apart` positions from every better one kept; at most `keep`,
    with `rank`. With `within` positions are those in a key, and rows of different keys are far apart. Greedy, so a small fold
    over at most `top` rows of each query; it stays in the JVM."""
    w = Window.partitionBy(query).orderBy(F.desc(score), *([key] if within else []), pos)
    d = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    item = F.struct(F.col("_r"), F.col(pos).cast("long").alias("p"), F.col(score).cast("double").alias("s"), F.col(key).cast("string").alias("k"))
    g = d.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("a"))
    none = F.slice(F.col("a"), 1, 0)
    near = lambda x: lambda y: (y["k"].eqNullSafe(x["k"]) if within else F.lit(True)) & (F.abs(y["p"] - x["p"]) < apart)
    fold = F.aggregate("a", none, lambda acc, x: F.when((F.size(acc) < keep) & ~F.exists(acc, near(x)), F.array_append(acc, x)).otherwise(acc))
    out = g.select(query, F.posexplode(fold).alias("_i", "x"))
    return out.select(query, (F.col("_i") + 1).alias("rank"), F.col("x.k").alias(key), F.col("x.p").alias(pos), F.col("x.s").alias(score))


def spaced_peaks(peaks: DataFrame, group: Sequence[str], order: str, value: str, apart: float) -> DataFrame:
    """Of peaks the highest ones that are at least `apart` from every higher one kept (ties: the first). A group's peaks are
    folded in the order of their height; they are local maxima, so at most half of the group's rows."""
    item = F.struct((-F.col(value)).alias("h"), F.col(order).alias("o"), F.col(value).alias("v"))
    g = peaks.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("a"))
    fold = F.aggregate("a", F.slice(F.col("a"), 1, 0), lambda acc, x: F.when(~F.exists(acc, lambda y: F.abs(y["o"] - x["o"]) < apart), F.array_append(acc, x)).otherwise(acc))
    return g.select(*group, F.explode(fold).alias("x")).select(*group, F.col("x.o").alias(order), F.col("x.v").alias(value))


def local_peaks(df: DataFrame, group: Sequence[str], order: str, value: str, share: float = 0.2) -> DataFrame:
    """Rows at least as large as the one before, larger than the next and above `share` of the group's maximum."""
    w = Window.partitionBy(*group).orderBy(order)
    d = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_m", F.max(value).over(Window.partitionBy(*group)))
    return d.where((F.col(value) >= F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) > F.col("_m") * share)).drop("_a", "_b", "_m")


def autocorrelation(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """(group, lag, ac): sums of products of mean-free values at each lag, as a share of lag 0."""
    g = list(group)
    m = df.groupBy(*g).agg(F.avg(value).alias("_mu"))
    d = df.join(m, g).select(*g, F.col(order).alias("_o"), (F.col(value) - F.col("_mu")).alias("_x"))
    a = d.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("_to", F.col("_o") + F.col("lag"))
    b = d.select(*g, F.col("_o").alias("_to"), F.col("_x").alias("_y"))
    s = a.join(b, [*g, "_to"]).groupBy(*g, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("s"))
    zero = s.where("lag = 0").select(*g, F.col("s").alias("_z"))
    return s.join(zero, g).select(*g, "lag", F.try_divide("s", "_z").alias("ac"))


def first_period(ac: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, lag, ac): the highest correlation after the lag at which it first falls below 0 (ties: the least lag), given
    ac(group, lag, ac). Groups whose correlation doesn't fall below 0 have none."""
    g = list(group)
    cross = ac.where("ac < 0").groupBy(*g).agg(F.min("lag").alias("_c"))
    late = ac.join(cross, g).where(F.col("lag") > F.col("_c"))
    return late.groupBy(*g).agg(F.max_by("lag", F.struct("ac", -F.col("lag"))).alias("lag"), F.max("ac").alias("ac"))
