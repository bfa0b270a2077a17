"""Audits of links: does the linked text fit a reading better than chance, and does another one fit better?

Controls are other readings, of other manuscripts and compositions, without a run of letters in common with the text that is
searched. They are taken from a fixed random order of all readings, from a place on that depends on the text, so that no reading
is paired with every text; and of a link's controls those of similar length count, or the nearest ones where there are few.

Defined results: a link without controls has p 1 and z null; a fragment that no control was scored on has z null; of equal
fragments the lesser label is the best; readings without letters have no scores and aren't audited.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import WorkDir
from .calibration import fisher
from .relational import top_per_group
from .skew import distributed_rank

#: Letters in a row that make a text and a reading parallel.
PARALLEL = 8


def decoys(readings: DataFrame, groups: DataFrame, grams_of_readings: DataFrame, grams_of_groups: DataFrame, many: int = 100, seed: str = "11") -> DataFrame:
    """(g, q, k): up to `many` readings for each group, of the 3 * many ones from the group's place in the random order on: none
    of the own manuscript or composition and none with a gram of the group. readings(q, ms, comp), groups(g, comp), grams (q,
    gram) and (g, gram). Null compositions are not the same as any."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("q")))
    pool = readings.select("q", "ms", "comp", order.alias("_h")).withColumn("_all", F.lit(0))
    size = pool.count()
    pool = distributed_rank(pool, ["_all"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"), ["_h", "q"], "_r").select("q", "ms", F.col("comp").alias("_comp"), "_r")
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("g"))), 1, 7), 16, 10).cast("long") % max(size, 1)
    span = min(3 * many, size)
    steps = F.sequence(F.lit(0), F.lit(span - 1)) if span else F.array().cast("array<int>")
    d = groups.select("g", "comp", first.alias("_s"), F.explode(steps).alias("k")).withColumn("_r", (F.col("_s") + F.col("k")) % max(size, 1))
    # the planner takes the groups for as few as they were before they were repeated, and would collect and broadcast them
    d = d.hint("merge").join(pool, "_r").where((F.col("ms") != F.col("g")) & ~F.coalesce(F.col("comp") == F.col("_comp"), F.lit(False))).select("g", "q", "k")
    # grams of few groups are met by the grams; those of many by the candidates, of which a group has 3 * many at most
    work = WorkDir(readings.sparkSession, "decoys")
    gq = work.save(grams_of_readings.select("q", "gram").distinct(), "of_readings")
    gg = grams_of_groups.select("g", "gram").join(groups.select("g").distinct(), "g", "left_semi")
    gg = work.save(gg.join(gq.select("gram").distinct(), "gram", "left_semi").select("g", "gram").distinct(), "of_groups")
    common = gg.groupBy("gram").agg(F.count("*").alias("_n")).where(F.col("_n") > 3 * many).select("gram", F.lit(True).alias("_common"))
    gg = gg.join(common, "gram", "left")
    rare = gq.join(gg.where("_common is null"), "gram").select("g", "q")
    of_many = d.select("g", "q").join(gq.join(common, "gram").select("q", "gram"), "q").join(gg.where("_common"), ["g", "gram"], "left_semi").select("g", "q")
    same = rare.unionByName(of_many).distinct()
    return top_per_group(d.join(same, ["g", "q"], "left_anti"), ["g"], [F.col("k")], many, "_n").drop("_n")


def controls(own: DataFrame, pool: DataFrame, ratio: float = 1.5, least: int = 20) -> DataFrame:
    """(q, g, c): of each link's pool(g, c, n) the readings whose number of letters is within the ratio of its own, or if they
    are fewer than `least` the `least` nearest in log length (ties: the lesser c). own(q, g, n); a pool is small."""
    d = own.select("q", "g", F.col("n").alias("_q")).join(pool, "g").where(F.col("c") != F.col("q"))
    d = d.withColumn("_d", F.round(F.abs(F.log(F.col("n") / F.col("_q"))), 12))
    near = F.col("_d") <= math.log(ratio) + 1e-12
    w = Window.partitionBy("q", "g")
    d = d.withColumn("_in", near).withColumn("_n", F.count_if(near).over(w)).withColumn("_r", F.row_number().over(w.orderBy("_d", "c")))
    return d.where(F.when(F.col("_n") >= least, F.col("_in")).otherwise(F.col("_r") <= least)).select("q", "g", "c")


def fit(own: DataFrame, pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(q, g, frag, n_controls, p_own, z_own, best_frag, z_best, p_fw) of own(q, g, frag) from the scores(q, g, frag, score) of
    links and controls in all fragments of the group, and pairs(q, g, c) of links and controls."""
    by = ["q", "g"]
    of_control = pairs.join(scores.withColumnRenamed("q", "c"), ["g", "c"])
    stats = of_control.groupBy(*by, "frag").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
    z = lambda s: (s - F.col("mu")) / (F.col("sd") + 1e-6)
    real = scores.join(own.select(*by).distinct(), by, "left_semi").join(stats, [*by, "frag"], "left").withColumn("z", z(F.col("score")))
    best = real.groupBy(*by).agg(F.min(F.struct((-F.col("z")).alias("z"), "frag")).alias("b"))
    best = best.select(*by, F.col("b.frag").alias("best_frag"), (-F.col("b.z")).alias("z_best"))
    top = of_control.join(stats, [*by, "frag"]).groupBy(*by, "c").agg(F.max(z(F.col("score"))).alias("z_max"))
    family = best.join(top, by, "left").groupBy(*by, "best_frag", "z_best").agg(F.count("z_max").alias("n_controls"), F.count_if(F.round("z_max", 9) >= F.round("z_best", 9)).alias("ge"))
    family = family.withColumn("p_fw", (F.col("ge") + 1) / (F.col("n_controls") + 1)).drop("ge")
    mine = own.select(*by, "frag").join(real.select(*by, "frag", "score", F.col("z").alias("z_own")), [*by, "frag"], "left")
    above = mine.join(of_control.select(*by, "frag", F.col("score").alias("s_c")), [*by, "frag"], "left")
    above = above.groupBy(*by, "frag", "z_own", "score").agg(F.count_if(F.col("s_c") >= F.col("score")).alias("ge"), F.count("s_c").alias("n"))
    p = F.when(F.col("score").isNull(), 1.0).otherwise((F.col("ge") + 1) / (F.col("n") + 1))
    out = above.select(*by, "frag", p.alias("p_own"), "z_own").join(family, by, "left")
    return out.select(*by, "frag", F.coalesce("n_controls", F.lit(0)).alias("n_controls"), "p_own", "z_own", "best_frag", "z_best", F.coalesce("p_fw", F.lit(1.0)).alias("p_fw"))


def expected_hits(hits: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Adds p_decoy and E to hits(q, g, n, score): against the best scores of readings of other groups of similar length; E is
    p times the number of readings searched. Lengths and groups are counted first, so no pair of readings is made: the scores of
    a length are summed up in the order of the scores."""
    step = math.log(ratio)
    total = hits.count()
    want = hits.select("q", "g", "n", "score").withColumn("_b", F.explode(F.array(*[F.floor(F.log(F.col("n").cast("double")) / step) + d for d in (-1, 0, 1)])))
    have = hits.groupBy(F.col("g").alias("_g"), F.col("n").alias("_n"), F.col("score").alias("_s")).agg(F.count("*").alias("_k")).withColumn("_b", F.floor(F.log(F.col("_n").cast("double")) / step))
    near = F.abs(F.log(F.col("_n") / F.col("n"))) <= step + 1e-12
    j = want.join(have, "_b").where(near & (F.col("g") != F.col("_g")))
    c = j.groupBy("q").agg(F.sum("_k").alias("n_decoys"), F.sum(F.when(F.col("_s") >= F.col("score"), F.col("_k")).otherwise(0)).alias("_ge"))
    out = hits.join(c, "q", "left")
    out = out.withColumn("p_decoy", (F.coalesce("_ge", F.lit(0)) + 1) / (F.coalesce("n_decoys", F.lit(0)) + 1)).drop("_ge", "n_decoys")
    return out.withColumn("E", F.col("p_decoy") * total)


# ---------------------------------------------------------------- groups of readings
def mixed_groups(pieces: DataFrame, ks: tuple[int, ...], draws: int, seed: str = "1") -> DataFrame:
    """(k, draw, q): groups of k readings of k owners, which share no source, in a fixed random order; none where there are fewer
    owners than k. pieces(q, owner)."""
    h = lambda c: F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(c)))
    p = pieces.where("q is not null and owner is not null").select("q", "owner").distinct()
    owners = p.select("owner").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    chosen = top_per_group(owners, ["draw"], [h("owner"), F.col("owner")], max(ks), "r")
    one = chosen.join(p, "owner").groupBy("draw", "r").agg(F.min_by("q", F.struct(h("q"), "q")).alias("q"))
    return _complete(one.withColumn("owner", F.lit("")), ks).drop("owner")


def own_groups(pieces: DataFrame, ks: tuple[int, ...], draws: int, seed: str = "2") -> DataFrame:
    """(owner, k, draw, q): groups of k readings of one owner; none of owners with fewer."""
    p = pieces.where("q is not null and owner is not null").select("q", "owner").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("q")))
    return _complete(top_per_group(p, ["owner", "draw"], [h, F.col("q")], max(ks), "r"), ks)


def _complete(d: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Groups of each size out of ranked members r = 1, 2, ..., those that have all of them."""
    d = d.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: k >= F.col("r"))))
    full = d.groupBy("owner", "draw", "k").agg(F.count("*").alias("_n")).where("_n = k").drop("_n")
    return d.join(full, ["owner", "draw", "k"], "left_semi").select("owner", "k", "draw", "q")


def group_validation(p: DataFrame, mixed: DataFrame, own: DataFrame) -> DataFrame:
    """(k, groups, own, threshold, over, over_own): groups of one owner, how many have it as the document of the largest sum of
    -ln p, the statistic that 1 % of mixed groups exceed, and how many groups reach it, and of these how many with their owner.
    p(q, doc, p), groups from `mixed_groups` and `own_groups`; rows with p = 1 may be left out, but for one of each reading. Draws
    that are the same readings, as most are of an owner with few, are summed up once."""
    null = fisher(mixed.join(p, "q"), ["k", "draw"], "doc")
    limit = null.groupBy("k").agg(F.expr("percentile(stat, 0.99D)").alias("threshold"))
    drawn = own.groupBy("owner", "k", "draw").agg(F.array_sort(F.collect_list("q")).alias("qs")).groupBy("owner", "k", "qs").agg(F.count("*").alias("_n"), F.min("draw").alias("draw"))
    drawn = WorkDir(p.sparkSession, "drawn").save(drawn, "drawn")
    of = ["owner", "k", "draw"]
    real = fisher(drawn.select(*of, F.explode("qs").alias("q")).join(p, "q"), of, "doc").join(drawn.select(*of, "_n"), of).join(limit, "k", "left")
    hit, over = F.col("doc") == F.col("owner"), F.coalesce(F.col("stat") >= F.col("threshold"), F.lit(False))
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).alias(name)
    g = real.groupBy("k", "threshold").agg(F.sum("_n").alias("groups"), n(hit, "own"), n(over, "over"), n(over & hit, "over_own"))
    return g.select("k", "groups", "own", "threshold", "over", "over_own")
