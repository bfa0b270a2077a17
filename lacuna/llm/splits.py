"""Train, validation and test splits that keep related records together.

Records that share a value (a manuscript, a plate) are one group, and so on through further records. The graph is bipartite:
its nodes are the distinct values and its edges the distinct pairs of values, so a value that a third of all records share is
one node, and rows are brought down to distinct pairs before anything is shuffled by value.

Borůvka's contraction: in each round every component chooses its least edge to another one (edges have a random but fixed total
order, which keeps the chains short), the chosen edges go to the forest, and the components they join become one. At least half
of the components with an edge vanish in each round, so there are at most log2(nodes) rounds, and each works on the edges that
are left. The forest and each round's parents are written to the shared folder; no component is ever gathered anywhere.

Roots are stratified by size band (powers of two, largest first) and dealt in hash order, systematically, so every band is
dealt as evenly as it can be; the last band, of the smallest groups, gets the shares that the others left open. Only groups of
more than a tenth of the smallest split, of which there can be a bounded number at any size of input, are placed one by one.

Defined results: a null value links nothing; a record without any value is a group of its own; repeated records stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import distributed_rank, salted_join


def _min_edges(edges: DataFrame) -> DataFrame:
    """(c, to, a, b): each component's least edge. Minima are taken within tasks first, so a hub costs no more than others."""
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("to"), "w", "a", "b").unionByName(
        edges.select(F.col("v").alias("c"), F.col("u").alias("to"), "w", "a", "b")
    )
    least = both.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e"))
    return least.select("c", "e.to", "e.a", "e.b")


def _roots(parents: DataFrame, work) -> DataFrame:
    """(c, root) from (c, p) by pointer doubling; the only cycles are pairs that chose the same edge."""
    back = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    d = parents.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    while True:
        d = work.save(d, "parents")
        up = d.select(F.col("c").alias("p"), F.col("p").alias("pp")).where("p <> pp")
        nxt = d.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        nxt = work.save(nxt, "jump")
        d = nxt.drop("moved")
        if not nxt.where("moved").limit(1).count():
            return d.select("c", F.col("p").alias("root"))


class Forest:
    """edges: (a, b, round) of the spanning forest; roots: (node, root) of every node with an edge."""

    def __init__(self, edges: DataFrame | None, roots: DataFrame | None) -> None:
        self.edges = edges
        self.roots = roots


def spanning_forest(pairs: DataFrame, work) -> Forest:
    """The forest over distinct edges (a, b), nodes being strings that differ between the two sides."""
    e = pairs.where("a is not null and b is not null").select("a", "b").distinct()
    e = e.select(F.col("a").alias("u"), F.col("b").alias("v"), F.xxhash64("a", "b").alias("w"), "a", "b").where("u <> v")
    e = work.save(e, "edges")
    maps: list[DataFrame] = []
    chosen: list[DataFrame] = []
    while e.limit(1).count():
        least = work.save(_min_edges(e), "least")
        chosen.append(least.select("a", "b").distinct().withColumn("round", F.lit(len(chosen) + 1)))
        roots = _roots(least.select("c", F.col("to").alias("p")), work)
        maps.append(roots)
        u = roots.select(F.col("c").alias("u"), F.col("root").alias("ru"))
        v = roots.select(F.col("c").alias("v"), F.col("root").alias("rv"))
        e = e.join(u, "u", "left").join(v, "v", "left")
        e = e.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"), "w", "a", "b").where("u <> v")
        # of the edges between two components only the least can be chosen
        lo, hi = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        e = e.groupBy(lo, hi).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("u", "v", "e.w", "e.a", "e.b")
        e = work.save(e, "edges")
    if not maps:
        return Forest(None, None)
    # the last round has the fewest components: compose from there, so that all rounds together cost as much as two
    done = maps[-1]
    for m in reversed(maps[:-1]):
        up = done.select(F.col("c").alias("root"), F.col("root").alias("top"))
        done = work.save(m.join(up, "root", "left").select("c", F.coalesce("top", "root").alias("root")), "roots")
    forest = chosen[0]
    for c in chosen[1:]:
        forest = forest.unionByName(c)
    return Forest(forest, done.select(F.col("c").alias("node"), "root"))


def grouped(rows: DataFrame, key: str, first: Column, second: Column, work, keep: list[str] | None = None) -> tuple[DataFrame, Forest]:
    """The rows with their group: (key, keep..., first, second, root). Rows without any value have root null."""
    d = rows.select(key, *[F.col(k) for k in keep or []], first.alias("first"), second.alias("second"))
    a, b = F.concat(F.lit("a:"), F.col("first")), F.concat(F.lit("b:"), F.col("second"))
    forest = spanning_forest(d.select(a.alias("a"), b.alias("b")), work)
    d = d.withColumn("node", F.coalesce(a, b))
    if forest.roots is None:
        return d.withColumnRenamed("node", "root"), forest
    # distinct nodes find their root first; then rows, of which one node may have any share
    nodes = d.select("node").where("node is not null").distinct().join(forest.roots, "node", "left")
    nodes = nodes.select("node", F.coalesce("root", "node").alias("root"))
    return salted_join(d, nodes, ["node"], [key]).drop("node"), forest


def torn(groups: DataFrame, split: str) -> DataFrame:
    """(root, first_min): groups with more than one non-null split, and their least first value."""
    g = groups.where("root is not null").groupBy("root").agg(
        F.min(split).alias("_lo"), F.max(split).alias("_hi"), F.min("first").alias("first_min")
    )
    return g.where("_lo <> _hi").select("root", "first_min")


#: Groups with more than this part of the smallest split are placed one by one: at most 1 / (LARGE * its share) of them.
LARGE = 0.1
_STEP = 0.6180339887498949


def place_large(sizes: list[tuple[str, int]], want: dict[str, float]) -> tuple[dict[str, str], dict[str, float]]:
    """(group -> split, rows still wanted), largest first, each to the split that lacks the largest part of its rows and has
    room, or else to the one that lacks most."""
    left, out = dict(want), {}
    for g, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        fits = [s for s in want if want[s] > 0 and n <= left[s]]
        best = max(fits, key=lambda s: (left[s] / want[s], want[s], s)) if fits else max(left, key=lambda s: (left[s], s))
        out[g] = best
        left[best] -= n
    return out, left


def _ranges(x: Column, lack: dict[str, float]) -> Column:
    """The split into whose range of [0, 1) x falls; ranges are as wide as what the splits lack."""
    total, at = sum(lack.values()) or 1.0, 1.0
    out = F.lit(None).cast("string")
    for s in reversed(list(lack)):  # the last range first, so that each `when` is below its own upper edge
        out = F.when(x < at, F.lit(s)).otherwise(out)
        at -= lack[s] / total
    return F.coalesce(out, F.lit(max(lack, key=lambda s: lack[s])))


def deal(groups: DataFrame, key: str, shares: dict[str, float], work, seed: int = 0) -> DataFrame:
    """(key, root, split): every row's split. The few large groups are placed one by one; all others are dealt by a running
    place, band after band, whose multiples of the golden ratio fall evenly into the shares that are still wanted. The
    smallest band comes last and is cut, in hash order, at what the splits then lack."""
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must add up to 1")
    shares = {s: v for s, v in shares.items() if v > 0}
    rows = groups.withColumn("root", F.coalesce("root", F.concat(F.lit("r:"), F.col(key).cast("string"))))
    sizes = work.save(rows.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(1.0, LARGE * min(shares.values()) * total)
    large = [tuple(r) for r in sizes.where(F.col("n") > limit).collect()]  # at most 1 / (LARGE * the smallest share)
    placed, left = place_large(large, {s: v * total for s, v in shares.items()})
    spark = groups.sparkSession
    fixed = spark.createDataFrame([(g, s, n) for (g, n) in large for s in [placed[g]]], "root string, split string, n long")
    rest = sizes.where(F.col("n") <= limit).withColumn("band", F.floor(F.log2("n"))).withColumn("h", F.xxhash64(F.lit(seed), "root"))
    lowest = rest.agg(F.min("band")).first()[0] or 0
    # one running place over the bands: each has 4096 hash ranges, in order
    hashed = F.shiftright("h", 52) + 2048
    upper = distributed_rank(rest.where(F.col("band") > lowest).withColumn("_all", F.lit(0)), ["_all"], -F.col("band").cast("long") * 4096 + hashed, ["h", "root"], "place")
    lack = {s: max(0.0, v) for s, v in left.items()}
    upper = upper.select("root", _ranges((F.col("place") + 0.5) * _STEP % 1.0, lack).alias("split"), "n")
    done = work.save(upper.unionByName(fixed), "dealt")
    have = {r[0]: r[1] for r in done.groupBy("split").agg(F.sum("n")).collect()}
    last = distributed_rank(rest.where(F.col("band") == lowest).withColumn("_all", F.lit(0)), ["_all"], hashed, ["h", "root"], "place")
    count = rest.where(F.col("band") == lowest).count()
    lack = {s: max(0.0, v * total - have.get(s, 0)) for s, v in shares.items()}
    last = last.select("root", _ranges((F.col("place") + 0.5) / max(1, count), lack).alias("split"))
    return salted_join(rows.select(key, "root"), done.select("root", "split").unionByName(last), ["root"], [key]).select(key, "root", "split")
