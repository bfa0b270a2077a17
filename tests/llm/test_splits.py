import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lacuna.llm import splits
from lacuna.llm.splits import deal, grouped, place_large, torn


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a, b in rows:
        for v in (("a", a), ("b", b)):
            if v[1] is not None:
                parent[find(("k", k))] = find(v)
        find(("k", k))
    out = defaultdict(set)
    for k, _, _ in rows:
        out[find(("k", k))].add(k)
    return {frozenset(v) for v in out.values()}


def build(spark, work, rows):
    d = spark.createDataFrame(rows, "k long, a string, b string")
    return grouped(d, "k", F.col("a"), F.col("b"), work)


def test_groups_are_connected_components(spark, work):
    rnd = random.Random(3)
    for n in (0, 1, 40, 400):
        val = lambda m: rnd.choice([None, f"v{rnd.randrange(m)}", f"v{rnd.randrange(m)}"])
        rows = [(i, val(max(2, n // 2)), val(max(2, n // 2))) for i in range(n)]
        g, forest = build(spark, work, rows)
        got = defaultdict(set)
        for r in g.collect():
            got[r["root"] or ("alone", r["k"])].add(r["k"])
        assert {frozenset(v) for v in got.values()} == components(rows)
        if forest.edges is not None:
            nodes = {("a", a) for _, a, b in rows if a and b} | {("b", b) for _, a, b in rows if a and b}
            comps = len({r["root"] for r in forest.roots.collect()})
            assert forest.edges.count() == len(nodes) - comps


def test_long_chain_and_hub(spark, work):
    chain = [(i, f"x{i}", f"y{i}") for i in range(200)] + [(1000 + i, f"x{i + 1}", f"y{i}") for i in range(199)]
    hub = [(5000 + i, "hub", f"p{i}") for i in range(300)]
    g, _ = build(spark, work, chain + hub)
    assert sorted(Counter(r["root"] for r in g.collect()).values()) == [300, 399]


def test_deal_keeps_groups_and_shares(spark, work):
    rows = [(i, f"m{min(i // 3, 900)}" if i % 5 else None, None) for i in range(6000)]
    g, _ = build(spark, work, rows)
    out = deal(g, "k", {"train": 0.8, "val": 0.1, "test": 0.1}, work).collect()
    assert len(out) == 6000
    by = defaultdict(set)
    for r in out:
        by[r["root"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    n = Counter(r["split"] for r in out)
    assert abs(n["train"] - 4800) <= 60 and abs(n["val"] - 600) <= 60 and abs(n["test"] - 600) <= 60


@pytest.mark.parametrize("n", [300, 1000, 5000])
def test_groups_of_every_size_are_dealt(spark, work, n, monkeypatch):
    rnd = random.Random(n)
    rows = [(i, f"m{int(rnd.paretovariate(0.8))}" if rnd.random() < 0.7 else None, None) for i in range(n)]
    g, _ = build(spark, work, rows)
    placed = []
    monkeypatch.setattr(splits, "place_large", lambda sizes, want: placed.append(len(sizes)) or place_large(sizes, want))
    out = deal(g, "k", {"train": 0.8, "val": 0.1, "test": 0.1}, work).collect()
    by = defaultdict(set)
    for r in out:
        by[r["root"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and placed[0] <= 100
    several = [k for k, c in Counter(r["root"] for r in out).items() if c > 1]
    assert len(several) > placed[0]  # the dealing places groups of several rows too
    c = Counter(r["split"] for r in out)
    assert all(abs(c[s] / n - v) <= 0.01 for s, v in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_torn(spark):
    d = spark.createDataFrame([(1, "r", "b", "train"), (2, "r", "a", None), (3, "s", None, "val"), (4, "s", None, "test"), (5, None, None, "val"), (6, "q", "z", "val")], "k long, root string, first string, split string")
    assert sorted(map(tuple, torn(d, "split").collect())) == [("s", None)]
