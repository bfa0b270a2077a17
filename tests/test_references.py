import random
from datetime import datetime, timedelta

import pytest

from lacuna.operators import references
from lacuna.operators.references import judged, key_runs, orphans
from lacuna.operators.skew import distributed_rank, salted_join

T = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T + timedelta(days=n)


def test_reasons(spark):
    parents = spark.createDataFrame(
        [(1, day(0), None), (2, day(5), None), (3, day(0), day(3)), (3, day(3), day(6)), (4, day(8), day(9)), (4, day(1), day(2)), (5, None, None), (6, day(4), day(4)), (None, day(0), None)],
        "id long, loaded_at timestamp, deleted_at timestamp",
    )
    refs = [(1, 0), (1, -1), (2, 4), (2, 5), (3, 2), (3, 3), (3, 6), (4, 3), (4, 8), (4, 0), (5, 3), (6, 4), (6, 3), (7, 3), (None, 3), (1, None), (9, None)]
    r = spark.createDataFrame([(i, k, day(d)) for i, (k, d) in enumerate(refs)], "n int, id long, loaded_at timestamp")
    got = {x["n"]: x["reason"] for x in orphans(r, parents, ["id"], "loaded_at", ["n"], integer_key="id").collect()}
    assert got == {1: "late", 2: "late", 6: "deleted", 7: "deleted", 9: "late", 10: "deleted", 11: "deleted", 12: "late", 13: "missing", 15: "deleted", 16: "missing"}
    same = {x["n"]: x["reason"] for x in orphans(r, parents, ["id"], "loaded_at", ["n"]).collect()}
    assert same == got


def test_runs_decide_what_is_missing(spark, monkeypatch):
    p = spark.createDataFrame([(k, day(0), None) for k in (1, 2, 3, 7)], "id long, loaded_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame([(i, i, day(1)) for i in range(10)], "n int, id long, loaded_at timestamp")
    missing = lambda: sorted(x["n"] for x in orphans(r, p, ["id"], "loaded_at", ["n"], integer_key="id").collect())
    assert missing() == [0, 4, 5, 6, 8, 9]
    # without runs nothing is known
    monkeypatch.setattr(references, "key_runs", lambda parents, key, groups=(): key_runs(parents, key, groups).limit(0))
    assert missing() == list(range(10))


@pytest.mark.parametrize("integer_key", ["id", None])
def test_hot_keys_and_blocks_are_split_without_a_change(spark, integer_key):
    rnd = random.Random(5)
    at = lambda: rnd.choice([None, *[day(rnd.uniform(0, 40)) for _ in range(9)]])
    parents = [(g, k, at(), at()) for g in ("x", "y", None) for k in [*range(5), *range(9, 14), 5000, *[3] * 60]]
    refs = [(i, rnd.choice(["x", "x", "y", None]), rnd.choice([3, 3, 3, 1, 2, 6, 9, 14, 5000, None]), at()) for i in range(400)]
    p = spark.createDataFrame(parents, "g string, id long, loaded_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame(refs, "n int, g string, id long, loaded_at timestamp")

    def reason(g, k, t):
        own = [(s, e) for a, b, s, e in parents if (a, b) == (g, k)]
        if not own:
            return "missing"
        if t is not None and any(s is not None and s <= t and (e is None or e > t) for s, e in own):
            return None
        return "late" if t is not None and all(s is not None and s > t for s, _ in own) else "deleted"

    want = {n: reason(g, k, t) for n, g, k, t in refs if g is not None and k is not None}
    for least in (5, 50_000):
        got = {x["n"]: x["reason"] for x in judged(r, p, ["g", "id"], "loaded_at", ["n"], integer_key, least=least).collect()}
        assert got == want


def test_references_are_shuffled_once_and_joined_to_nothing(spark):
    p = spark.createDataFrame([(1, day(0), None)], "id long, loaded_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame([(1, 1, day(1))], "n int, id long, loaded_at timestamp")
    plan = judged(r, p, ["id"], "loaded_at", ["n"], integer_key="id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_key_runs(spark):
    d = spark.createDataFrame([(x,) for x in (-2, -1, 0, 1, 5, 6, 6, 9, None)], "id long")
    assert sorted((r["lo"], r["hi"]) for r in key_runs(d, "id").collect()) == [(-2, -1), (0, 1), (5, 6), (9, 9)]


@pytest.mark.parametrize("n", [0, 5])
def test_empty_parents_or_refs(spark, n):
    p = spark.createDataFrame([], "id long, loaded_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame([(i, i, day(0)) for i in range(n)], "n int, id long, loaded_at timestamp")
    assert [x["reason"] for x in orphans(r, p, ["id"], "loaded_at", ["n"], integer_key="id").collect()] == ["missing"] * n


def test_salted_join_is_the_plain_join(spark):
    big = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 1 when id % 3 = 1 then null else id end as k")
    small = spark.range(3000).selectExpr("id as k", "id * 2 as v")
    for how in ("left", "inner"):
        a = sorted(map(str, salted_join(big, small, ["k"], ["id"], how, salts=8, least=100).collect()))
        assert a == sorted(map(str, big.join(small, ["k"], how).collect()))


def test_distributed_rank(spark):
    from pyspark.sql import functions as F

    d = spark.range(1000).selectExpr("id", "id % 3 as g", "(id * 7919) % 1000 as x")
    out = distributed_rank(d, ["g"], F.floor(F.col("x") / 50), ["x", "id"], "r").collect()
    for g in range(3):
        rows = sorted((r["x"], r["r"]) for r in out if r["g"] == g)
        assert [r for _, r in rows] == list(range(len(rows)))


def test_clashing_columns_stay(spark):
    p = spark.createDataFrame([(1, day(0), None, "x")], "day long, loaded_at timestamp, deleted_at timestamp, e string")
    r = spark.createDataFrame([(1, 1, day(-1), "t", "f", "k"), (2, 1, day(1), "t", "f", "k")], "n int, day long, loaded_at timestamp, t string, first string, known string")
    got = orphans(r, p, ["day"], "loaded_at", ["n"], integer_key="day").collect()
    assert [(x["n"], x["reason"], x["t"], x["first"], x["known"]) for x in got] == [(1, "late", "t", "f", "k")]
