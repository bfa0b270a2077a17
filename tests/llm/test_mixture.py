import math

import pytest

from lacuna.llm.mixture import entropy, exponent_for_entropy, mix, plan, shares, tempered, weights_within_limits
from lacuna.session import default_tokenizer


def test_temperature():
    p = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    assert tempered(p, 1) == pytest.approx({"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0})
    assert tempered(p, 0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 0})
    x = exponent_for_entropy(p, 0.9)
    assert entropy(tempered(p, x)) == pytest.approx(0.9)


def test_limits_move_weights_least():
    targets, sizes, caps = {"a": 0.5, "b": 0.5}, {"a": 100, "b": 10}, {"a": 1, "b": 2}
    assert weights_within_limits(targets, sizes, caps, 40) == ({"a": 0.5, "b": 0.5}, 0.0)
    w, x = weights_within_limits(targets, sizes, caps, 80)
    assert 0 < x < 1 and w["b"] * 80 == pytest.approx(20, rel=1e-6)
    with pytest.raises(ValueError):
        weights_within_limits(targets, sizes, caps, 1000)


def test_plan_edges():
    assert plan([], {}) == []
    p = {x.source: x for x in plan([("a", 0.5, 2), ("b", 0.5, 3), ("gone", 0.2, 1), (None, 0.3, 1), ("nil", None, 1)], {"a": 10, "b": 40})}
    assert p["a"].budget == pytest.approx(20) and p["a"].passes == 2 and p["a"].rest == 0
    assert p["b"].passes == 0 and p["b"].rest == pytest.approx(20)
    assert p["gone"].budget == 0 and p["nil"].budget == 0


def test_draw(spark, work):
    rows = [(i, "big" if i % 3 else "small", "one two three four five " * (1 + i % 7)) for i in range(600)] + [(1000, "big", None), (1001, "big", ""), (1002, None, "x"), (1003, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    d, plans = mix(docs, targets, default_tokenizer(), work)
    got = {r["source"]: r for r in shares(d, plans).collect()}
    assert got["big"]["share"] == pytest.approx(4 / 9, abs=0.003) and got["small"]["share"] == pytest.approx(5 / 9, abs=0.003)
    assert got["small"]["repeats"] <= 3 and got["big"]["repeats"] <= 1 and got["absent"]["drawn"] == 0
    used = [(r["doc_id"], r["copy"]) for r in d.collect()]
    assert len(used) == len(set(used))
    assert d.orderBy("copy", "doc_id").collect() == mix(docs, targets, default_tokenizer(), work)[0].orderBy("copy", "doc_id").collect()
    none, plans = mix(docs.limit(0), targets, default_tokenizer(), work)
    assert none.count() == 0 and all(r["share"] == 0 for r in shares(none, plans).collect())
    assert math.isfinite(sum(p.budget for p in plans))


def test_flatten_and_stretch_bisect_the_exponent(spark, work):
    sizes = {"a": 1000, "b": 300, "c": 20}
    targets = [("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.5, 4)]
    own = {s: n / 1320 for s, n in sizes.items()}
    p = {x.source: x for x in plan(targets, sizes, flatten=0.5)}
    assert 0 < p["a"].exponent < 1 and p["a"].weight / p["b"].weight == pytest.approx((1000 / 300) ** p["a"].exponent)
    assert entropy({s: x.weight for s, x in p.items()}) == pytest.approx((entropy(own) + math.log(3)) / 2)
    assert all(x.budget <= x.cap * x.tokens * (1 + 1e-9) for x in p.values())
    # without the bisection the weights would be others: even at exponent 0, the own sizes at 1
    assert p["c"].weight != pytest.approx(1 / 3, abs=0.01) and p["c"].weight != pytest.approx(own["c"], abs=0.01)
    q = {x.source: x for x in plan(targets, sizes, stretch=0.5)}
    at0 = sum(x.budget for x in plan(targets, sizes))
    assert 0 < q["a"].exponent < 1 and sum(x.budget for x in q.values()) == pytest.approx((at0 + 1000 + 600 + 80) / 2)
    assert all(x.budget <= x.cap * x.tokens * (1 + 1e-9) for x in q.values())
    docs = spark.createDataFrame([(i, "abc"[i % 3] if i % 5 else "a", "one two three four five " * (1 + i % 7)) for i in range(900)], "doc_id long, source string, text string")
    d, plans = mix(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), default_tokenizer(), work, flatten=0.5)
    for r in shares(d, plans).collect():
        assert abs(r["drawn"] - r["budget"]) <= 45 and r["repeats"] <= r["max_repeats"] and 0 < r["exponent"] < 1
