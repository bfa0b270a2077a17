import random
from itertools import groupby
from statistics import median

from pyspark.sql import functions as F

from lacuna.operators import sequences as Q
from lacuna.operators import statistics as S
from lacuna.operators.skew import hot_keys


def test_stretches_change_nothing(spark, monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(Q, "STRETCH", 7)
    rows = [(g, o, rnd.choice("aab" if o % 20 < 15 else "a"), rnd.randint(0, 99)) for g in "xy" for o in sorted(rnd.sample(range(120), 90))]
    d = spark.createDataFrame(rows, "g string, o long, s string, v long")
    got = sorted((r["g"], r["first"], r["last"], r["state"], r["length"]) for r in Q.islands(d, ["g"], "o", F.col("s")).collect())
    want = []
    for g in "xy":
        for s, part in groupby([r for r in rows if r[0] == g], key=lambda r: r[2]):
            part = list(part)
            want.append((g, part[0][1], part[-1][1], s, len(part)))
    assert got == sorted(want)
    steps = {g: [b[3] - a[3] for a, b in zip(x, x[1:])] for g in "xy" if (x := [r for r in rows if r[0] == g])}
    assert {r["g"]: (r["n"], r["pitch"]) for r in Q.median_step(d, ["g"], "o", "v").collect()} == {g: (len(v), median(v)) for g, v in steps.items()}
    lines = [(g, k, p, float(rnd.randint(-5, 9))) for g in "xy" for p in range(60) for k in range(3)]
    c = spark.createDataFrame(lines, "g string, line int, pos long, score double")
    s = {(g, k, p): max(v, 0.0) for g, k, p, v in lines}
    t = {(g, 2, p): s[g, 2, p] for g in "xy" for p in range(60)}
    for k in (1, 0):
        t |= {(g, k, p): s[g, k, p] + max([t[g, k + 1, q] for q in range(p + 2, p + 6) if q < 60], default=0.0) for g in "xy" for p in range(60)}
    assert {(r["g"], r["pos"]): r["score"] for r in Q.chain_lines(c, ["g"], "line", "pos", "score", 3, 2, 5).collect()} == {(g, p): t[g, 0, p] for g in "xy" for p in range(60)}


def test_ranks_with_outliers_and_ties(spark):
    rnd = random.Random(2)
    rows = [(f"k{i:04}", float(rnd.choice([5, 5, 5, 7, rnd.random(), -1e18, 1e18]))) for i in range(2000)] + [("z", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["r"] for r in S.ordinal_rank(d, "v", "k", "r").collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted((v, k) for k, v in rows if v is not None))}
    kept = {r["k"]: r["kept"] for r in S.prune_worst(d, "v", "k", 0.1).collect()}
    worst = {k for _, k in sorted((-v, k) for k, v in rows if v is not None)[:200]}
    assert {k for k, x in kept.items() if not x} == worst and len(kept) == 2000


def test_hot_keys_in_one_job(spark):
    d = spark.range(1000).selectExpr("case when id < 400 then 'a' when id < 700 then null else cast(id as string) end as k", "id % 2 as m")
    assert hot_keys(d, ["k"], 0.05, 10) == [("a",), (None,)] and hot_keys(d, ["k"], 0.05, 500) == [] and hot_keys(d.limit(0), ["k"]) == []
    assert sorted(hot_keys(d, ["k", "m"], 0.1, 10), key=str) == [("a", 0), ("a", 1), (None, 0), (None, 1)]


def test_peaks_and_periods(spark):
    peaks = spark.createDataFrame([("g", 1, 5.0), ("g", 3, 9.0), ("g", 8, 9.0), ("g", 10, 7.0), ("g", 20, 1.0), ("h", 1, 1.0)], "g string, o long, v double")
    assert sorted((r["g"], r["o"]) for r in Q.spaced_peaks(peaks, ["g"], "o", "v", 4).collect()) == [("g", 3), ("g", 8), ("g", 20), ("h", 1)]
    ac = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 0.9), ("g", 2, -0.1), ("g", 3, 0.5), ("g", 4, 0.5), ("h", 0, 1.0), ("h", 1, 0.3)], "g string, lag int, ac double")
    assert [tuple(r) for r in Q.first_period(ac, ["g"]).collect()] == [("g", 3, 0.5)]


def test_harvest_and_tiles(spark):
    from lacuna.sources import files as IO

    tiles = spark.createDataFrame([("i", 0, 0, [1, 2, 3, 4]), ("i", 0, 1, [5, 6, 7, 8]), ("j", 0, 0, None)], "image string, r int, c int, p array<int>")
    got = {(r["y"], r["x"]): r["value"] for r in IO.stitched(tiles, "image", "r", "c", "p", (2, 2), (3, 2)).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 5, (1, 0): 3, (1, 1): 4, (1, 2): 7}
    fetch = lambda p: [{"k": None, "v": p["page"], "error": None}] if p["page"] == 2 else [{"k": 1, "v": p["page"], "error": None}]
    rows = IO.harvest_pages(spark, fetch, 3, "k long, v long, error string", "k", wait=0)
    assert sorted((r["k"] or 0, r["v"], r["page"]) for r in rows.collect()) == [(0, 2, 2), (1, 3, 3)]
    assert IO.harvest_report(rows, "k", 2).first().asDict() == {"unique": 1, "expected": 2, "failed": 0, "incomplete": True}


def test_common_runs_send_no_seeds(spark):
    """Runs over all pairs of parts, of families that differ, against all places; texts aren't cut into rows of seeds."""
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("אבג") for _ in range(n))
    q = [(f"q{i}", rnd.choice(["x", "y", None]), word(rnd.randint(0, 40))) for i in range(12)]
    t = [(i, rnd.choice(["x", "z", None]), word(rnd.randint(0, 60))) for i in range(15)]
    q += [("whole", "w", t[0][2] + "ד"), ("no text", "w", None)]
    want = set()
    for k, f, a in q:
        for j, g, b in t:
            for i in range(len(a or "")):
                for o in range(len(b)):
                    if f and g and f != g and (not i or not o or a[i - 1] != b[o - 1]):
                        n = next((m for m in range(len(a)) if i + m >= len(a) or o + m >= len(b) or a[i + m] != b[o + m]), len(a))
                        want |= {(k, j, i, o, n)} if n >= 4 else set()
    dq, dt = spark.createDataFrame(q, "q string, fq string, s string"), spark.createDataFrame(t, "t long, ft string, s string")
    d = Q.common_runs(dq, dt, "q", "t", "s", 4, ("fq", "ft"), group=90, block=150)
    assert sorted(map(tuple, d.collect())) == sorted(want) and len(want) > 50
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "inline(" not in plan  # seeds aren't rows
    import pyarrow as pa

    texts = [pa.array([x[-1] or "" for x in side]) for side in (q, t)]
    one, many = ([tuple(int(v[k]) for v in b) for b in Q.merged_runs(*texts, 4, piece=n) for k in range(len(b[0]))] for n in (1 << 20, 16))
    assert sorted(one) == sorted(many) and len(one) > len(want)
