import hashlib

from lacuna.operators import calibration as C


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffled_controls_move_positions_once(spark):
    texts = {"a": "xyzzyx", "b": "q", "c": "לדאאץלד"}
    rows = [(k, i * 3, c) for k, t in texts.items() for i, c in enumerate(t)]
    got = C.shuffled_controls(spark.createDataFrame(rows, "k string, i int, c string"), ["k"], "i", 3, "s")
    assert got.columns == ["k", "rep", "c", "i"] and _exchanges(got) == 1 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    h = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    want = set()
    for k, t in texts.items():
        for rep in range(3):
            order = sorted(range(len(t)), key=lambda i: h("s", k, rep, i * 3))
            want |= {(k, rep, t[o], i * 3) for i, o in enumerate(order)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_shuffled_lines_stay_in_their_rows(spark, tmp_path):
    from lacuna.plans.statistics_queries import shuffled_controls

    rows = [("k1", "1Q1", "abc d"), ("k2", "1Q1", ""), ("k3", None, None), ("k4", "1Q2", "\N{HEBREW LETTER ALEF}")]
    d = spark.createDataFrame(rows, "line_key string, scroll string, text string")
    d.selectExpr("line_key", "scroll", "'f' AS frag", "1 AS length", "0D AS z", "0D AS share_rec", "text", "timestamp'2024-01-01 00:00:00' AS loaded_at").write.parquet(f"{tmp_path}/m9_restore_lines.parquet")
    got = shuffled_controls(spark, str(tmp_path))
    assert _exchanges(got) == 1  # the last row of each line; letters aren't sent about
    h = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    want = {(k, rep, "".join(t[i] for i in sorted(range(len(t)), key=lambda i: h(0, k, rep, i + 1)))) for k, _, t in rows if t for rep in (0, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_matched_totals_without_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from lacuna.operators import relational as R

    rnd = random.Random(5)
    q = spark.createDataFrame([(f"q{i:02}", rnd.choice([0, 3, 10, 11, 40, 400, None])) for i in range(30)], "q string, lq int")
    c = spark.createDataFrame([(f"c{i:02}", rnd.choice([0, 2, 10, 11, 12, 40, 42])) for i in range(90)], "c string, lc int")
    want = R.matched_controls(q, c, "q", "lq", "lc", "c", 1.2, 20).groupBy("q", "near").agg(F.count("*"), F.sum("lc").cast("long"))
    got = R.matched_totals(q, c, "q", "lq", "lc", "c", 1.2, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r["near"] for r in got.collect()} == {True, False}


def test_shuffled_lines_are_the_shuffled_controls(spark):
    lines = [("a", 0, "אבגדהוז"), ("a", 1, "חט"), ("b/c", 0, "אאא"), ("e", 0, "")]
    d = spark.createDataFrame(lines, "q string, line int, t string")
    rows = spark.createDataFrame([(q, n, i, c) for q, n, t in lines for i, c in enumerate(t)], "q string, line int, i int, c string")
    want = {}
    for r in C.shuffled_controls(rows, ["q", "line"], "i", 4).collect():
        want.setdefault((r["q"], r["line"], r["rep"]), {})[r["i"]] = r["c"]
    got = {(r["q"], r["line"], r["rep"]): r["t"] for r in C.shuffled_lines(d, ["q", "line"], "t", 4).collect()}
    assert got == {k: "".join(v[i] for i in sorted(v)) for k, v in want.items()} and len(got) == 12
    # a line's letters stay in one row
    plan = C.shuffled_lines(d, ["q", "line"], "t", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1
