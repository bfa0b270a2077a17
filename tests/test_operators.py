import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import hebrew as H
from lacuna.functions import labels as L
from lacuna.functions.sigla import plate, siglum
from lacuna.operators import alignment as A
from lacuna.operators import calibration as C
from lacuna.operators import relational as R
from lacuna.operators import sequences as Q
from lacuna.operators import statistics as S
from lacuna.operators import vectors as V


def one(spark, col, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(col(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_normal_forms(spark):
    assert [one(spark, siglum, x) for x in (" 4Q2^54^a-820", "4q_12.b", "", None)] == ["4Q254A", "4Q-12B", "", None]
    assert [one(spark, plate, x) for x in (" 12A/Rec ", "7/vrs", None)] == ["12a", "7", None]
    assert [one(spark, L.fragment_numbers, x) for x in ("f6+14", "f9i_10", "f2ii", "12a", "f1_99")] == [[6, 14], [9, 10], [2], [12], [1, 99]]
    assert one(spark, L.link_type, "4Q249", "4Q249z") == "subsiglum" and one(spark, L.link_type, "4Q254a-820", "4Q254a") == "exact" and one(spark, L.link_type, "4Q1", "4Q12") is None
    assert one(spark, L.fragment_label, "frg. 3 i") == "f3i" and one(spark, L.plate_key, "*466/Vrs") == "466"
    assert one(spark, L.same_place, "Ps.18.3", "2Sam.22.9") and one(spark, L.same_place, "Gen.1.1", "Gen.1.4") and not one(spark, L.same_place, "Gen.1.1", "Gen.1.5") and one(spark, L.same_place, "1Q1 f2:3", "1Q1 f2:9")


def test_variant_kinds(spark):
    pairs = [("שלומ", "שלום", "same"), ("שלם", "שלום", "orthographic"), ("לכה", "לך", "long_form"), ("אבד", "גדל", "substantive"), ("אב", "", "plus"), ("אב", None, "plus")]
    for a, b, k in pairs:
        assert one(spark, H.variant_kind, a, b) == k


def test_visible_trims_and_flags(spark):
    v = one(spark, H.visible, "אבג דה", "r.u ..")
    assert (v["label"], v["letters"], v["uncertain"], v["has_gap"]) == ("בג דה", 4, 1, False)
    assert one(spark, H.visible, "אבג", ".r.")["has_gap"] and one(spark, H.visible, "אב", "rr") is None
    assert one(spark, H.bracketed, "אבגד", ".rr.") == "א[בג]ד"


def test_ratio_band_is_the_filter_without_a_nested_loop(spark):
    q = spark.createDataFrame([(i, i * 7 % 90 + 1) for i in range(60)], "q long, lq long")
    c = spark.createDataFrame([(i, i * 13 % 120) for i in range(150)], "c long, lc long")
    got = {(r["q"], r["c"]) for r in R.ratio_band(q, c, "lq", "lc").collect()}
    assert got == {(a["q"], b["c"]) for a in q.collect() for b in c.collect() if b["lc"] > 0 and abs(math.log(b["lc"] / a["lq"])) <= math.log(1.5) + 1e-12}
    plan = R.ratio_band(q, c, "lq", "lc")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empirical_p_is_never_zero(spark):
    real = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 9.0), ("c", 1.0), ("a", None)], "g string, s double")
    null = spark.createDataFrame([("a", float(x)) for x in range(9)] + [("b", 9.0), ("a", None)], "g string, s double")
    got = sorted((r["g"], r["s"] or -1, round(r["p"], 4)) for r in C.empirical_p(real, null, ["g"], "s").collect())
    assert got == [("a", -1, 0.1), ("a", 1.0, 0.9), ("a", 5.0, 0.5), ("b", 9.0, 1.0), ("c", 1.0, 1.0)]


def test_auc_ties_and_empty_side(spark):
    d = spark.createDataFrame([("x", True, 1), ("x", False, 1), ("x", True, 3), ("x", False, 2), ("y", True, 1)], "g string, p boolean, s long")
    got = {r["g"]: r["auc"] for r in S.auc(d, F.col("p"), "s", ["g"]).collect()}
    assert got == {"x": 0.625, "y": None}


def test_robust_outliers_drop_small_groups(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (10, 10, 10, 11, 50)] + [("b", 1.0)], "g string, x double")
    got = {(r["g"], r["x"]): (r["z_score"], r["flag"]) for r in S.robust_outliers(d, ["g"], "x").collect()}
    assert got[("a", 50.0)] == (40.0, True) and ("b", 1.0) not in got


def test_chain_places_each_line_after_the_one_before_it(spark):
    rnd = random.Random(4)
    n, lines, lo, hi = 60, 3, 4, 9
    s = [[rnd.uniform(-1, 1) for _ in range(n)] for _ in range(lines)]
    t = [max(x, 0) for x in s[-1]]
    for k in (1, 0):
        t = [max(s[k][o], 0) + max([t[j] for j in range(o + lo, min(n, o + hi + 1))], default=0) for o in range(n)]
    d = spark.createDataFrame([("d", k, o, s[k][o]) for k in range(lines) for o in range(n)], "g string, line int, pos int, score double")
    got = {r["pos"]: r["score"] for r in Q.chain_lines(d, ["g"], "line", "pos", "score", lines, lo, hi).collect()}
    assert [got[o] for o in range(n)] == pytest.approx(t)


def test_suppression_collapses_near_hits(spark):
    d = spark.createDataFrame([("q", str(p), p, float(s)) for p, s in ((0, 9), (30, 8), (49, 8), (50, 7), (120, 6), (99, 5))], "q string, k string, p long, s double")
    assert [r["p"] for r in Q.suppressed(d, "q", "k", "p", "s").orderBy("rank").collect()] == [0, 50, 120]


def test_common_runs(spark):
    q = spark.createDataFrame([("q", "xxabcdefyyy"), ("e", "")], "q string, s string")
    t = spark.createDataFrame([("t", "zabcdefzzabcde"), ("n", None)], "t string, s string")
    got = sorted((r["q_start"], r["t_start"], r["length"]) for r in Q.common_runs(q, t, "q", "t", "s", 4).collect())
    assert got == [(2, 1, 6), (2, 9, 5)]


def test_semiglobal_against_the_recurrence():
    def slow(a, b):
        row = [(0, j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [(i, 0)]
            for j, y in enumerate(b, 1):
                new.append(min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
            row = new
        j = min(range(len(row)), key=lambda k: (row[k][0], k))
        return row[j][0], row[j][1], j

    assert A.semiglobal("abc", "xxabdxx")[0] == 1 and A.semiglobal("hello", "yhelo")[0] == 1 and A.semiglobal("zzz", "abc")[0] == 3
    rnd = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(2))
        assert A.semiglobal(a, b) == slow(a, b)


def test_neighbours_leave_the_group_out(spark):
    rnd = np.random.default_rng(8)
    m = rnd.normal(size=(90, 6))
    d = spark.createDataFrame([(i, [float(x) for x in m[i]], i % 4, i % 3) for i in range(90)], "id long, v array<double>, g int, l int")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    want = {i: [int(j) for j in np.argsort(-s[i], kind="stable") if j % 4 != i % 4][:5] for i in range(90)}
    got = V.nearest(d, "id", "v", "g", "l", 5).orderBy("q", "rank").collect()
    assert {i: [r["key"] for r in got if r["q"] == i] for i in range(90)} == want


def test_nearest_by_ratio(spark):
    q = spark.createDataFrame([(i, i * 5 + 1) for i in range(12)], "q long, lq long")
    c = spark.createDataFrame([(i, i * i % 97) for i in range(200)], "c long, lc long")
    got = R.nearest_by_ratio(q, c, "q", "lq", "lc", "c", 7).collect()
    for x in q.collect():
        want = sorted(abs(math.log(r["lc"] / x["lq"])) for r in c.collect() if r["lc"] > 0)[:7]
        assert sorted(abs(math.log(r["lc"] / x["lq"])) for r in got if r["q"] == x["q"]) == pytest.approx(want)


def test_llm_free_import():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    found = subprocess.run(["grep", "-rln", "lacuna.llm\\|from ..llm\\|from .llm\\|import llm", str(root / "lacuna"), "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/llm/" in f for f in found), found
    code = "import sys; sys.modules['lacuna.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith(('p2_', 'p6_')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_windows(spark):
    from lacuna.operators import search as P

    d = spark.createDataFrame([(1, "ab..cd ab......cd ab"), (2, None), (3, ""), (4, "abab" + "x" * 4 + "cd")], "k long, t string")
    got = sorted((r["k"], r["p0"], r["p1"]) for r in P.ordered_window(d, "k", "t", ["ab", "cd"], 3, 8).collect())
    assert got == [(1, 0, 4), (1, 7, 15), (4, 0, 8), (4, 2, 8)]
    runs = spark.createDataFrame([("abba",), ("ab",), ("zzzz",)], "run string")
    texts = spark.createDataFrame([("x", "abbabba"), ("y", None)], "doc string, t string")
    assert sorted((r["doc"], r["pos"]) for r in P.contained(runs, texts, "run", "doc", "t", 3).collect()) == [("x", 0), ("x", 3)]


def test_symbols_keep_barriers(spark):
    from lacuna.operators import search as P

    d = spark.createDataFrame([("f", 1, "אבגד", ".rr."), ("f", 0, "א###ם", ".##p.")], "f string, n int, t string, m string")
    assert P.symbols(d, ["f"], "n", F.col("t"), F.col("m")).first()["symbols"] == "א|מא||ד|"


def test_null_text_and_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t string")
    assert Q.common_runs(none, none.toDF("d", "t"), "k", "d", "t", 4).count() == 0
    assert S.letter_frequency(none, F.col("t")).count() == 0
    assert S.letter_model(none, F.col("t"), "ab").count() == 0
    assert S.spearman(spark.createDataFrame([], "k string, a long, b long"), "a", "b", "k").first()["n"] == 0
    e = spark.createDataFrame([], "g string, s double")
    assert C.empirical_p(e, e, ["g"], "s").count() == 0 and S.auc(e, F.lit(True), "s", ["g"]).count() == 0
    assert R.nearest_by_ratio(spark.createDataFrame([], "q long, lq long"), spark.createDataFrame([], "c long, lc long"), "q", "lq", "lc", "c").count() == 0


def test_aligned_words_keeps_plus_words(spark, monkeypatch):
    from lacuna.plans import search_queries

    rows = [(1, "1", "שלום", "שלום", 1), (2, "1", "אבד", None, None), (3, "1", "גדל", "גדל", 2), (4, "1", "לגדל", "גדל", 2), (5, "2", "אחר", "", None), (6, None, "אב", None, None)]
    d = spark.createDataFrame([(i, "4Q1", r, s, m, j) for i, r, s, m, j in rows], "word_id long, sg string, ref string, scroll_word string, mt string, j int")
    monkeypatch.setattr(search_queries.K, "words", lambda spark, sf: d)
    got = sorted((r["ref"], r["i"], r["j"]) for r in search_queries.aligned_words(spark, "").collect())
    assert len(got) == 5 and ("1", 0, 0) in got and ("1", 1, None) in got and ("2", 0, None) in got and sorted(j for _, _, j in got if j is not None) == [0, 1]


def test_fewest_edits_is_semiglobal():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("אבגד") for _ in range(n))
    texts = [word(rng.randrange(0, 30)) for _ in range(60)]
    for n in (0, 1, 2, 7, 20, 45):
        a = word(n)
        assert A.fewest_edits(a, texts, 200).tolist() == [A.semiglobal(a, t)[0] for t in texts]


def test_e_values_of_all_records(spark, monkeypatch):
    from lacuna.plans import statistics_queries

    p = spark.createDataFrame([(f"n{i}", (i + 1) / 50, 49) for i in range(45)], "name string, p double, n_controls long")
    monkeypatch.setattr(statistics_queries, "empirical_p", lambda spark, sf: p)
    got = {r["name"]: round(r["E"], 6) for r in statistics_queries.e_values(spark, "").collect()}
    assert got == {f"n{i}": round((i + 1) / 50 * 45, 6) for i in range(45)}
