import hashlib
import math
import random

from pyspark.sql import functions as F

from lacuna.operators import audit as U
from lacuna.operators import relational as R
from lacuna.operators import vectors as V


def test_decoys_against_brute_force(spark):
    rnd = random.Random(1)
    readings = [(f"q{i:02}", rnd.choice("abcd"), rnd.choice([None, "x", "y"])) for i in range(40)]
    groups = [("a", "x"), ("b", None), ("e", "y")]
    grams = {q: {rnd.choice("stuvw") for _ in range(rnd.randint(0, 2))} for q, _, _ in readings}
    of_groups = {"a": {"s"}, "b": {"t", "u"}}
    r = spark.createDataFrame(readings, "q string, ms string, comp string")
    g = spark.createDataFrame(groups, "g string, comp string")
    gq = spark.createDataFrame([(q, x) for q, v in grams.items() for x in v] * 2, "q string, gram string")
    gg = spark.createDataFrame([(k, x) for k, v in of_groups.items() for x in v], "g string, gram string")
    h = lambda s: hashlib.md5(f"11|{s}".encode()).hexdigest()
    order = sorted(readings, key=lambda x: (h(x[0]), x[0]))
    for many in (3, 100):
        want = set()
        for k, comp in groups:
            first, n = int(h(k)[:7], 16) % 40, 0
            for step in range(min(3 * many, 40)):
                q, ms, c = order[(first + step) % 40]
                if n < many and ms != k and not (comp is not None and c == comp) and not grams[q] & of_groups.get(k, set()):
                    want.add((k, q, step))
                    n += 1
        assert {tuple(x) for x in U.decoys(r, g, gq, gg, many).collect()} == want
    assert U.decoys(r.limit(0), g, gq, gg).count() == 0 and U.decoys(r, g.limit(0), gq, gg).count() == 0


def test_decoys_with_grams_of_many_groups(spark):
    """A gram in more groups than there are candidates is met from the candidates, a rare one from the grams."""
    readings = [(f"q{i:02}", f"m{i}", None) for i in range(30)]
    groups = [(f"g{i}", None) for i in range(8)]
    of_groups = {g: {"all"} | ({"one"} if i == 3 else set()) for i, (g, _) in enumerate(groups[:7])}
    grams = {q: {"all"} if i % 3 == 0 else {"one"} if i % 3 == 1 else set() for i, (q, _, _) in enumerate(readings)}
    r, g = spark.createDataFrame(readings, "q string, ms string, comp string"), spark.createDataFrame(groups, "g string, comp string")
    gq = spark.createDataFrame([(q, x) for q, v in grams.items() for x in v], "q string, gram string")
    gg = spark.createDataFrame([(k, x) for k, v in of_groups.items() for x in v] + [("other", "all")], "g string, gram string")
    d = U.decoys(r, g, gq, gg, 2)
    h = lambda s: hashlib.md5(f"11|{s}".encode()).hexdigest()
    order = sorted(q for q, _, _ in readings)
    order.sort(key=h)
    want = set()
    for k, _ in groups:
        fit = [(k, order[(int(h(k)[:7], 16) + n) % 30], n) for n in range(6)]
        want |= set([x for x in fit if not grams[x[1]] & of_groups.get(k, set())][:2])
    assert {tuple(x) for x in d.collect()} == want
    # the candidates, 3 * many for each group, aren't collected for a broadcast
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in x and "_r#" in x for x in plan.splitlines())


def test_controls_are_near_in_length(spark):
    own = spark.createDataFrame([("q1", "g", 30), ("q2", "g", 1000), ("q3", "h", 10)], "q string, g string, n long")
    pool = [("g", f"c{n:03}", n) for n in range(20, 80)] + [("h", "q3", 10), ("h", "c1", 12)]
    got = {}
    for x in U.controls(own, spark.createDataFrame(pool, "g string, c string, n long"), 1.5, 20).collect():
        got.setdefault(x["q"], set()).add(x["c"])
    assert got["q1"] == {f"c{n:03}" for n in range(20, 46)} and got["q2"] == {f"c{n:03}" for n in range(60, 80)} and got["q3"] == {"c1"}


def test_fit_against_brute_force(spark):
    rnd = random.Random(2)
    frags = [f"f{i}" for i in range(6)]
    names = [f"q{i}" for i in range(5)] + [f"c{i}" for i in range(12)]
    score = {(q, "g", f): float(rnd.randint(0, 6)) for q in names for f in frags}
    own = [(f"q{i}", "g", rnd.choice(frags)) for i in range(4)] + [("q4", "g", "gone"), ("none", "z", "f1")]
    pairs = [(q, g, c) for q, g, _ in own[:5] for c in names[5:] if rnd.random() < 0.6]
    got = {r["q"]: r for r in U.fit(spark.createDataFrame(own, "q string, g string, frag string"), spark.createDataFrame(pairs, "q string, g string, c string"), spark.createDataFrame([(*k, v) for k, v in score.items()], "q string, g string, frag string, score double")).collect()}
    assert got["none"]["p_own"] == 1.0 and got["none"]["z_own"] is None and got["none"]["p_fw"] == 1.0
    for q, g, f in own[:5]:
        cs = [c for a, _, c in pairs if a == q]
        mu = {x: sum(score[c, g, x] for c in cs) / len(cs) for x in frags}
        sd = {x: math.sqrt(sum((score[c, g, x] - mu[x]) ** 2 for c in cs) / len(cs)) for x in frags}
        z = {(a, x): (score[a, g, x] - mu[x]) / (sd[x] + 1e-6) for a in [q, *cs] for x in frags}
        best = min(frags, key=lambda x: (-round(z[q, x], 9), x))
        r = got[q]
        assert r["n_controls"] == len(cs) and abs(r["z_best"] - z[q, best]) < 1e-6
        assert abs(r["p_fw"] - (1 + sum(round(max(z[c, x] for x in frags), 9) >= round(z[q, best], 9) for c in cs)) / (len(cs) + 1)) < 1e-12
        if f in frags:
            assert abs(r["z_own"] - z[q, f]) < 1e-6 and abs(r["p_own"] - (1 + sum(score[c, g, f] >= score[q, g, f] for c in cs)) / (len(cs) + 1)) < 1e-12
        else:
            assert r["p_own"] == 1.0 and r["z_own"] is None


def test_expected_hits(spark):
    rnd = random.Random(3)
    hits = [(f"q{i}", rnd.choice("abc"), rnd.randint(5, 60), float(rnd.randint(0, 20))) for i in range(60)]
    got = {r["q"]: r for r in U.expected_hits(spark.createDataFrame(hits, "q string, g string, n long, score double")).collect()}
    for q, g, n, s in hits:
        near = [x for _, h, m, x in hits if h != g and abs(math.log(m / n)) <= math.log(1.5) + 1e-12]
        p = (1 + sum(x >= s for x in near)) / (len(near) + 1)
        assert abs(got[q]["p_decoy"] - p) < 1e-12 and abs(got[q]["E"] - p * 60) < 1e-9


def test_matched_controls_fall_back_to_the_nearest(spark):
    q = spark.createDataFrame([("a", 100), ("b", 10)], "q string, lq long")
    c = spark.createDataFrame([(f"c{i:02}", 90 + i) for i in range(25)], "c string, lc long")
    got = {}
    for r in R.matched_controls(q, c, "q", "lq", "lc", "c", 1.5, 20).collect():
        got.setdefault((r["q"], r["near"]), set()).add(r["c"])
    assert got == {("a", False): {f"c{i:02}" for i in range(25)}, ("b", True): {f"c{i:02}" for i in range(20)}}


def test_label_ranks_over_all_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 5))
    rows = [(i, v[i].tolist(), i % 4, None if i % 11 == 0 else f"l{i % 6}") for i in range(120)]
    d = spark.createDataFrame(rows, "id long, v array<double>, g int, l string")
    monkeypatch.setattr(V, "BLOCK", 37)  # several blocks
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    got = {}
    for r in V.label_ranks(d, "id", "v", "g", "l", d.where("id % 10 = 0")).collect():
        got.setdefault(r["q"], {})[r["label"]] = (r["sim"], r["rank"])
    for i in range(0, 120, 10):
        best = {}
        for j, _, g, l in rows:
            if j != i and g != i % 4 and l is not None:
                best[l] = max(best.get(l, -9), s[i, j])
        order = sorted(best, key=lambda l: (-best[l], l))
        assert got[i] == {l: (best[l], order.index(l) + 1) for l in best}


def test_patterns_with_unsure_letters(spark):
    from lacuna.operators import search as P

    d = spark.createDataFrame([(1, "xab" * 500 + "axb......cod a?b"), (2, "aab"), (3, None), (4, ""), (5, "a b.....cud")], "k long, t string")
    got = sorted((r["k"], r["p0"], r["p1"]) for r in P.ordered_window(d, "k", "t", ["a[xy]b", "c?d"], 3, 12).collect())
    assert got == [(1, 1500, 1509)]
    assert [r["p0"] for r in P.ordered_window(d, "k", "t", ["aa?"], 0, 1).collect()] == [0]
    e = spark.createDataFrame([("ab",), ("a?",), ("[ab]b",), ("",)], "p string").select("p", P.log_expected(F.col("p"), {"a": 0.25, "b": 0.5}, F.lit(1000)).alias("e")).collect()
    want = {"ab": 1000 * 0.125, "a?": 250.0, "[ab]b": 1000 * 0.375, "": 1000.0}
    assert all(abs(r["e"] - math.log(want[r["p"]])) < 1e-9 for r in e)


def test_groups(spark):
    pieces = [(f"q{i:02}", f"o{i % 4}") for i in range(18)] + [("alone", "z"), (None, "o1"), ("x", None)]
    d = spark.createDataFrame(pieces + pieces[:3], "q string, owner string")
    owner = dict(pieces)
    mixed = {}
    for r in U.mixed_groups(d, (1, 3, 9), 10).collect():
        mixed.setdefault((r["k"], r["draw"]), []).append(r["q"])
    assert set(mixed) == {(k, i) for k in (1, 3) for i in range(1, 11)}
    assert all(len(v) == k and len({owner[q] for q in v}) == k for (k, _), v in mixed.items())
    own = {}
    for r in U.own_groups(d, (1, 5), 6).collect():
        own.setdefault((r["owner"], r["k"], r["draw"]), set()).add(r["q"])
    assert set(own) == {(o, 1, i) for o in ("o0", "o1", "o2", "o3", "z") for i in range(1, 7)} | {(o, 5, i) for o in ("o0", "o1") for i in range(1, 7)}
    assert all(len(v) == k and {owner[q] for q in v} == {o} for (o, k, _), v in own.items())
    p = spark.createDataFrame([(q, doc, 0.01 if doc == o else 0.5) for q, o in pieces[:19] for doc in ("o0", "o1", "o2", "o3", "z")], "q string, doc string, p double")
    got = {r["k"]: r for r in U.group_validation(p, U.mixed_groups(d, (1, 3), 10), U.own_groups(d, (1, 3), 6)).collect()}
    assert got[1]["groups"] == got[1]["own"] == 30 and got[3]["groups"] == got[3]["own"] == got[3]["over"] == got[3]["over_own"] == 24
    assert abs(got[1]["threshold"] + math.log(0.01)) < 1e-5


def test_p_by_document_is_the_p_of_all_scores(spark):
    """Scores of 0 aren't kept, and p is what it is with them; a document is spread over texts and tasks."""
    import numpy as np
    from pyspark.sql import functions as F

    from lacuna.functions.hebrew import ALPHABET
    from lacuna.operators import calibration as K
    from lacuna.operators import corpus as C

    rng = np.random.default_rng(31)
    rows = (rng.normal(-1.5, 0.5, (22, 22)) + np.eye(22) * 4).tolist()
    text = lambda n: "".join(rng.choice(list(ALPHABET[:5] + "|"), n, p=[0.19] * 5 + [0.05]))
    texts = [(f"d{i % 3}", f"f{i}", text(n)) for i, n in enumerate((40, 90, 3, 60, 200, 1))] + [("e", "f", ""), ("d9", "f", "|||")]
    pick = lambda n: "".join(rng.choice(list(ALPHABET[:6]), n))
    read = [(f"q{i}" + "#0" * (i % 2), "ab"[i % 3 > 1], bool(i % 2), [pick(3 + i % 9), pick(i % 4)]) for i in range(30)]
    read += [("one", "c", False, [pick(5)]), ("none", "a", False, [""]), ("no band", None, False, [pick(5)])]
    r = spark.createDataFrame(read, "q string, band string, control boolean, tables array<string>")
    t = spark.createDataFrame(texts, "doc string, frag string, symbols string")
    p = C.p_by_document(r, t.select("doc", "symbols"), "q", "band", "doc", rows, block=120, group=40)
    got = {(x["q"], x["doc"]): x["p"] for x in p.collect()}
    every = C.scores_by_document(r.select("q", F.lit("g").alias("g")), r.select("q", "tables"), t.select(F.lit("g").alias("g"), F.concat_ws("|", "doc", "frag").alias("d"), "symbols"), "q", "g", "d", rows=rows)
    every = every.groupBy("q", F.split("d", r"\|")[0].alias("doc")).agg(F.max("score").alias("score")).join(r.where("band is not null").drop("tables"), "q")
    want = {(x["q"], x["doc"]): x["p"] for x in K.empirical_p(every.where("not control"), every.where("control"), ["band", "doc"], "score").collect()}
    assert got == {k: v for k, v in want.items() if v < 1} and 10 < len(got) < len(want)


def test_groups_drawn_again_count_again(spark):
    """Rows of p = 1 may be left out but for one of each reading, and equal draws are summed up once."""
    pieces = [(f"q{i}", f"o{i % 3}") for i in range(7)]
    d = spark.createDataFrame(pieces, "q string, owner string")
    every = [(q, doc, 0.02 if doc == o and q != "q4" else 1.0) for q, o in pieces for doc in ("o0", "o1", "o2", "z")]
    sets = U.mixed_groups(d, (1, 2), 9), U.own_groups(d, (1, 2), 9)
    got = [sorted(map(tuple, U.group_validation(spark.createDataFrame(p, "q string, doc string, p double"), *sets).collect())) for p in (every, [x for x in every if x[2] < 1 or x[1] == "o0"])]
    assert got[0] == got[1] and [x[1] for x in got[0]] == [27, 27]
    plan = U.group_validation(spark.createDataFrame(every, "q string, doc string, p double"), *sets)._jdf.queryExecution().executedPlan().toString()
    assert "drawn" in plan  # distinct draws, written


def test_best_with_p_is_the_best_of_all_scores(spark):
    """Texts are bounded before they are scored, by blocks and keys; best texts, ties and p are those of all scores of all pairs."""
    import numpy as np

    from lacuna.functions.hebrew import ALPHABET
    from lacuna.operators import calibration as K
    from lacuna.operators import corpus as C

    rng = np.random.default_rng(5)
    rows = (rng.normal(-1.5, 0.5, (22, 22)) + np.eye(22) * 4).tolist()
    pick = lambda n, k=5: "".join(rng.choice(list(ALPHABET[:k]), n))
    texts = [(f"g{i % 6}", f"f{i:02}", pick(int(rng.integers(1, 160))) + "|") for i in range(40)]
    texts += [("g1", "f98", texts[3][2]), ("g2", "f99", ""), ("alone", "f", pick(30)), ("far", "f", pick(99)), ("g0", "long", pick(400) + "|" + texts[3][2])]
    members = [("a", g) for g in ("g0", "g1", "g2", "g3")] + [("b", g) for g in ("g1", "g3", "g5", "none")] + [("c", "alone"), ("none", "far")]
    read = [(f"q{i}/f#{i % 3}", "ab"[i % 2], f"g{i % 6}", [pick(3 + i % 9), pick(i % 4), pick(i % 7)][: 1 + i % 3]) for i in range(24)]
    read += [("own only", "c", "alone", [pick(5)]), ("other", "c", "g1", ["ש" * 9, "ך"]), ("letters", "a", "g5", [""]), ("part", "a", "g5", [texts[3][2][:20]]), ("no key", None, "g1", [pick(5)])]
    read = [(*x, [["".join(rng.permutation(list(t))) for t in x[3]] for _ in range(5)]) for x in read]
    r = spark.createDataFrame(read, "q string, k string, own string, tables array<string>, controls array<array<string>>")
    t, m = spark.createDataFrame(texts, "g string, frag string, symbols string"), spark.createDataFrame(members * 2, "k string, g string")
    every = r.select("q", "k", "own", "tables", F.lit(-1).alias("rep")).unionByName(r.select("q", "k", "own", F.posexplode("controls").alias("rep", "tables")))
    every = every.withColumn("id", F.concat_ws("~", "q", "rep"))
    pairs = every.join(m.distinct(), "k").where("g <> own").select("id", "g")
    s = C.scores_by_document(pairs, every.select("id", "tables"), t, "id", "g", "frag", rows=rows)
    best = R.top_per_group(s, ["id"], [F.desc("score"), F.col("g"), F.col("frag")], 1).drop("rank").join(every.select("id", "q", "rep"), "id")
    want = {(x["q"], x["g"], x["frag"], x["score"], x["p"]) for x in K.empirical_p(best.where("rep < 0"), best.where("rep >= 0").select("q", "score"), ["q"], "score").collect()}
    assert len(want) == 26 and len({x[4] for x in want}) > 3 and min(x[3] for x in want) == 0
    for sizes in ({}, {"block": 500, "letters": 300}):
        assert {tuple(x) for x in C.best_with_p(r, m, t, "q", "k", "own", "g", "frag", rows, **sizes).collect()} == want


def test_prior_search_writes_no_pairs(spark, monkeypatch):
    """What is written grows with the readings and with the texts, not with the pairs of both."""
    from lacuna.plans import audit_queries as A
    from lacuna.session import WorkDir

    sf, save, rows = "/root/testdata/sf0.01", WorkDir.save, {}

    def counted(self, df, name, *more):
        out = save(self, df, name, *more)
        rows[name] = out.count()
        return out

    pairs = A.prior_candidates(spark, sf).count()
    monkeypatch.setattr(WorkDir, "save", counted)
    assert A.prior_search(spark, sf).count() == 31
    assert rows and max(rows.values()) < pairs, rows
