import math
import random

import numpy as np

from lacuna.operators import alignment as A


def slow_words(scroll, base):
    """Costs in millionths by the recurrence, and the path that takes pairs first."""
    n, m = len(scroll), len(base)
    pair = lambda i, j: A.WORD_UNKNOWN if scroll[i] is None else A.word_cost(scroll[i], base[j])
    cost = {}
    for i in range(n + 1):
        for j in range(m + 1):
            options = [0] if i == j == 0 else []
            options += [cost[i - 1, j - 1] + pair(i - 1, j - 1)] if i and j else []
            options += [cost[i - 1, j] + A.WORD_GAP] if i else []
            options += [cost[i, j - 1] + A.WORD_SKIP] if j else []
            cost[i, j] = min(options)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + pair(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + A.WORD_GAP:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def test_words_against_the_recurrence():
    assert A.align_words([(["שלום", None, "גדל"], ["שלם", "אב", "גדל", "בן"])]) == [[(0, 0), (1, 1), (2, 2), (None, 3)]]
    assert A.align_words([([], ["א"]), (["א"], []), ([], [])]) == [[(None, 0)], [(0, None)], []] and A.align_words([]) == []
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("אבגםי") for _ in range(rnd.randint(0, 4)))
    verses = [([rnd.choice([word(), word(), word(), None]) for _ in range(rnd.randint(0, 7))], [word() for _ in range(rnd.randint(0, 7))]) for _ in range(300)]
    assert A.align_words(verses) == [slow_words(*v) for v in verses]


def slow_bands(bands, lines, pitch, width):
    """States by memoised recursion: of each pair of places the cheapest way there, with the last pair it has."""
    from functools import lru_cache

    def misfit(i, j):
        return abs(math.log(max(bands[i]["x1"] - bands[i]["x0"], 1) / (max(len(lines[j]["label"]), 1) * width * pitch)))

    @lru_cache(None)
    def best(i, j):
        if i == j == 0:
            return 0.0, None, ()
        ways = []
        if i and j:
            c, last, path = best(i - 1, j - 1)
            far = 0.0
            if last is not None and lines[j - 1]["num"] is not None and lines[last[1]]["num"] is not None:
                far = 1.5 * abs((bands[i - 1]["y"] - bands[last[0]]["y"]) / pitch - (lines[j - 1]["num"] - lines[last[1]]["num"]))
            ways.append((c + (misfit(i - 1, j - 1) + far), (i - 1, j - 1), path + ((i - 1, j - 1),)))
        if i:
            c, last, path = best(i - 1, j)
            ways.append((c + (0.4 if bands[i - 1]["strength"] < 0.35 else 1.0), last, path))
        if j:
            c, last, path = best(i, j - 1)
            ways.append((c + (0.3 if lines[j - 1]["letters"] <= 2 else 1.2), last, path))
        return min(ways, key=lambda w: w[0])

    return list(best(len(bands), len(lines))[2])


def test_bands_against_the_recurrence():
    rnd = random.Random(2)
    pictures = []
    for _ in range(300):
        bands = [dict(y=rnd.randint(0, 300), x0=0, x1=rnd.randint(0, 200), strength=rnd.random()) for _ in range(rnd.randint(0, 6))]
        lines = [dict(label="x" * rnd.randint(0, 12), letters=rnd.randint(0, 12), num=rnd.choice([None, *range(8)])) for _ in range(rnd.randint(0, 6))]
        pictures.append(dict(bands=bands, lines=lines, pitch=rnd.choice([25.0, 40.0])))
    for p, got in zip(pictures, A.align_bands(pictures, 0.25)):
        assert [(i, j) for i, j, _ in got] == slow_bands(p["bands"], p["lines"], p["pitch"], 0.25)
    assert A.align_bands([], 0.5) == []


def slow_frames(logp, target):
    """The best score over all ways of giving frames to symbols and blanks."""
    best = [-math.inf]

    def go(t, k, on, score):  # k symbols begun; on: in the last of them
        if t == len(logp):
            if k == len(target):
                best[0] = max(best[0], score)
            return
        go(t + 1, k, False, score + logp[t][0])
        if on:
            go(t + 1, k, True, score + logp[t][target[k - 1]])
        if k < len(target) and not (on and target[k] == target[k - 1]):
            go(t + 1, k + 1, True, score + logp[t][target[k]])

    go(0, 0, False, 0.0)
    return best[0]


def test_forced_frames_against_all_paths():
    rng = np.random.default_rng(3)
    logps, targets = [], []
    for _ in range(300):
        logps.append(np.log(rng.dirichlet(np.ones(4), int(rng.integers(0, 7)))))
        targets.append([int(x) for x in rng.integers(1, 4, int(rng.integers(0, 4)))])
    for logp, target, got in zip(logps, targets, A.forced_frames(logps, targets)):
        want = slow_frames(logp, target) if len(logp) else -math.inf
        if want == -math.inf:
            assert got is None
            continue
        assert all(f and f == list(range(f[0], f[-1] + 1)) for f in got) and all(a[-1] < b[0] for a, b in zip(got, got[1:]))
        owner = {t: c for c, f in zip(target, got) for t in f}
        assert sum(row[owner.get(t, 0)] for t, row in enumerate(logp)) == np.float64(want).round(12) or abs(sum(row[owner.get(t, 0)] for t, row in enumerate(logp)) - want) < 1e-9
        assert all(target[k] != target[k + 1] or got[k][-1] + 1 < got[k + 1][0] for k in range(len(target) - 1))


def test_greedy_symbols():
    p = np.full((7, 3), 0.1)
    for t, k in enumerate((1, 1, 0, 1, 2, 2, 0)):
        p[t, k] = 0.8
    assert A.greedy_symbols(np.log(p)) == [1, 1, 2] and A.greedy_symbols([]) == []


def test_on_dataframes(spark):
    d = spark.createDataFrame([("a", ["שלם", None], ["שלום"]), ("b", None, ["א"]), ("c", [], [])], "k string, s array<string>, b array<string>")
    assert sorted(map(tuple, A.aligned_words(d, ["k"], "s", "b").collect())) == [("a", 0, 0), ("a", 1, None)]
    frames = [[math.log(x) for x in row] for row in ((0.1, 0.8, 0.1), (0.8, 0.1, 0.1), (0.1, 0.1, 0.8))]
    f = spark.createDataFrame([("a", frames, [1, 2]), ("b", frames[:1], [1, 2]), ("c", None, [1]), ("d", frames, [])], "k string, p array<array<double>>, t array<int>")
    assert sorted(map(tuple, A.forced(f, ["k"], "p", "t").collect())) == [("a", 0, 0, 0), ("a", 1, 2, 2)]
    assert {r["k"]: r["symbols"] for r in A.decoded(f, ["k"], "p").collect()} == {"a": [1, 2], "b": [1], "d": [1, 2]}
    line = dict(label="x" * 10, letters=10, num=1)
    schema = "k string, bands array<struct<y:double,x0:int,x1:int,strength:double>>, lines array<struct<label:string,letters:int,num:int>>, pitch double"
    weak = [(0.0, 0, 100, 0.9), (20.0, 0, 5, 0.1), (40.0, 0, 100, 0.9)]
    lines = [("x" * 10, 10, 1), ("x" * 10, 10, 2)]
    b = spark.createDataFrame([("a", weak, lines, 40.0), ("b", weak, lines, 0.0), ("c", None, lines, 40.0), ("d", [], lines, 40.0)], schema)
    assert sorted((r["k"], r["band"], r["line"]) for r in A.aligned_bands(b, ["k"], "bands", "lines", "pitch", 0.25).collect()) == [("a", 0, 0), ("a", 2, 1)] and line
    e = spark.createDataFrame([("a", "abc", "xxabdxx"), ("b", "", "x"), ("c", None, "x")], "k string, a string, b string")
    assert sorted((r["k"], r["edits"]) for r in A.best_substring(e, "a", "b", ["k"]).collect()) == [("a", 1), ("b", 0), ("c", None)]
