import random

import pytest
from pyspark.sql import functions as F

from lacuna.llm.spans import WINDOW, FingerprintIndex, SharedSpans, chunks_of_texts, chunks_of_words, classes, seeds, with_members


def spans_of(chunks, work, buckets=4, fanout=4, hot=1000):
    return SharedSpans(chunks, work, FingerprintIndex(work.spark, work.place("index"), buckets, fanout, hot))


def brute(texts):
    keys = sorted(texts)
    wins = {k: {texts[k][i : i + WINDOW] for i in range(len(texts[k]) - WINDOW + 1)} for k in keys}
    pairs = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if wins[a] & wins[b]}
    cover = {}
    for k in keys:
        other = set().union(*[wins[x] for x in keys if x != k]) if len(keys) > 1 else set()
        at = {j for i in range(len(texts[k]) - WINDOW + 1) if texts[k][i : i + WINDOW] in other for j in range(i, i + WINDOW)}
        if at:
            cover[k] = len(at)
    return pairs, cover


@pytest.mark.parametrize("fanout,hot", [(2, 1000), (4, 3)])
def test_lines_and_words_against_brute_force(spark, work, fanout, hot):
    rnd = random.Random(fanout)
    word = lambda: "".join(rnd.choice("אבגדה") for _ in range(rnd.randint(0, 6)))
    stock = [" ".join(word() for _ in range(15)) for _ in range(4)]
    texts = {f"k{i:02d}": " ".join(rnd.choice([word(), word(), rnd.choice(stock)]) for _ in range(rnd.randint(0, 40))) for i in range(30)}
    texts["long"] = "א" * 3000 + stock[0] + "ב" * 600
    texts["mono"] = "א" * 45
    lines = spark.createDataFrame([("t", k, i % 5, t) for i, (k, t) in enumerate(texts.items())], "tab string, key string, batch int, text string")
    scrolls = {f"s{i}": [w for w in texts[f"k{i:02d}"].split(" ")] for i in range(12)}
    scrolls["s99"] = texts["long"].split(" ") + [word() for _ in range(700)] + stock[1].split(" ")
    words = spark.createDataFrame([("w", k, 0, w, 1000 + 7 * n) for k, ws in scrolls.items() for n, w in enumerate(ws)], "tab string, key string, batch int, word string, word_id long")
    s = spans_of(chunks_of_texts(lines).unionByName(chunks_of_words(words, "word_id")), work, 4, fanout, hot)
    got = {(r["tab"], r["key_a"], r["key_b"]) for r in s.pairs().collect()}
    cover = {(r["tab"], r["key"]): r["covered"] for r in s.covered().collect()}
    for tab, t in (("t", texts), ("w", {k: " ".join(w) for k, w in scrolls.items()})):
        pairs, c = brute(t)
        assert {(a, b) for x, a, b in got if x == tab} == pairs
        assert {k: n for (x, k), n in cover.items() if x == tab} == c


def test_copies_and_empty(spark, work):
    text = "x" * 10 + "abcdefghij" * 4
    d = spark.createDataFrame([("t", f"k{i}", 0, text) for i in range(4)] + [("t", "z", 0, "y" + text), ("t", "short", 0, "abc"), ("t", "short2", 0, "abc")], "tab string, key string, batch int, text string")
    c = classes(d)
    s = spans_of(chunks_of_texts(c.where("key = rep").select("tab", "key", F.col("first").alias("batch"), "text")), work)
    members = c.where(f"copies > 1 and length(text) >= {WINDOW}").select("tab", "rep", "key")
    got = sorted((r["key_a"], r["key_b"]) for r in with_members(s.pairs(), members).collect())
    keys = ["k0", "k1", "k2", "k3", "z"]
    assert got == [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    none = spans_of(chunks_of_texts(d.limit(0)), work)
    assert none.pairs().count() == 0 and none.covered().count() == 0


def test_hashes_tell_windows_apart():
    import numpy as np

    from lacuna.llm.spans import SEED, _hashes

    rnd = np.random.default_rng(1)
    codes = rnd.integers(0x5D0, 0x5EB, 20_000).astype(np.uint32)
    h = _hashes(np.concatenate([codes, codes]), SEED)
    assert len(set(h[: 20_000 - SEED + 1].tolist())) == 20_000 - SEED + 1
    assert (h[: 20_000 - SEED + 1] == h[20_000:]).all()


def test_a_later_session_finds_pairs_with_history(spark, work):
    rnd = random.Random(6)
    phrase = "".join(rnd.choice("abcdefgh") for _ in range(60))
    noise = lambda n: "".join(rnd.choice("ijklmnop") for _ in range(n))
    texts = {f"k{i}": noise(70) + (phrase if i % 2 else phrase[:30]) + noise(50) for i in range(8)}
    make = lambda keys, b: chunks_of_texts(spark.createDataFrame([("t", k, b, texts[k]) for k in keys], "tab string, key string, batch int, text string"))
    at = work.place("index")
    first = FingerprintIndex.open(spark, at, 4)
    first.add(seeds(make(["k0", "k1", "k2", "k3"], 1)), "1")
    first.close()
    other = spark.newSession()
    second = FingerprintIndex.open(other, at)
    assert second.state["buckets"] == 4 and len(second.runs) == 1
    second.add(seeds(make(["k4", "k5", "k6", "k7"], 2)), "2")
    second.add(seeds(make(["k4", "k5", "k6", "k7"], 2)), "2")  # it is there already
    third = SharedSpans(make(["k1"], 2), work, FingerprintIndex.open(spark, at))
    got = {(r["key_a"], r["key_b"]) for r in third.pairs().collect()}
    pairs, cover = brute(texts)
    assert got == pairs and ("k1", "k7") in got and len(second.runs) == 2
    assert {r["key"]: r["covered"] for r in third.covered().collect()} == cover


def test_words_that_come_later_are_in_a_later_batch(spark):
    w = [("w", "s", 2024 if i < 300 else 2025, "abc", i) for i in range(400)]
    c = chunks_of_words(spark.createDataFrame(w, "tab string, key string, batch int, word string, word_id long"), "word_id")
    assert [r["batch"] for r in c.orderBy("chunk").collect()] == [2024, 2025, 2025, 2025]


def test_stretches_over_the_edges_of_parts(spark, work):
    rnd = random.Random(9)
    a = "".join(rnd.choice("abcdefgh") for _ in range(140_000))
    texts = {"a": a, "b": "x" * 50 + a[65_400:65_700] + "y" * 50 + a[131_050:131_120], "c": a[65_500:65_580], "d": a[65_536:65_600]}
    d = spark.createDataFrame([("t", k, 0, t) for k, t in texts.items()], "tab string, key string, batch int, text string")
    assert {r["key"]: r["covered"] for r in spans_of(chunks_of_texts(d), work).covered().collect()} == brute(texts)[1]
