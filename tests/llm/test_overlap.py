import random

import numpy as np

from lacuna.llm.fmindex import FMIndex, suffix_array
from lacuna.llm.overlap import Overlap, matching_texts, merged, overlapping_rows, search
from lacuna.operators.alignment import edits


def test_suffix_array_and_backward_search():
    rnd = random.Random(1)
    for _ in range(100):
        s = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 80))], dtype=np.uint8)
        assert list(suffix_array(s)) == sorted(range(len(s)), key=lambda i: tuple(s[i:]))
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) for _ in range(20)]
    ix = FMIndex.loads(FMIndex(texts).dumps())
    assert [ix.decode(i) for i in range(len(texts))] == texts
    for p in ("a", "ab", "abca", "zz", "cab"):
        c = ix.encode(p)
        lo, hi = ix.intervals(c, np.array([len(c)]), np.array([len(c)]))
        at = sorted(ix.locate(np.arange(lo[0], hi[0])))
        want = sorted(int(ix.start[k]) + i for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(p, i))
        assert at == want


def change(rnd, s, alphabet="abcdefgh"):
    s = list(s)
    for _ in range(rnd.randint(0, len(s) // 10 + 1)):
        i, o = rnd.randrange(len(s)), rnd.random()
        if o < 0.33:
            s[i] = rnd.choice(alphabet)
        elif o < 0.66:
            s.insert(i, rnd.choice(alphabet))
        elif len(s) > 20:
            del s[i]
    return "".join(s)


def test_search_loses_no_match_and_shards_agree(spark, work):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdef") for _ in range(rnd.choice([20, 25, 40, 90, 300]))) for _ in range(25)]
    held, train = sorted({change(rnd, b) for b in base for _ in range(3)}), sorted({change(rnd, b) for b in base for _ in range(3)} | {base[0]})
    close = lambda a, b: len(a) >= 20 <= len(b) and edits(a, b) * 10 <= max(len(a), len(b))
    want = {(a, b) for a in train for b in held if close(a, b)}
    found = list(search(FMIndex.loads(FMIndex(held).dumps()), train))
    assert want and want <= {(a, b) for a, b, *_ in found}
    for a, b, n, spans in found:
        assert sum(y - x for x, y in spans) > 0 and n > 0 and all(b[x:y] for x, y in spans)
    t, h = (spark.createDataFrame([(x,) for x in [*v, v[0], "short", None]], "letters string") for v in (train, held))
    for shard in (500, 10**6):
        got = [(r["a"], r["b"]) for r in matching_texts(t, h, work, shard=shard, block=700).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert matching_texts(t.limit(0), h, work).count() == 0 and matching_texts(t, h.limit(0), work).count() == 0


def test_rows(spark, work):
    a = "abcdefghijklmnopqrstuvwxyz"
    texts = spark.createDataFrame([("p1", a), ("p2", a[:5] + "X" + a[5:]), ("p3", a[::-1]), ("p4", None)], "place string, letters string")
    rows = spark.createDataFrame([(1, "train", "p1"), (2, "val", "p2"), (3, "test", "p1"), (4, "train", "p3"), (5, None, "p1"), (6, "test", "p4"), (2, "val", "p2")], "key long, split string, place string")
    got = sorted(tuple(r) for r in overlapping_rows(rows, texts, ["place"], work).collect())
    assert got == [(1, 2), (1, 3)]


def pieces_spans(a, b):
    """Merged maximal matches that hold a piece of a, at all places of b that are near enough, in letters of either."""
    k, d = len(a) // 9 + 1, max(len(a), len(b)) // 10
    own, other = set(), set()
    for i in range(k):
        x, y = i * len(a) // k, (i + 1) * len(a) // k
        for o in range(max(0, x - d), min(len(b), x + d + 1)):
            if b.startswith(a[x:y], o):
                u, v = x, o
                while u and v and a[u - 1] == b[v - 1]:
                    u, v = u - 1, v - 1
                n = 0
                while u + n < len(a) and v + n < len(b) and a[u + n] == b[v + n]:
                    n += 1
                own |= set(range(u, u + n))
                other |= set(range(v, v + n))
    return own, other


def test_spans_against_brute_force(spark, work):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdef") for _ in range(rnd.choice([20, 30, 60, 120]))) for _ in range(12)]
    held, train = sorted({change(rnd, b) for b in base for _ in range(2)}), sorted({change(rnd, b) for b in base for _ in range(2)})
    texts = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(train)] + [(f"h{i}", x) for i, x in enumerate(held)] + [("h0", "z" * 25)], "place string, letters string")
    rows = spark.createDataFrame([(i, "train", f"t{i}") for i in range(len(train))] + [(1000 + i, "test", f"h{i}") for i in range(len(held))], "key long, split string, place string")
    o = Overlap(rows, texts, ["place"], work)
    close = lambda a, b: len(a) >= 20 <= len(b) and edits(a, b) * 10 <= max(len(a), len(b))
    for r in o.matches.collect():
        own, other = pieces_spans(r["a"], r["b"])
        assert r["matched"] == len(own) and {i for s in r["spans"] for i in range(s["s"], s["e"])} == other
    want = {}
    for i, b in [*enumerate(held), (0, "z" * 25)]:
        with_ = [a for a in train if close(a, b)]
        if len(b) >= 20:
            want[f"h{i}", b] = (len(with_), len(set().union(*[pieces_spans(a, b)[1] for a in with_])))
    assert {(r["place"], r["letters"]): (r["matches"], r["covered"]) for r in o.spans().collect()} == want and any(n for n, _ in want.values())


def test_few_letters_in_spans_are_no_match():
    a = "abcdefghij" * 3
    b = a[:10] + "zyxwvutsrq" * 2
    assert not list(search(FMIndex([b]), [a])) and [n for _, _, n, _ in search(FMIndex([a]), [a])] == [30]
    assert merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
