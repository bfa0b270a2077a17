"""Reading level of each document, on the scale of given anchor texts.

A familiar-word formula: the share of words outside a high-frequency list, and the average sentence length. The list holds the
words that at least a share `theta` of the corpus' English documents use; theta, the two coefficients and the constant are
fitted to the anchors (texts of known level, a small fixed table), and so are the cut points between levels, each at the same
number of standard deviations from its two neighbours. A list defined by a share of documents has at most (mean distinct words
of a document / theta) words, however large the corpus, so it goes to every worker.

Two passes over the corpus: document frequencies by label, summed in each task before the one small shuffle, and scores, without
a shuffle. Cutting texts into words is done in Arrow batches: measured on 12 million characters, the JVM's regular expressions
took five times the CPU of the library matcher used here.

Words are runs of letters with inner apostrophes. A capitalised word outside the list counts as a name and is left out. Markup
is removed first; dots of numbers and of common abbreviations end no sentence, an empty line does.

Which documents are English is learned, as labels of language can be null, wrong or unusual. Labels whose frequent words are
those of the anchors are English ones, however they are spelt, and the others foreign. Words that a tenth of the English
documents use and three times less of any foreign label's are marks of English, and words that a tenth of a foreign label's
documents use and three times less of the English ones are marks of that label. A document is running English, whatever its own
label says, if it has at least three marks of English and half as many again as of any foreign label, and half of its words are
in Latin letters.

Defined results: documents that aren't English, null, empty and wordless ones have level and score null (n_words is 0 for null);
repeated rows are scored each; without anchors nothing is English and nothing has a level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations with a dot.
ABBREVIATIONS = "frg frgs col cols cf pl pls no nos vol vols p pp fig figs l ll ms mss dr mr mrs st etc ca ed eds"
THETAS = (0.12, 0.15, 0.18, 0.21, 0.25)
#: A label counts if it has this share of the documents, and five of them.
LABEL = 0.0005
#: Shares of documents that make a word a mark of English or of another label, and how much rarer it must be elsewhere.
MARK, FOREIGN, RARER = 0.1, 0.1, 3.0
#: Of the anchors' most alike label's likeness, what an English label must have.
ALIKE = 0.5
#: A guard on the list's size (see the bound above), and the words that a task counts before it passes them on.
MAX_LIST, HELD = 200_000, 300_000


class Reader:
    """Cuts texts into words and sentences."""

    def __init__(self) -> None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        letters = "".join(f"{m[0][0]}-{m[0][-1]}" for m in regex.finditer(r"\p{L}+", every))
        self.ascii_words = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*").findall
        self.words = re.compile(f"[{letters}]+(?:['’][{letters}]+)*").findall
        self.markup = re.compile(r"<[^<>]{0,300}>|&[a-zA-Z]{1,8};|&#\d{1,6};").sub
        self.ends = re.compile(r"[.!?]+[\"'’”)\]]*(?:\s+|$)|\n\s*\n").finditer
        self.short = frozenset(ABBREVIATIONS.split())

    def words_of(self, text: str) -> list[str]:
        if "<" in text or "&" in text:
            text = self.markup(" ", text)
        return (self.ascii_words if text.isascii() else self.words)(text)

    def cut(self, text: str, gate: "Gate | None" = None) -> tuple[Counter, int] | None:
        """The words as written with their counts, and the number of sentences; None if the text isn't English by the gate."""
        if "<" in text or "&" in text:
            text = self.markup(" ", text)
        words = Counter((self.ascii_words if text.isascii() else self.words)(text))
        total = sum(words.values())
        if not total or 2 * sum(n for w, n in words.items() if w[0] < "ɐ") < total:
            return None
        if gate is not None and not gate.english({w.lower() for w in words}):
            return None
        n = done = 0
        for m in self.ends(text):
            at = m.start()
            if text[at] == ".":
                before = text[max(0, at - 6) : at].split()
                if before and before[-1].lower() in self.short:
                    continue
            n += 1
            done = m.end()
        return words, max(1, n + bool(text[done:].strip()))


class Gate:
    """Marks of English and of each foreign label, learned from document shares by label."""

    def __init__(self, english: frozenset, foreign: list[frozenset]) -> None:
        self.marks, self.foreign = english, foreign

    @classmethod
    def learn(cls, english: dict[str, float], foreign: dict[str, dict[str, float]]) -> "Gate":
        """From the shares of documents that use a word: of English ones, and of each foreign label's."""
        most = lambda w: max((d.get(w, 0.0) for d in foreign.values()), default=0.0)
        marks = frozenset(w for w, s in english.items() if s >= MARK and most(w) * RARER <= s)
        return cls(marks, [frozenset(w for w, s in d.items() if s >= FOREIGN and english.get(w, 0.0) * RARER <= s) for d in foreign.values()])

    def english(self, words: set[str]) -> bool:
        n = len(words & self.marks)
        return n >= 3 and n > 1.5 * max((len(words & f) for f in self.foreign), default=0)


def english_labels(labels: dict[str, dict[str, float]], anchors: dict[str, float]) -> set[str]:
    """The labels whose words are like the anchors' (cosine of document shares)."""
    norm = lambda d: math.sqrt(sum(v * v for v in d.values())) or 1.0
    like = {k: sum(v * anchors.get(w, 0.0) for w, v in d.items()) / (norm(d) * norm(anchors)) for k, d in labels.items()}
    top = max(like.values(), default=0.0)
    return {k for k, v in like.items() if top > 0 and v >= ALIKE * top}


@lru_cache(maxsize=1)
def reader() -> Reader:
    return Reader()


def is_name(word: str) -> bool:
    """Capitalised, but not all capitals."""
    return word[0].isupper() and (len(word) == 1 or not word.isupper())


def unlisted(words: Counter, listed: frozenset) -> float:
    """The share of words outside the list, names left out."""
    inside = outside = 0
    for w, n in words.items():
        if w in listed or w.lower() in listed:
            inside += n
        elif not is_name(w):
            outside += n
    return outside / max(1, inside + outside)


def learned(docs: DataFrame, text: str, label: str | None, anchors: dict[str, float], least: float, work) -> tuple[dict[str, float], Gate]:
    """The words in at least a share `least` of the English documents with their shares, and the gate."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.trim(F.lower(F.col(label).cast("string"))), F.lit("")).alias("label") if label else F.lit("").alias("label"), text)

    def run(batches):
        import pyarrow as pa

        r, held = reader(), Counter()

        def out():
            pairs = list(held)
            cols = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["label", "word", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    held[k, ""] += 1
                    held.update({(k, w) for w in {x.lower() for x in set(r.words_of(t))}})
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    # written, as it is read for the totals, the labels' words and those of English; the row of the empty word counts documents
    counts = d.mapInArrow(run, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))
    counts = work.save(counts, "words")
    total = {r["label"]: r["n"] for r in counts.where("word = ''").orderBy(F.desc("n")).limit(int(1 / LABEL) + 1).collect()}
    every = sum(total.values())
    total = {k: n for k, n in total.items() if n >= max(5, LABEL * every)}
    if not total or not anchors:
        return {}, Gate(frozenset(), [])
    sizes = F.broadcast(spark.createDataFrame(list(total.items()), "label string, total long"))  # at most 1 / LABEL rows
    # below this share a word can neither be a mark nor keep another from being one
    floor = min(FOREIGN, MARK / RARER) * 0.75
    rows = counts.where("word <> ''").join(sizes, "label").where(F.col("n") >= floor * F.col("total")).limit(MAX_LIST + 1).collect()
    labels: dict[str, dict[str, float]] = {k: {} for k in total}
    for r in rows:
        labels[r["label"]][r["word"]] = r["n"] / r["total"]
    ours = english_labels(labels, anchors)
    n = sum(total[k] for k in ours)
    low = min(least, FOREIGN / RARER)
    known = counts.where(F.col("label").isin(*ours) & (F.col("word") != "")).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= low * n).limit(MAX_LIST + 1).collect()
    if max(len(rows), len(known)) > MAX_LIST:
        raise ValueError("the word list is larger than its bound")
    shares = {r["word"]: r["n"] / n for r in known}
    gate = Gate.learn(shares, {k: v for k, v in labels.items() if k not in ours})
    return {w: s for w, s in shares.items() if s >= least}, gate


def fit(anchors: list[tuple[int, Counter, int]], shares: dict[str, float], thetas: tuple[float, ...]):
    """(listed words, coefficients, cut points as (level, least score), rising), by the theta of the least squared error."""
    import numpy as np

    y = np.array([a[0] for a in anchors], dtype=float)
    best = None
    for t in thetas:
        listed = frozenset(w for w, s in shares.items() if s >= t)
        x = np.array([[unlisted(w, listed), sum(w.values()) / n, 1.0] for _, w, n in anchors])
        c, *_ = np.linalg.lstsq(x, y, rcond=None)
        err = float(((x @ c - y) ** 2).mean())
        if best is None or err < best[0] - 1e-9:
            best = (err, listed, [float(v) for v in c], x @ c)
    assert best is not None
    _, listed, c, z = best
    cuts: list[tuple[int, float]] = []
    levels = sorted({int(v) for v in y})
    for a, b in zip(levels, levels[1:]):
        za, zb = z[y == a], z[y == b]
        sa, sb = za.std() + 1e-3, zb.std() + 1e-3
        at = float((za.mean() * sb + zb.mean() * sa) / (sa + sb))
        cuts.append((b, max(at, cuts[-1][1]) if cuts else at))
    return listed, c, [(levels[0], float("-inf")), *cuts]


def reading_levels(docs: DataFrame, anchors: DataFrame, work, key: str = "doc_id", text: str = "text", label: str | None = None, thetas: tuple[float, ...] = THETAS) -> DataFrame:
    """(key, level, score, unlisted, asl, english, n_words) of each row; see the module for the definitions. `label` names the
    column of language labels, if there is one."""
    texts = [(level, t) for level, t in anchors.select(F.col("level").cast("int"), "text").where("level is not null and text is not null").collect()]  # small and fixed
    used = Counter(w for _, t in texts for w in {x.lower() for x in reader().words_of(t)})
    shares, gate = learned(docs, text, label, {w: n / len(texts) for w, n in used.items()}, min(thetas), work)
    known = [(level, *got) for level, t in texts if (got := reader().cut(t))]
    model = fit(known, shares, thetas) if known and shares else None
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("level int, score double, unlisted double, asl double, english boolean, n_words long").fields])

    def run(batches):
        import pyarrow as pa

        r = reader()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                got = r.cut(t, gate) if t else None
                n_words = len(t.split()) if t else 0
                if not got:
                    rows.append((None, None, None, None, False, n_words))
                    continue
                asl = sum(got[0].values()) / got[1]
                if model is None:
                    rows.append((None, None, None, asl, True, n_words))
                    continue
                listed, c, cuts = model
                u = unlisted(got[0], listed)
                score = u * c[0] + asl * c[1] + c[2]
                rows.append(([k for k, least in cuts if score >= least][-1], score, u, asl, True, n_words))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(cols, kinds)]], names=[key, "level", "score", "unlisted", "asl", "english", "n_words"])

    return docs.select(key, text).mapInArrow(run, schema)
