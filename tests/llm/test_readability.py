from collections import Counter

from lacuna.llm.readability import Gate, english_labels, is_name, reader, reading_levels, unlisted

EASY = "The cat sat on the mat. It was a red cat. We had a dog. The dog was big. It sat by the wall. They ran to the hill. "
HARD = "The methodological reconstruction of heterogeneous terminologies necessitates comprehensive reconsideration of the palaeographical evidence, whose interpretation remains provisional and which is not to be considered conclusive by the editors of this volume. "


def test_cut():
    r = reader()
    words, n = r.cut("<b>The</b> lid of frg. 3 is at 2.5 mm. It's old! Who was it?\n\nA title of this and that")
    assert n == 4 and words["It's"] == 1 and "b" not in words
    assert r.cut("The note from the box with שלום שלום שלום שלום שלום שלום שלום שלום") is None
    assert is_name("Kiax") and not is_name("KIAX") and not is_name("kiax")
    assert unlisted(Counter({"The": 2, "hard": 1, "Kiax": 5, "cat": 1}), frozenset({"the", "cat"})) == 0.25


def test_levels(spark, work):
    rows = [(i, EASY * 3) for i in range(20)] + [(100 + i, HARD * 2) for i in range(3)] + [(200, None), (201, ""), (202, " \n"), (203, "12 34"), (0, EASY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    anchors = spark.createDataFrame([(1, EASY), (1, EASY * 2), (3, HARD), (3, HARD * 2), (None, "x"), (2, None)], "level int, text string")
    out = reading_levels(docs, anchors, work).collect()
    assert len(out) == len(rows)
    assert {r["level"] for r in out if r["doc_id"] < 100} == {1} and {r["level"] for r in out if 100 <= r["doc_id"] < 200} == {3}
    assert all(r["level"] is None and not r["english"] for r in out if r["doc_id"] >= 200)
    assert all(r["level"] is None for r in reading_levels(docs, anchors.limit(0), work).collect())
    assert reading_levels(docs.limit(0), anchors, work).count() == 0


GERMAN = "Der Rand ist nicht mit der Zeile und das Leder ist alt, wie auf der Tafel zu sehen ist und mit dem Blatt in der Lade. "


def test_gate_is_learned_from_labels_and_anchors(spark, work):
    gate = Gate.learn({"the": 0.9, "of": 0.8, "and": 0.7, "in": 0.6, "rare": 0.01}, {"de": {"der": 0.9, "und": 0.8, "in": 0.7}})
    assert gate.marks == {"the", "of", "and"} and gate.foreign == [{"der", "und"}]
    assert gate.english({"the", "of", "and", "x"}) and not gate.english({"the", "of"}) and not gate.english({"the", "of", "and", "der", "und"})
    assert english_labels({"en": {"the": 0.9}, "EN?": {"the": 0.5, "x": 0.1}, "de": {"der": 0.9}}, {"the": 1.0, "cat": 0.3}) == {"en", "EN?"} and english_labels({}, {}) == set()
    # labels that are wrong, unusual or missing
    rows = [(i, EASY, ("en", "EN", "und", None)[i % 4]) for i in range(80)] + [(100 + i, GERMAN, "de" if i else "en") for i in range(30)] + [(200, EASY * 2, "de"), (201, HARD, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    anchors = spark.createDataFrame([(1, EASY), (3, HARD)], "level int, text string")
    english = {r["doc_id"]: r["english"] for r in reading_levels(docs, anchors, work, label="lang").collect()}
    assert all(english[i] for i in [*range(80), 200]) and not any(english[100 + i] for i in range(30))
