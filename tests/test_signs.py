from pyspark.sql import functions as F

from lacuna.operators import signs as G


def test_lines_of_signs(spark):
    rows = [("l", 1, 1, "א", "s", "", 0, 0, 0), ("l", 1, 2, "ב", "s", " ", 0, 1, 0), ("l", 2, 1, None, "missing", "", 0, 0, 0), ("l", 2, 2, None, "missing", "", 0, 0, 0), ("l", 3, 1, "ג", "s", " ", 1, 1, 1), ("m", 1, 1, "", "s", " ", 0, 0, 0)]
    d = spark.createDataFrame(rows[::-1], "line string, word int, sign int, glyph string, kind string, after string, script int, rec int, unc int")
    assert [tuple(r) for r in G.lines_of_signs(d, ["line"]).collect()] == [("l", "אב #ג", ".r #p")]


def test_edition_text(spark):
    rows = [("e", 2, "ב", [("sign_type", "LETTER")]), ("e", 1, "א", [("sign_type", "LETTER"), ("x", "y")]), ("e", 3, "ג", [("sign_type", "LETTER"), ("is_reconstructed", "TRUE")]), ("e", 4, " ", [("sign_type", "SPACE")]), ("f", 1, "א", None)]
    d = spark.createDataFrame(rows, "e string, i int, letter string, attributes array<struct<kind:string,value:string>>")
    assert [tuple(r) for r in G.edition_text(d, "e", ["i"]).collect()] == [("e", "אב")]


def test_classifiers(spark):
    t, f = F.lit(True), F.lit(False)
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(G.relabelled(F.lit("ok"), f, t, t, t, F.lit(0.1))) == "ok"
    assert one(G.relabelled(F.lit("no_fit"), t, t, f, t, F.lit(0.1))) == "split_record"
    assert one(G.relabelled(F.lit("no_fit"), t, t, f, f, F.lit(0.1))) == "other_frag"
    assert one(G.relabelled(F.lit("elsewhere"), t, f, f, f, F.lit(1.5))) == "weak_elsewhere"
    assert one(G.hit_kind(f, F.lit(None))) == "no_image_scroll" and one(G.hit_kind(t, F.lit(3))) == "missing_link"
    assert one(G.numbering(F.lit(0.9), F.lit(0.5))) == "same" and one(G.numbering(F.lit(0.5), F.lit(0.6))) == "unclear"
    assert one(G.contested(F.lit(0.1), F.lit(0.5))) and not one(G.contested(F.lit(0.2), F.lit(0.9)))


def test_markdown(spark):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string").orderBy("n")
    assert G.markdown(d) == "| n | s |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |\n"
