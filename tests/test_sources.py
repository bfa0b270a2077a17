from pyspark.sql import functions as F

from lacuna.sources import files as IO
from lacuna.streaming import incremental as I


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "x": "a"}, {"id": 2}]')
    assert sorted(map(tuple, IO.read_json_array(spark, str(tmp_path / "a.json"), "id long, x string").collect())) == [(1, "a"), (2, None)]
    out = str(tmp_path / "lines")
    IO.append_json_lines(spark.createDataFrame([(1, "a")], "id long, x string"), out)
    IO.append_json_lines(spark.createDataFrame([(2, 5)], "id long, n long"), out)
    got = sorted(map(tuple, IO.read_json_lines(spark, [out], "id long, x string, n long").collect()))
    assert got == [(1, "a", None), (2, None, 5)]


def test_verses_without_notes(spark, tmp_path):
    (tmp_path / "v.xml").write_text('<b><verse osisID="Gen.1.1"><w>בְּרֵא</w><note>n<w>xx</w></note><w>שִׁית/</w></verse></b>', encoding="utf-8")
    assert [tuple(r) for r in IO.read_verses(spark, str(tmp_path / "v.xml")).collect()] == [("Gen.1.1", "ברא שית")]


def test_harvest_retries_and_reports(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page int")

    def fetch(p):
        if p["page"] == 2:
            raise OSError("down")
        return [{"id": 7, "error": None}]

    got = sorted(((r["id"], r["error"]) for r in IO.harvest(pages, fetch, "id double, error string", tries=2).collect()), key=str)
    assert got == [(7.0, None), (None, "OSError: down")]


def test_read_through_and_resume(spark, tmp_path):
    made = []
    path = str(tmp_path / "t")
    for _ in range(2):
        d = IO.read_through(spark, path, lambda: made.append(1) or spark.range(3).toDF("id"))
        assert d.count() == 3
    assert len(made) == 1
    at = str(tmp_path / "r")
    seen = []
    IO.resume(spark.range(3).toDF("id"), at, ["id"], lambda x: seen.append(x.count()) or x)
    assert IO.resume(spark.range(5).toDF("id"), at, ["id"], lambda x: seen.append(x.count()) or x).count() == 5
    assert seen == [3, 2]


def test_stream_runs_twice_without_repeats(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(4).toDF("id").write.parquet(src)
    stream = lambda: I.read_folder(spark, src, "*.parquet", "id long")
    I.run_available(stream(), cp, I.append_once(out))
    spark.range(4, 6).toDF("id").write.mode("append").parquet(src)
    I.run_available(stream(), cp, I.append_once(out))
    assert sorted(r["id"] for r in spark.read.parquet(out).select("id").collect()) == [0, 1, 2, 3, 4, 5]


def test_tensors(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [])], "k string, v array<double>")
    back = IO.tensor_arrays(IO.tensor_rows(d, ["k"], "v"), ["k"]).select("k", F.col("values"))
    assert [tuple(r) for r in back.collect()] == [("a", [1.0, 2.0])]


def test_plain_texts_of_all_documents(spark, tmp_path):
    from lacuna.plans.search_queries import plain_texts

    rows = [(1, "<b>un</b>&nbsp;mot", "fr"), (2, "בְּרֵאשִׁית־בָּרָא", "he"), (3, "<i>a</i>  word\n", None), (4, None, "en"), (5, "שָׁלוֹם <p>", "fr"), (6, " ", "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["plain"] for r in plain_texts(spark, str(tmp_path)).collect()}
    assert got == {1: "un mot", 2: "בראשית ברא", 3: "a word", 4: None, 5: "שלום", 6: ""}
