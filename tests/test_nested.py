from lacuna.operators.nested import flatten_nested

SCHEMA = "rec_id long, pos string, a array<struct<key:string, n:int, tags:array<string>, deep:struct<x:int, more:array<int>>>>, m map<string, array<struct<t:string>>>, s map<string, int>, nn array<array<int>>"


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def make(spark):
    return spark.createDataFrame(
        [
            (1, "p", [("k1", 1, ["u", None, "v"], (5, [7, None])), None, (None, None, None, None), ("k1", 1, ["u"], (6, []))], {"x": [("t1",), None, ("t2",)], "y": [], "z": None}, {"q": 3}, [[1, 2], None, []]),
            (2, None, None, None, None, None),
            (3, "p", [], {}, {}, []),
            (None, "p", [("k", 9, None, None)], None, None, None),
        ],
        SCHEMA,
    )


def test_elements_keep_place_and_parent(spark):
    f = flatten_nested(make(spark), "rec_id")
    assert f.tags == ["a", "a.tags", "a.deep.more", "m", "s", "nn", "nn.element"]
    a = f.table("a")
    assert a.columns == ["root_key", "key", "parent_key", "map_key", "pos", "x_key", "n", "deep_x"]
    got = rows(a.select("root_key", "key", "parent_key", "pos", "x_key", "n", "deep_x"))
    assert got == sorted(
        [("1", "1/a:0", "1", "0", "k1", "1", "5"), ("1", "1/a:2", "1", "2", "None", "None", "None"), ("1", "1/a:3", "1", "3", "k1", "1", "6"), ("None", "None", "None", "0", "k", "9", "None")]
    )
    assert rows(f.table("a.tags").select("parent_key", "pos", "value")) == [("1/a:0", "0", "u"), ("1/a:0", "2", "v"), ("1/a:3", "0", "u")]
    assert rows(f.table("a.deep.more").select("parent_key", "pos", "value")) == [("1/a:0", "0", "7")]
    assert rows(f.table("m").select("map_key", "pos", "t")) == [("x", "0", "t1"), ("x", "2", "t2")]
    assert rows(f.table("s").select("map_key", "pos", "value")) == [("q", "0", "3")]
    assert rows(f.table("nn.element").select("parent_key", "pos", "value")) == [("1/nn:0", "0", "1"), ("1/nn:0", "1", "2")]


def test_written_tables_are_the_same(spark, work):
    f = flatten_nested(make(spark), "rec_id")
    g = f.written(work)
    for t in f.tags:
        assert rows(f.table(t)) == rows(g.table(t))
        assert f.table(t).schema.names == g.table(t).schema.names


def test_written_without_any_element(spark, work):
    d = make(spark)
    for none in (d.limit(0), d.where("rec_id = 2"), d.where("rec_id = 3")):
        for keys_only in (False, True):
            f = flatten_nested(none, "rec_id", keys_only=keys_only)
            g = f.written(work)
            assert all(g.table(t).count() == 0 and g.table(t).columns == f.table(t).columns for t in f.tags)


def test_keys_only(spark, work):
    f = flatten_nested(make(spark), "rec_id", keep=["a", "m"], keys_only=True).written(work)
    assert f.table("a").columns == ["root_key", "key", "parent_key", "map_key", "pos"] and f.table("a").count() == 4
    assert rows(f.table("m").select("map_key", "pos")) == [("x", "0"), ("x", "2")]


def test_empty_table_and_no_nested_column(spark):
    import pytest

    f = flatten_nested(make(spark).limit(0), "rec_id")
    assert all(f.table(t).count() == 0 for t in f.tags)
    with pytest.raises(ValueError):
        flatten_nested(spark.range(3), "id")


def test_one_scan_and_no_shuffle(spark):
    plan = flatten_nested(make(spark), "rec_id").rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1


def test_the_query_writes_all_tables_with_their_columns(spark, monkeypatch):
    from lacuna.plans import record_queries as Q

    seen, real = {}, Q.flatten_nested

    def recorded(df, key, fields, *more):
        f = real(df, key, fields, *more)
        written = f.written
        f.written = lambda work, name: seen.setdefault(name, written(work, name))
        return f

    monkeypatch.setattr(Q, "flatten_nested", recorded)
    assert Q.p1_found(spark, "/root/testdata/sf0.001").count()
    assert {t for f in seen.values() for t in f.tags} == {"text_fragments", "text_fragments.etcbc", "links", "links.etcbc", "lines"}
    assert {"text", "marks"} <= set(seen["pairs"].table("lines").columns) and {"edition", "tf_name"} <= set(seen["inventory_images"].table("text_fragments").columns)
    assert all(seen[n].table(t).count() for n, t in (("pairs", "links.etcbc"), ("inventory_images", "text_fragments.etcbc"), ("pairs", "lines")))
