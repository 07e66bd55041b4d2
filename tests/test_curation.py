import pytest
from pyspark.sql import functions as F

from sparkdesk.functions.labels import map_labels
from sparkdesk.operators import curation as C
from sparkdesk.plans import loading as P


def test_map_labels_join_equals_the_map(spark):
    mapping = {"bug": "bug", "Crash": "bug", "misc": "other", "ui": "ui_ux"}
    lists = [["crash", "ui"], ["misc"], ["zzz", "ui", "bug"], [], None] + [["bug"]] * 50
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, labels array<string>")
    dim = spark.createDataFrame(list(mapping.items()), "alias string, group string")
    got = {r["id"]: r["mapped"] for r in C.map_labels_join(df, dim).collect()}
    want = {r["id"]: r["m"] for r in df.select(
        "id", F.coalesce(map_labels(F.col("labels"), mapping), F.array(F.lit("unknown"))).alias("m")
    ).collect()}
    assert got == want and len(got) == 55
    assert got[2] == ["ui_ux", "bug"]


def test_split_unknown_covers_all_rows(spark):
    df = spark.createDataFrame([(["unknown"],), (["a", "unknown"],), (["b"],)], "m array<string>")
    known, unknown = C.split_unknown(df, "m")
    assert (known.count(), unknown.count()) == (2, 1)


def test_severity_to_priority(spark):
    rows = [("T <b>", "b", " Critical"), ("t", "", "MAJOR"), ("<x>", "{y}", "minor"),
            ("t", "b", None), ("t", "b", "trivial"), (None, "B", "minor ")]
    df = spark.createDataFrame(rows, "title string, body string, severity string")
    got = [tuple(r) for r in C.severity_to_priority(df).select("title", "body", "priority").collect()]
    assert sorted(got) == [("", "B", "low"), ("T", "b", "critical"), ("t", "", "high")]


def test_filters(spark):
    df = spark.createDataFrame(
        [("a", ["x"]), (" ", ["x"]), ("oos", []), (None, ["x"])], "t string, l array<string>")
    assert C.drop_empty(df, ["t", "l"]).count() == 1
    assert C.drop_class(df, "t").count() == 3
    assert C.drop_null(df, ["t"]).count() == 3
    assert C.class_filter(df, "t", "a").count() == 1


def test_union_by_name_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "t string, id int")
    rows = [tuple(r) for r in C.union_splits([a, b, a.select("id")]).collect()]
    assert sorted(rows, key=str) == [(1, "x"), (1, "x"), (1, None), (2, "y")]


def test_loaders(spark):
    cat = spark.createDataFrame(
        [("T", "b", "['Bug', 'a-b']"), ("T", "b", "[]"), (None, "", "bug"), ("T", None, "UI")],
        "title string, body string, `labels-mapped` string")
    assert [tuple(r) for r in P.load_category(cat).collect()] == [
        ("t t b", ["bug", "a_b"]), ("t t", ["ui"])]
    listed = cat.withColumn("labels-mapped", F.array(F.lit("A b")))
    assert P.load_category(listed).first()["labels"] == ["a_b"]
    pri = spark.createDataFrame([("T", "b", "High"), ("T", "b", None), (None, None, "low")],
                                "title string, body string, priority string")
    assert [tuple(r) for r in P.load_priority(pri).collect()] == [("t t b", "high")]
    intent = spark.createDataFrame([(" Hi  X", "Get-Refund"), ("", "a"), ("t", "")],
                                   "text string, intent string")
    assert [tuple(r) for r in P.load_intent(intent).collect()] == [("hi x", "get_refund")]
    with pytest.raises(ValueError, match="missing columns"):
        P.load_intent(pri)
