import math

import pytest
from pyspark.sql import functions as F

from sparkdesk.functions import decode as D
from sparkdesk.operators import metrics as M
from sparkdesk.operators import reports as R

A = "c array<double>"


def test_decode_single(evaluate):
    got = evaluate(lambda c: D.decode_single(c, ["x", "y", "z"]), A, ([0.2, 0.67815, 0.67815],))
    assert got[0].asDict() == {"label": "y", "confidence": 0.6782}
    got = evaluate(lambda c: D.decode_single(c, ["x", "y"], digits=None), A, ([0.2, 0.123456],))
    assert got[0]["confidence"] == 0.2


def test_decode_multi(evaluate):
    names = ["a", "b", "c", "d"]
    got = evaluate(
        lambda c: D.decode_multi(c, names), A,
        ([0.9, 0.5, 0.7, 0.6],), ([0.1, 0.4, 0.4, 0.2],), ([0.5, 0.5, 0.5, 0.5],),
        ([0.49999, 0.1, 0.1, 0.1],),
    )
    assert [[p["label"] for p in g] for g in got] == [
        ["a", "c", "d"], ["b"], ["a", "b", "c"], ["a"]]
    assert got[3][0]["confidence"] == 0.5  # chosen before rounding, as the only one


def test_softmax_and_sigmoid(evaluate):
    soft, binary, large = evaluate(D.softmax_scores, A, ([1.0, 2.0, 3.0],), ([1.5],), ([900.0, 0.0],))
    total = sum(math.exp(x) for x in (1, 2, 3))
    assert soft == pytest.approx([math.exp(x) / total for x in (1, 2, 3)])
    assert binary == pytest.approx([1 / (1 + math.exp(3)), 1 / (1 + math.exp(-3))])
    assert large == pytest.approx([1.0, 0.0])
    assert evaluate(D.sigmoid_scores, A, ([0.0, 2.0],))[0] == pytest.approx(
        [0.5, 1 / (1 + math.exp(-2))])
    with pytest.raises(ValueError):
        D.decode_logits(F.col("c"), ["a"], "other")


def report(df):
    return {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in df.collect()}


def test_single_label_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "d")]
    df = spark.createDataFrame(pairs, "y string, p string")
    assert M.accuracy(df).first()[0] == 0.5
    rows = report(M.classification_report(df))
    assert rows["a"] == pytest.approx((0.5, 1 / 3, 0.4, 3))
    assert rows["b"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert rows["c"] == (0.0, 0.0, 0.0, 1) and rows["d"] == (0.0, 0.0, 0.0, 0)
    assert rows["accuracy"] == (None, None, 0.5, 6)
    assert rows["macro avg"][2] == pytest.approx(0.3)
    assert rows["weighted avg"][2] == pytest.approx((0.4 * 3 + 0.8 * 2) / 6)
    assert M.macro_f1(df).first()[0] == pytest.approx(0.3)
    matrix = [tuple(r) for r in M.confusion_matrix(df, ["c", "a", "b"]).collect()]
    assert matrix == [("c", 0, 1, 0), ("a", 0, 1, 1), ("b", 0, 0, 2)]


def test_missing_labels_are_no_class(spark):
    pairs = [("a", "a"), ("a", None), ("b", "b"), ("b", None), (None, "b")]
    df = spark.createDataFrame(pairs, "y string, p string")
    rows = report(M.classification_report(df))
    assert set(rows) == {"a", "b", "accuracy", "macro avg", "weighted avg"}
    assert rows["a"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert rows["b"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert rows["accuracy"] == (None, None, 0.5, 4)
    known = df.where("y IS NOT NULL")
    assert M.macro_f1(known).first()[0] == pytest.approx(2 / 3)
    lists = spark.createDataFrame([(["a"], None), (None, ["a"]), (["a"], ["a"])], "y array<string>, p array<string>")
    got = report(M.classification_report_multi(lists, ["a"]))
    assert got["a"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert got["samples avg"] == pytest.approx((1 / 3, 1 / 3, 1 / 3, 2))


def test_multi_label_metrics(spark):
    rows = [(["a", "b"], ["a"]), (["b"], ["b", "c"]), ([], []), (["a"], ["b"])]
    df = spark.createDataFrame(rows, "y array<string>, p array<string>")
    classes = ["a", "b", "c", "d"]
    assert M.subset_accuracy(df).first()[0] == 0.25
    assert M.micro_f1(df, classes).first()[0] == pytest.approx(4 / 8)
    got = report(M.classification_report_multi(df, classes))
    assert got["d"] == (0.0, 0.0, 0.0, 0)
    assert got["micro avg"] == pytest.approx((2 / 4, 2 / 4, 0.5, 4))
    assert got["samples avg"] == pytest.approx(
        ((1 + 0.5) / 4, (0.5 + 1) / 4, (2 / 3 + 2 / 3) / 4, 4))
    assert got["macro avg"][2] == pytest.approx(M.macro_f1(df, classes).first()[0])


def test_coverage_by_hand(spark):
    uses = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"] * 3 + ["e"]
    df = spark.createDataFrame([(uses,)], "l array<string>")
    def brute(share):
        total, run = len(uses), 0
        for n, c in enumerate(sorted((uses.count(x) for x in set(uses)), reverse=True), 1):
            run += c
            if run >= share * total:
                return n, run / total
    for share in (0.1, 1 / 3, 0.5, 0.83, 0.95, 1.0):
        assert tuple(R.label_coverage(df, "l", share).first()) == pytest.approx(brute(share))


def test_value_counts_and_shares(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "v string")
    assert [tuple(r) for r in R.value_counts(df, "v").collect()] == [("x", 2), ("y", 1)]
    assert [tuple(r) for r in R.value_counts(df, "v", 1).collect()] == [("x", 2)]
    shares = [r["percent"] for r in R.value_shares(df, "v").collect()]
    assert shares == pytest.approx([200 / 3, 100 / 3])


def test_prediction_log_without_category(spark):
    df = spark.createDataFrame(
        [(None, "b", [], ("p", 0.5), ("i", 0.25), "m", 1.0)],
        "title string, body string, category array<struct<label:string,confidence:double>>, "
        "priority struct<label:string,confidence:double>, "
        "intent struct<label:string,confidence:double>, model_backend string, latency_ms double",
    )
    row = R.prediction_log(df).first()
    assert (row["title_length"], row["top_category_confidence"]) == (0, 0.0)
    past = R.session_history(df.withColumn("timestamp", F.current_timestamp())).first()
    assert past["top_category"] == "—"
