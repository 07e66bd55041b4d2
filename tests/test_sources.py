from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkdesk.session import materialize, remove_path, shared_dir, work_path, written
from sparkdesk.sources import registry as G
from sparkdesk.sources import tables as S

AWKWARD = [
    ("a", 'line one\nline "two", with comma'), ("  padded ", "back\\slash \\\" end"),
    ('"', ""), ("#hash", "tab\there"), ("unié—", "x" * 200_000), ("none", None),
]


def test_csv_roundtrip(spark):
    df = spark.createDataFrame(AWKWARD, S.TICKETS)
    path = work_path(spark, "csv")
    S.write_csv(df, path)
    # an empty cell reads as a missing text
    want = df.withColumn("body", F.nullif("body", F.lit("")))
    assert sorted(map(str, S.read_tickets_csv(spark, path).collect())) == sorted(
        map(str, want.collect()))


def test_csv_writes_nested_values_as_json(spark):
    df = spark.createDataFrame([(["a", "b"], "t")], "`labels-mapped` array<string>, title string")
    path = work_path(spark, "csv")
    S.write_csv(df, path, ["title", "labels-mapped"])
    back = S.read_tickets_csv(spark, path, S.text_schema("title", "labels-mapped"))
    assert back.first()["labels-mapped"] == '["a","b"]'


def test_require_columns(spark):
    df = spark.createDataFrame([("x",)], "title string")
    assert S.require_columns(df, ["title"]) is df
    with pytest.raises(ValueError, match=r"missing columns: \['body', 'labels'\]"):
        S.require_columns(df, ["title", "labels", "body"])
    with pytest.raises(ValueError, match="body, title"):
        S.require_columns(df, ["title", "body"], list_all=True)


def test_limit_and_pick(spark):
    df = spark.range(20).withColumn("instruction", F.lit("t")).withColumn("last", F.lit("c"))
    assert [r["id"] for r in S.limit_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert S.limit_rows(df, None, "id") is df
    assert S.pick_column(df, ["instruction", "utterance"]) == "instruction"
    assert S.intent_frame(df).columns == ["text", "intent"]
    assert S.intent_frame(df).first()["intent"] == "c"
    with pytest.raises(ValueError):
        S.pick_column(df, ["utterance"])


def test_decode_label_id(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "i int")
    assert [r["n"] for r in S.decode_label_id(df, "i", ["a", "b"], "n").collect()] == [
        "a", "b", None, None]


def entry(target, rows, when, **metrics):
    return (target, "kind", "path", rows, ["a"], metrics, "data", when)


def test_registry(spark):
    path = work_path(spark, "registry")
    assert G.read_registry(spark, path).count() == 0
    old = spark.createDataFrame(
        [entry("intent", 1, datetime(2024, 1, 1)), entry("priority", 2, datetime(2024, 1, 1))],
        G.REGISTRY)
    new = spark.createDataFrame(
        [entry("intent", 9, datetime(2024, 1, 1), accuracy=0.5)], G.REGISTRY)
    merged = {r["target"]: r["rows"] for r in G.upsert_registry(old, new).collect()}
    assert merged == {"intent": 9, "priority": 2}
    G.append_registry(old, path)
    G.append_registry(new.withColumn("updated_at", F.current_timestamp()), path)
    found = {r["target"]: r["metrics"] for r in G.read_registry(spark, path).collect()}
    assert found == {"intent": {"accuracy": 0.5}, "priority": {}}


def test_clean_metrics(spark):
    df = spark.createDataFrame([({"eval_f1": 0.123456, "epoch": 3.0, "eval_none": None},)],
                               "m map<string,double>")
    assert df.select(G.clean_metrics(F.col("m"))).first()[0] == {"f1": 0.1235}


def test_missing_model(spark):
    with pytest.raises(FileNotFoundError):
        G.load_model(spark, shared_dir(spark) + "/nothing-here")


def test_work_folder_comes_from_the_session(spark):
    assert work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    table, path = materialize(spark.range(5), "x")
    assert table.count() == 5
    remove_path(spark, path)


def test_written_tables_go_with_their_block(spark):
    with written(spark.range(5), "x") as table:
        assert table.count() == 5
        path = table.inputFiles()[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_partitions_are_an_argument(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    assert S.read_table(spark, path, partitions=5).rdd.getNumPartitions() == 5
    assert S.read_table(spark, path).count() == S.read_table(spark, path, partitions=5).count()
