from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdesk.operators.features import TextAndUrgency, Tfidf
from sparkdesk.plans import scoring as SC
from sparkdesk.plans import solver as SV
from sparkdesk.plans import training as TR
from sparkdesk import session as S
from sparkdesk.session import shared_dir, work_path, written
from sparkdesk.sources.registry import read_registry
from sparkdesk.streaming import jobs

TOPICS = {
    "get_refund": "money back refund charged invoice twice",
    "cancel_order": "cancel order shipment parcel delivery",
    "recover_password": "password login reset account locked",
}
SEVERITY = {"get_refund": "high", "cancel_order": "low", "recover_password": "critical"}


@pytest.fixture(scope="module")
def raw(spark):
    rows = []
    for i in range(120):
        topic = list(TOPICS)[i % 3]
        words = TOPICS[topic].split()
        body = " ".join(words[(i + j) % len(words)] for j in range(4)) + f" <b>case{i % 5}</b>"
        labels = [topic.split("_")[1]] + (["always"]) + (["urgent"] if i % 4 == 0 else [])
        rows.append((i, words[i % len(words)], body, str(labels), SEVERITY[topic], topic))
    return spark.createDataFrame(
        rows,
        "id long, title string, body string, `labels-mapped` string, priority string, intent string",
    ).withColumn("text", F.concat_ws(" ", "title", "body"))


@pytest.fixture(scope="module")
def trained(spark, raw):
    out = work_path(spark, "models")
    entries = TR.train_all(spark, {t: raw for t in TR.LOADERS}, out)
    return out, {r["target"]: r for r in entries.collect()}, SC.TicketModels.load(spark, out)


def test_train_all_registers_every_target(spark, trained):
    out, entries, models = trained
    assert set(entries) == {"category", "priority", "intent"}
    assert entries["intent"]["labels"] == sorted(TOPICS)
    assert entries["intent"]["metrics"]["accuracy"] == 1.0
    assert entries["category"]["rows"] == 120
    assert set(entries["category"]["metrics"]) == {"micro_f1", "macro_f1"}
    assert read_registry(spark, f"{out}/registry").count() == 3
    # the label of every row has a constant score
    assert models.category.constant == {"always": 1.0}


def test_limit_trains_on_the_first_rows(spark, raw):
    out = work_path(spark, "models")
    rows = TR.train_all(spark, {"intent": raw}, out, limit=60).first()
    assert rows["rows"] == 60


def test_predictions_keep_the_contract(raw, trained):
    models = trained[2]
    tickets = raw.select("id", "title", "body")
    found = SC.predict_batch(tickets, models)
    rows = found.collect()
    assert len(rows) == 120 and found.columns == ["id", "title", "body", "category", "priority",
                                                  "intent"]
    for r in rows:
        assert 1 <= len(r["category"]) <= 3
        scores = [c["confidence"] for c in r["category"]]
        assert scores == sorted(scores, reverse=True) and 0 <= min(scores) and max(scores) <= 1
        assert r["priority"]["label"] in ("critical", "high", "low")
        assert r["intent"]["label"] == list(TOPICS)[r["id"] % 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "json" not in plan.lower()
    assert plan.count("ArrowEvalPython") == 1  # one product for all models and labels


def test_probabilities_sum_to_one(raw, trained):
    p = SC.probabilities(trained[2].intent, raw, "s").select(
        F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert all(abs(r["t"] - 1) < 1e-9 for r in p.collect())


def test_saved_model_predicts_the_same(spark, raw, trained):
    path = work_path(spark, "again")
    trained[2].category.save(path)
    again = TR.MultiLabelModel.load(spark, path)
    def rows(m):
        return [(r["id"], r["p"]) for r in m.predict(raw).select("id", "p").orderBy("id").collect()]
    assert rows(again) == rows(trained[2].category)


def test_one_ticket_and_missing_texts(spark, trained):
    df = spark.createDataFrame([("App is crashing", ""), (None, None)], "title string, body string")
    assert SC.predict_batch(df, trained[2]).count() == 2
    with pytest.raises(ValueError, match="body, title"):
        SC.predict_batch(df.drop("body"), trained[2])


def test_score_table(spark, raw, trained):
    src, dst, bad = (work_path(spark, t) for t in ("src", "dst", "bad"))
    tickets = raw.select("title", "body").union(
        spark.createDataFrame([("  ", "b")], "title string, body string"))
    from sparkdesk.sources.tables import write_csv
    write_csv(tickets, src)
    assert SC.score_table(spark, src, dst, trained[2]).count() == 121
    out = SC.score_table(spark, src, dst + "2", trained[2], rejected=bad)
    assert out.count() == 120
    row = out.first()
    assert set(out.columns) >= {"category", "priority_confidence", "prediction_json"}
    assert row["prediction_json"].startswith('{"category":[{"label":')


def test_flatten_and_json(raw, trained):
    found = SC.attach_run(SC.predict_batch(raw.select("title", "body"), trained[2]), 50.0, 20)
    assert SC.with_json(found).columns == ["title", "body", "model_backend", "latency_ms",
                                           "prediction"]
    assert found.first()["latency_ms"] == 2.5


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
@pytest.mark.parametrize("label", ["label", "two", "labels"])
def test_gradients_tell_a_whole_fit_from_a_stopped_one(raw, loss, label):
    docs = TR.load_intent(raw, keep=["id", "labels-mapped"])
    parsed = F.split(F.regexp_replace("labels-mapped", r"[\[\]' ]", ""), ",")
    docs = docs.withColumn("labels", parsed).withColumn("two", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    fit = TR.fit_multi_label if label == "labels" else TR.fit_single_label
    of = "labels" if label == "labels" else "label"
    features = Tfidf(min_df=1, max_features=200).fit(docs)

    def worst(**options):
        objective = SV.Objective(loss, **options)
        model = fit(docs, features=features, objective=objective, **{of: label})
        rows = TR.fit_gradients(model, docs, label, objective).collect()
        known = [x for x in model.labels if x != "always"][1 if label == "two" else 0:]
        assert sorted(r["label"] for r in rows) == sorted(known)
        return max(r["gradient"] / r["total"] for r in rows)

    assert worst(tolerance=1e-6) <= 2e-6
    with pytest.warns(UserWarning, match="tolerance"):
        assert worst(max_iter=2, tolerance=1e-6) > 1e-3


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) * [1.0, 0.2, 3.0]
    y = (x @ [1.0, -4.0, 0.5] + rng.normal(size=80) > 0.3).astype(float)
    weights = TR.single_label_weights(80, [int((y == 0).sum()), int((y == 1).sum())], True)
    w = weights[y.astype(int), 0]
    df = instances(spark, x, y[:, None])
    objective = SV.Objective("logistic", tolerance=1e-9)
    found, intercept = SV.solve(df, 3, weights, np.array([80.0]), objective)
    z = np.hstack([x, np.ones((80, 1))])
    beta = np.zeros(4)
    penalty = np.diag([1.0, 1, 1, 0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(
            (z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (p - y)) + penalty @ beta)
    assert np.allclose([*found[0], intercept[0]], beta, atol=1e-6)


def instances(spark, x, hot):
    """Rows as sparse structs with their 0/1 labels."""
    rows = [
        ([int(v) for v in h], (0, x.shape[1], np.flatnonzero(a).tolist(), a[np.flatnonzero(a)].tolist()))
        for a, h in zip(x, hot)
    ]
    kind = "hot array<int>, features struct<type:int,size:int,indices:array<int>,values:array<double>>"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge", "softmax"])
def test_objectives_are_solved(spark, kind):
    """The gradient vanishes by finite differences of a plainly written objective."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) * (rng.random((60, 4)) < 0.6)
    cls = (x @ rng.normal(size=(4, 3)) + rng.normal(size=(60, 3))).argmax(1)
    hot = np.eye(3)[cls]
    weights = np.array([[1.0, 0.5, 2.0], [1.5, 2.0, 0.7]])
    loss = "logistic" if kind == "softmax" else kind
    c, b = SV.solve(
        instances(spark, x, hot), 4, weights, np.array([60.0] * (1 if kind == "softmax" else 3)),
        SV.Objective(loss, tolerance=1e-8), coupled=kind == "softmax",
    )

    def value(c, b):
        m = x @ c.T + b
        if kind == "softmax":
            w = (hot * weights[1]).sum(1)
            return -(w * np.log((np.exp(m) * hot).sum(1) / np.exp(m).sum(1))).sum() + (c**2).sum() / 2
        w, z = np.where(hot == 1, weights[1], weights[0]), m * (2 * hot - 1)
        if kind == "logistic":
            return (w * np.log(1 + np.exp(-z))).sum() + (c**2).sum() / 2
        return (w * np.maximum(0, 1 - z) ** 2).sum() + ((c**2).sum() + (b**2).sum()) / 2

    h = 1e-5
    for k in range(3):
        for j in range(5):
            dc, db = np.zeros((3, 4)), np.zeros(3)
            if j < 4:
                dc[k, j] = h
            else:
                db[k] = h
            assert abs(value(c + dc, b + db) - value(c - dc, b - db)) / (2 * h) < 1e-4


def test_badly_scaled_problems_end_apart(spark):
    """Curvatures from 1 to 10^6 cost few passes, and a problem that has ended costs none."""
    bends = np.stack([np.logspace(0, 6, 200), np.ones(200)])
    goal, asked = np.ones((2, 200)), []

    def evaluate(x, open_):
        asked.append(len(open_))
        miss = x - goal[open_]
        skewed = bends[open_] * (miss + 0.2 * miss**3)
        return (bends[open_] * (miss**2 / 2 + 0.05 * miss**4)).sum(1), skewed

    found, norms, _ = SV.minimise(evaluate, np.zeros((2, 200)), bends, np.array([1e-3, 1.0]), 500)
    assert np.allclose(found[0], goal[0], atol=1e-3) and (norms <= [1e-3, 1.0]).all()
    assert len(asked) <= 30 and asked[-1] == 1


def test_passes_leave_no_shuffle_files(spark):
    """Many passes over the instances need no more shuffle space than one."""
    x = np.random.default_rng(1).normal(size=(40, 30_000))
    df = instances(spark, x, (x[:, :1] > 0).astype(int))
    blocks = SV.packed(df).localCheckpoint()
    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()

    def held():
        return sum(1 for b in jvm.diskBlockManager().getAllFiles().mkString("\n").split("\n")
                   if "shuffle_" in b.rsplit("/", 1)[-1] and b.endswith(".data"))

    before = held()
    for _ in range(5):
        SV._summed(blocks, "logistic", np.zeros((1, 30_001)), np.ones((2, 1)), np.arange(1))
    assert held() <= before


def test_terms_are_gone_while_a_model_is_fitted(spark, raw, monkeypatch):
    """Only the vectors stay for the solver; targets are trained one after the other."""
    def tables():
        found = Path(f"{shared_dir(spark)}/sparkdesk".removeprefix("file:"))
        return {f.name for f in found.iterdir()}

    def looked(*args, **options):
        kept.append({f.rsplit("-", 1)[0] for f in tables() - before})
        return solve(*args, **options)

    loaded = TR.load_intent(raw, keep=["id"])
    with written(loaded, "other"):
        before, kept, solve = tables(), [], TR.solve
        monkeypatch.setattr(TR, "solve", looked)
        TR.fit_single_label(loaded, features=Tfidf(min_df=1, max_features=30))
        TR.train_target("intent", loaded, work_path(spark, "models"), "id")
    assert kept == [{"features"}, {"vectors"}]


def test_tables_of_a_fit_hold_words_not_terms(spark, raw, monkeypatch):
    """What a fit stores of the texts is their words: no n-grams, no second copy of the text."""
    def looked(df, tag):
        kept.setdefault(tag, []).append(set(df.columns))
        return make(df, tag)

    kept, make = {}, S.materialize
    monkeypatch.setattr(S, "materialize", looked)
    monkeypatch.setattr(TR, "materialize", looked)
    loaded = TR.load_intent(raw, keep=["id"])
    TR.fit_single_label(loaded, features=Tfidf(min_df=1, max_features=30))
    TR.train_target("intent", loaded, work_path(spark, "models"), "id")
    assert kept["words"] == [{"hot", "features_terms_words"}]
    assert kept["split"] == [{"id", "label", "is_test", "features_terms_words"}]
    assert "terms" not in kept and "instances" not in kept


def test_many_rows_begin_near_their_solution(spark, monkeypatch):
    """A descent over an eighth of the blocks gives the start; the end is that over all rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1600, 12)) * np.logspace(0, -1.5, 12)
    y = (x[:, :2] + 0.3 * rng.normal(size=(1600, 2)) > 0).astype(int)
    df = instances(spark, x, y).repartition(4).localCheckpoint()
    weights, totals, full = np.ones((2, 2)), np.full(2, 1600.0), []
    summed = SV._summed

    def looked(blocks, kind, held, *args, **options):
        found = summed(blocks, kind, held, *args, **options)
        full.append(blocks.select(F.sum(F.octet_length("sizes"))).first()[0] // 4 == 1600)
        return found

    monkeypatch.setattr(SV, "_summed", looked)
    monkeypatch.setattr(SV, "BLOCK_ROWS", 20)
    close = SV.Objective(tolerance=1e-7)
    plain = SV.solve(df, 12, weights, totals, close)
    passes = sum(full)
    full.clear()
    monkeypatch.setattr(SV, "PART_ROWS", 1000)
    found = SV.solve(df, 12, weights, totals, close)
    assert sum(full) < passes and not all(full)
    assert all(np.allclose(a, b, atol=0.02) for a, b in zip(found, plain))


def test_blocks_hold_few_numbers_and_short_indices(spark):
    """Blocks stay small objects, with indices of two bytes where the width allows it."""
    x = np.random.default_rng(1).normal(size=(40, 30_000))
    df = instances(spark, x, (x[:, :1] > 0).astype(int))
    for width, size in ((30_000, 2), (None, 4)):
        rows = SV.packed(df, width).select(
            F.octet_length("indices").alias("i"), F.octet_length("values").alias("v")
        ).collect()
        assert all(r["i"] == r["v"] // 8 * size and r["v"] <= 8 * SV.ENTRIES for r in rows)
        assert sum(r["v"] for r in rows) == 8 * 40 * 30_000


def test_rows_are_worked_on_in_pieces(spark):
    """Sums don't depend on how many rows are worked on at once."""
    sizes = np.array([0, 3, 0, 2, 9, 1, 0], np.int32)
    found = list(SV.row_pieces(sizes, 4))
    assert [r.stop for r, _ in found][-1] == len(sizes) and [e.stop for _, e in found][-1] == sizes.sum()
    assert all(e.stop - e.start == sizes[r].sum() for r, e in found)
    assert all(sizes[r].sum() <= 4 or r.stop - r.start == 1 for r, _ in found)


def test_early_stop_warns(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = instances(spark, x, (x[:, :1] > 0).astype(int))
    with pytest.warns(UserWarning, match="above the tolerance"):
        SV.solve(df, 3, np.ones((2, 1)), np.array([40.0]), SV.Objective(max_iter=1))


def test_comparison(raw):
    two = TR.load_intent(raw.where("intent <> 'get_refund'"), keep=["id"])
    table = TR.compare_models(two, {"logreg": TR.logistic(), "svm": TR.linear_svm()}, "id")
    assert {r["model"]: r["accuracy"] for r in table.collect()} == {"logreg": 1.0, "svm": 1.0}


def test_comparison_of_texts(raw):
    loaded = TR.load_intent(raw, keep=["id", "title", "body"])
    table = TR.compare_texts(loaded, ["title", "text"], {"logreg": TR.logistic()}, "id")
    rows = {r["text"]: r["accuracy"] for r in table.collect()}
    assert set(rows) == {"title", "text"} and rows["text"] == 1.0


def test_svm_on_text_and_urgency_roundtrip(spark, raw):
    loaded = TR.load_intent(raw, keep=["id"]).withColumn(
        "text", F.concat("text", F.when(F.col("id") % 2 == 0, " crash now").otherwise("")))
    loaded = loaded.withColumn("label", F.when(F.col("id") % 2 == 0, "high").otherwise("low"))
    svm = TR.fit_linear_svm(loaded, "label", features=TextAndUrgency(min_df=1, max_features=30, sublinear=False))
    path = work_path(spark, "svm")
    svm.save(path)
    again = TR.OneVsRestModel.load(spark, path)
    rows = again.scores(svm.scores(loaded, "a"), "b").collect()
    assert all(r["a"] == r["b"] for r in rows) and len(rows) == 120
    assert TR.evaluate_single(again, loaded)["accuracy"] == 1.0


def test_two_class_svm_roundtrip(spark, raw):
    two = TR.load_intent(raw.where("intent <> 'get_refund'"), keep=["id"])
    svm = TR.fit_linear_svm(two, "label", features=Tfidf(min_df=1, max_features=30))
    assert (svm.coefficients[0] == -svm.coefficients[1]).all() and svm.coefficients[1].any()
    path = work_path(spark, "svm")
    svm.save(path)
    again = TR.OneVsRestModel.load(spark, path)
    assert isinstance(again, TR.OneVsRestModel)
    assert TR.evaluate_single(again, two)["accuracy"] == 1.0


def test_svm(raw):
    loaded = TR.load_intent(raw, keep=["id"])
    svm = TR.fit_linear_svm(loaded, "label", features=Tfidf(min_df=1, max_features=30))
    assert isinstance(svm, TR.OneVsRestModel)
    assert TR.evaluate_single(svm, loaded)["accuracy"] == 1.0
    p = SC.probabilities(svm, loaded, "s").select(
        F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert all(abs(r["t"] - 1) < 1e-9 for r in p.collect())


def test_shared_features_can_be_passed(raw):
    loaded = TR.load_intent(raw)
    features = Tfidf(min_df=1, max_features=30).fit(loaded)
    assert TR.fit_single_label(loaded, features=features).labels == sorted(TOPICS)
    with pytest.raises(ValueError, match="two classes"):
        TR.fit_single_label(loaded.where("label = 'get_refund'"))


def test_external_scorer(spark):
    def load():
        return lambda batch: np.stack([batch.sum(axis=1), -batch.sum(axis=1)], axis=1)
    df = spark.createDataFrame([([1.0, 2.0],), ([-4.0, 1.0],)], "f array<float>")
    got = df.select(SC.external_scorer(load, [2])(F.col("f"))).collect()
    assert [list(r[0]) for r in got] == [[3.0, -3.0], [-3.0, 3.0]]


def test_stream_equals_batch(spark, raw, trained):
    models = trained[2]
    src, out = work_path(spark, "in"), work_path(spark, "out")
    tickets = raw.select("id", "title", "body").union(
        spark.createDataFrame([(900, None, "x"), (901, " ", "x")],
                              "id long, title string, body string"))
    tickets.repartition(4).write.parquet(src)

    def rows(table):
        return sorted(map(str, spark.read.parquet(f"{out}/{table}").drop("batch_id").collect()))

    def run(score=lambda d: SC.predict_batch(d, models)):
        stream = jobs.read_stream(spark, src, tickets.schema)
        jobs.stream_score(stream, score, out, f"{out}/state").awaitTermination()

    run()
    batch = SC.predict_batch(raw.select("id", "title", "body"), models)
    want = sorted(map(str, batch.collect()))
    assert rows("scored") == want and len(rows("log")) == len(want)
    assert {r["reject_reason"] for r in spark.read.parquet(f"{out}/refused").collect()} == {
        "title missing", "title blank"}
    # a batch that breaks off half-way is run again, and nothing is repeated
    more = tickets.where("id in (0, 900)").withColumn("id", F.col("id") + 1000)
    more.write.mode("append").parquet(src)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(broken)
    run()
    run()
    ids = [r["id"] for r in spark.read.parquet(f"{out}/scored").select("id").collect()]
    assert sorted(ids) == [*range(120), 1000] and len(rows("log")) == 121
    assert len(rows("refused")) == 3
    log = spark.read.parquet(f"{out}/log")
    assert log.where("latency_ms IS NULL OR batch_id IS NULL").count() == 0


def test_stream_stats_equal_batch(spark):
    """Over two arrivals, with a restart between them; old batches go."""
    log = spark.range(90).select(
        F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("priority"),
        (F.col("id") / 100).alias("priority_conf"), (F.col("id") / 200).alias("intent_conf"),
        F.col("id").cast("double").alias("latency_ms"))
    src, table, state = (work_path(spark, t) for t in ("log", "table", "state"))
    for part in range(3):
        log.where(F.col("latency_ms") % 3 == part).write.mode("append").parquet(src)
        stream = jobs.read_stream(spark, src, log.schema)
        jobs.stream_stats(stream, table, state).awaitTermination()
    got = sorted(map(tuple, jobs.latest_stats(spark, table).collect()))
    want = sorted(map(tuple, jobs.running_stats(log).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want))
    assert spark.read.parquet(table).select("batch_id").distinct().count() == 2
