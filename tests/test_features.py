import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from sparkdesk.functions import tokens as K
from sparkdesk.functions.text import URGENT_WORDS
from sparkdesk.operators import features as FT
from sparkdesk.session import work_path

DOCS = [
    (0, "Error when the server crashes, server crashes again"),
    (1, "The printer prints nothing; printer offline"),
    (2, "Server offline and printer offline"),
    (3, ""),
    (4, "größe größe ok_1 a b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string")


def grams(text, stop, lo=1, hi=2):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
    return [" ".join(words[i:i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)]


def test_terms_match_plain_python(docs):
    stop = K.stop_words()
    got = {r[0]: r[1] for r in docs.select("id", K.terms(F.col("text"), stop, 1, 3)).collect()}
    assert got == {i: grams(t, stop, 1, 3) for i, t in DOCS}


def test_term_counts(docs):
    got = docs.select("id", K.term_counts(K.tokenize(F.col("text"))).alias("c")).collect()
    for r in got:
        want = Counter(re.findall(r"\b\w\w+\b", dict(DOCS)[r["id"]].lower()))
        assert {(x["term"], x["tf"]) for x in r["c"]} == set(want.items())


def test_stop_words():
    words = K.stop_words(["don't", "the", "i"])
    assert "don" in words and "the" in words and "nbsp" in words
    assert "i" not in words and "t" not in words
    assert len(K.DOMAIN_STOP_WORDS) == 65 and len(set(K.DOMAIN_STOP_WORDS)) == 64


def test_vocab_bounds(docs):
    listed = docs.select(K.tokenize(F.col("text")).alias("t"))
    def vocab(**bounds):
        return {r["term"]: (r["df"], r["cf"]) for r in FT.vocab_df(listed, "t", **bounds).collect()}
    assert vocab(min_df=2) == {"server": (2, 3), "the": (2, 2), "printer": (2, 3),
                               "offline": (2, 3)}
    assert vocab(min_df=0.4, max_df=0.9) == vocab(min_df=2)
    assert "größe" in vocab(min_df=1, max_df=1) and "the" not in vocab(min_df=1, max_df=1)
    top = FT.vocab_topk(FT.vocab_df(listed, "t", 1), 2)
    assert [r["term"] for r in top.collect()] == ["offline", "printer"]


@pytest.mark.parametrize("bounds", [(2, 1.0), (0.05, 0.5), (3, 40), (1, 1.0)])
@pytest.mark.parametrize("shipped", [64 << 20, 0])
def test_levels_equal_one_count(spark, monkeypatch, bounds, shipped):
    monkeypatch.setattr(FT, "SHIPPED_GRAMS", shipped)
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee ff gg"], k=rng.randrange(0, 25))),) for _ in range(80)]
    listed = spark.createDataFrame([*rows, (None,)], "text string").select(K.terms(F.col("text"), [], 1, 4).alias("t"))
    want = sorted(map(tuple, FT.vocab_df(listed, "t", *bounds).collect()))
    with FT.vocab_levels(listed, "t", 4, *bounds) as vocab:
        assert sorted(map(tuple, vocab.collect())) == want and len(want) > 5


def test_levels_are_made_of_single_words(spark):
    """Longer n-grams needn't be in the list, whose texts are read once."""
    rows = [("aa bb aa bb cc",), ("aa bb cc",), ("bb",), ("",), (None,)]
    texts = spark.createDataFrame(rows, "text string")
    single, all_ = (texts.select(K.terms(F.col("text"), [], 1, n).alias("t")) for n in (1, 3))
    want = sorted(map(tuple, FT.vocab_df(all_, "t", 2).collect()))
    with FT.vocab_levels(single, "t", 3, 2) as vocab:
        assert sorted(map(tuple, vocab.collect())) == want
    assert ("aa bb cc", 2, 2) in want and ("aa bb", 2, 3) in want


@pytest.mark.parametrize("sublinear", [True, False])
def test_tfidf_matches_plain_python(docs, sublinear):
    model = FT.Tfidf(min_df=1, max_features=100, sublinear=sublinear, words=["the"]).fit(docs)
    got = {(r["id"], r["term"]): r["value"] for r in FT.tfidf_long(model, docs, "id").collect()}
    counts = {i: Counter(grams(t, {"the"})) for i, t in DOCS}
    df = Counter(t for c in counts.values() for t in c)
    want = {}
    for i, c in counts.items():
        x = {t: (1 + math.log(n) if sublinear else n) * (math.log(6 / (1 + df[t])) + 1)
             for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        want.update({(i, t): v / norm for t, v in x.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_transform_is_narrow(docs):
    model = FT.Tfidf(min_df=1, max_features=50).fit(docs)
    plan = FT.tfidf_transform(model, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "json" not in plan.lower()


def test_text_and_urgency_pipeline(spark, docs):
    """The union is one pipeline that is saved, loaded and gives the same vectors."""
    rows = docs.union(spark.createDataFrame([(9, "urgent: server offline")], docs.schema))
    model = FT.TextAndUrgency(min_df=1, max_features=50).fit(rows)
    path = work_path(spark, "union")
    model.write().overwrite().save(path)
    got = {r["id"]: r["features"] for r in FT.tfidf_transform(PipelineModel.load(path), rows).collect()}
    text = FT.Tfidf(min_df=1, max_features=50).fit(rows)
    for r in FT.tfidf_transform(text, rows).collect():
        both, alone = got[r["id"]], r["features"]
        flag = [alone["size"]] if any(w in r["text"].lower() for w in URGENT_WORDS) else []
        assert both["size"] == alone["size"] + 1
        assert both["indices"] == alone["indices"] + flag
        assert both["values"] == pytest.approx(alone["values"] + [1.0] * len(flag))


def test_written_features_read_back_as_vectors(docs):
    model = FT.Tfidf(min_df=1, max_features=50).fit(docs)
    plain = FT.tfidf_transform(model, docs)
    want = {r["id"]: r["features"] for r in plain.collect()}
    with FT.written_vectors(plain, "test", "features") as table:
        for r in table.collect():
            assert isinstance(r["features"], SparseVector)
            assert r["features"].indices.tolist() == want[r["id"]]["indices"]
            assert r["features"].values.tolist() == want[r["id"]]["values"]


def test_tfidf_refuses_unbounded_or_empty(docs):
    with pytest.raises(ValueError, match="bounded"):
        FT.Tfidf(max_features=None)
    with pytest.raises(ValueError, match="no terms"):
        FT.Tfidf(min_df=99).fit(docs)


def test_label_features(spark):
    df = spark.createDataFrame(
        [(1, ["b", "a"]), (2, ["c"]), (3, [])], "id int, labels array<string>"
    )
    hot = {r["id"]: r["hot"] for r in FT.multi_hot(df, "labels").collect()}
    assert hot == {1: [1, 1, 0], 2: [0, 0, 1], 3: [0, 0, 0]}
    floats = FT.multi_hot(df, "labels", ["a", "z"], kind="float")
    assert dict(floats.dtypes)["hot"] == "array<float>"
    one = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "l string")
    assert {r["l"]: r["label_id"] for r in FT.label_index(one, "l").collect()} == {
        "a": 0, "b": 1, None: None}
    assert {r["l"]: r["weight"] for r in FT.class_weights(one, "l").collect()} == {
        "a": 1.5, "b": 0.75}


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 3), (1, 4)])
@pytest.mark.parametrize("most", [1 << 20, 3])
def test_grams_of_joined_words_equal_listed_terms(spark, monkeypatch, lo, hi, most):
    """N-grams counted from the words alone, by the batch, are those of the term lists."""
    monkeypatch.setattr(FT, "COUNTED_TERMS", most)
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["aa", "bb", "the", "dd", "ee ff"], k=rng.randrange(0, 15))),) for _ in range(50)]
    texts = spark.createDataFrame([*rows, (None,), ("",), ("the",)], "text string")
    extract = FT.TermExtractor(outputCol="t", lo=lo, hi=hi, words=["the"])
    want = sorted(map(tuple, FT.term_stats(extract.transform(texts), "t").collect()))
    words = extract.with_words(texts)
    got = FT.gram_stats(words, extract.words_col, lo, hi)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 3
    lists = [[r["t"] for r in extract.transform(df).select("t").collect()] for df in (texts, words.drop("text"))]
    assert lists[0] == lists[1]


def test_vocabulary_is_fitted_on_words_alone(docs):
    """The terms of a text are neither stored nor needed for a fit, only its words."""
    tfidf = FT.Tfidf(min_df=1, max_features=50)
    words = tfidf.extractor().with_words(docs).drop("text")
    model, whole = tfidf.fit(words), tfidf.fit(docs)
    assert model.terms == whole.terms
    got, want = (
        {r["id"]: r["features"] for r in FT.tfidf_transform(whole, df).collect()} for df in (words, docs)
    )
    assert got == want


def test_rare_grams_are_told_by_buckets(spark, monkeypatch):
    """The first terms are those of the whole count, though rare ones are not made as texts."""
    rng = random.Random(3)
    names = [f"w{i}" for i in range(300)]
    rows = [(" ".join(rng.choices(names, [1 / (i + 1) for i in range(300)], k=30)),) for _ in range(400)]
    words = spark.createDataFrame([*rows, (None,), ("",)], "w string").repartition(3).localCheckpoint()
    made, stats = [], FT.gram_stats

    def looked(*args):
        found = stats(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(FT, "gram_stats", looked)
    for lo, hi in ((1, 2), (2, 3)):
        for k, bounds in ((20, (2, 1.0)), (20, (2, 0.2)), (5000, (2, 1.0)), (1 << 21, (1, 1.0))):
            want = FT.vocab_topk(FT._bounded(stats(words, "w", lo, hi), *bounds, 402), k).collect()
            made.clear()
            monkeypatch.setattr(FT, "BUCKET_ROWS", 1)
            got = FT.frequent_grams(words, "w", lo, hi, k, *bounds, 402).to_pylist()
            assert [tuple(r.values()) for r in got] == [tuple(r) for r in want]
            assert k > 20 or made[0] < stats(words, "w", lo, hi).count() / (2 if hi == 2 else 1)


@pytest.mark.parametrize("most", [1, 40, 1 << 22])
def test_texts_are_split_in_pieces(monkeypatch, most):
    """The words of a batch are the same however many bytes are split at once."""
    monkeypatch.setattr(FT, "SPLIT_BYTES", most)
    rng = random.Random(4)
    words = ["aa", "b\u00e9e", "\u4e2d\u6587", "dd"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(200)]
    texts[3] = texts[77] = None
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["w"])
    found = list(FT._word_lists(iter([batch])))
    for lists in found:
        lists.validate(full=True)
    assert [x for lists in found for x in lists.to_pylist()] == [t.split(" ") if t else None for t in texts]
    assert len(found) == 1 or most < 1 << 22
