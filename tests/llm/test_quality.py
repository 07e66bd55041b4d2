import collections
import math
import re

import numpy as np
import pytest

from sparkdesk.llm import quality_rules, rule_ensemble, toxicity
from sparkdesk.llm.stats import text_stats
from tests.conftest import SMALL
from tests.llm.helpers import odd_documents, words

MIDDLE = SMALL.replace("0.001", "0.01")


def stats(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 5))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_stats_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [None, "", "a b c d e a b c d e", "x " * 300, "a b c d", "é ü # é ü # é ü #\n\n \né ü #\n#", "a\tb\x0bc\x1cd e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r[0]: tuple(r)[1:] for r in text_stats(docs).select("id", *columns).collect()}
    assert got == {i: stats(t) for i, t in enumerate(texts)}


def em(patterns, count, rounds):
    """The estimate in numpy."""
    votes = np.array([v for v, _ in patterns])
    n = np.array([float(c) for _, c in patterns])
    belief = np.where((votes == 0).any(1), 0.1, 0.9)
    right, wrong = quality_rules.PRIOR_SEEN
    for r in range(rounds + 1):
        if r:
            odds = math.log(share) - math.log1p(-share)
            odds = odds + np.where(votes == 0, np.log(g) - np.log(b), 0).sum(1)
            odds = odds + np.where(votes == 1, np.log1p(-g) - np.log1p(-b), 0).sum(1)
            belief = 1 / (1 + np.exp(-odds))
        good, bad = n * belief, n * (1 - belief)
        share = (good.sum() + 1) / (n.sum() + 2)
        said = [(votes == v) for v in (0, 1)]
        g = (good @ said[0] + wrong) / (good @ said[0] + good @ said[1] + wrong + right)
        b = (bad @ said[0] + right) / (bad @ said[0] + bad @ said[1] + wrong + right)
    return share, g, b


def test_em_equals_numpy(spark):
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.8
    votes = np.where(rng.random((5000, 4)) < 0.3, -1, (rng.random((5000, 4)) < np.where(truth[:, None], 0.95, 0.3)).astype(int))
    patterns = sorted(collections.Counter(map(tuple, votes.tolist())).items())
    df = spark.createDataFrame([(list(v), c) for v, c in patterns], "votes array<int>, n long")
    got = quality_rules.estimate(df, 4, 20).first()
    share, g, b = em(patterns, 4, 20)
    assert abs(got.share - share) < 1e-9
    assert np.allclose(got.on_good, g) and np.allclose(got.on_bad, b)
    assert abs(share - 0.8) < 0.05 and (g < 0.15).all() and (b > 0.5).all()


def test_rules_find_junk_and_keep_prose(spark):
    rows = quality_rules.op5_quality_rules(spark, MIDDLE).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    kept = {q: [r.kept for r in rows if quality.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(kept[0]) < 0.1 and np.mean(kept[1]) > 0.95
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_odd_cases(spark):
    docs = odd_documents(spark)
    got = quality_rules.judge_quality(docs).collect()
    assert len(got) == docs.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    assert quality_rules.judge_quality(docs.limit(0)).count() == 0


def auc(rows, truth):
    score = np.array([r.score for r in rows])
    return toxicity._ranking(score, np.array([truth[r.doc_id] for r in rows]))


@pytest.mark.parametrize(
    "query, label, part, rest", [("op6", "quality", 3, 1), ("op7", "toxic", 4, 2)]
)
def test_classifiers_on_held_out_rows(spark, query, label, part, rest):
    import zlib

    run = {"op6": rule_ensemble.op6_rule_ensemble, "op7": toxicity.op7_toxicity}[query]
    rows = run(spark, MIDDLE).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    least = {"op6": 0.5, "op7": 0.3}[query]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % part == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert auc(held, truth) > {"op6": 0.97, "op7": 0.75}[query]


def test_toxic_words_in_many_contexts(spark):
    """With enough labels, toxic texts of any length are told from clean ones."""
    rng = np.random.default_rng(6)
    clean = ["".join(rng.choice(list("etaoinsr"), 5)) for _ in range(400)]

    def text(bad):
        w = rng.choice(clean, int(rng.integers(20, 300))).tolist()
        for _ in range(bad):
            w[int(rng.integers(len(w)))] = str(rng.choice(["scoundrel", "blackguard", "miscreant"]))
        return " ".join(w)

    toxic, ordinary = [text(4) for _ in range(150)], [text(0) for _ in range(300)]
    model = toxicity.train(toxic[:100], ordinary[:200], 0.3)
    rows = [(i, t) for i, t in enumerate(toxic[100:] + ordinary[200:])]
    scored = toxicity.add_score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    y = np.array([r.doc_id < 50 for r in scored])
    p = np.array([r.score >= 0.3 for r in scored])
    assert p[y].mean() > 0.95 and p[~y].mean() < 0.05


def test_toxic_words_that_ordinary_texts_hold_too():
    """Rarer toxic words count beside frequent ones, also if a few ordinary texts hold their parts."""
    rng = np.random.default_rng(8)
    clean = ["".join(rng.choice(list("etaoinsr"), 5)) for _ in range(400)]
    frequent = ["scoundrel", "blackguard", "miscreant"]
    rare = ["xulquamp" + end for end in ("ba", "ke", "di", "vo", "zu")]

    def text(bad, n):
        w = rng.choice(clean, 60).tolist()
        for place in rng.choice(60, n, replace=False):
            w[place] = str(rng.choice(bad))
        return " ".join(w)

    toxic = [text(rare if i % 4 == 0 else frequent, 4) for i in range(240)]
    ordinary = [text(rare if i % 50 == 0 else clean, 1) for i in range(400)]
    picked = set(toxicity._distinctive(toxic[:120], ordinary[:300]))
    assert picked == {*frequent, *rare}
    model = toxicity.train(toxic[:180], ordinary[:300], 0.3)
    by = model.compressors()

    def caught(text):
        return np.dot(toxicity.features(toxicity.gains(text, *by), model.gain), model.weights) >= np.log(0.3 / 0.7)

    assert np.mean([caught(t) for t in toxic[180::4]]) > 0.9
    assert np.mean([caught(t) for t in ordinary[300:]]) < 0.1


def test_every_picked_word_is_in_the_dictionary():
    """Also words that stand only in the first of the toxic texts."""
    rng = np.random.default_rng(3)
    clean = ["".join(rng.choice(list("etaoinsr"), 5)) for _ in range(200)]
    early, late = [[f"{a}{'xqzjvwk'[i % 7] * 4}{i}" for i in range(3)] for a in ("gub", "pylk")]
    toxic = [" ".join(rng.permutation([*(early if i < 40 else late * 6), *rng.choice(clean, 30)])) for i in range(120)]
    ordinary = [" ".join(rng.choice(clean, 60)) for _ in range(100)]
    words_of = set(toxicity.train(toxic, ordinary, 0.3).toxic.decode().split(" "))
    assert {*early, *late} <= words_of


def test_gains_read_whole_texts():
    sizes = []
    toxicity.gains("word " * 40_000, lambda w: sizes.append(len(w)) or b"", lambda w: b"")
    assert sum(sizes) >= 200_000 and max(sizes) == toxicity.LENGTH


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 0, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (1, 1, 1)]])
def test_classifiers_odd_cases(spark, labels):
    docs = odd_documents(spark)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.add_score(docs, toxicity.learn(docs.select("doc_id", "text"), table), out="toxic_score")
    assert scored.columns == [*docs.columns, "toxic_score"] and scored.count() == docs.count()
    assert all(0 <= r.toxic_score <= 1 for r in scored.collect())
    rated = rule_ensemble.score_quality(docs, table).collect()
    assert len(rated) == docs.count() and all(0 <= r.score <= 1 for r in rated)
    assert rule_ensemble.score_quality(docs.limit(0), table).count() == 0
    assert toxicity.drop_toxic(docs.limit(0), toxicity.Model()).count() == 0


def test_compiled_score_equals_its_rules(spark):
    import random

    rnd = random.Random(1)
    rules = [((("a", -math.inf, 0.5),), 1.5), ((("a", 0.2, math.inf), ("b", 0.1, 0.9)), -2.0)]
    model = rule_ensemble.Ensemble(0.25, rules)
    rows = [(rnd.random(), rnd.random()) for _ in range(50)]
    for a, b, s in spark.createDataFrame(rows, "a double, b double").select("a", "b", model.score()).collect():
        z = 0.25 + 1.5 * (a <= 0.5) - 2.0 * (a > 0.2 and 0.1 < b <= 0.9)
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-12


def test_word_pattern_matches_words():
    assert re.compile(r"[^\x20\x09-\x0D]+").findall("a\x1cb c d\x0be") == ["a\x1cb", "c d", "e"]
