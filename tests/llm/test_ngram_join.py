import collections
import random

import pytest

from sparkdesk.llm import ngram_join, shingles
from sparkdesk.llm.components import components
from tests.conftest import SMALL
from tests.llm.helpers import LONG, odd_documents, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n):
    w = words(lower(text))
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def brute(rows, n, of):
    sets = [shingle_set(t, n) for _, t in rows]
    holds, overlap, parent = collections.defaultdict(list), collections.Counter(), list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        for x in s:
            overlap.update((j, i) for j in holds[x])
            holds[x].append(i)
    for (a, b), o in overlap.items():
        if 100 * o >= of * (len(sets[a]) + len(sets[b]) - o):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(seed):
    """Chains of edits of texts of all sizes, some around one common passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage, rows = [rnd.choice(vocabulary) for _ in range(40)], []
    for k in range(45):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 7, 9, 12, 20, 50, 150, 400]))]
        text += passage if k % 3 == 0 else []
        for _ in range(rnd.randint(1, 8)):
            rows.append((len(rows) * 7 % 1009 + 1000, " \n".join(text)))
            i, r = rnd.randrange(len(text) + 1), rnd.random()
            text = text[:i] + ([rnd.choice(vocabulary)] if r < 0.6 else []) + text[i + (r > 0.3) :]
    return [*rows, (1, None), (2, ""), (3, " \n\t"), (None, rows[0][1]), rows[5], (None, None)]


@pytest.mark.parametrize("n, of", [(4, 85), (5, 80), (2, 55), (3, 70), (1, 80), (2, 30)])
def test_components_equal_brute_force(spark, n, of):
    """Also at low similarities, where the rarest parts find what the stars leave."""
    rows = edited(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, n=n, of=of)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, n, of)


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.op2_ngram_join(spark, SMALL).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, 85)


def test_shingles_cross_segments(monkeypatch):
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    texts = ["A b\tC d e f " * 9, "x" * 300 + " y z", "", "é ü ß " * 30, LONG[:5000], "one two"]
    for n in (1, 4, 5):
        found = shingles.shingle_sets([t.encode() for t in texts], n)
        assert [len(f) for f in found] == [len(shingle_set(t, n)) for t in texts]
    assert (shingles.shingle_sets([b"A b c d"], 4)[0] == shingles.shingle_sets([b" a  B c\nd"], 4)[0]).all()


def test_every_similar_pair_files_a_common_part():
    import numpy as np

    rng = np.random.default_rng(1)
    for of in (80, 85, 60):
        filing = ngram_join.Filing(of)
        for _ in range(1500):
            size = int(rng.integers(1, 90))
            one = rng.integers(0, 1 << 63, size, np.uint64)
            gone = int(rng.integers(0, size * (100 - of) // 100 + 1))
            other = np.concatenate([one[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 5)), np.uint64)])
            one, other = np.unique(one), np.unique(other)
            overlap = len(np.intersect1d(one, other))
            if 100 * overlap >= of * (len(one) + len(other) - overlap):
                assert set(filing.parts(one)) & set(filing.parts(other))


def test_keep_one_and_odd_cases(spark):
    docs = odd_documents(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((repr((r.doc_id, (r.text or "")[:3])) for r in kept.collect()))
    want = [(1, "One"), (3, ""), (4, ""), (5, " \n\t"), (6, "lor"), (None, "no "), (None, ""), (7, "xxx")]
    assert got == sorted(map(repr, want))
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(500, 540)] + [(7, 3), (3, 7), (9, 9)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {3: 3, 7: 3}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(count, size, most, seed):
    """Copies of one text with 1 to ``most`` words changed."""
    rnd = random.Random(seed)
    base, rows = [f"w{i}" for i in range(size)], []
    for k in range(count):
        text = list(base)
        for i in rnd.sample(range(size), rnd.randint(1, most)):
            text[i] = f"x{rnd.randrange(10**6)}"
        rows.append((k + size * 1000, " ".join(text)))
    return rows


@pytest.mark.parametrize("n, of", [(4, 85), (3, 70), (2, 30)])
def test_pairs_are_met_about_once(spark, n, of):
    """All links are among the pairs met, and a pair doesn't stand there for every part it shares."""
    rows = [r for r in edited(n) if r[0] and r[1]]
    for size in (60, 64, 90, 230, 300):
        rows += near_copies(40, size, 5, size)
    docs = spark.createDataFrame(rows, "id long, text string").dropDuplicates(["id"])
    filed = ngram_join.file_documents(docs, n, of).join(docs, "id").where("node IS NOT NULL").cache()
    named = filed.dropDuplicates(["node"])
    every = ngram_join.every_part(named, n, of)
    placed = named.selectExpr("node", "node AS component")
    met = ngram_join._across(ngram_join._rarest(every), placed, named.select("node", "size", "sketch"), of)
    met = [tuple(r) for r in met.collect()]
    sets = {r.node: shingle_set(r.text, n) for r in named.collect()}
    nodes, links = sorted(sets), set()
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            overlap = len(sets[a] & sets[b])
            if 100 * overlap >= of * (len(sets[a]) + len(sets[b]) - overlap):
                links.add((a, b))
    assert links and links <= set(met)
    assert len(met) <= 1.5 * len(set(met))


def test_few_pairs_of_a_group_are_compared(spark, monkeypatch):
    """What belongs together joins before all pairs across components are compared."""
    counted, write = collections.Counter(), ngram_join.Steps.write

    def counting(steps, df, tag):
        table = write(steps, df, tag)
        counted[tag] += table.count() if tag in ("stars", "centres", "rest") else 0
        return table

    monkeypatch.setattr(ngram_join.Steps, "write", counting)
    rows = near_copies(300, 200, 4, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, n=4, of=85)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, 85)
    assert sum(counted.values()) <= 10 * len(rows)


def test_sketches_never_differ_more_than_sets():
    """Also after folding to the width of a smaller set's sketch."""
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (1, 31, 33, 64, 100, 1000):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for less, more in ((0, 0), (size // 5, 0), (0, size // 4), (size // 6, size // 6)):
            other = np.unique(np.concatenate([base[less:], rng.integers(0, 1 << 63, more, np.uint64)]))
            a, b = sorted((ngram_join.sketch(np.unique(base)), ngram_join.sketch(other)), key=len)
            while len(b) > len(a):
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(base, other))
