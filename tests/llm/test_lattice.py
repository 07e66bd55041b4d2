import numpy as np
import pytest

from sparkdesk.llm import lattice
from tests.conftest import SMALL


def brute(rows, cosine=0.93):
    parent, count, groups = list(range(len(rows))), [0] * len(rows), {}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, label, v) in enumerate(rows):
        if i is None or label is None or not v or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and x.any():
            groups.setdefault((label, len(x)), []).append((k, x / np.linalg.norm(x)))
    for group in groups.values():
        x = np.array([v for _, v in group])
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                count[group[a][0]] += 1
                parent[root(group[a][0])] = root(group[b][0])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted(((r[0], count[k], least.get(root(k))) for k, r in enumerate(rows)), key=repr)


def mate(rng, v, cosine):
    y = rng.normal(size=len(v))
    y -= (y @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_lattice_points_are_nearest():
    short = lattice.shortest_vectors()
    assert len({tuple(v) for v in short}) == 240 and (np.square(short).sum(1) == 2).all()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 2
    points = lattice.nearest_e8(x)
    gap = np.square(x - points).sum(1)
    assert (gap <= 1 + 1e-9).all()  # the covering radius
    around = points[:, None] + short
    assert (np.square(x[:, None] - around).sum(2) >= gap[:, None] - 1e-9).all()


@pytest.mark.parametrize("cosine, least", [(0.932, 0.97), (0.96, 0.99), (0.99, 1.0)])
def test_recall_and_no_false_links(spark, cosine, least):
    rng, rows = np.random.default_rng(3), []
    for k in range(500):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        rows += [(2 * k, k % 3, v.tolist()), (2 * k + 1, k % 3, mate(rng, v, cosine).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.id: r.n_links for r in lattice.near_duplicates(df).collect()}
    want = {i: n for i, n, _ in brute(rows)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= least * sum(want.values())


def test_query(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    got = lattice.op4_embeddings(spark, SMALL)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == brute(rows)


def test_odd_cases(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=16).tolist()
    near = [x * 2 for x in v]
    rows = [
        (1, 0, v), (2, 0, near), (2, 0, near), (3, 1, v), (4, None, v), (5, 0, None), (6, 0, []),
        (7, 0, [0.0] * 16), (8, 0, [float("nan")] * 16), (9, 0, [float("inf")] + v[1:]),
        (10, 0, [None] + v[1:]), (11, 0, [1.0, 2.0]), (12, 0, [2.0, 4.0]), (None, 0, v), (13, 0, [-x for x in v]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    df = df.selectExpr("*", "vec_id AS rep", "label AS n", "embedding AS v", "vec_id AS id")
    got = lattice.near_duplicates(df).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(rows)
    assert {r.id for r in got if not r.kept} == {2, 12}
    assert lattice.near_duplicates(df.limit(0)).count() == 0
