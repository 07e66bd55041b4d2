"""Exact top-k against a plain walk over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdesk.llm import top_k
from tests.llm.helpers import collected

TENTH = "id % 10 = 0"


def brute(rows, k, every=10, scale=64):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for a, (q, x) in enumerate(kept):
        if q % every:
            continue
        scored = [(-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(kept) if a != b]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("blocks", [(4096, 65_536, 2048, 8192), (7, 16, 16, 5)])
def test_matches_all_pairs(spark, monkeypatch, blocks):
    for name, size in zip(("QUERY_ROWS", "CANDIDATE_ROWS", "LEAST_ROWS", "CHUNK"), blocks):
        monkeypatch.setattr(top_k, name, size)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies tie
    rows += [(300 + i, np.where(np.arange(12) == i % 12, 0.5, 0.0).tolist()) for i in range(40)]
    got = collected(top_k.top_k(frame(spark, rows, "double"), TENTH, k=7))
    assert got == brute(rows, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (10, [-1.0, 2.0, 3.0]), (20, []), (-10, [0.0, 0.0]),
        (1, [0.25]), (1, [0.25]), (2, None), (None, [1.0]), (3, [nan, 1.0]), (4, [inf]),
        (5, [1.0, None]), (30, [1e30]), (40, [3e5, -3e5]),
    ]
    got = collected(top_k.top_k(frame(spark, rows, "double"), TENTH, k=4))
    assert got == brute([r for r in rows if r != (30, [1e30])], 4)


def test_wide_sparse_vectors(spark):
    """Postings of few rows are scattered by place; scores beyond 32 bits stay exact."""
    rng, rows = np.random.default_rng(2), []
    for i in range(60):
        v = np.zeros(300)
        v[rng.integers(0, 300, 6)] = rng.integers(-2000, 2000, 6)
        rows.append((i, v.tolist()))
    got = collected(top_k.top_k(frame(spark, rows, "double"), TENTH, k=5, scale=1000))
    assert got == brute(rows, 5, scale=1000)


def test_clashing_names_and_empty(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(25)]
    df = frame(spark, rows)
    for c in ("row", "id", "weights", "block", "query_block", "rank", "score", "v"):
        df = df.withColumn(c, F.lit("x"))
    assert collected(top_k.top_k(df, TENTH, k=3)) == brute(rows, 3)
    assert collected(top_k.top_k(df.where("false"), TENTH)) == []
