"""Periodic runs against a plain walk over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdesk.llm import periodic
from tests.conftest import SMALL
from tests.llm.helpers import collected, odd_documents, words


def brute_runs(w):
    """(start, length, period) by start and period."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            block = w[start : start + q]
            power = any(q % d == 0 and block == block[:d] * (q // d) for d in range(1, q))
            if length >= max(6, 4 * q) and not power:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_row(doc_id, text, plant=True):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), *top, digest(listing), digest(kept))


def samples():
    rng = random.Random(3)
    texts = ["", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "a a b " * 9 + "a a", "x " * 700]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 16, 31, 40]))]
            parts += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
        texts.append(" ".join(parts))
    a, b = "a", "b"  # Thue-Morse and Fibonacci words meet bad cases of hashes and of periods
    for _ in range(9):
        a, b = a + b, b + a
    f, g = "a", "ab"
    for _ in range(12):
        f, g = g, g + f
    return texts + [" ".join(a), " ".join(a[:64] * 5), " ".join(g), " ".join((g[:34] * 5)[:-3])]


def found_runs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = periodic.with_runs(df, periodic.find_runs(df), "runs").collect()
    return {r["doc_id"]: [(x["start"], x["length"], x["period"]) for x in r["runs"]] for r in rows}


@pytest.mark.parametrize("top", [256, 1, 2, 8])
def test_matches_walk(monkeypatch, top):
    """With narrow tiles every sample is cut into many."""
    texts = samples()
    for i, text in enumerate(texts):
        w = text.split()
        cut = [(lo, hi, s, w[s:e]) for lo, hi, s, e in _tiles(w, top, monkeypatch)]
        assert _solve(cut) == brute_runs(w), i


def _tiles(w, top, monkeypatch):
    monkeypatch.setattr(periodic, "TOP", top)
    return periodic.tiles(len(w))


def _solve(cut):
    """Tiles solved one by one, fragments joined by hand."""
    numbers, matches = {}, {}
    for low, high, start, part in cut:
        c = np.array([numbers.setdefault(x, len(numbers)) for x in part], np.int32)
        for q, first, end in periodic.fragments(c, low, high):
            for p, a, b in zip(q.tolist(), first.tolist(), end.tolist()):
                matches.setdefault(p, set()).update(range(start + a, start + b))
    out = []
    for q, places in matches.items():
        for a in sorted(p for p in places if p - 1 not in places):
            b = a
            while b in places:
                b += 1
            if b - a + q >= max(6, 4 * q):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_large_periods_over_many_tiles(spark):
    rng = random.Random(4)
    unit = [str(rng.randrange(50)) for _ in range(1500)]
    texts = [
        " ".join(["x", "y"] * 3 + unit * 9 + unit[:700] + ["z"]),
        " ".join(str(rng.randrange(9)) for _ in range(9000)) + " " + " ".join(unit[:5] * 4000),
        "lorem ipsum dolor sit amet " * 6000,
    ]
    got = found_runs(spark, texts)
    assert (6, 9 * 1500 + 700, 1500) in got[0] and (0, 6, 2) not in got[0]
    assert got[1][-1][1:] >= (20_000, 5) and got[2] == [(0, 30_000, 5)]
    assert got[0] == [r for r in brute_like(texts[0], [*range(1, 20), 1500])]


def brute_like(text, periods):
    w = text.split()
    out = []
    for q in periods:
        same = [x == y for x, y in zip(w, w[q:])] + [False]
        start = None
        for i, hit in enumerate(same):
            if hit and start is None:
                start = i
            elif not hit and start is not None:
                if i - start + q >= max(6, 4 * q) and not any(
                    q % d == 0 and w[start : start + q] == w[start : start + d] * (q // d) for d in range(1, q)
                ):
                    out.append((start, i - start + q, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query_on_table(spark):
    got = collected(periodic.op11_periodic_runs(spark, SMALL))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((brute_row(*d) for d in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("key", F.lit("k")).withColumn("runs", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = docs.drop("runs")
    both = periodic.with_runs(kept, periodic.find_runs(kept), "runs").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "runs")
    short = [r for r in rows if len(r[1] or "") < 60_000]
    got = collected(periodic.summarise(both.where("length(text) < 60000")))
    assert got == sorted((brute_row(*r, plant=False) for r in short), key=repr)
    long = periodic.summarise(both.where("length(text) >= 60000")).collect()
    assert [(r["doc_id"], r["n_runs"], r["length"], r["period"]) for r in long] == [(6, 1, 100_000, 5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert collected(periodic.summarise(periodic.with_runs(docs, periodic.find_runs(docs), "runs"))) == []
