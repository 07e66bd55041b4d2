"""Ranked lexical search against a plain walk over all documents and items."""

import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkdesk.llm import lexical
from tests.llm.helpers import LONG, collected, odd_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def found(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(i, Counter(found(t))) for i, t in docs]
    bags = [(i, bag, bag.total()) for i, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m, score = 25 + (75 * n * n_docs) // n_terms, 0
            for t in found(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        ranked = enumerate(sorted(scores)[:k], 1)
        out += [(item, n, None if null else i, -s) for n, (s, null, i) in ranked]
    return sorted(out, key=repr)


def test_terms():
    text = "Don't  ÉTÉ-été_x9\x00z\x7f漢字 <b>"
    assert [t.decode() for t in lexical.terms(text.encode())] == found(text)


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_matches_walk(spark, monkeypatch, block_bytes):
    """Also with items in many blocks; copies and permutations of words make classes."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(200)]
    docs += [(1000 - i, docs[0][1]) for i in range(30)]
    docs += [(2000 + i, " ".join(rng.sample(docs[1][1].split(), len(docs[1][1].split())))) for i in range(20)]
    docs += [(3000 + i, f"other{i} words{i}") for i in range(20)]
    items = [(i, " ".join(rng.choices(words[i : i + 30], k=12))) for i in range(20)]
    items += [(20, docs[0][1]), (21, docs[1][1]), (22, "absent words only"), (22, "w1 w1 w2")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"))
    assert collected(got) == brute(docs, items)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "one SIX lorem"), (1, "one SIX lorem"), (None, "id"), (2, None), (3, ""), (4, LONG), (5, "none here")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))
    docs = docs.withColumn("terms", F.lit(1)).withColumn("n", F.lit(2))
    assert collected(lexical.search(docs, df)) == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert collected(lexical.search(docs.where("false"), items)) == []
    assert collected(lexical.search(docs, items.where("false"))) == []
