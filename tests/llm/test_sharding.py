import collections
import zlib

from sparkdesk.llm import sharding
from tests.conftest import SMALL
from tests.llm.helpers import odd_documents


def check(rows, shards=8):
    total = len(rows)
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s in sizes for k in range(sizes[s])}
    of, inside = collections.Counter(r.source for r in rows), collections.Counter((r.source, r.shard) for r in rows)
    for source, n in of.items():
        for s in range(shards):
            # at most the neighbouring rows of the same rank stand between a cut and the source's share
            assert abs(inside[source, s] - n * sizes[s] / total) <= 2


def brute(rows, shards=8):
    """Fractional ranks of the drawn order, sorted and cut, in plain Python."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    placed = []
    for source, group in by.items():
        group.sort(key=lambda r: r.draw)
        placed += [((2 * k + 1) / (2 * len(group)), source is None, source or "", r.doc_id) for k, r in enumerate(group)]
    placed.sort()
    cut = [[] for _ in range(shards)]
    for at, (_, _, _, doc_id) in enumerate(placed):
        cut[at * shards // len(placed)].append(doc_id)
    return {d: (s, k) for s, ids in enumerate(cut) for k, d in enumerate(ids)}


def test_equals_brute_force(spark):
    from pyspark.sql import functions as F

    from sparkdesk.llm.common import seeded

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.op10_sharding(spark, SMALL).collect()}
    assert got == brute(docs.withColumn("draw", seeded(sharding.SEED, F.col("doc_id"))).collect())


def test_query_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = sharding.op10_sharding(spark, SMALL).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    check(rows)


def test_hot_source_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    rows = [(i, "t", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(2003)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 2003
    check(got)


def test_odd_cases(spark):
    docs = odd_documents(spark)
    got = sharding.interleave(docs)
    assert got.columns == ["id", "source", "size", "text_crc32", "shard", "slot"]
    rows = got.collect()
    assert sorted(r.size for r in rows) == sorted(len((r.text or "").encode()) + 1 for r in docs.collect())
    check(rows)
    assert sharding.interleave(docs.limit(0)).count() == 0
    assert [r.shard for r in sharding.interleave(docs.limit(1)).collect()] == [0]
