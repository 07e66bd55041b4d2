from checks.compare import rows_of
from sparkdesk.llm import line_dedup
from tests.llm.helpers import odd_documents


def lines(tag, n):
    return [f"{tag} line {i} says {i * i % 17}" for i in range(n)]


def test_shifted_passage_is_found(spark):
    """A passage inside different texts goes from all but the first, whatever stands before."""
    passage = lines("shared", 30)
    rows = [(i, "\n".join([*lines(f"own{i}", 3 + i), *passage, *lines(f"end{i}", 4)])) for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 5):
        left = got[i].split("\n")
        assert set(lines(f"own{i}", 3 + i)) | set(lines(f"end{i}", 4)) <= set(left)
        assert sum(x in passage for x in left) <= 10


def test_hash_collisions_are_not_copies(spark, monkeypatch):
    """Texts with one hash but other bytes stay."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    rows = [(1, "aa bb\ncc dd"), (2, "aa bb\ncc ee"), (3, "aa bb\ncc dd")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "aa bb\ncc dd", 2: "aa bb\ncc ee", 3: ""}


def test_odd_cases(spark):
    docs = odd_documents(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = sorted(repr((r.doc_id, (r.text if r.text is None else r.text[:3]))) for r in got.collect())
    want = [(1, "One"), (1, "One"), (2, ""), (3, None), (4, ""), (5, " \n\t"), (6, "lor"), (None, "no "), (None, None), (7, "xxx")]
    assert texts == sorted(map(repr, want))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_equals_sql_on_repeated_lines(spark):
    import random

    import duckdb

    rnd = random.Random(5)
    pool = ["", " ", *[f"l{i}" for i in range(12)]]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for i in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    cur = con.execute(f"SELECT doc_id, n_removed, text_sha256 FROM ({line_dedup.op3_sql('t')})")
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, counts=("a", "b", "n_removed"))
    got = got.select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))
    assert rows_of(got.columns, got.collect()) == want


def brute_passages(rows):
    """Texts without lines of pairs of worded lines that stand first elsewhere, by a plain walk."""
    first, kept = {}, {}
    for i, text in sorted(rows):
        all_of = text.split("\n")
        at = [k for k, x in enumerate(all_of) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for k, (begin, end) in enumerate(zip(at, at[1:])):
            seen = first.setdefault("\n".join(all_of[begin : end + 1]), (i, k))
            if seen[0] != i or k >= seen[1] + 2:
                gone |= set(range(begin, end + 1))
        kept[i] = "\n".join(x for k, x in enumerate(all_of) if k not in gone)
    return kept


def test_short_passages_go_whatever_stands_around(spark):
    """Planted passages of 2 to 8 lines go whole from all hosts but the first, in the pipeline."""
    import corpus_pipeline

    rows = []
    for n in range(2, 9):
        for copy in range(3):
            i = n * 10 + copy
            rows.append((i, "\n".join([*lines(f"own{i}", 2 + copy), *lines(f"shared{n}", n), *lines(f"end{i}", 3)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    for i, text in rows:
        shared = "" if i % 10 == 0 else "shared"
        assert got[i] == "\n".join(x for x in text.split("\n") if not shared or not x.startswith(shared))


def test_passages_equal_a_plain_walk(spark):
    import random

    rnd = random.Random(6)
    pool = ["", " ", *[f"l{i}" for i in range(12)]]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_passages(docs).collect()}
    assert got == brute_passages(rows)
    odd = odd_documents(spark)
    assert line_dedup.dedup_passages(odd).columns == odd.columns
    assert line_dedup.dedup_passages(odd).count() == odd.count()
    assert line_dedup.dedup_passages(odd.limit(0)).count() == 0
