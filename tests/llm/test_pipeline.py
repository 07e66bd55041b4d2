"""Stages against brute force, and what the whole keeps and drops."""

import collections
import hashlib
import struct

import tokenizers

import corpus_pipeline
from sparkdesk.llm import bpe, mixing, ngram_join, toxicity
from tests.conftest import SMALL
from tests.llm.helpers import LONG, words
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute


def plain_mix(rows):
    """Copies of each row (doc_id, text, source), by a walk in seeded order."""
    groups, out = collections.defaultdict(list), []
    for i, (doc_id, text, source) in enumerate(rows):
        parts = [str(mixing.SEED), *([str(doc_id)] if doc_id is not None else []), hashlib.md5((text or "").encode()).hexdigest()]
        draw = int(hashlib.md5(":".join(parts).encode()).hexdigest()[:12], 16)
        groups[source].append((draw, len(words(text)), i))
    sizes = {s: sum(n for _, n, _ in g) for s, g in groups.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    copies = [0] * len(rows)
    for s, group in groups.items():
        times = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        rest, upto = target[s] - times * sizes[s], 0
        units = collections.defaultdict(list)
        for draw, n, i in sorted(group):
            units[draw].append((n, i))
        for draw in sorted(units):
            unit = sum(n for n, _ in units[draw])
            more = int(upto * 2 + unit <= rest * 2)
            upto += unit
            for _, i in units[draw]:
                copies[i] = min(3, times + more)
    for i, (doc_id, text, _) in enumerate(rows):
        out += [(doc_id, text)] * copies[i]
    return collections.Counter(out)


def plain_digests(texts):
    """(n_tokens, digest of ids, digest of the decoded text) by the tokenizers library."""
    tokenizer = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        yield len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_over_a_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = (docs.collect(), out.collect())
        if name != "bpe":
            assert out.columns == columns and out.schema == docs.schema
        docs = out

    before, after = seen["toxicity"]
    model = toxicity.learn(spark.createDataFrame(before).select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.add_score(spark.createDataFrame(before), model).collect()}
    assert {r.doc_id for r in after} == {i for i, s in scores.items() if s < toxicity.LEAST_SCORE}

    before, after = seen["line_dedup"]
    texts = {r.doc_id: r.text for r in after}
    gone = [r for r in before if r.doc_id not in texts]
    held = collections.Counter(r.text for r in before)
    assert all(held[r.text] > 1 or "\n" in r.text for r in gone)
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = seen["ngram_jaccard_join"]
    component = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in before], 5, 80)}
    assert {r.doc_id for r in after} == {d for d, c in component.items() if d == c}

    before, after = seen["mixing"]
    assert collections.Counter((r.doc_id, r.text) for r in after) == plain_mix([(r.doc_id, r.text, r.source) for r in before])

    before, after = seen["bpe"]
    want = [(r.doc_id, *found) for r, found in zip(before, plain_digests([r.text for r in before]))]
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after)
    assert sorted(map(repr, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(repr, after))


def test_copies_leave_one_document(spark):
    text = "\n".join(f"line {i} of a text that stands here {i * 7 % 11} times" for i in range(9))
    near = text.replace("line 4", "row 4")
    rows = [(5, text, "en", "a", len(text)), (3, text, "en", "b", len(text)), (8, near, "en", "a", len(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SMALL)
    assert {r.doc_id for r in lines.collect()} == {3, 8}
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()] == [3]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


ODD = [
    (1, "One two three four five.\nSix seven eight nine ten.\nEleven.", "en", "a", 60),
    (1, "One two three four five.\nSix seven eight nine ten.\nEleven.", "en", "a", 60),
    (2, "One two three four five.\nSix seven eight nine ten.\nEleven.", None, None, 60),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, " \n\t ", "en", None, 4),
    (6, LONG[:200_000], "en", "b", 200_000),
    (None, "no id here, none at all", "en", "c", 23),
    (None, "no id here either, and another text", "en", "c", 35),
    (None, None, None, None, None),
]


def test_stages_on_odd_rows_and_an_empty_table(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, kind)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, SMALL).cache()
            if name == "bpe":
                assert docs.count() == before.count()
            else:
                assert docs.columns == columns
        if rows:
            # of the copies the smallest known id stays
            assert {r.doc_id for r in docs.collect()} >= {1, 6, None}
            assert 2 not in {r.doc_id for r in docs.collect()}
        else:
            assert docs.count() == 0
