import collections

from checks.compare import rows_of
from sparkdesk.llm import mixing
from tests.llm.helpers import odd_documents, words


def targets(sizes, weights, epochs):
    """Clamp and share again until nothing is above its clamp."""
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        share = (total - sum(clamped.values())) / max(1, sum(weights[s] for s in free))
        above = {s: epochs * sizes[s] for s in free if weights[s] * share >= epochs * sizes[s]}
        if not above:
            return {**clamped, **{s: weights[s] * share for s in free}}
        clamped.update(above)


def test_water_filling(spark):
    cases = [
        {"a": 10, "b": 1000, "c": 5, "d": 300, "e": 0, "f": 77},
        {"a": 1, "b": 1, "c": 1},
        {"x": 100},
        {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1},
        {"a": 0, "b": 0},
    ]
    for sizes in cases:
        table = mixing.cyclic_weights(spark.createDataFrame(list(sizes.items()), "source string, size long"))
        got = {r.source: r.target for r in mixing.water_fill(table).collect()}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        want = targets(sizes, weights, 3)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_taken_words_meet_targets_and_rows_repeat(spark):
    rows = [(i, "w " * (i % 40 + 1), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.draw_mix(docs).collect()
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in plan:
        by[r.source][0] += r.words * r.copies
        by[r.source][1] = r.target
        by[r.source][2] = r.source_size
        assert 0 <= r.copies <= 3
    assert all(abs(taken - target) <= 40 and target <= 3 * size for taken, target, size in by.values())
    copies = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert copies == {r.id: r.copies for r in plan if r.copies}
    again = mixing.draw_mix(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, plan))


def test_odd_cases(spark):
    docs = odd_documents(spark)
    plan = mixing.draw_mix(docs)
    got = plan.collect()
    assert sorted(r.words for r in got) == sorted(len(words(r.text)) for r in docs.collect())
    assert {r.source for r in got} == {"a", "b", "c", None}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    names, rows = rows_of(mixed.columns, mixed.collect())
    want = sum(r.copies for r in got)
    assert len(rows) == want
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.draw_mix(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_meet_their_target(spark):
    """Within about one document."""
    rows = [(None if i % 2 else 7, f"text {i} " + "w " * (i % 30), "a" if i % 3 else "b") for i in range(900)]
    plan = mixing.draw_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.words * r.copies for r in own) - own[0].target) <= 32
        assert 0 < own[0].target
