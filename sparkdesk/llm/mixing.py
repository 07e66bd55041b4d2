"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source asks for its share of the mix by weight. A source that would be repeated more
than ``epochs`` times is clamped there and its excess is shared by weight among the others,
until none is above its clamp. A source's documents are then taken whole as many times as
the target holds whole epochs, and once more in seeded order until the rest is used up.

Cases: a null text has size 0, a null source is a source of its own, a source without words
gets target 0, rows with equal ids and texts are taken together, others that share an id or have
none are drawn apart, an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.llm.common import HASH_BITS, Steps, fresh, same, seeded, whole, words
from sparkdesk.session import materialize

EPOCHS = 3
SEED = 9
# Tasks that a source's documents are dealt to where they meet their source's cut.
SALTS = 64
# Bits of the seeded number that each look into a source's order resolves.
LOOKS = (36, 24, 0)


def size_in_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, size, weight): weights repeat along the sources' names, null last.

    The window sees one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int"))
    return sizes.select("source", "size", weight.alias("weight"))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, size, weight): the mix is as large as all sources together.

    Clamping the sources in the order of size over weight reaches the state in which the
    rounds of clamping and sharing end: once a source fits under the level of the rest, all
    later ones do. The windows see one row per source; weights are positive.
    """
    order = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    clamp = F.col("size") * epochs
    state = sources.select(
        "source",
        "size",
        "weight",
        clamp.alias("clamp"),
        (
            F.sum("size").over(order.rowsBetween(first, last))
            - F.coalesce(F.sum(clamp).over(order.rowsBetween(first, -1)), F.lit(0))
        ).alias("left"),
        F.sum("weight").over(order.rowsBetween(0, last)).alias("sharing"),
    )
    clamped = F.col("clamp") * F.col("sharing") <= F.col("weight") * F.col("left")
    level = F.first(F.when(~clamped, F.struct("left", "sharing")), ignorenulls=True)
    state = state.withColumns(
        {"clamped": clamped, "level": level.over(order.rowsBetween(first, last))}
    )
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.sharing")
    return state.select(
        "source",
        "size",
        "weight",
        F.when(F.col("clamped"), F.col("clamp").cast("double")).otherwise(share).alias("target"),
    )


def draw_of(id: Column, text: Column, seed: int = SEED) -> Column:
    """Seeded number of a row, from its id and a digest of its text: rows that share an id, or
    have none, are drawn apart, and only rows equal in both are taken together."""
    return seeded(seed, id, F.md5(whole(text)))


def _cuts(drawn: DataFrame, sources: DataFrame, epochs: int) -> DataFrame:
    """Per source the whole repetitions and the largest seeded number of the last, partial one.

    A histogram over the leading bits of the seeded number finds the cell that holds the cut,
    a second one the cell inside it; only that cell's documents, one in 2**24 of the source,
    are put in order. What is known after each look, a row per source, is written, so that no
    plan holds more than one look.
    """
    steps = Steps(drawn.sparkSession)
    times = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    state = sources.withColumn("times", F.least(times, F.lit(epochs)).cast("long")).select(
        "source",
        "size",
        "target",
        "times",
        (F.col("target") - F.col("times") * F.col("size")).alias("rest"),
        F.lit(0).cast("long").alias("cell"),
        F.lit(0).cast("long").alias("before"),
    )
    state = steps.write(state, "mix-state")
    shift = HASH_BITS
    for turn, finer in enumerate(LOOKS):
        inside = drawn.select(F.col("source").alias("of"), "draw", "words")
        if shift < HASH_BITS:
            cells = state.select(F.col("source").alias("in_source"), "cell")
            here = F.shiftright(F.col("draw"), shift) == F.col("cell")
            inside = inside.join(cells, same(F.col("of"), F.col("in_source")) & here, "left_semi")
        sums = inside.groupBy("of", F.shiftright("draw", finer).alias("part")).agg(
            F.sum("words").alias("sum")
        )
        known = state.select(F.col("source").alias("in_source"), "before", "rest")
        sums = sums.join(known, same(F.col("of"), F.col("in_source")))
        walk = Window.partitionBy("of").orderBy("part")
        sums = sums.withColumn("end", F.col("before") + F.sum("sum").over(walk))
        begin = F.col("end") - F.col("sum")
        if finer:
            # the cut lies in the first cell whose end passes what is left, if any does
            crossing = sums.where(F.col("end") > F.col("rest")).groupBy("of").agg(
                F.min(F.struct("part", begin.alias("begin"))).alias("at")
            )
            found = crossing.select("of", F.col("at.part").alias("part"), F.col("at.begin").alias("begin"))
            past = F.lit(1 << (HASH_BITS - finer)).cast("long")
        else:
            fits = begin * 2 + F.col("sum") <= F.col("rest") * 2
            found = sums.where(fits).groupBy("of").agg(
                F.max("part").alias("part"), F.lit(0).cast("long").alias("begin")
            )
            past = F.shiftleft(F.col("cell"), LOOKS[-2]) - 1
        state = state.join(found, same(state["source"], found["of"]), "left").select(
            "source",
            "size",
            "target",
            "times",
            "rest",
            F.coalesce("part", past).alias("cell"),
            F.coalesce("begin", F.col("before")).alias("before"),
        )
        state = steps.write(state, f"mix-state-{turn}")
        steps.drop("mix-state", f"mix-state-{turn - 1}")
        shift = finer
    return state.select("source", "size", "target", "times", F.col("cell").alias("cut"))


def draw_mix(
    docs: DataFrame,
    weights=cyclic_weights,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """(id, source, words, draw, source_size, target, copies) of every document.

    ``weights`` turns a table (source, size) into (source, size, weight).
    """
    drawn, _ = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            size_in_words(F.col(text_col)).alias("words"),
            draw_of(F.col(id_col), F.col(text_col), seed).alias("draw"),
        ),
        "mix",
    )
    cuts = _spread(mix_cuts(drawn, weights, epochs), "salt")
    mine = same(F.col("source"), F.col("of")) & (F.col("draw") % SALTS == F.col("salt"))
    return drawn.join(cuts, mine, "left").select(
        "id", "source", "words", "draw", "source_size", "target", copies_of("draw", epochs).alias("copies")
    )


def _spread(cuts: DataFrame, salt: str) -> DataFrame:
    """One row per source and salt, so that a hot source's documents meet it in many tasks."""
    return cuts.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def mix_cuts(drawn: DataFrame, weights=cyclic_weights, epochs: int = EPOCHS) -> DataFrame:
    """(of, source_size, target, times, cut): one row per source of (source, words, draw)."""
    sizes = drawn.groupBy("source").agg(F.sum("words").alias("size"))
    cuts = _cuts(drawn, water_fill(weights(sizes), epochs), epochs)
    return cuts.select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "times", "cut"
    )


def copies_of(draw: str, epochs: int) -> Column:
    once_more = F.when(F.col(draw) <= F.col("cut"), 1).otherwise(0)
    return F.least(F.col("times") + once_more, F.lit(epochs)).cast("long")


def mix(
    docs: DataFrame,
    weights=cyclic_weights,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mixed table: rows of ``docs``, with the same columns, as often as the mix takes them."""
    (draw,) = fresh(docs.columns, "mix_draw")
    slim = docs.select(
        F.col(source_col).alias("source"),
        size_in_words(F.col(text_col)).alias("words"),
        draw_of(F.col(id_col), F.col(text_col), seed).alias("draw"),
    )
    cuts = mix_cuts(materialize(slim, "mix")[0], weights, epochs)
    of, total, target, times, cut, salt, copy = fresh(
        [*docs.columns, draw],
        "mix_of", "mix_total", "mix_target", "mix_times", "mix_cut", "mix_salt", "mix_copy",
    )
    cuts = _spread(cuts.toDF(of, total, target, times, cut), salt)
    once_more = F.when(F.col(draw) <= F.col(cut), 1).otherwise(0)
    copies = F.least(F.col(times) + once_more, F.lit(epochs)).cast("int")
    out = docs.withColumn(draw, draw_of(F.col(id_col), F.col(text_col), seed)).join(
        cuts, same(F.col(source_col), F.col(of)) & (F.col(draw) % SALTS == F.col(salt))
    )
    out = out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from sparkdesk.llm.common import read

    mixed = draw_mix(read(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"),
        F.col("words").alias("size"),
        "source_size",
        "target",
        (F.col("words") * F.col("copies")).alias("taken"),
    )


def op9_sql() -> str:
    from sparkdesk.llm.common import seeded_sql

    return f"""
WITH docs AS (
  SELECT doc_id, source, {seeded_sql(SEED, 'doc_id', "md5(coalesce(text, ''))")} AS draw,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
state AS (
  SELECT *, {EPOCHS} * source_size AS clamp,
    sum(source_size) OVER () - coalesce(sum({EPOCHS} * source_size) OVER (
      ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM sources),
marked AS (SELECT *, clamp * sharing <= weight * room AS clamped FROM state),
level AS (SELECT arg_min(room, source_size / weight) AS room, arg_min(sharing, source_size / weight) AS sharing
  FROM marked WHERE NOT clamped),
targets AS (
  SELECT m.source, m.source_size,
    CASE WHEN clamped THEN clamp::DOUBLE ELSE (weight * l.room)::DOUBLE / l.sharing::DOUBLE END AS target
  FROM marked m LEFT JOIN level l ON true),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {EPOCHS}) ELSE 0 END::BIGINT AS times
  FROM targets),
walk AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY draw) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, draw) AS unit
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * least({EPOCHS}, times + CASE WHEN (upto - unit) * 2 + unit <= rest * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM walk"""
