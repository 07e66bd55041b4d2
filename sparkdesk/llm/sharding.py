"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; a row's fractional rank is its place in that
order over the source's rows. Sorting all rows by fractional rank spreads every source evenly,
and cutting the sorted rows into equal runs gives shards that all match the mixture. Shards'
row counts differ by one at most (law ``rows``).

Ranks and places come from counts per cell (a range of seeded numbers or of ranks) plus the
order inside a cell, so neither a large source nor the whole table is ever sorted in one task.

Cases: a null text counts as empty, a null source is a source of its own, rows with equal ids
are ordered by checksum and size, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.llm.common import HASH_BITS, read, same, seeded, whole
from sparkdesk.session import materialize

SHARDS = 8
SEED = 10
# Rows that a cell holds on average; it sets the size of tasks, not the result.
CELL_ROWS = 5000


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot): slots count up from 0 in each shard."""
    text = whole(F.col(text_col))
    rows, _ = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            seeded(seed, F.col(id_col)).alias("draw"),
        ),
        "shard",
    )
    total = rows.count()
    bits = max(4, (total // CELL_ROWS).bit_length())

    rows = rows.withColumn("cell", F.shiftright("draw", HASH_BITS - bits))
    cells = rows.groupBy(F.col("source").alias("of"), F.col("cell").alias("at")).count()
    up_to = Window.partitionBy("of").orderBy("at")
    cells = cells.select(
        "of",
        "at",
        (F.sum("count").over(up_to) - F.col("count")).alias("before"),
        F.sum("count").over(Window.partitionBy("of")).alias("of_rows"),
    )
    order = Window.partitionBy("source", "cell").orderBy("draw", "id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(order)).join(
        cells, same(F.col("source"), F.col("of")) & (F.col("cell") == F.col("at"))
    )
    rank = F.col("before") + F.col("nth")
    ranked = ranked.select(
        "id",
        "source",
        "size",
        "text_crc32",
        ((2 * rank - 1) / (2 * F.col("of_rows"))).alias("fraction"),
    ).withColumn("band", F.floor(F.col("fraction") * (1 << bits)))

    bands = ranked.groupBy(F.col("band").alias("in_band")).count()
    bands = bands.select(
        "in_band",
        (F.sum("count").over(Window.orderBy("in_band")) - F.col("count")).alias("bands_before"),
    )
    order = Window.partitionBy("band").orderBy("fraction", F.col("source").asc_nulls_last())
    placed = ranked.withColumn("nth", F.row_number().over(order) - 1).join(
        bands, F.col("band") == F.col("in_band")
    )
    place = (F.col("bands_before") + F.col("nth")).cast("long")
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("place", place)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select("id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return interleave(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
