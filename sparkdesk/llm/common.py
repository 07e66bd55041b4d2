"""Column expressions and small jobs that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdesk.session import materialize, remove_path

# Words are runs of anything but blank, tab, newline, vertical tab, form feed and return.
SPACE = r"[\x20\x09-\x0D]+"
HASH_BITS = 48


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column) -> Column:
    """The text, empty if null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE), "")


def seeded(seed: int, *parts: Column) -> Column:
    """Uniform 48-bit number from a seed and values; nulls count as absent."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def seeded_sql(seed: int, *parts: str) -> str:
    """``seeded`` in DuckDB's SQL."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 12))::BIGINT"


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash with none of ``taken``, which Spark compares without case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Intermediate tables in the shared folder.

    A step's shuffle files go when its table is written, and a table goes when a later one
    makes it needless; large steps then don't add up on the executors' disks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            table, path = materialize(df, tag)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        self.paths.setdefault(tag, []).append(path)
        return table

    def drop(self, *tags: str) -> None:
        for tag in tags:
            for path in self.paths.pop(tag, []):
                remove_path(self.spark, path)
