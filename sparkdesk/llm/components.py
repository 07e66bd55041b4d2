"""Connected components of a link table, by alternating large and small stars.

Every round rewires links towards smaller ids: the large star hangs a node's larger neighbours
under the smallest of its neighbourhood, the small star its smaller ones. The links end as
stars around each component's smallest id, after about log(longest path) rounds. A round is
two aggregations and two joins; a hub's links are pre-aggregated for its minimum and spread by
the join's skew handling. Each round is written to the shared folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdesk.llm.common import Steps


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    least = both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.where(F.col("b") > F.col("a"))
    return larger.join(least, F.col("a") == F.col("of")).select(F.col("m").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("of")).where(F.col("b") > F.col("m"))
    under = moved.select(F.col("m").alias("a"), "b")
    return under.unionAll(least.select(F.col("m").alias("a"), F.col("of").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), whose ids are numbers.

    Null ends and loops are ignored; a node without links isn't listed. Without links the
    result is empty.
    """
    links = links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    steps = Steps(links.sparkSession)
    state, before = steps.write(links.distinct(), "links0"), None
    for turn in itertools.count(1):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before or now[0] == 0:
            break
        before = now
        state = steps.write(_small_star(_large_star(state)).distinct(), f"links{turn}")
        steps.drop(f"links{turn - 1}")
    members = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionAll(
        state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
