"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row: a component's place is a term and its scaled, rounded-down value the
term's weight. Query rows and candidate rows are dealt into blocks, and a pair of blocks is one
group. There the candidates' weights are turned into postings by term; every term of a query
row scatters its weighted posting into a dense array of scores, one entry per candidate. No
candidate is left out. The best rows of an array are selected by partition, kept while further
candidates of the block pass, and merged across blocks.

A posting that covers most of its candidates is stored as a column, which makes scattering an
addition of arrays. Blocks hold at most ``QUERY_ROWS`` and ``CANDIDATE_ROWS`` rows, so a group
is bounded, and rows are dealt by number: equal vectors spread evenly. With fewer rows blocks get
smaller, so that all cores have work; blocks change no result.

Cases: rows with a null id or vector, vectors with null or non-finite components, and vectors
whose scaled squared length reaches 2^62, so that a score might not fit in 64 bits, take no part.
An absent component counts as zero, so vectors of different lengths are compared on those they
share and an empty one scores 0. A repeated row is a query and a candidate of its own; only the
query row itself is left out. Equal scores are ordered by id. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.llm.common import read
from sparkdesk.session import materialize

K = 20
SCALE = 64
QUERY_ROWS = 4096
CANDIDATE_ROWS = 65_536
# Candidate blocks aren't cut below this for the sake of more tasks.
LEAST_ROWS = 2048
# Candidates that one array of scores covers.
CHUNK = 8192
# A posting that covers one candidate in so many, or more, is stored as a column.
DENSE = 4
BEST = "query_row bigint, query_id bigint, vec_id bigint, vec_row bigint, score bigint"


def sparse_rows(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(row, id, weights) of the rows that take part; ``row`` tells repeated rows apart once
    the table is written."""
    given = F.col(vector_col)
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    takes_part = F.coalesce(finite, F.lit(False)) & F.col(id_col).isNotNull()
    weights = F.transform(given.cast("array<double>"), lambda x: F.floor(x * scale))
    square = F.aggregate(
        "weights", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    taken = rows.where(takes_part).select(F.col(id_col).cast("long").alias("id"), weights.alias("weights"))
    return taken.where(square < float(1 << 62)).select(
        F.monotonically_increasing_id().alias("row"), "id", "weights"
    )


class Block:
    """Rows (row, id, weights) of one block, their weights as flat arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.row = table.column("row").to_numpy()
        self.id = table.column("id").to_numpy()
        lists = table.column("weights")
        self.lengths = np.asarray(lists.chunk(0).value_lengths()) if len(table) else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        flat = lists.chunk(0).flatten() if len(table) else pa.array([], pa.int64())
        self.weights = flat.to_numpy(zero_copy_only=False).astype(np.int64)

    def norm(self) -> float:
        """Length of the longest row."""
        if not len(self.row):
            return 0.0
        sums = np.concatenate([[0.0], np.cumsum(np.square(self.weights.astype(np.float64)))])
        return float(np.sqrt(np.max(sums[self.starts[1:]] - sums[self.starts[:-1]], initial=0.0))) + 1

    def terms(self, at: int) -> tuple[list[int], np.ndarray]:
        """The terms of a row with a weight, and the weights."""
        weights = self.weights[self.starts[at] : self.starts[at + 1]]
        terms = np.flatnonzero(weights)
        return terms.tolist(), weights[terms]


def postings(block: Block, rows: np.ndarray, kind: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """By term, the places of the rows that hold it and their weights; no places: all rows."""
    lengths = block.lengths[rows]
    place = np.repeat(np.arange(len(rows)), lengths)
    ends = np.cumsum(lengths)
    term = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    weight = block.weights[np.repeat(block.starts[rows], lengths) + term]
    some = np.flatnonzero(weight)
    some = some[np.argsort(term[some], kind="stable")]
    place, term, weight = place[some], term[some], weight[some].astype(kind)
    cuts = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)] if len(term) else [0]
    out = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        at, own = place[a:b], weight[a:b]
        if (b - a) * DENSE >= len(rows):
            column = np.zeros(len(rows), kind)
            column[at] = own
            at, own = None, column
        out[int(term[a])] = (at, own)
    return out


def _select(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Of places in ascending order, the k with the highest scores, the earlier of equal ones."""
    if len(places) <= k:
        return places
    own = scores[places]
    least = np.partition(own, len(own) - k)[len(own) - k]
    above = places[own > least]
    return np.concatenate([above, places[own == least][: k - len(above)]])


def best_of_blocks(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of every query row in a pair of blocks."""
    asked, given = Block(queries), Block(candidates)
    # by Cauchy-Schwarz no partial sum is greater
    kind = np.int32 if asked.norm() * given.norm() < 2**31 - 1 else np.int64
    rows = [asked.terms(i) for i in range(len(asked.row))]
    rows = [list(zip(terms, weights.astype(kind))) for terms, weights in rows]
    order = np.lexsort([given.row, given.id])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]
    for start in range(0, len(order), CHUNK):
        chunk = order[start : start + CHUNK]
        posted = postings(given, chunk, kind)
        own_place = {r: i for i, r in enumerate(given.row[chunk].tolist())}
        scores, part = np.empty(len(chunk), kind), np.empty(len(chunk), kind)
        for i, row in enumerate(rows):
            scores.fill(0)
            for term, weight in row:
                if term not in posted:
                    continue
                at, weights = posted[term]
                if at is None:
                    np.multiply(weights, weight, out=part)
                    np.add(scores, part, out=scores)
                else:
                    scores[at] += weights * weight
            known, values = found[i]
            # candidates pass in order of id, so a later one has to score more
            hits = np.flatnonzero(scores > values[-1]) if len(known) == k else np.arange(len(chunk))
            own = own_place.get(int(asked.row[i]))
            if own is not None:
                hits = hits[hits != own]
            if len(hits):
                hits = _select(scores, hits, k)
                known = np.concatenate([known, hits + start])
                values = np.concatenate([values, scores[hits].astype(np.int64)])
                top = np.lexsort([known, -values])[:k]
                found[i] = known[top], values[top]
    sizes = [len(known) for known, _ in found]
    places = order[np.concatenate([known for known, _ in found])] if found else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.int64)
    columns = [np.repeat(asked.row, sizes), np.repeat(asked.id, sizes), given.id[places], given.row[places], values]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "vec_id", "vec_row", "score"])


def top_k(
    rows: DataFrame,
    queries: Column | str,
    k: int = K,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``queries`` picks.

    ``queries`` is a condition on the column ``id``, the rows' own.
    """
    table, _ = materialize(sparse_rows(rows, id_col, vector_col, scale), "sparse-rows")
    asked = table.where(queries)
    n, n_asked = table.count(), asked.count()
    query_blocks = max(1, ceil(n_asked / QUERY_ROWS))
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
    size = min(CANDIDATE_ROWS, max(LEAST_ROWS, ceil(n * query_blocks / wanted)))
    blocks = max(1, ceil(n / size))

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, others: int) -> DataFrame:
        all_others = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        df = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(own_blocks)).cast("int"))
        return df.withColumn(other, all_others)

    left = dealt(asked, "query_block", query_blocks, "block", blocks).groupBy("query_block", "block")
    right = dealt(table, "block", blocks, "query_block", query_blocks).groupBy("query_block", "block")
    best = left.cogroup(right).applyInArrow(lambda a, b: best_of_blocks(a, b, k), BEST)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op12_sql() -> str:
    return f"""
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id,
               list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r,
               list_sum(list_transform(list_zip(q.w, c.w), lambda x: coalesce(x[1] * x[2], 0)))::BIGINT AS score
        FROM v q JOIN v c ON q.r <> c.r
        WHERE q.vec_id % 20 = 0
    ), k AS (
        SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r) AS n FROM s
    )
    SELECT query_id, n::INT AS rank, vec_id, score FROM k WHERE n <= {K}
    """
