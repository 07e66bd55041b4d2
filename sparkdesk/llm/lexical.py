"""Ranked lexical search by bag deduplication.

Of a document, only the terms that some item holds matter to its scores. Each document is
restricted to that vocabulary: term numbers and occurrences, in order of term, and its length
factor m. Documents whose bags and m are equal are one class: rows meet by a hash of both and are
grouped by the values themselves, so a collision of hashes joins nothing. A class is scored once;
its members share the score and are expanded by ascending id. Since a ranking takes k documents,
a class carries its k first members and no more.

Classes are scored term at a time: a batch's occurrences are turned into postings of finished
64-bit parts, and every term of an item adds its posting to an array with one score per class.
Each task keeps the k best documents of an item, which are then merged.

Items are read in blocks of about ``BLOCK_BYTES`` of text, whatever their number; a block's
vocabulary is what tasks get, and documents are read once per block.

Cases: null and empty texts have no terms, and an item without terms no rows; documents without
terms aren't counted; a document with a null id counts and is ranked after its equals; repeated
items are ranked each, repeated documents listed each; an empty table on either side gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.llm.common import read, whole
from sparkdesk.session import materialize

K = 10
# Fixed values of the score.
PART, SATURATION, LENGTH_SHARE, LENGTH_STEP, WEIGHT = 1_000_000_000, 1000, 75, 8, 1000
# Text of the items whose vocabulary is handed to tasks at once, about.
BLOCK_BYTES = 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# ASCII letters in lower case, digits and all bytes of other characters stay, the rest parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Items:
    """A block of items and the vocabulary they hold."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.asked: list[tuple[int, list[tuple[int, int]]]] = []
        for row, text in rows:
            counts = Counter(self.number.setdefault(t, len(self.number)) for t in terms(text))
            if counts:
                self.asked.append((row, sorted(counts.items())))


def bags(docs: DataFrame, number) -> DataFrame:
    """(id, n, terms, counts) of documents (id, text) with a term: all terms' number, and the
    vocabulary's terms with their occurrences. ``number`` is a broadcast of term numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = number.value.get
        for batch in batches:
            sizes, held, counts, starts = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                found = terms(text.as_py())
                sizes.append(len(found))
                own = np.array([x for x in map(number_of, found) if x is not None], np.int32)
                own, often = np.unique(own, return_counts=True)
                held.append(own)
                counts.append(often)
                starts.append(starts[-1] + len(own))
            offsets = pa.array(starts, pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind))
                for x, kind in ((held, pa.int32()), (counts, pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "counts"]
            )

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, counts array<bigint>").where("n > 0")


def classes(bagged: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, terms, counts, members): documents of one bag and m, with their k smallest ids."""
    spread = F.expr(f"({LENGTH_SHARE}L * n * {n_docs}L) div {max(n_terms, 1)}L")
    found = bagged.where(F.size("terms") > 0).withColumn("m", 100 - LENGTH_SHARE + spread)
    key = ["hash", "m", "terms", "counts"]
    found = found.select("id", F.xxhash64("m", "terms", "counts").alias("hash"), *key[1:])
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("id")))
    first = found.withColumn("place", place).where(F.col("place") <= k)
    members = F.sort_array(F.collect_list(F.struct("place", "id")))
    return first.groupBy(*key).agg(members.alias("members")).select(*key[1:], "members.id")


class Best:
    """The k best (score, id) of one item so far; a null id follows its equals."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, first: np.ndarray, members: pa.ListArray) -> None:
        """Scores of classes and their smallest members' order."""
        hits = np.flatnonzero(scores >= self.least())
        if len(hits) > self.k:
            own = scores[hits]
            hits = hits[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
            hits = hits[np.lexsort([first[hits], -scores[hits]])[: self.k]]
        for at in hits.tolist():
            score = int(scores[at])
            self.rows += [(-score, i is None, i or 0) for i in members[at].as_py()]
        if len(hits):
            self.rows = sorted(self.rows)[: self.k]


def scored(bag_classes: DataFrame, block, k: int) -> DataFrame:
    """(row, score, id): for each item of a block the k best documents of every task.

    ``block`` is a broadcast of the items' terms and the weight of each term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = block.value
        best = {row: Best(k) for row, _ in asked}
        for batch in batches:
            m = batch.column(0).to_numpy()
            sizes = np.asarray(batch.column(1).value_lengths())
            term = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            often = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(len(m)), sizes)
            part = weight[term] * ((PART * often) // (SATURATION * often + LENGTH_STEP * m[place]))
            order = np.argsort(term, kind="stable")
            term, place, part = term[order], place[order], part[order]
            cuts = np.searchsorted(term, np.arange(len(weight) + 1))
            members = batch.column(3)
            head = members.flatten().take(members.offsets[:-1])
            # nulls last, then by id
            missing = np.asarray(head.is_null())
            first = np.empty(len(m), np.int64)
            first[np.lexsort([head.fill_null(0).to_numpy(zero_copy_only=False), missing])] = np.arange(len(m))
            scores = np.empty(len(m), np.int64)
            for row, held in asked:
                scores.fill(0)
                for t, times in held:
                    a, b = cuts[t], cuts[t + 1]
                    if b > a:
                        scores[place[a:b]] += times * part[a:b]
                best[row].add(scores, first, members)
        found = [(row, -s, None if null else i) for row, b in best.items() for s, null, i in b.rows]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "score", "id"])

    return bag_classes.mapInArrow(run, "row bigint, score bigint, id bigint")


def _block_scores(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    """Best documents of a block's items; None without any term in common."""
    spark = docs.sparkSession
    bagged, _ = materialize(bags(docs, spark.sparkContext.broadcast(items.number)), "bags")
    n_docs, n_terms = bagged.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(items.number), np.int64)
    # one row per term of the block's vocabulary at most
    for term, df in bagged.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weight[term] = math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))
    if not weight.any():
        return None
    block = spark.sparkContext.broadcast((items.asked, weight))
    return scored(classes(bagged, n_docs, n_terms, k), block, k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    numbered, _ = materialize(
        items.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(item_col).cast("long").alias("item_id"),
            whole(F.col(item_text_col)).alias("text"),
        ),
        "items",
    )
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / BLOCK_BYTES))
    found = spark.createDataFrame([], "row bigint, score bigint, id bigint")
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        own = Items([(r, bytes(t)) for r, t in rows.select("row", F.encode("text", "UTF-8")).collect()])
        if own.asked and (best := _block_scores(table, own, k)) is not None:
            found = found.unionByName(best)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.withColumnRenamed("id", "doc_id").withColumnRenamed("row", "of")
    return ranked.join(numbered.select("row", "item_id"), F.col("of") == F.col("row")).select(
        "item_id", "rank", "doc_id", "score"
    )


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def found(text: str) -> str:
        return f"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '{TERM}')"

    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, {found("text")} AS w FROM documents WHERE text IS NOT NULL
    ), s AS (
        SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0
    ), t AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL
    ), f AS (
        SELECT term, floor({WEIGHT} * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM t, s GROUP BY term, docs
    ), i AS (
        SELECT row_number() OVER () AS item, item_id, {found("text")} AS w FROM benchmark WHERE text IS NOT NULL
    ), q AS (
        SELECT item, item_id, term, count(*) AS times
        FROM (SELECT item, item_id, unnest(w) AS term FROM i) GROUP BY ALL
    ), m AS (
        SELECT r, doc_id, 100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * len(w) * docs) // total AS m
        FROM d, s WHERE len(w) > 0
    ), scores AS (
        SELECT item, item_id, r, doc_id,
               sum(times * w * (({PART} * tf) // ({SATURATION} * tf + {LENGTH_STEP} * m)))::BIGINT AS score
        FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS n
        FROM scores WHERE score > 0
    )
    SELECT item_id, n::INT AS rank, doc_id, score FROM ranked WHERE n <= {K}
    """
