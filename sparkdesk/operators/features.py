"""N-gram vocabulary, TF-IDF and label features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
)
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdesk.functions.text import let, urgency_flag
from sparkdesk.functions.tokens import joined_words, ngrams, split_words, stop_words, terms
from sparkdesk.session import freed_shuffles, materialize, remove_path, small_batches, written

# Vocabulary settings of the ticket classifiers.
NGRAMS = (1, 2)
MIN_DF = 2
MAX_FEATURES = 50_000


# Vocabulary

# Terms that a task counts at once.
COUNTED_TERMS = 1 << 19
# Bytes of texts that are split into words at once.
SPLIT_BYTES = 1 << 22

STATS = "term string, df bigint, cf bigint"


def counted_terms(rows: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """``term, df, cf`` of terms and the rows that they stand in; null is no term."""
    found = terms.dictionary_encode()
    valid = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    codes = found.indices.take(pa.array(valid)).to_numpy().astype(np.int64)
    many = len(found.dictionary)
    pairs = np.unique(rows[valid] * max(many, 1) + codes)
    counts = [np.bincount(x, minlength=many) for x in (pairs % max(many, 1), codes)]
    return pa.RecordBatch.from_arrays(
        [found.dictionary, *[pa.array(n, pa.int64()) for n in counts]], ["term", "df", "cf"]
    )


def _cut_lists(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """The lists in pieces of up to ``COUNTED_TERMS`` items, of one list at least."""
    ends, at = np.cumsum(_list_sizes(lists)), 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + COUNTED_TERMS, side="right")))
        yield lists.slice(at, end - at)
        at = end


def _list_sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _item_rows(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), _list_sizes(lists))


def _totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_stats(df: DataFrame, term_list: str) -> DataFrame:
    """``term, df, cf``: rows holding the term and its occurrences in all rows.

    Terms are counted by the batch, so (row, term) pairs are neither made as rows nor shuffled;
    a term found everywhere is reduced before the shuffle.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in _cut_lists(batch.column(0)):
                yield counted_terms(_item_rows(lists), lists.flatten())

    return _totals(df.select(F.col(term_list)).mapInArrow(counted, STATS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def numbered_grams(
    lists: pa.ListArray, hi: int, marked: bool = False
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """The distinct 1- to ``hi``-grams of rows of words, one length after the other, as numbers.

    Gives the words, then of each n-gram the number of the shorter one that it begins with, its last
    word, the rows that hold it, its occurrences and, if ``marked``, a hash of its words.
    """
    rows, found = _item_rows(lists), lists.flatten().dictionary_encode()
    codes, names = found.indices.to_numpy().astype(np.int64), found.dictionary
    many, bits = len(names), len(lists).bit_length()
    hashes = marks = None
    if marked:
        hashes = np.array([zlib.crc32(w) for w in names.cast(pa.binary()).to_pylist()], np.uint64)
        hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15))
    heads = codes  # the number of the shorter n-gram that begins at a word
    for n in range(1, hi + 1):
        at = np.flatnonzero(rows[: max(len(rows) - n + 1, 0)] == rows[n - 1 :])
        if not len(at):
            return
        keys = codes if n == 1 else heads[at] * many + codes[at + n - 1]
        held = np.sort(keys << bits | rows[at])
        of = held >> bits
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        fresh = np.concatenate([[True], held[1:] != held[:-1]])  # once a row
        of, cf = of[first], np.diff(first, append=len(held))
        head, last = of // many, of % many
        if marked:
            own = hashes[last]
            marks = own if n == 1 else _mixed(marks[head] * np.uint64(0x9E3779B97F4A7C15) + own)
        yield names, head, last, np.add.reduceat(fresh.astype(np.int64), first), cf, marks
        if 1 < n < hi:
            heads = np.zeros(len(codes), np.int64)
            heads[at] = np.searchsorted(of, keys)


def counted_grams(
    lists: pa.ListArray, lo: int, hi: int, wanted: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """``term, df, cf`` of the ``lo``- to ``hi``-grams of rows of words, one length after the other.

    Words are numbered, and n-grams are counted as numbers; only distinct ones become texts, and of
    these only those in ``wanted`` buckets, if such are given.
    """
    shorter = None
    found = numbered_grams(lists, hi, wanted is not None)
    for n, (names, head, last, df, cf, marks) in enumerate(found, 1):
        kept = np.arange(len(cf))
        if wanted is not None and (n == hi or n == 1):  # others are parts of longer ones
            kept = np.flatnonzero(wanted[_buckets(marks)])
        grams = names.take(pa.array(last[kept]))
        if n > 1:
            grams = pc.binary_join_element_wise(shorter.take(pa.array(head[kept])), grams, " ")
        if n >= lo:
            yield pa.RecordBatch.from_arrays(
                [grams, pa.array(df[kept]), pa.array(cf[kept])], ["term", "df", "cf"]
            )
        shorter = names if n == 1 else grams


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """The words of texts joined by blanks, as many rows at a time as are counted at once."""
    for batch in batches:
        texts, at = batch.column(0), 0
        # before the cut: pyarrow's if_else gives wrong texts for a slice
        texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts)
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(ends):  # the words of a whole batch at once would take several times its size
            begun = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begun + SPLIT_BYTES, side="right")))
            yield from _cut_lists(pc.split_pattern(texts.slice(at, end - at), " "))
            at = end


def gram_stats(
    df: DataFrame, words: str, lo: int, hi: int, wanted: np.ndarray | None = None
) -> DataFrame:
    """``term_stats`` of the ``lo``- to ``hi``-grams of a column of words joined by blanks.

    With ``wanted`` buckets, n-grams of other ones may be missing.
    """
    packed = None if wanted is None else np.packbits(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if packed is None else np.unpackbits(packed, count=BUCKETS).view(bool)
        for lists in _word_lists(batches):
            yield from counted_grams(lists, lo, hi, some)

    return _totals(df.select(F.col(words)).mapInArrow(counted, STATS))


# Buckets, by a hash, in which n-grams are counted together, and buckets summed as one piece.
BUCKETS = 1 << 22
BUCKET_PIECE = 1 << 14
# Rows from which the rare n-grams are told by their buckets.
BUCKET_ROWS = 1 << 14


def _buckets(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def bucket_counts(df: DataFrame, words: str, lo: int, hi: int) -> np.ndarray:
    """Occurrences of all ``lo``- to ``hi``-grams of each bucket (job)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for lists in _word_lists(batches):
            for n, (*_, cf, marks) in enumerate(numbered_grams(lists, hi, True), 1):
                if n >= lo:
                    np.add.at(counts, _buckets(marks), cf)
        pieces = [counts[i : i + BUCKET_PIECE].tobytes() for i in range(0, BUCKETS, BUCKET_PIECE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "part"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = np.frombuffer(part.as_buffer(), np.int64)
                totals[piece] = totals[piece] + numbers if piece in totals else numbers.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())],
            ["piece", "part"],
        )

    schema = "piece int, part binary"
    cores = df.sparkSession.sparkContext.defaultParallelism
    sums = df.select(F.col(words)).mapInArrow(counted, schema).repartition(cores, "piece")
    found = sums.mapInArrow(added, schema).collect()
    return np.concatenate([np.frombuffer(r["part"], np.int64) for r in sorted(found)])


def frequent_grams(
    df: DataFrame,
    words: str,
    lo: int,
    hi: int,
    k: int | None,
    min_df: int | float = MIN_DF,
    max_df: int | float = 1.0,
    rows: int | None = None,
) -> pa.Table:
    """``vocab_topk`` of the ``gram_stats`` within document-frequency bounds (jobs).

    Most n-grams stand in one row. All are counted by buckets first, and a bucket holds each of its
    n-grams at most as often as all of them. So if ``k`` n-grams of the fuller buckets occur as
    often as such a bucket at least holds, no n-gram of another bucket is among the first ``k``, and
    the rare ones are neither made as texts nor shuffled. Otherwise emptier buckets are taken too,
    and all n-grams in the end.
    """
    with freed_shuffles(df.sparkSession), small_batches(df.sparkSession):
        least = 0
        if k is not None and 0 < k < BUCKETS and (rows or 0) >= BUCKET_ROWS:
            held = bucket_counts(df, words, lo, hi)
            least = int(np.partition(held, BUCKETS - k)[BUCKETS - k]) // 2
        while True:
            wanted = held >= least if least > 1 else None
            stats = _bounded(gram_stats(df, words, lo, hi, wanted), min_df, max_df, rows)
            top = vocab_topk(stats, k).toArrow()
            if wanted is None or top.num_rows == k and pc.min(top["cf"]).as_py() >= least:
                return top
            least //= 4


def _bounded(
    stats: DataFrame, min_df: int | float, max_df: int | float, rows: int | None
) -> DataFrame:
    if isinstance(min_df, float):
        stats = stats.where(F.col("df") >= F.lit(min_df) * rows)
    elif min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    if isinstance(max_df, int):
        stats = stats.where(F.col("df") <= max_df)
    elif max_df < 1.0:
        stats = stats.where(F.col("df") <= F.lit(max_df) * rows)
    return stats


def _row_count(df: DataFrame, min_df: int | float, max_df: int | float) -> int | None:
    """Rows, if a bound is a share of them (job)."""
    if isinstance(min_df, float) or isinstance(max_df, float) and max_df < 1.0:
        return df.agg(F.count("*")).scalar()
    return None


def vocab_df(
    df: DataFrame, term_list: str, min_df: int | float = MIN_DF, max_df: int | float = 1.0
) -> DataFrame:
    """Term statistics within document-frequency bounds: counts (int) or shares (float)."""
    rows = _row_count(df, min_df, max_df)
    return _bounded(term_stats(df, term_list), min_df, max_df, rows)


# Bytes of the kept n-grams of one length up to which they are shipped to the rows.
SHIPPED_GRAMS = 64 << 20


def grams_within(
    words: pa.ListArray, n: int, kept: Sequence[pa.Array | None]
) -> tuple[np.ndarray, pa.Array]:
    """The rows' ``n``-grams whose shorter n-grams were all kept, and the row of each.

    ``kept`` holds those of length 1 to n - 1, or None for a length of which all count.
    """
    flat, rows = words.flatten(), _item_rows(words)
    starts, grams = np.arange(len(flat)), flat
    for length, names in enumerate(kept[: n - 1], 1):
        if names is not None:
            good = np.flatnonzero(pc.is_in(grams, value_set=names).to_numpy(zero_copy_only=False))
            starts, grams = starts[good], grams.take(pa.array(good))
        # two neighbours make one longer n-gram, unless a row ends within it
        pairs = np.flatnonzero(starts[1:] == starts[:-1] + 1)
        pairs = pairs[rows[starts[pairs]] == rows[starts[pairs] + length]]
        starts = starts[pairs]
        grams = pc.binary_join_element_wise(
            grams.take(pa.array(pairs)), flat.take(pa.array(starts + length)), " "
        )
    return rows[starts], grams


@contextmanager
def vocab_levels(
    df: DataFrame,
    term_list: str,
    hi: int,
    min_df: int | float = MIN_DF,
    max_df: int | float = 1.0,
) -> Iterator[DataFrame]:
    """``vocab_df`` of 1- to ``hi``-grams, one length after the other (jobs).

    The single words of ``term_list``, in order, are written once; longer n-grams, which the list
    need not hold, are made of them. An n-gram stands in no more rows than the two (n-1)-grams in
    it, so only n-grams whose both parts were kept are made and counted. The upper bound is
    applied at the end, as a frequent n-gram may be part of a rarer one. If the kept n-grams of a
    length are too many to ship to the rows, all of them count as kept.
    """
    rows, levels, kept = _row_count(df, min_df, max_df), [], []
    spark = df.sparkSession
    with ExitStack() as tables:
        single = F.filter(term_list, lambda t: ~F.contains(t, F.lit(" ")))
        words = tables.enter_context(written(df.select(single.alias("words")), "words"))
        for n in range(1, hi + 1):
            shipped = spark.sparkContext.broadcast(list(kept))
            tables.callback(shipped.destroy)

            def counted(
                batches: Iterator[pa.RecordBatch], n: int = n, shipped=shipped
            ) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lists in _cut_lists(batch.column(0)):
                        yield counted_terms(*grams_within(lists, n, shipped.value))

            with freed_shuffles(spark):
                stats = _totals(words.mapInArrow(counted, STATS))
                levels.append(
                    tables.enter_context(written(_bounded(stats, min_df, 1.0, rows), "grams"))
                )
            if n < hi:
                size = levels[-1].agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
                fits = size <= SHIPPED_GRAMS
                kept.append(levels[-1].toArrow()["term"].combine_chunks() if fits else None)
        out = levels[0]
        for more in levels[1:]:
            out = out.unionByName(more)
        yield _bounded(out, 1, max_df, rows)


def vocab_topk(vocab: DataFrame, k: int | None = MAX_FEATURES) -> DataFrame:
    """The ``k`` most frequent terms, ties by term."""
    return vocab if k is None else vocab.orderBy(F.desc("cf"), "term").limit(k)


def idf(vocab: DataFrame, rows) -> DataFrame:
    """Smoothed inverse document frequency; ``rows`` is a count or a scalar column."""
    total = rows if hasattr(rows, "cast") else F.lit(rows)
    return vocab.withColumn("idf", F.log((1 + total) / (1 + F.col("df"))) + 1)


# TF-IDF stages

class TermExtractor(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Text to a list of n-gram terms without stop words."""

    lo = Param(Params._dummy(), "lo", "shortest n-gram", TypeConverters.toInt)
    hi = Param(Params._dummy(), "hi", "longest n-gram", TypeConverters.toInt)
    words = Param(Params._dummy(), "words", "stop words", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="terms", lo=1, hi=2, words=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="terms", lo=1, hi=2, words=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def words_col(self) -> str:
        """Column of the single words, joined by blanks, that stands in for the text."""
        return f"{self.getOutputCol()}_words"

    def with_words(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` plus the single words of which the terms are made."""
        if self.words_col in dataset.columns:
            return dataset
        text, stop = F.col(self.getInputCol()), self.getOrDefault(self.words)
        return dataset.withColumn(self.words_col, joined_words(text, stop))

    def settings(self) -> tuple:
        get = self.getOrDefault
        return (self.getInputCol(), self.getOutputCol(), get(self.lo), get(self.hi),
                tuple(get(self.words)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getOutputCol() in dataset.columns:
            return dataset  # extracted before, for several models with equal settings
        get = self.getOrDefault
        if self.words_col in dataset.columns:
            found = ngrams(split_words(F.col(self.words_col)), get(self.lo), get(self.hi))
        else:
            found = terms(F.col(self.getInputCol()), get(self.words), get(self.lo), get(self.hi))
        return dataset.withColumn(self.getOutputCol(), found)


# Sparse features are plain structs of the layout in which Spark stores a sparse vector: built-in
# expressions make and read them, and a written table of them reads back as vectors.
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def sparse_struct(size: Column, indices: Column, values: Column) -> Column:
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        size.cast("int").alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )


def sparse_column(df: DataFrame, name: str) -> Column:
    """A feature column as a struct, whether the table holds structs or vectors."""
    column = F.col(name)
    return F.unwrap_udt(column) if isinstance(df.schema[name].dataType, VectorUDT) else column


@contextmanager
def written_vectors(df: DataFrame, tag: str, *names: str) -> Iterator[DataFrame]:
    """``df`` as a table of the shared folder, the named feature structs read back as vectors.

    A table that holds vectors already comes from such a file and is not written again.
    """
    if all(isinstance(df.schema[n].dataType, VectorUDT) for n in names):
        yield df
        return
    _, path = materialize(df, tag)
    fields = [
        T.StructField(f.name, VectorUDT() if f.name in names else f.dataType, True) for f in df.schema
    ]
    try:
        yield df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
    finally:
        remove_path(df.sparkSession, path)


class RowWeights(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Term counts and their idf-scaled copy to weights of length 1, as a sparse struct."""

    scaledCol = Param(Params._dummy(), "scaledCol", "counts times idf", TypeConverters.toString)
    sublinear = Param(Params._dummy(), "sublinear", "damp counts", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="counts", scaledCol="scaled", outputCol="features", sublinear=True):
        super().__init__()
        self._setDefault(inputCol="counts", scaledCol="scaled", outputCol="features", sublinear=True)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts = F.unwrap_udt(F.col(self.getInputCol()))
        scaled = F.unwrap_udt(F.col(self.getOrDefault(self.scaledCol)))
        values = scaled["values"]
        if self.getOrDefault(self.sublinear):
            values = F.zip_with(values, counts["values"], lambda x, n: x / n * (1 + F.log(n)))

        def normal(x: Column) -> Column:
            squares = F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v)
            return let(F.sqrt(squares), lambda norm: F.transform(x, lambda v: v / norm))

        weights = sparse_struct(scaled["size"], scaled["indices"], let(values, normal))
        return dataset.withColumn(self.getOutputCol(), weights)


class UrgencyFlag(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """1 for texts with a word that asks for haste, else 0."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="urgent"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="urgent")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), urgency_flag(F.col(self.getInputCol())))


def _moved(places: Column, by: Column) -> Column:
    return F.transform(places, lambda i: i + by)


class SparseUnion(
    Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Sparse features and numbers side by side in one sparse struct; a null number is 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        none = {"indices": F.array().cast("array<int>"), "values": F.array().cast("array<double>")}
        width, places, values = F.lit(0), [], []
        for name in self.getInputCols():
            if isinstance(dataset.schema[name].dataType, T.NumericType):
                x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
                places.append(F.when(x != 0, F.array(width)).otherwise(none["indices"]))
                values.append(F.when(x != 0, F.array(x)).otherwise(none["values"]))
                width = width + 1
            else:
                part = sparse_column(dataset, name)
                places.append(_moved(part["indices"], width))
                values.append(part["values"])
                width = width + part["size"]
        both = sparse_struct(width, F.concat(*places), F.concat(*values))
        return dataset.withColumn(self.getOutputCol(), both)


class Tfidf(Estimator):
    """Fits a pipeline model from text to L2-normalised TF-IDF features (jobs).

    Only the bounded vocabulary and its weights reach the driver; transforming is
    narrow, without a shuffle. A table that holds the extractor's terms, or the words they are
    made of, isn't read for text.
    """

    # Whether the fitted stages read the text apart from its words.
    reads_text = False

    def __init__(
        self,
        input_col: str = "text",
        output_col: str = "features",
        ngram: tuple[int, int] = NGRAMS,
        min_df: int | float = MIN_DF,
        max_df: int | float = 1.0,
        max_features: int | None = MAX_FEATURES,
        sublinear: bool = True,
        words: Sequence[str] | None = None,
    ):
        super().__init__()
        if max_features is None and not (isinstance(min_df, float) and min_df > 0):
            raise ValueError("give max_features or a share as min_df, so the vocabulary is bounded")
        self.input_col, self.output_col = input_col, output_col
        self.ngram, self.min_df, self.max_df = ngram, min_df, max_df
        self.max_features, self.sublinear = max_features, sublinear
        self.words = stop_words() if words is None else list(words)

    def extractor(self) -> TermExtractor:
        return TermExtractor(
            inputCol=self.input_col,
            outputCol=f"{self.output_col}_terms",
            lo=self.ngram[0],
            hi=self.ngram[1],
            words=self.words,
        )

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        prefix = self.output_col
        extract = self.extractor()
        bounds = (self.min_df, self.max_df)
        rows = dataset.count()

        def weighed(top: DataFrame) -> pa.Table:
            return idf(top, rows).select("term", "idf").toArrow().sort_by("term")

        if f"{prefix}_terms" in dataset.columns:
            listed = dataset.select(f"{prefix}_terms")
        else:
            words = extract.with_words(dataset).select(extract.words_col)
            listed = words.select(split_words(F.col(extract.words_col)).alias(f"{prefix}_terms"))
        if self.ngram[0] == 1 and self.ngram[1] > 2:
            with vocab_levels(listed, f"{prefix}_terms", self.ngram[1], *bounds) as vocab:
                fitted = weighed(vocab_topk(vocab, self.max_features))
        elif f"{prefix}_terms" in dataset.columns:
            vocab = vocab_df(listed, f"{prefix}_terms", *bounds)
            fitted = weighed(vocab_topk(vocab, self.max_features))
        else:
            top = frequent_grams(
                words, extract.words_col, *self.ngram, self.max_features, *bounds, rows
            )
            fitted = weighed(dataset.sparkSession.createDataFrame(top))
        if fitted.num_rows == 0:
            raise ValueError("no terms remain after document-frequency pruning")
        # Fitting on the kept terms themselves, one per row, hands over the whole list
        # at once; the fitted model then tells each term's position. All terms are as frequent
        # there, so they come in one partition, whose order is the same in every fit.
        kept = dataset.sparkSession.createDataFrame(fitted).coalesce(1).select(
            "term", "idf", F.array("term").alias(f"{prefix}_terms")
        )
        counts = CountVectorizer(
            inputCol=f"{prefix}_terms", outputCol=f"{prefix}_counts", vocabSize=fitted.num_rows
        ).fit(kept)
        placed = counts.transform(kept).select(
            "term", "idf", F.get(F.unwrap_udt(f"{prefix}_counts")["indices"], 0).alias("idx")
        ).toArrow().sort_by("idx")
        model = PipelineModel(
            [
                extract,
                counts,
                ElementwiseProduct(
                    scalingVec=DenseVector(placed["idf"].to_numpy()),
                    inputCol=f"{prefix}_counts",
                    outputCol=f"{prefix}_scaled",
                ),
                RowWeights(
                    inputCol=f"{prefix}_counts",
                    scaledCol=f"{prefix}_scaled",
                    outputCol=prefix,
                    sublinear=self.sublinear,
                ),
            ]
        )
        model.terms = placed["term"].to_pylist()
        return model


class TextAndUrgency(Estimator):
    """Fits TF-IDF features with the urgency flag beside them, as one pipeline (jobs)."""

    reads_text = True

    def __init__(self, input_col: str = "text", output_col: str = "features", **options):
        super().__init__()
        self.output_col = output_col
        self.tfidf = Tfidf(input_col=input_col, output_col=f"{output_col}_text", **options)

    def extractor(self) -> TermExtractor:
        return self.tfidf.extractor()

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        text, flag = self.tfidf.output_col, f"{self.output_col}_urgent"
        return PipelineModel(
            [
                *self.tfidf.fit(dataset).stages,
                UrgencyFlag(inputCol=self.tfidf.input_col, outputCol=flag),
                SparseUnion(inputCols=[text, flag], outputCol=self.output_col),
            ]
        )


def tfidf_transform(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` plus the feature column, without the columns of the steps between.

    A table that has the column already is returned as it is.
    """
    out = model.stages[-1].getOutputCol()
    if out in df.columns:
        return df
    return model.transform(df).select(*df.columns, out)


def vocabulary(model: PipelineModel) -> list[str]:
    """Terms by vector position; a loaded model asks the JVM for them."""
    if not hasattr(model, "terms"):
        counts = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
        model.terms = list(counts.vocabulary)
    return model.terms


def tfidf_long(model: PipelineModel, df: DataFrame, row_id: str) -> DataFrame:
    """The non-zero weights as ``row_id, term, value`` rows."""
    out = model.stages[-1].getOutputCol()
    rows = tfidf_transform(model, df)
    vector = sparse_column(rows, out)
    entries = rows.select(
        row_id, F.inline_outer(F.arrays_zip(vector["indices"], vector["values"]))
    ).toDF(row_id, "idx", "value")
    words = vocabulary(model)
    names = df.sparkSession.createDataFrame(
        pa.table({"idx": pa.array(range(len(words)), pa.int32()), "term": words})
    )
    # The vocabulary is bounded by the fit, which also had to hold it on the driver.
    return entries.join(F.broadcast(names), "idx").select(row_id, "term", "value")


def feature_union(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """``df`` plus sparse features and number columns side by side."""
    return SparseUnion(inputCols=list(cols), outputCol=out).transform(df)


# Labels

def label_classes(df: DataFrame, col: str) -> list[str]:
    """Sorted class names of a label or label-list column (job).

    Classes become model outputs, so the caller holds one model or score per name anyway.
    """
    return label_table(df, col).orderBy("c").toArrow()["c"].to_pylist()


def label_table(df: DataFrame, col: str) -> DataFrame:
    """Distinct labels of a label or label-list column, as ``c``."""
    values = F.explode_outer(col) if dict(df.dtypes)[col].startswith("array") else F.col(col)
    return df.select(values.alias("c")).where(F.col("c").isNotNull()).distinct()


def multi_hot(
    df: DataFrame, labels: str, classes: Sequence[str] | None = None, out: str = "hot",
    kind: str = "int",
) -> DataFrame:
    """0/1 array over the sorted classes; ``kind="float"`` gives 32-bit floats."""
    if classes is None:
        classes = label_classes(df, labels)
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(
        out, F.transform(names, lambda c: F.array_contains(F.col(labels), c).cast(kind))
    )


def label_index(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Number the sorted distinct labels from 0 and add the number.

    The window sees one row per distinct label.
    """
    place = F.row_number().over(Window.orderBy("c")) - 1
    ids = label_table(df, label).select(F.col("c").alias(label), place.alias(out))
    return df.join(ids, label, "left")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight of each class: n / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg((F.sum("n") / F.count("*")).alias("t")).scalar()
    return counts.withColumn(out, total / F.col("n"))
