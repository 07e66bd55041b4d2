"""Periodic runs of words: scale-tiled detection with boundary Z-functions.

A run is a stretch of words with a smallest period q, of at least 4q words, that can't be
extended. Periods are searched by octave, P <= q < 2P. A document is exploded into overlapping
tiles, wide ones for large octaves: small octaves share tiles of 32 * TOP words, every larger
octave has tiles of 32P, and tiles overlap by a quarter. Tiles are dealt out and solved alone.

In a tile every P-th word is a boundary. A run's matches (places i with word i = word i + q)
number 3P or more, so they hold all 2P places after one of the boundaries at least. Hashes of
2P words, doubled octave by octave, tell for all boundaries at once which q may do that. Of a
boundary's q the smallest one counts: any larger one is a period of the same words, hence a
multiple of a shorter period. The forward and backward Z-functions at the boundary, compared
word by word, verify q and give the fragment of matches around it; a q whose words are a
repeated shorter word is dropped.

Fragments (document, period, interval) are shuffled by document and period and stitched where
they touch. Neighbouring boundaries and tiles overlap so far that the union is the whole run.

Cases: a null or empty text has no words and no runs; a long text is more tiles; documents are
told apart by id and text, so repeated rows share their runs, and each keeps them; a null id is an
id; an empty table gives no rows; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.functions.text import let
from sparkdesk.llm.common import Steps, fresh, read, whole, words

LEAST_LENGTH = 6
LEAST_POWER = 4
# The largest octave of the narrowest tiles.
TOP = 256
# Widths in units of the octave.
TILE, OVERLAP = 32, 8
# Words handled at once in a task, besides a single longer text.
WORDS = 1 << 19
CELLS = 1 << 21


def octaves(n: int) -> list[tuple[int, int]]:
    """(lowest, highest) octave of each size of tiles for a text of n words."""
    out, low, high = [], 1, 1
    if n < LEAST_LENGTH:
        return out
    while high < TOP and LEAST_POWER * 2 * high <= n:
        high *= 2
    out.append((low, high))
    low = 2 * TOP
    while LEAST_POWER * low <= n:
        out.append((low, low))
        low *= 2
    return out


def tiles(n: int) -> list[tuple[int, int, int, int]]:
    """(lowest, highest octave, start, end) of the tiles of a text of n words."""
    out = []
    for low, high in octaves(n):
        wide = max(high, TOP)
        step = (TILE - OVERLAP) * wide
        for start in range(0, max(1, n - OVERLAP * wide), step):
            out.append((low, high, start, min(n, start + TILE * wide)))
    return out


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so much in all, or of one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def cut_tiles(docs: DataFrame) -> DataFrame:
    """(key, low, high, start, codes) of texts (key, text): a number per word, equal for equal
    words of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1])
            for a, b in _slices((lengths // 4).tolist(), WORDS):
                split = [t.as_py().split() for t in texts[a:b]]
                coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
                rows, at = [], 0
                for i, own in enumerate(split):
                    for low, high, start, end in tiles(len(own)):
                        rows.append((a + i, low, high, start, codes[at + start : at + end].tobytes()))
                    at += len(own)
                row, low, high, start, cut = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row, pa.int64())), pa.array(low, pa.int32()),
                        pa.array(high, pa.int32()), pa.array(start, pa.int64()), pa.array(cut, pa.binary()),
                    ],
                    ["key", "low", "high", "start", "codes"],
                )

    return docs.mapInArrow(run, "key string, low int, high int, start bigint, codes binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def _z_functions(c: np.ndarray, at: np.ndarray, q: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """How far words i and i + q match forward from each boundary, 3P at most, and backward,
    P at most."""
    forward, backward = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    reach = np.arange(-octave, 3 * octave)
    rows = max(1, CELLS // len(reach))
    for s in range(0, len(at), rows):
        left = at[s : s + rows, None] + reach
        right = left + q[s : s + rows, None]
        inside = (left >= 0) & (right < len(c))
        same = inside & (c[np.where(inside, left, 0)] == c[np.where(inside, right, 0)])
        ahead, back = ~same[:, octave:], ~same[:, octave - 1 :: -1]
        forward[s : s + rows] = np.where(ahead.any(1), ahead.argmax(1), 3 * octave)
        backward[s : s + rows] = np.where(back.any(1), back.argmax(1), octave)
    return forward, backward


def _primitive(c: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from each boundary aren't a repeated shorter word."""
    out = np.ones(len(at), bool)
    for own in np.unique(q).tolist():
        rows = np.flatnonzero(q == own)
        for part in range(0, len(rows), max(1, CELLS // own)):
            some = rows[part : part + max(1, CELLS // own)]
            block = c[at[some][:, None] + np.arange(own)]
            for p in _primes(own):
                d = own // p
                out[some] &= (block[:, : own - d] != block[:, d:]).any(1)
    return out


def fragments(c: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(period, first match, end of matches) for the octaves from low to high of an array of
    word numbers; negative numbers occur once each and part texts."""
    w = _mixed(c.astype(np.int64).view(np.uint64) + np.uint64(1))
    octave = 1
    while octave <= high and len(w) > octave:
        # w becomes the hashes of 2 * octave words
        w = _mixed(w[:-octave] * np.uint64(0xD6E8FEB86659FD93) + w[octave:])
        if octave >= low and len(w) > octave:
            heads = np.repeat(w[: len(w) - octave : octave], octave)[: len(w) - octave]
            hits = np.flatnonzero(heads == w[octave:])
            while len(hits):
                boundary = hits // octave * octave
                at, first = np.unique(boundary, return_index=True)
                q = hits[first] + octave - at
                forward, backward = _z_functions(c, at, q, octave)
                real = forward >= 2 * octave
                sound = np.flatnonzero(real)
                sound = sound[_primitive(c, at[sound], q[sound])]
                yield q[sound], at[sound] - backward[sound], at[sound] + forward[sound]
                # where only the hashes were equal, the next q is tried
                again = np.isin(boundary, at[~real])
                again[first] = False
                hits = hits[again]
        octave *= 2


def solve_tiles(cut: DataFrame) -> DataFrame:
    """(key, period, low, high): stretches of matches found in each tile."""

    def solved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Tiles of the same octaves, side by side with a number of its own between them."""
        low, high = batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
        parts, starts, total = [], [], 0
        for i, codes in enumerate(batch.column(4)):
            starts.append(total)
            parts += [np.frombuffer(codes.as_buffer(), "<i4"), np.array([-2 - i], "<i4")]
            total += len(parts[-2]) + 1
        begins, offsets = np.array(starts, np.int64), batch.column(3).to_numpy()
        for period, first, end in fragments(np.concatenate(parts), low, high):
            tile = np.searchsorted(begins, first, side="right") - 1
            shift = offsets[tile] - begins[tile]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(tile, pa.int64())), pa.array(period, pa.int64()),
                    pa.array(first + shift, pa.int64()), pa.array(end + shift, pa.int64()),
                ],
                ["key", "period", "low", "high"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
            for pair in np.unique(sides, axis=0):
                group = batch.take(pa.array(np.flatnonzero((sides == pair).all(1))))
                sizes = [len(x.as_buffer()) // 4 for x in group.column(4)]
                for a, b in _slices(sizes, WORDS):
                    yield from solved(group.slice(a, b - a))

    return cut.mapInArrow(run, "key string, period bigint, low bigint, high bigint")


def stitch(found: DataFrame) -> DataFrame:
    """(key, start, length, period) of whole runs from fragments that touch."""
    ordered = Window.partitionBy("key", "period").orderBy("low", "high")
    reached = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("low") <= reached, 0).otherwise(1))
    run = F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    whole_runs = (
        opened.withColumn("run", run)
        .groupBy("key", "period", "run")
        .agg(F.min("low").alias("start"), F.max("high").alias("end"))
        .withColumn("length", F.col("end") - F.col("start") + F.col("period"))
    )
    enough = F.greatest(F.lit(LEAST_LENGTH), F.col("period") * LEAST_POWER)
    return whole_runs.where(F.col("length") >= enough).select("key", "start", "length", "period")


def key_of(id_col: Column, text: Column) -> Column:
    """A digest of a document's id and text."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), text))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, start, length, period) of every run, in words from 0; ``key`` is ``key_of`` the
    document. The table is written to the shared folder."""
    text = whole(F.col(text_col))
    keyed = docs.select(key_of(F.col(id_col), text).alias("key"), text.alias("text"))
    dealt = cut_tiles(keyed).repartition("key", "low", "start")
    steps = Steps(docs.sparkSession)
    found = steps.write(solve_tiles(dealt), "fragments")
    runs = steps.write(stitch(found), "runs")
    steps.drop("fragments")
    return runs


def with_runs(docs: DataFrame, runs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with an array of their runs (start, period, length), by start and period."""
    own, key = fresh(docs.columns, "own_key", "key")
    listed = runs.groupBy(F.col("key").alias(own)).agg(
        F.sort_array(F.collect_set(F.struct("start", "period", "length"))).alias(name)
    )
    keyed = docs.withColumn(key, key_of(F.col(id_col), whole(F.col(text_col))))
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    joined = keyed.join(listed, F.col(key) == F.col(own), "left")
    return joined.withColumn(name, F.coalesce(name, none)).drop(own, key)


def summarise(docs: DataFrame) -> DataFrame:
    """Per document (id, text, runs): the number of runs, the strongest one, a listing of all
    and the text without repeats, words joined by one space."""

    def strongest(runs: list[dict]) -> dict | None:
        best = None
        for r in runs:
            if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                best = r
        return best

    def kept(found: list[bytes], runs: list[dict]) -> bytes:
        steps = np.zeros(len(found) + 1, np.int64)
        for r in runs:
            steps[r["start"] + r["period"]] += 1
            steps[r["start"] + r["length"]] -= 1
        return b" ".join(found[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).cast(pa.binary()), []
            for text, listed in zip(texts, batch.column(2)):
                found, runs = text.as_py().split(), listed.as_py()
                best = strongest(runs)
                listing = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rest = kept(found, runs) if runs else b" ".join(found)
                milli = 1000 * best["length"] // best["period"] if best else None
                rows.append(
                    (
                        len(runs), *((best[c] for c in ("start", "length", "period")) if best else (None,) * 3),
                        milli, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(),
                    )
                )
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(c, pa.int64()) for c in columns[:5]]
                + [pa.array(c, pa.string()) for c in columns[5:]],
                ["doc_id", *names],
            )

    names = [
        "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ]
    kinds = ["bigint"] * 5 + ["string"] * 2
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return docs.mapInArrow(run, schema)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which every tenth, by the id's crc32, ends in repeats.

    With h the checksum and g = h / 10 (rounded down), the words from a = g % n on repeat the
    p = 1 + (n - a) / (3 + g % 8) words there. Other texts stay as they are.
    """
    text = whole(F.col("text"))
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))

    def planted(found: Column) -> Column:
        n, g = F.size(found).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")

        def ended(ends: Column) -> Column:
            a, p = ends["a"], ends["p"]
            head = F.slice(found, F.lit(1), a.cast("int"))
            unit = F.slice(found, (a + 1).cast("int"), p.cast("int"))
            times = F.ceil((n - a) / p).cast("int")
            tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - a).cast("int"))
            return F.array_join(F.concat(head, tail), " ")

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), ended)).otherwise("")

    told = F.when(h % 10 == 0, let(words(F.col("text")), planted)).otherwise(text)
    return docs.select("doc_id", told.alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = repeated(read(spark, sf_dir, "documents"))
    return summarise(with_runs(docs, find_runs(docs), "runs"))
