"""Embedding near-duplicates by hashing to the E8 lattice.

In each of several tables a vector is projected to two random 8-dimensional spaces, and each
projection is decoded to its nearest point of the E8 lattice; the two points are its cell. A
vector is filed under its own cell and also looks into the cells that differ by one of the
lattice's 240 shortest vectors, those nearest to it first. Vectors that meet in a cell and have
the same label are compared exactly, by cosine in double precision.

Equal vectors are represented by one row, so copies are never paired. A pair that shares its
own cell in several tables comes out of the first one only. A link of cosine 0.93 is found with
probability over 0.99 at the default settings, closer ones more surely; none below is reported.
With more vectors, choose smaller cells or more tables: the expected number of chance meetings
per vector is the number of vectors times the share of the space that its cells cover.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a
null label or id, link with nothing; vectors of different lengths are never compared; a
repeated row is a copy that is linked with its original; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdesk.llm.common import read, same
from sparkdesk.llm.components import components
from sparkdesk.session import materialize

TABLES = 8
BLOCKS = 2
PROBES = 6
# Cell size relative to the length of a projected unit vector.
CELL = 0.76
COSINE = 0.93
SEED = 4
# Vectors hashed or compared at once in a task.
CHUNK = 2048


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of 1/2 with an even
    number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            found.append(np.array(signs))
    return np.array(found)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: whole or all half-odd coordinates, of an even sum."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def _mixed(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers of rows of half-integer coordinates; equal rows get equal numbers."""
    out = np.full(len(points), salt, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Tables:
    """Projections of vectors of one length, and their cells."""

    def __init__(self, length: int, tables: int, blocks: int, probes: int, cell: float, seed: int):
        rng = np.random.default_rng([seed, length])
        self.blocks, self.probes = blocks, probes
        self.short = shortest_vectors()
        scale = cell * np.sqrt(8 / length)
        self.planes = []
        for _ in range(tables):
            plane = rng.normal(size=(length, 8 * blocks))
            plane = np.linalg.qr(plane)[0] if length >= 8 * blocks else plane / np.sqrt(length)
            self.planes.append((plane / scale, rng.uniform(size=8 * blocks)))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (rows, tables) and looked-into ones (rows, tables, blocks * probes)."""
        own, look = [], []
        for t, (plane, shift) in enumerate(self.planes):
            at = unit @ plane + shift
            parts, rests = [], []
            for b in range(self.blocks):
                x = at[:, 8 * b : 8 * b + 8]
                parts.append(nearest_e8(x))
                rests.append(x - parts[-1])
            marks = [_mixed(p, 2 * t + 1) for p in parts]
            own.append(self._join(marks))
            for b in range(self.blocks):
                nearest = np.argpartition(-(rests[b] @ self.short.T), self.probes, 1)[:, : self.probes]
                for k in range(self.probes):
                    moved = _mixed(parts[b] + self.short[nearest[:, k]], 2 * t + 1)
                    look.append(self._join([*marks[:b], moved, *marks[b + 1 :]]))
        return np.stack(own, 1), np.stack(look, 1).reshape(len(unit), len(self.planes), -1)

    @staticmethod
    def _join(marks: list[np.ndarray]) -> np.ndarray:
        out = np.zeros_like(marks[0])
        for m in marks:
            out = (out ^ m) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), pa.int64()))


def file_cells(vectors: DataFrame, **settings) -> DataFrame:
    """(rep, label, own, look) of vectors (rep, label, v): cell numbers, by table."""
    settings = {
        "tables": TABLES, "blocks": BLOCKS, "probes": PROBES, "cell": CELL, "seed": SEED, **settings
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for length in np.unique(lengths):
                if length not in made:
                    made[length] = Tables(int(length), **settings)
                rows = np.flatnonzero(lengths == length)
                for at in range(0, len(rows), CHUNK):
                    part = batch.take(pa.array(rows[at : at + CHUNK]))
                    x = _matrix(part.column(2))
                    own, look = made[length].cells(x / np.linalg.norm(x, axis=1)[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), _lists(own), _lists(look.reshape(len(x), -1))],
                        ["rep", "label", "own", "look"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("rep", "label", "v").mapInArrow(
        run, f"rep {kinds['rep']}, label {kinds['label']}, own array<bigint>, look array<bigint>"
    )


def candidates(filed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of one label that meet in a cell."""
    at = filed.select("rep", "label", "own", F.posexplode("own").alias("t", "cell"))
    index = at.select(
        F.col("rep").alias("b"), F.col("label").alias("of"), F.col("own").alias("b_own"), "t",
        F.col("cell").alias("filed"),
    )
    met = (F.col("label") == F.col("of")) & (F.col("cell") == F.col("filed"))
    earlier = F.arrays_overlap(F.slice("own", 1, F.col("t")), F.slice("b_own", 1, F.col("t")))
    together = at.drop("t").join(index, met & (F.col("rep") < F.col("b"))).where(~earlier)
    looked = filed.select("rep", "label", "own", F.explode("look").alias("cell"))
    apart = looked.join(index, met & (F.col("rep") != F.col("b")))
    apart = apart.where(~F.arrays_overlap("own", "b_own")).select(
        F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")
    )
    return together.select(F.col("rep").alias("a"), "b").unionAll(apart.distinct())


def verified(pairs: DataFrame, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The pairs whose cosine, in double precision, is ``cosine`` or more."""
    left = vectors.select(F.col("rep").alias("l"), F.col("v").alias("lv"))
    right = vectors.select(F.col("rep").alias("r"), F.col("v").alias("rv"))
    sides = pairs.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r"))
    sides = sides.where(F.size("lv") == F.size("rv")).select("a", "b", "lv", "rv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                for at in range(0, len(rows), CHUNK):
                    part = batch.take(pa.array(rows[at : at + CHUNK]))
                    x, y = _matrix(part.column(2)), _matrix(part.column(3))
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    y /= np.linalg.norm(y, axis=1)[:, None]
                    found = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= cosine)
                    kept = part.take(pa.array(found))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return sides.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    **settings,
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of the table."""
    table = rows.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    )
    finite = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("v", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    reps, _ = materialize(
        table.where(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")),
        "vectors",
    )
    pairs, _ = materialize(candidates(file_cells(reps, **settings)), "near")
    links, _ = materialize(verified(pairs, reps, cosine), "linked")

    sizes = reps.select(F.col("rep").alias("of"), "n")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes, F.col("b") == F.col("of")).groupBy("a").agg(F.sum("n").alias("others"))
    member = components(links)
    known = (
        reps.select(F.col("label").alias("of_label"), F.col("v").alias("of_v"), "rep", "n")
        .join(linked, F.col("rep") == F.col("a"), "left")
        .join(member, F.col("rep") == F.col("node"), "left")
        .select(
            "of_label", "of_v",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    found = table.withColumn("usable", usable).join(
        known,
        F.col("usable") & (F.col("label") == F.col("of_label")) & (F.col("v") == F.col("of_v")),
        "left",
    )
    component = F.coalesce("component", "id")
    return found.select(
        "id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        same(F.col("id"), component).alias("kept"),
    )


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")
