"""Fitting linear classifiers: L-BFGS whose losses and gradients Spark sums.

All labels of a model are fitted together. One evaluation is one pass over one table of
instances: every task multiplies its sparse rows with the coefficients of all labels that are
still open and adds up its part of the gradient; the parts are summed by pieces of the gradient,
so neither a task nor the driver holds more than one gradient at a time (labels x features
numbers, as the model), and a pass leaves no shuffle files behind.

Over many rows the descent begins where a rougher one over every eighth block of instances ended,
with the curvatures at that point. It ends, as without, when the gradient over all rows is small
enough, so only the number of passes over all rows depends on the start.

Features are used as they are. Spark ML's own solver scales every feature to unit variance
within, which makes the rare terms of a vocabulary badly conditioned: on the test tickets it needs
over ten times as many passes for the same objective.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdesk.operators.features import sparse_column
from sparkdesk.session import freed_shuffles, kept_near, small_batches

# A problem is solved when the norm of its gradient is this small a share of the summed row
# weights; common single-node solvers ask as much of the gradient's largest entry alone.
TOLERANCE = 1e-4
# Fewest and most steps that L-BFGS remembers, and the bytes on the driver up to which it does.
MEMORY = (10, 30)
MEMORY_BYTES = 256 << 20
# Numbers of the gradient that are summed as one piece.
PIECE = 1 << 14
# Rows of an instance block.
BLOCK_ROWS = 2048
# Numbers of a block that are worked on at once, which fit the processor's cache. A block holds no
# more (but one row at least), so its values stay small objects to the executors' memory.
ENTRIES = 1 << 15
# Every so many-th block takes part in the descent that gives the start, if all hold this many rows
# and a label is on both sides of this many of them; that descent ends this many times above the bound.
PART, PART_ROWS, PART_SIDE, ROUGH, ROUGH_TURNS = 8, 1 << 14, 20, 30, 100
# Share of the curvature at 0 that is counted at least at the start.
LEAST_BEND = 0.02


@dataclass(frozen=True)
class Objective:
    """c * weighted loss + half the squared norm of the coefficients.

    ``logistic`` leaves the intercept free and is softmax over the classes of a single-label
    model; ``squared_hinge`` counts the intercept among the coefficients.
    """

    loss: str = "logistic"
    c: float = 1.0
    max_iter: int = 1000
    tolerance: float = TOLERANCE

    def problems(self, width: int, coupled: bool) -> tuple[str, int]:
        kind = "softmax" if coupled and self.loss == "logistic" else self.loss
        return kind, 1 if kind == "softmax" else width


def logistic(max_iter: int = 1000, c: float = 1.0) -> Objective:
    return Objective("logistic", c, max_iter)


def linear_svm(max_iter: int = 1000, c: float = 1.0) -> Objective:
    return Objective("squared_hinge", c, max_iter)


def residuals(
    kind: str, margins: np.ndarray, hot: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted losses (row, label) and their derivatives by the decision values.

    ``hot`` is 1 where a row has a label; ``weights`` are those of rows without and with it.
    """
    if kind == "softmax":
        top = margins.max(axis=1, keepdims=True)
        log_total = top + np.log(np.exp(margins - top).sum(axis=1, keepdims=True))
        weight = (hot * weights[1]).sum(axis=1, keepdims=True)
        return hot * weight * (log_total - margins), weight * (np.exp(margins - log_total) - hot)
    weight = np.where(hot == 1, weights[1], weights[0])
    side = 2.0 * hot - 1
    z = margins * side
    if kind == "logistic":
        return weight * np.logaddexp(0, -z), -weight * side * np.exp(-np.logaddexp(0, z))
    if kind == "squared_hinge":
        gap = np.maximum(0, 1 - z)
        return weight * gap * gap, -2 * weight * side * gap
    raise ValueError(f"unknown loss {kind!r}")


def packed(table: DataFrame, width: int | None = None) -> DataFrame:
    """Blocks of instances (features, hot) with their place in a task, each column of a block in one
    binary value.

    Every pass reads them again, and Spark hands such values to Python without touching the
    numbers in them. Indices below a ``width`` of 65,536 take two bytes.
    """
    vector = sparse_column(table, "features")
    rows = table.select(
        F.transform("hot", lambda x: F.coalesce(x, F.lit(0)).cast("byte")).alias("hot"),
        vector["indices"].alias("indices"),
        vector["values"].alias("values"),
    )
    kind = index_kind(width)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                hot, indices, values = batch.slice(start, BLOCK_ROWS).columns
                sizes = np.asarray(indices.value_lengths(), np.int32)
                numbers = [hot.flatten(), indices.flatten(), values.flatten()]
                hot, indices, values = (x.to_numpy(zero_copy_only=False) for x in numbers)
                hot = hot.astype(np.int8).reshape(len(sizes), -1)
                for few, entries in row_pieces(sizes, ENTRIES):
                    parts = [hot[few], sizes[few], indices[entries].astype(kind), values[entries]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([place], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                        ["place", *names],
                    )
                    place += 1

    names = ["hot", "sizes", "indices", "values"]
    return rows.mapInArrow(blocks, ", ".join(["place int", *[f"`{n}` binary" for n in names]]))


def index_kind(width: int | None) -> type:
    return np.uint16 if width is not None and width <= 1 << 16 else np.int32


def _numbers(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """The numbers of all blocks of a batch, one block after the other, where they lie."""
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or held is None:
        return np.zeros(0, kind)
    return np.frombuffer(held, np.uint8)[ends[0] : ends[-1]].view(kind)


def curvature(
    kind: str, margins: np.ndarray, hot: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Second derivatives (row, label) of the weighted losses at decision values."""
    if kind == "softmax":
        shares = np.exp(margins - margins.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        return (hot * weights[1]).sum(axis=1, keepdims=True) * shares * (1 - shares)
    weight = np.where(hot == 1, weights[1], weights[0])
    if kind == "logistic":
        return weight * np.exp(-np.logaddexp(0, margins) - np.logaddexp(0, -margins))
    return weight * np.where(margins * (2.0 * hot - 1) < 1, 2.0, 0.0)


def row_pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Consecutive rows and their entries, up to ``most`` entries or one row at a time."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        begun = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield slice(at, end), slice(begun, int(ends[end - 1]))
        at = end


def decisions(
    sizes: np.ndarray, index: np.ndarray, value: np.ndarray, held: np.ndarray
) -> np.ndarray:
    """Decision values (row, label) of a block's rows; ``held`` has an intercept at its end."""
    margins = np.zeros((len(sizes), len(held)))
    filled = np.flatnonzero(sizes)
    if len(filled):
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[filled]
        for k, row in enumerate(held):
            margins[filled, k] = np.add.reduceat(row.take(index) * value, starts)
    return margins + held[:, -1]


def _summed(
    blocks: DataFrame,
    kind: str,
    coefficients: np.ndarray,
    weights: np.ndarray,
    chosen: np.ndarray,
    curved: bool = False,
    narrow: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Losses by label and gradient (label, feature and intercept) over all blocks (job).

    ``coefficients`` and ``weights`` are those of the ``chosen`` places of the blocks' labels.
    With ``curved`` the second derivatives there are summed instead of the gradient, and the losses
    have two more rows: the rows with and without each label. ``narrow`` blocks were packed for a
    width that their indices need two bytes for.
    """
    labels, width = coefficients.shape
    spark = blocks.sparkSession
    shipped = spark.sparkContext.broadcast(np.ascontiguousarray(coefficients))
    heads = (3 if curved else 1) * labels
    types = (np.int8, np.int32, np.uint16 if narrow else np.int32, np.float64)

    def part(held, hot, sizes, index, value, sums, gradient) -> None:
        index = index.astype(np.int64)
        margins = decisions(sizes, index, value, held)
        loss, slope = residuals(kind, margins, hot, weights)
        sums[0] += loss.sum(axis=0)
        if curved:
            slope, value = curvature(kind, margins, hot, weights), value * value
            sums[1] += (hot == 1).sum(axis=0)
            sums[2] += (hot != 1).sum(axis=0)
        for k in range(labels):
            spread = np.repeat(slope[:, k], sizes)
            spread *= value
            gradient[k, :-1] += np.bincount(index, spread, width - 1)
        gradient[:, -1] += slope.sum(axis=0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        sums, gradient = np.zeros((heads // labels, labels)), np.zeros((labels, width))
        for batch in batches:
            hot, sizes, index, value = (_numbers(c, k) for c, k in zip(batch.columns, types))
            if not len(sizes):
                continue
            hot = hot.reshape(len(sizes), -1)[:, chosen]
            for rows, entries in row_pieces(sizes, max(ENTRIES, width)):
                part(held, hot[rows], sizes[rows], index[entries], value[entries], sums, gradient)
        flat = np.concatenate([sums.ravel(), gradient.ravel()])
        pieces = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "part"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = np.frombuffer(part.as_buffer(), np.float64)
                if piece in totals:
                    totals[piece] += numbers
                else:
                    totals[piece] = numbers.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())],
            ["piece", "part"],
        )

    schema = "piece int, part binary"
    pieces = -(-(heads + labels * width) // PIECE)
    try:
        with freed_shuffles(spark):
            sums = (
                blocks.select("hot", "sizes", "indices", "values").mapInArrow(parts, schema)
                .repartition(min(pieces, spark.sparkContext.defaultParallelism), "piece")
                .mapInArrow(added, schema).collect()
            )
    finally:
        shipped.destroy()
    flat = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(sums)])
    losses = flat[:heads].reshape(-1, labels) if curved else flat[:heads]
    return losses, flat[heads:].reshape(labels, width)


class Descent:
    """L-BFGS on one smooth problem, told the value and gradient at ``trial`` one at a time.

    ``scale`` holds the second derivatives at the start, which stand for the curvature that the
    remembered steps don't know: frequent terms and intercepts bend far more than rare terms.
    """

    def __init__(self, start: np.ndarray, scale: np.ndarray, small: float, memory: int):
        self.point, self.trial, self.scale = start, start, scale
        self.small, self.memory = small, memory
        self.value = self.slope = self.way = None
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.turns, self.tries, self.step, self.fall = 0, 0, 1.0, 0.0
        self.stuck = False

    @property
    def norm(self) -> float:
        return float(np.linalg.norm(self.slope))

    def ended(self, max_iter: int) -> bool:
        return self.stuck or self.norm <= self.small or self.turns >= max_iter

    def told(self, value: float, slope: np.ndarray) -> None:
        if self.value is not None:
            # a value may not fall any more within the precision of its sum
            slack = 1e-14 * abs(self.value)
            if not value <= self.value + 1e-4 * self.step * self.fall + slack:
                missed = max(value - self.value - self.step * self.fall, 1e-300)
                shorter = -self.fall * self.step**2 / (2 * missed)
                self.step = float(np.clip(shorter, 0.1 * self.step, 0.5 * self.step))
                self.tries += 1
                self.stuck = self.tries >= 30
                self.trial = self.point + self.step * self.way
                return
            made, turned = self.trial - self.point, slope - self.slope
            if made @ turned > 0:
                self.pairs = [*self.pairs, (made, turned, float(made @ turned))][-self.memory :]
            self.turns, self.tries = self.turns + 1, 0
        self.point, self.value, self.slope = self.trial, value, slope
        self._aim()

    def _aim(self) -> None:
        way, shares = -self.slope, []
        for made, turned, curve in reversed(self.pairs):
            shares.append((made @ way) / curve)
            way = way - shares[-1] * turned
        way = way / self.scale
        if self.pairs:
            _, turned, curve = self.pairs[-1]
            way = way * (curve / (turned @ (turned / self.scale)))
        for (made, turned, curve), share in zip(self.pairs, reversed(shares)):
            way = way + (share - (turned @ way) / curve) * made
        if way @ self.slope >= 0:
            way = -self.slope / self.scale
        self.way, self.fall, self.step = way, float(way @ self.slope), 1.0
        self.trial = self.point + way


def minimise(
    evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    start: np.ndarray,
    scale: np.ndarray,
    small: np.ndarray,
    max_iter: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Independent smooth problems, one per row of ``start``, by L-BFGS side by side.

    ``evaluate`` gives the value and gradient of some rows at one point for each. Every problem
    has its own steps, and one that has ended is not evaluated any more. Ends when the norm of each
    gradient is at most its ``small``; gives the points, those norms and the number of iterations.
    """
    memory = int(np.clip(MEMORY_BYTES // (2 * start.nbytes or 1), *MEMORY))
    found = [Descent(x, s, limit, memory) for x, s, limit in zip(start, scale, small)]
    open_ = np.arange(len(found))
    while len(open_):
        values, slopes = evaluate(np.stack([found[i].trial for i in open_]), open_)
        for i, value, slope in zip(open_, values, slopes):
            found[i].told(value, slope)
        open_ = np.array([i for i in open_ if not found[i].ended(max_iter)], int)
    points, norms = np.stack([d.point for d in found]), np.array([d.norm for d in found])
    return points, norms, max(d.turns for d in found)


def solve(
    table: DataFrame,
    width: int,
    weights: np.ndarray,
    totals: np.ndarray,
    objective: Objective,
    coupled: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts of all labels of ``table`` (features, hot) (jobs).

    Passes read the packed instances from the executors' memory or disks; what is lost is packed
    again from ``table``, which is to be a written one.

    ``weights`` holds the weights of rows without and with each label, ``totals`` each label's
    summed row weight. ``coupled`` makes the labels the classes of one softmax.
    """
    labels = weights.shape[1]
    kind, problems = objective.problems(labels, coupled)
    free_intercept = kind != "squared_hinge"
    penalty = np.ones((labels, width + 1))
    if free_intercept:
        penalty[:, -1] = 0

    narrow = index_kind(width) is np.uint16

    def places(chosen: np.ndarray) -> np.ndarray:
        return np.arange(labels).reshape(problems, -1)[chosen].ravel()

    def summed_over(some: DataFrame, c: float, those: np.ndarray) -> Callable:
        """Values and gradients of ``those`` problems, with the losses of some blocks times ``c``."""
        def evaluate(point: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = places(those[chosen])
            held = point.reshape(len(at), width + 1)
            losses, gradient = _summed(some, kind, held, weights[:, at], at, narrow=narrow)
            penalised = penalty[at] * held
            value = c * losses + 0.5 * (penalised * penalised).sum(1)
            slope = c * gradient + penalised
            return value.reshape(len(chosen), -1).sum(1), slope.reshape(len(chosen), -1)

        return evaluate

    def bent(some: DataFrame, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of all problems, rows with and without each label, and second derivatives."""
        held = point.reshape(labels, width + 1)
        sums, bends = _summed(some, kind, held, weights, np.arange(labels), True, narrow)
        values = objective.c * sums[0] + 0.5 * ((penalty * held) ** 2).sum(1)
        return values.reshape(problems, -1).sum(1), sums[1:], bends

    def scaled(bends: np.ndarray) -> np.ndarray:
        scale = objective.c * bends + penalty
        return np.where(scale > 0, scale, 1.0).reshape(problems, -1)

    def begun(blocks: DataFrame, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the descents begin, and the curvatures there."""
        values, sides, bends = bent(blocks, start)
        rows = sides[:, 0].sum()
        if rows < PART_ROWS:
            return start, scaled(bends)
        near = start.copy()
        with kept_near(blocks.where(F.col("place") % PART == 0)) as some:
            _, sides, _ = bent(some, start)
            enough = (sides >= PART_SIDE).all(axis=0).reshape(problems, -1).all(axis=1)
            those = np.flatnonzero(enough)
            if not len(those):
                return start, scaled(bends)
            near[those], _, _ = minimise(
                summed_over(some, objective.c * rows / sides[:, 0].sum(), those), start[those],
                scaled(bends)[those], ROUGH * small[those], min(ROUGH_TURNS, objective.max_iter),
            )
        lower, _, there = bent(blocks, near)
        used = lower < values  # a poor start is none
        there = np.where(np.repeat(used, labels // problems)[:, None], np.maximum(there, LEAST_BEND * bends), bends)
        return np.where(used[:, None], near, start), scaled(there)

    small = objective.tolerance * totals.reshape(problems, -1).max(1)
    start = np.zeros((problems, labels * (width + 1) // problems))
    with small_batches(table.sparkSession), kept_near(packed(table, width)) as blocks:
        start, scale = begun(blocks, start)
        evaluate = summed_over(blocks, objective.c, np.arange(problems))
        found, norms, turns = minimise(evaluate, start, scale, small, objective.max_iter)
    if (norms > small).any():
        warnings.warn(
            f"{int((norms > small).sum())} of {problems} fits ended after {turns} iterations above "
            f"the tolerance: gradients up to {(norms / small).max():.3g} times the bound",
            stacklevel=2,
        )
    held = found.reshape(labels, width + 1)
    return held[:, :-1].copy(), held[:, -1].copy()
