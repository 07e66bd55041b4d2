"""Scores to labels: sigmoid, softmax, arg-max and multi-label selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdesk.functions.text import let

# Multi-label selection and rounding of confidences.
THRESHOLD = 0.5
MAX_LABELS = 3
DIGITS = 4


def label_array(labels: Column | Sequence[str]) -> Column:
    return labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])


def sigmoid_scores(c: Column) -> Column:
    return F.transform(c, lambda x: 1 / (1 + F.exp(-x)))


def softmax_scores(c: Column) -> Column:
    """Max-shifted softmax; a single binary score ``d`` counts as ``[-d, d]``."""
    scores = let(
        c, lambda a: F.when(F.size(a) == 1, F.array(-F.get(a, 0), F.get(a, 0))).otherwise(a)
    )

    def shifted(a: Column) -> Column:
        return let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return let(total, lambda t: F.transform(e, lambda x: x / t))

    return let(let(scores, shifted), shares)


def _prediction(label: Column, score: Column, digits: int | None) -> Column:
    confidence = score if digits is None else F.round(score, digits)
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def decode_single(
    scores: Column, labels: Column | Sequence[str], digits: int | None = DIGITS
) -> Column:
    """Label and score of the first maximum."""
    names = label_array(labels)
    return let(
        F.struct(scores.alias("s"), F.array_max(scores).alias("m")),
        lambda v: _prediction(
            F.get(names, (F.array_position(v["s"], v["m"]) - 1).cast("int")), v["m"], digits
        ),
    )


def decode_multi(
    scores: Column,
    labels: Column | Sequence[str],
    threshold: float = THRESHOLD,
    cap: int = MAX_LABELS,
) -> Column:
    """Labels scoring at least ``threshold``, best first, at most ``cap``; else the best one.

    Equal scores keep the order of ``labels``.
    """
    names = label_array(labels)
    ranked = F.array_sort(
        F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("pos")))
    )

    def chosen(r: Column) -> Column:
        kept = F.filter(r, lambda x: -x["neg"] >= threshold)
        return F.when(F.size(kept) > 0, F.slice(kept, 1, cap)).otherwise(F.slice(r, 1, 1))

    return F.transform(
        let(ranked, chosen), lambda x: _prediction(F.get(names, x["pos"]), -x["neg"], DIGITS)
    )


def decode_logits(c: Column, labels: Column | Sequence[str], kind: str) -> Column:
    """Decode raw model outputs; ``kind`` is ``single`` or ``multi``."""
    if kind == "single":
        return decode_single(softmax_scores(c), labels)
    if kind == "multi":
        return decode_multi(sigmoid_scores(c), labels)
    raise ValueError(f"kind must be 'single' or 'multi', not {kind!r}")
