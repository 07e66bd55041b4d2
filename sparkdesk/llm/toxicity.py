"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut
into overlapping windows of bytes; a window that the toxic dictionary shortens more than the
ordinary one speaks for toxicity. How many bytes a window must gain is calibrated on labelled
texts, and so is the score made from the largest gain, the gains above that threshold and the
share of windows that reach it.

Toxic texts are mostly ordinary words. Their dictionary therefore holds only their words with a
part that stands in toxic texts several times as often as in ordinary ones, and in different
contexts (copies of one text repeat a word in the same context). It is laid over the ordinary
dictionary, so that windows without such words gain next to nothing.

The fit reads a bounded sample of labelled rows, ``SAMPLE_ROWS`` of either class at most and
texts up to ``SAMPLE_CHARS`` code points; scoring reads whole texts, whatever their length.

Cases: null and empty texts are one empty window and gain nothing; without labels of both
classes every score is the toxic share of the labels (0 without any); a label that a document
has twice counts as toxic if one is; repeated rows are scored each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.llm.common import fresh, read, seeded, whole

STEP, LENGTH = 48, 64
LEVEL = 6
ORDINARY_BYTES = 32 << 10
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
SEED = 7
# A telling part: the contexts in different toxic texts that it has at least; how many times as
# often it stands in toxic as in ordinary texts; and least sums of that rate's logarithm over its
# toxic texts, of which the calibration texts choose one.
LEAST_CONTEXTS, LEAST_RATE = 4, 4.0
EVIDENCE = (22.0, 30.0, 40.0, 60.0, 90.0)
LEAST_SCORE = 0.3
WORD = re.compile(r"\w+")
# Characters of the word parts that are looked for.
GRAM = 5


@dataclass
class Model:
    """Dictionaries, the gain a window needs, and the weights of the score's features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    gain: int = 1
    weights: list[float] = field(default_factory=list)
    share: float = 0.0

    def compressors(self) -> tuple:
        return _compress(self.ordinary), _compress(self.toxic + self.ordinary)


def _compress(content: bytes):
    """Compression to bare frames with a dictionary taken as it is."""
    options = zstd.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=LENGTH,
        dict_size=len(content),
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    if len(content) < 8:
        return zstd.ZstdCompressor(compression_params=options).compress
    prepared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(compression_params=options)
    return zstd.ZstdCompressor(dict_data=prepared, compression_params=options).compress


def gains(text: str, ordinary, toxic) -> np.ndarray:
    """Bytes that the toxic dictionary saves in every window, at least 0."""
    raw = text.lower().encode()
    count = max(1, -(-(len(raw) - (LENGTH - STEP)) // STEP))
    out = np.empty(count, np.int32)
    for i in range(count):
        window = raw[i * STEP : i * STEP + LENGTH]
        out[i] = len(ordinary(window)) - len(toxic(window))
    return np.maximum(out, 0)


def features(found: np.ndarray, gain: int) -> list[float]:
    hits = found >= gain
    return [
        1.0,
        float(min(found.max(), 16)) / 4,
        float(np.log1p(found[hits].sum())),
        float(np.sqrt(hits.mean())) * 4,
    ]


def _trained(size: int, samples: list[bytes], segment: int, width: int) -> bytes:
    """A trained dictionary, or the samples themselves if they are too few to train one."""
    joined = b" ".join(samples)
    if len(samples) < 16 or len(joined) < 4 * size:
        return joined[-size:]
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=width, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return joined[-size:]


def _grams(word: str) -> set[str]:
    """The strings of ``GRAM`` characters in a word between blanks."""
    padded = f" {word} "
    return {padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))}


def _texts_with(texts: list[str]) -> Counter:
    """In how many texts every word part stands."""
    count: Counter[str] = Counter()
    for text in texts:
        count.update({part for word in set(WORD.findall(text)) for part in _grams(word)})
    return count


def _distinctive(toxic: list[str], ordinary: list[str]) -> dict[str, float]:
    """The words with a part that tells toxic from ordinary texts, and their evidence; most telling last.

    Texts count once, however many copies there are.
    """
    toxic, ordinary = (list(dict.fromkeys(t.lower() for t in x)) for x in (toxic, ordinary))
    contexts: dict[str, set[str]] = defaultdict(set)
    holders: Counter[str] = Counter()
    for text in toxic:
        found = WORD.findall(text)
        holders.update(set(found))
        for before, word in zip(["", *found], found):
            for part in _grams(word):
                contexts[part].add(before)
    usual = _texts_with(ordinary)
    evidence: dict[str, float] = {}
    for part, n in _texts_with(toxic).items():
        n = min(n, len(contexts[part]))
        rate = (n + 0.5) / (len(toxic) + 1) * (len(ordinary) + 1) / (usual[part] + 0.5)
        weight = n * float(np.log(rate))
        if n >= LEAST_CONTEXTS and rate >= LEAST_RATE and weight >= EVIDENCE[0]:
            evidence[part] = weight
    telling = {w: max((evidence.get(part, 0.0) for part in _grams(w)), default=0.0) for w in holders}
    picked = [w for w in telling if telling[w]]
    return {w: telling[w] for w in sorted(picked, key=lambda w: (telling[w], holders[w], w))}


def _words_from(evidence: dict[str, float], least: float) -> bytes:
    """The words of at least that evidence, between blanks."""
    return " ".join(["", *(w for w, e in evidence.items() if e >= least), ""]).encode()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), ridge * len(y) ** 0.5 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _ranking(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a toxic text scores above an ordinary one."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[place]
    n = y.sum()
    return float((ranks[y == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n)))


def train(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """Fit on texts in a seeded order: the first two thirds make the dictionaries, the rest
    calibrates (all of them, where a class has fewer than 30 texts). ``share`` of all labelled
    texts is toxic."""
    if not toxic or not ordinary:
        return Model(share=share)
    few = min(len(toxic), len(ordinary)) < 30
    a, b = (len(x) if few else len(x) * 2 // 3 for x in (toxic, ordinary))
    base = _trained(ORDINARY_BYTES, [t.lower().encode() for t in ordinary[:b] if t], 256, 8)
    held = [(toxic, a, 1), (ordinary, b, 0)]
    rest = [(t, y) for texts, cut, y in held for t in (texts if few else texts[cut:])]
    y = np.array([y for _, y in rest])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    evidence = _distinctive(toxic[:a], ordinary)
    best, least_loss = Model(), np.inf
    for content in dict.fromkeys(_words_from(evidence, least) for least in EVIDENCE):
        model = Model(base, content, share=share)
        by = model.compressors()
        found = [gains(t, *by) for t, _ in rest]
        shares = {g: np.array([(f >= g).mean() for f in found]) for g in range(1, 9)}
        model.gain = max(shares, key=lambda g: _ranking(shares[g], y))
        x = np.array([features(f, model.gain) for f in found])
        w = _logistic(x, y, weight)
        model.weights = w.tolist()
        loss = float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)))
        if loss < least_loss:
            best, least_loss = model, loss
    return best


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> Model:
    """Train on ``rows`` texts of either class at most, the first ones in a seeded order."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("of"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .withColumn("draw", seeded(seed, F.col("of")))
    )
    counts = Counter({r["y"]: r["count"] for r in known.groupBy("y").count().collect()})
    share = counts[1] / max(1, counts[0] + counts[1])
    first = [known.where(F.col("y") == y).orderBy("draw", "of").limit(rows) for y in (1, 0)]
    sample = F.broadcast(first[0].unionByName(first[1]))  # two times ``rows`` small rows
    texts = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    texts = texts.where(F.length("text") <= SAMPLE_CHARS)
    got = (
        texts.join(sample, F.col("id") == F.col("of"))
        .dropDuplicates(["id"])
        .select("draw", "id", "y", "text")
        .collect()
    )
    got.sort(key=lambda r: (r["draw"], r["id"]))
    return train([r["text"] for r in got if r["y"] == 1], [r["text"] for r in got if r["y"] == 0], share)


def _score(batches: Iterator[pa.RecordBatch], model: Model, place: int, names: list[str]):
    by = model.compressors()
    weights = np.array(model.weights)
    for batch in batches:
        scores = []
        for text in batch.column(place):
            if not len(weights):
                scores.append(model.share)
                continue
            z = float(np.dot(features(gains(text.as_py() or "", *by), model.gain), weights))
            scores.append(1 / (1 + float(np.exp(-max(-30.0, min(30.0, z))))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)


def add_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns and ``out``, the probability of being toxic."""
    names = [*docs.columns, out]
    place = docs.columns.index(text_col)
    schema = docs.limit(0).withColumn(out, F.lit(0.0)).schema
    return docs.mapInArrow(lambda batches: _score(batches, model, place, names), schema)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that aren't held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score under the threshold, with the same columns."""
    (score,) = fresh(docs.columns, "toxic_score")
    kept = add_score(docs, model, text_col, score).where(F.col(score) < LEAST_SCORE)
    return kept.drop(score)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_score(docs, learn(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= LEAST_SCORE, 1).otherwise(0).alias("predicted"),
    )
