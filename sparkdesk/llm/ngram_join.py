"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their hashes. It is cut into fragments; a
document's set falls into one part per fragment. Two documents with a Jaccard similarity of at
least t differ in d shingles at most, so of many fragments all but d agree. A document
files its first d + 1 parts that aren't empty, d by its own size: two similar documents share
one of those, since among the leading fragments that both of them file at most d differ.
Documents with too few filled parts also file the leading shingles that a prefix filter needs.
Both are exact. The number of fragments follows from a range of set sizes, and a document files
parts for its own range and for a lower one in which partners may be.

Documents that share a part are compared: a pair's overlap is counted in each of a few wide
fragments on its own, and the partial overlaps are summed per pair. The leading fragments are
counted first; a pair that differs too much in them already is not compared further.

Equal sets are one node. A shared part first links its documents with its smallest and its
largest node only; pairs inside a component that has formed are not compared, as they add no
link between different components. Pairs across components that share a part are all compared,
so no component is left in two. A group of near copies therefore costs about its size, not its
square. Parts that very many documents share, those of a passage that stands in all of them,
say little about similarity. The documents that still share a part across components therefore
file anew, all of them alike: their d + 1 rarest parts instead of the first ones, by the counts
among these documents. The rarest part in which two similar documents agree has at most d
others before it in either order, so it is filed by both. A part is first compared with a few
documents drawn from it, which joins most of what still belongs together; then all pairs
across the components left are compared. Two documents meet at the lower of their ranges only,
and not in a part if they share one shortly before it: a row carries the parts before its own,
a fixed number of them, so a pair makes about one row, not one for every part it shares.

A pair is compared only if its sketches allow the similarity. A sketch has one bit for every
residue of a hash, the parity of the shingles that fall on it; the bits in which two sketches
differ are at most the shingles in which the sets differ, so no similar pair is lost.

Cases: a text without words, empty or null, has an empty set and is linked with nothing; equal
texts are linked; rows with a null id count as documents, but the smallest id of a component is
taken over known ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.llm.common import Steps, fresh, read, same
from sparkdesk.llm.components import components
from sparkdesk.llm.shingles import mixed, shingle_sets

# Set sizes of one range differ by this factor at most.
RANGE = 1.5
# Fragments that overlaps are counted in, and those of them that are counted first.
COUNTED, LEADING = 8, 2
BATCH_ROWS = 512
# Bits of a sketch for every shingle, at least.
SKETCH_BITS = 2
# Documents of a part that all others in it are compared with, before all pairs are.
CENTRES = 4
# Parts before its own that a filed row carries.
BEFORE = 16


class Filing:
    """Which parts of a set are filed, for a similarity of ``of`` / 100."""

    def __init__(self, of: int):
        self.of = of
        self.ranges: list[tuple[int, int, int]] = []  # smallest and largest size, fragments
        self._upto = 1

    def _grow(self, size: int) -> None:
        while self._upto <= size:
            low = self._upto
            high = max(low, int(low * RANGE))
            d = high * (100 - self.of) // self.of
            self.ranges.append((low, high, d + d // 4 + 2 if d else 1))
            self._upto = high + 1

    def levels(self, found: np.ndarray, every: bool = False) -> Iterator[tuple]:
        """(parts, d + 1, leading shingles) of a set of sorted hashes, for its own range and the
        lower ones in which partners may be: 64-bit numbers of the first d + 1 parts, or of
        ``every`` part; leading shingles only if the parts are too few."""
        size, of = len(found), self.of
        self._grow(size)
        top = found >> np.uint64(32)
        for level in range(len(self.ranges) - 1, -1, -1):
            low, high, fragments = self.ranges[level]
            if low > size:
                continue
            if high * 100 < size * of:  # all partners of this range are too small
                break
            # the largest difference from a partner: of any size in the own range, else the smaller
            d = size * (100 - of) // of if size <= high else (size + high) * (100 - of) // (100 + of)
            place = (top * np.uint64(fragments)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            leading = size - -(-size * of // 100) + 1 if len(first) <= d else 0
            upto = size if every or len(first) <= d + 1 else int(first[d + 1])
            first = first if every else first[: d + 1]
            sums = np.add.reduceat(mixed(found[:upto]), first)
            key = np.uint64((level << 32) + 1) + place[first]
            prefix = mixed(found[:leading] + np.uint64(level) + _PREFIX)
            yield mixed(mixed(sums) ^ mixed(key)), d + 1, prefix

    def parts(self, found: np.ndarray) -> np.ndarray:
        """What a set of sorted hashes files at first."""
        return np.concatenate([x for parts, _, prefix in self.levels(found) for x in (parts, prefix)])


_PREFIX = np.uint64(0x5851F42D4C957F2D)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def set_name(found: np.ndarray) -> int | None:
    """A set's 64-bit number, none for the empty set."""
    if not len(found):
        return None
    whole = np.add.reduce(mixed(found), keepdims=True) + mixed(np.uint64([len(found)]))
    return int(mixed(whole).view(np.int64)[0])


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the hashes on each of their residues, 64 to a number; the residues are a
    power of two, so a sketch folds to a smaller one by halves."""
    bits = 64
    while bits < SKETCH_BITS * len(found):
        bits *= 2
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _list_of(pieces: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
    flat = np.concatenate([*pieces, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def file_documents(docs: DataFrame, n: int, of: int) -> DataFrame:
    """(id, size, node, sketch, parts) of documents (id, text); ``node`` names the set, null if
    empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filing = Filing(of)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                sets = shingle_sets(_texts(part.column(1)), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_name(s) for s in sets], pa.int64()),
                        _list_of([sketch(s) for s in sets]),
                        _list_of([filing.parts(s) if len(s) else s for s in sets]),
                    ],
                    ["id", "size", "node", "sketch", "parts"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(
        run, f"id {kind}, size bigint, node bigint, sketch array<bigint>, parts array<bigint>"
    )


def _named_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows (node, size, text) whose text has the set ``node``, and their sets, batch by batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            sets = shingle_sets(_texts(part.column(2)), n)
            names = part.column(0).to_pylist()
            right = [i for i, s in enumerate(sets) if set_name(s) == names[i]]
            yield part.take(pa.array(right, pa.int32())), [sets[i] for i in right]


def every_part(docs: DataFrame, n: int, of: int) -> DataFrame:
    """(node, level, needed, parts) of documents (node, size, text): all parts of a set for each
    range of sizes, and how many of them must be filed. Where they are too few, leading shingles
    are among them and all must be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filing = Filing(of)
        for taken, sets in _named_sets(batches, n):
            nodes, levels, needed, parts = [], [], [], []
            for node, found in zip(taken.column(0).to_pylist(), sets):
                for level, (all_of, least, prefix) in enumerate(filing.levels(found, every=True)):
                    nodes.append(node)
                    levels.append(level)
                    needed.append(len(all_of) + len(prefix) if len(prefix) else least)
                    parts.append(np.concatenate([all_of, prefix]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(levels, pa.int32()), pa.array(needed, pa.int32()), _list_of(parts)],
                ["node", "level", "needed", "parts"],
            )

    return docs.select("node", "size", "text").mapInArrow(
        run, "node bigint, level int, needed int, parts array<bigint>"
    )


def wide_fragments(docs: DataFrame, n: int) -> DataFrame:
    """(node, size, leading, rest) of documents (node, size, text): a set's parts in wide
    fragments. Rows whose text has another set than ``node`` are left out."""
    bounds = [np.uint64(i * (1 << 64) // COUNTED) for i in range(1, COUNTED)]

    def nested(sets: list[np.ndarray], first: int, last: int) -> pa.ListArray:
        pieces = []
        for found in sets:
            cuts = [0, *np.searchsorted(found, bounds).tolist(), len(found)]
            pieces += [found[cuts[f] : cuts[f + 1]] for f in range(first, last)]
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * (last - first)
        return pa.ListArray.from_arrays(pa.array(offsets), _list_of(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for taken, sets in _named_sets(batches, n):
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), nested(sets, 0, LEADING), nested(sets, LEADING, COUNTED)],
                ["node", "size", "leading", "rest"],
            )

    return docs.select("node", "size", "text").mapInArrow(
        run, "node bigint, size bigint, leading array<array<bigint>>, rest array<array<bigint>>"
    )


def _partial(column: str) -> Column:
    """Overlaps of two sets counted fragment by fragment, and summed."""
    each = F.zip_with(f"l_{column}", f"r_{column}", lambda x, y: F.size(F.array_intersect(x, y)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _elements(column: str) -> Column:
    return F.aggregate(column, F.lit(0), lambda total, x: total + F.size(x))


def _with_sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    left = sets.select(F.col("node").alias("l"), *[F.col(c).alias(f"l_{c}") for c in columns])
    right = sets.select(F.col("node").alias("r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    return pairs.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r"))


def count_overlaps(pairs: DataFrame, sets: DataFrame, of: int, steps: Steps, tag: str) -> DataFrame:
    """The pairs (a, b) with 100 * overlap >= of * union, written."""
    both = F.col("l_size") + F.col("r_size")
    most = F.expr(f"(l_size + r_size) * {100 - of} div {100 + of}")
    apart = _elements("l_leading") + _elements("r_leading") - 2 * F.col("overlap")
    begun = (
        _with_sides(pairs, sets, "size", "leading")
        .withColumn("overlap", _partial("leading"))
        .where(apart <= most)
        .select("a", "b", "overlap")
        .distinct()
    )
    begun = steps.write(begun, f"{tag}-begun")
    overlap = F.col("overlap") + _partial("rest")
    found = (
        _with_sides(begun, sets, "size", "rest")
        .where(100 * overlap >= of * (both - overlap))
        .select("a", "b")
        .distinct()
    )
    found = steps.write(found, tag)
    steps.drop(f"{tag}-begun")
    return found


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link_sets(docs: DataFrame, n: int = 5, of: int = 80) -> DataFrame:
    """(id, size, component) of documents (id, text); ``component`` is a set's name, null if
    the set is empty. Written to the shared folder."""
    steps = Steps(docs.sparkSession)
    filed = steps.write(file_documents(docs, n, of), "filed")
    named = filed.where(F.col("node").isNotNull()).groupBy("node")
    named = named.agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    named = steps.write(named, "named")
    listed = steps.write(filed.select("id", "size", "node"), "listed")

    parts = filed.select("node", F.explode("parts").alias("part"))
    shared = parts.groupBy("part").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.where(F.col("low") < F.col("high")).withColumnRenamed("part", "at")
    met = parts.join(shared, F.col("part") == F.col("at")).select("part", "node", "low", "high")
    met = steps.write(met.distinct(), "met")
    steps.drop("filed")

    stars = met.where(F.col("node") > F.col("low")).select(*_pair("node", "low"))
    stars = stars.unionAll(met.where(F.col("node") < F.col("high")).select(*_pair("node", "high")))
    stars = steps.write(_maybe_similar(stars.distinct(), named, of), "stars")

    nodes = stars.select(F.col("a").alias("of")).unionAll(stars.select(F.col("b").alias("of")))
    sets = steps.write(_sets(docs, named, nodes.distinct(), n), "sets")
    links = count_overlaps(stars, sets, of, steps, "linked")
    steps.drop("stars", "sets")
    member = steps.write(components(links), "members")

    # what shares a part across components and has met neither end of the star
    known = member.select(F.col("node").alias("of"), "component")
    placed = met.join(known, F.col("node") == F.col("of"), "left").select(
        "part", "node", "low", "high", F.coalesce("component", "node").alias("component")
    )
    apart = placed.groupBy(F.col("part").alias("at")).agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    )
    apart = apart.where(F.col("least") < F.col("most"))
    placed = placed.where((F.col("node") != F.col("low")) & (F.col("node") != F.col("high")))
    placed = placed.join(apart, F.col("part") == F.col("at")).select("node", "component").distinct()
    placed = steps.write(placed, "placed")
    steps.drop("met")
    texts = _texts_of(docs, named, placed.select(F.col("node").alias("of")))
    rare = steps.write(_rarest(every_part(texts, n, of)), "rare")

    def compared(pairs: DataFrame, tag: str) -> DataFrame:
        pairs = steps.write(pairs.distinct(), tag)
        ends = pairs.select(F.col("a").alias("of")).unionAll(pairs.select(F.col("b").alias("of")))
        sets = steps.write(_sets(docs, named, ends.distinct(), n), f"{tag}-sets")
        more = count_overlaps(pairs, sets, of, steps, f"{tag}-linked")
        steps.drop(tag, f"{tag}-sets")
        return more

    more = compared(_with_centres(rare, placed, named, of), "centres")
    joined = steps.write(_joined(placed, more), "joined")
    more = more.unionAll(compared(_across(rare, _renamed(placed, joined), named, of), "rest"))
    steps.drop("rare")
    joined = steps.write(_joined(placed, more), "joined-all")
    found = listed.join(
        member.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left"
    )
    found = found.select("id", "size", F.coalesce("component", "node").alias("component"))
    found = _renamed(found, joined)
    found = steps.write(found, "components")
    steps.drop(*[tag for tag in list(steps.paths) if tag != "components"])
    return found


def _rarest(filed: DataFrame) -> DataFrame:
    """(node, part, own, before) of (node, level, needed, parts): the ``needed`` rarest parts of a
    level, by how many nodes have them, without those that only one has. ``own`` marks those of
    the node's own range of sizes; ``before`` holds the next smaller parts of the same level."""
    # repeated rows of one id and text give a set twice
    held = filed.dropDuplicates(["node", "level"]).select(
        "node", "level", F.size("parts").alias("total"), "needed", F.explode("parts").alias("part")
    )
    counts = held.groupBy(F.col("part").alias("at")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    held = held.join(counts, F.col("part") == F.col("at"))
    of_level = Window.partitionBy("node", "level")
    # parts of one node alone come before all others
    alone = F.col("total") - F.count("*").over(of_level)
    rank = alone + F.row_number().over(of_level.orderBy("n", "part"))
    held = held.withColumn("rank", rank).where(F.col("rank") <= F.col("needed"))
    nearest = of_level.orderBy("part").rowsBetween(-BEFORE, -1)
    return held.select(
        "node", "part", (F.col("level") == 0).alias("own"), F.collect_list("part").over(nearest).alias("before")
    )


def _placed_parts(filed: DataFrame, placed: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``filed`` with their node's component, size and sketch."""
    known = placed.join(named.select(F.col("node").alias("at"), "size", "sketch"), F.col("node") == F.col("at"))
    known = known.select(F.col("node").alias("of"), "component", "size", "sketch")
    return filed.join(known, F.col("node") == F.col("of")).drop("of")


def _with_centres(filed: DataFrame, placed: DataFrame, named: DataFrame, of: int) -> DataFrame:
    """Pairs of nodes of different components that may be similar, of which one is among the few
    nodes drawn from a part that both file. A part's draw differs from those of other parts."""
    mine = _placed_parts(filed, placed, named).drop("before")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("part", "node"), "node"))
    drawn = mine.withColumn("rank", rank).where(F.col("rank") <= CENTRES).drop("rank")
    drawn = drawn.toDF(*[f"other_{c}" for c in mine.columns])
    met = (F.col("part") == F.col("other_part")) & (F.col("component") != F.col("other_component"))
    near = _may_be_similar(of, "size", "other_size", "sketch", "other_sketch")
    return mine.join(drawn, met & (F.col("own") | F.col("other_own")) & near).select(*_pair("node", "other_node"))


def _across(filed: DataFrame, placed: DataFrame, named: DataFrame, of: int) -> DataFrame:
    """Pairs of nodes of different components that share a part of (node, part, own, before) and
    may be similar. A pair stands in a few rows at most."""
    mine = _placed_parts(filed, placed, named)
    other = mine.toDF(*[f"other_{c}" for c in mine.columns])
    met = (F.col("part") == F.col("other_part")) & (F.col("component") < F.col("other_component"))
    # at the first part that a pair shares at the lower of its ranges, this always holds
    first = (F.col("own") | F.col("other_own")) & ~F.arrays_overlap("before", "other_before")
    near = _may_be_similar(of, "size", "other_size", "sketch", "other_sketch")
    return mine.join(other, met & near & first).select(*_pair("node", "other_node"))


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of components that links (a, b) between their nodes join: a component's
    name, and that of the one it is now part of."""
    at = placed.select("node", "component")
    left, right = at.toDF("l", "l_component"), at.toDF("r", "r_component")
    ends = links.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r"))
    return components(ends.select(F.col("l_component").alias("a"), F.col("r_component").alias("b")))


def _renamed(placed: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows with the component that theirs is now part of."""
    now = joined.select(F.col("node").alias("was"), F.col("component").alias("now"))
    both = placed.join(now, F.col("component") == F.col("was"), "left")
    return both.withColumn("component", F.coalesce("now", "component")).drop("was", "now")


def _may_be_similar(of: int, size: str, other_size: str, sketch: str, other_sketch: str) -> Column:
    """Whether sizes and sketches of two sets allow the similarity."""

    def folded(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    def differing(a: Column, b: Column) -> Column:
        bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(bits, F.lit(0), lambda total, x: total + x)

    a, b = F.col(sketch), F.col(other_sketch)
    apart = (
        F.when(F.size(a) == F.size(b), differing(a, b))
        .when(F.size(a) == 2 * F.size(b), differing(folded(a), b))
        .when(F.size(b) == 2 * F.size(a), differing(a, folded(b)))
        .otherwise(0)
    )
    near = 100 * F.least(size, other_size) >= of * F.greatest(size, other_size)
    return near & (apart <= F.expr(f"({size} + {other_size}) * {100 - of} div {100 + of}"))


def _maybe_similar(pairs: DataFrame, named: DataFrame, of: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    known = named.select("node", "size", "sketch")
    left, right = known.toDF("l", "l_size", "l_sketch"), known.toDF("r", "r_size", "r_sketch")
    both = pairs.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r"))
    return both.where(_may_be_similar(of, "l_size", "r_size", "l_sketch", "r_sketch")).select("a", "b")


def _texts_of(docs: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, text) of nodes (of), from one document each."""
    wanted = named.join(nodes, F.col("node") == F.col("of")).select("rep", "node", "size")
    return docs.select("id", "text").join(wanted, same(F.col("id"), F.col("rep")))


def _sets(docs: DataFrame, named: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The sets of nodes (of), from the text of one document each."""
    return wide_fragments(_texts_of(docs, named, nodes), n)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, of: int = 80
) -> DataFrame:
    """(id, size, component_id): set size and smallest linked id of every document.

    ``of`` is the similarity in hundredths.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    linked = link_sets(docs, n, of)
    least = linked.where(F.col("component").isNotNull()).groupBy(F.col("component").alias("of")).agg(
        F.min("id").alias("least")
    )
    return linked.join(least, F.col("component") == F.col("of"), "left").select(
        "id", "size", F.coalesce("least", "id").alias("component_id")
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, of: int = 80
) -> DataFrame:
    """The row with the smallest id of each group of linked documents; unknown ids come last,
    and of rows with equal ids and texts one stays. Documents without words all stay."""
    text = F.col(text_col).cast("string")
    key, of_key = fresh(docs.columns, "row_key", "kept_key")
    keyed = docs.withColumn(
        key,
        F.struct(
            F.col(id_col).isNull().alias("unknown"),
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("mark"),
        ),
    )
    linked = link_sets(keyed.select(F.col(key).alias("id"), text.alias("text")), n, of)
    first = linked.where(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("id").alias(of_key)
    )
    has_word = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(has_word).join(first, F.col(key) == F.col(of_key), "left_semi")
    return kept.dropDuplicates([key]).drop(key).unionAll(docs.where(~has_word))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    found = jaccard_components(read(spark, sf_dir, "documents"), n=4, of=85)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
