"""Line dedup by content-defined chunks.

A rolling hash over the hashes of a line and the line before it is computed for every line of a
text; a chunk ends after a line whose rolling hash is a local minimum. Whether a line ends a
chunk thus depends on four lines around it and not on its place, so chunks line up again after
an insertion. Chunks have two lines at least. A chunk of several lines that stands somewhere
else too, byte for byte, stays where it comes first by document id and place and is removed
everywhere else.

Only hashes of chunks are counted over the corpus; texts of chunks are brought together only
where a hash repeats, and compared in full.

Cases: a null text stays null and counts as empty; chunks without words are never removed; rows
with the same id and text are one document and are treated alike; null ids come last; a text of
one line is kept; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.functions.text import let
from sparkdesk.llm.common import fresh, read, same, whole
from sparkdesk.session import materialize

# The rolling hash is (FACTOR * hash of the line before + hash of the line) mod MODULUS.
FACTOR, MODULUS = 31, 1000003
LEAST_LINES = 2
WORD = r"[^\x20\x09-\x0D]"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _ends(rolling: Column) -> Column:
    """Places of the last lines of chunks."""
    last = F.size(rolling) - 1

    def ends(i: Column) -> Column:
        here = F.get(rolling, i)
        low = (here < F.get(rolling, i - 1)) & (here <= F.get(rolling, i + 1))
        return (i == last) | ((i >= LEAST_LINES - 1) & (i < last - 1) & low)

    return F.filter(F.sequence(F.lit(0), last), ends)


def chunks(text: Column) -> Column:
    """A text's chunks, as array of (lines, text); joined by newlines they give the text."""

    def cut(lines: Column) -> Column:
        def rolled(hashes: Column) -> Column:
            return F.transform(
                hashes,
                lambda h, i: (F.coalesce(F.get(hashes, i - 1), F.lit(0)) * FACTOR + h) % MODULUS,
            )

        def parts(ends: Column) -> Column:
            def part(end: Column, k: Column) -> Column:
                begin = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
                return F.struct(
                    (end - begin + 1).alias("lines"),
                    F.array_join(F.slice(lines, begin + 1, end - begin + 1), "\n").alias("text"),
                )

            return F.transform(ends, part)

        return let(let(let(F.transform(lines, _line_hash), rolled), _ends), parts)

    return let(F.split(text, "\n"), cut)


def removed_chunks(docs: DataFrame) -> DataFrame:
    """(id, mark, places) of documents (id, mark, text): the chunks that stand elsewhere first.

    ``mark`` is a hash of the text and tells rows of one id apart.
    """
    all_of = docs.select("id", "mark", F.posexplode(chunks(F.col("text"))).alias("place", "chunk"))
    all_of = all_of.where((F.col("chunk.lines") >= LEAST_LINES) & F.col("chunk.text").rlike(WORD))
    all_of = all_of.select("id", "mark", "place", F.col("chunk.text").alias("chunk"))
    hashed = all_of.withColumn("hash", F.xxhash64("chunk"))
    repeated = hashed.groupBy(F.col("hash").alias("of")).count().where(F.col("count") > 1)
    candidates, _ = materialize(
        hashed.join(repeated, F.col("hash") == F.col("of")).select("id", "mark", "place", "hash", "chunk"),
        "chunks",
    )
    # null ids order last
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "mark", "place")
    first = candidates.groupBy(F.col("hash").alias("of"), F.col("chunk").alias("as")).agg(
        F.min(place).alias("first"), F.count("*").alias("n")
    )
    first = first.where(F.col("n") > 1)
    later = candidates.join(first, (F.col("hash") == F.col("of")) & (F.col("chunk") == F.col("as")))
    later = later.where(~same(place, F.col("first")))
    return later.groupBy("id", "mark").agg(F.collect_set("place").alias("places"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` without repeated chunks, with the same columns.

    ``counts`` may name columns to add: lines, chunks and removed chunks of the text before.
    """
    text = whole(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = removed_chunks(slim)
    mark, of, of_mark, places, cut = fresh(docs.columns, "of_text", "of_id", "of_mark", "places", "cut")
    found = found.toDF(of, of_mark, places)
    out = docs.withColumn(mark, F.xxhash64(text)).join(
        found, same(F.col(id_col), F.col(of)) & (F.col(mark) == F.col(of_mark)), "left"
    )
    gone = F.coalesce(places, F.array().cast("array<int>"))

    def kept(parts: Column) -> Column:
        return F.array_join(
            F.transform(
                F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), lambda x: x["text"]
            ),
            "\n",
        )

    new_text = F.when(F.size(gone) > 0, let(chunks(text), kept)).otherwise(F.col(text_col))
    shown = [new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    added = (F.size(F.split(text, "\n")), F.size(chunks(text)), F.size(gone))
    return out.select(*shown, *[a.cast("long").alias(c) for a, c in zip(added, counts)])


def pairs(text: Column) -> Column:
    """Every line with a word up to the next one, as array of (begin, end, text)."""

    def of(lines: Column) -> Column:
        def joined(at: Column) -> Column:
            def pair(begin: Column, k: Column) -> Column:
                end = F.get(at, k + 1)
                part = F.array_join(F.slice(lines, begin + 1, end - begin + 1), "\n")
                return F.struct(begin.alias("begin"), end.alias("end"), part.alias("text"))

            return F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), pair)

        places = F.sequence(F.lit(0), F.size(lines) - 1)
        return let(F.filter(places, lambda i: F.get(lines, i).rlike(WORD)), joined)

    return let(F.split(text, "\n"), of)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(id, mark, lines) of documents (id, mark, text): lines of pairs that stand elsewhere first.

    A pair that overlaps its own first place in a document is not a repetition. Texts of pairs
    are cut again only where a hash repeats, so that the count moves hashes alone.
    """
    hashes = F.transform(pairs(F.col("text")), lambda x: F.xxhash64(x["text"]))
    hashed = docs.select("id", "mark", F.posexplode(hashes).alias("place", "hash"))
    repeated = hashed.groupBy(F.col("hash").alias("of")).count().where(F.col("count") > 1)
    places = hashed.join(repeated, F.col("hash") == F.col("of")).groupBy(
        F.col("id").alias("in"), F.col("mark").alias("in_mark")
    )
    places = places.agg(F.collect_set("place").alias("places"))
    texts = docs.join(places, same(F.col("id"), F.col("in")) & (F.col("mark") == F.col("in_mark")))
    picked = F.transform(
        F.array_sort("places"), lambda k: F.struct(k.alias("place"), F.get(F.col("all"), k).alias("pair"))
    )
    texts = texts.select("id", "mark", "places", pairs(F.col("text")).alias("all"))
    texts = texts.select("id", "mark", F.explode(picked).alias("x")).select("id", "mark", "x.*")
    candidates, _ = materialize(
        texts.select("id", "mark", "place", F.xxhash64("pair.text").alias("hash"), "pair"), "pairs"
    )
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "mark", "place")
    first = candidates.groupBy(F.col("hash").alias("of"), F.col("pair.text").alias("as"))
    first = first.agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    later = candidates.join(first, (F.col("hash") == F.col("of")) & (F.col("pair.text") == F.col("as")))
    here = same(F.col("id"), F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    later = later.where(~(here & (F.col("place") < F.col("first.place") + 2)))
    spans = F.collect_set(F.struct("pair.begin", "pair.end"))
    lines = F.flatten(F.transform(spans, lambda x: F.sequence(x["begin"], x["end"])))
    return later.groupBy("id", "mark").agg(F.array_distinct(lines).alias("lines"))


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: str | None = None
) -> DataFrame:
    """``docs`` without runs of two or more lines with words that stand elsewhere first.

    Where a run begins and ends doesn't depend on the lines around it. ``removed`` may name a
    column to add, the number of lines removed.
    """
    text = whole(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    mark, of, of_mark, gone = fresh(docs.columns, "of_text", "of_id", "of_mark", "gone")
    found = removed_lines(slim).toDF(of, of_mark, gone)
    out = docs.withColumn(mark, F.xxhash64(text)).join(
        found, same(F.col(id_col), F.col(of)) & (F.col(mark) == F.col(of_mark)), "left"
    )

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    new_text = F.when(F.col(gone).isNotNull(), let(F.split(text, "\n"), kept)).otherwise(F.col(text_col))
    shown = [new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    count = F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.col(gone))).cast("long")
    return out.select(*shown, *([count.alias(removed)] if removed else []))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = dedup_lines(docs, counts=("n_lines", "n_chunks", "n_removed"))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_chunks",
        "n_removed",
        F.length(whole(F.col("text"))).cast("long").alias("n_chars"),
        F.sha2(whole(F.col("text")), 256).alias("text_sha256"),
    )


def op3_sql(docs: str = "documents") -> str:
    """DuckDB's SQL for ``op3_line_dedup``, where ids are known and differ."""
    return f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}),
line AS (
  SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM line),
rolled AS (
  SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {FACTOR} + h) % {MODULUS} AS r FROM hashed),
ended AS (
  SELECT *, (i >= 1 AND i < n - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w)::INT AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (
  SELECT *, coalesce(sum(ends) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM ended),
chunk AS (
  SELECT doc_id, place, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM placed GROUP BY doc_id, place),
marked AS (
  SELECT *, lines >= {LEAST_LINES} AND regexp_matches(chunk, '{WORD}') AS counts FROM chunk),
ranked AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id, place) > 1 AS gone FROM marked),
cleaned AS (
  SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, sum(gone::INT)::BIGINT AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM ranked GROUP BY doc_id)
SELECT doc_id, n_lines, n_chunks, n_removed, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256
FROM cleaned"""
