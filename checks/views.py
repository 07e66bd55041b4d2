"""Ticket-like views over the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdesk.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for heavy per-row work."""
    cores = spark.sparkContext.defaultParallelism
    return read_table(spark, f"{sf_dir}/{name}.parquet", partitions=cores)


def tickets_page(spark, sf_dir):
    """Web pages as raw issues: the page title and the whole markup as body."""
    return texts(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("body"),
    )


TICKETS_PAGE = """
SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS body
FROM pages"""


def tickets_doc(spark, sf_dir):
    """Documents as tickets: first line as title, language as intent, rated tags as labels."""
    docs, rated = texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(rated, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.col("lang").alias("intent"),
        "source",
        "n_chars",
        F.array_compact(
            F.array(
                F.concat(F.lit("lang "), "lang"),
                F.when(F.col("quality") == 1, "High-Quality"),
                F.when(F.col("quality") == 0, "low quality"),
                F.when(F.col("toxic") == 1, "toxic"),
                F.when(F.col("quality").isNull(), "unrated"),
            )
        ).alias("labels"),
        severity().alias("severity"),
    )


def severity():
    return (
        F.when(F.col("n_chars") < 800, "minor")
        .when(F.col("n_chars") < 3000, "Major")
        .otherwise(" critical ")
    )


TICKETS_DOC = """
SELECT d.doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, lang AS intent,
  source, n_chars,
  list_filter(['lang ' || lang,
    CASE WHEN quality = 1 THEN 'High-Quality' END,
    CASE WHEN quality = 0 THEN 'low quality' END,
    CASE WHEN toxic = 1 THEN 'toxic' END,
    CASE WHEN quality IS NULL THEN 'unrated' END], lambda x: x IS NOT NULL) AS labels,
  CASE WHEN n_chars < 800 THEN 'minor' WHEN n_chars < 3000 THEN 'Major' ELSE ' critical ' END
    AS severity
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def tickets_conv(spark, sf_dir):
    """Chats as tickets: the first user turn, and the other turns in order."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    first = F.get(F.filter("turns", lambda t: t["role"] == "user"), 0)
    others = F.filter("turns", lambda t: ~t["turn"].eqNullSafe(F.col("first.turn")))
    return chats.withColumn("first", first).select(
        F.col("conv_id").alias("id"),
        F.col("first.text").alias("title"),
        F.array_join(F.transform(others, lambda t: t["text"]), " ").alias("body"),
    )


TICKETS_CONV = """
SELECT conv_id AS id, max(CASE WHEN turn = first THEN coalesce(text, '') END) AS title,
  coalesce(string_agg(CASE WHEN turn IS DISTINCT FROM first THEN coalesce(text, '') END, ' '
    ORDER BY turn), '') AS body
FROM conversations JOIN (SELECT conv_id, min(turn) FILTER (role = 'user') AS first
  FROM conversations GROUP BY conv_id) USING (conv_id)
GROUP BY conv_id"""


def raw_labels(spark, sf_dir):
    """Parts as issues with a comma-separated label text; some have none."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(
            F.col("p_size") <= 45,
            F.concat(
                "p_type", F.lit(", "), "p_brand", F.lit(" ,P1, "),
                F.replace(F.col("p_name"), F.lit(" "), F.lit(",")),
            ),
        )
        .when(F.col("p_size") <= 48, F.lit(" P3, 42,"))
        .alias("labels"),
    )


RAW_LABELS = """
SELECT p_partkey AS id,
  CASE WHEN p_size <= 45 THEN p_type || ', ' || p_brand || ' ,P1, ' || replace(p_name, ' ', ',')
       WHEN p_size <= 48 THEN ' P3, 42,' END AS labels
FROM part"""

# Alias map for the part labels; some aliases are missing on purpose.
ALIASES = {
    "large": "installation_setup",
    "economy": "configuration",
    "small": "security",
    "promo": "duplicate_existing",
    "medium": "bug",
    "standard": "other",
    "ring": "question",
    "bolt": "data_import_export",
    "brand#7": "access_permissions",
    "brand#14": "refactor_maintenance",
    "brand#16": "duplicate_existing",
    "blue": "ui_ux",
    "hot": "other",
    # labels are compared in lower case, aliases as they stand: never found
    "Gear": "bug",
    "COLD": "question",
}


def alias_table(spark):
    return spark.createDataFrame(list(ALIASES.items()), "alias string, group string")


ALIAS_VALUES = ", ".join(f"('{a}', '{g}')" for a, g in ALIASES.items())


def severity_rows(spark, sf_dir):
    """Orders as issues with a severity; two order priorities have no mapping."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order <b>"), F.col("o_orderkey").cast("string"), F.lit("</b>")).alias(
            "title"
        ),
        F.concat(F.lit("status {s} "), "o_orderstatus").alias("body"),
        F.when(F.col("o_orderpriority") == "1-URGENT", " Critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "major")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MINOR ")
        .when(F.col("o_orderpriority") == "5-LOW", "trivial")
        .alias("severity"),
    )


SEVERITY_ROWS = """
SELECT o_orderkey AS id, 'Order <b>' || o_orderkey || '</b>' AS title,
  'status {s} ' || o_orderstatus AS body,
  CASE o_orderpriority WHEN '1-URGENT' THEN ' Critical' WHEN '2-HIGH' THEN 'major'
    WHEN '3-MEDIUM' THEN 'MINOR ' WHEN '5-LOW' THEN 'trivial' END AS severity
FROM orders"""

CLASSES = [f"class_{i}" for i in range(10)]


def scores(spark, sf_dir):
    """Embeddings as raw scores of ten classes, with the true class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10).alias("raw"),
        "label",
    )


SCORES = """
SELECT vec_id AS id, list_transform(embedding[1:10], lambda x: x::DOUBLE * 10) AS raw, label
FROM embeddings"""

CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def predicted(spark, sf_dir):
    """Single-label truth ``y`` and prediction ``p`` from the scores."""
    from sparkdesk.functions.decode import decode_single

    s = scores(spark, sf_dir)
    return s.select(
        "id",
        F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).alias("y"),
        decode_single(F.col("raw"), CLASSES)["label"].alias("p"),
    )


PREDICTED = f"""
SELECT id, {CLASS_LIST}[label + 1] AS y,
  {CLASS_LIST}[list_position(raw, list_max(raw))] AS p
FROM ({SCORES})"""


def predicted_multi(spark, sf_dir):
    """Label-set truth ``y`` and prediction ``p``: classes above a score bound."""
    s = scores(spark, sf_dir)
    names = F.array(*[F.lit(c) for c in CLASSES])

    def above(bound):
        hits = F.transform(F.col("raw"), lambda x, i: F.when(x > bound, F.get(names, i)))
        return F.array_compact(hits)

    truth = F.array_union(above(1.2), F.array(F.get(names, F.col("label"))))
    return s.select("id", truth.alias("y"), above(0.9).alias("p"))


def _above(bound: float) -> str:
    return (
        f"list_filter(list_transform(range(1, 11), lambda i: CASE WHEN raw[i] > {bound} "
        f"THEN {CLASS_LIST}[i] END), lambda x: x IS NOT NULL)"
    )


PREDICTED_MULTI = f"""
SELECT id, list_distinct(list_concat({_above(1.2)}, [{CLASS_LIST}[label + 1]])) AS y,
  {_above(0.9)} AS p
FROM ({SCORES})"""


def history(spark, sf_dir):
    """Events as history rows of scored tickets."""
    return as_history(table(spark, sf_dir, "events"))


def as_history(events):
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("Ticket "), F.repeat(F.col("props"), 8)).alias("title"),
        F.col("event_type").alias("priority"),
        ((F.col("user_id") % 100) / 100).alias("priority_conf"),
        F.concat(F.lit("user_intent_"), (F.col("user_id") % 7).cast("string")).alias("intent"),
        ((F.col("event_id") % 50) / 50).alias("intent_conf"),
        F.col("event_type").alias("top_category"),
        F.col("value").alias("latency_ms"),
    )


HISTORY = """
SELECT event_id AS id, ts AS timestamp, 'Ticket ' || repeat(props, 8) AS title,
  event_type AS priority, (user_id % 100) / 100 AS priority_conf,
  'user_intent_' || (user_id % 7) AS intent, (event_id % 50) / 50 AS intent_conf,
  event_type AS top_category, value AS latency_ms
FROM events"""
TIED_HISTORY = f"SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM ({HISTORY})"


def decoded(spark, sf_dir):
    """Decoded predictions of the embeddings with ticket texts."""
    from sparkdesk.functions.decode import decode_logits, decode_single, softmax_scores

    s = scores(spark, sf_dir)
    shares = softmax_scores(F.col("raw"))
    return s.select(
        "id",
        F.concat(F.lit("Vector "), F.col("id").cast("string")).alias("title"),
        F.array_join(
            F.transform("raw", lambda x: F.floor(x * 100).cast("string")), " "
        ).alias("body"),
        decode_logits(F.col("raw"), CLASSES, "multi").alias("category"),
        decode_single(shares, CLASSES).alias("priority"),
        decode_single(F.slice(shares, 1, 3), CLASSES[:3]).alias("intent"),
    )


SOFTMAX = """
SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS share FROM (
  SELECT *, list_transform(raw, lambda x: exp(x - list_max(raw))) AS e FROM ({scores}))"""

SOFTMAX_SCORES = SOFTMAX.format(scores=SCORES)


def sql_multi(scores: str) -> str:
    """Up to three [score, label] structs of a score list, best first."""
    ranked = (
        f"list_sort(list_transform(range(1, 11), lambda i: {{'neg': -({scores})[i], 'pos': i}}))"
    )
    kept = f"list_filter({ranked}, lambda r: -r.neg >= 0.5)"
    chosen = f"CASE WHEN len({kept}) > 0 THEN ({kept})[1:3] ELSE ({ranked})[1:1] END"
    return (
        f"list_transform({chosen}, lambda r: "
        f"{{'label': {CLASS_LIST}[r.pos], 'confidence': round(-r.neg, 4)}})"
    )


DECODED = f"""
SELECT id, 'Vector ' || id AS title,
  array_to_string(list_transform(raw, lambda x: floor(x * 100)::BIGINT), ' ') AS body,
  {sql_multi("list_transform(raw, lambda x: 1 / (1 + exp(-x)))")} AS category,
  {{'label': {CLASS_LIST}[list_position(share, list_max(share))],
    'confidence': round(list_max(share), 4)}} AS priority,
  {{'label': {CLASS_LIST}[list_position(share[1:3], list_max(share[1:3]))],
    'confidence': round(list_max(share[1:3]), 4)}} AS intent
FROM ({SOFTMAX_SCORES})"""
