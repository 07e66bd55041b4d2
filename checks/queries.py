"""Every operator as a query over the given tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as S
from checks import views as V
from sparkdesk.functions import decode as D
from sparkdesk.functions import labels as L
from sparkdesk.functions import text as X
from sparkdesk.functions import tokens as K
from sparkdesk.operators import curation, features, metrics, reports, sampling
from sparkdesk.plans import loading, scoring, training
from sparkdesk.session import materialize, work_path, written
from sparkdesk.sources import registry, tables
from sparkdesk.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def bar(c):
    """A list of strings as one text, so that results compare as plain values."""
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


# Flagship: clean, combine, flag and count

@query(
    f"""SELECT urgent, count(*) AS tickets, sum(length(text)) AS chars FROM (
      SELECT text, regexp_matches(lower(text), '{"|".join(X.URGENT_WORDS)}')::INT AS urgent
      FROM (SELECT {S.combined("title", "body")} AS text FROM ({V.TICKETS_PAGE})))
    GROUP BY urgent"""
)
def urgent_tickets(spark, sf_dir):
    texts = X.add_text_column(V.tickets_page(spark, sf_dir)).select("text")
    return (
        texts.withColumn("urgent", X.urgency_flag(F.col("text")))
        .groupBy("urgent")
        .agg(F.count("*").alias("tickets"), F.sum(F.length("text")).alias("chars"))
    )


# Scans, sources, sinks

@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    path = work_path(spark, "csv")
    tables.write_csv(docs, path)
    return tables.read_tickets_csv(spark, path, docs.schema)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_documents(spark, sf_dir):
    docs = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return tables.require_columns(docs, ["doc_id", "text", "lang", "source", "n_chars"])


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 300")
def limit_rows(spark, sf_dir):
    return tables.limit_rows(V.table(spark, sf_dir, "documents"), 300, "doc_id").select(
        "doc_id", "text"
    )


@query("SELECT doc_id, lang, n_chars FROM documents")
def prune_columns(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").drop("source").select("doc_id", "lang", "n_chars")


@query("SELECT text, role AS intent FROM conversations")
def pick_column(spark, sf_dir):
    chats = V.table(spark, sf_dir, "conversations")
    return tables.intent_frame(
        chats.select("conv_id", F.col("text").alias("utterance"), F.col("role").alias("speaker"))
    )


@query(f"SELECT vec_id, {V.CLASS_LIST}[label + 1] AS class FROM embeddings")
def decode_label_id(spark, sf_dir):
    vectors = V.table(spark, sf_dir, "embeddings")
    return tables.decode_label_id(vectors, "label", V.CLASSES, "class").select("vec_id", "class")


ENTRIES = """SELECT event_type AS target, 'user ' || user_id AS model_type, event_id AS rows,
  ts, ts >= TIMESTAMP '2024-01-16' AS is_new, value FROM events"""


@query(
    f"""SELECT target, model_type, rows, round(value, 4) AS accuracy FROM (
      SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, is_new DESC) AS rn
      FROM ({ENTRIES})) WHERE rn = 1"""
)
def registry_latest(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("target"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("model_type"),
        F.col("event_id").alias("rows"),
        registry.clean_metrics(
            F.create_map(F.lit("eval_accuracy"), F.col("value"), F.lit("epoch"), F.lit(3.0))
        ).alias("metrics"),
        F.col("ts").alias("updated_at"),
    )
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = events.where(F.col("updated_at") < middle), events.where(
        F.col("updated_at") >= middle
    )
    return registry.upsert_registry(old, new).select(
        "target", "model_type", "rows", F.col("metrics")["accuracy"].alias("accuracy")
    )


# Text and label expressions

@query(f"SELECT page_id, {S.clean('html')} AS text FROM pages")
def clean_text(spark, sf_dir):
    pages = V.texts(spark, sf_dir, "pages")
    return pages.select("page_id", X.clean_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {S.deep('html')} AS text FROM pages")
def deep_clean_text(spark, sf_dir):
    pages = V.texts(spark, sf_dir, "pages")
    return pages.select("page_id", X.deep_clean_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, {S.light('html')} AS text FROM pages")
def light_clean(spark, sf_dir):
    pages = V.texts(spark, sf_dir, "pages")
    return pages.select("page_id", X.light_clean(F.col("html")).alias("text"))


@query(f"SELECT id, {S.combined('title', 'body')} AS text FROM ({V.TICKETS_PAGE})")
def combine_title_body(spark, sf_dir):
    tickets = V.tickets_page(spark, sf_dir)
    return tickets.select("id", X.combine_title_body(F.col("title"), F.col("body")).alias("text"))


@query(
    f"""SELECT id, text FROM (SELECT doc_id AS id, {S.combined("NULL", "text")} AS text
    FROM documents) WHERE length(text) > 0"""
)
def add_text_column(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("body")
    )
    return X.add_text_column(docs).select("id", "text")


@query(f"SELECT p_partkey, {S.norm_label('p_name')} AS label FROM part")
def normalize_label(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    return part.select("p_partkey", L.normalize_label(F.col("p_name")).alias("label"))


@query(
    "SELECT o_orderkey, regexp_replace(lower("
    + S.strip("' ' || o_orderpriority || '  '")
    + f"), '{S.WS[:-1]}\\-]+', '_', 'g') AS intent FROM orders"
)
def snake_case_intent(spark, sf_dir):
    raw = F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))
    orders = V.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", L.snake_case_intent(raw).alias("intent"))


@query(
    f"""SELECT id, title || ' ' || body AS spaced, title || ' [SEP] ' || body AS marked,
    lower({S.strip("title || ' ' || body")}) AS lowered FROM ({V.TICKETS_PAGE})"""
)
def concat_text(spark, sf_dir):
    t, b = F.col("title"), F.col("body")
    return V.tickets_page(spark, sf_dir).select(
        "id",
        X.concat_text(t, b, fill=" ").alias("spaced"),
        X.concat_text(t, b, sep=" [SEP] ").alias("marked"),
        X.concat_text(t, b, lower=True).alias("lowered"),
    )


LITERALS = """SELECT p_partkey, CASE WHEN p_size <= 35
  THEN '[''' || p_type || ''', ''' || replace(p_name, ' ', '-') || ''']'
  WHEN p_size <= 45 THEN p_brand END AS raw FROM part"""


@query(
    f"""SELECT p_partkey, {S.joined("list_transform(items, lambda x: " + S.norm_label("x") + ")")}
      AS labels FROM (SELECT p_partkey, CASE WHEN raw IS NULL THEN []
        WHEN raw LIKE '[%' THEN regexp_extract_all(raw, '''([^'']*)''', 1)
        ELSE [raw] END AS items FROM ({LITERALS}))"""
)
def parse_label_list(spark, sf_dir):
    raw = F.when(
        F.col("p_size") <= 35,
        F.concat(
            F.lit("['"), "p_type", F.lit("', '"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("']"),
        ),
    ).when(F.col("p_size") <= 45, F.col("p_brand"))
    part = V.table(spark, sf_dir, "part")
    return part.select("p_partkey", bar(L.parse_label_list(raw)).alias("labels"))


@query(
    """SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand,
    lower(p_type) AS p_type, p_size, p_retailprice FROM part"""
)
def lower_all(spark, sf_dir):
    return X.lower_all(V.table(spark, sf_dir, "part"))


def sql_title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), "
        "lambda r: upper(r[1:1]) || lower(r[2:])), '')"
    )


SQL_CATEGORY = (
    "array_to_string(list_transform(category, "
    "lambda c: c.label || ' (' || printf('%.2f', c.confidence) || ')'), ', ')"
)


@query(
    f"""SELECT id, {SQL_CATEGORY} AS category,
      printf('%.1f', priority.confidence * 100) || '%' AS percent,
      {sql_title("replace(priority.label, '_', ' ')")} AS display,
      CASE WHEN length(body) > 60 THEN body[1:60] || '…' ELSE body END AS short
    FROM ({V.DECODED})"""
)
def format_predictions(spark, sf_dir):
    return V.decoded(spark, sf_dir).select(
        "id",
        X.format_predictions(F.col("category")).alias("category"),
        X.percent_text(F.col("priority.confidence")).alias("percent"),
        X.display_label(F.col("priority.label")).alias("display"),
        X.truncate_title(F.col("body")).alias("short"),
    )


def sql_reason(title: str, body: str) -> str:
    return (
        f"CASE WHEN {title} IS NULL THEN 'title missing' WHEN length({title}) = 0 THEN "
        f"'title empty' WHEN length({title}) > 1000 THEN 'title too long' "
        f"WHEN NOT regexp_matches({title}, '{S.NOT_WS}') THEN 'title blank' "
        f"WHEN length({body}) > 10000 THEN 'body too long' END"
    )


TITLED = """SELECT doc_id AS id, text AS body, CASE WHEN lang = 'fr' THEN NULL
  WHEN lang = 'es' THEN '  ' WHEN lang = 'de' THEN '' ELSE split_part(text, chr(10), 1) END
  AS title FROM documents"""


def _titled(spark, sf_dir):
    lang = F.col("lang")
    return V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("body"),
        F.when(lang == "fr", F.lit(None).cast("string"))
        .when(lang == "es", "  ")
        .when(lang == "de", "")
        .otherwise(F.substring_index("text", "\n", 1))
        .alias("title"),
    )


@query(
    f"""SELECT id, coalesce(reason, 'ok') AS state FROM (
      SELECT id, {sql_reason("title", "body")} AS reason FROM ({TITLED}))"""
)
def validate_tickets(spark, sf_dir):
    valid, refused = X.validate_tickets(_titled(spark, sf_dir))
    return valid.select("id", F.lit("ok").alias("state")).unionByName(
        refused.select("id", F.col("reject_reason").alias("state"))
    )


@query(
    f"""SELECT id, length(coalesce(title, '')) AS title_length, length(body) AS body_length
    FROM ({TITLED})"""
)
def length_features(spark, sf_dir):
    return X.length_features(_titled(spark, sf_dir)).select("id", "title_length", "body_length")


@query(
    f"""SELECT doc_id, regexp_matches(lower(text), '{"|".join(X.URGENT_WORDS)}')::INT AS urgent
    FROM documents"""
)
def urgency_flag(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", X.urgency_flag(F.col("text")).alias("urgent"))


# Filters and label taxonomy

CLEAN_LABELS = f"""SELECT id, CASE WHEN len(kept) > 0 THEN kept ELSE ['unknown'] END AS labels
FROM (SELECT id, list_filter(
    list_transform(str_split(labels, ','), lambda x: lower({S.strip("x")})),
    lambda x: regexp_matches(x, '[a-z]') AND NOT list_contains({S.text_list(L.NOISE_LABELS)}, x)
  ) AS kept FROM ({V.RAW_LABELS}))"""


def _cleaned(spark, sf_dir):
    return V.raw_labels(spark, sf_dir).select("id", L.clean_labels(F.col("labels")).alias("labels"))


@query(f"SELECT id, {S.joined('labels')} AS labels FROM ({CLEAN_LABELS})")
def clean_labels(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("id", bar("labels").alias("labels"))


# First place of each group decides its order; unknown goes if another group is there.
MAPPED = f"""SELECT id, list("group" ORDER BY first_pos) AS mapped FROM (
  SELECT id, "group", min(pos) AS first_pos,
    sum(CASE WHEN "group" <> 'unknown' THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS known FROM (
    SELECT i.id, i.pos, CASE WHEN a."group" IS NULL OR a."group" = 'other' THEN 'unknown'
      ELSE a."group" END AS "group"
    FROM (SELECT id, unnest(labels) AS label, unnest(range(1, len(labels) + 1)) AS pos
      FROM ({CLEAN_LABELS})) i
    LEFT JOIN (VALUES {V.ALIAS_VALUES}) a(alias, "group") ON i.label = a.alias)
  GROUP BY id, "group")
WHERE "group" <> 'unknown' OR known = 0 GROUP BY id"""


def _mapped(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(
        "id", L.map_labels(F.col("labels"), V.ALIASES).alias("mapped")
    )


@query(f"SELECT id, {S.joined('mapped')} AS mapped FROM ({MAPPED})")
def map_labels(spark, sf_dir):
    return _mapped(spark, sf_dir).select("id", bar("mapped").alias("mapped"))


@query(f"SELECT id, {S.joined('mapped')} AS mapped FROM ({MAPPED})")
def map_labels_join(spark, sf_dir):
    joined = curation.map_labels_join(_cleaned(spark, sf_dir), V.alias_table(spark))
    return joined.select("id", bar("mapped").alias("mapped"))


@query(f"SELECT id, mapped = ['unknown'] AS is_unknown FROM ({MAPPED})")
def split_unknown(spark, sf_dir):
    known, unknown = curation.split_unknown(_mapped(spark, sf_dir), "mapped")
    return known.select("id", F.lit(False).alias("is_unknown")).unionByName(
        unknown.select("id", F.lit(True).alias("is_unknown"))
    )


MERGE_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.LABEL_MERGES.items())


@query(
    f"""SELECT id, {S.joined("list_sort(list_distinct(kept))")} AS labels FROM (
      SELECT id, list_transform(list_filter(mapped, lambda x: x <> '{L.DROPPED_LABEL}'),
        lambda x: CASE x {MERGE_CASES} ELSE x END) AS kept FROM ({MAPPED})) WHERE len(kept) > 0"""
)
def consolidate_labels(spark, sf_dir):
    merged = curation.consolidate_rare(_mapped(spark, sf_dir), "mapped")
    return merged.select("id", bar("mapped").alias("labels"))


@query(
    f"""SELECT id, {S.light("title")} AS title, {S.light("body")} AS body, priority FROM (
      SELECT *, CASE lower(trim(severity)) WHEN 'critical' THEN 'critical' WHEN 'major' THEN 'high'
        WHEN 'minor' THEN 'low' END AS priority FROM ({V.SEVERITY_ROWS}))
    WHERE priority IS NOT NULL"""
)
def severity_to_priority(spark, sf_dir):
    return curation.severity_to_priority(V.severity_rows(spark, sf_dir))


# Every seventh title is white space of one kind or another.
BLANKS = ["\n\t", "\u00a0", "\u2003\r\n"]


@query(
    f"""SELECT id FROM ({TITLED}) WHERE id % 7 <> 0
      AND regexp_matches(title, '{S.NOT_WS}') AND regexp_matches(body, '{S.NOT_WS}')"""
)
def drop_empty(spark, sf_dir):
    blank = F.element_at(F.array(*map(F.lit, BLANKS)), (F.col("id") % 3 + 1).cast("int"))
    title = F.when(F.col("id") % 7 == 0, blank).otherwise(F.col("title"))
    rows = _titled(spark, sf_dir).withColumn("title", title)
    return curation.drop_empty(rows, ["title", "body"]).select("id")


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'fr'")
def drop_class(spark, sf_dir):
    return curation.drop_class(V.table(spark, sf_dir, "documents"), "lang", "fr").select(
        "doc_id", "lang"
    )


TICKET_COLUMNS = ["conv_id", "doc_id", "text"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS dataset, count(*) AS rows, (SELECT '[' || string_agg('''' || c || '''', ', ' ORDER BY c) || ']'
        FROM (SELECT unnest({TICKET_COLUMNS}) AS c) WHERE c NOT IN (
          SELECT column_name FROM (DESCRIBE {t}))) AS missing FROM {t}"""
        for t in ("documents", "benchmark", "conversations", "pages")
    )
)
def required_columns(spark, sf_dir):
    """What the check of required columns names as missing in each table."""
    found = []
    for name in ("documents", "benchmark", "conversations", "pages"):
        rows, missing = V.table(spark, sf_dir, name), ""
        try:
            tables.require_columns(rows, TICKET_COLUMNS, name)
        except ValueError as error:
            missing = str(error).partition(": ")[2]
        found.append(rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.lit(missing).alias("missing")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(
    f"""SELECT id, text, regexp_matches(lower(text), '{"|".join(X.URGENT_WORDS)}')::INT AS urgent
    FROM (SELECT id, {S.combined("title", "body")} AS text FROM ({V.TICKETS_CONV})) WHERE length(text) > 0"""
)
def conversation_tickets(spark, sf_dir):
    """Support chats through the same clean-up as tickets."""
    texts = X.add_text_column(V.tickets_conv(spark, sf_dir)).select("id", "text")
    return texts.withColumn("urgent", X.urgency_flag(F.col("text")))


@query(
    f"""SELECT id, text, {S.joined("list_transform(labels, lambda x: " + S.norm_label("x") + ")")}
      AS labels FROM (SELECT id, {S.combined("title", "body")} AS text, labels
      FROM ({V.TICKETS_DOC})) WHERE length(text) > 0"""
)
def load_category(spark, sf_dir):
    return _category(spark, sf_dir).select("id", "text", bar("labels").alias("labels"))


def _category(spark, sf_dir):
    docs = V.tickets_doc(spark, sf_dir)
    literal = F.to_json("labels")
    return loading.load_category(docs.withColumn("labels-mapped", literal), keep=["id"])


@query(
    f"""SELECT id, text, {S.norm_label("severity")} AS label FROM (
      SELECT id, {S.combined("title", "body")} AS text, severity FROM ({V.TICKETS_DOC}))
    WHERE length(text) > 0"""
)
def load_priority(spark, sf_dir):
    return _priority(spark, sf_dir)


def _priority(spark, sf_dir):
    return loading.load_priority(V.tickets_doc(spark, sf_dir), label="severity", keep=["id"])


@query(
    f"""SELECT * FROM (SELECT doc_id AS id, {S.clean("text")} AS text,
      {S.norm_label("lang")} AS label FROM documents) WHERE length(text) > 0"""
)
def load_intent(spark, sf_dir):
    return _intent(spark, sf_dir)


def _intent(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    return loading.load_intent(
        docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("intent")), keep=["id"]
    )


# Unions, samples, splits

@query(
    """SELECT 'documents' AS split, doc_id AS id, text, lang AS intent FROM documents
    UNION ALL SELECT 'chats', conv_id, text, NULL FROM conversations"""
)
def union_splits(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("split"), F.col("doc_id").alias("id"), "text",
        F.col("lang").alias("intent"),
    )
    chats = V.table(spark, sf_dir, "conversations").select(
        F.lit("chats").alias("split"), F.col("conv_id").alias("id"), "text"
    )
    return curation.union_splits([docs, chats])


@query("SELECT o_orderkey, md5('42:' || o_orderkey) AS place FROM orders")
def shuffle_rows(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    return sampling.shuffle_rows(orders, "o_orderkey").select(
        "o_orderkey", sampling.hash_key("o_orderkey").alias("place")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 500")
def sample_n(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_n(orders, 500, "o_orderkey")


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey FROM orders
      ORDER BY md5('42:' || o_custkey), o_custkey, o_orderkey LIMIT 501)"""
)
def sample_n_repeated(spark, sf_dir):
    """Ids that stand in several rows: the sample has its size all the same."""
    orders = V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return sampling.sample_n(orders, 501, "o_custkey")


@query(
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
    UNION ALL (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'
      ORDER BY md5('42:' || o_orderkey) LIMIT 1000)"""
)
def downsample_class(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.downsample_class(orders, "o_orderpriority", "5-LOW", 1000, "o_orderkey")


SIZED = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "documents": "doc_id"}


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS dataset, count(*) AS rows, (CASE WHEN count(*) >= 50 THEN ceil(0.2 * count(*))
        ELSE greatest(1, least(5, count(*) // 5)) END)::BIGINT AS test_rows FROM {t}"""
        for t in SIZED
    )
)
def split_sizes(spark, sf_dir):
    """Test rows of splits of small and large tables."""
    found = []
    for name, key in SIZED.items():
        rows = V.table(spark, sf_dir, name).select(key)
        split = sampling.split_random(rows, key, test=sampling.split_size(rows.count()))
        found.append(
            split.agg(
                F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_if("is_test").alias("test_rows")
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey))
      <= ceil(0.2 * count(*) OVER ()) AS is_test FROM orders"""
)
def split_random(spark, sf_dir):
    return sampling.split_random(
        V.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"
    )


@query(
    """WITH size AS (SELECT count(*) AS n, count(*) - ceil(0.2 * count(*))::BIGINT AS train
      FROM documents),
    c AS (SELECT lang, count(*) AS nc, (count(*) * any_value(train)) // any_value(n) AS base,
        (count(*) * any_value(train)) % any_value(n) AS rest
      FROM documents, size GROUP BY lang),
    q AS (SELECT lang, nc - base - (row_number() OVER (ORDER BY rest DESC, lang)
        <= (SELECT train FROM size) - sum(base) OVER ())::INT AS quota FROM c)
    SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang
      ORDER BY md5('42:' || doc_id)) <= quota AS is_test
    FROM documents d JOIN q ON d.lang = q.lang"""
)
def split_stratified(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.split_stratified(docs, "doc_id", "lang")


# Features

@query(f"SELECT doc_id, {S.joined(S.tokens('text'))} AS tokens FROM documents")
def tokenize(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", bar(K.tokenize(F.col("text"))).alias("tokens"))


def _sql_words():
    return K.stop_words(S.english_words())


@query(
    lambda: f"""SELECT doc_id, {S.joined(S.without(S.tokens("text"), _sql_words()))} AS tokens
    FROM documents"""
)
def remove_stopwords(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    kept = K.remove_stopwords(K.tokenize(F.col("text")), K.stop_words())
    return docs.select("doc_id", bar(kept).alias("tokens"))


def sql_grams(w: str, hi: int) -> str:
    parts = [w] + [
        f"list_transform(range(1, len({w}) - {n - 2}), lambda i: "
        f"array_to_string({w}[i:i + {n - 1}], ' '))"
        for n in range(2, hi + 1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


@query(
    f"""SELECT doc_id, {S.joined(sql_grams("w", 5))} AS grams FROM (
      SELECT doc_id, {S.tokens("text")} AS w FROM documents)"""
)
def ngrams(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", bar(K.ngrams(K.tokenize(F.col("text")), 1, 5)).alias("grams"))


def sql_terms(hi: int) -> str:
    return f"""SELECT doc_id, {sql_grams("w", hi)} AS terms FROM (SELECT doc_id,
      {S.without(S.tokens("text"), _sql_words())} AS w FROM documents)"""


def sql_vocab(hi: int = 2) -> str:
    return f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
      SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(terms) AS term FROM ({sql_terms(hi)})) GROUP BY doc_id, term)
      GROUP BY term"""


def _listed(spark, sf_dir, hi: int = 2):
    docs = V.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", K.terms(F.col("text"), K.stop_words(), 1, hi).alias("terms"))


@query(
    lambda: f"""WITH n AS (SELECT count(*) AS n FROM documents)
    SELECT term, df, cf FROM ({sql_vocab(5)}), n WHERE df >= 0.01 * n AND df <= 0.9 * n"""
)
def vocab_df(spark, sf_dir):
    with features.vocab_levels(_listed(spark, sf_dir, 1), "terms", 5, min_df=0.01, max_df=0.9) as vocab:
        return materialize(vocab, "vocabulary")[0]


def sql_top(size: int = features.MAX_FEATURES) -> str:
    return f"""SELECT * FROM ({sql_vocab()}) WHERE df >= 2
      ORDER BY cf DESC, term LIMIT {size}"""


@query(sql_top)
def vocab_topk(spark, sf_dir):
    return features.vocab_topk(features.vocab_df(_listed(spark, sf_dir), "terms"))


def sql_idf(size: int = features.MAX_FEATURES) -> str:
    return f"""SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
      FROM ({sql_top(size)})"""


@query(lambda: f"SELECT term, round(idf, 6) AS idf FROM ({sql_idf()})")
def idf(spark, sf_dir):
    vocab = features.vocab_topk(features.vocab_df(_listed(spark, sf_dir), "terms"))
    rows = V.table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return features.idf(vocab, rows).select("term", F.round("idf", 6).alias("idf"))


@query(
    lambda: f"""SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6)
      AS value FROM (SELECT doc_id, t.term, (1 + ln(tf)) * idf AS x FROM (
        SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest(terms) AS term FROM ({sql_terms(2)})) GROUP BY doc_id, term) t
      JOIN ({sql_idf()}) v ON t.term = v.term)"""
)
def tfidf(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    model = features.Tfidf().fit(docs)
    long = features.tfidf_long(model, docs, "doc_id")
    return long.withColumn("value", F.round("value", 6))


# Fixed value: vocabulary bound of the features that are joined with the urgency flag.
UNION_FEATURES = 10_000


@query(
    lambda: f"""SELECT doc_id, urgent, (SELECT count(*) FROM ({sql_top(UNION_FEATURES)}))::INT + 1 AS width,
      round(coalesce(total, 0) + urgent, 4) AS total
    FROM (SELECT doc_id, regexp_matches(lower(text), '{"|".join(X.URGENT_WORDS)}')::INT AS urgent FROM documents)
    LEFT JOIN (SELECT doc_id, sum(x) / sqrt(sum(x * x)) AS total FROM (
      SELECT doc_id, t.term, tf * idf AS x FROM (
        SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest(terms) AS term FROM ({sql_terms(2)})) GROUP BY doc_id, term) t
      JOIN ({sql_idf(UNION_FEATURES)}) v ON t.term = v.term) GROUP BY doc_id) USING (doc_id)"""
)
def feature_union(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents").select(
        "doc_id", "text", X.urgency_flag(F.col("text")).alias("urgent")
    )
    model = features.Tfidf(output_col="tfidf", max_features=UNION_FEATURES, sublinear=False).fit(docs)
    both = features.feature_union(features.tfidf_transform(model, docs), ["tfidf", "urgent"])
    return both.select(
        "doc_id",
        "urgent",
        F.col("features.size").alias("width"),
        F.round(F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


HOT = ["high_quality", "lang_de", "lang_en", "lang_es", "lang_fr", "low_quality", "toxic", "unrated"]


@query(
    f"""SELECT id, array_to_string(list_transform({S.text_list(HOT)},
      lambda c: list_contains(labels, c)::INT), '') AS hot FROM (SELECT id,
      list_transform(labels, lambda x: {S.norm_label("x")}) AS labels FROM ({V.TICKETS_DOC}))"""
)
def multi_hot(spark, sf_dir):
    docs = V.tickets_doc(spark, sf_dir).select(
        "id", L.normalize_items(F.col("labels")).alias("labels")
    )
    hot = features.multi_hot(docs, "labels")
    return hot.select("id", F.array_join(F.col("hot").cast("array<string>"), "").alias("hot"))


@query(
    """SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS label_id
    FROM documents"""
)
def label_index(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "source")
    return features.label_index(docs, "source")


@query(
    """SELECT source, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
)
def class_weights(spark, sf_dir):
    weights = features.class_weights(V.table(spark, sf_dir, "documents"), "source")
    return weights.withColumn("weight", F.round("weight", 6))


# Model fitting and scoring

_MODELS: dict[tuple[str, str], object] = {}


def once(spark, sf_dir, name, make):
    """Fitted models shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def _loaded(spark, sf_dir, load) -> DataFrame:
    return materialize(load(spark, sf_dir), "loaded")[0]


def _models(spark, sf_dir) -> scoring.TicketModels:
    jobs = [
        (_category, training.fit_multi_label),
        (_priority, training.fit_single_label),
        (_intent, training.fit_single_label),
    ]

    def fit(load, how):
        with written(load(spark, sf_dir), "loaded") as docs:
            return how(docs)

    # one after the other, so that their tables don't add up on the disks
    return once(spark, sf_dir, "models", lambda: scoring.TicketModels(*[fit(*j) for j in jobs]))


@query()
def fit_single_label(spark, sf_dir):
    docs, _ = training.split_table(_intent(spark, sf_dir), "id", "label")
    train, _ = training.split_parts(docs)
    model = training.fit_single_label(train)
    return model.predict(docs).select("id", "is_test", F.col("label").alias("y"), "p")


@query()
def fit_multi_label(spark, sf_dir):
    docs, _ = training.split_table(_category(spark, sf_dir), "id", "labels")
    train, _ = training.split_parts(docs)
    model = training.fit_multi_label(train)
    return model.predict(docs).select(
        "id", "is_test", bar("labels").alias("y"), bar("p").alias("p")
    )


@query()
def fit_linear_svm(spark, sf_dir):
    docs, _ = training.split_table(_intent(spark, sf_dir), "id", "label")
    train, _ = training.split_parts(docs)
    model = training.fit_linear_svm(train, "label")
    return model.predict(docs).select("id", "is_test", F.col("label").alias("y"), "p")


@query()
def compare_models(spark, sf_dir):
    return training.compare_models(
        _category(spark, sf_dir),
        {
            "logreg": training.logistic(max_iter=3000),
            "svm": training.linear_svm(),
        },
        "id",
        label="labels",
    )


@query()
def train_all(spark, sf_dir):
    docs = V.tickets_doc(spark, sf_dir)
    labels = F.to_json("labels")
    entries = training.train_all(
        spark,
        {
            "category": docs.withColumn("labels-mapped", labels),
            "priority": docs.withColumn("priority", F.col("severity")),
            "intent": docs.withColumn("text", F.col("body")),
        },
        work_path(spark, "models"),
    )
    return entries.select(
        "target", "model_type", "rows", bar("labels").alias("labels"),
        F.to_json("metrics").alias("metrics"),
    )


@query()
def model_roundtrip(spark, sf_dir):
    path = work_path(spark, "model")
    _models(spark, sf_dir).intent.save(path)
    loaded = training.SingleLabelModel.load(spark, path)
    return loaded.predict(_intent(spark, sf_dir)).select("id", "label", "p")


@query()
def predict_batch(spark, sf_dir):
    tickets = V.tickets_doc(spark, sf_dir).select("id", "title", "body")
    found = scoring.predict_batch(tickets, _models(spark, sf_dir))
    return found.select(
        "id",
        X.format_predictions(F.col("category")).alias("category"),
        F.col("priority.label").alias("priority"),
        F.col("intent.label").alias("intent"),
    )


@query()
def score_table(spark, sf_dir):
    tickets = V.tickets_page(spark, sf_dir)
    path = work_path(spark, "scored")
    return scoring.score_table(spark, tickets, path, _models(spark, sf_dir)).select(
        "id", "category", "priority", "priority_confidence", "intent", "intent_confidence",
        "prediction_json",
    )


# Contracts of fits and scoring, which SQL can state though it can't repeat them

INTENT_ROWS = f"""SELECT * FROM (SELECT doc_id AS id, {S.clean("text")} AS text,
  {S.norm_label("lang")} AS label FROM documents) WHERE length(text) > 0"""

# Largest norm of the gradient that counts as fitted, as a share of the summed row weight.
FLAT = 1e-3


@query(
    f"""SELECT label, count(*) AS rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)
      AS weight, true AS fitted FROM ({INTENT_ROWS}) GROUP BY label"""
)
def fit_single_label_optimal(spark, sf_dir):
    """Per class: its rows and weight, and whether the objective's gradient vanishes.

    The summed weighted loss plus half the squared norm of the coefficients has the gradient
    sum(w * (p - y) * x) + b for every class; it is summed here over the rows from the fitted
    coefficients b.
    """
    docs = _loaded(spark, sf_dir, _intent)
    model = training.fit_single_label(docs)
    counts = features.class_weights(docs, "label")
    rows = model.scores(features.tfidf_transform(model.features, docs), "share")
    rows = rows.join(F.broadcast(counts.select("label", "weight")), "label")  # a row per class
    vector = F.col("features")
    entries = rows.select(
        "label", "weight", "share", F.inline(F.arrays_zip(vector["indices"], vector["values"]))
    ).toDF("label", "weight", "share", "idx", "x")
    pulls = [
        F.sum(F.col("weight") * F.col("x") * (F.get("share", k) - (F.col("label") == name).cast("int"))).alias(f"g{k}")
        for k, name in enumerate(model.labels)
    ]
    sums = entries.groupBy("idx").agg(*pulls)
    matrix = model.coefficients
    held = spark.createDataFrame(
        [(i, [float(v) for v in matrix[:, i]]) for i in range(matrix.shape[1])], "idx int, b array<double>"
    )
    slopes = held.join(sums, "idx", "left").na.fill(0.0)
    norms = slopes.agg(
        *[F.sqrt(F.sum((F.col(f"g{k}") + F.get("b", k)) ** 2)).alias(n) for k, n in enumerate(model.labels)]
    ).first()
    total = docs.count()
    flat = F.create_map(*[F.lit(x) for n in model.labels for x in (n, norms[n] <= FLAT * total)])
    return counts.select(
        "label", F.col("n").alias("rows"), F.round("weight", 6).alias("weight"), flat[F.col("label")].alias("fitted")
    )


@query(f"SELECT id, label, true AS same FROM ({INTENT_ROWS})")
def model_roundtrip_same(spark, sf_dir):
    """Whether a saved model predicts for each row what the model predicted before."""
    path = work_path(spark, "model")
    model, docs = _models(spark, sf_dir).intent, _intent(spark, sf_dir)
    model.save(path)
    loaded = training.SingleLabelModel.load(spark, path)
    both = loaded.predict(model.predict(docs, "before"), "after")
    return both.select("id", "label", F.col("before").eqNullSafe(F.col("after")).alias("same"))


def _in_contract(category, priority, intent, models):
    """Ranks, ranges and names of one row's predictions."""
    falling = F.forall(
        F.sequence(F.lit(1), F.size(category)),
        lambda i: F.coalesce(
            F.get(category, i - 1)["confidence"] >= F.get(category, i)["confidence"], F.lit(True)
        ),
    )
    named = F.forall(category, lambda x: x["label"].isin(*models.category.labels))
    found = F.concat(category, F.array(priority, intent))
    return (
        F.size(category).between(1, 3)
        & falling
        & named
        & priority["label"].isin(*models.priority.labels)
        & intent["label"].isin(*models.intent.labels)
        & F.forall(found, lambda x: x["confidence"].between(0, 1))
    )


@query("SELECT doc_id AS id, true AS valid, true AS sums_to_one FROM documents")
def predict_batch_contract(spark, sf_dir):
    """One to three categories, best first, known names, confidences and shares in range."""
    models = _models(spark, sf_dir)
    tickets = V.tickets_doc(spark, sf_dir).select("id", "title", "body")
    found = scoring.predict_batch(tickets, models)
    texts = X.add_text_column(tickets).select("id", "text")
    shares = scoring.probabilities(models.intent, texts, "shares").select("id", "shares")
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    return found.join(shares, "id", "left").select(
        "id",
        _in_contract(F.col("category"), F.col("priority"), F.col("intent"), models).alias("valid"),
        F.coalesce(F.abs(total - 1) < 1e-9, F.lit(True)).alias("sums_to_one"),
    )


@query("SELECT page_id AS id, true AS equal, 1 AS logged FROM pages")
def score_table_contract(spark, sf_dir):
    """The written table's JSON says what its columns say, and every row is in the log."""
    path, log = work_path(spark, "scored"), work_path(spark, "log")
    scored = scoring.score_table(
        spark, V.tickets_page(spark, sf_dir), path, _models(spark, sf_dir), log=log
    )
    kind = (
        "category array<struct<label string, confidence double>>, "
        "priority struct<label string, confidence double>, intent struct<label string, confidence double>"
    )
    said = F.from_json("prediction_json", kind)
    equal = (
        (X.format_predictions(said["category"]) == F.col("category"))
        & (said["priority"]["label"] == F.col("priority"))
        & (said["priority"]["confidence"] == F.col("priority_confidence"))
        & (said["intent"]["label"] == F.col("intent"))
        & (said["intent"]["confidence"] == F.col("intent_confidence"))
    )
    logged = spark.read.parquet(log).where("latency_ms >= 0 AND backend IS NOT NULL").count()
    rows = scored.count()
    return scored.select("id", equal.alias("equal"), F.lit(int(logged == rows)).alias("logged"))


CATEGORY_LABELS = f"""SELECT id, unnest(list_distinct(list_transform(labels,
  lambda x: {S.norm_label("x")}))) AS label FROM (SELECT id, {S.combined("title", "body")} AS text,
  labels FROM ({V.TICKETS_DOC})) WHERE length(text) > 0"""


def _fitted():
    return (F.col("gradient") <= FLAT * F.col("total")).alias("fitted")


@query(f"SELECT label, count(*) AS rows, true AS fitted FROM ({CATEGORY_LABELS}) GROUP BY label")
def fit_multi_label_optimal(spark, sf_dir):
    """Per label: its rows, and whether the gradient of its weighted objective vanishes."""
    docs = _loaded(spark, sf_dir, _category)
    model = training.fit_multi_label(docs)
    gradients = training.fit_gradients(model, docs, "labels")
    counts = docs.select("id", F.explode(F.array_distinct("labels")).alias("label"))
    counts = counts.groupBy("label").agg(F.count("*").alias("rows"))
    return counts.join(gradients, "label").select("label", "rows", _fitted())


@query(f"SELECT label, count(*) AS rows, true AS fitted FROM ({INTENT_ROWS}) GROUP BY label")
def fit_linear_svm_optimal(spark, sf_dir):
    """The same of a linear SVM's classes, whose objective is strongly convex and smooth."""
    docs = _loaded(spark, sf_dir, _intent)
    model = training.fit_linear_svm(docs, "label")
    gradients = training.fit_gradients(model, docs, "label", training.linear_svm())
    counts = docs.groupBy("label").agg(F.count("*").alias("rows"))
    return counts.join(gradients, "label").select("label", "rows", _fitted())


@query(
    f"""SELECT id, label, true AS same FROM (SELECT id, {S.combined("title", "body")} AS text,
      {S.norm_label("severity")} AS label FROM ({V.TICKETS_DOC})) WHERE length(text) > 0"""
)
def svm_union_roundtrip(spark, sf_dir):
    """An SVM on TF-IDF beside the urgency flag, saved and loaded as one pipeline."""
    docs, path = _loaded(spark, sf_dir, _priority), work_path(spark, "model")
    both = features.TextAndUrgency(max_features=UNION_FEATURES, sublinear=False)
    model = training.fit_linear_svm(docs, "label", features=both)
    model.save(path)
    again = training.OneVsRestModel.load(spark, path)
    scored = again.scores(model.scores(docs, "before"), "after")
    return scored.select("id", "label", (F.col("before") == F.col("after")).alias("same"))


@query(
    """SELECT text, model, true AS valid FROM (SELECT unnest(['title', 'body']) AS text),
      (SELECT unnest(['logreg', 'svm']) AS model) WHERE (SELECT count(*) FROM documents) > 0"""
)
def compare_models_contract(spark, sf_dir):
    """Each candidate on each text column, on one split: shares that beat chance."""
    docs = V.tickets_doc(spark, sf_dir).select("id", "title", "body", F.col("intent").alias("label"))
    classes = docs.select("label").distinct().count()
    found = training.compare_texts(
        docs, ["title", "body"], {"logreg": training.logistic(), "svm": training.linear_svm()}, "id"
    )
    valid = [F.col(c).between(1 / classes, 1) for c in ("accuracy", "macro_f1")]
    return found.select("text", "model", (valid[0] & valid[1]).alias("valid"))


def _sql_target(target: str, rows: str) -> str:
    return f"""SELECT '{target}' AS target, count(DISTINCT id) AS rows,
      string_agg(DISTINCT label, '|' ORDER BY label) AS labels, true AS valid FROM ({rows})"""


@query(
    " UNION ALL ".join(
        [
            _sql_target("category", CATEGORY_LABELS),
            _sql_target(
                "priority",
                f"""SELECT id, {S.norm_label("severity")} AS label FROM (SELECT id, severity,
                {S.combined("title", "body")} AS text FROM ({V.TICKETS_DOC})) WHERE length(text) > 0""",
            ),
            _sql_target("intent", INTENT_ROWS),
        ]
    )
)
def train_all_contract(spark, sf_dir):
    """Rows and labels of each target, and whether its saved model has the labels and its
    metrics are shares."""
    docs, path = V.tickets_doc(spark, sf_dir), work_path(spark, "models")
    sources = {
        "category": docs.withColumn("labels-mapped", F.to_json("labels")),
        "priority": docs.withColumn("priority", F.col("severity")),
        "intent": docs.withColumn("text", F.col("body")),
    }
    entries = training.train_all(spark, sources, path)
    models = scoring.TicketModels.load(spark, path)
    held = F.create_map(
        *[x for t in sources for x in (F.lit(t), F.array(*[F.lit(c) for c in getattr(models, t).labels]))]
    )
    shares = F.forall(F.map_values("metrics"), lambda x: x.between(0, 1)) & (F.size("metrics") == 2)
    return entries.select(
        "target", "rows", bar("labels").alias("labels"),
        (shares & (held[F.col("target")] == F.col("labels"))).alias("valid"),
    )


CENTROIDS = """SELECT label, list(c ORDER BY i) AS centre FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS c FROM embeddings, range(1, 65) r(i)
  GROUP BY label, i) GROUP BY label"""


@query(
    f"""SELECT vec_id, arg_max(c.label, list_dot_product(list_transform(embedding,
        lambda x: x::DOUBLE), centre)) AS nearest
    FROM embeddings e, ({CENTROIDS}) c GROUP BY vec_id"""
)
def external_scorer(spark, sf_dir):
    vectors = V.table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("c"))
        .orderBy("label", "i")
        .toArrow()
    )
    centres = np.array(means["c"].to_numpy()).reshape(-1, 64)

    def load():
        return lambda batch: batch.astype("float64") @ centres.T

    score = scoring.external_scorer(load, [64])
    classes = F.array(*[F.lit(i) for i in range(len(centres))])
    return vectors.select(
        "vec_id", D.decode_single(score(F.col("embedding")), classes)["label"].alias("nearest")
    )


@query(
    f"""SELECT id, {V.CLASS_LIST}[list_position(share, list_max(share))] AS label,
      round(list_max(share), 4) AS confidence FROM ({V.SOFTMAX_SCORES})"""
)
def decode_single(spark, sf_dir):
    best = D.decode_single(D.softmax_scores(F.col("raw")), V.CLASSES)
    return V.scores(spark, sf_dir).select("id", best.alias("b")).select("id", "b.*")


SIGMOID = "list_transform(raw, lambda x: 1 / (1 + exp(-x)))"


@query(f"SELECT id, {SQL_CATEGORY} AS category FROM ({V.DECODED})")
def decode_multi(spark, sf_dir):
    chosen = D.decode_multi(D.sigmoid_scores(F.col("raw")), V.CLASSES)
    return V.scores(spark, sf_dir).select("id", X.format_predictions(chosen).alias("category"))


def _long(c):
    return F.posexplode(c).alias("place", "score")


@query(
    f"""SELECT id, (unnest(range(0, 10)))::INT AS place, round(unnest(s), 6) AS score
    FROM (SELECT id, {SIGMOID} AS s FROM ({V.SCORES}))"""
)
def sigmoid_scores(spark, sf_dir):
    found = V.scores(spark, sf_dir).select("id", _long(D.sigmoid_scores(F.col("raw"))))
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""SELECT id, (unnest(range(0, 12)))::INT AS place, round(unnest(s), 6) AS score FROM (
      SELECT id, list_concat(share, [1 / (1 + exp(2 * raw[1])), 1 / (1 + exp(-2 * raw[1]))]) AS s
      FROM ({V.SOFTMAX_SCORES}))"""
)
def softmax_scores(spark, sf_dir):
    raw = F.col("raw")
    both = F.concat(D.softmax_scores(raw), D.softmax_scores(F.slice(raw, 1, 1)))
    found = V.scores(spark, sf_dir).select("id", _long(both))
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""SELECT id, {SQL_CATEGORY} AS category, priority.label AS priority,
      priority.confidence AS confidence FROM ({V.DECODED})"""
)
def decode_logits(spark, sf_dir):
    raw = F.col("raw")
    return V.scores(spark, sf_dir).select(
        "id",
        X.format_predictions(D.decode_logits(raw, V.CLASSES, "multi")).alias("category"),
        D.decode_logits(raw, V.CLASSES, "single")["label"].alias("priority"),
        D.decode_logits(raw, V.CLASSES, "single")["confidence"].alias("confidence"),
    )


def _sql_struct(x: str) -> str:
    return f"""'{{"label":"' || {x}.label || '","confidence":' || {x}.confidence || '}}'"""


@query(
    f"""SELECT id, title, body, {SQL_CATEGORY} AS category, priority.label AS priority,
      priority.confidence AS priority_confidence, intent.label AS intent,
      intent.confidence AS intent_confidence,
      '{{"category":[' || array_to_string(list_transform(category, lambda c: {_sql_struct("c")}), ',')
        || '],"priority":' || {_sql_struct("priority")} || ',"intent":' || {_sql_struct("intent")}
        || '}}' AS prediction_json
    FROM ({V.DECODED})"""
)
def flatten_predictions(spark, sf_dir):
    return scoring.flatten_predictions(V.decoded(spark, sf_dir))


@query(
    f"""SELECT id, title, body, '{{"category":[' || array_to_string(list_transform(category,
      lambda c: {_sql_struct("c")}), ',') || '],"priority":' || {_sql_struct("priority")}
      || ',"intent":' || {_sql_struct("intent")} || '}}' AS prediction FROM ({V.DECODED})"""
)
def with_json(spark, sf_dir):
    return scoring.with_json(V.decoded(spark, sf_dir))


@query(f"SELECT doc_id, array_to_string(({S.tokens('text')})[1:256], ' ') AS text FROM documents")
def truncate_tokens(spark, sf_dir):
    docs = V.texts(spark, sf_dir, "documents")
    return docs.select("doc_id", K.truncate_tokens(F.col("text")).alias("text"))


# Evaluation

def _some_missing(df: DataFrame) -> DataFrame:
    """Every fifth prediction is missing."""
    return df.withColumn("p", F.when(F.col("id") % 5 != 0, F.col("p")))


@query(f"SELECT round(avg((id % 5 <> 0 AND y = p)::INT), 6) AS accuracy FROM ({V.PREDICTED})")
def accuracy(spark, sf_dir):
    found = metrics.accuracy(_some_missing(V.predicted(spark, sf_dir)))
    return found.select(F.round("accuracy", 6).alias("accuracy"))


@query(
    f"""SELECT round(avg((id % 5 <> 0 AND list_sort(list_distinct(y)) = list_sort(list_distinct(p)))::INT), 6)
      AS subset_accuracy FROM ({V.PREDICTED_MULTI})"""
)
def subset_accuracy(spark, sf_dir):
    found = metrics.subset_accuracy(_some_missing(V.predicted_multi(spark, sf_dir)))
    return found.select(F.round("subset_accuracy", 6).alias("subset_accuracy"))


SOME_MISSING = f"SELECT * REPLACE (CASE WHEN id % 5 <> 0 THEN p END AS p) FROM ({V.PREDICTED})"
SOME_EMPTY = f"SELECT * REPLACE (CASE WHEN id % 5 <> 0 THEN p ELSE [] END AS p) FROM ({V.PREDICTED_MULTI})"

MULTI_COUNTS = f"""SELECT c AS label, sum((list_contains(y, c) AND list_contains(p, c))::INT) AS tp,
  sum(list_contains(p, c)::INT) AS predicted, sum(list_contains(y, c)::INT) AS support
FROM ({SOME_EMPTY}), (SELECT unnest({V.CLASS_LIST}) AS c) GROUP BY c"""

SINGLE_COUNTS = f"""SELECT c AS label, sum(coalesce(y = c AND p = c, false)::INT) AS tp,
  sum(coalesce(p = c, false)::INT) AS predicted, sum((y = c)::INT) AS support
FROM ({SOME_MISSING}), (SELECT unnest({V.CLASS_LIST}) AS c) GROUP BY c"""

SCORED = """SELECT label, support::BIGINT AS support, tp, predicted,
  CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
FROM ({counts}) WHERE predicted + support > 0 OR {keep}"""

MULTI_SCORED = SCORED.format(counts=MULTI_COUNTS, keep="true")
SINGLE_SCORED = SCORED.format(counts=SINGLE_COUNTS, keep="false")

AVERAGES = """SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s"""

REPORT = """WITH s AS ({scored}), r AS (
SELECT label, precision, recall, f1, support FROM s UNION ALL {first} UNION ALL """ + AVERAGES + """)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support::BIGINT AS support FROM r"""


@query(f"SELECT round(2 * sum(tp) / (sum(predicted) + sum(support)), 6) AS micro_f1 FROM ({MULTI_COUNTS})")
def micro_f1(spark, sf_dir):
    found = metrics.micro_f1(_some_missing(V.predicted_multi(spark, sf_dir)), V.CLASSES)
    return found.select(F.round("micro_f1", 6).alias("micro_f1"))


@query(
    f"""SELECT (SELECT round(avg(f1), 6) FROM ({SINGLE_SCORED})) AS single,
      (SELECT round(avg(f1), 6) FROM ({MULTI_SCORED})) AS multi"""
)
def macro_f1(spark, sf_dir):
    single = metrics.macro_f1(_some_missing(V.predicted(spark, sf_dir)))
    single = single.withColumnRenamed("macro_f1", "single")
    multi = metrics.macro_f1(_some_missing(V.predicted_multi(spark, sf_dir)), V.CLASSES)
    return single.select(
        F.round("single", 6).alias("single"), F.round(multi.scalar(), 6).alias("multi")
    )


def _rounded(report):
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    REPORT.format(
        scored=SINGLE_SCORED,
        first="SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM s",
    )
)
def classification_report(spark, sf_dir):
    return _rounded(metrics.classification_report(_some_missing(V.predicted(spark, sf_dir))))


@query(
    REPORT.format(
        scored=MULTI_SCORED,
        first=f"""SELECT 'micro avg', sum(tp) / sum(predicted), sum(tp) / sum(support),
          2 * sum(tp) / (sum(predicted) + sum(support)), sum(support) FROM s
        UNION ALL SELECT 'samples avg',
          avg(CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(y, p)) / len(p) END),
          avg(CASE WHEN len(y) = 0 THEN 0 ELSE len(list_intersect(y, p)) / len(y) END),
          avg(CASE WHEN len(y) + len(p) = 0 THEN 0
            ELSE 2 * len(list_intersect(y, p)) / (len(y) + len(p)) END), sum(len(y))
        FROM ({SOME_EMPTY})""",
    )
)
def classification_report_multi(spark, sf_dir):
    return _rounded(
        metrics.classification_report_multi(
            _some_missing(V.predicted_multi(spark, sf_dir)), V.CLASSES
        )
    )


@query(
    "SELECT c AS label, "
    + ", ".join(f"sum((y = c AND p = '{x}')::INT)::BIGINT AS {x}" for x in V.CLASSES)
    + f" FROM ({V.PREDICTED}), (SELECT unnest({V.CLASS_LIST}) AS c) GROUP BY c"
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(V.predicted(spark, sf_dir), V.CLASSES)


# Aggregations and reports

@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return reports.value_counts(V.table(spark, sf_dir, "events"), "event_type")


@query(
    """SELECT o_orderpriority, round(100 * count(*) / (SELECT count(*) FROM orders), 6) AS percent
    FROM orders GROUP BY o_orderpriority"""
)
def value_shares(spark, sf_dir):
    shares = reports.value_shares(V.table(spark, sf_dir, "orders"), "o_orderpriority")
    return shares.withColumn("percent", F.round("percent", 6))


USES = f"SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM ({CLEAN_LABELS})) GROUP BY label"


@query(f"SELECT * FROM ({USES}) ORDER BY count DESC, label LIMIT 20")
def label_counts(spark, sf_dir):
    return reports.label_counts(_cleaned(spark, sf_dir), "labels", 20)


@query(
    f"""SELECT n, round(running / total, 6) AS coverage FROM (
      SELECT row_number() OVER w AS n, sum(count) OVER w AS running,
        sum(count) OVER () AS total FROM ({USES})
      WINDOW w AS (ORDER BY count DESC, label ROWS UNBOUNDED PRECEDING))
    WHERE running >= 0.83 * total ORDER BY n LIMIT 1"""
)
def label_coverage(spark, sf_dir):
    found = reports.label_coverage(_cleaned(spark, sf_dir), "labels")
    return found.withColumn("coverage", F.round("coverage", 6))


@query("SELECT DISTINCT source, (SELECT count(DISTINCT source) FROM documents) AS classes FROM documents")
def distinct_classes(spark, sf_dir):
    return reports.distinct_classes(V.table(spark, sf_dir, "documents"), "source")


STATS = """round(avg(priority_conf), 6) AS avg_priority_conf,
  round(avg(intent_conf), 6) AS avg_intent_conf, round(avg(latency_ms), 6) AS avg_latency_ms"""


def _round_stats(df):
    return df.withColumns(
        {c: F.round(c, 6) for c in ("avg_priority_conf", "avg_intent_conf", "avg_latency_ms")}
    )


@query(f"SELECT count(*) AS predictions, {STATS} FROM ({V.HISTORY})")
def session_stats(spark, sf_dir):
    return _round_stats(reports.session_stats(V.history(spark, sf_dir)))


@query(
    f"""SELECT 'priority' AS of, priority AS label, count(*) AS count FROM ({V.HISTORY})
      GROUP BY priority UNION ALL
    SELECT 'intent', {sql_title("replace(intent, '_', ' ')")}, count(*) FROM ({V.HISTORY})
      GROUP BY intent"""
)
def distribution(spark, sf_dir):
    seen = V.history(spark, sf_dir)
    parts = [
        reports.distribution(seen, c, display=c == "intent").select(
            F.lit(c).alias("of"), F.col(c).alias("label"), "count"
        )
        for c in ("priority", "intent")
    ]
    return curation.union_splits(parts)


@query(
    f"""SELECT strftime(timestamp, '%H:%M:%S') AS "Time",
      CASE WHEN length(title) > 60 THEN title[1:60] || '…' ELSE title END AS "Title",
      priority AS "Priority", intent AS "Intent", top_category AS "Top Category",
      latency_ms AS "Latency (ms)" FROM (SELECT * FROM ({V.TIED_HISTORY})
        ORDER BY timestamp DESC, title, priority, intent, top_category, latency_ms LIMIT 700)"""
)
def recent_predictions(spark, sf_dir):
    """Times are cut to the hour, so that many rows tie at the limit."""
    tied = V.history(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return reports.recent_predictions(tied, 700)


@query(
    f"""SELECT length(title) AS title_length, length(body) AS body_length,
      '{scoring.BACKEND}' AS backend, 2.5::DOUBLE AS latency_ms,
      priority.confidence AS priority_confidence, intent.confidence AS intent_confidence,
      category[1].confidence AS top_category_confidence, priority.label AS predicted_priority,
      intent.label AS predicted_intent FROM ({V.DECODED})"""
)
def prediction_log(spark, sf_dir):
    decoded = V.decoded(spark, sf_dir)
    rows = decoded.count()
    return reports.prediction_log(scoring.attach_run(decoded, 2.5 * rows, rows))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS total,
      round(sum(value), 4) AS total_latency_ms, round(avg(value), 6) AS avg_latency_ms_per_ticket,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS processed_at FROM events GROUP BY 1"""
)
def batch_summary(spark, sf_dir):
    runs = V.table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("batch_id"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("processed_at"),
    )
    return reports.batch_summary(runs).select(
        "batch_id",
        "total",
        F.round("total_latency_ms", 4).alias("total_latency_ms"),
        F.round("avg_latency_ms_per_ticket", 6).alias("avg_latency_ms_per_ticket"),
        F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"),
    )


@query(
    """SELECT upper(event_type[1:1]) || event_type[2:] AS "Target", 'events' AS "Model",
      regexp_replace(count(*)::VARCHAR, '([0-9])([0-9]{3})$', '\\1,\\2') AS "Training Rows",
      printf('%.3f', avg(user_id) / 10000) AS "Macro F1",
      printf('%.3f', count(DISTINCT user_id) / count(*)) AS "Accuracy"
    FROM events GROUP BY event_type"""
)
def model_table(spark, sf_dir):
    entries = (
        V.table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("target"))
        .agg(
            F.count("*").alias("rows"),
            F.create_map(
                F.lit("macro_f1"), F.avg("user_id") / 10000,
                F.lit("accuracy"), F.countDistinct("user_id") / F.count("*"),
            ).alias("metrics"),
        )
        .withColumn("model_type", F.lit("events"))
    )
    return reports.model_table(entries, ["macro_f1", "accuracy"])


INVENTORY = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS rows FROM {t}" for t in INVENTORY)
)
def dataset_inventory(spark, sf_dir):
    return reports.dataset_inventory({t: V.table(spark, sf_dir, t) for t in INVENTORY})


# Streams

def _ticket_stream(spark, sf_dir):
    pages = jobs.read_stream(
        spark, f"{sf_dir}/page*.parquet", V.table(spark, sf_dir, "pages").schema
    )
    return pages.select(
        F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("body")
    )


PAGE_TICKETS = "SELECT page_id AS id, url AS title, html AS body FROM pages"


@query(
    f"""SELECT id, coalesce({sql_reason("title", "body")}, 'ok') AS state,
      regexp_matches(lower(body), '{"|".join(X.URGENT_WORDS)}')::INT AS urgent FROM ({PAGE_TICKETS})"""
)
def stream_score(spark, sf_dir):
    flag = X.urgency_flag(F.col("body")).alias("urgent")
    out = work_path(spark, "stream")
    jobs.stream_score(
        _ticket_stream(spark, sf_dir), lambda df: df.select("id", flag), out, f"{out}/state", log=False
    ).awaitTermination()
    scored, refused = (spark.read.parquet(f"{out}/{t}") for t in ("scored", "refused"))
    return scored.select("id", F.lit("ok").alias("state"), "urgent").unionByName(
        refused.select("id", F.col("reject_reason").alias("state"), flag)
    )


@query(
    f"""SELECT id, state, 1 AS times, state = 'ok' AS logged, state = 'ok' AS same FROM (
      SELECT id, coalesce({sql_reason("title", "body")}, 'ok') AS state FROM ({PAGE_TICKETS}))"""
)
def stream_predict(spark, sf_dir):
    """Fitted models over a stream that is restarted: how often a ticket stands in the tables,
    whether the log has its lengths, and whether its predictions are those of a batch."""
    models, out = _models(spark, sf_dir), work_path(spark, "stream")
    for _ in range(2):
        jobs.stream_score(
            _ticket_stream(spark, sf_dir), lambda df: scoring.predict_batch(df, models), out, f"{out}/state"
        ).awaitTermination()
    scored, refused, log = (spark.read.parquet(f"{out}/{t}") for t in ("scored", "refused", "log"))
    pages = V.table(spark, sf_dir, "pages")
    tickets = pages.select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("body"))
    found = ["category", "priority", "intent"]
    batch = scoring.predict_batch(tickets, models).select(
        F.col("id").alias("of"), F.to_json(F.struct(*found)).alias("wanted")
    )
    checked = scored.join(batch, F.col("id") == F.col("of")).withColumn(
        "same", F.to_json(F.struct(*found)) == F.col("wanted")
    )
    counts = log.groupBy("title_length", "body_length").agg(F.count("*").alias("n")).alias("l")
    sizes = scored.groupBy(F.length("title").alias("t"), F.length("body").alias("b")).agg(F.count("*").alias("m"))
    wrong = sizes.join(
        counts, (F.col("t") == F.col("title_length")) & (F.col("b") == F.col("body_length")), "full"
    ).where(~F.col("n").eqNullSafe(F.col("m")))
    logged = wrong.count() == 0
    good = checked.groupBy("id").agg(
        F.lit("ok").alias("state"), F.count("*").cast("int").alias("times"),
        F.lit(logged).alias("logged"), F.bool_and("same").alias("same"),
    )
    bad = refused.groupBy("id").agg(
        F.first("reject_reason").alias("state"), F.count("*").cast("int").alias("times"),
        F.lit(False).alias("logged"), F.lit(False).alias("same"),
    )
    return good.unionByName(bad)


@query(
    f"""SELECT priority, count(*) AS predictions, round(sum(latency_ms), 4) AS latency_sum, {STATS}
    FROM ({V.HISTORY}) GROUP BY priority"""
)
def stream_stats(spark, sf_dir):
    """Two arrivals of files, with the query stopped and started again between them."""
    events, path = V.table(spark, sf_dir, "events"), work_path(spark, "stats")
    for part in range(2):
        arrived = events.where(F.pmod("event_id", F.lit(2)) == part)
        arrived.write.mode("append").parquet(f"{path}/events")
        stream = jobs.read_stream(spark, f"{path}/events", events.schema)
        jobs.stream_stats(V.as_history(stream), f"{path}/table", f"{path}/state").awaitTermination()
    found = jobs.latest_stats(spark, f"{path}/table")
    return _round_stats(found).withColumn("latency_sum", F.round("latency_sum", 4))
