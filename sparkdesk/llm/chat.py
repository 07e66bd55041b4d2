r"""Chat formatting as relational work: collect, sort, merge, concatenate.

A conversation's rows are collected as structs and sorted by turn, adjacent turns of one role
are merged by an array aggregation into one block, and blocks are concatenated:

    <|im_start|>role\ntext<|im_sep|>text of the same role<|im_end|>\n

``<|im_sep|>`` keeps merged turns apart, so the rows can be read back. A control string inside
a text gets a backslash after its first character (one more if it has some already), which
takes its effect and can be undone. Roles are escaped in the same way, their newlines as
``\n``. ``loss`` lists (start, length) in code points, from 0, of every text whose role is
trained on.

A conversation is one output value, so its turns meet in one row; a conversation has to fit
one task, as its formatted text has to.

Cases: null texts and roles count as empty, null turns come first, equal turns are ordered by
role and text, rows of a null conversation id form one conversation, an empty table gives no
conversations, other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.functions.text import let
from sparkdesk.llm.common import read, whole

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Strings that steer a model in this template or in others that may read the text later.
CONTROLS = (
    START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TRAINED = ("assistant",)

# Turns whose lengths are summed at once on the way to a running sum.
STRIDE = 128


def _by_first(controls: tuple[str, ...]) -> list[tuple[str, str]]:
    """(first character, pattern of what may follow it) of control strings.

    No control string may hold another one, or a backslash: escaping one would then change
    whether the other is found.
    """
    rests: dict[str, list[str]] = {}
    for a in controls:
        if len(a) < 2 or "\\" in a or any(b in a[1:] for b in controls):
            raise ValueError(f"control string {a!r} can't be escaped reversibly")
        rests.setdefault(a[0], []).append(rf"\Q{a[1:]}\E")
    return [(rf"\Q{first}\E", "|".join(rest)) for first, rest in sorted(rests.items())]


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    for first, rest in _by_first(controls):
        text = F.regexp_replace(text, rf"({first})(\\*+)(?={rest})", r"$1\\$2")
    return text


def unescape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    for first, rest in reversed(_by_first(controls)):
        text = F.regexp_replace(text, rf"({first})\\(\\*+)(?={rest})", "$1$2")
    return text


def escape_role(role: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    bare = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(bare, controls)


def unescape_role(role: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    # a doubled backslash stands aside while \n is read
    halves = F.split(unescape(role, controls), r"\\\\")
    return F.array_join(
        F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"
    )


def _merged(rows: Column) -> Column:
    """Blocks of adjacent rows with the same role: where runs start, and what lies between."""
    place = F.sequence(F.lit(0), F.size(rows) - 1)
    starts = F.filter(place, lambda i: (i == 0) | (F.get(rows, i)["role"] != F.get(rows, i - 1)["role"]))

    def cut(s: Column) -> Column:
        def block(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(s, j + 1), F.size(rows))
            own = F.slice(rows, start + 1, end - start)
            return F.struct(
                F.get(rows, start)["role"].alias("role"),
                F.transform(own, lambda r: r["text"]).alias("texts"),
            )

        return F.transform(s, block)

    return let(starts, cut)


def _running(widths: Column) -> Column:
    """The sum of all entries before each entry: of whole strides, and inside the own one."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def stride(i: Column) -> Column:
        return F.floor(i / STRIDE).cast("int")

    strides = F.sequence(F.lit(0), stride(F.size(widths) - 1))
    sums = F.transform(strides, lambda j: total(F.slice(widths, j * STRIDE + 1, STRIDE)))
    ahead = let(sums, lambda s: F.transform(s, lambda x, j: total(F.slice(s, F.lit(1), j))))
    return let(
        ahead,
        lambda h: F.transform(
            widths,
            lambda x, i: F.get(h, stride(i)) + total(F.slice(widths, stride(i) * STRIDE + 1, i % STRIDE)),
        ),
    )


def _spans(rows: Column, trained: tuple[str, ...]) -> Column:
    """Place and length of each text of a trained role in the formatted chat."""

    def measured(r: Column, i: Column) -> Column:
        opens = (i == 0) | (r["role"] != F.get(rows, i - 1)["role"])
        closes = (i == F.size(rows) - 1) | (r["role"] != F.get(rows, i + 1)["role"])
        lead = F.when(opens, F.length(r["role"]) + len(START) + 1).otherwise(len(SEP))
        length = F.length(r["text"])
        return F.struct(
            lead.alias("lead"),
            length.alias("length"),
            (lead + length + F.when(closes, len(END) + 1).otherwise(0)).alias("width"),
            r["role"].isin(*trained).alias("trained"),
        )

    def placed(m: Column) -> Column:
        at = let(F.transform(m, lambda x: x["width"]), _running)
        spans = F.zip_with(
            m,
            at,
            lambda x, start: F.when(
                x["trained"], F.struct((start + x["lead"]).alias("start"), x["length"].alias("length"))
            ),
        )
        return F.array_compact(spans)

    return let(F.transform(rows, measured), placed)


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained: tuple[str, ...] = TRAINED,
    controls: tuple[str, ...] = CONTROLS,
) -> DataFrame:
    """(conv_id, formatted, loss, n_blocks): one row per conversation."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        whole(F.col(role_col)).alias("role"),
        whole(F.col(text_col)).alias("text"),
    )
    chats = turns.select(F.col(id_col).alias("conv_id"), row.alias("row"))
    chats = chats.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    escaped = F.transform(
        "rows",
        lambda r: F.struct(
            escape_role(r["role"], controls).alias("role"), escape(r["text"], controls).alias("text")
        ),
    )
    chats = chats.select(
        "conv_id",
        let(
            escaped,
            lambda r: F.struct(_merged(r).alias("blocks"), _spans(r, trained).alias("loss")),
        ).alias("chat"),
    ).select("conv_id", "chat.blocks", "chat.loss")
    pieces = F.transform(
        "blocks",
        lambda b: F.concat(
            F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n")
        ),
    )
    return chats.select(
        "conv_id",
        F.array_join(pieces, "").alias("formatted"),
        "loss",
        F.size("blocks").alias("n_blocks"),
    )


def read_back(chats: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, turns, loss_text): the rows and the trained text found in formatted chats."""
    blocks = F.slice(F.split("formatted", rf"\Q{START}\E"), 2, 1 << 30)

    def rows(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        inside = F.substr(
            block,
            F.length(role) + 2,
            F.length(block) - F.length(role) - F.lit(1 + len(END) + 1),
        )
        return F.transform(
            F.split(inside, rf"\Q{SEP}\E"),
            lambda text: F.struct(
                unescape_role(role, controls).alias("role"), unescape(text, controls).alias("text")
            ),
        )

    trained = F.transform(
        "loss",
        lambda span: unescape(F.substr(F.col("formatted"), span["start"] + 1, span["length"]), controls),
    )
    return chats.select(
        "conv_id",
        F.flatten(F.transform(blocks, rows)).alias("turns"),
        F.array_join(trained, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = read_back(format_chats(rows.unionByName(probe)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


def op8_sql() -> str:
    def escaped(column: str) -> str:
        for first, rests in _sql_rests().items():
            column = f"regexp_replace({column}, '({first})(\\\\*)({rests})', '\\1\\\\\\2\\3', 'g')"
        return column

    role = escaped("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS fresh,
    length({escaped("text")}) AS text_chars, length({role}) AS role_chars
  FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN fresh THEN {len(START) + 1 + len(END) + 1} + role_chars ELSE {len(SEP)} END)::BIGINT AS formatted_chars,
  sum(fresh::INT)::INT AS n_blocks
FROM marked GROUP BY conv_id"""


def _sql_rests() -> dict[str, str]:
    rests: dict[str, list[str]] = {}
    for c in CONTROLS:
        rests.setdefault(re.escape(c[0]), []).append(re.escape(c[1:]))
    return {first: "|".join(rest) for first, rest in sorted(rests.items())}
