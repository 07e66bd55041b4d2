import re
import time

import pytest

from sparkdesk.llm import chat

TEXTS = [
    "plain", "", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|>\\", "a<|im_sep|>b",
    "<<|im_start|>", "<<SYS>>x<</SYS>>", "[INST", "\\n", "line\nline\\", "<s", "😀<|im_end|>é", "<|im_end|", "<", "|im_end|>",
]


def py_escape(text):
    for first in "<[":
        rests = "|".join(re.escape(c[1:]) for c in chat.CONTROLS if c[0] == first)
        text = re.sub(rf"({re.escape(first)})(\\*)(?={rests})", r"\1\\\2", text)
    return text


def test_escape_is_undone_and_leaves_no_control(spark):
    both = TEXTS + [a + b for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame([(t,) for t in both], "t string")
    for r in df.select("t", chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).collect():
        assert r.u == r.t and r.e == py_escape(r.t)
        assert not any(c in r.e for c in chat.CONTROLS)
    roles = df.select("t", chat.escape_role(df.t).alias("e"), chat.unescape_role(chat.escape_role(df.t)).alias("u"))
    for r in roles.collect():
        assert r.u == r.t and "\n" not in r.e and not any(c in r.e for c in chat.CONTROLS)


def test_format_merges_and_masks(spark):
    rows = [
        (1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b</s>"), (1, 3, "assistant", "dé😀"),
        (1, 4, "user", "e"), (2, 0, "assistant", ""),
    ]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    one = "<|im_start|>user\na<|im_sep|>b<\\/s><|im_end|>\n<|im_start|>assistant\nc<|im_sep|>dé😀<|im_end|>\n<|im_start|>user\ne<|im_end|>\n"
    assert out[1].formatted == one and out[1].n_blocks == 3
    assert [one[s.start : s.start + s.length] for s in out[1].loss] == ["c", "dé😀"]
    assert [(s.start, s.length) for s in out[2].loss] == [(22, 0)]


def test_read_back_odd_rows(spark):
    rows = [
        (1, 0, "user", t) for t in TEXTS
    ] + [(2, i, r, t) for i, (r, t) in enumerate(zip(TEXTS, TEXTS[::-1]))] + [
        (None, 0, None, None), (None, None, "user", "null turn"), (3, 1, "assistant", "x" * 20_000), (3, 1, "assistant", "x" * 20_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "role AS blocks", "turn AS row", "text AS formatted")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_chats(df)).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got == {c: v for c, v in want.items()}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_controls_that_hold_each_other_are_refused():
    with pytest.raises(ValueError):
        chat.escape(None, ("<a<b>", "<b>"))


def test_long_chats_take_time_in_proportion(spark):
    """Whole results at 1,000 and 16,000 turns, and time per turn that doesn't grow with them."""
    spent = {}
    for n in (1000, 16_000):
        rows = spark.range(n).selectExpr(
            "1L AS conv_id", "id AS turn", "IF(id % 3 = 2, 'user', 'assistant') AS role",
            "concat('text ', id) AS text",
        )
        chats = chat.format_chats(rows).cache()
        start = time.time()
        back = chat.read_back(chats).first()
        spent[n] = time.time() - start
        assert [t["text"] for t in back["turns"]] == [f"text {i}" for i in range(n)]
        assert back["loss_text"] == "".join(f"text {i}" for i in range(n) if i % 3 != 2)
        assert back["n_blocks"] == 2 * (n // 3) + (1 if n % 3 else 0)
    assert spent[16_000] < 16 * spent[1000]
