import re

import pytest
from pyspark.sql import functions as F

from sparkdesk.functions import labels as L
from sparkdesk.functions import text as X


def one(evaluate, make, value, kind="string"):
    return evaluate(make, f"c {kind}", (value,))[0]


def test_clean_text(evaluate):
    assert evaluate(X.clean_text, "c string", (None,), ("  Hello\nWorld ",)) == ["", "hello world"]
    assert one(evaluate, X.clean_text, "a  b　") == "a b"


def test_number_text_treats_nan_as_missing(evaluate):
    assert evaluate(X.number_text, "c double", (float("nan"),), (2.5,)) == ["", "2.5"]


@pytest.mark.parametrize(
    "raw, gone, kept",
    [
        ("## Bug Report\n### Steps to reproduce", ["##"], ["bug report", "steps"]),
        ("Description\n```python\nraise ValueError\n```\nEnd", ["```", "raise"],
         ["description", "end"]),
        ("<div>Click <b>here</b></div>", ["<div>", "<b>"], ["click", "here"]),
        ("See https://example.org/a/b?c=1 for details", ["https://"], ["see", "details"]),
        ("Issue with {product_purchased}. Please assist.", ["{product_purchased}"], ["issue"]),
        ("\x1b[31mERROR\x1b[0m: message", ["\x1b"], ["error"]),
        ("Call `some_function()` with args", ["`"], ["call", "with args"]),
        ("## Bug\n\nThe login page crashes after clicking submit.\n```\nTraceback...\n```",
         ["traceback"], ["login", "crashes", "clicking", "submit"]),
        ("- [x] done - [ ] open", ["["], ["done", "open"]),
    ],
)
def test_deep_clean_text(evaluate, raw, gone, kept):
    out = one(evaluate, X.deep_clean_text, raw)
    assert not any(g in out for g in gone)
    assert all(k in out for k in kept)


def test_deep_clean_text_edges(evaluate):
    assert evaluate(X.deep_clean_text, "c string", (None,), ("",)) == ["", ""]
    assert one(evaluate, X.deep_clean_text, "**bold** and *it*") == "bold and it"
    # tags go before fences, so a tag across a fence swallows the text between
    assert one(evaluate, X.deep_clean_text, "a ```<x``` b> c") == "a ``` c"
    assert one(evaluate, X.deep_clean_text, "####### seven") == "####### seven"


# The expected rewrite in plain Python, for comparison on awkward strings.
# Fixed patterns: the steps of the clean-up.
STEPS = [
    (r"\x1b\[[0-9;]*m", " "), (r"<[^>]+>", " "), (r"https?://\S+", " "),
    (r"```[\s\S]*?```", " "), (r"`[^`\n]{1,100}`", " "), (r"\{[^}]+\}", " "),
    (r"(?m)^#{1,6}\s+", " "), (r"\*{1,2}([^*]+)\*{1,2}", r"\1"), (r"-\s*\[[ xX]\]", " "),
]


def plain_deep(text):
    for pattern, to in STEPS:
        text = re.sub(pattern, to, text)
    return re.sub(r"\s+", " ", text.lower()).strip()


AWKWARD = [
    "***a***b**", "* item\n* item", "`" + "x" * 101 + "`", "``` open", "<>", "< >a", "{}{a}",
    "# a\r# b # c\n# d", "http:// x", "https://a<b>c", "-\n[X]", "#\n\n## t",
    "\x1b[1;31mred\x1b[m", "a\x1cb\x85c　", "*\n*a*", "- [x][ ]", "```a``b```c```",
]


def test_deep_clean_matches_plain_python(evaluate):
    got = evaluate(X.deep_clean_text, "c string", *[(x,) for x in AWKWARD])
    assert got == [plain_deep(x) for x in AWKWARD]


def test_light_clean_keeps_case(evaluate):
    assert one(evaluate, X.light_clean, "A <b>B</b> {c} `d` **E**") == "A B `d` **E**"
    assert one(evaluate, X.light_clean, None) == ""


def test_combine_title_body(evaluate):
    got = evaluate(
        X.combine_title_body, "t string, b string",
        ("Bug", "Description of the bug"), ("Login fails", ""), (None, None), (None, "B"),
    )
    assert got == ["bug bug description of the bug", "login fails login fails", "", "b"]


def test_add_text_column(spark):
    df = spark.createDataFrame([("A", ""), (None, None)], "title string, body string")
    assert [r["text"] for r in X.add_text_column(df).collect()] == ["a a"]
    assert [r["text"] for r in X.add_text_column(df.drop("body")).collect()] == ["a a"]


def test_labels(evaluate):
    raw = ["Technical issue", "Cancellation-request", "cancel_order", "  GET Refund  ", "a - b"]
    assert evaluate(L.normalize_label, "c string", *[(x,) for x in raw]) == [
        "technical_issue", "cancellation_request", "cancel_order", "get_refund", "a___b",
    ]
    assert one(evaluate, L.snake_case_intent, " Get - a Refund") == "get_a_refund"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("['feature_request', 'build-ci-cd']", ["feature_request", "build_ci_cd"]),
        ("bug", ["bug"]),
        (None, []),
        ("", []),
        ("None", []),
        ("[]", []),
        ("['a', 'a']", ["a", "a"]),
        ("['a', None, 'b']", ["a", "b"]),
        ("['a',]", ["a"]),
        ("'Bug'", ["bug"]),
        ("''", []),
        ("[\"don't\", 'x']", ["don't", "x"]),
        (r"['it\'s', 'y']", ["it's", "y"]),
        ("[1, 2]", ["1", "2"]),
        ("[broken", ["[broken"]),
    ],
)
def test_parse_label_list(evaluate, raw, want):
    assert one(evaluate, L.parse_label_list, raw) == want


def test_label_arrays(evaluate):
    assert one(evaluate, L.normalize_items, ["Bug", "Feature Request", " "], "array<string>") == [
        "bug", "feature_request",
    ]
    got = evaluate(L.clean_labels, "c string", (None,), ("P1, 42",), ("Bug, p2 ,UI",), ("é,ü",))
    assert got == [["unknown"], ["unknown"], ["bug", "ui"], ["unknown"]]
    mapping = {"bug": "bug", "crash": "bug", "misc": "other"}
    got = evaluate(
        lambda c: L.map_labels(c, mapping), "c array<string>",
        (["crash", "Bug", "zzz"],), (["misc"],), ([],),
    )
    assert got == [["bug"], ["unknown"], ["unknown"]]
    got = evaluate(
        L.consolidate_labels, "c array<string>",
        (["security", "bug", "access_permissions"],), (["duplicate_existing"],),
    )
    assert got == [["bug", "security_access"], []]


def test_display(evaluate):
    assert one(evaluate, X.display_label, "set_up-x1y don't") == "Set Up-X1Y Don'T"
    assert one(evaluate, X.display_label, "set_up-x1y don't") == "set_up-x1y don't".replace(
        "_", " ").title()
    assert one(evaluate, X.truncate_title, "x" * 61) == "x" * 60 + "…"
    assert one(evaluate, X.truncate_title, "x" * 60) == "x" * 60
    assert one(evaluate, X.percent_text, 0.825, "double") == "82.5%"
    kind = "array<struct<label:string,confidence:double>>"
    assert one(evaluate, X.format_predictions, [("bug", 0.825), ("ui", 0.61)], kind) == (
        "bug (0.82), ui (0.61)"
    )


def test_validate_tickets(spark):
    rows = [
        (1, "ok", None), (2, None, "b"), (3, "", "b"), (4, "  ", "b"), (5, "x" * 1001, "b"),
        (6, "t", "y" * 10_001), (7, "x" * 1000, "y" * 10_000),
    ]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    valid, refused = X.validate_tickets(df)
    assert {r["id"]: r["body"][:1] for r in valid.collect()} == {1: "", 7: "y"}
    assert {r["id"]: r["reject_reason"] for r in refused.collect()} == {
        2: "title missing", 3: "title empty", 4: "title blank", 5: "title too long",
        6: "body too long",
    }


def test_urgency_flag_is_a_substring_match(evaluate):
    got = evaluate(X.urgency_flag, "c string", ("Shutdown",), ("calm",), (None,))
    assert got == [1, 0, 0]


def test_concat_text(evaluate):
    assert evaluate(
        lambda t, b: X.concat_text(t, b, sep=" [SEP] "), "t string, b string", (None, "B")
    ) == [" [SEP] B"]
    assert evaluate(
        lambda t, b: X.concat_text(t, b, lower=True), "t string, b string", (None, "B ")
    ) == ["b"]


def test_text_functions_use_no_python(spark):
    df = spark.createDataFrame([("a", "b")], "title string, body string")
    plan = X.add_text_column(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert F.col("text") is not None
