"""SQL text for the clean-up and token expressions, for the comparison engine."""

from __future__ import annotations

import glob
import os
import zipfile

WS = r"[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]"


def sub(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, WS + '+')})"


def clean(x: str) -> str:
    return squeeze(f"lower(coalesce({x}, ''))")


def _blocks(x: str) -> str:
    # Fixed patterns: the steps of the clean-up.
    for pattern in (r"\x1b\[[0-9;]*m", "<[^>]+>", f"https?://{NOT_WS}+", "(?s)```.*?```"):
        x = sub(x, pattern)
    return x


def light(x: str) -> str:
    return squeeze(sub(_blocks(f"coalesce({x}, '')"), r"\{[^}]+\}"))


def deep(x: str) -> str:
    x = sub(_blocks(f"coalesce({x}, '')"), r"`[^`\n]{1,100}`")
    x = sub(x, r"\{[^}]+\}")
    x = sub(x, f"(?m)^#{{1,6}}{WS}+")
    x = sub(x, r"\*{1,2}([^*]+)\*{1,2}", r"\1")
    return clean(sub(x, rf"-{WS}*\[[ xX]\]"))


def combined(title: str, body: str) -> str:
    t = deep(title)
    return f"trim({t} || ' ' || {t} || ' ' || {deep(body)})"


def norm_label(x: str) -> str:
    return f"translate({clean(x)}, ' -', '__')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def joined(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, '{sep}'), '')"


def text_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"


def without(x: str, words) -> str:
    return f"list_filter({x}, lambda t: NOT list_contains({text_list(words)}, t))"


def english_words() -> list[str]:
    """The English list that Spark ships, read without a session."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jar = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as z:
        text = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8")
    return text.split("\n")
