"""Small tables with the odd cases that every operator has to take."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 20_000


def words(text):
    return WORDS.findall(text or "")


def odd_documents(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, and extra columns
    whose names the operators use themselves."""
    rows = [
        (1, "One two three four five.\nSix seven eight nine ten.\nEleven twelve.", "a", 1, "x"),
        (1, "One two three four five.\nSix seven eight nine ten.\nEleven twelve.", "a", 1, "x"),
        (2, "One two three four five.\nSix seven eight nine ten.\nEleven twelve.", None, 2, None),
        (3, None, "a", None, "y"),
        (4, "", "b", 0, "z"),
        (5, " \n\t ", None, 3, "z"),
        (6, LONG, "b", 4, "z"),
        (None, "no id here, none at all", "c", 5, "z"),
        (None, None, None, None, None),
        (7, "x" * 50_000, "c", 6, "z"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, size long, id string"
    ).selectExpr("*", "size AS words", "id AS rep", "size AS shard", "id AS draw", "size AS mark", "id AS of")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
