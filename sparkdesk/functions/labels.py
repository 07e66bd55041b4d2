"""Label normalisation and taxonomy mapping expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdesk.functions.text import WS, clean_text, let, strip

UNKNOWN = "unknown"

# Labels that only carry a priority number.
NOISE_LABELS = ["p1", "p2", "p3", "p4", "p5"]

# Rare labels and the groups they join.
LABEL_MERGES = {
    "installation_setup": "setup_config",
    "configuration": "setup_config",
    "security": "security_access",
    "access_permissions": "security_access",
    "refactor_maintenance": "maintenance_data",
    "data_import_export": "maintenance_data",
}

# Fixed value: the label that is removed.
DROPPED_LABEL = "duplicate_existing"

# Severity names and the priorities they become.
SEVERITY_TO_PRIORITY = {"critical": "critical", "major": "high", "minor": "low"}


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def normalize_label(c: Column) -> Column:
    return F.translate(clean_text(c), " -", "__")


def snake_case_intent(c: Column) -> Column:
    """Lower case, each run of white space and hyphens one underscore."""
    return F.regexp_replace(F.lower(strip(c)), WS.replace("]", r"\-]") + "++", "_")


def normalize_items(items: Column) -> Column:
    """Normalise each item and drop the empty ones; repeats stay."""
    return F.filter(F.transform(items, normalize_label), lambda x: x != "")


def parse_label_list(c: Column) -> Column:
    """Labels from a list literal held in a string; other text is one label.

    Python-only spellings (bare ``None``, a trailing comma, a quoted scalar) are
    rewritten to what the JSON reader takes. Tuples are not recognised as lists.
    """
    raw = F.trim(c)
    literal = F.regexp_replace(raw, rf",{WS}*\]$", "]")
    literal = F.regexp_replace(literal, rf"(?<=[\[,]){WS}*None{WS}*(?=[\],])", "null")
    quoted = r"""^(['"])(.*)\1$"""
    parsed = F.from_json(
        literal,
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
    return (
        F.when(c.isNull() | raw.isin("None", ""), F.array().cast("array<string>"))
        .when(raw.startswith("["), normalize_items(F.coalesce(parsed, F.array(c))))
        .when(raw.rlike(quoted), normalize_items(F.array(F.regexp_extract(raw, quoted, 2))))
        .otherwise(normalize_items(F.array(c)))
    )


def clean_labels(c: Column, noise: Iterable[str] = NOISE_LABELS) -> Column:
    """Comma-separated raw labels to a list; ``[unknown]`` if none has a letter a-z."""
    parts = F.transform(F.split(c, ","), lambda x: F.lower(strip(x)))
    kept = F.filter(parts, lambda x: x.rlike("[a-z]") & ~x.isin(*noise))
    return _or_unknown(kept)


def _or_unknown(labels: Column) -> Column:
    return let(
        labels, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(UNKNOWN)))
    )


def resolve_groups(groups: Column) -> Column:
    """Drop repeats, and ``unknown`` wherever another group is present."""
    def resolved(found: Column) -> Column:
        known = F.array_remove(found, UNKNOWN)
        return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(UNKNOWN)))

    return let(F.array_distinct(groups), resolved)


def group_or_unknown(group: Column) -> Column:
    return F.when(group == "other", F.lit(UNKNOWN)).otherwise(
        F.coalesce(group, F.lit(UNKNOWN))
    )


def map_labels(c: Column, mapping: Mapping[str, str]) -> Column:
    """Alias to group through a small literal map (see ``map_labels_join`` for large ones)."""
    lookup = literal_map({k: (UNKNOWN if v == "other" else v) for k, v in mapping.items()})
    return resolve_groups(
        F.transform(c, lambda x: F.coalesce(lookup[F.lower(x)], F.lit(UNKNOWN)))
    )


def consolidate_labels(
    c: Column, merges: Mapping[str, str] = LABEL_MERGES, drop: str = DROPPED_LABEL
) -> Column:
    """Merge rare labels and drop one; a sorted set, empty if nothing is left."""
    lookup = literal_map(merges)
    kept = F.filter(c, lambda x: x != drop)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.coalesce(lookup[x], x))))


def severity_priority(c: Column, mapping: Mapping[str, str] = SEVERITY_TO_PRIORITY) -> Column:
    """Priority name of a severity; null where the severity is not mapped."""
    return literal_map(mapping)[F.lower(strip(c))]
