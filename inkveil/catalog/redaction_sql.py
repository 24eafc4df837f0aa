"""The redaction semantics in DuckDB SQL, for comparison with the Spark queries.

DuckDB has no look-around, so word boundaries stand in for the ASCII boundary; they differ only next to an
underscore, which the tables do not have.
"""

from __future__ import annotations

import re

from inkveil.catalog.core import literal

# (ordinal, original, replacement): a phrase over its words, deletions, upper and lower case, a key
# that ends in punctuation.
MAPPING_ROWS = [
    (1, "The", "Thy"),
    (2, "of the", "From A"),
    (3, "and", ""),
    (4, "de la", "Dalla"),
    (5, "der", "Jener"),
    (6, "Le", "Il"),
    (7, "555-", "000-"),
    (8, "with", "Without"),
    (9, "on the other", "Elsewhere"),
]


def mapping_sql(rows: list[tuple]) -> str:
    values = ", ".join(f"({n}, {literal(a)}, {literal(b)})" for n, a, b in rows)
    return f"SELECT CAST(ordinal AS BIGINT) AS ordinal, original, replacement FROM (VALUES {values}) AS m(ordinal, original, replacement)"


def pattern_sql(keys: list[str]) -> str:
    def guarded(key: str) -> str:
        left = r"\b" if key[0].isalnum() else ""
        right = r"\b" if key[-1].isalnum() else ""
        return left + re.escape(key) + right

    ordered = sorted(keys, key=lambda k: -len(k))
    return literal("(?i)(?:" + "|".join(guarded(k) for k in ordered) + ")")


def lookup_sql(rows: list[tuple], match: str) -> str:
    entries = ", ".join(f"{literal(a.lower())}: {literal(b)}" for _, a, b in rows)
    return f"MAP {{{entries}}}[lower({match})]"


def replaced_sql(rows: list[tuple], match: str) -> str:
    found = lookup_sql(rows, match)
    return (
        f"CASE WHEN {match} = upper({match}) AND {match} <> lower({match}) THEN upper({found}) "
        f"WHEN {match} = lower({match}) AND {match} <> upper({match}) THEN lower({found}) ELSE {found} END"
    )


def redacted_sql(rows: list[tuple], text: str) -> str:
    pattern = pattern_sql([r[1] for r in rows])
    gaps = f"regexp_split_to_array({text}, {pattern})"
    hits = f"regexp_extract_all({text}, {pattern})"
    swapped = f"list_transform({hits}, lambda m: {replaced_sql(rows, 'm')})"
    woven = f"list_transform(list_zip({gaps}, list_append({swapped}, '')), lambda z: z[1] || z[2])"
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN {text} ELSE array_to_string({woven}, '') END"


def count_sql(rows: list[tuple], text: str) -> str:
    pattern = pattern_sql([r[1] for r in rows])
    return f"CAST(coalesce(len(regexp_extract_all({text}, {pattern})), 0) AS BIGINT)"


def details_sql(rows: list[tuple], table: str, keys: str, text: str = "text") -> str:
    """``keys, original, occurrences`` as a statement."""
    pattern = pattern_sql([r[1] for r in rows])
    return f"""
SELECT {keys}, m.original, count(*) AS occurrences
FROM (SELECT {keys}, unnest(regexp_extract_all({text}, {pattern})) AS hit FROM {table}) AS h
JOIN ({mapping_sql(rows)}) AS m ON lower(h.hit) = lower(m.original)
GROUP BY {keys}, m.original"""
