"""Single-pass replacement as column expressions.

A text is scanned once: each match is fenced with a mark, and the text is cut at the marks, which gives
an array of alternating untouched pieces and matches.  Texts that already hold the mark take a second
scan instead, so no input is misread.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Unicode noncharacter, reserved for internal use by programs.
MARK = "﷐"

LOOKUP_TYPE = "struct<original:string,replacement:string>"

Lookup = Callable[[Column], Column]


def pieces(text: Column, pattern: Column) -> Column:
    """``[untouched, match, untouched, match, ..., untouched]``; null stays null."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), F.lit(MARK), F.lit(-1))
    gaps = F.split(text, pattern, F.lit(-1))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    woven = F.flatten(F.zip_with(gaps, matches, lambda gap, match: F.array_compact(F.array(gap, match))))
    return F.when(F.contains(text, F.lit(MARK)), woven).otherwise(marked)


def resolved(parts: Column, lookup: Lookup) -> Column:
    """Pair every piece with its dictionary entry; untouched pieces and unknown matches get null."""
    return F.transform(
        parts,
        lambda part, at: F.struct(
            part.alias("part"), F.when(at % 2 == 1, lookup(F.lower(part))).alias("entry")
        ),
    )


def rewritten(entries: Column) -> Column:
    """Join the pieces again, with every known match replaced in the case of the match."""
    return F.array_join(
        F.transform(
            entries,
            lambda x: F.when(x["entry"].isNull(), x["part"]).otherwise(
                in_case_of(x["part"], x["entry"]["replacement"])
            ),
        ),
        "",
    )


def in_case_of(match: Column, replacement: Column) -> Column:
    """Upper-case for an all-upper match, lower-case for an all-lower one, otherwise as given."""
    return (
        F.when((F.upper(match) == match) & (F.lower(match) != match), F.upper(replacement))
        .when((F.lower(match) == match) & (F.upper(match) != match), F.lower(replacement))
        .otherwise(replacement)
    )


def hit_names(entries: Column) -> Column:
    """The canonical key of every replacement, in text order."""
    return F.transform(
        F.filter(entries, lambda x: x["entry"].isNotNull()), lambda x: x["entry"]["original"]
    )


def hit_count(entries: Column) -> Column:
    """Number of replacements; 0 for a null text."""
    known = F.filter(entries, lambda x: x["entry"].isNotNull())
    return F.when(entries.isNull(), F.lit(0)).otherwise(F.size(known)).cast("long")


def literal_lookup(rows: Iterable[tuple[str, str, str]]) -> Lookup:
    """A constant hash table over ``(lower key, original, replacement)`` rows.

    Map values in Spark are searched linearly, so the entries are spread over many small maps that are
    addressed by a checksum of the key.  The whole table is one constant of the plan.
    """
    rows = list(rows)
    slots = max(1, len(rows) // 2)
    table: list[dict] = [{} for _ in range(slots)]
    for lower, original, replacement in rows:
        table[zlib.crc32(lower.encode()) % slots][lower] = {
            "original": original,
            "replacement": replacement,
        }
    constant = F.from_json(F.lit(json.dumps(table)), f"array<map<string,{LOOKUP_TYPE}>>")

    def find(lower: Column) -> Column:
        slot = F.pmod(F.crc32(lower.cast("binary")), F.lit(slots)).cast("int")
        return F.try_element_at(F.get(constant, slot), lower)

    return find
