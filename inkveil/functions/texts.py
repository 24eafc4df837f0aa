"""Scalar text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OUTER_SPACE = r"(?U)^\s+|\s+$"


def strip(value: Column) -> Column:
    """Remove blanks of every kind, not only spaces, from both ends."""
    return F.regexp_replace(value, _OUTER_SPACE, "")


def normalised_value(value: Column) -> Column:
    """Strip, and drop the ``.0`` a spreadsheet adds to whole or phone-like numbers."""
    bare = strip(value)
    numeric = bare.rlike(r"^[-() ]*[0-9][-() 0-9]*\.0$")
    return F.when(numeric, F.substring(bare, F.lit(1), F.length(bare) - 2)).otherwise(bare)


def tolerant_int(value: Column) -> Column:
    """A whole number, else a rounded one (half to even), else 0, as decimal(38,0); a number beyond its 38 digits is null.

    Type suffixes such as ``d`` make no number.
    """
    bare = strip(value)
    whole = bare.rlike(r"^[-+]?[0-9]+$")
    number = bare.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")
    rounded = F.bround(bare.try_cast("double")).try_cast("decimal(38,0)")
    return F.when(whole, bare.try_cast("decimal(38,0)")).when(number, rounded).otherwise(F.lit(0).cast("decimal(38,0)"))


def truncated(value: Column, width: int = 60) -> Column:
    """Shorten what is longer than ``width`` and end it with three dots."""
    short = F.concat(F.substring(value, 1, width - 3), F.lit("..."))
    return F.when(F.length(value) > width, short).otherwise(value)


def size_kb(size: Column) -> Column:
    return F.bround(size / 1024).cast("long")


def clean_metadata(value: Column) -> Column:
    """Turn escaped line breaks and tabs into spaces, then collapse and trim blanks."""
    spaced = F.regexp_replace(value, r"\\[nrtf]", " ")
    return strip(F.regexp_replace(spaced, r"(?U)\s+", " "))


def pdf_field(text: Column, field: str) -> Column:
    """The text in parentheses after ``/field``, or ``Not found``."""
    found = F.regexp_extract(text, rf"/{field}\s*\(([^)]+)\)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Not found"))


def normalised_path(path: Column) -> Column:
    return strip(F.translate(path, "\\", "/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """The last dotted ending of the file name, or ``''``; a leading dot starts a name, not a suffix."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(path)))


def parent_folder(path: Column) -> Column:
    """Everything before the file name, or ``root`` for a file at the top."""
    return F.when(
        F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")
    ).otherwise(F.lit("root"))


def top_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), 1)).otherwise(
        F.lit("root")
    )


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with its file suffix replaced."""
    kept = F.substring(path, F.lit(1), F.length(path) - F.length(file_suffix(path)))
    return F.concat(kept, F.lit(suffix))
