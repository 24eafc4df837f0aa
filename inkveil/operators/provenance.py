"""Which tool wrote a file, and whether that tool is approved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.texts import clean_metadata, pdf_field

# Approved producers.
APPROVED = ["Adobe PDF", "Adobe Acrobat", "Adobe InDesign", "Adobe Illustrator", "Adobe Photoshop"]

QUARANTINE = "MOVE_TO_QUARANTINE"
NOTIFY = "NOTIFY_ONLY"
DELETE = "DELETE"


def allowlist_union(custom: list[str] | None = None) -> list[str]:
    """Built-in and own entries, each once."""
    return list(dict.fromkeys([*APPROVED, *(custom or [])]))


def is_approved(producer: Column, creator: Column, allowed: list[str]) -> Column:
    """Either field holds an approved name, in any case; missing metadata is not approved."""
    names = F.array(*[F.lit(name.lower()) for name in allowed]) if allowed else F.lit([]).cast("array<string>")
    return F.exists(
        names,
        lambda name: F.contains(F.coalesce(F.lower(producer), F.lit("")), name)
        | F.contains(F.coalesce(F.lower(creator), F.lit("")), name),
    )


def allowlist_match(files: DataFrame, allowed: list[str]) -> DataFrame:
    return files.withColumn("is_approved", is_approved(F.col("producer"), F.col("creator"), allowed))


def allowlist_split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved files, and violations."""
    return checked.filter("is_approved"), checked.filter("not is_approved")


def allowlist_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("is_approved").alias("approved"),
        F.count_if(~F.col("is_approved")).alias("violations"),
    )


def pdf_metadata(content: Column) -> dict[str, Column]:
    """Producer and creator, each where a file first defines it, however late."""
    text = F.decode(content, "ISO-8859-1")
    return {
        "producer": clean_metadata(pdf_field(text, "Producer")),
        "creator": clean_metadata(pdf_field(text, "Creator")),
    }


def action(chosen: Column) -> Column:
    """What to do with a violation; an unknown setting is reported as such."""
    return (
        F.when(chosen == QUARANTINE, "quarantine")
        .when(chosen == DELETE, "delete")
        .when(chosen == NOTIFY, "notify")
        .otherwise("unknown")
    )
