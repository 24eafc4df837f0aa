"""Redaction of text columns, and the counts that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import redaction
from inkveil.operators import hits
from inkveil.operators.dictionary import Dictionary, with_hits
from inkveil.operators.joins import BROADCAST_BYTES, fits_broadcast, measured_join


def with_entries(df: DataFrame, dictionary: Dictionary, text: str, keys: list[str]) -> DataFrame:
    """Add ``_found``: the pieces of ``text`` with the dictionary entry of each match."""
    column = F.col(text)
    if dictionary.is_empty:
        entry = F.lit(None).cast(redaction.LOOKUP_TYPE).alias("entry")
        whole = F.array(F.struct(column.alias("part"), entry))
        return df.withColumn("_found", F.when(column.isNotNull(), whole))
    if dictionary.pattern is not None:
        parts = redaction.pieces(column, F.lit(dictionary.pattern))
        return df.withColumn("_found", redaction.resolved(parts, dictionary.lookup))
    ready = with_hits(df, dictionary, text, keys).withColumn("_pieces", hits.cut_pieces(column))
    return ready.withColumn("_found", hits.entries(column, F.col("_pieces"), F.col("_hits"))).drop("_pieces", "_hits")


def redact(
    df: DataFrame, dictionary: Dictionary, text: str = "text", keys: list[str] | None = None,
    redacted: str = "redacted", count: str = "replacements",
) -> DataFrame:
    """Replace every key in one pass and count the replacements per row."""
    found = with_entries(df, dictionary, text, keys or ["doc_id"])
    return found.select(
        *[F.col(c) for c in df.columns if c not in (redacted, count)],
        redaction.rewritten(F.col("_found")).alias(redacted),
        redaction.hit_count(F.col("_found")).alias(count),
    )


def replacement_details(
    df: DataFrame, dictionary: Dictionary, text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """Replacements per row key and canonical dictionary key."""
    keys = keys or ["doc_id"]
    names = redaction.hit_names(F.col("_found"))
    named = with_entries(df.select(*keys, text), dictionary, text, keys).select(
        *keys, F.explode(names).alias("original")
    )
    return named.groupBy(*keys, "original").agg(F.count("*").alias("occurrences"))


def merge_details(*parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add up several details tables."""
    keys = keys or ["doc_id"]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*keys, "original").agg(F.sum("occurrences").alias("occurrences"))


def merge_count_maps(left: Column, right: Column) -> Column:
    """The same addition for two ``map<string,long>`` columns; a null map counts as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,long>")
    return F.map_zip_with(
        F.coalesce(left, empty), F.coalesce(right, empty),
        lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    )


def residual_leaks(
    df: DataFrame, dictionary: Dictionary, text: str = "redacted", keys: list[str] | None = None
) -> DataFrame:
    """Rows whose text still holds a key, with the number of such places."""
    keys = keys or ["doc_id"]
    found = with_entries(df.select(*keys, text), dictionary, text, keys)
    return found.select(*keys, redaction.hit_count(F.col("_found")).alias("leaks")).filter("leaks > 0")


def dictionary_hits(
    df: DataFrame, mapping: DataFrame, text: str = "text", keys: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hits of single-word keys by joining words instead of running a pattern.

    A dictionary of a measured small size filters the words where they are read. For a larger one the
    words are counted per row before they are shuffled, and frequent words are dealt out.
    """
    keys = keys or ["doc_id"]
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    said = df.select(*keys, F.explode(words).alias("term"))
    wanted = mapping.select(F.lower("original").alias("term")).distinct()
    n_keys, n_chars = wanted.agg(F.count("*"), F.sum(F.length("term"))).first()
    if fits_broadcast(n_keys, n_chars or 0, broadcast_bytes):
        held = said.join(F.broadcast(wanted), "term")
        return held.groupBy(*keys, "term").agg(F.count("*").alias("occurrences"))
    counted = said.groupBy(*keys, "term").agg(F.count("*").alias("occurrences"))
    return measured_join(counted, wanted, "term", keys, broadcast_bytes=0).select(*keys, "term", "occurrences")
