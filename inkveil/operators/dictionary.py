"""A mapping made ready for matching, small or large.

A dictionary within ``max_keys`` becomes one pattern and one constant hash table: redaction is then a
narrow projection without a shuffle.  A larger one stays distributed: runs of pieces of the texts are joined
with the keys that they equal.  Both ways give the same result.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import redaction
from inkveil.functions.patterns import NOT_AFTER_WORD, NOT_BEFORE_WORD, PatternTooDeepError, combined_pattern
from inkveil.operators import hits
from inkveil.operators.joins import BROADCAST_BYTES, fits_broadcast
from inkveil.operators.mapping import casefold_lookup
from inkveil.session import written

MAX_KEYS = 100_000
MAX_KEY_CHARS = 4_000_000


@dataclass(frozen=True)
class Dictionary:
    """``pattern`` and ``lookup`` for the small form, an ``index`` of keys for the large form."""

    pattern: str | None
    lookup: redaction.Lookup | None
    index: hits.KeyIndex | None
    broadcast_keys: bool
    open_chars: tuple[str, ...]

    @property
    def is_empty(self) -> bool:
        return self.pattern is None and self.index is None

    @classmethod
    def build(
        cls, mapping: DataFrame, max_keys: int = MAX_KEYS, broadcast_bytes: int = BROADCAST_BYTES
    ) -> Dictionary:
        """Prepare ``mapping(ordinal, original, replacement)``; sizes are measured before a form is chosen."""
        keys = casefold_lookup(mapping)
        n_keys, n_chars, shortest = keys.agg(
            F.count("*"), F.sum(F.length("original") + F.length("replacement")), F.min(F.length("original"))
        ).first()
        if not n_keys:
            return cls(None, None, None, False, ())
        if shortest == 0:
            raise ValueError("a dictionary key must not be empty")
        if n_keys <= max_keys and n_chars <= MAX_KEY_CHARS:
            rows = [tuple(r) for r in keys.select("lower", "original", "replacement").collect()]
            originals = [original for _, original, _ in rows]
            with contextlib.suppress(PatternTooDeepError):
                return cls(
                    combined_pattern(originals), redaction.literal_lookup(rows), None, False,
                    tuple(sorted({c for key in originals for c in key[:-1]})),
                )
        keys = written(keys, "dictionary")
        # Distinct characters, so at most the size of an alphabet.
        inner = F.explode(F.split(F.expr("left(original, length(original) - 1)"), ""))
        chars = keys.select(inner.alias("c")).filter("c != ''").distinct().collect()
        return cls(
            None, None, hits.KeyIndex.build(keys, n_keys), fits_broadcast(n_keys, n_chars, broadcast_bytes),
            tuple(sorted(r[0] for r in chars)),
        )


def escaped(key: Column) -> Column:
    return F.regexp_replace(key, r"([^\p{L}\p{N}])", r"\\$1")


def left_guarded(key: Column) -> Column:
    return key.rlike(r"^[\p{L}\p{N}]")


def right_guard(key: Column) -> Column:
    return F.when(key.rlike(r"[\p{L}\p{N}]$"), F.lit(NOT_BEFORE_WORD)).otherwise(F.lit(""))


def key_pattern(key: Column) -> Column:
    """The escaped key, guarded on each side that is alphanumeric."""
    left = F.when(left_guarded(key), F.lit(NOT_AFTER_WORD)).otherwise(F.lit(""))
    return F.concat(left, escaped(key), right_guard(key))


def with_hits(df: DataFrame, dictionary: Dictionary, text: str, keys: list[str]) -> DataFrame:
    """Add ``_hits`` (see :mod:`inkveil.operators.hits`) for the large form; ``keys`` identify a row of ``df``."""
    runs = hits.candidates(df, dictionary.index, text, keys)
    found = hits.settled(hits.verified(runs, dictionary.index, keys, dictionary.broadcast_keys), keys, dictionary.index.sizes[-1])
    found = found.withColumnsRenamed({**{k: f"_key_{k}" for k in keys}, "_text": "_key_text"})
    # Null-safe, so that a row without a key value is redacted like any other.
    same_row = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = df.withColumn("_text", F.xxhash64(text)).join(found, [*same_row, F.col("_text") == F.col("_key_text")], "left")
    return joined.drop("_text", "_key_text", *[f"_key_{k}" for k in keys])
