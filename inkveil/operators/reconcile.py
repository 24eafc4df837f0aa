"""Joining what went in with what came out, and counts with their mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators.joins import BROADCAST_BYTES, measured_join

NOT_CREATED = "output file not created"
EMPTY = "output file is empty"


def in_out_reconcile(files: DataFrame, outputs: DataFrame, key: str = "rel_path") -> DataFrame:
    """A success needs an output with content; otherwise it fails with a reason and counts nothing."""
    produced = outputs.groupBy(key).agg(F.max("size").alias("_size"))
    claimed = F.col("status") == "success"
    reason = F.when(F.col("_size").isNull(), NOT_CREATED).when(F.col("_size") == 0, EMPTY)
    broken = claimed & reason.isNotNull()
    joined = files.join(produced, key, "left")
    return joined.withColumns(
        {
            "status": F.when(broken, "failed").otherwise(F.col("status")),
            "error": F.when(broken, reason).otherwise(F.col("error")),
            **{
                c: F.when(broken, 0).otherwise(F.col(c))
                for c in ("replacements", "images_removed", "hyperlinks_removed")
                if c in files.columns
            },
        }
    ).drop("_size")


def _by_original(mapping: DataFrame, key: str, to: str) -> DataFrame:
    """One replacement per key: the last by ordinal, or the largest where there is no order."""
    last = F.max_by("replacement", "ordinal") if "ordinal" in mapping.columns else F.max("replacement")
    return mapping.groupBy(F.col("original").alias(key)).agg(last.alias(to))


def details_to_mapping(details: DataFrame, mapping: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach the replacement of each key; unknown keys and deletions get a label."""
    known = _by_original(mapping, "original", "_to")
    label = F.when(F.col("_to").isNull(), "[UNKNOWN]").when(F.col("_to") == "", "[DELETED]").otherwise(F.col("_to"))
    joined = measured_join(details, known, "original", details.columns, "left", broadcast_bytes)
    return joined.select(*details.columns, label.alias("replacement"))


def details_fallback(details: DataFrame, mapping: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The replacement by exact key, else by lower-cased key, else ``?``."""
    exact = _by_original(mapping, "original", "_exact")
    lower = _by_original(mapping, "_lower", "_folded")
    found = measured_join(details, exact, "original", details.columns, "left", broadcast_bytes).withColumn("_lower", F.lower("original"))
    found = measured_join(found, lower, "_lower", details.columns, "left", broadcast_bytes)
    return found.select(*details.columns, F.coalesce("_exact", "_folded", F.lit("?")).alias("replacement"))
