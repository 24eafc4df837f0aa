"""Equi-joins whose plan follows measured sizes and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 * 1024 * 1024
#: A key with a larger part of the rows than one in so many is dealt out over several tasks.
FREQUENT = 512


def fits_broadcast(n_rows: int, n_chars: int | None, limit: int = BROADCAST_BYTES) -> bool:
    """Whether so many rows stay below ``limit`` as a hash table; ``None`` stands for rows of one number."""
    size = 40 * n_rows if n_chars is None else 250 * n_rows + 2 * n_chars
    return size <= limit


def frequent_keys(df: DataFrame, on: str) -> list:
    """All keys that more than one in ``FREQUENT`` rows have, and at most ``FREQUENT`` in all: a sketch of fixed size per task."""
    keys = df.select(on).where(F.col(on).isNotNull())
    found = keys.stat.freqItems([on], 1 / FREQUENT).first()[0]
    return list(found or [])


def measured_join(
    many: DataFrame, few: DataFrame, on: str, spread_by: list[str | Column], how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join ``many`` with ``few`` on one column, ``how`` inner, left or left_semi.

    ``few`` is broadcast if its measured size allows it. Otherwise both are shuffled: rows of frequent keys go to as many tasks as
    there are shuffle partitions, by ``spread_by``, with copies of their partners; so do rows without a key, which have none.
    """
    if broadcast_bytes:
        chars = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in few.columns), F.lit(0))
        n_rows, n_chars = few.agg(F.count("*"), F.sum(chars)).first()
        if fits_broadcast(n_rows, n_chars or 0, broadcast_bytes):
            return many.join(F.broadcast(few), on, how)
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col(on).isin(frequent_keys(many, on))
    dealt = F.when(hot | F.col(on).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(tasks))).otherwise(F.lit(0)).cast("int")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    return many.withColumn("_salt", dealt).join(few.withColumn("_salt", F.explode(copies)), [on, "_salt"], how).drop("_salt")
