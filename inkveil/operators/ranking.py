"""Row numbers over groups of any size, from a range-partitioned sort and prefix sums over its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.session import written

#: A row's number within its partition, in the lower bits of an increasing id.
_ROW_BITS = 33


def numbered(df: DataFrame, sort: list[Column], ordinal: str, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Number the rows of each ``by`` group from 1 in the order of ``sort``, then ``ordinal``, which tells equal rows apart.

    Rows are dealt out by ranges of the whole order, so a hot group is sorted by many tasks. The sorted rows are written once, since
    ranges are sampled anew in each run. Nulls come first; null groups count as one group.
    """
    by = by or []
    keys = [f"_numbered_sort{i}" for i in range(len(sort))]
    rows = df.select("*", *[column.alias(label) for label, column in zip(keys, sort, strict=True)])
    order = [*by, *keys, ordinal]
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_numbered_at", at).drop(*keys), "sorted")
    part = F.shiftright("_numbered_at", _ROW_BITS).alias("_numbered_part")
    start, starts = 0, []
    for part_no, rows_in in placed.groupBy(part).agg(F.count("*")).orderBy("_numbered_part").collect():  # one row per partition
        starts.append((part_no, start))
        start += rows_in
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_numbered_part long, _numbered_start long"))
    inside = F.col("_numbered_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    overall = placed.withColumn("_numbered_part", part).join(offsets, "_numbered_part").withColumn("_numbered_place", F.col("_numbered_start") + inside)
    if by:
        firsts = overall.groupBy(*by).agg(F.min("_numbered_place").alias("_numbered_first"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        numbers = overall.alias("l").join(firsts.alias("r"), same)
        return numbers.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_numbered_place") - F.col("_numbered_first") + 1).alias(name))
    return overall.select(*df.columns, (F.col("_numbered_place") + 1).alias(name))
