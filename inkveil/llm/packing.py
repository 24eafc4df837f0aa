"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths, and what a sequence costs besides its length.
CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32
#: Pieces that are packed together.
SHARD = 2048


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each length, in the order given; no length may exceed the largest capacity.

    Longest first, each goes to the open bin that it fills best, the oldest among equals. If none has room, the
    size is opened that costs least per token that it can still hold. In the end each bin shrinks to the least
    size that holds its contents.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = sum(lengths)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    placed = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, bin_no = room.pop(at)
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, left), c))
            bin_no = len(used)
            used.append(0)
        placed[i] = (bin_no, used[bin_no])
        used[bin_no] += n
        left -= n
        if free > n:
            insort(room, (free - n, bin_no))
    size = [min(c for c in capacities if c >= u) for u in used]
    return [(b, size[b], offset) for b, offset in placed]


def word_count() -> Column:
    """Words of ``text`` and one end mark; null and empty texts have the end mark alone."""
    return (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, piece_start, length, bin_id, capacity, bin_offset: where each piece of each document goes.

    ``docs`` has doc_id and n_tokens (null or negative: 0; such a document takes no room and has no row). A
    document longer than the largest capacity is cut into pieces of that size and a rest. Pieces are dealt
    evenly to shards of about ``SHARD``, packed independently; equal ids, repeated rows and null ids are
    separate items. Other columns are ignored.
    """
    largest = max(capacities)
    pieces = (
        docs.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(largest))))
        .select(
            "doc_id", F.col("pos").cast("long").alias("piece"), F.col("col").alias("piece_start"),
            F.least(F.lit(largest), F.col("n_tokens") - F.col("col")).alias("length"),
        )
    )
    shards = max(1, -(-pieces.count() // SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        found = pd.DataFrame(pack(rows["length"].tolist(), capacities, overhead), index=rows.index)
        found.columns = ["bin", "capacity", "bin_offset"]
        return rows.assign(
            bin_id=rows["shard"] * (1 << 20) + found["bin"], capacity=found["capacity"], bin_offset=found["bin_offset"]
        ).drop(columns="shard")

    return dealt.groupBy("shard").applyInPandas(
        place, "doc_id long, piece long, piece_start long, length long, bin_id long, capacity long, bin_offset long"
    )
