"""Exact top-k by inner product with MaxScore over sharded postings.

A term is a dimension with a sign. Its postings in a shard are the vectors whose component has that sign, with
the size of the component; a query's term matches postings of its own sign, and components of the other sign only lower a
score. The largest posting bounds what a term can add. Terms whose bounds add up to less than the k-th best score
so far are non-essential: only vectors in the postings of an essential term can still be among the best k.

Vectors are dense here, so postings are columns, read for a block of queries at once. A block meets the shards of a strip
one after another and keeps its k best, so each shard but the first has a threshold, and a strip returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import written

#: Vectors of a shard, and queries that meet it together.
SHARD, BLOCK = 2048, 256
#: Shards of a strip at most; strips of all blocks together, as far as there are shards; partitions at most.
STRIP, CELLS, PARTITIONS = 256, 32, 4096
#: Terms read at once; shards of a batch that a Python worker gets.
_TERMS, _ROWS = 16, 16


def _largest(vectors: np.ndarray) -> int:
    """The largest size of a component; that of the least 64-bit number has no 64-bit number."""
    return max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0


class Shard:
    """Vectors of one shard by row, and their postings. ``largest``: size of a component of its queries at most."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int):
        order = np.argsort(ids, kind="stable")
        # doubles are exact here and multiply fastest; Python's integers hold what 64 bits don't
        most = max(1, _largest(vectors), largest) ** 2 * vectors.shape[1]
        self.kind = np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object
        self.ids, self.vectors = ids[order], vectors[order].astype(self.kind)
        #: The largest posting of each dimension with each sign.
        self.most = np.maximum(self.vectors.max(axis=0), 0), np.maximum(-self.vectors.min(axis=0), 0)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids, without ``own``."""
        one = Block(np.array([own]), query[np.newaxis], k)
        one.meet(self)
        return one.ids[0], one.scores[0].astype(np.int64)


class Block:
    """A block of queries, with ids and scores of the k best of each among the shards it has met; ties go to smaller ids."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = own, queries, k
        self.ids = [np.zeros(0, np.int64)] * len(own)
        self.scores = [np.zeros(0, np.int64)] * len(own)

    def meet(self, shard: Shard) -> None:
        """Take in the vectors of ``shard`` that are among the best."""
        # a query without k vectors so far takes all; scores of a shard that isn't of objects are below 2**62
        full = np.array([len(x) >= self.k for x in self.scores])
        least = [int(x[-1]) if f else 0 for x, f in zip(self.scores, full, strict=True)]
        if shard.kind is not object:
            least = [min(max(x, -(1 << 62)), 1 << 62) for x in least]
        least = np.array(least, dtype=shard.kind)
        queries = self.queries.astype(shard.kind)
        bound = np.abs(queries) * np.where(queries < 0, shard.most[1], shard.most[0])
        order = np.argsort(-bound.astype(np.float64).sum(axis=0), kind="stable")
        rest = bound[:, order][:, ::-1].cumsum(axis=1)[:, ::-1]
        live = np.flatnonzero(~full | (rest[:, 0] >= least))
        if not len(live):
            return
        queries, rest, least, full = queries[live][:, order], rest[live], least[live], full[live]
        vectors = shard.vectors[:, order]
        other = shard.ids != self.own[live][:, np.newaxis]
        width = len(order)
        score, fits, done = np.zeros(other.shape, dtype=shard.kind), other, 0
        while done < width:
            part = slice(done, done + _TERMS)
            score = score + queries[:, part] @ vectors[:, part].T
            done = min(width, done + _TERMS)
            left = rest[:, done] if done < width else np.zeros(len(live), dtype=shard.kind)
            fits = other & (~full[:, np.newaxis] | (score + left[:, np.newaxis] >= least[:, np.newaxis]).astype(bool))
            if fits.sum() * 32 < fits.size:
                break
        query, row = np.nonzero(fits)
        score = score[query, row]
        # probe: the other terms of the few that are left, while competitive
        while done < width and len(query):
            part = slice(done, done + _TERMS)
            score = score + (queries[query, part] * vectors[row, part]).sum(axis=1)
            done = min(width, done + _TERMS)
            left = rest[query, done] if done < width else np.zeros(len(query), dtype=shard.kind)
            fits = ~full[query] | (score + left >= least[query]).astype(bool)
            query, row, score = query[fits], row[fits], score[fits]
        if shard.kind is not object:
            score = score.astype(np.int64)
        starts = np.searchsorted(query, np.arange(len(live) + 1))
        for i, a, b in zip(live.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if a < b:
                self._add(i, shard.ids[row[a:b]], score[a:b])

    def _add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > 4 * self.k and scores.dtype != object:
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[some], scores[some]
        ids, scores = np.concatenate((self.ids[i], ids)), np.concatenate((self.scores[i], scores))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(-scores[order], kind="stable")][: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]

    def rows(self) -> pd.DataFrame:
        sizes = [len(x) for x in self.ids]
        return pd.DataFrame({
            "query_id": np.repeat(self.own, sizes), "vec_id": np.concatenate(self.ids),
            "score": np.concatenate([x.astype(np.int64) for x in self.scores]),
        })


def _packed(vectors: DataFrame, groups: int, size: int) -> DataFrame:
    """``groups`` rows with the ids and the matrix of their vectors."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(rows["vector"].tolist(), dtype=np.int64).reshape(len(rows), size)
        least = np.int16 if _largest(matrix) < 1 << 15 else np.int64
        ids = rows["id"].to_numpy(np.int64)
        return pd.DataFrame({
            "group": rows["group"][:1], "ids": [ids.tobytes()], "matrix": [matrix.astype(least).tobytes()], "wide": [least is np.int64],
        })

    dealt = vectors.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack, "group long, ids binary, matrix binary, wide boolean")


def _searched(near: DataFrame) -> DataFrame:
    """Write and read back in batches of few shards; the session's value returns."""
    conf, key = near.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, _ROWS)
    try:
        return written(near, "near")
    finally:
        conf.set(key, before)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` (id, vector array<long>) with the largest product.

    Queries are the rows for which ``is_query`` (over id) holds; candidates are all rows with another id. Every row
    counts: a repeated id is as many candidates, and the queries of one id share its ranks, as in the registered SQL. Ties go
    to smaller ids. Rows with a null id, a null vector or null components take no part. Shorter vectors are filled
    up with zeros; an empty vector scores 0. Other columns are ignored. Products are exact at any size; a score
    among the best of a strip that 64 bits can't hold is an error, as it is in SQL. Every strip of shards returns its own k
    best of each query.
    """
    usable = "id is not null and vector is not null and not exists(vector, x -> x is null)"
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector").where(usable)
    size = F.max(F.size("vector"))
    counts = rows.agg(size, F.count("*"), F.count_if(is_query)).first()
    width, n, n_queries = counts[0] or 1, counts[1], counts[2]
    width = max(1, width)
    filled = f"concat(vector, array_repeat(0L, {width} - size(vector)))"
    numbered = F.monotonically_increasing_id().alias("row")
    rows = written(rows.select("id", F.expr(filled).alias("vector"), numbered), "vectors")
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))
    strips = min(shards, max(-(-CELLS // blocks), -(-shards // STRIP)))
    # the queries of a cell come first, then its shards
    left = _packed(rows, shards, width).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        (F.col("block") * F.lit(strips).cast("long") + F.pmod("group", F.lit(strips))).alias("cell"),
        F.col("group").alias("part"), "ids", "matrix", "wide",
    )
    right = _packed(rows.where(is_query), blocks, width).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).select(
        (F.col("group") * F.lit(strips).cast("long") + F.col("strip")).alias("cell"),
        F.lit(-1).cast("long").alias("part"), "ids", "matrix", "wide",
    )

    def matrix(raw: bytes, wide: bool) -> np.ndarray:
        return np.frombuffer(raw, np.int64 if wide else np.int16).reshape(-1, width).astype(np.int64)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, block, largest = None, None, 0
        for batch in batches:
            for row in batch.itertuples():
                ids, vectors = np.frombuffer(row.ids, np.int64), matrix(row.matrix, row.wide)
                if row.part < 0:
                    if block is not None:
                        yield block.rows()
                    cell, block, largest = row.cell, Block(ids, vectors, k), _largest(vectors)
                elif row.cell == cell:  # a block may have got no queries
                    block.meet(Shard(ids, vectors, largest))
        if block is not None:
            yield block.rows()

    cells = left.unionByName(right).repartition(min(blocks * strips, PARTITIONS), "cell").sortWithinPartitions("cell", "part")
    near = _searched(cells.mapInPandas(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """id and vector of floor(64 * component); vectors with null or non-finite components are left out.

    A product beyond 64 bits is an error, as it is in SQL.
    """
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"

    def whole(x: Column) -> Column:
        y = x.cast("double") * 64
        fits = (y >= -(2.0**63)) & (y < 2.0**63)
        return F.when(fits, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))

    return embeddings.where("embedding is not null").where(finite).select(
        F.col("vec_id").alias("id"), F.transform("embedding", whole).alias("vector")
    )
