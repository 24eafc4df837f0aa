"""Whitening of embedding vectors along the leading principal components of their covariance.

Tasks add up exact sums and then, with the means known, products of centred vectors; one row per dimension leaves a
task. The covariance has a fixed size, whatever the number of rows, so its eigenpairs are found on the driver
(:mod:`inkveil.llm.symmetric`) and its components are sent to all tasks that project the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.symmetric import leading

#: Components with less than this part of the largest eigenvalue, times the dimension, are not told from zero.
_LEAST = 1e4 * float(np.finfo(np.float64).eps)
#: Vectors whose whitened rows leave a task at once.
_ROWS = 2048
#: Below this size no sum of a batch and no product of two numbers leaves 64 bits.
_SMALL = 1 << 31


@dataclass(frozen=True)
class Whitening:
    """What was learned: ``n`` vectors with exact ``sums``, falling eigenvalues ``values`` and unit ``vectors`` as columns.

    ``values`` and ``vectors`` hold the components asked for, ``trace`` the variance of all of them, and ``drift`` the mean
    of the centred vectors, which is zero but for rounding.
    """

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    drift: np.ndarray


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and embedding (array<double>) of the rows whose vector is not null and holds finite numbers only."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & finite)


def _matrix(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of integers floor(scale * c) + offset."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component times the scale does not fit 64 bits")
    return scaled.astype(np.int64).reshape(len(column), -1) + offset


def _same_size(rows: DataFrame, size: int) -> DataFrame:
    return rows.where(F.size("embedding") == size)


def _totals(rows: DataFrame, size: int, scale: int, offset: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), scale, offset)
            small = not x.size or np.abs(x).max() < _SMALL
            part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part, strict=True)]
            n += len(x)
        if n:
            whole = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array([n] * size), pa.array(range(size), pa.int32()), whole], ["n", "at", "total"])

    parts = rows.select("embedding").mapInArrow(sums, "n long, at int, total decimal(38,0)")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()  # one row per dimension
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [0] * size)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n in double precision, subtracted as integers first so that a common offset costs no digits."""
    base = [s // n for s in sums]
    rest = np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
    return (x - np.array(base, dtype=np.int64)).astype(np.float64) - rest


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of matrices that come as rows (at, line). Its size is that of one matrix."""
    cells = parts.select("at", F.posexplode("line").alias("pos", "value")).groupBy("at", "pos").agg(F.sum("value").alias("value"))
    lines = cells.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("line"))
    total = np.zeros((size + 1, size))
    for row in lines.collect():  # one row per dimension, and the sums
        total[row["at"]] = row["line"]
    return total


def _products(rows: DataFrame, columns: Callable[[pa.Array], np.ndarray], size: int) -> np.ndarray:
    """Products of all pairs of the ``columns`` made of each batch, added up, and in the last row their sums."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size + 1, size)), False
        for batch in batches:
            y = columns(batch.column(0))
            total[:size] += y.T @ y
            total[size] += y.sum(axis=0)
            any_rows = any_rows or len(y) > 0
        if any_rows:
            yield pa.record_batch([pa.array(range(size + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["at", "line"])

    return _added(rows.select("embedding").mapInArrow(products, "at int, line array<double>"), size)


def fit(rows: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Learn a whitening of ``rows`` (vec_id, embedding; see :func:`usable`) from all of them; None without variance.

    Vectors of the most frequent length take part, the longest of equally frequent ones. Every number c counts as
    floor(scale * c) + offset.
    """
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().where("size > 0")
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return None
    size = most["size"]
    rows = _same_size(rows, size)
    n, totals = _totals(rows, size, scale, offset)
    sums = tuple(totals)
    found = _products(rows, lambda column: _centred(_matrix(column, scale, offset), n, sums), size)
    drift = found[size] / n
    covariance = found[:size] / n - np.outer(drift, drift)
    trace = float(np.trace(covariance))
    if not trace > 0.0:
        return None
    values, vectors = leading((covariance + covariance.T) / 2, min(components, size))
    known = values > _LEAST * size * values[0]
    return Whitening(n, sums, values[known], vectors[:, known], trace, drift)


def _whitened(y: np.ndarray, model: Whitening) -> np.ndarray:
    return y @ (model.vectors / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Whitening, scale: int = 64, offset: int = 1_000_000) -> float:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity."""
    k = len(model.values)
    mean = _whitened(model.drift[None, :], model)

    def columns(column: pa.Array) -> np.ndarray:
        return _whitened(_centred(_matrix(column, scale, offset), model.n, model.sums), model) - mean

    found = _products(_same_size(rows, len(model.sums)), columns, k)
    left = found[k] / model.n
    return float(np.abs(found[:k] / model.n - np.outer(left, left) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The exact sum over dimensions of (n * x - S)^2 for each row; an error if 64 bits can't hold it."""
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]
    apart = x - np.array(base, dtype=np.int64)
    largest = n * int(np.abs(apart).max(initial=0)) + n
    if largest * largest * x.shape[1] < 1 << 63:
        away = apart * n - np.array(rest, dtype=np.int64)
        return (away * away).sum(axis=1)
    away = apart.astype(object) * n - np.array(rest, dtype=object)
    exact = (away * away).sum(axis=1)
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return exact.astype(np.int64)


def transform(rows: DataFrame, model: Whitening, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1), deviation and whitened: one row for each vector of the learned length and component."""
    k = len(model.values)
    key = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part.column(1), scale, offset)
                away = np.repeat(_deviations(x, model.n, model.sums), k)
                projected = _whitened(_centred(x, model.n, model.sums), model)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(away), pa.array(projected.ravel()),
                    ],
                    ["vec_id", "component", "deviation", "whitened"],
                )

    same = _same_size(rows, len(model.sums)).select("vec_id", "embedding")
    return same.mapInArrow(project, f"vec_id {key}, component int, deviation long, whitened double")


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row of ``vectors`` and component.

    Rows whose ``embedding`` is null or holds null, NaN or infinite entries are dropped; so are empty vectors and vectors
    whose length is not the most frequent one. Repeated rows, equal and null ids all count and all return. Tables that are
    empty or without variance (one row, equal rows) give no rows, and components whose eigenvalue can't be told from
    zero are left out. Entries beyond 64 bits after scaling, and deviations beyond 64 bits, are an error. Other columns are ignored.
    """
    rows = usable(vectors)
    model = fit(rows, components, scale, offset)
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema.format(rows.schema["vec_id"].dataType.simpleString()))
    error = identity_error(rows, model, scale, offset)
    explained = F.array(*(F.lit(float(v)) for v in model.values / model.trace))
    return transform(rows, model, scale, offset).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
