"""Token ids as Arrow files of fixed-size-list batches, for random access without copies.

Each task writes one pair of Arrow IPC files. The first has rows of ``LENGTH`` ids and a mask of equal length: the ids of
the task's documents one after another, each with its end id; the last row is filled up with masked zeros. The
second has doc_id, start in the first, and number of ids of each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.bpe import encoder
from inkveil.llm.common import small_batches
from inkveil.session import shared_dir

LENGTH = 1024
ROWS = 256
END = 0
_FILES = "part int, path string, n_docs long, n_ids long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])


class _Writer:
    """Gathers ids and writes them in batches of ``ROWS`` rows."""

    def __init__(self, sink, dtype: np.dtype):
        self.kind = pa.from_numpy_dtype(dtype)
        self.file = ipc.new_file(sink, _schema(self.kind))
        self.dtype, self.waiting, self.n = dtype, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= LENGTH * ROWS:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // (LENGTH * ROWS) * LENGTH * ROWS
            for at in range(0, whole, LENGTH * ROWS):
                self._write(ids[at : at + LENGTH * ROWS], LENGTH * ROWS)
            self.waiting, self.n = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, filled: int) -> None:
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), LENGTH),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < filled), LENGTH),
        ]
        self.file.write_batch(pa.record_batch(columns, schema=_schema(self.kind)))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.waiting)
            self._write(np.concatenate((ids, np.zeros(-len(ids) % LENGTH, self.dtype))), len(ids))
        self.file.close()


class SequenceFile:
    """Random access to the ids of one file; batches are views of the mapped file where the store allows it."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.file = ipc.open_file(self.source)
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def batch(self, number: int) -> np.ndarray:
        if self._last[0] != number:
            self._last = number, self.file.get_batch(number).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, size = [], LENGTH * ROWS
        while n > 0:
            number, at = divmod(start, size)
            part = self.batch(number)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


def write_sequences(docs: DataFrame, path: str, folder: str) -> list:
    """Encode and write ``docs`` (doc_id, text) in ascending doc_id order; one row about each file, in order.

    Null texts are empty; null ids come first and equal ids are ordered by their text. A task that runs again writes files
    of its own; only those of the attempt that counted are listed.
    """
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        base = encoder(path)
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        n_docs = n_ids = 0
        end = np.array([END], dtype=base.dtype)
        with store.open_output_stream(f"{at}/{name}.ids") as ids_sink, store.open_output_stream(f"{at}/{name}.docs") as docs_sink:
            writer = _Writer(ids_sink, base.dtype)
            with ipc.new_file(docs_sink, _DOCS) as index:
                for batch in batches:
                    sizes = []
                    for ids in base.encode([t or "" for t in batch["text"]]):
                        writer.add(ids)
                        writer.add(end)
                        sizes.append(len(ids) + 1)
                    starts = n_ids + np.cumsum([0, *sizes])
                    columns = [pa.Array.from_pandas(batch["doc_id"], type=pa.int64()), pa.array(starts[:-1]), pa.array(sizes, pa.int64())]
                    index.write_batch(pa.record_batch(columns, schema=_DOCS))
                    n_docs, n_ids = n_docs + len(sizes), int(starts[-1])
            writer.close()
        if n_docs:
            yield pd.DataFrame({"part": [task.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return sorted(sorted_docs.mapInPandas(write, _FILES).collect())  # one row a task


def read_sequences(spark: SparkSession, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, with starts counted over all files."""
    before, listed = 0, []
    for f in files:
        listed.append((f["path"], before))
        before += f["n_ids"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                ids = SequenceFile(f"{path}.ids")
                index = SequenceFile(f"{path}.docs").file
                for number in range(index.num_record_batches):
                    rows = index.get_batch(number)
                    starts, sizes = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                    sums = [crc32(ids.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pd.DataFrame({
                        "doc_id": rows.column(0).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                        "start": starts + base, "n_tokens": sizes, "ids_crc32": np.array(sums, dtype=np.int64),
                    })

    names = spark.createDataFrame(listed, "path string, base long").repartition(max(1, len(listed)))
    return names.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequences(docs: DataFrame, path: str) -> DataFrame:
    """Write the files below the shared folder and read them back. Other columns of ``docs`` are ignored."""
    folder = shared_dir(docs.sparkSession, "sequences")
    return read_sequences(docs.sparkSession, write_sequences(docs, path, folder))
