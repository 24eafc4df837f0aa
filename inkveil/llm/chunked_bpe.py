"""BPE encoding with content-defined chunks: a chunk that many texts share is encoded once.

A rolling hash over the last 32 bytes decides where chunks end, so equal passages fall into equal chunks wherever
they stand. Near its ends a chunk's tokens depend on its neighbours. There the texts are encoded again, from the
last boundary of the left chunk that later text cannot move to the first one of the right chunk that earlier
text cannot move; from there on the encodings agree. If a chunk has no such boundary, the next is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.bpe import Encoder, cut, encoder
from inkveil.llm.common import small_batches

#: Chunks have 1,024 bytes on average.
CHUNK_BITS = 10
#: Bytes of chunks that one Python worker keeps.
CACHED_BYTES = 24 << 20
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunks(text: str, bits: int = CHUNK_BITS) -> list[str]:
    """Cut ``text`` after each character where the hash of the 32 bytes before has ``bits`` zeros in front."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    rolled = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        moved = rolled[:-shift] << np.uint32(shift)
        rolled = rolled.copy()
        rolled[shift:] += moved
    ends = np.flatnonzero((rolled >> np.uint32(32 - bits)) == 0) + 1
    ends = ends[ends < len(raw)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    bounds = [0, *ends.tolist(), len(raw)]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(bounds, bounds[1:], strict=False)]


class ChunkEncoder:
    def __init__(self, base: Encoder, bits: int = CHUNK_BITS):
        self.base, self.bits = base, bits
        self.reused = self.encoded = self._size = 0
        self._known: dict[str, tuple | None] = {}

    def _new(self, chunk: str) -> None:
        """Text before the first sure boundary, units up to the last one, and the text after it; None without one."""
        units = cut(chunk)
        self._known[chunk] = (units[0], units[1:-1], units[-1]) if len(units) > 1 else None
        self._size += 3 * len(chunk) + 200
        self.encoded += 1

    def _parts(self, chunked: list[str]) -> Iterator[tuple[list[str], str]]:
        """The chunks of a segment as pairs: units of a joint, and the chunk whose inner ids follow (or "")."""
        open_text = ""
        for chunk in chunked:
            found = self._known[chunk]
            if found is None:
                open_text += chunk
            else:
                yield cut(open_text + found[0]), chunk
                open_text = found[2]
        yield cut(open_text), ""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, equal to the library's."""
        if self._size > CACHED_BYTES:
            self._known.clear()
            self._size = 0
        cuts = [[s if i % 2 else chunks(s, self.bits) for i, s in enumerate(self.base.segments(t))] for t in texts]
        fresh = []
        for chunk in (c for parts in cuts for segment in parts[::2] for c in segment):
            if chunk in self._known:
                self.reused += 1
            else:
                self._new(chunk)
                fresh.append(chunk)
        joints = [[s if i % 2 else list(self._parts(s)) for i, s in enumerate(parts)] for parts in cuts]
        units = {u for c in fresh if self._known[c] for u in self._known[c][1]}
        units.update(u for parts in joints for segment in parts[::2] for joint, _ in segment for u in joint)
        self.base.learn(units)
        for chunk in fresh:
            if self._known[chunk]:
                head, inner, tail = self._known[chunk]
                self._known[chunk] = head, self.base.joined(inner), tail
        out = []
        for parts in joints:
            ids = []
            for i, segment in enumerate(parts):
                if i % 2:
                    ids.append(self.base.added[segment])
                    continue
                for joint, chunk in segment:
                    ids.append(self.base.joined(joint))
                    if chunk:
                        ids.append(self._known[chunk][1])
            out.append(np.frombuffer(b"".join(ids), dtype=self.base.dtype))
        return out


#: A Python worker keeps its chunks from one batch to the next.
_workers: dict[tuple[str, int], ChunkEncoder] = {}


def _chunk_encoder(path: str, bits: int) -> ChunkEncoder:
    if (path, bits) not in _workers:
        _workers[path, bits] = ChunkEncoder(encoder(path), bits)
    return _workers[path, bits]


def encode_decode(docs: DataFrame, path: str, bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of ``docs`` (doc_id, text).

    Null counts as the empty text, which has no ids. Repeated rows and null ids stay. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def coded(texts: pd.Series) -> pd.DataFrame:
        chunked = _chunk_encoder(path, bits)
        ids = chunked.encode([t or "" for t in texts])
        return pd.DataFrame({"ids": [x.astype(np.int32) for x in ids], "decoded": [chunked.base.decode(x.tolist()) for x in ids]})

    rows = docs.select("doc_id", coded("text").alias("c"))
    return rows.select("doc_id", F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", "c.decoded")


def digests(docs: DataFrame, path: str, bits: int = CHUNK_BITS) -> DataFrame:
    """As ``encode_decode``, with sha256 digests of ids and text instead of both, made where they are encoded."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(texts: pd.Series) -> pd.DataFrame:
        chunked, out = _chunk_encoder(path, bits), []
        base = chunked.base
        for found in chunked.encode([t or "" for t in texts]):
            ids = found.tolist()
            names = ",".join(map(base.names.__getitem__, ids))
            decoded = base.decode(ids).encode("utf-8", "surrogatepass")
            out.append((len(ids), sha256(names.encode()).hexdigest(), sha256(decoded).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", coded("text").alias("c")).select("doc_id", "c.*")

