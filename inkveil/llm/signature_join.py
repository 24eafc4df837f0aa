"""Near-duplicate groups through an inverted join over MinHash signature coordinates.

Every distinct shingle set gets a signature of ``COORDINATES`` minima, and is posted under pairs of a coordinate and its
value. Sets whose similarity reaches the threshold agree in at least ``matches`` coordinates, but for a chance below ``MISS``;
links are confirmed on full sets, so what agrees by accident costs work only.

* Prefix: all pairs (coordinate, value) have one global order, rare ones first. Two signatures that agree in ``matches`` of the
  coordinates share a pair among the first ``COORDINATES - matches + 1`` of each, so a set is posted under those only. Values
  that a common passage gives to unrelated texts come last and are posted by none of them. The order comes from a
  summary of frequent values; any order is right.
* Leaders: each set first meets the least set of each of its lists. Collisions are counted per pair before anything is
  fetched, the other coordinates only for pairs that are there.
* The rest: lists whose other members are still apart are cut into blocks, and any two blocks meet in a task of their own.
  A pair is counted in the list of its first common coordinate and skipped in all others, and skipped as soon as it can't
  reach ``matches``; what is left is compared by class counts, and confirmed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import BATCH_ROWS, written
from inkveil.llm.components import components
from inkveil.llm.shingles import mix, shingle_sets

#: Length of a signature, and the chance that a pair just at the threshold agrees in too few coordinates.
COORDINATES = 64
MISS = 1e-8
#: Frequent values that a task and the whole summary keep. They decide the order of values, not which links are found.
_TASK_VALUES = 1 << 14
_VALUES = 1 << 16
#: Bits of the filter for texts whose sets are wanted. False positives cost work, not results.
_FILTER_BITS = 1 << 24
#: Sets of one list that meet others at once.
_BLOCK = 512
#: Shingles hashed in one go.
_CHUNK = 1 << 16

_rng = np.random.default_rng(20)
_FLIPS = _rng.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def matches_needed(percent: int, coordinates: int = COORDINATES) -> int:
    """The most matches that a pair of this similarity reaches but for a chance below ``MISS``."""
    p, below, least = percent / 100, 0.0, 0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > MISS:
            break
        least = k + 1
    return least


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each non-empty set."""
    found = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)))
        for i in range(COORDINATES):
            found[at:end, i] = np.minimum.reduceat((values ^ _FLIPS[i]) * _FACTORS[i], starts) >> np.uint64(32)
        at = end
    return found


def _tokens(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair (coordinate, value)."""
    places = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    return mix((signature.astype(np.uint64) + places).ravel()).reshape(signature.shape)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), COORDINATES)


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """Write and read back in batches of few rows, so that a Python worker holds few texts or sets; the session's value returns."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_ROWS)
    try:
        return written(df, purpose)
    finally:
        conf.set(key, before)


def _name(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _class_counts(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of a power of two of classes; four bits each, 15 for more.

    Small sets have one to two classes a shingle, which tells single shingles apart; large ones two to four shingles a class.
    """
    n = len(shingles)
    classes = 1 << max(4, min((2 * n).bit_length() - 1, max(8, (n // 2).bit_length() - 1)))
    counts = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (classes - 1), minlength=classes)
    low, high = np.minimum(counts, 15).astype(np.uint8).reshape(2, -1)
    return (low | high << 4).tobytes()


def _unpacked(classes: bytes) -> np.ndarray:
    both = np.frombuffer(classes, np.uint8)
    return np.concatenate((both & 15, both >> 4))


def _may_link(x: np.ndarray, y: np.ndarray, sizes: int, percent: int) -> bool:
    """Whether class counts allow a link: no class shares more shingles than the set with fewer of it has."""
    if x.max() == 15 or y.max() == 15:
        return True
    width = min(len(x), len(y))
    x, y = (c if len(c) == width else c.reshape(-1, width).sum(axis=0) for c in (x, y))
    most = int(np.minimum(x, y).sum())
    return 100 * most >= percent * (sizes - most)


def _lonely(n: int, percent: int) -> bool:
    """Whether a set is too small to be similar to any other set."""
    return 100 * n < percent * (n + 1)


def _source() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("source")


def _indexed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, name of its set, n_shingles and source of each document; signature and classes once per set and task."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            sets = list(shingle_sets(list(batch["text"]), k))
            names = [_name(s) for s in sets]
            new = []
            for i, (name, shingles) in enumerate(zip(names, sets, strict=True)):
                if name is not None and name not in seen and not _lonely(len(shingles), percent):
                    seen.add(name)
                    new.append(i)
            signed: list[bytes | None] = [None] * len(sets)
            classes: list[bytes | None] = [None] * len(sets)
            for i, row in zip(new, signatures([sets[i] for i in new]), strict=True):
                signed[i], classes[i] = row.tobytes(), _class_counts(sets[i])
            yield pd.DataFrame({
                "row": batch["row"], "name": pd.Series(names, dtype=object), "n_shingles": np.array([len(s) for s in sets], dtype=np.int64),
                "source": batch["source"], "signature": pd.Series(signed, dtype=object), "classes": pd.Series(classes, dtype=object),
            })

    # ids travel as text: integers with nulls would become floating point and lose digits
    rows = docs.select(F.col("doc_id").cast("string").alias("row"), _source(), "text")
    schema = "row string, name binary, n_shingles long, source long, signature binary, classes binary"
    key = docs.schema["doc_id"].dataType
    return _written(rows.mapInPandas(index, schema).withColumn("doc_id", F.col("row").cast(key)).drop("row"), "signed")


def _frequent(nodes: DataFrame) -> Broadcast:
    """The most frequent tokens, sorted, and their ranks. At most ``_VALUES`` of them."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            both = np.concatenate((tokens, _tokens(_matrix(batch["signature"])).ravel()))
            weight = np.concatenate((numbers, np.ones(len(both) - len(tokens), np.int64)))
            tokens, back = np.unique(both, return_inverse=True)
            numbers = np.bincount(back, weights=weight).astype(np.int64)
            if len(tokens) > 16 * _TASK_VALUES:
                most = np.sort(np.argpartition(numbers, -4 * _TASK_VALUES)[-4 * _TASK_VALUES :])
                tokens, numbers = tokens[most], numbers[most]
        more = np.flatnonzero(numbers > 1)
        more = more[np.argsort(numbers[more], kind="stable")[-_TASK_VALUES:]]
        if len(more):
            yield pd.DataFrame({"token": tokens[more].view(np.int64), "n": numbers[more]})

    parts = nodes.select("signature").mapInPandas(counts, "token long, n long")
    most = parts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(_VALUES).toPandas()
    tokens = most["token"].to_numpy(np.int64).view(np.uint64)[::-1]
    order = np.argsort(tokens, kind="stable")
    return nodes.sparkSession.sparkContext.broadcast((tokens[order], order.astype(np.uint64)))


def _prefixes(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """The coordinates of the first ``length`` tokens of each row in the global order."""
    known, ranks = frequent
    order = tokens >> np.uint64(1)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        order = np.where(known[at] == tokens, ranks[at] + np.uint64(1 << 63), order)
    return np.argsort(order, axis=1, kind="stable")[:, :length]


def _postings(nodes: DataFrame, frequent: Broadcast, length: int) -> DataFrame:
    """token and node for each posting."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                tokens = _tokens(_matrix(batch["signature"]))
                first = _prefixes(tokens, frequent.value, length)
                token = np.take_along_axis(tokens, first, axis=1).ravel().view(np.int64)
                yield pd.DataFrame({"token": token, "node": np.repeat(batch["node"].to_numpy(np.int64), length)})

    return nodes.select("node", "signature").mapInPandas(post, "token long, node long")


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes fit and whose signatures agree in enough coordinates; one byte of each value is compared."""
    least = matches_needed(percent)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), COORDINATES) for c in ("x", "y"))
            yield batch.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            brief = _matrix(batch["signature"]).astype(np.uint8)
            yield pd.DataFrame({"node": batch["node"], "n": batch["n_shingles"], "brief": [row.tobytes() for row in brief]})

    brief = nodes.select("node", "n_shingles", "signature").mapInPandas(shorten, "node long, n long, brief binary")
    left = brief.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("brief").alias("x"))
    right = brief.select(F.col("node").alias("b"), "n", F.col("brief").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").where(f"100 * least(m, n) >= {percent} * greatest(m, n)")
    return written(joined.select("a", "b", "x", "y").mapInPandas(keep, "a long, b long"), "agreeing")


def _filter(numbers: DataFrame) -> Broadcast:
    """A bitmap of the hashes in the only column of ``numbers``; its size is fixed."""
    at = F.pmod(F.col(numbers.columns[0]), F.lit(_FILTER_BITS))
    words = numbers.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(_FILTER_BITS >> 6, dtype=np.uint64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return numbers.sparkSession.sparkContext.broadcast(bitmap)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and shingles (sorted, as bytes) of ``wanted`` (node, name, source), one row per node."""
    shared = _filter(wanted.select("source"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            at = np.mod(batch["source"].to_numpy(np.int64), _FILTER_BITS)
            hit = ((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            batch = batch[hit].drop_duplicates("source")
            batch = batch[~batch["source"].isin(seen)] if seen else batch
            seen.update(batch["source"].tolist())
            found = [s for s in shingle_sets(list(batch["text"]), k)]
            yield pd.DataFrame({
                "source": batch["source"].to_numpy(np.int64), "name": pd.Series([_name(s) or b"" for s in found], dtype=object),
                "shingles": pd.Series([s.tobytes() for s in found], dtype=object),
            })

    found = docs.select(_source(), "text").mapInPandas(sets, "source long, name binary, shingles binary")
    return _written(found.join(wanted, ["source", "name"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    sets = _sets(docs, written(nodes.join(wanted, "node").select("node", "name", "source"), "wanted"), k)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = np.zeros(len(batch), dtype=bool)
            for i, (left, right) in enumerate(zip(batch["left"], batch["right"], strict=True)):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.loc[linked, ["a", "b"]]

    lefts = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    rights = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(rights, "b").join(lefts, "a")
    return _written(joined.select("a", "b", "left", "right").mapInPandas(keep, "a long, b long"), "confirmed")


def _cell(rows: pd.DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> pd.DataFrame:
    """The pairs (a, b) of one cell, from its two blocks or inside its only one, that are apart and may link."""
    rows = rows.sort_values("block", kind="stable")
    blocks, nodes = rows["block"].to_numpy(), rows["node"].to_numpy()
    groups, sizes = rows["component"].to_numpy(), rows["n_shingles"].to_numpy()
    signed = _matrix(rows["signature"])
    tokens = _tokens(signed)
    least = matches_needed(percent)
    weight = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)
    posted = weight[_prefixes(tokens, frequent, COORDINATES - least + 1)].sum(axis=1, dtype=np.uint64)
    # the coordinate of the list, and all before it
    below = weight[int(np.argmax(tokens[0] == rows["token"].to_numpy(np.int64).view(np.uint64)[0]))] - np.uint64(1)
    counts = [_unpacked(c) for c in rows["classes"]]
    first = int(np.searchsorted(blocks, blocks[0], "right"))
    one = bool(rows["same"].iloc[0])
    lefts, rights = [], []
    for i in range(first):
        others = np.arange(i + 1 if one else first, len(rows))
        small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[(groups[others] != groups[i]) & (100 * small >= percent * large)]
        if not len(others):
            continue
        equal = signed[others] == signed[i]
        # a pair belongs to the list of the first coordinate under which both are posted with one value
        shared = (equal * weight).sum(axis=1, dtype=np.uint64) & posted[others] & posted[i]
        mine = (shared & below) == 0
        others, equal = others[mine], equal[mine]
        others = others[equal.sum(axis=1) >= least]
        if not len(others):
            continue
        others = others[[_may_link(counts[i], counts[j], int(sizes[i] + sizes[j]), percent) for j in others]]
        lefts.append(np.minimum(nodes[others], nodes[i]))
        rights.append(np.maximum(nodes[others], nodes[i]))
    return pd.DataFrame({"a": np.concatenate(lefts), "b": np.concatenate(rights)} if lefts else {"a": [], "b": []}).astype(np.int64)


def _cell_pairs(apart: DataFrame, nodes: DataFrame, frequent: Broadcast, percent: int) -> DataFrame:
    """The pairs (a, b) of common lists that are apart and may link. ``apart``: token, size, node, component.

    The sets of a list are dealt to blocks of about ``_BLOCK``, and any two blocks meet in a cell, so a hot list spreads over
    many tasks, and only pairs that may link leave them.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_cell = None
        for batch in batches:
            rows = batch if open_cell is None else pd.concat([open_cell, batch], ignore_index=True)
            cells = rows["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1)]
            found = [_cell(rows.iloc[i:j], frequent.value, percent) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            open_cell = rows.iloc[cuts[-1] :]
            if found:
                yield pd.concat(found, ignore_index=True)
        if open_cell is not None and len(open_cell):
            yield _cell(open_cell, frequent.value, percent)

    many = F.ceil(F.col("size") / _BLOCK)
    rows = apart.withColumn("many", many).withColumn("block", F.pmod(F.xxhash64("node", "token"), many))
    rows = rows.join(nodes.select("node", "n_shingles", "signature", "classes"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    cell = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(
        cell.alias("cell"), "block", (F.col("block") == F.col("other")).alias("same"), "token", "node", "component",
        "n_shingles", "signature", "classes",
    )
    return _written(rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(pairs, "a long, b long"), "cells")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds the component of each node; a node without links is its own."""
    return rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their k-word shingle sets; component_id is the smallest
    doc_id that links reach, and kept says that it is the row's own. Texts with equal sets always belong together. A null
    text counts as empty; an empty text links with nothing and has its own doc_id as component. Repeated rows stay repeated,
    and all rows of a kept id are kept. Rows with a null doc_id stay and pass links on; among null ids alone the component is
    null, and kept true. Other columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    docs = docs.select("doc_id", "text")
    indexed = _indexed(docs, k, percent)
    nodes = indexed.where("name is not null").groupBy("name").agg(
        F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"),
        F.max("classes").alias("classes"), F.min("source").alias("source"),
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    signed = nodes.where("signature is not null")
    length = COORDINATES - matches_needed(percent) + 1
    frequent = _frequent(signed)

    postings = _postings(signed, frequent, length)
    lists = postings.groupBy("token").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    listed = written(postings.join(lists, "token").where("node <> leader"), "listed")
    counted = listed.groupBy(F.col("node").alias("b"), F.col("leader").alias("a")).agg(F.count("*").alias("collisions"))
    links = _confirmed(_agreeing(counted.select("a", "b"), signed, percent), docs, signed, k, percent)
    groups = components(links, "a", "b")

    # leaders have met all others of their lists
    others = _grouped(listed.where("size > 2").select("token", "size", "node"), groups)
    apart = others.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    pairs = _cell_pairs(others.join(apart, "token"), signed, frequent, percent)
    final = components(links.unionByName(_confirmed(pairs, docs, signed, k, percent)), "a", "b")

    named = _grouped(nodes.select("node", "name", "least"), final)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = named.join(least, "component").select("name", "component_id")
    return indexed.join(reached, "name", "left").select(
        "doc_id", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
