"""Near-duplicate groups by word-shingle Jaccard similarity, found through token-combination prefixes.

Shingles are put in one global order, in a rare and a frequent class. A text is indexed under single shingles of
the rare class and under combinations of several neighbouring shingles of the frequent class, over prefixes that are
long enough for any two linked texts to share an entry:

* A text x of n shingles lacks at most ``t = n - ceil(s * n)`` of them in a partner. Its first ``t + 1`` rare shingles
  therefore hold a shared one; they are its entries.
* With only ``r <= t`` rare shingles, which may all be lost, the prefix is extended over all frequent ones. Two linked
  texts of at most m shingles differ in at most ``d = 2 * m * (1 - s) / (1 + s)``. The order is cut into ``d + 1 + z``
  ranges, and the frequent shingles that a text has in one range are a combination, about five at s = 0.85. At least
  ``1 + z`` ranges then hold the same shingles in both texts. Empty ranges are entries only in texts with more than z
  of them. m comes from the text's size band, and a text is indexed for its own band and for the next one.

This holds for any division into classes. Each round indexes the texts that the round before left in different groups
under a common entry; shingles in entries of several such texts are frequent from then on. Only the shingles of
prefixes are counted, so the last round, for the texts that two rounds could not tell apart, takes every shingle
for frequent. In each round texts are compared with leaders of their entries only, and all pairs that are still
apart under the last index are compared block by block in the end.

Entries travel in arrays: a task deals those of its texts to buckets by their shingle, and the task of a bucket returns
only entries under which texts are apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import dropped, small_batches, written
from inkveil.llm.components import components
from inkveil.llm.shingles import mix, shingle_sets

#: Classes of shingles; how many texts of different groups make a class frequent; how often texts are indexed.
CLASSES = 1 << 26
FREQUENT = 4
ROUNDS = 3
#: Bits of the filter for texts that have candidates. False positives cost work, not results.
_FILTER_BITS = 1 << 24
#: Texts of one entry that meet others at once.
_BLOCK = 256
#: Entries of one bucket, and entries that a task looks at together.
_BUCKET, _TOGETHER = 1 << 19, 1 << 21
#: Pairs compared at once.
_PAIRS = 1 << 16
#: Least number of classes of a summary.
_COARSE = 64


def _class(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CLASSES - 1)).astype(np.int64)


def _identity(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    mixed = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64)
    return int(mix(both).view(np.int64)[0])


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _band(n: int, percent: int) -> int:
    """Linked sets have sizes of the same band or of neighbouring ones."""
    return math.floor(math.log(n) / math.log(100 / percent) - 1e-9)


def _combinations(common: np.ndarray, band: int, percent: int) -> np.ndarray:
    """One entry for each range of the order with shingles of ``common``; linked sets of this band and the one before share one."""
    most = math.ceil((100 / percent) ** (band + 1)) + 1
    differ = 2 * most * (100 - percent) // (100 + percent)
    spare = 1 + differ // 8
    parts = differ + 1 + spare
    width = (1 << 64) // parts + 1
    cuts = np.searchsorted(common, np.arange(1, parts, dtype=np.uint64) * np.uint64(width)) if parts > 1 else np.zeros(0, np.int64)
    ends = np.concatenate((cuts, [len(common)]))
    starts = np.concatenate(([0], cuts))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(common ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)))
    place = mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 2) << 32))
    entries = mix(place + total[ends] - total[starts])
    filled = ends > starts
    return entries if parts - int(filled.sum()) > spare else entries[filled]


def _entries(shingles: np.ndarray, frequent: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of one set (see the module's text): single shingles, and combinations."""
    n = len(shingles)
    lost = n - _least_overlap(n, percent)
    often = _set_bits(frequent, _class(shingles))
    rare = shingles[~often][: lost + 1]
    if len(rare) > lost:
        return rare, rare[:0]
    common, band = shingles[often], _band(n, percent)
    return rare, np.concatenate([_combinations(common, b, percent) for b in (band, band + 1)])


def _summary(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each of a power of two of classes, about two into each; None if a count is too large.

    Counts are given in half bytes where all of them fit, and the last byte tells which form it is.
    """
    classes = max(_COARSE, 1 << (max(1, len(shingles) // 2) - 1).bit_length())
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (classes - 1), minlength=classes)
    return _packed(counts) if counts.max() < 256 else None


def _packed(counts: np.ndarray) -> bytes:
    counts = counts.astype(np.uint8)
    if counts.max() < 16:
        return (counts[::2] | counts[1::2] << 4).tobytes() + b"\x01"
    return counts.tobytes() + b"\x00"


def _counts(summary: bytes) -> np.ndarray:
    packed = np.frombuffer(summary, np.uint8)[:-1]
    return np.stack((packed & 15, packed >> 4), axis=1).ravel() if summary[-1] else packed


def _classes(summary: bytes | None) -> int:
    return 0 if summary is None else (len(summary) - 1) << summary[-1]


def _coarse(summary: bytes | None) -> bytes | None:
    """The summary over the least number of classes, which allows more links."""
    if summary is None:
        return None
    counts = _counts(summary).reshape(-1, _COARSE).sum(axis=0, dtype=np.int64)
    return _packed(counts) if counts.max() < 256 else None


def _may_link(left: bytes | None, right: bytes | None, sizes: int, percent: int) -> bool:
    """Whether two summaries allow a link: no class shares more shingles than the set with fewer of it has."""
    if left is None or right is None:
        return True
    x, y = _counts(left).astype(np.int32), _counts(right).astype(np.int32)
    classes = min(len(x), len(y))
    x, y = x.reshape(-1, classes).sum(axis=0), y.reshape(-1, classes).sum(axis=0)
    most = int(np.minimum(x, y).sum())
    return 100 * most >= percent * (sizes - most)


def _set_bits(bitmap: np.ndarray | None, at: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(at), dtype=bool)
    return ((bitmap[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _bitmap(
    numbers: DataFrame, bits: int, position: Callable[[np.ndarray], np.ndarray], before: Broadcast | None = None
) -> Broadcast:
    """``before`` with the positions of the only column of ``numbers`` set as well. Its size is fixed."""
    name = numbers.columns[0]

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = position(batch[name].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"word": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    parts = numbers.mapInPandas(positions, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = before.value.copy() if before else np.zeros(bits >> 6, dtype=np.int64)
    merged = parts.toPandas()  # at most bits / 64 rows
    bitmap[merged["word"].to_numpy()] |= merged["bits"].to_numpy()
    return numbers.sparkSession.sparkContext.broadcast(bitmap)


def _position(doc_id: np.ndarray) -> np.ndarray:
    return (mix(doc_id) & np.uint64(_FILTER_BITS - 1)).astype(np.int64)


def _filtered(batch: pd.DataFrame, bitmap: np.ndarray) -> pd.DataFrame:
    """Rows whose doc_id may be one of those in the bitmap."""
    batch = batch[batch["doc_id"].notna()]
    return batch[_set_bits(bitmap, _position(batch["doc_id"].to_numpy(np.int64).view(np.uint64)))]


def _indexed(docs: DataFrame, k: int, percent: int, often: Broadcast | None, wanted: Broadcast | None) -> DataFrame:
    """One row per document: doc_id, node (name of its set), n_shingles, entries, combinations, summary and its coarse form.

    A task gives entries, combinations and summaries of a set once. ``often``: frequent classes; ``wanted``: filter for documents.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            batch = batch if wanted is None else _filtered(batch, wanted.value)
            for shingles in shingle_sets(list(batch["text"]), k):
                node = _identity(shingles) if len(shingles) else None
                new = node is not None and len(shingles) > 1 and node not in seen
                seen.add(node)
                singles, combined = _entries(shingles, often.value if often else None, percent) if new else (None, None)
                lists = (singles.view(np.int64), combined.view(np.int64)) if new else (None, None)
                summary = _summary(shingles) if new else None
                out.append((node, len(shingles), *lists, summary, _coarse(summary)))
            names, sizes, singles, combined, summaries, coarse = zip(*out, strict=True) if out else ([],) * 6
            # integers with nulls would become floating point and lose digits
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").array, "node": pd.array(list(names), dtype="Int64"),
                "n_shingles": np.array(sizes, dtype=np.int64), "entries": pd.Series(list(singles), dtype=object),
                "combinations": pd.Series(list(combined), dtype=object), "summary": pd.Series(list(summaries), dtype=object),
                "coarse": pd.Series(list(coarse), dtype=object),
            })

    schema = "doc_id long, node long, n_shingles long, entries array<long>, combinations array<long>, summary binary, coarse binary"
    return written(docs.select("doc_id", "text").mapInPandas(index, schema), "entries")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and shingles (sorted, as bytes) of ``wanted`` (doc_id, node), one row per node."""
    shared = _bitmap(wanted.select("doc_id"), _FILTER_BITS, _position)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = _filtered(batch, shared.value)
            found = [(s.tobytes(), _identity(s)) for s in shingle_sets(list(batch["text"]), k)]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].to_numpy(np.int64), "shingles": pd.Series([f[0] for f in found], dtype=object),
                    "node": np.array([f[1] for f in found], dtype=np.int64),
                }
            )

    found = docs.select("doc_id", "text").mapInPandas(sets, "doc_id long, shingles binary, node long")
    # repeated rows of a document give its set more than once
    return written(found.join(wanted, ["doc_id", "node"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")


def _fits(summaries: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """``_may_link`` for many pairs of places in ``summaries``. ``sizes``: of both sets of a pair together."""
    widths = np.array([_classes(x) for x in summaries], dtype=np.int64)
    width = np.minimum(widths[left], widths[right])
    may = width == 0
    for w in np.unique(width[~may]).tolist():
        at = np.flatnonzero(width == w)
        used, place = np.unique(np.concatenate((left[at], right[at])), return_inverse=True)
        table = np.stack([_counts(summaries[i]).reshape(-1, w).sum(axis=0, dtype=np.uint16) for i in used])
        x, y = place[: len(at)], place[len(at) :]
        step = max(1, (1 << 22) // w)
        for i in range(0, len(at), step):
            most = np.minimum(table[x[i : i + step]], table[y[i : i + step]]).sum(axis=1, dtype=np.int64)
            may[at[i : i + step]] = 100 * most >= percent * (sizes[at[i : i + step]] - most)
    return may


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and summaries allow a link: coarse summaries first, whole ones for what is left."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            both = np.concatenate((batch["x"].to_numpy(object), batch["y"].to_numpy(object)))
            yield batch.loc[_fits(both, np.arange(n), np.arange(n, 2 * n), batch["sizes"].to_numpy(), percent), ["a", "b"]]

    def allowed(some: DataFrame, summary: str) -> DataFrame:
        x = nodes.select(F.col("node").alias("a"), F.col(summary).alias("x"), F.col("n_shingles").alias("m"))
        y = nodes.select(F.col("node").alias("b"), F.col(summary).alias("y"), F.col("n_shingles").alias("n"))
        fits = f"100 * least(m, n) >= {percent} * greatest(m, n)"
        joined = some.select("a", "b").join(x, "a").join(y, "b").where(fits)
        found = joined.select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("sizes")).mapInPandas(keep, "a long, b long")
        return written(found, "plausible")

    coarse = allowed(pairs, "coarse")
    found = allowed(coarse, "summary")
    dropped(coarse)
    return found


def _compared(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, percent: int) -> pd.DataFrame:
    """The pairs (a, b) among those of places in ``rows`` that may link and are apart, each once."""
    nodes, sizes = rows["node"].to_numpy(), rows["n_shingles"].to_numpy()
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    groups = rows["component"].to_numpy()
    some = (groups[left] != groups[right]) & (100 * small >= percent * large)
    left, right = left[some], right[some]
    a, b = np.minimum(nodes[left], nodes[right]), np.maximum(nodes[left], nodes[right])
    order = np.lexsort((b, a))
    a, b, left, right = a[order], b[order], left[order], right[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, left, right = a[first], b[first], left[first], right[first]
    may = _fits(rows["summary"].to_numpy(object), left, right, sizes[left] + sizes[right], percent)
    return pd.DataFrame({"a": a[may], "b": b[may]})


def _cells(rows: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """The pairs (a, b) of whole cells, each from its two blocks or inside its only one, that may link and are still apart."""
    rows = rows.sort_values(["cell", "block"], kind="stable", ignore_index=True)
    cells, blocks, same = (rows[c].to_numpy() for c in ("cell", "block", "same"))
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    lefts, rights, waiting = [], [], 0
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        if same[i]:
            left, right = np.triu_indices(j - i, 1)
        else:
            first = int(np.searchsorted(blocks[i:j], blocks[i], "right"))
            left, right = (x.ravel() for x in np.meshgrid(np.arange(first), np.arange(first, j - i), indexing="ij"))
        lefts.append(left + i)
        rights.append(right + i)
        waiting += len(left)
        if waiting >= _PAIRS:
            yield _compared(rows, np.concatenate(lefts), np.concatenate(rights), percent)
            lefts, rights, waiting = [], [], 0
    if waiting:
        yield _compared(rows, np.concatenate(lefts), np.concatenate(rights), percent)


def _cell_pairs(apart: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) under a common entry that are apart and whose sizes and summaries allow a link.

    The texts of an entry are dealt to blocks of about ``_BLOCK``, and any two blocks meet in a cell, so a hot entry spreads
    over many tasks, and only pairs that may link leave them.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_cell = None
        for batch in batches:
            rows = batch if open_cell is None else pd.concat([open_cell, batch], ignore_index=True)
            cells = rows["cell"].to_numpy()
            cut = int(np.flatnonzero(cells[1:] != cells[:-1])[-1]) + 1 if len(rows) and cells[0] != cells[-1] else 0
            yield from _cells(rows.iloc[:cut], percent) if cut else ()
            open_cell = rows.iloc[cut:]
        if open_cell is not None and len(open_cell):
            yield from _cells(open_cell, percent)

    many = F.ceil(F.col("size") / _BLOCK)
    rows = apart.select("entry", "node", "component", many.alias("many"), F.pmod(F.xxhash64("node", "entry"), many).alias("block"))
    rows = rows.join(nodes.select("node", "n_shingles", "summary"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    cell = F.xxhash64("entry", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(
        cell.alias("cell"), "block", (F.col("block") == F.col("other")).alias("same"), "node", "component", "n_shingles", "summary"
    )
    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(pairs, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, nodes.where("doc_id is not null").join(wanted, "node").select("doc_id", "node"), k)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                joined = np.concatenate((x, y))
                joined.sort()
                both = int((joined[1:] == joined[:-1]).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(linked, dtype=bool), ["a", "b"]]

    lefts = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    rights = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(lefts, "a").join(rights, "b")
    found = written(joined.select("a", "b", "left", "right").mapInPandas(keep, "a long, b long"), "links")
    dropped(sets)
    return found


def _grouped(entries: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds the component of each node; a node without links is its own."""
    if groups is None:
        return entries.withColumn("component", F.col("node"))
    return entries.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the number of the run of each key."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _differ(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Of sorted keys, those with more than one group."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    starts, run = _ranges(keys)
    return (np.minimum.reduceat(groups, starts) < np.maximum.reduceat(groups, starts))[run]


def _under_common(keys: np.ndarray, nodes: np.ndarray, groups: np.ndarray, bands: np.ndarray, whole: bool) -> pd.DataFrame:
    """entry, node, component and single of the nodes that share an entry with a node of another group.

    ``bands``: of the node's size, or -1 if the key is a combination. Without the ``whole`` of a bucket no key is left out.
    """
    order = np.argsort(keys, kind="stable")
    if whole:
        order = order[_differ(keys[order], groups[order])]
    keys, nodes, groups, bands = keys[order], nodes[order], groups[order], bands[order]
    # linked sets are in the same band or in neighbouring ones
    one = bands >= 0
    banded = [mix(keys[one].view(np.uint64) ^ mix((bands[one] + more).astype(np.uint64))).view(np.int64) for more in (0, 1)]
    entry = np.concatenate((keys[~one], *banded))
    at = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one), np.flatnonzero(one)))
    order = np.lexsort((nodes[at], entry))
    entry, at = entry[order], at[order]
    # several tasks may have given one node
    new = np.ones(len(at), dtype=bool)
    new[1:] = (entry[1:] != entry[:-1]) | (nodes[at][1:] != nodes[at][:-1])
    entry, at = entry[new], at[new]
    if whole:
        kept = _differ(entry, groups[at])
        entry, at = entry[kept], at[kept]
    single = pd.array(keys[at], dtype="Int64")
    single[~one[at]] = pd.NA
    return pd.DataFrame({"entry": entry, "node": nodes[at], "component": groups[at], "single": single})


def _entries_apart(indexed: DataFrame, groups: DataFrame | None, percent: int) -> DataFrame:
    """entry, node, component and single (null for a combination) for entries with nodes of different groups."""
    given = indexed.where("entries is not null")
    n = given.agg(F.coalesce(F.sum(F.size("entries") + F.size("combinations")), F.lit(0))).first()[0]
    buckets = -(-n // _BUCKET) + 8

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [*batch["entries"], *batch["combinations"]]
            at = np.repeat(np.tile(np.arange(len(batch)), 2), [len(x) for x in lists])
            keys = np.concatenate([np.zeros(0, np.int64), *lists])
            bands = np.array([_band(x, percent) for x in batch["n_shingles"].tolist()], dtype=np.int16)[at]
            bands[sum(len(x) for x in batch["entries"]) :] = -1
            bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            columns = [x[order] for x in (keys, batch["node"].to_numpy(np.int64)[at], batch["component"].to_numpy(np.int64)[at], bands)]
            starts, _ = _ranges(bucket[order])
            ends = [*starts[1:].tolist(), len(order)]
            rows = [(int(bucket[order[i]]), *(x[i:j].tobytes() for x in columns)) for i, j in zip(starts.tolist(), ends, strict=True) if j > i]
            yield pd.DataFrame(rows, columns=["bucket", "keys", "nodes", "components", "bands"])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        held, whole = 0, True
        for batch in batches:
            for row in batch[["bucket", "keys", "nodes", "components", "bands"]].itertuples(index=False):
                ended = bool(waiting) and waiting[0][0] != row.bucket
                if ended or held >= _TOGETHER:
                    whole = whole and ended
                    yield from answered(waiting, whole)
                    waiting, held, whole = [], 0, ended
                waiting.append(tuple(row))
                held += len(row.bands) // 2
        if waiting:
            yield from answered(waiting, whole)

    def answered(rows: list[tuple], whole: bool) -> Iterator[pd.DataFrame]:
        columns = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in ((1, np.int64), (2, np.int64), (3, np.int64), (4, np.int16)))
        found = _under_common(*columns, whole)
        for at in range(0, len(found), 1 << 16):
            yield found.iloc[at : at + (1 << 16)]

    rows = _grouped(given.select("node", "n_shingles", "entries", "combinations"), groups)
    dealt = rows.mapInPandas(deal, "bucket long, keys binary, nodes binary, components binary, bands binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInPandas(settle, "entry long, node long, component long, single long"), "entries-apart")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their k-word shingle sets; component_id is
    the smallest doc_id that links reach. Texts with equal sets always belong together. A null text counts as
    empty; an empty text links with nothing and has its own doc_id as component. Repeated rows stay repeated.
    Rows with a null doc_id stay; they group with rows of an equal set only. Other columns are ignored.
    ``frequent`` decides which shingles count as frequent, not which links are found.
    """
    if not 80 <= percent <= 100:
        raise ValueError("prefixes are long enough for 80 to 100 percent only")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    by_entry = Window.partitionBy("entry")
    low, high = F.min("component").over(by_entry), F.max("component").over(by_entry)
    often = wanted = groups = links = tried = None
    for turn in range(ROUNDS):
        indexed = _indexed(docs, k, percent, often, wanted)
        if groups is None:
            every = written(indexed.select("doc_id", "node", "n_shingles"), "every")
            nodes = written(
                indexed.where("node is not null").groupBy("node")
                .agg(F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in ("n_shingles", "summary", "coarse")]), "nodes",
            )
        entries = _entries_apart(indexed, groups, percent)
        dropped(indexed)
        # two leaders of each entry: one of the first group, and any
        one = F.struct("component", "node")
        leaders = F.array(F.min(one).over(by_entry), F.min_by(one, F.xxhash64("node", "entry")).over(by_entry))
        stars = entries.withColumn("leaders", leaders).select("node", "component", F.explode("leaders").alias("leader"))
        stars = stars.where("component <> leader.component")
        pairs = stars.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        tried = pairs if tried is None else tried.unionByName(pairs)
        plausible = _plausible(pairs, nodes, percent)
        found = _verified(plausible, docs, nodes, k, percent)
        links = found if links is None else links.unionByName(found)
        groups = components(links, "a", "b")
        apart = _grouped(entries.drop("component"), groups).withColumns({"low": low, "high": high, "size": F.count("*").over(by_entry)})
        apart = written(apart.where("low < high").drop("low", "high"), "apart")
        dropped(plausible, entries)
        some = apart.select("node").distinct().join(nodes.where("doc_id is not null"), "node").select("doc_id")
        wanted = _bitmap(some, _FILTER_BITS, _position)
        if turn + 2 < ROUNDS:
            common = apart.where((F.col("size") >= frequent) & F.col("single").isNotNull()).select("single").distinct()
            often = _bitmap(common, CLASSES, _class, often)
            dropped(apart)
        elif turn + 1 < ROUNDS:
            dropped(apart)
            often = docs.sparkSession.sparkContext.broadcast(np.full(CLASSES >> 6, -1, dtype=np.int64))

    pairs = _cell_pairs(apart, nodes, percent).join(tried, ["a", "b"], "left_anti")
    plausible = written(pairs, "plausible")
    more = _verified(plausible, docs, nodes, k, percent)
    dropped(apart, plausible, tried, nodes)
    final = components(links.unionByName(more), "a", "b")

    named = every.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
