"""Conversation structure repair: cheapest edits that give every conversation the roles system?, (user, assistant)+.

Decisions are made on narrow rows (digests instead of texts). Equal rows are counted, all rows are sorted over ranges of
(conversation, turn), and blocks of at most 4,096 rows of one range are summed up as steps between the four states of
the pattern. Where a conversation spans several blocks, :mod:`inkveil.llm.crossings` picks the states at their borders,
and then each block is solved by itself, so one conversation of any length spreads over many tasks. Texts join their
edits in the end.

Blank and duplicate turns have to go wherever the pattern stands, and "D" is the least letter, so they are deleted
at once and take no part in the recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm import crossings
from inkveil.llm.common import written

#: Rows of one block, as a power of two.
_BLOCK_BITS = 12
_BLANKS = " \t\n\v\f\r"
#: Neighbouring role initials that follow the pattern.
_LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats the row, 4
    makes it the user's.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault")
    )
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _said() -> Column:
    """A digest of who said what in which conversation; lengths keep the parts apart."""
    conv = F.col("conv_id").cast("string")
    name = F.coalesce(F.concat(F.length(conv), F.lit(":"), conv), F.lit("-"))
    return F.sha2(F.concat(name, F.lit(" "), F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` without nulls in role and text, ``said``, and ``row``, a digest of all columns that count."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("said", _said())
    turn = F.coalesce(F.col("turn").cast("string"), F.lit("-"))
    return rows.withColumn("row", F.unhex(F.sha2(F.concat("said", turn), 256))).withColumn("said", F.unhex("said"))


def _ordered(keyed: DataFrame) -> DataFrame:
    """One narrow row per distinct row with its place ``at`` in the order of conversations and turns, and its fault."""
    end = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    facts = keyed.select("conv_id", "turn", "role", "said", "row", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open"))
    same = facts.groupBy("row").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("conv_id", "turn", "role", "said", "blank", "open"))
    )
    again = same.where("not blank").groupBy("said").agg(F.count("*").alias("turns"), F.min(F.struct("turn")).alias("first"))
    again = again.where("turns > 1").select("said", "first")
    told = same.join(again, "said", "left").withColumn("repeated", F.col("first").isNotNull() & (F.col("first") != F.struct("turn")))
    fault = F.when(F.col("blank"), "blank").when(F.col("repeated"), "duplicate").when(F.col("open"), "truncated")
    initial = F.substring("role", 1, 1)
    rows = told.select(
        "conv_id", "turn", "role", "row", "copies", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial")
    )
    order = ("conv_id", "turn", "role", "row")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(rows.withColumn("block", F.shiftright("at", _BLOCK_BITS)), "turns")


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block in order, and where its conversations begin (with the end)."""
    order = np.argsort(table["at"].to_numpy(), kind="stable")
    codes = table["conv_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
    return order, starts


def _stays(fault: str | None) -> bool:
    return fault not in ("blank", "duplicate")


@lru_cache(maxsize=1 << 16)
def _whole(kinds: tuple[tuple[str, bool], ...]) -> tuple[tuple[int, int, int, int], ...]:
    return crossings.whole([crossings.turn(*k) for k in kinds]).steps


def _summaries(ordered: DataFrame) -> DataFrame:
    """One row per conversation and block: its steps between states, its illegal neighbours, its first and last initial."""

    def summary(table: pa.Table) -> pa.Table:
        order, starts = _runs(table)
        initial = np.array(table["initial"].to_pylist(), dtype=object)[order]
        fault = np.array(table["fault"].to_pylist(), dtype=object)[order]
        copies = table["copies"].to_numpy()[order]
        steps, illegal = [], []
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            kinds = tuple((initial[i], fault[i] == "truncated") for i in range(low, high) if _stays(fault[i]))
            steps.append([x for step in _whole(kinds) for x in step])
            wrong = sum(initial[i - 1] + initial[i] not in _LEGAL for i in range(low + 1, high))
            illegal.append(wrong + int(copies[low:high].sum()) - (high - low))
        firsts, lasts = starts[:-1], starts[1:] - 1
        return pa.table({
            "conv_id": table["conv_id"].combine_chunks().take(pa.array(order[firsts])),
            "block": table["block"].combine_chunks().take(pa.array(order[firsts])), "steps": pa.array(steps, pa.list_(pa.int64())),
            "illegal": pa.array(illegal, pa.int64()), "first": pa.array(initial[firsts], pa.string()), "last": pa.array(initial[lasts], pa.string()),
        })

    key = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, block long, steps array<long>, illegal long, first string, last string"
    return ordered.select("block", "at", "conv_id", "initial", "fault", "copies").groupBy("block").applyInArrow(summary, schema)


def _borders(summaries: DataFrame) -> DataFrame:
    """conv_id, block, the states ``enter`` and ``leave`` of each part of a conversation, whether it ends there, and illegal neighbours."""

    def cross(parts: list[tuple]) -> Iterator[tuple]:
        items = [crossings.Item(tuple(zip(*[iter(p[2])] * 4, strict=True))) for p in parts] + [crossings.END]
        states = crossings.crossings(items, crossings.START, crossings.START)
        for i, (conv, block, _, illegal, first, _) in enumerate(parts):
            wrong = i > 0 and parts[i - 1][5] + first not in _LEGAL
            yield conv, block, states[i], states[i + 1], i + 1 == len(parts), illegal + int(wrong)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        names = ["conv_id", "block", "enter", "leave", "ends", "illegal"]
        for batch in batches:
            rows = []
            for part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and parts[0][0] != part[0]:
                    rows += cross(parts)
                    parts = []
                parts.append(part)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(batch), strict=True)], names)
            last = batch
        if parts:
            rows = list(cross(parts))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(last), strict=True)], names)

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]

    key = summaries.schema["conv_id"].dataType.simpleString()
    rows = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return written(rows.mapInArrow(found, f"conv_id {key}, block long, enter int, leave int, ends boolean, illegal long"), "borders")


def _cost(letter: str, truncated: bool) -> int:
    if letter == "D":
        return crossings.DELETE
    if letter == "I":
        return crossings.INSERT
    return (crossings.REROLE if letter == "R" else 0) + (crossings.TRUNCATED if truncated else 0)


@lru_cache(maxsize=1 << 16)
def _solved(kinds: tuple[tuple[str, bool], ...], enter: int, leave: int, ends: bool) -> tuple[tuple[tuple[str, str | None, int], ...], ...]:
    """The edits (letter, new role, cost) of each turn, and in the last place those after the last turn."""
    items = [crossings.turn(*k) for k in kinds]
    states = crossings.crossings(items, enter, leave)
    found = []
    for i, (initial, truncated) in enumerate(kinds):
        letters = items[i].letters[states[i], states[i + 1]]
        found.append(tuple(zip(letters, crossings.roles(states[i], letters, initial), [_cost(x, truncated) for x in letters], strict=True)))
    letters = crossings.END.letters[leave, crossings.START] if ends else ""
    found.append(tuple(zip(letters, crossings.roles(leave, letters, ""), [crossings.INSERT] * len(letters), strict=True)))
    return tuple(found)


def _edits(ordered: DataFrame, borders: DataFrame) -> DataFrame:
    """conv_id, at, step, edit, new_role, times, cost, and the digest ``row`` of the turn; null for inserted ones."""
    fields = [("at", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("new_role", pa.string()), ("times", pa.int64()), ("cost", pa.int64())]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        order, starts = _runs(left)
        at, copies = left["at"].to_numpy()[order], left["copies"].to_numpy()[order]
        initial = np.array(left["initial"].to_pylist(), dtype=object)[order]
        fault = np.array(left["fault"].to_pylist(), dtype=object)[order]
        ways = dict(zip(right["conv_id"].to_pylist(), zip(*(right[c].to_pylist() for c in ("enter", "leave", "ends")), strict=True), strict=True))
        convs = left["conv_id"].combine_chunks().take(pa.array(order[starts[:-1]])).to_pylist()
        rows: list[tuple] = []
        source: list[int] = []
        for conv, low, high in zip(convs, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            kinds = tuple((initial[i], fault[i] == "truncated") for i in range(low, high) if _stays(fault[i]))
            solved = iter(_solved(kinds, *ways[conv]) if len(kinds) <= 64 else _solved.__wrapped__(kinds, *ways[conv]))
            for i in range(low, high):
                left_over = int(copies[i])
                step = 0
                if _stays(fault[i]):
                    for letter, role, cost in next(solved):
                        rows.append((int(at[i]), step, letter, role, 1, cost))
                        source.append(i)
                        step += 1
                    left_over -= 1
                if left_over:
                    rows.append((int(at[i]), step, "D", None, left_over, crossings.DELETE * left_over))
                    source.append(i)
                    step += 1
            for letter, role, cost in next(solved):
                rows.append((int(at[high - 1]), step, letter, role, 1, cost))
                source.append(high - 1)
                step += 1
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        picked = pa.array(order[np.array(source, dtype=np.int64)])
        inserted = pa.array([r[2] == "I" for r in rows], pa.bool_())
        digests = left["row"].combine_chunks().take(picked)
        return pa.table(
            {"conv_id": left["conv_id"].combine_chunks().take(picked)}
            | {name: pa.array(c, t) for (name, t), c in zip(fields, columns, strict=True)}
            | {"row": pa.compute.if_else(inserted, pa.scalar(None, digests.type), digests)}
        )

    key = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, at long, step int, edit string, new_role string, times long, cost long, row binary"
    turns = ordered.select("block", "at", "conv_id", "initial", "fault", "copies", "row")
    return turns.groupBy("block").cogroup(borders.groupBy("block")).applyInArrow(solve, schema)


def _with_texts(edits: DataFrame, keyed: DataFrame) -> DataFrame:
    texts = keyed.dropDuplicates(["row"]).select("row", "turn", "role", "text")
    # inserted turns have no text to meet; a key of their own deals them out
    own = F.encode(F.concat_ws(":", "at", "step"), "utf-8")
    return edits.withColumn("row", F.coalesce("row", own)).join(texts, "row", "left").select(
        "conv_id", "at", "step", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "times", "cost"
    )


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit: conv_id, at and step (their order), edit, turn, role, text, times and cost.

    Turns count in the order of turn (nulls first), then role, then a digest of the row. A turn is ``blank`` without anything
    but ASCII white space, ``duplicate`` if the conversation said the same in the same role before, ``truncated`` if it ends in none of
    ``.!?``. Edits are K (keep, 0), R (rerole to user or assistant, 3), D (delete, 4; always for blank and duplicate turns) and I
    (insert an empty turn of user or assistant, 3); an undeleted truncated turn adds 3. The role initials that are left
    match ``(s?(ua)+)?`` at least cost, and of the cheapest audits the ASCII-least is taken. ``times`` counts equal turns that go together.

    Null roles and texts count as one space; rows with a null conv_id are one conversation. Repeated rows are duplicates. An empty
    table gives no rows. Other columns are ignored.
    """
    keyed = _keyed(conversations)
    ordered = _ordered(keyed)
    return _with_texts(_edits(ordered, _borders(_summaries(ordered))), keyed)


def _digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256. Turns are streamed in order; a task holds one audit and the state of one hash."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, audit, state, lines = nothing, [], None, 0
        key = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), (key, pa.string(), pa.string()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            key = batch.schema.field(0).type
            done = []
            for this, edit, times, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != conv:
                    if conv is not nothing:
                        done.append((conv, "".join(audit), state.hexdigest()))
                    conv, audit, state, lines = this, [], hashlib.sha256(), 0
                audit.append(edit * times)
                if edit != "D":
                    state.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    lines += 1
            if done:
                yield out(done)
        if conv is not nothing:
            yield out([(conv, "".join(audit), state.hexdigest())])

    key = edits.schema["conv_id"].dataType.simpleString()
    # deleted turns need no text
    rows = edits.select("conv_id", "at", "step", "edit", "times", "role", F.when(F.col("edit") != "D", F.col("text")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step").select("conv_id", "edit", "times", "role", "text")
    return rows.mapInArrow(digest, f"conv_id {key}, audit string, repaired_sha256 string")


def reports(originals: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``originals`` about the repair of ``conversations``.

    gaps (missing turn numbers between the least and the greatest, null turns apart), blank, duplicate, truncated (turns by their
    first fault), illegal (neighbouring role initials other than su, ua, au, before the repair), cost, audit (letters of the edits in order) and
    repaired_sha256 (``role:text`` of the repaired turns, joined by newlines). Conversations without rows have zeros, an
    empty audit and the hash of the empty string. See :func:`repair` for the rest.

    The hash has to read a repaired conversation in order, so that last step takes one task for each conversation, in a stream.
    """
    keyed = _keyed(conversations)
    ordered = _ordered(keyed)
    borders = _borders(_summaries(ordered))
    edits = _edits(ordered, borders)
    stays = F.when(F.col("fault").isNull() | (F.col("fault") == "truncated"), 1).otherwise(0)
    blank = F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0))
    duplicate = F.sum(F.when(F.col("fault") == "blank", 0).otherwise(F.col("copies") - stays))
    truncated = F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0))
    # turns are counted once each before their conversation is added up
    numbers = ordered.groupBy("conv_id", "turn").agg(blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counted = numbers.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    parts = [
        originals.select("conv_id").distinct(), counted, borders.groupBy("conv_id").agg(F.sum("illegal").alias("illegal")),
        edits.groupBy("conv_id").agg(F.sum("cost").alias("cost")), _digests(_with_texts(edits, keyed)),
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return together.groupBy("conv_id").agg(
        *numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256")
    )
