"""Conversation repair against a model that keeps every cheapest audit as a string."""

import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import conversations, crossings

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id long, turn long, role string, text string, cost long, `a.b` string"


def damage(rows):
    for conv, turn, role, text in rows:
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        yield from [row] * (2 if fault == 3 else 1)


def cheapest(turns):
    """(cost, audit, repaired roles) of ``turns`` (role, must go, truncated), with all insertions tried everywhere."""

    def inserted(table):
        table, layer = dict(table), table
        for _ in range(3):
            more = {}
            for s, (c, a, out) in layer.items():
                way = (c + 3, a + "I", (*out, ({2: "user", 3: "assistant"}[NEXT[s]], None)))
                if NEXT[s] not in table or way < table[NEXT[s]]:
                    more[NEXT[s]] = table[NEXT[s]] = way
            layer = more
        return table

    # least by cost, then by audit: audits that reach one state after a turn are never prefixes of each other
    table = {0: (0, "", ())}
    for i, (role, goes, truncated) in enumerate(turns):
        more = {}
        for s, (c, a, out) in ([(s, w) for s, w in table.items()] if goes else list(inserted(table).items())):
            ways = [(s, 4, "D", ())]
            if not goes:
                ways.append((NEXT[s], 3 + 3 * truncated, "R", (({2: "user", 3: "assistant"}[NEXT[s]], i),)))
                if (s, role[:1]) in KEPT:
                    ways.append((KEPT[s, role[:1]], 3 * truncated, "K", ((role, i),)))
            for t, cost, letter, kept in ways:
                way = (c + cost, a + letter, out + kept)
                if t not in more or way[:2] < more[t][:2]:
                    more[t] = way
        table = more
    table = inserted(table)
    return min((table[s] for s in (0, 3) if s in table), key=lambda w: w[:2])


def model(rows):
    report = {}
    after = {}
    for row in damage(rows):
        after.setdefault(row[0], []).append(row)
    for conv in {r[0] for r in rows}:
        turns = sorted(after.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, seen = [], set()
        for _, _, role, text in turns:
            said = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
            seen.add((role, text))
        first = [r[2][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, out = cheapest([(r[2], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(turns, faults, strict=True)])
        lines = [f"{role}:{'' if i is None else turns[i][3]}" for role, i in out]
        digest = sha256("\n".join(lines).encode()).hexdigest()
        report[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return report


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(3)
    out = conversations.reports(frame, conversations.damaged(frame))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.columns == ["conv_id", *names]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in out.collect()}
    want = model(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def made(rng, convs, turns, roles=("system", "user", "assistant", "user", "assistant", "tool", "")):
    texts = ["Yes.", "no", "Why?", "", " \t\n", "Good!  \n", "a. b", "\xa0", "Ärger…"]
    for conv in convs:
        for turn in range(int(rng.integers(1, turns + 1))):
            text = str(rng.choice(texts)) if rng.random() < 0.5 else f"line {conv} {turn}."
            yield (conv, turn * int(rng.integers(1, 3)) if rng.random() < 0.1 else 2 * turn, str(rng.choice(roles)), text)


def test_reports_match_the_model(spark):
    rng = np.random.default_rng(4)
    rows = {(r[0], r[1]): r for r in made(rng, range(150), 12)}  # one row for each turn, so that the order is given
    check(spark, list(rows.values()))


def test_nulls_repeated_rows_and_long_texts(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, "user", "Null turn."), (1, 3, None, "x."),
        (1, 4, "assistant", None), (1, 9, "assistant", "z" * 2_000_000 + "."), (2, 1, "system", "Only system."), (3, 2**62, "user", "Far."),
        (4, 7, "user", "same."), (4, 7, "user", "same."), (4, 8, "assistant", "same."), (4, 9, "user", "same."), (5, 1, "assistant", "\n"),
        (2**60 + 1, 1, "user", "Large id."), (2**60, 1, "assistant", "Large id."),
    ]
    check(spark, rows)


def test_one_long_conversation_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "_BLOCK_BITS", 3)
    rng = np.random.default_rng(8)
    check(spark, list({(r[0], r[1]): r for r in [*made(rng, [7], 400), *made(rng, range(20, 40), 5)]}.values()))


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(frame).count() == 0
    assert conversations.reports(frame, conversations.damaged(frame)).count() == 0


def test_repair_gives_texts(spark):
    rows = [(1, 1, "assistant", "First."), (1, 2, "user", "Cut"), (1, 2, "user", "Cut"), (1, 3, "assistant", " ")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repair(frame).orderBy("at", "step").select("edit", "role", "text", "times", "cost").collect()
    # an empty user turn before the first answer costs less than its deletion
    assert [tuple(r) for r in got] == [
        ("I", "user", "", 1, 3), ("K", "assistant", "First.", 1, 0), ("D", "user", "Cut", 1, 4), ("D", "user", "Cut", 1, 4),
        ("D", "assistant", " ", 1, 4),
    ]


@pytest.mark.parametrize("seed", range(6))
def test_crossings_of_blocks_and_turns_agree(seed):
    rng = np.random.default_rng(seed)
    kinds = [(str(rng.choice(["s", "u", "a", ""])), bool(rng.random() < 0.3)) for _ in range(60)]
    items = [crossings.turn(*k) for k in kinds]
    states = crossings.crossings([*items, crossings.END], 0, 0)
    audit = "".join(x.letters[a, b] for x, a, b in zip([*items, crossings.END], states, states[1:], strict=False))
    cost = crossings.forward([*items, crossings.END], 0, len(items) + 1, 0)[0][0]
    assert (cost, audit) == cheapest([(k[0], False, k[1]) for k in kinds])[:2]
    cuts = [0, 7, 7, 20, 59, 60]
    blocks = [crossings.whole(items[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert crossings.crossings([*blocks, crossings.END], 0, 0)[:-1] == [states[c] for c in cuts]


def test_query_keeps_every_conversation(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
    assert conversations.damaged(table).where(F.col("text").isNull()).count() == 0
