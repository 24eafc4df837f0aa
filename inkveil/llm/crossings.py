"""Cheapest edits that give a sequence of turns the role pattern ``(s?(ua)+)?``, by divide and conquer in linear space.

The pattern has four states: nothing yet, after a system turn, after a user turn, after an assistant turn. An *item* is
anything that takes one state to another at a cost: a single turn with the edits around it, a whole block of turns, or
the end. Forward cost vectors from the start and backward ones from the end meet in the middle of a sequence; of the
crossing states with least total cost the one with the ASCII-least audit is taken, and both halves are solved alone.

Comparing audits needs no strings. Every audit of the first half ends with the letter of its last turn, and two audits
that reach different states differ, so neither is a prefix of the other: the one that is less before the crossing is less as
a whole. Vectors therefore carry, beside each state's cost, the rank of its least audit among the four.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state after an inserted or reroled turn: user comes next everywhere but after a user.
_NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept turn whose role begins so; other steps are illegal.
_KEPT = {(START, "s"): SYSTEM, **{(p, "u"): USER for p in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}


class Item(NamedTuple):
    """``steps``: (from, to, cost, rank), where ranks order the audits of one start; ``letters``: edits for (from, to)."""

    steps: tuple[tuple[int, int, int, int], ...]
    letters: dict[tuple[int, int], str] | None = None


def _ranked(best: dict[tuple[int, int], tuple[int, str]]) -> Item:
    steps = []
    for p in range(STATES):
        order = sorted((letters, t) for (q, t), (_, letters) in best.items() if q == p)
        steps += [(p, t, best[p, t][0], rank) for rank, (_, t) in enumerate(order)]
    return Item(tuple(steps), {k: letters for k, (_, letters) in best.items()})


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _NEXT[state]
    return state


@lru_cache(maxsize=16)
def turn(initial: str, truncated: bool) -> Item:
    """One turn with at most two insertions before it; more would only return to an earlier state."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = TRUNCATED if truncated else 0
    for p in range(STATES):
        for n in range(3):
            at = _inserted(p, n)
            ways = [("D", at, DELETE), ("R", _NEXT[at], REROLE + more)]
            if (at, initial) in _KEPT:
                ways.append(("K", _KEPT[at, initial], more))
            for letter, t, cost in ways:
                way = (n * INSERT + cost, "I" * n + letter)
                best[p, t] = min(best.get((p, t), way), way)
    return _ranked(best)


#: The end of a conversation: what is missing of the pattern is inserted.
END = _ranked({(START, START): (0, ""), (ASSISTANT, START): (0, ""), (USER, START): (INSERT, "I"), (SYSTEM, START): (2 * INSERT, "II")})

Vector = dict[int, tuple[int, int]]


def forward(items: Sequence[Item], low: int, high: int, start: int) -> Vector:
    """Cost and rank of each state that ``start`` reaches over ``items[low:high]``."""
    vector: Vector = {start: (0, 0)}
    for i in range(low, high):
        reached: dict[int, tuple[int, int, int]] = {}
        for p, t, cost, rank in items[i].steps:
            if p in vector:
                way = (vector[p][0] + cost, vector[p][1], rank)
                if t not in reached or way < reached[t]:
                    reached[t] = way
        order = sorted(reached, key=lambda t: reached[t][1:])
        vector = {t: (reached[t][0], rank) for rank, t in enumerate(order)}
    return vector


def backward(items: Sequence[Item], low: int, high: int, end: int) -> dict[int, int]:
    """The cost from each state to ``end`` over ``items[low:high]``."""
    vector = {end: 0}
    for i in range(high - 1, low - 1, -1):
        reached: dict[int, int] = {}
        for p, t, cost, _ in items[i].steps:
            if t in vector:
                reached[p] = min(reached.get(p, cost + vector[t]), cost + vector[t])
        vector = reached
    return vector


def crossings(items: Sequence[Item], start: int, end: int) -> list[int]:
    """The state before each item and after the last one, on the audit-least of the cheapest ways."""
    states = [start] * len(items) + [end]
    open_parts = [(0, len(items))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        before = forward(items, low, middle, states[low])
        after = backward(items, middle, high, states[high])
        states[middle] = min((s for s in before if s in after), key=lambda s: (before[s][0] + after[s], before[s][1]))
        open_parts += [(low, middle), (middle, high)]
    return states


def whole(items: Sequence[Item]) -> Item:
    """``items`` as one item without letters."""
    steps = []
    for p in range(STATES):
        steps += [(p, t, cost, rank) for t, (cost, rank) in forward(items, 0, len(items), p).items()]
    return Item(tuple(steps))


def roles(state: int, letters: str, initial: str) -> list[str | None]:
    """The role that each of ``letters`` gives to its turn: None where a turn keeps its own or goes."""
    found: list[str | None] = []
    for letter in letters:
        if letter in "IR":
            state = _NEXT[state]
            found.append(NAMES[state])
        else:
            state = _KEPT[state, initial] if letter == "K" else state
            found.append(None)
    return found
