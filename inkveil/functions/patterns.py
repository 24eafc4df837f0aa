"""Turning dictionary keys into one ordered, boundary-guarded pattern.

Every key is matched case-insensitively, the longest key first, and a key edge that is alphanumeric
must not touch another ASCII letter or digit.  A flat alternation costs one comparison per key at
every word start; the pattern built here shares common prefixes instead, so its cost follows the
length of the text and not the number of keys.

Keys that can match at one position are prefixes of each other, so trying the longer continuation
before the shorter ending picks the same key as a longest-first alternation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

# ASCII letters and digits, with the four letters that case-insensitive matching folds into them.
# The POSIX name keeps the class small: one is stored per key, and a listed range costs 256 bytes.
WORD_CLASS = r"[\p{Alnum}İıſK]"
NOT_AFTER_WORD = f"(?-i:(?<!{WORD_CLASS}))"
NOT_BEFORE_WORD = f"(?-i:(?!{WORD_CLASS}))"


# Forks that a pattern may nest; keys that are prefixes of each other many times over go deeper.
MAX_FORKS = 300


class PatternTooDeepError(ValueError):
    """The keys share too many nested prefixes for one pattern."""


def fold(text: str) -> str:
    """Fold each character the way case-insensitive matching compares it; length never changes."""
    return "".join(_fold_char(c) for c in text)


def _fold_char(char: str) -> str:
    if char == "İ":
        return "i"
    upper = char.upper()
    upper = upper if len(upper) == 1 else char
    lower = upper.lower()
    return lower if len(lower) == 1 else upper


def is_alnum(char: str) -> bool:
    return unicodedata.category(char)[0] in "LN"


def escape(text: str) -> str:
    """Escape ASCII punctuation and blanks; a backslash before those is always literal."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def combined_pattern(keys: Iterable[str]) -> str | None:
    """One pattern for all keys, or None when there is no key to match."""
    guarded: dict = {}
    free: dict = {}
    for key in keys:
        if not key:
            raise ValueError("a dictionary key must not be empty")
        _insert(guarded if is_alnum(key[0]) else free, fold(key))
    branches = []
    if guarded:
        branches.append(_first_letters(guarded) + NOT_AFTER_WORD + _render(guarded))
    if free:
        branches.append(_render(free))
    return "(?iu)(?:" + "|".join(branches) + ")" if branches else None


_END = ""


def _first_letters(root: dict) -> str:
    """A cheap test of the next character, so that most places of a text are left at once."""
    firsts = set(root)
    if not all(c.isascii() for c in firsts):
        return ""
    both = {*firsts, *(c.upper() for c in firsts)}
    wide = "".join(w for w, c in (("İı", "i"), ("ſ", "s"), ("K", "k")) if c in firsts)
    return f"(?-iu:(?=[{''.join(sorted(both))}{wide}]))"


def first_letter(key: str) -> str:
    """The same test for a single key, empty if the key does not begin with an ASCII letter or digit."""
    return _first_letters({fold(key[0]): None}) if key and is_alnum(key[0]) else ""


def _insert(root: dict, key: str) -> None:
    node = root
    for char in key:
        node = node.setdefault(char, {})
    node[_END] = NOT_BEFORE_WORD if is_alnum(key[-1]) else ""


def _render(node: dict, forks: int = 0) -> str:
    """Render a prefix tree: single-child chains become plain text, forks become groups."""
    if forks > MAX_FORKS:
        raise PatternTooDeepError(f"more than {MAX_FORKS} nested prefixes")
    branches = []
    for char in sorted(k for k in node if k != _END):
        text, child = char, node[char]
        while len(child) == 1 and _END not in child:
            ((step, child),) = child.items()
            text += step
        branches.append(escape(text) + _render(child, forks + 1))
    if _END in node:
        branches.append(node[_END])
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
