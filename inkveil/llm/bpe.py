"""Byte-level BPE with the ``tokenizers`` library: exact encoding by reusable units of text, and decoding.

A space before a character that isn't white space always begins a new pre-token, whatever stands before or after it.
Text between two such spaces is therefore encoded alike wherever it occurs. Units are encoded by the library,
once for as long as they stay in the cache.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: Units kept by one Python worker.
CACHED_UNITS = 400_000
_GAP = re.compile(r" (?=\s|\Z)")
_loaded: dict[str, Encoder] = {}


def cut(text: str) -> list[str]:
    """The units of ``text``; their concatenation is ``text``."""
    pieces = text.split(" ")
    if not _GAP.search(text):
        return [pieces[0], *map(" ".__add__, pieces[1:])]
    units = [pieces[0]]
    for piece in pieces[1:]:
        if piece and not piece[0].isspace():
            units.append(" " + piece)
        else:
            units[-1] += " " + piece
    return units


def _byte_of_character() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies name bytes: printable Latin-1 stands for
    itself, the other bytes follow in order from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """One tokenizer file. Strings of added tokens in a text become those tokens, as the library does."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = {t: self._ids(t) for t in added}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        of = _byte_of_character()
        tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t in tokens]
        self.names = [str(i) for i in range(size)]
        self._spaced = np.array([b[:1] == b" " for b in self.bytes], dtype=bool)
        self._cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype).tobytes()

    def segments(self, text: str) -> list[str]:
        """``text`` cut at added tokens, which are the odd elements."""
        return self._split.split(text) if self._split else [text]

    def learn(self, units: set[str]) -> None:
        """Encode the units that aren't cached. Those with one leading space are encoded as one text, in
        which each token that begins with a space begins a unit."""
        missing = list(units.difference(self._cache))
        if len(self._cache) + len(missing) > CACHED_UNITS:
            self._cache.clear()
            missing = list(units)
        plain = [u for u in missing if u[:1] == " " and u.count(" ") == 1 and len(u) > 1 and not u[1].isspace()]
        for u in set(missing).difference(plain):
            self._cache[u] = self._ids(u)
        for at in range(0, len(plain), 2048):
            some = plain[at : at + 2048]
            ids = np.frombuffer(self._ids("".join(some)), dtype=self.dtype)
            starts = np.flatnonzero(self._spaced[ids])
            if len(starts) != len(some):
                raise AssertionError("units don't begin where the library begins them")
            ends = [*starts[1:], len(ids)]
            self._cache.update((u, ids[a:b].tobytes()) for u, a, b in zip(some, starts, ends, strict=True))

    def joined(self, units: list[str]) -> bytes:
        """Ids of learned units, as bytes of ``dtype``."""
        return b"".join(map(self._cache.__getitem__, units))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, equal to the library's."""
        cuts = [[cut(s) if i % 2 == 0 else s for i, s in enumerate(self.segments(t))] for t in texts]
        self.learn(set(chain.from_iterable(units for parts in cuts for units in parts[::2])))
        out = []
        for parts in cuts:
            ids = b"".join(self.joined(p) if i % 2 == 0 else self.added[p] for i, p in enumerate(parts))
            out.append(np.frombuffer(ids, dtype=self.dtype))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
