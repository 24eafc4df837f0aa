"""Licence scans: passages compared with licence templates by Dice coefficient over word bigrams.

Passages are single lines and paragraphs (lines up to an empty one). A template is compared with a passage only
if their numbers of bigrams allow the least coefficient, and if they share a bigram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from inkveil.llm.common import small_batches

#: Notices by which works are put under a licence, and short licence texts.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
}
LEAST = 0.8
_WORD = re.compile(r"[^\W_]+")
Bigrams = frozenset[tuple[str, str]]


def bigrams(passage: str) -> Bigrams:
    """Pairs of neighbouring words, in lower case and without punctuation."""
    words = _WORD.findall(passage.lower())
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least = least
        self.templates = [(name, bigrams(text)) for name, texts in templates.items() for text in texts]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, pairs) in enumerate(self.templates):
            for pair in pairs:
                self.holders.setdefault(pair, []).append(i)
        sizes = [len(pairs) for _, pairs in self.templates]
        ratio = least / (2 - least)
        self.bounds = [(n * ratio, n / ratio) for n in sizes]

    def compare(self, passage: str) -> dict[str, float]:
        """The best coefficient of each licence that reaches the least one."""
        pairs = bigrams(passage)
        if not pairs:
            return {}
        shared: dict[int, int] = {}
        for pair in pairs.intersection(self.holders):
            for i in self.holders[pair]:
                low, high = self.bounds[i]
                if low <= len(pairs) <= high:
                    shared[i] = shared.get(i, 0) + 1
        found: dict[str, float] = {}
        for i, n in shared.items():
            name, template = self.templates[i]
            dice = 2 * n / (len(pairs) + len(template))
            if dice >= self.least:
                found[name] = max(dice, found.get(name, 0.0))
        return found

    def scan(self, text: str | None) -> dict[str, tuple[float, int, int]]:
        """Per licence: coefficient, first line and number of lines of its best passage, the earliest and shortest among equals."""
        best: dict[str, tuple[float, int, int]] = {}
        lines = (text or "").split("\n")
        paragraph = 0
        for i, line in enumerate([*lines, ""]):
            units = [(i, 1)] if line.strip() else []
            if not line.strip():
                if i - paragraph > 1:
                    units.append((paragraph, i - paragraph))
                paragraph = i + 1
            for at, n in units:
                for name, dice in self.compare("\n".join(lines[at : at + n])).items():
                    key = (-dice, at, n)
                    if name not in best or key < (-best[name][0], *best[name][1:]):
                        best[name] = (dice, at, n)
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, line, n_lines: one row for each licence found in each row of ``docs`` (doc_id, text).

    Null and empty texts have none. Repeated rows and null ids stay. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = [
                (doc_id, name, *found)
                for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True)
                for name, found in sorted(scanner.scan(text).items())
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "dice", "line", "n_lines"]).astype(
                {"doc_id": "Int64", "dice": float, "line": "int64", "n_lines": "int64"}
            )

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, license string, dice double, line long, n_lines long")
