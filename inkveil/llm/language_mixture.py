"""Language identification: each text is a mixture of languages, fitted by expectation-maximisation.

A language is a distribution over hashed letter trigrams. A text's proportions maximise the likelihood of its
trigrams; the set of languages is the one with the best likelihood after a penalty for each further language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import fold, small_batches

BUCKETS = 1 << 14
ROUNDS = 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray:
    """The bucket of each letter with its two neighbours; anything else than a letter counts as one blank."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += code[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(50)).astype(np.int64)[letter[1:-1]]


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in order and their log probabilities, from ``labelled`` (text, lang); null languages are left out.

    Each task sends one row of fixed size per language that it has met.
    """
    small_batches(labelled.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                total += np.bincount(trigrams(text), minlength=BUCKETS)
        if totals:
            yield pd.DataFrame({"lang": list(totals), "counts": [t.tobytes() for t in totals.values()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in rows["counts"])
        return pd.DataFrame({"lang": rows["lang"][:1], "counts": [total.tobytes()]})

    parts = labelled.where("lang is not null").select("text", "lang").mapInPandas(count, "lang string, counts binary")
    rows = sorted(parts.groupBy("lang").applyInPandas(add, "lang string, counts binary").collect())  # one row a language
    counts = np.array([np.frombuffer(r["counts"], dtype=np.int64) for r in rows], dtype=float).reshape(-1, BUCKETS)
    background = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    smooth = counts + 200 * background
    return [r["lang"] for r in rows], np.log(smooth / smooth.sum(axis=1, keepdims=True))


def _mixture(counts: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of one text; like: languages x its trigrams."""
    share = np.full(len(like), 1 / len(like))
    total = counts.sum()
    for _ in range(ROUNDS):
        joint = share[:, None] * like
        mass = joint.sum(axis=0)
        share, before = joint @ (counts / mass) / total, share
        if np.abs(share - before).max() < 1e-4:
            break
    return share, float(counts @ np.log(share @ like))


def identify(text: str | None, names: list[str], logp: np.ndarray) -> tuple[str, float, dict[str, float]]:
    """The main language, its score, and the proportions of the selected languages."""
    found = trigrams(text)
    if not len(found) or not names:
        return "und", 0.0, {}
    dense = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(dense)
    counts, some = dense[at].astype(float), logp[:, at]
    alone = some @ counts
    best = int(alone.argmax())
    like = np.exp(some - some.max(axis=0))
    offset = float(counts @ some.max(axis=0))
    chosen, share, value = [best], np.ones(1), float(alone[best])
    if len(names) > 1:
        everything, most = _mixture(counts, like)
        penalty = 3 * np.log(1 + counts.sum())
        order = np.argsort(-everything, kind="stable")
        size = 2
        # no set of ``size`` languages can beat all of them, so larger sets are tried only while that would pay
        while size <= len(names) and most + offset - value > penalty:
            some_share, some_value = _mixture(counts, like[order[:size]])
            if some_value + offset - value > penalty * (size - len(chosen)):
                chosen, share, value = list(order[:size]), some_share, some_value + offset
            size += 1
    if len(chosen) == 1:
        score = float(1 / np.exp(alone - alone[best]).sum())
        return names[best], score, {names[best]: 1.0}
    top = int(share.argmax())
    return names[chosen[top]], float(share[top]), {names[c]: float(s) for c, s in zip(chosen, share, strict=True)}


def predict(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """``docs`` with lang_pred, score, languages (joined by commas) and their shares added.

    lang_pred is ``und`` with score 0 when the text is null or has no letter, or no language was learned. Ties
    go to the language that is first by name. Columns of ``docs`` with these names are replaced.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((names, logp))

    @F.pandas_udf("lang_pred string, score double, languages string, shares array<double>")
    def guess(texts: pd.Series) -> pd.DataFrame:
        rows = [identify(t, *model.value) for t in texts]
        rows = [(name, score, ",".join(found), list(found.values())) for name, score, found in rows]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "shares"])

    added = {"lang_pred", "score", "languages", "shares"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*kept, guess("text").alias("__guess")).select(*kept, "__guess.*")


def language_folds(docs: DataFrame, learn_not: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares: learned from all documents outside the held-out fold."""
    held_out = fold(F.col("doc_id"), folds) == learn_not
    names, logp = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), names, logp).drop("text")
