"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier.

Voters are a fixed lexicon, lexicons of words and word stems mined from labelled rows, and patterns of their use. The label
model is a tree-shaped generative model: each voter has its accuracy in either class and depends on the one
voter that it is most correlated with. Its parameters come from expectation-maximisation over the counts of vote
patterns. A logistic regression on the voters' evidence learns the posterior labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import fold, small_batches, written

#: Insults that need no mining.
SEED = (
    "asshole", "bastard", "bitch", "clown", "crap", "creep", "dimwit", "disgusting", "dumb", "fool", "freak", "garbage",
    "idiot", "imbecile", "jerk", "loser", "lunatic", "moron", "pathetic", "pig", "rat", "scum", "stupid", "trash",
    "ugly", "vermin", "worthless",
)
GROUPS = 3
STEMS = (4, 5, 6)
#: Most entries that are considered and mined, most labelled ids that are broadcast, most rows the classifier is fitted on.
CANDIDATES, ENTRIES, LABELS_BROADCAST, FIT_ROWS = 50_000, 2_000, 2_000_000, 20_000
#: How much more frequent an entry is among toxic documents than among clean ones.
LEAST_RATIO = 50
_WORD = re.compile(r"[^\W\d_]+")
VOTERS = ["seed", *(f"words{g}" for g in range(GROUPS)), *(f"stems{g}" for g in range(GROUPS)), "repeated", "dense"]
EVIDENCE = 1 + 2 * GROUPS


def _features(word: str) -> list[str]:
    """A word of letters, and its stems, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of labelled documents. A document with several labels counts by the largest."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= LABELS_BROADCAST:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id").select("text", "toxic")


def _toxic_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic documents, and a bit for each class of preceding words (copies repeat their contexts)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch["text"]:
                words, here = _WORD.findall((text or "").lower()), set()
                for before, word in zip(["", *words], words, strict=False):
                    bit = 1 << (crc32(before.encode("utf-8", "surrogatepass")) % 63)
                    for f in _features(word):
                        entry = found.setdefault(f, [0, 0])
                        entry[1] |= bit
                        if f not in here:
                            here.add(f)
                            entry[0] += 1
        if found:
            toxic, contexts = zip(*found.values(), strict=True)
            yield pd.DataFrame({"feature": list(found), "toxic": toxic, "contexts": contexts})

    parts = rows.where("toxic = 1").select("text").mapInPandas(count, "feature string, toxic long, contexts long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"))


def _clean_counts(rows: DataFrame, candidates: list[str]) -> dict[str, int]:
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        for batch in batches:
            for text in batch["text"]:
                here = {f for w in set(_WORD.findall((text or "").lower())) for f in _features(w)} & shared.value
                for f in here:
                    found[f] = found.get(f, 0) + 1
        if found:
            yield pd.DataFrame({"feature": list(found), "clean": list(found.values())})

    parts = rows.where("toxic = 0").select("text").mapInPandas(count, "feature string, clean long")
    return {r["feature"]: r["clean"] for r in parts.groupBy("feature").agg(F.sum("clean").alias("clean")).collect()}


def mine(rows: DataFrame) -> dict[str, int]:
    """Mined entries and the voter that each belongs to, from ``rows`` (text, toxic)."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = _toxic_counts(rows).where((F.col("toxic") >= max(4, n_toxic // 200)) & (F.bit_count("contexts") >= 4))
    top = counts.orderBy(F.desc("toxic"), "feature").limit(CANDIDATES).collect()
    clean = _clean_counts(rows, [r["feature"] for r in top])
    odds = {
        r["feature"]: np.log((r["toxic"] + 0.5) / (n_toxic + 1)) - np.log((clean.get(r["feature"], 0) + 0.5) / (n_clean + 1))
        for r in top
    }
    best = sorted((f for f in odds if odds[f] >= np.log(LEAST_RATIO)), key=lambda f: (-odds[f], f))[:ENTRIES]
    words, stems = [f for f in best if f[-1] != "-"], [f for f in best if f[-1] == "-"]
    return {f: 1 + i % GROUPS for i, f in enumerate(words)} | {f: 1 + GROUPS + i % GROUPS for i, f in enumerate(stems)}


def evidence(docs: DataFrame, entries: dict[str, int]) -> DataFrame:
    """``docs`` without text, plus n_words and hits, the words that hit each lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(entries)
    seed = frozenset(SEED)

    @F.pandas_udf("n_words long, hits array<long>")
    def hits(texts: pd.Series) -> pd.DataFrame:
        lexicon, known, out = shared.value, {}, []
        for text in texts:
            words, total = _WORD.findall((text or "").lower()), [0] * EVIDENCE
            for word in words:
                groups = known.get(word)
                if groups is None:
                    groups = known[word] = tuple({lexicon[f] for f in _features(word) if f in lexicon} | ({0} if word in seed else set()))
                for g in groups:
                    total[g] += 1
            out.append((len(words), total))
        return pd.DataFrame(out, columns=["n_words", "hits"])

    kept = [c for c in docs.columns if c not in ("text", "n_words", "hits")]
    return docs.select(*kept, hits("text").alias("__found")).select(*kept, "__found.*")


def votes(rows: DataFrame) -> DataFrame:
    """Adds ``votes``: one bit for each voter."""
    hits = [F.col("hits")[i] for i in range(EVIDENCE)]
    most = F.array_max("hits")
    fired = [*(h > 0 for h in hits), most >= 2, most * 100 >= F.greatest("n_words", F.lit(1))]
    return rows.withColumn("votes", sum((f.cast("int") * (1 << i) for i, f in enumerate(fired)), F.lit(0)))


@dataclass
class LabelModel:
    """Class prior, each voter's parent, and P(vote | parent's vote, class)."""

    prior: float
    parents: list[int]
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of 0/1 votes."""
        log = np.log([[1 - self.prior], [self.prior]]) + np.zeros((2, len(patterns)))
        for v, parent in enumerate(self.parents):
            above = patterns[:, parent] if parent >= 0 else np.zeros(len(patterns), dtype=int)
            for y in (0, 1):
                p = self.table[v, above, y]
                log[y] += np.log(np.where(patterns[:, v] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _tree(patterns: np.ndarray, weight: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Each voter's parent in the tree of largest mutual information given the class; roots have -1."""
    m = patterns.shape[1]
    info = np.zeros((m, m))
    for share in (weight * toxic, weight * (1 - toxic)):
        total = share.sum() + 1e-9
        for a in range(m):
            for b in range(a):
                for x in (0, 1):
                    for y in (0, 1):
                        both = share[(patterns[:, a] == x) & (patterns[:, b] == y)].sum() / total
                        apart = share[patterns[:, a] == x].sum() * share[patterns[:, b] == y].sum() / total**2
                        if both > 0:
                            info[a, b] += total * both * np.log(both / apart)
    info = np.maximum(info, info.T)
    parents, done = [-1] * m, {0}
    while len(done) < m:
        a, b = max(((a, b) for a in done for b in range(m) if b not in done), key=lambda p: (info[p], -p[0], -p[1]))
        parents[b] = a
        done.add(b)
    return parents


def fit_label_model(counts: pd.DataFrame, prior: float, rounds: int = 30) -> LabelModel:
    """From ``counts`` (votes, count): at most 2 ** voters rows. Half the rounds assume independent voters."""
    m = len(VOTERS)
    patterns = (counts["votes"].to_numpy()[:, None] >> np.arange(m)) & 1
    weight = counts["count"].to_numpy(float)
    model = LabelModel(prior, [-1] * m, np.tile(np.array([0.02, 0.6]), (m, 2, 1)))
    for step in range(rounds if len(weight) else 0):
        toxic = model.posterior(patterns)
        if step == rounds // 2:
            model.parents = _tree(patterns, weight, toxic)
        for v, parent in enumerate(model.parents):
            above = patterns[:, parent] if parent >= 0 else np.zeros(len(patterns), dtype=int)
            for y, share in enumerate((weight * (1 - toxic), weight * toxic)):
                whole = (share @ patterns[:, v] + (0.02, 0.6)[y]) / (share.sum() + 1)
                for x in (0, 1):
                    here = share * (above == x)
                    # towards the voter's rate over both votes of its parent
                    model.table[v, x, y] = np.clip((here @ patterns[:, v] + whole) / (here.sum() + 1), 1e-6, 1 - 1e-6)
    return model


def _inputs(n_words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    rate = hits / np.maximum(n_words, 1)[:, None]
    return np.hstack([np.ones((len(hits), 1)), hits > 0, np.minimum(np.log1p(hits), 3), np.minimum(rate * 20, 2)]).astype(float)


def fit_classifier(inputs: np.ndarray, soft: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps."""
    weights = np.zeros(inputs.shape[1])
    ridge = np.full(inputs.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        gradient = inputs.T @ (p - soft) + ridge * weights
        hessian = (inputs * (p * (1 - p) + 1e-6)[:, None]).T @ inputs + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, posterior of every row of ``docs`` (doc_id, text).

    Nothing is learned from labels of the held-out fold. Null and empty texts hold no evidence and get the score
    of that. Without any usable label only the fixed lexicon votes. Repeated rows stay and score alike. Other
    columns are ignored; labels of unknown documents and null labels are left out.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    known = _labelled(docs.where("not held_out"), labels.select("doc_id", "toxic"))
    sizes = known.agg(F.avg("toxic").alias("rate"), F.count("*").alias("n")).first()
    entries = mine(known) if sizes["n"] else {}
    prior = min(0.5, max(0.005, sizes["rate"] if sizes["n"] else 0.05))
    rows = written(votes(evidence(docs, entries)), "evidence")
    learned = rows.where("not held_out")
    model = fit_label_model(learned.groupBy("votes").count().orderBy("votes").toPandas(), prior)  # at most 512 rows

    # the sample: every vote pattern in proportion, by a hash of the evidence and the id
    sample = learned.orderBy(F.xxhash64("doc_id", "n_words"), "doc_id").limit(FIT_ROWS).select("n_words", "hits", "votes").toPandas()
    bits = np.arange(len(VOTERS))
    if len(sample):
        inputs = _inputs(sample["n_words"].to_numpy(), np.array(sample["hits"].tolist()))
        weights = fit_classifier(inputs, model.posterior((sample["votes"].to_numpy()[:, None] >> bits) & 1))
    else:
        weights = fit_classifier(np.eye(1 + 3 * EVIDENCE), np.array([0.0] + [1.0] * 3 * EVIDENCE))

    @F.pandas_udf("score double, posterior double")
    def scored(n_words: pd.Series, hits: pd.Series, found: pd.Series) -> pd.DataFrame:
        z = _inputs(n_words.to_numpy(), np.array(hits.tolist()).reshape(-1, EVIDENCE)) @ weights
        posterior = model.posterior((found.to_numpy()[:, None] >> bits) & 1)
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -500, 500))), "posterior": posterior})

    out = rows.select("doc_id", "held_out", scored("n_words", "hits", "votes").alias("s"))
    return out.select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.posterior"
    )
