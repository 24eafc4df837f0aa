"""Language-model scores from a weighted backoff automaton over all n-grams.

Discounted n-grams are states. A state has an arc for each continuation in the training texts and one failure arc to
the state of its longest proper suffix, weighted with what the discounts left over. No n-gram is pruned.

The automaton is never in one place. The words of all texts are dealt by the hash of the two words before them, so a
task has all arcs of its contexts and answers, for each text, those words that a trigram arc reads. Words that take
a failure arc go on as rows, and are joined with bigram arcs, backoff weights and unigrams. ``build`` makes the same
automaton in memory from given counts; tests compare both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import fold, small_batches, written
from inkveil.llm.shingles import mix, words

#: Words with this share of all training tokens, at most 1 / share, have their counts broadcast; others are joined.
SHARE = 1e-6
#: What is taken off each count of a bigram or trigram; words of one bucket; distinct bigrams that a task adds up.
DISCOUNT, _BUCKET, _TYPES = 0.75, 1 << 20, 1 << 21
END, START = -1, -2
_LOG10 = np.log(10)


def _streams(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text; no word has the hash END or START."""
    for at, end, hashes, first in words(texts):
        hashes = hashes.view(np.int64)
        for i in range(end - at):
            yield hashes[first[i] : first[i + 1]]


Counts = tuple[np.ndarray, np.ndarray]


def _counted(keys: np.ndarray) -> Counts:
    return np.unique(keys, return_counts=True)


def _merged(waiting: list[Counts], most: int) -> list[Counts]:
    """The counts, added up if they are ``most`` or more."""
    if len(waiting) < most or len(waiting) < 2:
        return waiting
    found, at = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
    return [(found, np.bincount(at, weights=np.concatenate([w[1] for w in waiting])).astype(np.int64))]


def _word_counts(train: DataFrame) -> DataFrame:
    """word, count over all training tokens; END counts once for each text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            streams = list(_streams(list(batch["text"])))
            waiting.append(_counted(np.concatenate([*streams, np.full(len(streams), END)])))
            waiting = _merged(waiting, 8)
        for found, n in _merged(waiting, 1):
            yield pd.DataFrame({"word": found, "count": n})

    parts = train.select("text").mapInPandas(count, "word long, count long")
    return written(parts.groupBy("word").agg(F.sum("count").alias("count")), "words")


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit names of pairs of words."""
    return mix(mix(left.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + right.view(np.uint64)).view(np.int64)


#: The context of the first word of a text; its arcs are the bigrams after START.
_FIRST = int(_pair(np.array([START]), np.array([START]))[0])


def _bigrams(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word before and word, of each word of each text and of its end."""
    before = np.concatenate([x for s in streams for x in ([START], s)] or [[]]).astype(np.int64)
    word = np.concatenate([x for s in streams for x in (s, [END])] or [[]]).astype(np.int64)
    return np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams]), before, word


def _bigram_counts(train: DataFrame) -> DataFrame:
    """low (name of the bigram), before, word, count over all training tokens."""

    def merged(waiting: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        low, before, word, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
        low, first, at = np.unique(low, return_index=True, return_inverse=True)
        return low, before[first], word[first], np.bincount(at, weights=n).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            _, before, word = _bigrams(list(_streams(list(batch["text"]))))
            waiting.append((_pair(before, word), before, word, np.ones(len(word), np.int64)))
            if sum(len(w[0]) for w in waiting) >= _TYPES:
                waiting = [merged(waiting)]
                if len(waiting[0][0]) >= _TYPES // 2:
                    yield pd.DataFrame(dict(zip(("low", "before", "word", "count"), waiting.pop(), strict=True)))
        if waiting:
            yield pd.DataFrame(dict(zip(("low", "before", "word", "count"), merged(waiting), strict=True)))

    parts = train.select("text").mapInPandas(count, "low long, before long, word long, count long")
    return written(parts.groupBy("low", "before", "word").agg(F.sum("count").alias("count")), "bigrams")


@dataclass
class Automaton:
    """States by number; state 0 is the empty context. Arcs are keyed by (state << 20 | word number)."""

    numbers: dict[int, int]
    arcs: dict[int, int]
    weights: list[float]
    targets: list[int]
    failure: list[int]
    backoff: list[float]
    start: int

    def read(self, stream: np.ndarray) -> tuple[float, list[int]]:
        """Log probability of the words and the end, without the unigram terms of the words that are returned."""
        state, total, rare = self.start, 0.0, []
        numbers, arcs, failure, backoff = self.numbers, self.arcs, self.failure, self.backoff
        for word in [*stream.tolist(), END]:
            number = numbers.get(word)
            if number is None:
                while state:
                    total += backoff[state]
                    state = failure[state]
                rare.append(word)
                continue
            arc = arcs.get(state << 20 | number)
            while arc is None:
                total += backoff[state]
                state = failure[state]
                arc = arcs.get(state << 20 | number)
            total += self.weights[arc]
            state = self.targets[arc]
        return total, rare


@dataclass
class Unigrams:
    """Absolutely discounted unigrams; unseen words share one type."""

    tokens: int
    types: int
    discount: float

    def log(self, count: np.ndarray) -> np.ndarray:
        unseen = self.discount * self.types / max(self.tokens, 1)
        return np.log(np.where(count > 0, (count - self.discount) / max(self.tokens, 1), max(unseen, 1e-300)))


def build(frequent: np.ndarray, counts: np.ndarray, grams: pd.DataFrame, unigrams: Unigrams, d: float = DISCOUNT) -> Automaton:
    """``frequent``: END, START, and words by falling count; ``grams``: gram (word numbers in base 2**20, plus 2**62 for three) and count."""
    own = unigrams.log(counts)
    numbers = {int(w): i for i, w in enumerate(frequent) if w != START and counts[i] > 0}
    base = {i: own[i] for i in numbers.values()}
    state_of, failure, backoff = {(): 0}, [0], [0.0]
    arcs, weights, goals = {}, [], []
    known: dict[tuple, float] = {(i,): p for i, p in base.items()}
    all_counts: dict[tuple, int] = {(i,): int(c) for i, c in enumerate(counts)}

    def arc(context: tuple, number: int, p: float) -> None:
        arcs[state_of[context] << 20 | number] = len(weights)
        weights.append(p)
        goals.append((*context, number))

    for i, p in base.items():
        arc((), i, p)
    by_order: dict[int, dict[tuple, list[tuple[int, int]]]] = {2: {}, 3: {}}
    for gram, n in zip(grams["gram"].tolist(), grams["count"].tolist(), strict=True):
        a, b, c = gram >> 40 & 0xFFFFF, gram >> 20 & 0xFFFFF, gram & 0xFFFFF
        context = (a, b) if gram >> 62 else (b,)
        all_counts[(*context, c)] = n
        by_order[len(context) + 1].setdefault(context, []).append((c, n))

    def lower(context: tuple, number: int) -> float:
        """Log probability after the longest proper suffix of ``context``."""
        total = 0.0
        suffix = context[1:]
        while True:
            p = known.get((*suffix, number))
            if p is not None:
                return total + p
            total += backoff[state_of[suffix]] if suffix in state_of else 0.0
            suffix = suffix[1:]

    for order in (2, 3):
        for context in sorted(by_order[order]):
            seen = all_counts.get(context)
            if not seen or (order == 3 and context[1:] not in state_of):
                continue
            followers = by_order[order][context]
            state_of[context] = len(failure)
            failure.append(state_of[context[1:]])
            kept = sum(n - d for _, n in followers) / seen
            covered = sum(np.exp(lower(context, c)) for c, _ in followers)
            backoff.append(float(np.log(max(1 - kept, 1e-9) / max(1 - covered, 1e-9))))
            for c, n in followers:
                known[(*context, c)] = float(np.log((n - d) / seen))
                arc(context, c, known[(*context, c)])

    def state(words_read: tuple) -> int:
        while words_read not in state_of:
            words_read = words_read[1:]
        return state_of[words_read]

    targets = [state(g[-2:]) for g in goals]
    return Automaton(numbers, arcs, weights, targets, failure, backoff, state_of.get((1,), 0))


_META = "doc_id long, held_out boolean, n_tokens long, frequent long, base double, rare array<long>, times array<long>"
_DEALT = f"batch long, bucket long, contexts binary, lows binary, places binary, pairs binary, held binary, text int, {_META}"
_SETTLED = f"batch long, text int, total double, ctx long, low long, before long, word long, left double, {_META}"


def _typed(rows: pd.DataFrame, schema: str) -> pd.DataFrame:
    """The columns of ``schema``; integers with nulls would become floating point and lose digits."""
    kinds = {"long": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean"}
    fields = dict(x.split() for x in schema.split(", "))
    rows = rows.reindex(columns=list(fields))
    rows = rows.astype({c: kinds.get(kind, object) for c, kind in fields.items()})
    for c, kind in fields.items():
        if kind not in kinds:
            rows[c] = rows[c].where(rows[c].notna(), None)
    return rows


def _settled(batch: np.ndarray, text: np.ndarray, held: np.ndarray, ctx: np.ndarray, low: np.ndarray, pairs: np.ndarray) -> Iterator[pd.DataFrame]:
    """What a bucket knows: total of each text over trigram arcs; words that take a failure arc; arcs of the contexts they leave.

    ``pairs``: the bigrams (before, word) of the words of held-out texts.
    """
    order = np.lexsort((low, ctx))
    new_ctx = np.concatenate(([True], np.diff(ctx[order]) != 0))
    new_gram = new_ctx | np.concatenate(([True], np.diff(low[order]) != 0))
    gram, context = np.empty(len(order), np.int64), np.cumsum(new_ctx)[new_gram] - 1
    gram[order] = np.cumsum(new_gram) - 1
    n = np.bincount(gram[~held], minlength=len(context))
    seen = np.bincount(context, weights=n)
    arcs = np.bincount(context, weights=n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(n > 0, np.log((n - DISCOUNT) / seen[context]), 0.0)
    of, at = _texts(batch, text)
    yield pd.DataFrame({"batch": of[0], "text": of[1], "total": np.bincount(at, weights=p[gram])})
    missed = n[gram] == 0
    leaves = (seen[context[gram[missed]]] > 0) & (ctx[missed] != _FIRST)
    name = pd.array(ctx[missed], dtype="Int64")
    name[~leaves] = pd.NA
    found = pairs[missed[held]]
    yield pd.DataFrame({
        "batch": batch[missed], "text": text[missed], "ctx": name, "low": low[missed], "before": found[:, 0], "word": found[:, 1],
    })
    left = np.zeros(len(seen), dtype=bool)
    left[context[gram[missed]][leaves]] = True
    kept = np.flatnonzero(left[context] & (n > 0))
    one = order[new_gram][kept]
    c = context[kept]
    yield pd.DataFrame({"ctx": ctx[one], "low": low[one], "left": DISCOUNT * arcs[c] / seen[c]})


def _texts(batch: np.ndarray, text: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct (batch, text), and the number of each row's."""
    batches, b = np.unique(batch, return_inverse=True)
    keys, at = np.unique(b << 16 | text, return_inverse=True)
    return (batches[keys >> 16], keys & 0xFFFF), at


def score(docs: DataFrame, held_out: int = 1, folds: int = 5, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Learned from all texts outside the held-out fold. Null texts are empty and have the end as their only token.
    Without training texts every token is unseen; probabilities are then 1, as there is one type only. Repeated
    rows are scored each for itself. Other columns are ignored. Scores are log10 probabilities. ``share`` moves work
    between broadcast and join and changes no score.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    train = docs.where("not held_out")
    counts = _word_counts(train)
    n, types, once, twice, texts = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2),
        F.coalesce(F.sum(F.when(F.col("word") == END, F.col("count"))), F.lit(0)),
    ).first()
    unigrams = Unigrams(n, types, once / (once + 2 * twice) if once and twice else 0.5)
    least = max(2, int(np.ceil(share * n)))
    is_often = (F.col("count") >= least) | (F.col("word") == END)
    often = counts.where(is_often).toPandas()  # at most 1 / share
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(often["word"].tolist(), often["count"].tolist(), strict=True)))
    scale = n + 0.5 * (types + 1)
    buckets = -(-n // _BUCKET) + 8

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base_of = {w: float(np.log((c + 0.5) / scale)) for w, c in shared.value.items()}
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches, task):
            streams = list(_streams(list(batch["text"])))
            out = []
            for stream in streams:
                seen = Counter(stream.tolist())
                rare = {w: t for w, t in seen.items() if w not in base_of}
                base = base_of.get(END, 0.0) + sum(base_of[w] * t for w, t in seen.items() if w in base_of)
                known = len(stream) + 1 - sum(rare.values())
                out.append((len(stream) + 1, known, base, list(rare), list(rare.values())))
            found = pd.DataFrame(out, columns=["n_tokens", "frequent", "base", "rare", "times"])
            meta = pd.concat([batch[["doc_id", "held_out"]].reset_index(drop=True), found], axis=1)
            meta["doc_id"] = meta["doc_id"].astype("Int64")
            place, before, word = _bigrams(streams)
            low = _pair(before, word)
            first = before == START
            ctx = np.where(first, _FIRST, np.concatenate(([0], low[:-1])))
            held = batch["held_out"].to_numpy(bool)[place]
            bucket = (mix(ctx.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = [
                (int(bucket[i[0]]), ctx[i].tobytes(), low[i].tobytes(), place[i].astype(np.uint16).tobytes(),
                 np.stack([before[i], word[i]], axis=1)[held[i]].tobytes(), np.packbits(held[i]).tobytes())
                for i in np.split(order, ends) if len(i)
            ]
            dealt = pd.DataFrame(rows, columns=["bucket", "contexts", "lows", "places", "pairs", "held"])
            # texts go along with their batch, negative buckets
            both = pd.concat([dealt, meta.assign(bucket=-1 - number % buckets, text=np.arange(len(meta)))], ignore_index=True)
            both["batch"] = number
            yield _typed(both, _DEALT)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        for batch in batches:
            meta = batch["bucket"] < 0
            if meta.any():
                yield _typed(batch[meta], _SETTLED)
            for row in batch.loc[~meta, ["bucket", "batch", "contexts", "lows", "places", "pairs", "held"]].itertuples(index=False):
                if waiting and waiting[0][0] != row.bucket:
                    yield from answered(waiting)
                    waiting = []
                waiting.append(tuple(row))
        if waiting:
            yield from answered(waiting)

    def answered(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        sizes = [len(r[4]) // 2 for r in rows]
        ctx, low, text = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in ((2, np.int64), (3, np.int64), (4, np.uint16)))
        pairs = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(-1, 2)
        held = np.concatenate([np.unpackbits(np.frombuffer(r[6], np.uint8), count=k) for r, k in zip(rows, sizes, strict=True)]).astype(bool)
        for part in _settled(np.repeat([r[1] for r in rows], sizes), text.astype(np.int64), held, ctx, low, pairs):
            for at in range(0, len(part), 1 << 16):
                yield _typed(part.iloc[at : at + (1 << 16)], _SETTLED)

    dealt = docs.mapInPandas(deal, _DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    settled = written(dealt.mapInPandas(settle, _SETTLED), "settled")
    rows = settled.where("n_tokens is not null").select("batch", "text", *[x.split()[0] for x in _META.split(", ")])
    bigrams = _bigram_counts(train)
    start = docs.sparkSession.createDataFrame([(START, texts)], "word long, count long")
    before = counts.unionByName(start).select(F.col("word").alias("before"), F.col("count").alias("before_count"))
    arcs = bigrams.join(before, "before").select("low", "before", "word", ((F.col("count") - DISCOUNT) / F.col("before_count")).alias("p"))
    own = (F.col("count") - unigrams.discount) / max(n, 1)
    rest = lambda left, covered: F.log(F.greatest(left, F.lit(1e-9)) / F.greatest(1 - covered, F.lit(1e-9)))
    of_words = (
        arcs.join(counts, "word").groupBy("before")
        .agg(rest(1 - F.sum("p"), F.sum(own)).alias("word_backoff"))
    )
    of_pairs = (
        settled.where("left is not null").select("ctx", "low", "left").join(arcs.select("low", "p"), "low")
        .groupBy("ctx").agg(rest(F.first("left"), F.sum("p")).alias("pair_backoff"))
    )
    failed = settled.where("batch is not null and low is not null").select("batch", "text", "ctx", "low", "before", "word")
    unseen = max(unigrams.discount * types / max(n, 1), 1e-300) if n else 1.0
    down = (
        failed.join(of_pairs, "ctx", "left").join(arcs.select("low", "p"), "low", "left")
        .select("batch", "text", "before", "word", "p", F.coalesce("pair_backoff", F.lit(0.0)).alias("pair_backoff"))
    )
    down = written(down, "failed")
    zero = F.lit(0.0)
    ended = down.where("p is not null").select("batch", "text", (F.col("pair_backoff") + F.log("p")).alias("total"))
    lowest = down.where("p is null").join(of_words, "before", "left").join(counts, "word", "left").select(
        "batch", "text",
        (F.col("pair_backoff") + F.coalesce("word_backoff", zero) + F.log(F.coalesce(own, F.lit(unseen)))).alias("total"),
    )
    totals = settled.where("total is not null").select("batch", "text", "total").unionByName(ended).unionByName(lowest)
    totals = totals.groupBy("batch", "text").agg(F.sum("total").alias("total"))
    rare = rows.select("batch", "text", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("batch", "text", "r.rare", "r.times")
    table = counts.where(~is_often).select(F.col("word").alias("rare"), "count")
    seen = F.coalesce("count", F.lit(0))
    more = (
        rare.join(table, "rare", "left")
        .groupBy("batch", "text").agg(
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log((seen + 0.5) / F.lit(float(scale)))).alias("more_base"),
        )
    )
    joined = rows.drop("rare", "times").join(totals, ["batch", "text"], "left").join(more, ["batch", "text"], "left")
    joined = joined.fillna(0, ["more_known", "more_base", "total"])
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("frequent") + F.col("more_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        ((F.col("base") + F.col("more_base")) / _LOG10).alias("base_score"), (F.col("total") / _LOG10).alias("score"),
    )
