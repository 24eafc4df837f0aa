"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables,
and extra columns with clashing names."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkveil.llm import backoff_lm, bpe, chunked_bpe, jaccard_join, language_mixture, licenses, maxscore, packing, sequences, toxicity, winnowing
from inkveil.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, node long, score double, entry string, run int"
COPY = " ".join(f"word{i} other{i * 7 % 50}" for i in range(120))
TEXTS = [
    None, "", "   \n\t ", "one", "one", "Two words", "the cat sat on the mat", COPY, COPY, COPY.replace("word60", "changed"),
    COPY.replace("word60", "changed").replace("word10", "edited"), "x " * 3000, "你好 世界 <|endoftext|> ok", "LICENSED under the MIT License.\nText",
    "a\n\nb  c d 'll've", "Ärger über Größe und Straße",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, i, 0.5, "e", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "without id", "en", 1, 0.1, "e", 1), (3, "one", "en", 1, 0.1, "e", 1), (3, "one", "en", 1, 0.1, "e", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def grouped(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[a] < least[b]:
                    least[b], changed = least[a], True
                elif sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return sets, least


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs, k, percent):
    rows = jaccard_join.near_duplicates(docs, k, percent).collect()
    assert len(rows) == docs.count()
    sets, least = grouped(dict(enumerate(TEXTS)), k, percent)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), least[r["doc_id"]])


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_near_duplicates_of_mixed_texts(spark, frequent):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 30)) for _ in range(6)]
    texts = {}
    for i in range(70):
        words = f"{base[i % 6]} {base[(i // 6) % 6]}".split()
        for at in rng.integers(0, len(words), i % 4):
            words[at] = f"v{rng.integers(0, 50)}"
        texts[i] = " ".join(words[: len(words) - int(rng.integers(0, 4))])
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80, frequent).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == grouped(texts, 4, 80)[1]


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    bitmap = rng.integers(-(2**63), 2**63 - 1, jaccard_join.CLASSES >> 6, dtype=np.int64)
    for n in [2, 3, 5, 8, 20, 60, 150]:
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.08], rng.integers(0, 2**63, n // 12, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                for often in (None, bitmap, np.full_like(bitmap, -1)):
                    (a, c), (b, d) = (jaccard_join._entries(s, often, 80) for s in (x, y))
                    assert len(np.intersect1d(a, b)) or len(np.intersect1d(c, d))
                    assert len(a) + len(c) <= len(x) + 8
                    assert jaccard_join._may_link(jaccard_join._summary(x), jaccard_join._summary(y), len(x) + len(y), 80)


def test_components_follow_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.1, (300, 8)))]
    data += [(300 + i, data[20][1]) for i in range(30)]
    bad = [(900, None), (901, [1.0, None] * 4), (902, [math.nan] * 8), (903, [math.inf] * 8), (None, [0.1] * 8)]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    rows = maxscore.top_k(maxscore.quantised(frame), F.col("id") % 20 == 0, 20).collect()
    vectors = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in data}
    want = set()
    for q in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:20], 1)}
    assert {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in rows} == want
    assert maxscore.top_k(maxscore.quantised(frame.where("vec_id = 20 or vec_id = 21")), F.col("id") == 20, 20).count() == 1
    assert maxscore.top_k(maxscore.quantised(frame.where("false")), F.col("id") == 20, 20).count() == 0


def test_toxicity_finds_mined_stems(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words = [f"{chr(97 + x % 26)}{chr(97 + x // 26)}word" for x in rng.integers(0, 600, 40)]
        toxic = i % 8 == 0
        if toxic:
            words[5], words[20] = f"zzkrat{chr(97 + i % 20)}x", "idiot" if i % 16 else f"zzkrat{chr(97 + i % 11)}q"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    labels += [(1002, 1), (None, 1), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0))
    out = {r["doc_id"]: r for r in toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(out) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert sum(out[i]["predicted"] == (i % 8 == 0) for i in range(400)) >= 396
    assert out[1000]["predicted"] == out[1001]["predicted"] == 0


def test_language_mixture(spark, docs):
    english, german = "the of and to in is that it was for ", "der die und das nicht ist von mit auf "
    rows = [(i, (english if i % 2 else german) * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)] + [(99, english * 6 + german * 6, None)]
    out = {r["doc_id"]: r for r in language_mixture.language_folds(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60)) and set(out[99]["languages"].split(",")) == {"en", "de"}
    odd = {r["doc_id"]: r for r in language_mixture.language_folds(docs.where("doc_id is not null and doc_id <> 3")).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (0, 1, 2))


def test_backoff_scores(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    out = backoff_lm.score(docs).where("doc_id is not null").collect()
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in texts.items()}
    all_rows = [r["doc_id"] for r in docs.collect()]
    counts = Counter()
    for i in all_rows:
        if crc32(str("" if i is None else i).encode()) % 5 != 1:
            counts.update(tokens[i] if i is not None else ["without", "id", None])
    n, v = sum(counts.values()), len(counts)
    for r in out:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] <= 0


def test_backoff_probabilities_sum_to_one():
    frequent = np.array([backoff_lm.END, backoff_lm.START, 11, 12, 13])
    counts = np.array([10, 10, 30, 20, 5])
    unigrams = backoff_lm.Unigrams(65, 4, 0.5)
    grams = pd.DataFrame({"gram": [1 << 20 | 2, 2 << 20 | 3, 3 << 20 | 0, 1 << 62 | 1 << 40 | 2 << 20 | 3], "count": [8, 15, 9, 6]})
    model = backoff_lm.build(frequent, counts, grams, unigrams)

    def log_p(state, number):
        total = 0.0
        while (state << 20 | number) not in model.arcs:
            total, state = total + model.backoff[state], model.failure[state]
        return total + model.weights[model.arcs[state << 20 | number]]

    for state in range(len(model.failure)):
        at, unseen = state, 0.0
        while at:
            unseen, at = unseen + model.backoff[at], model.failure[at]
        total = sum(math.exp(log_p(state, w)) for w in (0, 2, 3, 4)) + math.exp(unseen) * unigrams.discount * 4 / 65
        assert total == pytest.approx(1)


def test_encoders_equal_the_library(docs):
    base = bpe.Encoder(PATH)
    rng = np.random.default_rng(7)
    parts = ["a", "The", " ", "  ", "\n", "'s", "'", "ré", "12", "!", "<|endoftext|>", "漢", "😀", " x", "\x1c", "\x85", " \n"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(800)]
    chunked = chunked_bpe.ChunkEncoder(base, 3)
    for text, plain, joined in zip(texts, base.encode(texts), chunked.encode(texts), strict=True):
        want = base.library.encode(text, add_special_tokens=False).ids
        assert want == plain.tolist() == joined.tolist()
        assert base.decode(want) == base.library.decode(want, skip_special_tokens=False)
    assert chunked.reused


def test_chunked_rows_and_sequences(docs, empty):
    base = bpe.Encoder(PATH)
    for r in chunked_bpe.digests(docs.where("doc_id is not null and doc_id <> 3"), PATH).collect():
        ids = base.library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
    rows = sorted(sequences.sequences(docs, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 3, 3, *range(4, len(TEXTS))]
    at = 0
    for r in rows:
        text = "without id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = [*base.library.encode(text, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sequences.sequences(empty, PATH).count() == 0
    decoded = {r["doc_id"]: r["decoded"] for r in chunked_bpe.encode_decode(docs.where("doc_id is not null"), PATH).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(TEXTS)}


def test_winnowing(docs):
    rows = winnowing.fingerprints(docs.where("doc_id is not null and doc_id <> 3")).collect()
    ids = [i for i in range(len(TEXTS)) if i != 3]
    order = sorted(ids, reverse=True)
    prints = {}
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        follower = TEXTS[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        marks = [tuple(x.split(":")) for x in r["fingerprint"].split()]
        n = max(0, len(text.split()) - winnowing.K + 1)
        gaps = np.diff([-1, *[int(p) for _, p in marks], n]) if marks else [0]
        assert max(gaps) <= winnowing.W
    assert {r["doc_id"]: r["near_next"] for r in rows}[8] == 1.0
    assert winnowing.fingerprints(docs).count() == docs.count()


def test_licenses(docs):
    found = licenses.scan_licenses(docs).collect()
    assert [(r["doc_id"], r["license"], r["dice"], r["line"], r["n_lines"]) for r in found] == [(13, "MIT", 1.0, 0, 1)]
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.6)
    for line in ("Licensed under the Apache License, Version 3", "licensed under CC BY-NC 4.0", "nothing here at all", ""):
        pairs, want = licenses.bigrams(line), {}
        for name, texts in licenses.TEMPLATES.items():
            for text in texts:
                dice = 2 * len(pairs & licenses.bigrams(text)) / max(1, len(pairs) + len(licenses.bigrams(text)))
                if dice >= 0.6:
                    want[name] = max(dice, want.get(name, 0))
        assert scanner.compare(line) == want


def test_packing(docs):
    lengths = [int(x) for x in np.random.default_rng(4).integers(1, 4097, 500)]
    placed = packing.pack(lengths)
    bins = {}
    for n, (b, size, offset) in zip(lengths, placed, strict=True):
        bins.setdefault((b, size), []).append((offset, n))
    for (_, size), items in bins.items():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and items[0][0] == 0
        used = sum(n for _, n in items)
        assert size == min(c for c in packing.CAPACITIES if c >= used)
    assert sum(lengths) / sum(size for _, size in bins) > 0.9
    rows = packing.best_fit(docs.select("doc_id", packing.word_count().alias("n_tokens")).withColumn("bin", F.lit(1))).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in [*TEXTS, "without id", "one", "one"]]
    assert sum(r["length"] for r in rows) == sum(words) + len(words)


@pytest.mark.parametrize("run", [
    lambda e: jaccard_join.near_duplicates(e), lambda e: toxicity.toxicity(e, e.select("doc_id", F.lit(1).alias("toxic"))),
    lambda e: language_mixture.language_folds(e), lambda e: backoff_lm.score(e), lambda e: winnowing.fingerprints(e),
    lambda e: licenses.scan_licenses(e), lambda e: chunked_bpe.digests(e, PATH), lambda e: chunked_bpe.encode_decode(e, PATH),
    lambda e: packing.best_fit(e.select("doc_id", packing.word_count().alias("n_tokens"))),
])
def test_empty_tables_give_no_rows(empty, run):
    assert run(empty).count() == 0


def test_other_columns_do_not_disturb(docs):
    assert toxicity.toxicity(docs, docs.select("doc_id", F.lit(0).alias("toxic"))).count() == docs.count()
    assert licenses.scan_licenses(docs.withColumn("license", F.lit("x"))).count() == 1


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    words = "the of and to in is that it was for with as his on be at by had not are but from or have an they which".split()
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(words, 60)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "12345 !!!", "en", "s", 0), (102, None, None, None, None), (103, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in got}) == list(range(40))


def test_backoff_reads_every_ngram(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(40)] + ["rare pair of words once", "rare pair of words twice new"]
    held = [crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    out = {r["doc_id"]: r["score"] for r in backoff_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    streams = list(backoff_lm._streams(texts))
    train = [s.tolist() for s, h in zip(streams, held, strict=True) if not h]
    counts = Counter(w for s in train for w in [*s, backoff_lm.END])
    frequent = [backoff_lm.END, backoff_lm.START, *(w for w in counts if w != backoff_lm.END)]
    number = {w: i for i, w in enumerate(frequent)}
    grams = Counter()
    for s in train:
        at = [number[w] for w in [backoff_lm.START, *s, backoff_lm.END]]
        grams.update(a << 20 | b for a, b in zip(at, at[1:], strict=False))
        grams.update(1 << 62 | a << 40 | b << 20 | c for a, b, c in zip(at, at[1:], at[2:], strict=False))
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    unigrams = backoff_lm.Unigrams(sum(counts.values()), len(counts), once / (once + 2 * twice) if once and twice else 0.5)
    tally = np.array([len(train), len(train), *(counts[w] for w in frequent[2:])])
    model = backoff_lm.build(np.array(frequent), tally, pd.DataFrame({"gram": list(grams), "count": list(grams.values())}), unigrams)
    unseen = float(unigrams.log(np.array([0]))[0])
    for i, stream in enumerate(streams):
        total, rare = model.read(stream)
        assert out[i] == pytest.approx((total + unseen * len(rare)) / math.log(10)), i


def test_top_k_counts_every_row_and_any_size(spark):
    rng = np.random.default_rng(5)
    data = [(i % 50, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(0, 1, (120, 4)))]
    data += [(60, [0.5, 0.25, -1.0, 2.0])] * 3 + [(61, [float(1 << 24), 0.0, -float(1 << 22), 1.0]), (62, [-float(1 << 25), 3.0, 0.0, 0.5]), (80, [float(1 << 23)] * 4)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = maxscore.top_k(maxscore.quantised(frame), F.col("id") % 20 == 0, 20).collect()
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in data]
    want = []
    for q in {i for i, _ in vectors if i % 20 == 0}:
        pairs = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in vectors if i == q for j, y in vectors if j != q]
        want += [(q, n, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:20], 1)]
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_shards_hold_numbers_beyond_64_bits():
    vectors = np.array([[-(1 << 63), 1], [(1 << 62), -(1 << 62)], [3, 4]])
    shard = maxscore.Shard(np.array([5, 6, 7]), vectors, 1 << 62)
    assert shard.kind is object
    ids, scores = shard.best(np.array([1, 2]), 9, 3)
    assert (ids.tolist(), scores.tolist()) == ([7, 6, 5], [11, -(1 << 62), 2 - (1 << 63)])


def test_pipeline_keeps_one_row_of_each_text(spark):
    import corpus_pipeline

    other = " ".join(f"quite{i} different{i}" for i in range(40))
    rows = [(1, COPY), (1, COPY), (2, COPY), (2, other), (None, other), (None, COPY), (None, "a b c d e"), (None, "a b c d e"), (4, ""), (4, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.deduplicated(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, COPY), (2, other), (None, "a b c d e"), (4, ""), (5, "")], key=str)


def test_pipeline_keeps_texts_in_several_languages(spark, monkeypatch):
    import corpus_pipeline

    shares = F.when(F.col("text") == "?", F.lit("und")).otherwise(F.lit("en"))
    monkeypatch.setattr(corpus_pipeline.language_mixture, "fit", lambda docs: ([], None))
    monkeypatch.setattr(corpus_pipeline.language_mixture, "predict", lambda docs, *_: docs.withColumns({"lang_pred": shares, "score": F.lit(0.4)}))
    docs = spark.createDataFrame([(1, "one and zwei und trois"), (2, "?")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


def test_winnowing_of_text_without_spaces(spark):
    rng = np.random.default_rng(8)
    chinese = ["".join(chr(x) for x in rng.integers(0x4E00, 0x9000, 300)) for _ in range(2)]
    code = ["".join(chr(x) for x in rng.integers(97, 123, 300)) for _ in range(2)]
    astral = ["".join(chr(x) for x in rng.integers(0x20000, 0x21000, 60)) for _ in range(2)]
    for texts in (chinese, code, astral):
        rows = winnowing.fingerprints(spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")).collect()
        for r in rows:
            positions = [int(x.split(":")[1]) for x in r["fingerprint"].split()]
            assert max(np.diff([-1, *positions, len(texts[0]) - winnowing.K + 1])) <= winnowing.W
            assert 0.3 < r["near_edited"] < 0.9 and r["near_next"] < 0.2
    passage = chinese[0][100:106]
    marked = winnowing.with_marks(spark.createDataFrame([(1, f"{code[0]} {passage}x"), (2, f"y {passage}{code[1]}")], "doc_id long, text string"), "text", "marks")
    left, right = (set(r[0]) for r in marked.select(winnowing.hashes("marks")).collect())
    assert left & right
