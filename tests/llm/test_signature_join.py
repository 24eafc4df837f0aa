"""The signature join against brute force, its prefixes and its counts."""

import re

import numpy as np
import pytest

from inkveil.llm import signature_join as join

SCHEMA = "doc_id long, text string, node long, name string, signature int, `a.b` string"


def frame(spark, texts):
    rows = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, 1, "n", 2, "x") for i, t in rows], SCHEMA).repartition(3)


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def grouped(rows, k, percent):
    """(doc_id, n_shingles, component_id) of each row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str
    )


def check(spark, rows, k, percent):
    out = join.near_duplicates(frame(spark, rows), k, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == grouped(list(rows), k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def families(seed, n, k=3):
    """Edited copies of a few texts, most of them near the threshold, with a passage that all share."""
    rng = np.random.default_rng(seed)
    shared = " ".join(f"s{i}" for i in range(40))
    bases = [[f"b{b}w{x}" for x in rng.integers(0, 500, 60 + 40 * b)] for b in range(5)]
    for i in range(n):
        words = list(bases[i % 5])
        for at in rng.integers(0, len(words), int(rng.integers(0, 8))):
            words[at] = f"e{rng.integers(0, 10**6)}"
        text = " ".join(words[: len(words) - int(rng.integers(0, 6))])
        yield i, f"{text} {shared}" if i % 2 else text


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80), (2, 95)])
def test_families_match_brute_force(spark, k, percent):
    check(spark, list(families(percent, 220)), k, percent)


def test_lists_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(join, "_BLOCK", 8)
    check(spark, list(families(3, 160)), 3, 85)


def test_order_of_values_changes_no_link(spark, monkeypatch):
    monkeypatch.setattr(join, "_VALUES", 3)
    check(spark, list(families(4, 120)), 3, 85)


def test_edge_cases(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(120_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "two words"), (7, "Two  WORDS"), (8, "a b c d e f g h"),
        (9, "a b c d e f g x"), (10, "x " * 4000), (11, "x x x x"), (12, long), (13, long + " tail"), (2**60 + 1, "large id here now"),
        (2**60, "large id here now"), (None, "only null ids say this"), (None, "only null ids say this"), (None, long + " end"), (14, "Ärger über Größe"),
        (14, "Ärger über Größe"), (-5, "one"),
    ]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.near_duplicates(frame(spark, rows), 3, 85).collect()), key=str)
    assert got == grouped(rows, 3, 85)


def test_empty_table(spark):
    assert join.near_duplicates(frame(spark, [])).collect() == []


def test_matches_needed():
    for percent in (60, 80, 85, 95, 100):
        needed = join.matches_needed(percent)
        rng = np.random.default_rng(percent)
        assert rng.binomial(join.COORDINATES, percent / 100, 200_000).min() >= needed
    assert join.matches_needed(100) == join.COORDINATES


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (7, 20, 300):
        for _ in range(150):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            y = np.concatenate((x[: n - n // 7], rng.integers(0, 2**63, n // 7, dtype=np.uint64)))
            a, b = join.signatures([np.sort(x), np.sort(y)])
            errors.append((a == b).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07


def test_prefixes_of_agreeing_signatures_meet():
    rng = np.random.default_rng(2)
    length = join.COORDINATES - 36 + 1
    values = rng.integers(0, 40, (400, join.COORDINATES)).astype(np.uint32)
    values[1::2] = np.where(rng.random((200, join.COORDINATES)) < 0.62, values[::2], values[1::2])
    tokens = join._tokens(values)
    known = np.unique(rng.choice(tokens.ravel(), 500))
    first = join._prefixes(tokens, (known, rng.permutation(len(known)).astype(np.uint64)), length)
    held = np.take_along_axis(tokens, first, axis=1)
    for i in range(0, 400, 2):
        if (values[i] == values[i + 1]).sum() >= 36:
            assert len(np.intersect1d(held[i], held[i + 1]))


def test_class_counts_rule_out_no_link():
    rng = np.random.default_rng(6)
    for n in (6, 7, 13, 40, 300, 5000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.06], rng.integers(0, 2**63, n // 14, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            counts = [join._unpacked(join._class_counts(z)) for z in (x, y)]
            assert [c.sum() for c in counts] == [len(x), len(y)]
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert join._may_link(*counts, len(x) + len(y), 85)
    same = np.arange(40, dtype=np.uint64)  # all in one class, beyond what four bits hold
    assert join._may_link(*[join._unpacked(join._class_counts(same))] * 2, 80, 85)
