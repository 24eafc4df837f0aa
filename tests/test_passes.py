"""Passes from a table against one pass after the other."""

import random

import pytest

from inkveil.operators.passes import redact_in_passes
from test_redaction import model

RANKED = "position long, original string, replacement string"
FRAME = "doc_id long, text string"


def in_turn(text, rows):
    hits = 0
    for key, to in rows:
        text, n = model(text, [(key, to)])
        hits += n
    return text, hits


def run(spark, texts, rows, **how):
    ranked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RANKED)
    done = redact_in_passes(spark.createDataFrame(list(enumerate(texts)), FRAME), ranked, **how)
    assert done.columns == ["doc_id", "text", "redacted", "replacements"]
    return [(r["redacted"], r["replacements"]) for r in done.orderBy("doc_id").collect()]


@pytest.mark.parametrize("how", [{}, {"few": 0}])
@pytest.mark.parametrize(
    "rows",
    [
        [("a b", "c"), ("c", "d")],
        [("c", "d"), ("a b", "c")],
        [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e e")],
        [("a", ""), ("b  c", "x"), ("b", "y")],
        [("a", "b c d"), ("c", "x"), ("b x", "q")],
        [("-", ""), ("ab", "z"), ("b", "a")],
        [("a", "é"), ("é", "b"), ("b", "a")],
        [("(a", "b"), ("b)", "(a"), ("a", "")],
        [("a", "A b"), ("A", "c"), ("b c", "A A")],
    ],
)
def test_chains(spark, rows, how):
    texts = ["a b C", "c d", "b a c", "A-B a-b", "(a) b)", "a", "", "a a b a é", "b  c b a c"]
    assert run(spark, texts, rows, **how) == [in_turn(t, rows) for t in texts]


def test_a_chain_without_broadcasts(spark):
    rows, texts = [("a", "b"), ("b", "c d"), ("d", "")], ["a b d", "c", "B a-d"]
    assert run(spark, texts, rows, few=0, broadcast_bytes=0) == [in_turn(t, rows) for t in texts]


def test_null_texts_and_no_keys(spark):
    frame = spark.createDataFrame([(1, None), (2, "a")], FRAME)
    for rows, want in (([(1, "a", "b")], [(None, 0), ("b", 1)]), ([], [(None, 0), ("a", 0)])):
        done = redact_in_passes(frame, spark.createDataFrame(rows, RANKED)).orderBy("doc_id").collect()
        assert [(r["redacted"], r["replacements"]) for r in done] == want


def test_random_dictionaries(spark):
    rng = random.Random(12)
    letters = "abAB1 -(é"
    for _ in range(2):
        rows = []
        while len(rows) < 14:
            key = "".join(rng.choice(letters) for _ in range(rng.randint(1, 4))).strip()
            if key:
                rows.append((key, "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))))
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(60)]
        assert run(spark, texts, rows, few=rng.choice([0, 64])) == [in_turn(t, rows) for t in texts]


def test_many_keys(spark):
    """Thousands of keys, of which each text holds a few; chains of three."""
    rows = [(f"name{i}", f"alias{i}") for i in range(20_000)] + [(f"alias{i}", f"last{i}") for i in range(0, 20_000, 2)]
    rng = random.Random(1)
    texts = [" ".join(f"name{rng.randrange(25_000)}" for _ in range(6)) for _ in range(50)]

    def expected(text):
        out, n = [], 0
        for word in text.split():
            i = int(word[4:])
            if i < 20_000:
                word, n = (f"last{i}", n + 2) if i % 2 == 0 else (f"alias{i}", n + 1)
            out.append(word)
        return " ".join(out), n

    assert run(spark, texts, rows) == [expected(t) for t in texts]


def test_a_pass_scans_a_text_once_and_only_where_its_key_may_stand(spark):
    ranked = spark.createDataFrame([(0, "ab", "c"), (1, "kis", "Ab")], RANKED)
    plan = redact_in_passes(spark.createDataFrame([(1, "ab")], FRAME), ranked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "contains(" in plan.lower()


@pytest.mark.parametrize("rows", [[("ab", "Kis"), ("kis", "c"), ("c", "é"), ("é", "Ab"), ("ab", "x")], [("ΣΑΣ", "a"), ("-a", "i"), ("i", "ß")]])
def test_letters_that_match_ascii_ones(spark, rows):
    texts = ["KİS Kıſ kis", "AB. aB é", "ΣΑΣ σας -a", "-A İ ı é", "", "no"]
    assert run(spark, texts, rows) == run(spark, texts, rows, few=0)
