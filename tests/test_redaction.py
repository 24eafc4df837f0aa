"""Redaction against golden values and against an independent model with Python's regex engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.operators import hits
from inkveil.operators import redact as R
from inkveil.operators.dictionary import Dictionary

FORMS = {
    "pattern": {},
    "broadcast": {"max_keys": 0},
    "shuffled": {"max_keys": 0, "broadcast_bytes": 0},
}
MAPPING = "ordinal long, original string, replacement string"


def model(text, rows):
    """What redaction means, stated once more: longest key at the leftmost place, hits never rescanned."""
    if not text:
        return text, 0
    known, hits = {}, 0
    for original, replacement in rows:
        known[original.lower()] = replacement
    branches = []
    for key in sorted((r[0] for r in rows), key=len, reverse=True):
        left = "(?<![a-zA-Z0-9])" if key[0].isalnum() else ""
        right = "(?![a-zA-Z0-9])" if key[-1].isalnum() else ""
        branches.append(left + re.escape(key) + right)
    out, last = [], 0
    for found in re.finditer("|".join(branches), text, re.IGNORECASE):
        hit = found.group()
        out.append(text[last : found.start()])
        last = found.end()
        to = known.get(hit.lower())
        if to is None:
            out.append(hit)
            continue
        hits += 1
        out.append(to.upper() if hit.isupper() else to.lower() if hit.islower() else to)
    return "".join(out) + text[last:], hits


def run(spark, texts, rows, **form):
    mapping = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MAPPING)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = R.redact(frame, Dictionary.build(mapping, **form)).orderBy("doc_id").collect()
    return [(r["redacted"], r["replacements"]) for r in done]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize(
    "text, rows, expected",
    [
        ("Box Co. and BOX and box", [("Box Co.", "Nest Corp."), ("Box", "Nest")], ("Nest Corp. and NEST and nest", 3)),
        ("Boxer Dropbox box_1 éBox boxé", [("Box", "Nest")], ("Boxer Dropbox nest_1 éNest nesté", 3)),
        ("call (877) 555-0100 now", [("(877) 555-0100", "(000) 000-0000")], ("call (000) 000-0000 now", 1)),
        ("Secret plan", [("Secret", "")], (" plan", 1)),
        (None, [("Box", "Nest")], (None, 0)),
        ("", [("Box", "Nest")], ("", 0)),
        ("box bOx", [("Box", "A"), ("BOX", "B")], ("b B", 2)),
        ("a box b", [("Box", "Chest box box")], ("a chest box box b", 1)),
        ("mark ﷐ box", [("Box", "Nest")], ("mark ﷐ nest", 1)),
        ("Иван Иванович 名前", [("Иван", "Пётр"), ("名", "x")], ("Пётр Пётрович x前", 3)),
        ("boxı boxİ box", [("Box", "Nest")], ("boxı boxİ nest", 1)),
    ],
)
def test_golden(spark, form, text, rows, expected):
    assert run(spark, [text], rows, **FORMS[form]) == [expected]


def test_random_texts_match_the_model_in_every_form(spark):
    rng = random.Random(7)
    letters = "aAbB1 .-(é_\n"
    for _ in range(4):
        rows, seen = [], set()
        while len(rows) < 8:
            key = "".join(rng.choice(letters) for _ in range(rng.randint(1, 5))).strip()
            if key and key.lower() not in seen:
                seen.add(key.lower())
                rows.append((key, rng.choice(["", "Xy", "Zed q", "aB"])))
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(120)]
        expected = [model(t, rows) for t in texts]
        for form in ({}, {"max_keys": 0}, {"max_keys": 0, "broadcast_bytes": 400}, {"max_keys": 0, "broadcast_bytes": 0}):
            assert run(spark, texts, rows, **form) == expected


def test_unknown_match_is_kept_and_not_counted(spark):
    assert run(spark, ["es ES eſ"], [("eſ", "X")]) == [("es ES x", 1)]


def test_empty_mapping_changes_nothing(spark):
    assert run(spark, ["some text", None], []) == [("some text", 0), (None, 0)]


def test_empty_key_is_rejected(spark):
    with pytest.raises(ValueError):
        run(spark, ["x"], [("", "y")])


def test_details_and_their_sum(spark):
    mapping = spark.createDataFrame([(1, "Box", "Nest"), (2, "cat", "dog")], MAPPING)
    frame = spark.createDataFrame([(1, "box Box cat"), (2, None), (3, "none")], "doc_id long, text string")
    details = R.replacement_details(frame, Dictionary.build(mapping))
    assert sorted(map(tuple, details.collect())) == [(1, "Box", 2), (1, "cat", 1)]
    merged = R.merge_details(details, details)
    assert sorted(map(tuple, merged.collect())) == [(1, "Box", 4), (1, "cat", 2)]


def test_count_maps_add_up(spark):
    row = spark.range(1).select(
        R.merge_count_maps(F.expr("map('a', 1L, 'b', 2L)"), F.expr("map('b', 3L)")).alias("both"),
        R.merge_count_maps(F.expr("cast(null as map<string,bigint>)"), F.expr("map('b', 3L)")).alias("one"),
    ).first()
    assert row["both"] == {"a": 1, "b": 5} and row["one"] == {"b": 3}


def test_word_join_agrees_with_the_pattern(spark):
    mapping = spark.createDataFrame([(1, "box", "n"), (2, "BOX", "m"), (3, "cat", "c")], MAPPING)
    frame = spark.createDataFrame([(1, "Box box-cat boxer"), (2, "dog")], "doc_id long, text string")
    for size in (1 << 20, 0):
        joined = R.dictionary_hits(frame, mapping, broadcast_bytes=size)
        assert sorted(map(tuple, joined.collect())) == [(1, "box", 2), (1, "cat", 1)]


def test_rows_without_a_key_value_are_redacted_too(spark):
    mapping = spark.createDataFrame([(1, "Box", "Nest")], MAPPING)
    frame = spark.createDataFrame([(None, "a box"), (None, "Box"), (1, "x")], "doc_id long, text string")
    for form in FORMS.values():
        done = R.redact(frame, Dictionary.build(mapping, **form))
        assert sorted(r["redacted"] for r in done.collect()) == ["Nest", "a nest", "x"]


def test_leaks_are_found(spark):
    mapping = Dictionary.build(spark.createDataFrame([(1, "Box", "the cat"), (2, "cat", "")], MAPPING))
    frame = spark.createDataFrame([(1, "a box"), (2, "a cat")], "doc_id long, text string")
    assert [tuple(r) for r in R.residual_leaks(R.redact(frame, mapping), mapping).collect()] == [(1, 1)]


def test_deeply_nested_prefixes(spark):
    """Keys that continue each other hundreds of times leave the single pattern, not the result."""
    rows = [("a" + " a" * n, f"x{n}") for n in range(350)]
    ready = Dictionary.build(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MAPPING))
    assert ready.pattern is None
    texts = ["a" + " a" * 349 + " b", "a a a", "A"]
    assert run(spark, texts, rows) == [("x349 b", 1), ("x2", 1), ("X0", 1)]
    assert run(spark, texts, rows[:250]) == [model(t, rows[:250]) for t in texts]


def test_many_long_keys(spark):
    """The largest dictionary that still becomes one pattern."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = list({" ".join(rng.choices(words, k=rng.randint(1, 5))): "q" for _ in range(90_000)}.items())
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    assert sum(len(a) + len(b) for a, b in rows) < 4_000_000
    small, large = run(spark, texts, rows), run(spark, texts, rows, max_keys=0)
    assert small == large and sum(n for _, n in small) > 100


def test_keys_that_share_endings_meet_only_their_texts(spark):
    """Candidates are runs that equal a key, whatever keys share an ending, a beginning or three letters."""
    rows = [(f"Firma{i} Ltd", f"Haus{i} Ltd") for i in range(5000)] + [(f"при{i}вет мир", f"мир{i}") for i in range(300)]
    mapping = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MAPPING)
    ready = Dictionary.build(mapping, max_keys=0)
    texts = ["firma7 Ltd and Ltd", "FIRMA4999 LTD, Firma5000 Ltd", "При3вет Мир, при300вет мир", "Ltd " * 50, "хприй приприпри"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = hits.candidates(frame, ready.index, "text", ["doc_id"])
    assert hits.matched(runs, ready.index, ["doc_id"], True).count() == 3
    assert runs.count() < 30
    assert run(spark, texts, rows, max_keys=0) == [model(t, rows) for t in texts]


def test_overlapping_keys_are_settled_from_the_left(spark):
    rows = [("a b", "1"), ("b c", "2"), ("c d e", "3"), ("d", "4"), ("e f", "5"), ("c", "6"), ("-(", "7"), ("(x", "8"), ("x)", "9")]
    texts = ["a b c d e f", "b c d e f", "a b c d", "-(x)", "c d e f-(x) a b c", "z(x)x)", " ".join("abcdef" * 40)]
    expected = [model(t, rows) for t in texts]
    for form in FORMS.values():
        assert run(spark, texts, rows, **form) == expected


def test_equal_row_keys_with_different_texts(spark):
    mapping = spark.createDataFrame([(1, "Box", "Nest")], MAPPING)
    frame = spark.createDataFrame([(1, "a box"), (1, "Box box"), (1, "a box")], "doc_id long, text string")
    for form in FORMS.values():
        assert sorted(r["redacted"] for r in R.redact(frame, Dictionary.build(mapping, **form)).collect()) == ["Nest nest", "a nest", "a nest"]


def test_characters_fold_one_by_one(spark):
    rows = [("straße", "X"), ("ΣΑΣ", "Y"), ("ﬁn", "Z"), ("ŉ", "N"), ("İx", "I"), ("😀b", "E")]
    texts = ["Straße STRASSE straẞe", "σας ΣΑΣ σαΣ", "ﬁn FIN fin", "ŉ ʼn", "ix İx IX ıx", "a 😀B 😀"]
    small = run(spark, texts, rows)
    assert run(spark, texts, rows, max_keys=0) == small == run(spark, texts, rows, max_keys=0, broadcast_bytes=0)


def test_the_hits_of_a_text_are_gathered_at_once(spark):
    ready = Dictionary.build(spark.createDataFrame([(0, "ab", "c"), (1, "kis", "d")], MAPPING), max_keys=0)
    df = spark.createDataFrame([(1, "ab kis")], "doc_id long, text string")
    plan = R.redact(df, ready)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate [") == 1


def test_knots_among_hits_that_stand_alone(spark):
    rows = [("a b", "1"), ("b c d", "2"), ("d e", "3"), ("c", "4"), ("é", "5"), ("e", "6")]
    texts = ["a b c d e e c", "b c d e a b", "c é e. aé", "e", "", "a a b b c c d d e e " * 30]
    for form in ({"max_keys": 0}, {"max_keys": 0, "broadcast_bytes": 0}):
        assert run(spark, texts, rows, **form) == [model(t, rows) for t in texts]
