"""Stitching: a paragraph is one row, however many blocks it was redacted in."""

import random

import pytest

from inkveil.operators.dictionary import Dictionary
from inkveil.operators.redact import redact
from inkveil.operators.stitch import first_format, link_run_split, run_stitch

MAPPING = "ordinal long, original string, replacement string"
RUNS = "para long, run_no long, text string, in_link boolean"


def test_phrase_over_runs(spark):
    ready = Dictionary.build(spark.createDataFrame([(1, "Jane Roe", "Ann Lee")], MAPPING))
    rows = [(1, 2, "Roe", False), (1, 0, "Jane", False), (1, 1, " ", False),
            (2, 0, "Jane", False), (2, 1, " ", True), (2, 2, "Roe", False)]
    runs = spark.createDataFrame(rows, RUNS)
    done = run_stitch(runs.filter("para = 1"), ready, ["para"]).first()
    assert (done["redacted"], done["replacements"]) == ("Ann Lee", 1)
    split = link_run_split(runs, ready, ["para"]).orderBy("para", "part_no").collect()
    assert [(r["para"], r["redacted"], r["replacements"]) for r in split] == [
        (1, "Ann Lee", 1), (2, "Jane", 0), (2, " ", 0), (2, "Roe", 0)
    ]


@pytest.mark.parametrize("form", [{}, {"max_keys": 0}])
@pytest.mark.parametrize("block", [1, 2, 4, 10_000])
def test_a_long_paragraph_is_one_row_at_any_block_size(spark, form, block):
    rng = random.Random(3)
    words = ["ab", "a b", "b.", " ", "\n", "c", "ab c", ",", "", "A", "b a", None]
    rows = [(p, n, rng.choice(words), False) for p in [*range(6), None] for n in range(rng.choice([1, 5, 90]))]
    rows += [(7, 0, "", False), (7, 9, None, False), (8, 3, "ab" * 40, False), (8, 4, "c", False), (8, 40_000, "a b", False)]
    mapping = spark.createDataFrame([(1, "a b", "X"), (2, "ab", "Yy"), (3, "b.", "zz"), (4, "c a", "")], MAPPING)
    ready = Dictionary.build(mapping, **form)
    whole = {}
    for p, n, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        whole[p] = whole.get(p, "") + (t or "")
    want = redact(spark.createDataFrame(list(whole.items()), "para long, text string"), Dictionary.build(mapping), keys=["para"])
    got = run_stitch(spark.createDataFrame(rows, RUNS).repartition(5), ready, ["para"], block=block)
    assert got.columns == ["para", "redacted", "replacements"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("text").collect()))


def test_first_format(spark):
    rows = spark.createDataFrame([(1, 1, True, "B"), (1, 0, False, "A")], "para long, run_no long, bold boolean, font string")
    assert tuple(first_format(rows, ["para"], ["bold", "font"]).first()) == (1, False, "A")
