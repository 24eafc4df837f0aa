"""Mapping preparation on small sheets."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import texts
from inkveil.operators import mapping as M
from inkveil.operators.ranking import numbered
from inkveil.sources.sheets import book_pairs, mapping_cells, mapping_source

PAIRS = "book long, ordinal long, original string, replacement string"


def pairs(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], PAIRS)


def kinds(frame):
    return {(r["original"], r["replacement"], r["kind"]) for r in frame.collect()}


def test_reversed_names(spark):
    done = kinds(M.mapping_union(pairs(spark, ("Jane Roe", "Ann Lee"), ("Max Poe", "Person"), ("Roe Max", "A B"), ("Max Roe", "C D")), ["book"]))
    assert ("Roe Jane", "Lee Ann", "reversed") in done
    assert not any(o == "Poe Max" for o, _, _ in done)
    assert {(o, r) for o, r, k in done if k == "direct"} >= {("Roe Max", "A B"), ("Max Roe", "C D")}


def test_bases(spark):
    done = kinds(M.mapping_union(pairs(spark, ("Box Inc.", "Nest Inc."), ("Jane Roe, CEO", "Ann Lee"), (", CEO", "x"), ("Box LLC", "Other")), ["book"]))
    bases = {(o, r) for o, r, k in done if k == "base"}
    assert bases == {("Box", "Nest"), ("Jane Roe", "Ann Lee"), ("Inc. Box", "Inc. Nest")} - {("Inc. Box", "Inc. Nest")}
    assert ("Inc. Box", "Inc. Nest", "reversed") in done


def test_normalised_values(spark):
    values = ["91301.0", "v1.0", ".0", " a\t", "(877) 555-0100.0", "-.0"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in frame.select(texts.normalised_value(F.col("v"))).collect()] == [
        "91301", "v1.0", ".0", "a", "(877) 555-0100", "-.0"
    ]


def test_numbers_and_display(spark):
    given = ["24", "19.5", "20.5", "22.079999923706055", "100.6", "x", None, " 7 ", "12d", "1.5f"]
    frame = spark.createDataFrame([(v,) for v in given], "v string")
    assert [r[0] for r in frame.select(texts.tolerant_int(F.col("v"))).collect()] == [24, 20, 20, 22, 101, 0, 0, 7, 0, 0]
    wide = spark.createDataFrame([("9" * 29,), ("-" + "9" * 38,), ("9" * 39,), ("1e30",), ("+12",), ("1e400",)], "v string")
    assert [r[0] for r in wide.select(texts.tolerant_int(F.col("v"))).collect()] == [10**29 - 1, 1 - 10**38, None, 10**30, 12, None]
    long = spark.createDataFrame([("y" * 61,), ("y" * 60,)], "v string").select(texts.truncated(F.col("v"))).collect()
    assert [r[0] for r in long] == ["y" * 57 + "...", "y" * 60]


def test_last_value_first_place(spark):
    done = M.last_value_wins(pairs(spark, ("a", "1"), ("b", "2"), ("a", "3")), ["book"]).orderBy("ordinal").collect()
    assert [(r["original"], r["replacement"], r["ordinal"]) for r in done] == [("a", "3", 0), ("b", "2", 1)]


def test_sheet_header_and_columns(spark):
    cells = spark.createDataFrame(
        [(1, 1, "Data", True, 1, 0, "x"), (1, 2, "My Mapping", False, 2, 0, "No"), (1, 2, "My Mapping", False, 2, 1, "Before"),
         (1, 2, "My Mapping", False, 2, 2, "After"), (1, 2, "My Mapping", False, 2, 3, "New alias"), (1, 2, "My Mapping", False, 3, 1, " Box "),
         (1, 2, "My Mapping", False, 3, 3, None)],
        "book long, sheet_no int, sheet string, is_active boolean, row_no long, col_no int, value string",
    )
    assert mapping_source(cells, ["book"]).first()["sheet_no"] == 2
    sheet = cells.filter("sheet_no = 2")
    assert tuple(M.column_detect(sheet, ["book"]).first()) == (1, 2, 1, 3, None)
    row = M.load_mapping(sheet, ["book"]).first()
    assert (row["original"], row["replacement"], row["kind"]) == ("Box", "", "direct")


def test_empty_mapping_is_refused(spark):
    with pytest.raises(ValueError):
        M.require_mapping(pairs(spark).filter("false"))


def test_tiers(spark):
    rows = pairs(spark, ("ab", ""), ("a b", ""), ("x Inc.", ""), ("abc", ""), ("a b c", ""), ("xyz", ""))
    done = M.tier_rank(rows, ["book"]).orderBy("position").collect()
    assert [r["original"] for r in done] == ["x Inc.", "a b c", "a b", "abc", "xyz", "ab"]


def test_numbers_of_groups_and_of_all_rows(spark):
    """A hot group, a null group and equal sort values, over many ranges."""
    group = F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, F.col("id") % 5)
    frame = spark.range(0, 3000, 1, 7).select("id", group.alias("g"), (F.col("id") % 7).alias("k"))
    rows = sorted(((r["g"] is not None, r["g"] or 0, r["k"], r["id"]) for r in frame.collect()))
    seen, want = {}, {}
    for known, g, _, key in rows:
        seen[known, g] = want[key] = seen.get((known, g), 0) + 1
    got = numbered(frame.repartition(9), [F.col("k")], "id", ["g"])
    assert got.columns == ["id", "g", "k", "position"]
    assert {r["id"]: r["position"] for r in got.collect()} == want
    whole = numbered(frame, [-F.col("k")], "id").orderBy("position").collect()
    assert [r["position"] for r in whole] == list(range(1, 3001))
    assert [(-r["k"], r["id"]) for r in whole] == sorted((-r["k"], r["id"]) for r in whole)
    assert numbered(frame.limit(0), [], "id", ["g"]).count() == 0
    names = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "name string")
    assert {r["name"]: r["position"] for r in numbered(names, [], "name").collect()} == {None: 1, "a": 2, "b": 3, "c": 4}


CELLS = "book long, sheet_no int, sheet string, is_active boolean, row_no long, col_no int, value string"


def test_rejected_sheets_say_why(spark):
    rows = [
        (1, 1, "Mapping", True, 11, 0, "Original"), (1, 1, "Mapping", True, 11, 1, "Alias"),
        (2, 1, "Mapping", True, 1, 0, "Before"), (2, 1, "Mapping", True, 1, 1, "Remark"), (2, 1, "Mapping", True, 2, 1, "Alias"),
        (3, 1, "Mapping", True, 10, 0, "Real"), (3, 1, "Mapping", True, 10, 1, "After"), (3, 1, "Mapping", True, 12, 0, "x"),
        (4, 1, "Mapping", True, 1, 0, None), (5, 1, "Mapping", True, 1, 0, "Original alias"),
    ]
    cells = spark.createDataFrame(rows, CELLS)
    got = {r["book"]: r["problem"] for r in M.rejected_sheets(cells, ["book"]).collect()}
    assert got == {1: M.NO_HEADER, 2: M.NO_TARGET, 4: M.NO_HEADER, 5: M.NO_TARGET}
    assert {r["book"] for r in M.header_detect(cells, ["book"]).where("problem is null").collect()} == {2, 3, 5}
    assert [tuple(r) for r in M.raw_pairs(cells, ["book"]).collect()] == [(3, 12, "x", None)]


def test_books_in_one_shuffle_equal_the_single_steps(spark):
    rng = random.Random(4)
    words = ["Original", "Before", "Alias", "After", "Replacement name", "x", None, " y ", "z.0", "Real alias"]
    rows = [
        (book, sheet, rng.choice(["Data", "Mapping", "Tracker", "Notes"]), sheet == 2, row, col, rng.choice(words if row < 4 else words[5:8]))
        for book in range(40) for sheet in (1, 2, 3) for row in range(1, 14) for col in range(4) if rng.random() < 0.7
    ]
    named = {(r[0], r[1]): r[2] for r in rows}
    cells = spark.createDataFrame([(b, s, named[b, s], *rest) for b, s, _, *rest in rows], CELLS).repartition(4)
    single = M.raw_pairs(mapping_cells(cells, ["book"]), ["book"])
    assert single.count() > 20
    assert sorted(map(str, book_pairs(cells, ["book"]).collect())) == sorted(map(str, single.collect()))


def test_case_collisions(spark):
    row = M.casefold_lookup(pairs(spark, ("Box", "A"), ("BOX", "B"))).first()
    assert (row["lower"], row["original"], row["replacement"], row["spellings"]) == ("box", "BOX", "B", 2)
