"""Hot keys, file counts and names: what has to hold when one key has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import joins, reconcile, scrub
from inkveil.sources.sinks import read_report, write_report, write_scrubbed

DETAILS = "doc_id long, original string, occurrences long"
MAPPING = "ordinal long, original string, replacement string"


def skewed(spark, n=20_000):
    """Nine of ten rows share a key; some have none."""
    rows = [(i, "Hot" if i % 10 else (None if i % 50 == 0 else f"key{i % 700}"), 1) for i in range(n)]
    return spark.createDataFrame(rows, DETAILS).repartition(6)


def test_frequent_keys_hold_every_hot_key(spark):
    found = joins.frequent_keys(skewed(spark), "original")
    assert "Hot" in found and len(found) <= joins.FREQUENT + 1
    assert joins.frequent_keys(skewed(spark).limit(0), "original") == []


@pytest.mark.parametrize("size", [joins.BROADCAST_BYTES, 0])
def test_details_meet_their_mapping_whatever_the_plan(spark, size):
    details = skewed(spark)
    mapping = spark.createDataFrame([(1, "Hot", "A"), (2, "hot", "B"), (3, "key7", ""), (4, "key20", "C"), (5, "key20", "D")], MAPPING)
    got = reconcile.details_to_mapping(details, mapping, size)
    assert got.columns == [*details.columns, "replacement"]
    want = {"Hot": "A", "key7": "[DELETED]", "key20": "D"}
    rows = got.collect()
    assert len(rows) == 20_000 and all(r["replacement"] == want.get(r["original"], "[UNKNOWN]") for r in rows)
    lower = {"hot": "B", "key7": "", "key20": "D"}
    rows = reconcile.details_fallback(details, mapping, size).collect()
    both = {"Hot": "A", **lower}
    assert len(rows) == 20_000 and all(r["replacement"] == both.get(r["original"], lower.get((r["original"] or "").lower(), "?")) for r in rows)


def test_a_hot_key_goes_to_many_tasks(spark):
    details = skewed(spark)
    known = spark.createDataFrame([("Hot", "A"), ("key20", "C")], "original string, to string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.measured_join(details, known.hint("merge"), "original", ["doc_id"], broadcast_bytes=0)
        tasks = joined.where("original = 'Hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in tasks) == 18_000
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 12_000


def test_files_follow_folders_and_bytes(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 16).select(
        F.concat(F.lit("f"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 25)).alias("top_folder"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text")
    )
    path = str(tmp_path / "scrubbed")
    write_scrubbed(rows, path)
    files = list((tmp_path / "scrubbed").rglob("part-*.parquet"))
    assert 25 <= len(files) <= 25 + 8  # 16 tasks with 25 folders each would leave 400
    back = spark.read.parquet(path)
    assert back.count() == 40_000 and back.where("top_folder = 'f0'").count() == rows.where("top_folder = 'f0'").count()


def test_reports_are_written_side_by_side(spark, tmp_path):
    tables = {name: spark.range(5).withColumn("t", F.lit(name)) for name in ("file_details", "error_log", "mappings")}
    write_report(tables, str(tmp_path))
    assert all(read_report(spark, str(tmp_path), name).where(F.col("t") == name).count() == 5 for name in tables)
    with pytest.raises(ValueError):
        write_report({"other": spark.range(1)}, str(tmp_path))


def names(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc long, sheet long, old string, new string")


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("A", "X"), ("X", "X"), ("X_1", "X_1")], ["X_2", "X", "X_1"]),
        ([("A", "X"), ("B", "x"), ("C", "X")], ["X", "x_1", "X_2"]),
        ([("A", "X"), ("B", "X"), ("C", "X_1"), ("D", "X_1"), ("E", "X_3"), ("F", "X")], ["X", "X_2", "X_1", "X_1_1", "X_3", "X_4"]),
        ([("A", "a_1"), ("B", "A"), ("C", "A"), ("D", "A_01")], ["a_1", "A", "A_2", "A_01"]),
        ([("A", "A"), ("B", "B")], ["A", "B"]),
    ],
)
def test_names_become_unique(spark, rows, expected):
    got = scrub.name_dedupe(names(spark, *rows), ["doc"], "old", "new", "sheet").orderBy("sheet").collect()
    assert [r["final_name"] for r in got] == expected


def test_random_names_are_unique_and_take_the_least_numbers(spark):
    rng = random.Random(6)
    pool = ["X", "x", "X_1", "X_2", "x_5", "Y", "Y_1", "X_1_1", "Z"]
    rows = [(doc, i, rng.choice(pool), rng.choice(pool)) for doc in range(30) for i in range(14)]
    frame = spark.createDataFrame(rows, "doc long, sheet long, old string, new string")
    got = {}
    for r in scrub.name_dedupe(frame, ["doc"], "old", "new", "sheet").collect():
        got.setdefault(r["doc"], {})[r["sheet"]] = r["final_name"]
    for doc in range(30):
        mine = [(i, old, new) for d, i, old, new in rows if d == doc]
        wanted = {new.lower() for _, _, new in mine}
        order = sorted(mine, key=lambda r: (r[1] != r[2], r[0]))
        final, taken = {}, set()
        for i, _, new in order:
            name, k = new, 0
            while name.lower() in taken or (k and name.lower() in wanted):
                k += 1
                name = f"{new}_{k}"
            taken.add(name.lower())
            final[i] = name
        assert got[doc] == final
        assert len({n.lower() for n in final.values()}) == 14
