"""Streams over several batches give what the batch twin gives."""

import datetime as dt

from pyspark.sql import functions as F

from inkveil.operators.dictionary import Dictionary
from inkveil.operators.provenance import allowlist_union
from inkveil.operators.redact import redact
from inkveil.streaming import arrivals as A


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Producer (Adobe PDF Library) ")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF /Producer (Skia) /Creator (Me)")
    (tmp_path / "c.txt").write_bytes(b"/Producer (Adobe PDF)")
    found = A.stream_allowlist(A.arrival_source(spark, str(tmp_path)), allowlist_union())
    rows = A.collected(found.select("producer", "creator", "is_approved")).collect()
    assert sorted(map(tuple, rows)) == [("Adobe PDF Library", "Not found", True), ("Skia", "Me", False)]


def two_batches(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in.parquet")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    frame = spark.read.parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return frame, stream


def test_duplicates_across_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 5, start + dt.timedelta(seconds=i)) for i in range(20)]
    _, stream = two_batches(spark, tmp_path, rows, "id long, created timestamp")
    assert sorted(r["id"] for r in A.collected(A.arrival_dedupe(stream, ["id"])).collect()) == [0, 1, 2, 3, 4]


def test_batches_out_of_order_lose_nothing(spark, tmp_path):
    path, times = str(tmp_path / "in.parquet"), [12, 13, 10]
    for i, hour in enumerate(times):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1, hour))], "id long, created timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id long, created timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(r["id"] for r in A.collected(A.arrival_dedupe(stream, ["id"])).collect()) == [0, 1, 2]
    assert sum(r["violations"] for r in A.violation_report(stream).collect()) == 6


def test_dedupe_goes_on_after_a_restart(spark, tmp_path):
    """What a query saw before it was stopped is still known to the next one with the same checkpoint, long after."""
    path, out, state = (str(tmp_path / name) for name in ("in.parquet", "out", "state"))
    seen = []
    for day, ids in enumerate([[1, 2], [2, 3, 1], [4, 1], [5, 5]]):
        rows = [(i, dt.datetime(2024, 1, 30 - 9 * day)) for i in ids]  # each batch is older than the one before
        spark.createDataFrame(rows, "id long, created timestamp").coalesce(1).write.mode("append").parquet(path)
        stream = A.arrival_dedupe(spark.readStream.schema("id long, created timestamp").parquet(path), ["id"])
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        assert sum(p["numInputRows"] for p in progress) == len(ids)
        seen.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
        query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]
    assert seen == [2, 3, 4, 5]


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    (tmp_path / "in.parquet").mkdir()
    stream = spark.readStream.schema("id long, created timestamp").parquet(str(tmp_path / "in.parquet"))
    assert A.foreach_batch(stream, lambda batch: batch.select("id")).collect() == []


def test_redaction_of_a_stream(spark, tmp_path):
    mapping = spark.createDataFrame([(1, "Box", "Nest")], "ordinal long, original string, replacement string")
    rows = [(i, "a box" if i % 2 else "none") for i in range(10)]
    frame, stream = two_batches(spark, tmp_path, rows, "doc_id long, text string")
    small, large = Dictionary.build(mapping), Dictionary.build(mapping, max_keys=0)
    want = sorted(map(tuple, redact(frame, small).collect()))
    assert sorted(map(tuple, A.stream_redact(stream, small).collect())) == want
    assert sorted(map(tuple, A.stream_redact(stream, large).collect())) == want


def test_error_channel_and_actions(spark):
    rows = spark.createDataFrame([(1, "ok", None), (2, None, "broken")], "id long, producer string, error string").withColumn("creator", F.lit(None).cast("string"))
    good, bad = A.error_channel(rows, F.col("error"))
    assert [r["id"] for r in good.collect()] == [1] and [r["problem"] for r in bad.collect()] == ["broken"]
    routed = A.action_routing(A.stream_allowlist(rows, allowlist_union()), F.lit("DELETE"))
    assert {(r["id"], r["action"]) for r in routed.collect()} == {(1, "delete"), (2, "delete")}
