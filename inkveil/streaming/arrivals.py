"""Watching for new files and checking, redacting and reporting them as streams.

A query's checkpoint remembers which input it has read, which replaces looking back a few minutes on a
timer.  Results go to file sinks, written once per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkveil.operators.dictionary import Dictionary
from inkveil.operators.provenance import action, is_approved, pdf_metadata
from inkveil.operators.redact import redact
from inkveil.session import shared_dir

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
LOOK_BACK = "10 minutes"
EVERY = "5 minutes"


def arrival_source(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """New files of a folder with the producer and creator named in their content."""
    found = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    )
    return found.select(
        "path", F.col("modificationTime").alias("created"), F.col("length").alias("size"),
        *[column.alias(name) for name, column in pdf_metadata(F.col("content")).items()],
    )


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet table as a stream.  Written as a pattern, the path may be one file or a folder."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")


def recent_arrivals(arrivals: DataFrame, polled: Column, created: str = "created", look_back: str = LOOK_BACK) -> DataFrame:
    """Arrivals at most ``look_back`` older than the poll that sees them."""
    return arrivals.filter(F.col(created) >= polled - F.expr(f"interval {look_back}"))


def arrival_dedupe(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """The stream with each arrival once, although overlapping polls report it twice, however late it comes.

    Keys that were seen are state of the query, kept in RocksDB without a watermark: nothing is late, and a micro-batch costs its
    own size and its own keys, not the history. A restart from the same checkpoint goes on with that state.
    """
    return arrivals.dropDuplicates(keys)


def stream_allowlist(arrivals: DataFrame, allowed: list[str]) -> DataFrame:
    """Check each arrival; one whose metadata could not be read is not approved."""
    failed = F.coalesce(F.col("error"), F.lit("")) != "" if "error" in arrivals.columns else F.lit(False)
    approved = is_approved(F.col("producer"), F.col("creator"), allowed)
    return arrivals.withColumn("is_approved", ~failed & approved)


def action_routing(checked: DataFrame, chosen: Column) -> DataFrame:
    """Violations with the action to take."""
    return checked.filter("not is_approved").withColumn("action", action(chosen))


def audit_trail(violations: DataFrame, key: str) -> DataFrame:
    """One comment per violation with the time it was seen."""
    note = F.concat(
        F.lit("Not written by an approved tool; producer: "), F.coalesce("producer", F.lit("Unknown")),
        F.lit("; creator: "), F.coalesce("creator", F.lit("Unknown")),
    )
    return violations.select(key, note.alias("comment"), F.current_timestamp().alias("detected"))


def violation_report(violations: DataFrame, created: str = "created") -> DataFrame:
    """Run the stream and count all its violations per polling window; each micro-batch leaves partial counts."""

    def count(batch: DataFrame) -> DataFrame:
        windows = batch.groupBy(F.window(created, LOOK_BACK, EVERY).alias("w")).agg(F.count("*").alias("violations"))
        return windows.select(F.col("w.start").alias("from_time"), "violations")

    return foreach_batch(violations, count).groupBy("from_time").agg(F.sum("violations").alias("violations"))


def error_channel(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failing rows with their reason."""
    judged = rows.withColumn("problem", problem)
    return judged.filter("problem is null").drop("problem"), judged.filter("problem is not null")


def stream_redact(texts: DataFrame, dictionary: Dictionary, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Run the stream and redact all its texts; a dictionary in its joined form is applied to each micro-batch."""
    if dictionary.index is None:
        return collected(redact(texts, dictionary, text, keys))
    return foreach_batch(texts, lambda batch: redact(batch, dictionary, text, keys))


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, into files, and read the files back."""
    spark = stream.sparkSession
    path = shared_dir(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/data")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def foreach_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply batch work to every micro-batch.  A batch that is run again replaces its own files."""
    spark = stream.sparkSession
    path = shared_dir(spark, "stream")
    empty = work(spark.createDataFrame([], stream.schema))
    schema = empty.schema
    empty.write.parquet(f"{path}/data/batch=none")

    def save(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (
        stream.writeStream.foreachBatch(save).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names)
