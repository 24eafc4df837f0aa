"""Writing scrubbed units and report tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

REPORT_TABLES = [
    "file_details", "folder_summary", "run_summary", "error_log",
    "mappings", "copied_files", "detailed_replacements",
]


def write_scrubbed(units: DataFrame, path: str, partition: str = "top_folder") -> None:
    """One folder per top folder, so that a later read of one folder skips the others.

    Rows are rebalanced by folder first: adaptive execution puts small folders into one task and splits a large one by its
    measured bytes, so the number of files follows the folders and the bytes, not the tasks that found the units.
    """
    units.hint("rebalance", partition).write.partitionBy(partition).parquet(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One table per report sheet below ``path``; the tables are written side by side."""
    unknown = set(tables) - set(REPORT_TABLES)
    if unknown:
        raise ValueError(f"not a report table: {sorted(unknown)}")

    def write(name: str) -> None:
        tables[name].write.format(fmt).option("header", True).save(f"{path}/{name}")

    with ThreadPoolExecutor(len(REPORT_TABLES)) as pool:
        list(pool.map(write, tables))


def read_report(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).option("header", True).load(f"{path}/{name}")
