"""Aggregates over file, copy and detail records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUSPICIOUS_SUFFIXES = [".docx", ".pptx", ".xlsx"]


def _outcomes() -> list[Column]:
    done = F.col("status") == "success"
    counts = [
        F.count("*").alias("files"),
        F.count_if(done).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    ]
    sums = [
        F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c)
        for c in ("replacements", "images_removed", "hyperlinks_removed")
    ]
    return counts + sums


def run_totals(files: DataFrame) -> DataFrame:
    """Totals of the run; amounts count for successes only."""
    return files.agg(*_outcomes())


def folder_stats(files: DataFrame, folder: str = "folder") -> DataFrame:
    """The same totals per folder."""
    return files.groupBy(folder).agg(*_outcomes())


def success_rate(succeeded: Column, total: Column) -> Column:
    return F.round(F.lit(100.0) * succeeded / F.greatest(total, F.lit(1)), 1)


def file_summary(details: DataFrame, key: str) -> DataFrame:
    return details.groupBy(key).agg(
        F.sum("occurrences").alias("total_replacements"), F.count("original").alias("unique_terms")
    )


def term_frequency(details: DataFrame, key: str) -> DataFrame:
    """Hits per key over all files, and the number of files it was found in."""
    return details.groupBy("original").agg(
        F.sum("occurrences").alias("hits"), F.count_distinct(key).alias("files")
    )


def suspicious_files(files: DataFrame) -> DataFrame:
    """Successes that changed nothing, which can hide a failure."""
    return files.filter(
        (F.col("status") == "success")
        & (F.col("replacements") == 0)
        & (F.col("images_removed") == 0)
        & F.lower("extension").isin(SUSPICIOUS_SUFFIXES)
    )


def integrity_status(files: DataFrame, discovered: DataFrame, copied: DataFrame) -> DataFrame:
    """Does everything that was found come out again?  Three one-row aggregates are combined."""
    suspicious = (
        (F.col("status") == "success") & (F.col("replacements") == 0) & (F.col("images_removed") == 0)
        & F.lower("extension").isin(SUSPICIOUS_SUFFIXES)
    )
    parts = [
        files.agg(
            F.count_if(F.col("status") == "success").alias("succeeded"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.count_if(suspicious).alias("suspicious"),
        ),
        discovered.agg(F.count("*").alias("discovered"), F.count_if("is_tracker").alias("trackers")),
        copied.agg(F.count("*").alias("copied")),
    ]
    names = ["succeeded", "failed", "suspicious", "discovered", "trackers", "copied"]
    rows = None
    for part in parts:
        padded = part.select(*[F.col(n) if n in part.columns else F.lit(0).cast("long").alias(n) for n in names])
        rows = padded if rows is None else rows.unionByName(padded)
    totals = rows.agg(*[F.sum(n).alias(n) for n in names])
    outputs = F.col("succeeded") + F.col("copied")
    expected = F.col("discovered") - F.col("trackers") + F.col("copied")
    matches = (outputs == expected) & (F.col("failed") == 0)
    warning = F.concat(F.lit("WARNING ("), F.col("suspicious").cast("string"), F.lit(" suspicious files)"))
    return totals.select(
        *names, outputs.alias("outputs"), expected.alias("expected"),
        F.when(~matches, "MISMATCH!").when(F.col("suspicious") > 0, warning).otherwise("VERIFIED").alias("integrity"),
    )


def error_log(files: DataFrame) -> DataFrame:
    return files.filter("error != ''").select("rel_path", "error")


def pdf_outcomes(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count_if("pdf_success").alias("pdf_successes"), F.count_if(~F.col("pdf_success")).alias("pdf_failures")
    )


def elapsed(seconds: Column) -> Column:
    """Seconds as ``Xm Ys``."""
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(minutes, F.lit("m "), F.floor(F.pmod(seconds, F.lit(60))).cast("string"), F.lit("s"))


def ranked_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def first_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before it shuffles."""
    return ranked_within(rows, by, order).filter(F.col("rank") <= n)


def top_terms(details: DataFrame, key: str) -> DataFrame:
    """All keys of a file, the most frequent first."""
    return ranked_within(details, [key], [F.desc("occurrences"), F.asc("original")])


def link_category(host: Column, scheme_less: Column) -> Column:
    """Cloud-drive link, other site, or a link within the same collection."""
    return (
        F.when(scheme_less, "internal navigation")
        .when(host.rlike(r"(^|\.)(docs|drive)\."), "cloud drive")
        .otherwise("company site")
    )
