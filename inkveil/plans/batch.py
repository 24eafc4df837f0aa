"""The end of a run: reconcile files with their outputs and build the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.texts import file_name, file_suffix, parent_folder
from inkveil.operators.mapping import action_label
from inkveil.operators.reconcile import details_to_mapping, in_out_reconcile
from inkveil.operators.report import error_log, folder_stats, run_totals, success_rate
from inkveil.session import written
from inkveil.sources.files import copy_manifest


def report_tables(
    files: DataFrame, outputs: DataFrame, details: DataFrame, mapping: DataFrame, output_root: str
) -> dict[str, DataFrame]:
    """The seven tables of the report. ``details`` holds ``rel_path, original, occurrences``.

    Four tables come from the reconciled files, which are written once and read back column by column.
    """
    path = F.col("rel_path")
    checked = written(in_out_reconcile(files, outputs).withColumns(
        {"folder": parent_folder(path), "filename": file_name(path), "extension": F.lower(file_suffix(path))}
    ), "reconciled")
    rate = success_rate(F.col("succeeded"), F.col("files")).alias("success_rate")
    return {
        "file_details": checked.select(
            "rel_path", "folder", "filename", "extension", "status", "replacements", "images_removed",
            "hyperlinks_removed", F.round("processing_time", 2).alias("processing_time"), "error",
        ),
        "folder_summary": folder_stats(checked).select("*", rate),
        "run_summary": run_totals(checked).select("*", rate),
        "error_log": error_log(checked),
        "mappings": action_label(mapping).select("original", F.col("shown").alias("replacement"), "action"),
        "copied_files": copy_manifest(checked.select("rel_path", "size"), output_root),
        "detailed_replacements": details_to_mapping(details, mapping).select(
            "rel_path", parent_folder(path).alias("folder"), file_name(path).alias("filename"),
            "original", "replacement", "occurrences",
        ),
    }
