"""Listings of a file tree and what they say about each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.texts import file_name, file_suffix, parent_folder, top_folder, with_suffix
from inkveil.operators.report import first_n

# What is redacted, and what is passed through unchanged.
DOCUMENTS = [".docx", ".doc"]
SHEETS = [".xlsx", ".xlsm", ".xls"]
SLIDES = [".pptx", ".ppt"]
PROCESSABLE = DOCUMENTS + SHEETS + SLIDES
PASS_THROUGH = [
    ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".txt",
    ".csv", ".json", ".xml", ".html", ".htm", ".zip", ".tar", ".gz",
]
SECONDS_PER_FILE = 5


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``rel_path, size, modified`` of every file below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").removeprefix("file:") + "/"
    return listed.select(
        F.element_at(F.split(F.col("path"), F.lit("\\Q" + base + "\\E"), F.lit(2)), -1).alias("rel_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def described(files: DataFrame) -> DataFrame:
    """Add file name, folders, lower-cased extension and the tracker flag to a listing."""
    path = F.col("rel_path")
    return files.withColumns(
        {
            "filename": file_name(path),
            "folder": parent_folder(path),
            "top_folder": top_folder(path),
            "extension": F.lower(file_suffix(path)),
            "is_tracker": is_tracker(path),
        }
    )


def is_tracker(path: Column) -> Column:
    return F.contains(F.lower(file_name(path)), F.lit("tracker"))


def tracker_exclusion(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are not mapping files, and how many of each there are."""
    counts = files.agg(
        F.count("*").alias("discovered"),
        F.count_if(is_tracker(F.col("rel_path"))).alias("excluded"),
    )
    return files.filter(~is_tracker(F.col("rel_path"))), counts


def file_inventory(files: DataFrame) -> DataFrame:
    """The files to redact: a known ending in any case, and not a mapping file."""
    found = described(files)
    return found.filter(F.col("extension").isin(PROCESSABLE) & ~F.col("is_tracker"))


def route(extension: Column) -> Column:
    """Which processor takes a file."""
    return (
        F.when(extension == ".docx", "docx")
        .when(extension == ".pptx", "pptx")
        .when(extension.isin(".xlsx", ".xlsm"), "xlsx")
        .when(extension == ".xls", "xls")
        .when(extension.isin(".doc", ".ppt"), "convert")
        .otherwise("skipped")
    )


def copy_manifest(files: DataFrame, output_root: str) -> DataFrame:
    """Pass-through files and where they go; files of no known kind stay visible as ``unhandled``."""
    found = described(files).filter("not is_tracker")
    kind = (
        F.when(F.col("extension").isin(PASS_THROUGH), "copied")
        .when(~F.col("extension").isin(PROCESSABLE), "unhandled")
    )
    return found.withColumn("handling", kind).filter("handling is not null").select(
        F.col("rel_path").alias("original_path"),
        F.when(F.col("handling") == "copied", F.concat(F.lit(output_root + "/"), "rel_path")).alias("output_path"),
        F.col("extension").alias("file_type"),
        "filename",
        "handling",
    )


def output_path_plan(files: DataFrame, output: str, pdf_output: str, root: str, stamp: str = "") -> DataFrame:
    """Output and PDF path of each file; an ``.xls`` is written as ``.xlsx``."""
    path = F.col("rel_path")
    legacy = F.lower(file_suffix(path)) == ".xls"
    kept = F.when(legacy, with_suffix(path, ".xlsx")).otherwise(path)
    return files.withColumns(
        {
            "output_path": F.concat_ws("/", F.lit(output), F.lit(root + stamp), kept),
            "pdf_path": F.concat_ws("/", F.lit(pdf_output), F.lit(root + stamp), with_suffix(path, ".pdf")),
        }
    )


def type_union(files: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Label each file with the kind whose endings it has; files of no kind are left out."""
    label = F.lit(None).cast("string")
    for kind, endings in kinds.items():
        label = F.when(F.col("extension").isin(endings), kind).otherwise(label)
    return described(files).withColumn("kind", label).filter("kind is not null")


def type_counts(files: DataFrame) -> DataFrame:
    """Files per kind; kinds without a file do not appear."""
    kinds = {
        "DOCX": DOCUMENTS, "XLSX": SHEETS, "PPTX": SLIDES,
        "PDF": [".pdf"], "PNG": [".png"], "JPG/JPEG": [".jpg", ".jpeg"],
    }
    return type_union(files, kinds).groupBy("kind").agg(F.count("*").alias("files"))


def folder_preview(files: DataFrame) -> DataFrame:
    """What a run would do, per top folder."""
    found = described(files)
    counted = {
        "docx": DOCUMENTS, "xlsx": SHEETS, "pptx": SLIDES,
        "pdf": [".pdf"], "png": [".png"], "jpg": [".jpg", ".jpeg"],
    }
    work = F.col("extension").isin(PROCESSABLE) & ~F.col("is_tracker")
    below = F.when(F.col("folder") != F.col("top_folder"), F.col("folder"))
    totals = found.groupBy("top_folder").agg(
        F.count_if(work).alias("file_count"),
        *[F.count_if(F.col("extension").isin(ends)).alias(f"n_{kind}") for kind, ends in counted.items()],
        F.count_distinct(below).alias("subfolders"),
    )
    firsts = first_n(found.filter(work), ["top_folder"], [F.asc("filename"), F.asc("rel_path")], 5)
    names = firsts.groupBy("top_folder").agg(F.collect_list(F.struct("rank", "filename")).alias("_names"))
    listed = F.array_join(F.transform(F.array_sort("_names"), lambda x: x["filename"]), ", ")
    return totals.join(names, "top_folder", "left").select(
        *totals.columns,
        F.coalesce(listed, F.lit("")).alias("samples"),
        F.round(F.col("file_count") * SECONDS_PER_FILE / 60, 1).alias("est_minutes"),
    )
