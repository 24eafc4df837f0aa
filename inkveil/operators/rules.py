"""Image rules: folders whose files lose their images whatever the run's default says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.texts import normalised_path


def rule_list_parse(lists: DataFrame, column: str) -> DataFrame:
    """One row per entry of a comma-separated list; blank entries are dropped."""
    return lists.withColumn("rule", F.explode(F.split(column, ","))).withColumn(
        "rule", normalised_path(F.col("rule"))
    ).filter("rule != ''")


def image_rule_prefix(
    files: DataFrame, rules: DataFrame, path: str = "rel_path", whole_folders: bool = False
) -> DataFrame:
    """Add ``rule_match``: the path begins with a rule.

    Instead of comparing every file with every rule, a path offers its own beginnings, in the lengths
    that rules have, to an equi-join.  ``whole_folders`` asks for a ``/`` after the rule.
    """
    wanted = rules.select(normalised_path(F.col("rule")).alias("rule")).distinct()
    sizes = [r[0] for r in wanted.select(F.length("rule")).distinct().collect()]  # at most a path length
    clean = normalised_path(F.col(path))
    starts = F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda n: n <= F.length(clean))
    if whole_folders:
        starts = F.filter(starts, lambda n: F.substring(clean, n + 1, F.lit(1)).isin("/", ""))
    offered = files.select(path, F.explode(starts).alias("n")).select(
        path, F.substring(clean, F.lit(1), F.col("n")).alias("rule")
    )
    return _flagged(files, offered, wanted, path)


def image_rule_folder(files: DataFrame, rules: DataFrame, folder: str = "folder") -> DataFrame:
    """Add ``rule_match``: the folder is a rule or ends with ``/rule``."""
    wanted = rules.select(normalised_path(F.col("rule")).alias("rule")).distinct()
    parts = F.split(normalised_path(F.col(folder)), "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"),
    )
    folders = files.select(folder).distinct()
    return _flagged(files, folders.select(folder, F.explode(tails).alias("rule")), wanted, folder)


def _flagged(files: DataFrame, offered: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    matched = offered.join(wanted, "rule", "left_semi").select(key).distinct()
    return files.join(matched.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "rule_match", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def image_decision(rule_match: Column, default: Column) -> Column:
    """A rule turns image removal on; otherwise the default of the run decides."""
    return rule_match | default


def rule_override_flag(decision: Column, default: Column) -> Column:
    return decision != default
