"""Preparing a mapping: from raw spreadsheet cells to distinct, ordered keys.

Every step takes ``by``, the columns that tell one mapping from another, so many mapping sheets can be
prepared in one job.  ``ordinal`` keeps the order of the sheet: derived rows follow all direct rows,
reversed names before base names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.texts import normalised_value, strip
from inkveil.operators.ranking import numbered

# Words that mark a sheet, a source column and a target column.
SHEET_WORDS = ["tracker", "anonymization", "mapping", "aliases"]
SOURCE_WORDS = ["original", "real", "actual", "before"]
TARGET_WORDS = ["replacement", "anonymized", "alias", "after"]
HEADER_ROWS = 10
NO_HEADER = "no header row in the first ten rows"
NO_TARGET = "no replacement column in the header row"

# Endings that are dropped to derive a base name.
EXECUTIVE_SUFFIXES = [
    ", CEO",
    ", CFO",
    ", COO",
    ", CTO",
    ", Chief Executive Officer",
    ", Chief Financial Officer",
    ", Chief Operating Officer",
    ", Chief Technology Officer",
    ", Chief Legal Officer",
    ", Vice President",
    ", Director",
    ", President",
    ", Chief Accounting Officer and Controller",
    ", Chief Legal Officer & Corporate Secretary",
]
COMPANY_SUFFIXES = [
    " Inc.",
    " Corp.",
    " Corporation",
    " LLC",
    " L.L.C.",
    " Ltd.",
    " Limited",
    " Co.",
    " Company",
]
# Company words that put a key into the first tier.
COMPANY_WORDS = ["Inc.", "Corp.", "Corporation", "LLC", "L.L.C.", "Ltd.", "Limited", "Co.", "Company"]

_REVERSED_FROM = 1 << 40
_BASE_FROM = 1 << 41


def holds_any(value: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(value).rlike("|".join(words)), F.lit(False))


def heading_columns() -> tuple[Column, Column]:
    """The last source and the last target column among cells, as aggregates; a source heading is never a target."""
    source = holds_any(F.col("value"), SOURCE_WORDS)
    target = ~source & holds_any(F.col("value"), TARGET_WORDS)
    return F.max(F.when(source, F.col("col_no"))), F.max(F.when(target, F.col("col_no")))


def header_detect(cells: DataFrame, by: list[str]) -> DataFrame:
    """The first of the top ten rows with a source heading; a sheet without one gets a ``problem`` instead."""
    heading = (F.col("row_no") <= HEADER_ROWS) & holds_any(F.col("value"), SOURCE_WORDS)
    found = cells.groupBy(*by).agg(F.min(F.when(heading, F.col("row_no"))).alias("header_row"))
    return found.withColumn("problem", F.when(F.col("header_row").isNull(), NO_HEADER))


def column_detect(cells: DataFrame, by: list[str]) -> DataFrame:
    """The last source and the last target column of the header row; a source cell is never a target.

    Every sheet has a row. ``problem`` says why a sheet gives no mapping: no header row, or no target column in it.
    """
    source, target = heading_columns()
    top = F.when(F.col("row_no") <= HEADER_ROWS, F.col("row_no"))
    headings = cells.groupBy(*by, top.alias("_row")).agg(source.alias("source_col"), target.alias("target_col"))
    # rows below the top ones share one group, whose headings don't count
    row = F.when(F.col("source_col").isNotNull(), F.col("_row"))
    first = F.min(F.when(row.isNotNull(), F.struct(row.alias("row"), "source_col", "target_col")))
    found = headings.groupBy(*by).agg(first.alias("_head")).select(
        *by, F.col("_head.row").alias("header_row"), "_head.source_col", "_head.target_col"
    )
    problem = F.when(F.col("header_row").isNull(), NO_HEADER).when(F.col("target_col").isNull(), NO_TARGET)
    return found.withColumn("problem", problem)


def rejected_sheets(cells: DataFrame, by: list[str]) -> DataFrame:
    """The sheets that give no mapping, each with its problem."""
    return column_detect(cells, by).filter("problem is not null").select(*by, "problem")


def raw_pairs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Source and target cell of each row below the header; :func:`rejected_sheets` lists the sheets that have none."""
    heads = column_detect(cells, by).filter("problem is null").drop("problem")
    placed = cells.join(heads, by).filter(
        (F.col("row_no") > F.col("header_row")) & F.col("col_no").isin(F.col("source_col"), F.col("target_col"))
    )
    return placed.groupBy(*by, F.col("row_no").cast("long").alias("ordinal")).agg(
        F.max(F.when(F.col("col_no") == F.col("source_col"), F.col("value"))).alias("original"),
        F.max(F.when(F.col("col_no") == F.col("target_col"), F.col("value"))).alias("replacement"),
    )


def value_normalise(pairs: DataFrame) -> DataFrame:
    """Normalise both sides and skip rows without an original."""
    return pairs.withColumns(
        {
            "original": normalised_value(F.col("original")),
            "replacement": normalised_value(F.col("replacement")),
        }
    ).filter("original is not null and original != ''")


def blank_is_delete(pairs: DataFrame) -> DataFrame:
    """A missing or blank replacement deletes the key from the text."""
    return pairs.withColumn("replacement", F.coalesce(strip(F.col("replacement")), F.lit("")))


def last_value_wins(pairs: DataFrame, by: list[str]) -> DataFrame:
    """A repeated original keeps its first place and its last replacement."""
    return pairs.groupBy(*by, "original").agg(
        F.max_by("replacement", "ordinal").alias("replacement"), F.min("ordinal").alias("ordinal")
    )


KINDS = ["direct", "reversed", "base"]
_OFFER = "struct<ordinal:long,original:string,replacement:string,kind:int>"


def with_reversed(direct: DataFrame, by: list[str]) -> DataFrame:
    """Direct rows, and ``first second`` also as ``second first`` where both sides are two words."""

    def swapped(name: str) -> Column:
        words = F.split(strip(F.col(name)), r"(?U)\s+")
        two = (F.size(words) == 2) & F.contains(F.col(name), F.lit(" "))
        return F.when(two, F.concat(words[1], F.lit(" "), words[0]))

    original, replacement = swapped("original"), swapped("replacement")
    offer = F.struct(F.col("ordinal") + _REVERSED_FROM, original, replacement, F.lit(1)).cast(_OFFER)
    own = F.struct("ordinal", "original", "replacement", F.lit(0)).cast(_OFFER)
    offers = F.when(original.isNotNull() & replacement.isNotNull(), F.array(own, offer)).otherwise(F.array(own))
    offered = direct.select(*by, F.inline(offers))
    return _earlier_kind_wins(offered, by, last_value=True)


def with_bases(named: DataFrame, by: list[str]) -> DataFrame:
    """Keys with a title or company ending also without it; the first producer of a base wins."""
    suffixes = F.array(*[F.lit(s) for s in EXECUTIVE_SUFFIXES + COMPANY_SUFFIXES])
    original, replacement = F.col("original"), F.col("replacement")

    def without(value: Column, suffix: Column) -> Column:
        return F.substring(value, F.lit(1), F.length(value) - F.length(suffix))

    def base(suffix: Column) -> Column:
        kept = F.when(F.endswith(replacement, suffix), without(replacement, suffix)).otherwise(replacement)
        return F.struct(F.col("ordinal") + _BASE_FROM, without(original, suffix), kept, F.lit(2)).cast(_OFFER)

    found = F.filter(suffixes, lambda s: F.endswith(original, s) & (F.length(original) > F.length(s)))
    own = F.array(F.struct("ordinal", "original", "replacement", "kind").cast(_OFFER))
    offers = F.concat(own, F.transform(found, base))
    return _earlier_kind_wins(named.select(*by, F.inline(offers)), by, last_value=False)


def _earlier_kind_wins(offered: DataFrame, by: list[str], last_value: bool) -> DataFrame:
    """One row per original: its first place in the earliest kind, with the first or last value there."""
    first = F.struct("kind", "ordinal")
    last = F.struct(-F.col("kind"), F.col("ordinal"))
    value = F.max_by("replacement", last) if last_value else F.min_by("replacement", first)
    return offered.groupBy(*by, "original").agg(
        value.alias("replacement"), F.min(first).alias("_first")
    ).select(*by, "_first.ordinal", "original", "replacement", "_first.kind")


def reverse_names(direct: DataFrame, by: list[str]) -> DataFrame:
    """Only the reversed names that a mapping gains."""
    return with_reversed(direct, by).filter("kind = 1").drop("kind")


def suffix_base(direct: DataFrame, by: list[str]) -> DataFrame:
    """Only the base names that a mapping gains, after its reversed names."""
    return with_bases(with_reversed(direct, by), by).filter("kind = 2").drop("kind")


def mapping_union(direct: DataFrame, by: list[str]) -> DataFrame:
    """Direct, reversed and base rows; an earlier kind wins."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return with_bases(with_reversed(direct, by), by).withColumn("kind", F.get(names, F.col("kind")))


def load_mapping(cells: DataFrame, by: list[str]) -> DataFrame:
    """From the cells of one sheet per ``by`` group to the finished mapping."""
    return finished_mapping(raw_pairs(cells, by), by)


def finished_mapping(pairs: DataFrame, by: list[str]) -> DataFrame:
    """From pairs of cells to the finished mapping."""
    return mapping_union(last_value_wins(blank_is_delete(value_normalise(pairs)), by), by)


def mapping_validate(books: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """Number of keys for each expected mapping, with a flag for the empty ones."""
    counted = mapping.groupBy(*by).agg(F.count("*").alias("n"))
    return books.join(counted, by, "left").select(
        *by, F.coalesce("n", F.lit(0)).alias("n_keys"), F.col("n").isNotNull().alias("is_valid")
    )


def require_mapping(mapping: DataFrame) -> DataFrame:
    """Fail early when a mapping has no key at all."""
    if mapping.isEmpty():
        raise ValueError("no valid mapping rows: check the source and target columns")
    return mapping


def tier(original: Column) -> Column:
    company = F.lit(False)
    for word in COMPANY_WORDS:
        company = company | F.contains(original, F.lit(word))
    return F.when(company, 1).when(F.contains(original, F.lit(" ")), 2).otherwise(3)


def tier_rank(mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Company names, then phrases, then single words; the longest first within a tier."""
    ranked = mapping.withColumn("tier", tier(F.col("original")))
    return numbered(ranked, [F.col("tier"), -F.length("original")], "ordinal", by)


def longest_first(mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The order in which keys are tried at one place of a text."""
    return numbered(mapping, [-F.length("original")], "ordinal", by)


def casefold_lookup(mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per lower-cased key; of keys that differ only in case the last one counts."""
    last = F.max_by(F.struct("original", "replacement"), "ordinal")
    return (
        mapping.groupBy(*(by or []), F.lower("original").alias("lower"))
        .agg(last.alias("last"), F.max("ordinal").alias("ordinal"), F.count("*").alias("spellings"))
        .select(*(by or []), "lower", "last.original", "last.replacement", "ordinal", "spellings")
    )


def action_label(mapping: DataFrame) -> DataFrame:
    """How the mapping reads in a report."""
    blank = F.col("replacement") == ""
    return mapping.select(
        "*",
        F.when(blank, "[DELETED]").otherwise(F.col("replacement")).alias("shown"),
        F.when(blank, "DELETION (blank)").otherwise("REPLACEMENT").alias("action"),
    )
