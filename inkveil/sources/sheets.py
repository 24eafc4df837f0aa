"""Finding the sheet that holds a mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.mapping import HEADER_ROWS, SHEET_WORDS, heading_columns, holds_any


def mapping_source(cells: DataFrame, by: list[str]) -> DataFrame:
    """The first sheet whose name speaks of a mapping, else the active one."""
    named = F.min(F.when(holds_any(F.col("sheet"), SHEET_WORDS), F.col("sheet_no")))
    active = F.min(F.when(F.col("is_active"), F.col("sheet_no")))
    return cells.groupBy(*by).agg(F.coalesce(named, active).alias("sheet_no"))


def mapping_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """The cells of the chosen sheet of each workbook."""
    return cells.join(mapping_source(cells, by), [*by, "sheet_no"], "left_semi")


def book_pairs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Source and target cell of each mapping row of each workbook: sheet, header row and columns are found in one shuffle of the cells.

    The same as :func:`raw_pairs` of :func:`mapping_cells`; everything after the rows of the sheets works on a few values per sheet.
    """
    source, target = heading_columns()
    rows = cells.groupBy(*by, "sheet_no", "row_no").agg(
        F.max("sheet").alias("_sheet"), F.max("is_active").alias("_active"), F.collect_list(F.struct("col_no", "value")).alias("_cells"),
        source.alias("_source"), target.alias("_target"),
    )
    heading = (F.col("row_no") <= HEADER_ROWS) & F.col("_source").isNotNull()
    sheets = rows.groupBy(*by, "sheet_no").agg(
        F.max("_sheet").alias("_sheet"), F.max("_active").alias("_active"),
        F.min(F.when(heading, F.struct("row_no", "_source", "_target"))).alias("_head"),
    )
    sheet = F.struct("sheet_no", "_head")
    named, active = F.min(F.when(holds_any(F.col("_sheet"), SHEET_WORDS), sheet)), F.min(F.when(F.col("_active"), sheet))
    books = sheets.groupBy(*by).agg(F.coalesce(named, active).alias("_chosen")).where("_chosen._head._target is not null")
    books = books.select(*by, "_chosen.sheet_no", F.col("_chosen._head").alias("_head"))
    placed = rows.join(books, [*by, "sheet_no"]).where("row_no > _head.row_no")

    def cell(column: Column) -> Column:
        return F.array_max(F.transform(F.filter("_cells", lambda c: c["col_no"] == column), lambda c: c["value"]))

    first, second = F.col("_head._source"), F.col("_head._target")
    held = F.exists("_cells", lambda c: (c["col_no"] == first) | (c["col_no"] == second))
    return placed.where(held).select(
        *by, F.col("row_no").cast("long").alias("ordinal"), cell(first).alias("original"), cell(second).alias("replacement")
    )
