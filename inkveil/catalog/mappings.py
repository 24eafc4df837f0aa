"""Registered queries over mapping workbooks, one per supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.catalog import inputs
from inkveil.catalog.core import Catalog, Source, in_sql, literal
from inkveil.functions.patterns import NOT_AFTER_WORD, NOT_BEFORE_WORD
from inkveil.operators import mapping as M
from inkveil.operators.dictionary import key_pattern
from inkveil.operators.ranking import numbered
from inkveil.sources.sheets import book_pairs, mapping_source

catalog = Catalog()
add = catalog.add

BOOK = ["book"]
SHEET = ["book", "sheet_no"]

SOURCE_RE = "'" + "|".join(M.SOURCE_WORDS) + "'"
TARGET_RE = "'" + "|".join(M.TARGET_WORDS) + "'"
SHEET_RE = "'" + "|".join(M.SHEET_WORDS) + "'"


def _norm(column: str) -> str:
    bare = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    return (
        f"CASE WHEN regexp_matches({bare}, '^[-() ]*[0-9][-() 0-9]*\\.0$') "
        f"THEN left({bare}, length({bare}) - 2) ELSE {bare} END"
    )


SUFFIXES = ", ".join(literal(x) for x in M.EXECUTIVE_SUFFIXES + M.COMPANY_SUFFIXES)
COMPANY = " OR ".join(f"contains(original, {literal(w)})" for w in M.COMPANY_WORDS)

# The whole preparation, step by step; a query selects from the step it shows.
STEPS = f"""
WITH cells AS ({in_sql(inputs.CELLS)}),
sheets AS (
  SELECT book, coalesce(min(sheet_no) FILTER (regexp_matches(lower(sheet), {SHEET_RE})), min(sheet_no) FILTER (is_active)) AS sheet_no
  FROM cells GROUP BY book),
chosen AS (SELECT c.* FROM cells AS c JOIN sheets AS s ON s.book = c.book AND s.sheet_no = c.sheet_no),
heads AS (
  SELECT book, min(row_no) AS header_row FROM chosen
  WHERE row_no <= 10 AND regexp_matches(lower(value), {SOURCE_RE}) GROUP BY book),
cols AS (
  SELECT c.book, h.header_row,
    max(col_no) FILTER (regexp_matches(lower(value), {SOURCE_RE})) AS source_col,
    max(col_no) FILTER (NOT regexp_matches(lower(value), {SOURCE_RE}) AND regexp_matches(lower(value), {TARGET_RE})) AS target_col
  FROM chosen AS c JOIN heads AS h ON h.book = c.book AND h.header_row = c.row_no GROUP BY c.book, h.header_row),
pairs AS (
  SELECT c.book, c.row_no AS ordinal,
    max(value) FILTER (col_no = source_col) AS original, max(value) FILTER (col_no = target_col) AS replacement
  FROM chosen AS c JOIN cols AS k ON k.book = c.book AND c.row_no > k.header_row
  WHERE source_col IS NOT NULL AND target_col IS NOT NULL AND col_no IN (source_col, target_col)
  GROUP BY c.book, c.row_no),
normal AS (
  SELECT * FROM (SELECT book, ordinal, {_norm('original')} AS original, {_norm('replacement')} AS replacement FROM pairs) AS n
  WHERE original IS NOT NULL AND original <> ''),
filled AS (SELECT book, ordinal, original, coalesce(replacement, '') AS replacement FROM normal),
direct AS (
  SELECT book, original, arg_max(replacement, ordinal) AS replacement, min(ordinal) AS ordinal FROM filled GROUP BY book, original),
swapped AS (
  SELECT book, ordinal, split_part(original, ' ', 2) || ' ' || split_part(original, ' ', 1) AS original,
    split_part(replacement, ' ', 2) || ' ' || split_part(replacement, ' ', 1) AS replacement
  FROM direct WHERE regexp_matches(original, '^\\S+ \\S+$') AND regexp_matches(replacement, '^\\S+ \\S+$')),
reversed AS (
  SELECT book, original, arg_max(replacement, ordinal) AS replacement, min(ordinal) + {1 << 40} AS ordinal
  FROM swapped AS s WHERE NOT EXISTS (SELECT 1 FROM direct AS d WHERE d.book = s.book AND d.original = s.original)
  GROUP BY book, original),
named AS (SELECT book, ordinal, original, replacement, 'direct' AS kind FROM direct
  UNION ALL SELECT book, ordinal, original, replacement, 'reversed' FROM reversed),
stripped AS (
  SELECT book, ordinal, left(original, length(original) - length(suffix)) AS original,
    CASE WHEN suffix(replacement, suffix) THEN left(replacement, length(replacement) - length(suffix)) ELSE replacement END AS replacement
  FROM named JOIN (SELECT unnest([{SUFFIXES}]) AS suffix) AS x ON suffix(original, suffix)),
base AS (
  SELECT book, original, arg_min(replacement, ordinal) AS replacement, min(ordinal) + {1 << 41} AS ordinal
  FROM stripped AS s WHERE original <> '' AND NOT EXISTS (SELECT 1 FROM named AS n WHERE n.book = s.book AND n.original = s.original)
  GROUP BY book, original),
mapping AS (SELECT * FROM named UNION ALL SELECT book, ordinal, original, replacement, 'base' FROM base)
"""


def cells(s: Source) -> DataFrame:
    return s.derived(inputs.CELLS)


def pairs(s: Source) -> DataFrame:
    return book_pairs(cells(s), BOOK)


def filled(s: Source) -> DataFrame:
    return M.blank_is_delete(M.value_normalise(pairs(s)))


def direct(s: Source) -> DataFrame:
    return M.last_value_wins(filled(s), BOOK)


def full(s: Source) -> DataFrame:
    return M.finished_mapping(pairs(s), BOOK)


@add("mapping_source", STEPS + "SELECT book, CAST(sheet_no AS BIGINT) AS sheet_no FROM sheets")
def source_sheet(s: Source) -> DataFrame:
    return mapping_source(cells(s), BOOK).select("book", F.col("sheet_no").cast("long").alias("sheet_no"))


@add("header_detect", f"""
SELECT *, CASE WHEN header_row IS NULL THEN {literal(M.NO_HEADER)} END AS problem FROM (
  SELECT book, CAST(sheet_no AS BIGINT) AS sheet_no, min(row_no) FILTER (row_no <= 10 AND regexp_matches(lower(value), {SOURCE_RE})) AS header_row
  FROM ({in_sql(inputs.CELLS)}) AS c GROUP BY book, sheet_no) AS h""")
def header_detect(s: Source) -> DataFrame:
    return M.header_detect(cells(s), SHEET).select("book", F.col("sheet_no").cast("long").alias("sheet_no"), "header_row", "problem")


@add("column_detect", f"""
WITH cells AS ({in_sql(inputs.CELLS)}),
heads AS (SELECT book, sheet_no, min(row_no) FILTER (row_no <= 10 AND regexp_matches(lower(value), {SOURCE_RE})) AS header_row FROM cells GROUP BY book, sheet_no),
cols AS (
  SELECT h.book, h.sheet_no, any_value(h.header_row) AS header_row,
    max(col_no) FILTER (regexp_matches(lower(value), {SOURCE_RE})) AS source_col,
    max(col_no) FILTER (NOT regexp_matches(lower(value), {SOURCE_RE}) AND regexp_matches(lower(value), {TARGET_RE})) AS target_col
  FROM heads AS h LEFT JOIN cells AS c ON c.book = h.book AND c.sheet_no = h.sheet_no AND c.row_no = h.header_row GROUP BY h.book, h.sheet_no)
SELECT book, CAST(sheet_no AS BIGINT) AS sheet_no, header_row, CAST(source_col AS BIGINT) AS source_col, CAST(target_col AS BIGINT) AS target_col,
  CASE WHEN header_row IS NULL THEN {literal(M.NO_HEADER)} WHEN target_col IS NULL THEN {literal(M.NO_TARGET)} END AS problem FROM cols""")
def column_detect(s: Source) -> DataFrame:
    long = [F.col(c).cast("long").alias(c) for c in ("sheet_no", "source_col", "target_col")]
    return M.column_detect(cells(s), SHEET).select("book", "header_row", "problem", *long)


@add("value_normalise", STEPS + "SELECT book, ordinal, original, replacement FROM normal")
def value_normalise(s: Source) -> DataFrame:
    return M.value_normalise(pairs(s)).select("book", "ordinal", "original", "replacement")


@add("blank_is_delete", STEPS + "SELECT book, ordinal, original, replacement FROM filled")
def blank_is_delete(s: Source) -> DataFrame:
    return filled(s).select("book", "ordinal", "original", "replacement")


@add("last_value_wins", STEPS + "SELECT book, ordinal, original, replacement FROM direct")
def last_value_wins(s: Source) -> DataFrame:
    return direct(s).select("book", "ordinal", "original", "replacement")


@add("reverse_names", STEPS + "SELECT book, ordinal, original, replacement FROM reversed")
def reverse_names(s: Source) -> DataFrame:
    return M.reverse_names(direct(s), BOOK)


@add("suffix_base", STEPS + "SELECT book, ordinal, original, replacement FROM base")
def suffix_base(s: Source) -> DataFrame:
    return M.suffix_base(direct(s), BOOK)


@add("mapping_union", STEPS + "SELECT book, ordinal, original, replacement, kind FROM mapping")
def mapping_union(s: Source) -> DataFrame:
    return full(s)


@add("mapping_validate", STEPS + """
SELECT s.book, coalesce(n, 0) AS n_keys, n IS NOT NULL AS is_valid
FROM sheets AS s LEFT JOIN (SELECT book, count(*) AS n FROM mapping GROUP BY book) AS m ON m.book = s.book""")
def mapping_validate(s: Source) -> DataFrame:
    return M.mapping_validate(s.table("supplier").select(F.col("s_suppkey").alias("book")), full(s), BOOK)


@add("tier_rank", STEPS + f"""
SELECT book, original, CAST(tier AS BIGINT) AS tier,
  row_number() OVER (PARTITION BY book ORDER BY tier, length(original) DESC, ordinal) AS position
FROM (SELECT *, CASE WHEN {COMPANY} THEN 1 WHEN contains(original, ' ') THEN 2 ELSE 3 END AS tier FROM mapping) AS t""")
def tier_rank(s: Source) -> DataFrame:
    return M.tier_rank(full(s), BOOK).select("book", "original", F.col("tier").cast("long").alias("tier"), "position")


@add("longest_first", STEPS + """
SELECT book, original, row_number() OVER (PARTITION BY book ORDER BY length(original) DESC, ordinal) AS position FROM mapping""")
def longest_first(s: Source) -> DataFrame:
    return M.longest_first(full(s), BOOK).select("book", "original", "position")


@add("boundary_pattern", STEPS + """
SELECT book, original,
  CASE WHEN regexp_matches(original, '^[A-Za-z0-9]') THEN 'word' ELSE 'any' END AS left_edge,
  CASE WHEN regexp_matches(original, '[A-Za-z0-9]$') THEN 'word' ELSE 'any' END AS right_edge,
  regexp_replace(original, '([^A-Za-z0-9])', '\\\\\\1', 'g') AS escaped
FROM mapping""")
def boundary_pattern(s: Source) -> DataFrame:
    pattern = key_pattern(F.col("original"))
    escaped = F.replace(F.replace(pattern, F.lit(NOT_AFTER_WORD), F.lit("")), F.lit(NOT_BEFORE_WORD), F.lit(""))
    return full(s).select(
        "book", "original",
        F.when(F.startswith(pattern, F.lit(NOT_AFTER_WORD)), "word").otherwise("any").alias("left_edge"),
        F.when(F.endswith(pattern, F.lit(NOT_BEFORE_WORD)), "word").otherwise("any").alias("right_edge"),
        escaped.alias("escaped"),
    )


@add("casefold_lookup", STEPS + """
SELECT book, lower(original) AS lower, arg_max(original, ordinal) AS original, arg_max(replacement, ordinal) AS replacement,
  count(*) AS spellings
FROM mapping GROUP BY book, lower(original)""")
def casefold_lookup(s: Source) -> DataFrame:
    return M.casefold_lookup(full(s), BOOK).select("book", "lower", "original", "replacement", "spellings")


@add("action_label", STEPS + """
SELECT book, original, CASE WHEN replacement = '' THEN '[DELETED]' ELSE replacement END AS shown,
  CASE WHEN replacement = '' THEN 'DELETION (blank)' ELSE 'REPLACEMENT' END AS action
FROM mapping""")
def action_label(s: Source) -> DataFrame:
    return M.action_label(full(s)).select("book", "original", "shown", "action").orderBy("book", "original")


@add("mapping_sort", STEPS + """
SELECT book, original, row_number() OVER (PARTITION BY book ORDER BY original) AS position FROM mapping""")
def mapping_sort(s: Source) -> DataFrame:
    return numbered(full(s), [], "original", BOOK).select("book", "original", "position")
