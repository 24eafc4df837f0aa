"""Joining the runs of a paragraph so that keys which span runs are found.

Runs are joined in blocks of at most ``block`` runs, and each block is cut after its last place where no key can reach
across: right after a character that is neither alphanumeric nor inside or at the start of any key. What follows that
place is carried to the next block that has one, so the blocks of a paragraph hold exactly the matches of the whole, and
a hot paragraph is redacted by many tasks. The redacted blocks are put together again: one row per paragraph, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.patterns import escape
from inkveil.operators.dictionary import Dictionary
from inkveil.operators.redact import redact

BLOCK = 10_000


def cut_pattern(dictionary: Dictionary) -> str:
    """Everything up to the last safe cut, then the rest."""
    barred = "".join(escape(c) for c in dictionary.open_chars)
    return rf"(?isu)^(.*[^\p{{L}}\p{{N}}İıſK{barred}])(.*)$"


def joined_text(parts: Column, order: str, text: str) -> Column:
    """Texts of collected ``struct(order, text)`` rows in their order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x[text]), "")


def stitched(
    runs: DataFrame, dictionary: Dictionary, by: list[str], order: str = "run_no", text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """The texts of each paragraph as parts that no key reaches across, numbered by ``part_no``."""
    run = F.struct(order, text)
    blocks = runs.groupBy(*by, F.floor(F.col(order) / block).alias("part_no")).agg(
        joined_text(F.collect_list(run), order, text).alias("_text")
    )
    cut = blocks.withColumn("_head", F.regexp_extract("_text", cut_pattern(dictionary), 1)).select(
        *by, "part_no", "_head", F.substring("_text", F.length("_head") + 1, F.length("_text")).alias("_tail")
    )
    # Only tails go through this window: a few characters of each block, unless it has no place to cut. The next block
    # with such a place takes them, or else a part behind the last block.
    later = W.partitionBy(*by).orderBy("part_no").rowsBetween(1, W.unboundedFollowing)
    last = F.max("part_no").over(W.partitionBy(*by))
    to = F.coalesce(F.min(F.when(F.col("_head") != "", F.col("part_no"))).over(later), last + 1)
    tails = cut.select(*by, "part_no", "_tail", to.alias("_to")).filter("_tail != ''")
    tails = tails.groupBy(*by, "_to").agg(joined_text(F.collect_list(F.struct("part_no", "_tail")), "part_no", "_tail").alias("_carried"))
    heads = cut.filter("_head != '' or _tail = ''").select(*by, "part_no", "_head")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    both = heads.alias("l").join(tails.alias("r"), [*same, F.col("part_no") == F.col("_to")], "full")
    whole = F.concat(F.coalesce("_carried", F.lit("")), F.coalesce("_head", F.lit("")))
    return both.select(
        *[F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in by], F.coalesce("part_no", "_to").alias("part_no"), whole.alias(text)
    )


def run_stitch(
    runs: DataFrame, dictionary: Dictionary, by: list[str], order: str = "run_no", text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Stitch the runs of each paragraph and redact the stitched text: one row per paragraph, as if it were redacted whole."""
    parts = redact(stitched(runs, dictionary, by, order, text, block), dictionary, text, [*by, "part_no"])
    pieces = F.collect_list(F.struct("part_no", "redacted"))
    return parts.groupBy(*by).agg(joined_text(pieces, "part_no", "redacted").alias("redacted"), F.sum("replacements").alias("replacements"))


def link_run_split(
    runs: DataFrame, dictionary: Dictionary, by: list[str], order: str = "run_no", text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Paragraphs with a link keep their runs apart; all others are stitched."""
    linked = runs.filter("in_link").select(*by).distinct()
    apart = redact(
        runs.join(linked, by, "left_semi").select(*by, F.col(order).alias("part_no"), text),
        dictionary, text, [*by, "part_no"],
    )
    whole = run_stitch(runs.join(linked, by, "left_anti"), dictionary, by, order, text, block)
    return apart.drop(text).unionByName(whole.withColumn("part_no", F.lit(0).cast("long")))


def first_format(runs: DataFrame, by: list[str], formats: list[str], order: str = "run_no") -> DataFrame:
    """The format of the first run, which the rewritten paragraph keeps."""
    first = F.min_by(F.struct(*formats), order)
    return runs.groupBy(*by).agg(first.alias("_format")).select(*by, *[f"_format.{f}" for f in formats])
