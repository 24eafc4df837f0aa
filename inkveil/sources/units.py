"""Flattening documents to text units, one row per piece of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import markup

_UNIT = "struct<unit_kind:string,unit_no:int,text:string,url:string,in_link:boolean>"
_BLANK = r"^[\s\x0B]*$"


def page_units(pages: DataFrame) -> DataFrame:
    """The runs of HTML pages that hold a visible character or begin a link, each page read once.

    Every visible character is in exactly one unit. ``unit_kind`` is that of the nearest block tag before the run, ``header`` or
    ``footer`` inside such an element, and ``link`` inside a link; the first unit of a link has its ``url``. ``unit_no`` counts the units
    of a page.
    """
    rows = pages.select("page_id", markup.runs(F.col("html")).alias("_runs"), markup.borders(F.col("html")).alias("_tags"))
    texts = F.transform("_runs", lambda run: F.regexp_replace(run, markup.INLINE, ""))
    names = F.transform("_tags", markup.tag_name)
    rows = rows.select("page_id", texts.alias("_texts"), "_tags", names.alias("_names"))
    state = F.struct(
        F.lit("block").alias("kind"), F.lit(False).alias("in_link"), F.lit(0).alias("header"), F.lit(0).alias("footer"),
        F.array().cast(f"array<{_UNIT}>").alias("units"),
    )

    def step(acc: Column, i: Column) -> Column:
        # the tag before the run changes the state, then the run is looked at
        name, text = F.coalesce(F.get("_names", i - 1), F.lit("")), F.get("_texts", i)
        kind = F.coalesce(markup.kind_of(name), acc["kind"])
        url = F.when(name == "a", markup.target(F.get("_tags", i - 1)))
        in_link = F.when(name == "a", F.lit(True)).when(name == "/a", F.lit(False)).otherwise(acc["in_link"])
        depth = {
            edge: F.greatest(acc[edge] + (name == edge).cast("int") - (name == f"/{edge}").cast("int"), F.lit(0)) for edge in markup.EDGES
        }
        shown = (
            F.when(in_link, F.lit("link")).when(depth["footer"] > 0, F.lit("footer")).when(depth["header"] > 0, F.lit("header")).otherwise(kind)
        )
        unit = F.array(_unit(shown, F.size(acc["units"]), text, url, in_link))
        counts = ~text.rlike(_BLANK) | url.isNotNull()
        return F.struct(
            kind.alias("kind"), in_link.alias("in_link"), depth["header"].alias("header"), depth["footer"].alias("footer"),
            F.when(counts, F.concat(acc["units"], unit)).otherwise(acc["units"]).alias("units"),
        )

    found = F.aggregate(F.sequence(F.lit(0), F.size("_texts") - 1), state, step)["units"]
    return rows.where(F.col("_texts").isNotNull()).select("page_id", F.inline(found))


def document_units(documents: DataFrame) -> DataFrame:
    """The lines of plain documents."""
    lines = F.transform(
        F.split("text", "\n"), lambda text, at: _unit(F.lit("line"), at, text, F.lit(None), F.lit(False))
    )
    return documents.select("doc_id", F.inline(lines))


def conversation_units(turns: DataFrame) -> DataFrame:
    """The turns of conversations, as the runs of one paragraph."""
    return turns.select(
        "conv_id", F.lit("turn").alias("unit_kind"), F.col("role").alias("container"),
        F.col("turn").alias("run_no"), "text",
    )


def _unit(kind: Column, number: Column, text: Column, url: Column, in_link: Column) -> Column:
    return F.struct(
        kind.alias("unit_kind"), number.alias("unit_no"), text.alias("text"),
        url.cast("string").alias("url"), in_link.alias("in_link"),
    ).cast(_UNIT)
