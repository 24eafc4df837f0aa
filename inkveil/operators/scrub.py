"""Removing structure that can identify its source: links, images, headers, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import markup, redaction
from inkveil.functions.texts import strip
from inkveil.operators.dictionary import Dictionary
from inkveil.operators.ranking import numbered
from inkveil.operators.redact import with_entries
from inkveil.session import written

# Properties that are blanked, per kind of document.
DOCUMENT_PROPS = [
    "author", "last_modified_by", "title", "subject", "keywords", "comments", "category",
    "content_status", "identifier", "language", "company", "creator",
]
SHEET_PROPS = [
    "creator", "last_modified_by", "title", "subject", "keywords", "description", "category",
    "content_status", "identifier", "company", "manager",
]
SLIDE_PROPS = [
    "author", "last_modified_by", "title", "subject", "keywords", "comments", "category",
    "content_status", "identifier", "company",
]

IMAGE_TAG = r"""(?is)^<img(?:[\s/].*)?>$"""
EDGE_ELEMENT = r"(?is)<(?:header|footer)\b[^>]*>(.*?)</(?:header|footer)>"
TAG = r"(?is)<[^>]*>"
#: Properties of a page: the content of its named meta tags, whichever of the two attributes comes first.
_NAMED = rf"""name\s*=\s*["']?(?:{"|".join(DOCUMENT_PROPS)})["']?"""
PAGE_PROPS = [
    rf"""(?i)(<meta\s(?:[^<>]*\s)?{_NAMED}\s(?:[^<>]*\s)?content\s*=\s*)("[^"]+"|'[^']+'|[^\s"'>]+)""",
    rf"""(?i)(<meta\s(?:[^<>]*\s)?content\s*=\s*)("[^"]+"|'[^']+'|[^\s"'>]+)((?:\s[^<>]*)?\s{_NAMED}[\s/>])""",
]
#: Kinds of documents whose images go; sheets keep theirs.
IMAGE_KINDS = ("document", "slides")


def _has_target(tag: Column) -> Column:
    return markup.target(tag).isNotNull()


def link_count(html: Column) -> Column:
    """Links with a target, however it is quoted."""
    return F.size(F.filter(markup.borders(html), _has_target)).cast("long")


def _without_links(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.when(markup.tag_name(t).isin("a", "/a"), F.lit("")).otherwise(t))


def unlink_doc(pages: DataFrame, html: str = "html") -> DataFrame:
    """Unwrap link elements, keep their text, count the links that had a target."""
    return pages.withColumns(
        {
            "links_removed": link_count(F.col(html)),
            html: markup.woven(markup.runs(F.col(html)), _without_links(markup.borders(F.col(html)))),
        }
    )


def unlink_cells(cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells without link targets, and the number of targets dropped per group."""
    counts = cells.groupBy(*by).agg(F.count("url").alias("links_removed"))
    return cells.withColumn("url", F.lit(None).cast("string")), counts


def unlink_shapes(shapes: DataFrame) -> DataFrame:
    """Drop the targets of run links and click actions; grouped shapes are left alone."""
    applies = F.col("kind").isin("run", "click_action") & (F.col("shape_type") != "group")
    return shapes.withColumns(
        {
            "removed": (applies & F.col("url").isNotNull()).cast("long"),
            "url": F.when(~applies, F.col("url")),
        }
    )


def drop_images_doc(units: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Remove all drawings; only those that hold a picture are counted."""
    drawing = F.col("unit_kind") == "drawing"
    counts = units.groupBy(*by).agg(
        F.count_if(drawing & F.col("has_picture")).alias("images_removed"), F.count_if(drawing).alias("drawings_removed")
    )
    return units.filter(~drawing), counts


def drop_images_slides(shapes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Remove top-level pictures and count each."""
    picture = (F.col("shape_type") == "picture") & (F.col("depth") == 0)
    return shapes.filter(~picture), shapes.groupBy(*by).agg(F.count_if(picture).alias("images_removed"))


def clear_headers_footers(units: DataFrame) -> DataFrame:
    """Blank header and footer units in all sections; non-blank ones count as cleared."""
    edge = F.col("unit_kind").isin("header", "footer")
    return units.withColumns(
        {
            "cleared": (edge & (strip(F.coalesce("text", F.lit(""))) != "")).cast("long"),
            "text": F.when(edge, F.lit("")).otherwise(F.col("text")),
        }
    )


def edge_count(html: Column) -> Column:
    """Header and footer elements that hold more than blanks."""
    inner = F.regexp_extract_all(html, F.lit(EDGE_ELEMENT), F.lit(1))
    return F.size(F.filter(inner, lambda x: strip(F.regexp_replace(x, TAG, "")) != "")).cast("long")


def strip_props(docs: DataFrame, fields: list[str], props: str = "props") -> DataFrame:
    """Blank the listed properties, restart the revision and drop the version."""
    cleaned = F.col(props)
    for name in fields:
        cleaned = cleaned.withField(name, F.lit(""))
    cleaned = cleaned.withField("revision", F.lit(1)).withField("version", F.lit(None).cast("string"))
    return docs.withColumn(props, cleaned)


def strip_props_doc(docs: DataFrame) -> DataFrame:
    return strip_props(docs, DOCUMENT_PROPS)


def strip_props_sheet(docs: DataFrame) -> DataFrame:
    return strip_props(docs, SHEET_PROPS)


def strip_props_slides(docs: DataFrame) -> DataFrame:
    return strip_props(docs, SLIDE_PROPS)


def name_dedupe(names: DataFrame, by: list[str], old: str, new: str, ordinal: str) -> DataFrame:
    """``final_name``: unique in each ``by`` group, whatever its case.

    A name goes to the row that had it before, else to the first row that wants it. The others get the least numbers, in their order,
    that make a name nobody wants: ``name_1``, ``name_2`` and so on.
    """
    kept = (F.col(old) == F.col(new)).cast("int")
    keyed = names.withColumns({"_name": F.lower(new), "_first": -F.coalesce(kept, F.lit(0))})
    ranked = numbered(keyed, [F.col("_first")], ordinal, [*by, "_name"], "_place")
    # numbers that some wanted name already has behind another wanted name, and how many free ones are before each
    number = F.regexp_extract("_name", r"^.*_([1-9][0-9]{0,17})$", 1)
    taken = ranked.where("_place = 1").select(*by, F.regexp_extract("_name", r"^(.*)_[1-9][0-9]{0,17}$", 1).alias("_name"), number.alias("_number"))
    taken = taken.where("_number <> ''").select(*by, "_name", F.col("_number").cast("long").alias("_number"))
    taken = numbered(taken, [], "_number", [*by, "_name"], "_nth").select(*by, "_name", (F.col("_number") - F.col("_nth") + 1).alias("_value"))
    losers = ranked.where("_place > 1").select(*by, "_name", (F.col("_place") - 1).alias("_value"))
    # the r-th loser takes the r-th free number, which is its place among losers and the taken numbers up to it
    events = taken.withColumn("_loser", F.lit(0)).unionByName(losers.withColumn("_loser", F.lit(1)))
    events = numbered(events, [F.col("_value"), F.col("_loser")], "_value", [*by, "_name"], "_suffix").where("_loser = 1")
    found = events.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_name").alias("_of"), (F.col("_value") + 1).alias("_at"), "_suffix")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    final = ranked.join(found, [*same, F.col("_name").eqNullSafe(F.col("_of")), F.col("_place") == F.col("_at")], "left")
    suffixed = F.concat(F.col(new), F.lit("_"), F.col("_suffix").cast("string"))
    return final.select(*names.columns, F.coalesce(suffixed, F.col(new)).alias("final_name"))


def strip_page_props(pages: DataFrame, html: str = "html") -> DataFrame:
    """Blank the content of the meta tags that name a property; those that held something count in ``props_cleared``."""
    first, second = (F.lit(p) for p in PAGE_PROPS)
    text = F.col(html)
    return pages.withColumns(
        {
            "props_cleared": (F.regexp_count(text, first) + F.regexp_count(text, second)).cast("long"),
            html: F.regexp_replace(F.regexp_replace(text, first, F.lit('$1""')), second, F.lit('$1""$3')),
        }
    )


def _found_in(df: DataFrame, dictionary: Dictionary, texts: str, found: str) -> DataFrame:
    """Add ``found``: for each text of the array ``texts``, its parts with the entry of each match.

    A dictionary that is one pattern needs no shuffle. For a large one the texts become rows of a written table.
    """
    if dictionary.index is None:
        nothing = F.lit(None).cast(redaction.LOOKUP_TYPE)

        def parts(text: Column) -> Column:
            if dictionary.is_empty:
                return F.array(F.struct(text.alias("part"), nothing.alias("entry")))
            return redaction.resolved(redaction.pieces(text, F.lit(dictionary.pattern)), dictionary.lookup)

        return df.withColumn(found, F.transform(texts, parts))
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    each = rows.select("_row", F.posexplode(texts).alias("_slot", "_text_of"))
    done = with_entries(each, dictionary, "_text_of", ["_row", "_slot"]).groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_slot", "_found"))), lambda x: x["_found"]).alias(found)
    )
    return rows.join(done, "_row", "left").drop("_row")


def _rewritten_pieces(pieces: Column, found: Column) -> Column:
    """The pieces of one run after replacement: a match goes to the piece that it begins in, and leaves those it reaches into."""

    def ends(lengths: Column) -> Column:
        return F.transform(lengths, lambda _, i: _added(F.slice(lengths, F.lit(1), i + 1)))

    def rewritten(part_ends: Column, piece_ends: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            return markup.let(F.struct((F.get(piece_ends, i) - F.length(piece)).alias("start"), F.get(piece_ends, i).alias("end")), text_of)

        def text_of(span: Column) -> Column:
            def share(x: Column, j: Column) -> Column:
                to = F.get(part_ends, j)
                at = to - F.length(x["part"])
                low, high = F.greatest(at, span["start"]), F.least(to, span["end"])
                kept = F.when(high > low, F.substring(x["part"], low - at + 1, high - low)).otherwise(F.lit(""))
                begins = (at >= span["start"]) & (at < span["end"])
                new = F.when(begins, redaction.in_case_of(x["part"], x["entry"]["replacement"])).otherwise(F.lit(""))
                return F.when(x["entry"].isNull(), kept).otherwise(new)

            return F.array_join(F.transform(found, share), "")

        return F.transform(pieces, one)

    part_lengths, piece_lengths = F.transform(found, lambda x: F.length(x["part"])), F.transform(pieces, F.length)
    many = markup.let(
        F.struct(markup.let(part_lengths, ends).alias("parts"), markup.let(piece_lengths, ends).alias("pieces")),
        lambda e: rewritten(e["parts"], e["pieces"]),
    )
    untouched = ~F.exists(found, lambda x: x["entry"].isNotNull())
    alone = F.size(F.filter(pieces, lambda p: p != "")) == 1
    # one piece with text takes it all
    single = F.transform(pieces, lambda p: F.when(p == "", p).otherwise(redaction.rewritten(found)))
    return F.when(untouched, pieces).when(alone, single).otherwise(many)


def _added(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def redact_markup(
    pages: DataFrame, dictionary: Dictionary, html: str = "html", remove_links: bool = False, remove_images: Column | bool = False
) -> DataFrame:
    """Replace keys in the text and in the link targets of pages; tags and their other attributes stay as they are.

    Inline tags don't interrupt a text: a key is found across them, its replacement stands where the key began, and the tags
    keep their places. Adds replacements, links_removed and images_removed. Null pages stay null.
    """
    cut = pages.withColumns({"_runs": markup.runs(F.col(html)), "_tags": markup.borders(F.col(html))})
    cut = cut.withColumns({"_pieces": F.transform("_runs", markup.pieces), "_targets": F.transform("_tags", markup.target)})
    stitched = F.transform("_pieces", lambda pieces: F.array_join(pieces, ""))
    targets = F.transform("_targets", lambda target: F.coalesce(target, F.lit("")))
    cut = _found_in(cut.withColumn("_texts", F.concat(stitched, targets)), dictionary, "_texts", "_all")
    n_runs = F.size("_runs")
    picture = F.lit(remove_images) if isinstance(remove_images, bool) else F.coalesce(remove_images, F.lit(False))

    def is_image(tag: Column) -> Column:
        return tag.rlike(IMAGE_TAG)

    def left(tags: Column) -> Column:
        return F.transform(tags, lambda t: F.when(picture & is_image(t), F.lit("")).otherwise(t))

    def new_run(run: Column, i: Column) -> Column:
        both = F.struct(F.get("_pieces", i).alias("pieces"), F.get("_all", i).alias("found"))
        new = markup.let(both, lambda x: _rewritten_pieces(x["pieces"], x["found"]))
        # most runs have no tags inside
        return F.when(F.size(F.get("_pieces", i)) == 1, F.get(new, F.lit(0))).otherwise(markup.woven(new, left(markup.inline_tags(run))))

    def new_tag(tag: Column, i: Column) -> Column:
        found = F.get("_all", n_runs + i)
        return F.when(F.get("_targets", i).isNull(), tag).otherwise(markup.with_target(tag, lambda _: redaction.rewritten(found)))

    new_tags = F.transform("_tags", new_tag)
    images = _added(F.transform("_runs", lambda run: F.size(F.filter(markup.inline_tags(run), is_image))))
    n_links = F.size(F.filter("_targets", lambda t: t.isNotNull())).cast("long")
    zero = F.lit(0).cast("long")
    replaced = _added(F.transform("_all", lambda found: redaction.hit_count(found).cast("int")))
    done = cut.withColumns(
        {
            html: markup.woven(F.transform("_runs", new_run), _without_links(new_tags) if remove_links else new_tags),
            "replacements": F.coalesce(replaced, F.lit(0)).cast("long"),
            "links_removed": F.coalesce(n_links, zero) if remove_links else zero,
            "images_removed": F.coalesce(F.when(picture, images), F.lit(0)).cast("long"),
        }
    )
    return done.drop("_runs", "_tags", "_pieces", "_targets", "_texts", "_all")


def scrub_pipeline(
    pages: DataFrame, dictionary: Dictionary, html: str = "html", remove_links: bool = False, remove_images: bool = True,
    clear_edges: bool = False, kind: str | None = None,
) -> DataFrame:
    """Redact, then unlink, then drop images, then clear headers and footers, and blank properties last.

    ``kind`` names a column with the kind of document; images go only from those in ``IMAGE_KINDS``.
    """
    images = F.col(kind).isin(*IMAGE_KINDS) if remove_images and kind else remove_images
    done = redact_markup(pages, dictionary, html, remove_links, images)
    done = done.withColumn("edges_cleared", F.coalesce(edge_count(F.col(html)), F.lit(0)).cast("long") if clear_edges else F.lit(0).cast("long"))
    if clear_edges:
        done = done.withColumn(html, F.regexp_replace(html, EDGE_ELEMENT, ""))
    return strip_page_props(done, html)
