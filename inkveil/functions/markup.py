"""Markup cut into runs of text and the tags between them, without losing a character.

A page is cut at its *borders*: comments, scripts, styles, declarations, block tags and link tags. What lies between two
borders is a *run*: pieces of text, and inline tags that don't interrupt them. Borders and runs in turn, and the pieces
and inline tags of each run in turn, are the page again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that begin a new run, by the kind of unit that they hold.
UNIT_KINDS = {
    "title": ["title"],
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6"],
    "paragraph": ["p"],
    "item": ["li", "dt", "dd"],
    "cell": ["td", "th", "caption"],
    "block": [
        "address", "article", "aside", "blockquote", "body", "br", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption",
        "figure", "form", "frameset", "head", "hr", "html", "legend", "link", "main", "menu", "meta", "nav", "ol", "option", "pre",
        "section", "select", "summary", "table", "tbody", "textarea", "tfoot", "thead", "tr", "ul", "header", "footer",
    ],
}
#: Elements whose units are named after them, however deep they stand inside.
EDGES = ["header", "footer"]

_QUOTED = r"""[^<>"']*(?:(?:"[^"<]*"|'[^'<]*')[^<>"']*)*"""


def _tags(names: list[str]) -> str:
    """Opening and closing tags; attributes in quotes may hold ``>``, unless their quotes don't match."""
    either = "|".join(sorted(names, key=lambda n: (-len(n), n)))
    return rf"</?(?:{either})(?:[\s/]{_QUOTED})?>|</?(?:{either})(?:[\s/][^<>]*)?>"


HIDDEN = r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<![^>]*>|<\?[^>]*>"
BORDER = rf"(?is)(?:{HIDDEN}|{_tags([n for names in UNIT_KINDS.values() for n in names] + ['a'])})"
INLINE = rf"(?is)(?:</?[a-z]{_QUOTED}>|</?[a-z][^<>]*>)"
TAG_NAME = r"(?i)^<(/?[a-z][a-z0-9]*)"
#: The target of a link tag, with its quotes if it has any.
TARGET = r"""(?is)^<a\s(?:.*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Everything up to the target, then the target, then the rest.
AROUND_TARGET = r"""(?is)^(<a\s(?:.*?\s)?href\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)(.*)$"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def borders(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(BORDER), F.lit(0))


def runs(html: Column) -> Column:
    """One more than :func:`borders`; empty where two borders touch."""
    return F.split(html, F.lit(BORDER), F.lit(-1))


def pieces(run: Column) -> Column:
    """The texts of a run, one more than its inline tags."""
    return F.split(run, F.lit(INLINE), F.lit(-1))


def inline_tags(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit(INLINE), F.lit(0))


def tag_name(tag: Column) -> Column:
    """The lower-case name, with a slash if the tag closes; empty for what is not an element."""
    return F.lower(F.regexp_extract(tag, TAG_NAME, 1))


def target(tag: Column) -> Column:
    """The target of a link tag without quotes; null if there is none."""
    found = F.regexp_extract(tag, TARGET, 1)
    quoted = found.rlike("^[\"']")
    return F.when(found == "", F.lit(None)).when(quoted, F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)


def with_target(tag: Column, change: Callable[[Column], Column]) -> Column:
    """The tag with its target changed, in the quotes it had; a bare target that can't stay bare gets some."""
    found = F.regexp_extract(tag, AROUND_TARGET, 2)
    quote = F.regexp_extract(found, "^[\"']", 0)
    to = change(target(tag))
    needed = F.when(quote != "", quote).when(to.rlike("[\\s\"'>]") | (to == ""), F.lit('"')).otherwise(F.lit(""))
    return F.when(found == "", tag).otherwise(
        F.concat(F.regexp_extract(tag, AROUND_TARGET, 1), needed, to, needed, F.regexp_extract(tag, AROUND_TARGET, 3))
    )


def woven(first: Column, second: Column) -> Column:
    """Two arrays of texts in turn as one text; ``first`` is one longer."""
    return F.array_join(F.flatten(F.zip_with(first, second, lambda a, b: F.array_compact(F.array(a, b)))), "")


def kind_of(name: Column) -> Column:
    """The kind of unit that a border tag begins; null for a link tag, ``block`` for closing tags and all else."""
    chosen = F.when(name.isin("a", "/a") | (name == ""), F.lit(None).cast("string"))
    for kind, names in UNIT_KINDS.items():
        if kind != "block":
            chosen = chosen.when(name.isin(*names), F.lit(kind))
    return chosen.otherwise(F.lit("block"))
