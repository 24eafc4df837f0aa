"""Markup: runs and borders are the page again, every visible character is in one unit, and scrubbing changes texts only."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.functions import markup
from inkveil.operators import scrub
from inkveil.operators.dictionary import Dictionary
from inkveil.sources.units import page_units

PAGE = "page_id long, html string"
MAPPING = "ordinal long, original string, replacement string"
FORMS = [{}, {"max_keys": 0}]


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), PAGE)


def units(spark, html):
    return [tuple(r)[1:] for r in page_units(pages(spark, html)).orderBy("unit_no").collect()]


def dictionary(spark, rows, form=None):
    return Dictionary.build(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MAPPING), **(form or {}))


def random_page(rng):
    parts = [
        "<p>", "</p>", '<p class="a>b">', "<div>", "</div>", "<li>", "<b>", "</b>", "<i title='x > y'>", "</i>", "<br/>", "<a href='/u v'>", "</a>",
        '<a class="c" href="/w">', "<a HREF=/bare>", "<a>", "<!-- no <p> -->", "<script>if (a<b) p()</script>", "<style>p{}</style>", "<", ">", '"',
        "<footer>", "</footer>", "<header>", "</header>", "<h2>", "text ", "Jane", " Roe", "ä", "\n", "<a href=\"/open", "<img src='x'>", "&amp;",
    ]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_nothing_is_lost(spark):
    rng = random.Random(3)
    htmls = [random_page(rng) for _ in range(400)] + ["", "no tags", "<", "<p"]
    runs, tags = markup.runs(F.col("html")), markup.borders(F.col("html"))
    inner = F.transform(runs, lambda r: markup.woven(markup.pieces(r), markup.inline_tags(r)))
    rows = pages(spark, *htmls).select("html", markup.woven(runs, tags).alias("outer"), markup.woven(inner, tags).alias("inner")).collect()
    assert [r for r in rows if not r["html"] == r["outer"] == r["inner"]] == []


def test_units_hold_every_visible_character_once(spark):
    rng = random.Random(5)
    htmls = [random_page(rng) for _ in range(300)]
    got = {}
    for r in page_units(pages(spark, *htmls)).orderBy("page_id", "unit_no").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    visible = F.array_join(F.transform(markup.runs(F.col("html")), lambda run: F.regexp_replace(run, markup.INLINE, "")), "")
    for r in pages(spark, *htmls).select("page_id", visible.alias("text")).collect():
        assert re.sub(r"\s", "", "".join(got.get(r["page_id"], []))) == re.sub(r"\s", "", r["text"])


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<title class='x'>T</title>", [("title", 0, "T", None, False)]),
        ("<div id=1>one<p>two</p>three</div>", [("block", 0, "one", None, False), ("paragraph", 1, "two", None, False), ("block", 2, "three", None, False)]),
        ("<ul><li>a<li>b</ul>", [("item", 0, "a", None, False), ("item", 1, "b", None, False)]),
        ("<P>Ja<b>ne</b> R</P>", [("paragraph", 0, "Jane R", None, False)]),
        (
            "<p>see <a href='/x y'>this</a> or <a href=/z>that</a>.",
            [
                ("paragraph", 0, "see ", None, False), ("link", 1, "this", "/x y", True), ("paragraph", 2, " or ", None, False),
                ("link", 3, "that", "/z", True), ("paragraph", 4, ".", None, False),
            ],
        ),
        ("<footer><p>c</p></footer><header>h</header>d", [("footer", 0, "c", None, False), ("header", 1, "h", None, False), ("block", 2, "d", None, False)]),
        ("<a href=\"/i\"><img src='a>b'></a>", [("link", 0, "", "/i", True)]),
        ("<a href='/m'><div>x</div>y</a>", [("link", 0, "", "/m", True), ("link", 1, "x", None, True), ("link", 2, "y", None, True)]),
        ("<script>x</script><!-- c --><style>y</style>", []),
        ("<table><tr><td>1</td><th>2</th></tr></table>", [("cell", 0, "1", None, False), ("cell", 1, "2", None, False)]),
        ("plain", [("block", 0, "plain", None, False)]),
    ],
)
def test_units(spark, html, expected):
    assert units(spark, html) == expected


def test_null_and_empty_pages_have_no_units(spark):
    assert page_units(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], PAGE)).count() == 0


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize(
    "html, rows, expected, count",
    [
        ("<p title='p'>P title p</p>", [("p", "Q"), ("title", "Name")], "<p title='p'>Q name q</p>", 3),
        ("Jane <b>Roe</b>!", [("Jane Roe", "Ann Lee")], "Ann Lee<b></b>!", 1),
        ("<i>x</i>Ja<b>ne</b> <u>Roe</u> Jane", [("Jane", "Ann")], "<i>x</i>Ja<b>ne</b> <u>Roe</u> Ann", 1),
        ("<i>x </i>Ja<b>ne</b> <u>Roe</u> Jane", [("Jane", "Ann")], "<i>x </i>Ann<b></b> <u>Roe</u> Ann", 2),
        ("<p>Jane</p><p>Roe</p>", [("Jane Roe", "Ann Lee"), ("janeroe", "X")], "<p>Jane</p><p>Roe</p>", 0),
        ("<a href='/box'>Box</a>", [("Box", "Nest")], "<a href='/nest'>Nest</a>", 2),
        ("<a class=box href=/box/1>x</a>", [("Box", "a nest")], '<a class=box href="/a nest/1">x</a>', 1),
        ('<a href="box">', [("box", "")], '<a href="">', 1),
        ("<script>box</script><!-- box -->box", [("Box", "Nest")], "<script>box</script><!-- box -->nest", 1),
        ("es ES", [("eſ", "X")], "es ES", 0),
        ("", [("Box", "Nest")], "", 0),
        (None, [("Box", "Nest")], None, 0),
        ("a ﷐ <b>bo</b>x", [("Box", "Nest")], "a ﷐ <b>nest</b>", 1),
    ],
)
def test_texts_and_targets_are_rewritten(spark, form, html, rows, expected, count):
    done = scrub.redact_markup(pages(spark, html), dictionary(spark, rows, form)).first()
    assert (done["html"], done["replacements"]) == (expected, count)


def test_tags_stay_in_place(spark):
    rng = random.Random(9)
    htmls = [random_page(rng) for _ in range(200)]
    ready = dictionary(spark, [("Jane Roe", "Ann"), ("text", ""), ("p", "q"), ("href", "z"), ("b", "c")])
    tags = F.regexp_extract_all("html", F.lit(markup.INLINE), F.lit(0))
    names = F.transform(markup.borders(F.col("html")), markup.tag_name)
    before = pages(spark, *htmls).select("page_id", tags.alias("t"), names.alias("n")).orderBy("page_id").collect()
    after = scrub.redact_markup(pages(spark, *htmls), ready).select("page_id", tags.alias("t"), names.alias("n")).orderBy("page_id").collect()
    outside = [[t for t in r["t"] if not t.lower().startswith("<a")] for r in before], [[t for t in r["t"] if not t.lower().startswith("<a")] for r in after]
    assert outside[0] == outside[1] and [r["n"] for r in before] == [r["n"] for r in after]


def test_links_are_counted_in_all_quotes(spark):
    html = "<a href=\"/a\">1</a><a href='/b'>2</a><A class=x HREF=/c>3</A><a name=d>4</a><a data-href='/e'>5</a><abbr href='/f'>6</abbr>"
    done = scrub.unlink_doc(pages(spark, html)).first()
    assert done["links_removed"] == 3 and done["html"] == "12345<abbr href='/f'>6</abbr>"
    assert pages(spark, html).select(scrub.link_count(F.col("html"))).first()[0] == 3


def test_pipeline_in_order(spark):
    html = (
        '<meta name="author" content="Jane"><meta content=\'box\' name=title ><meta name="author" content=""><meta name="viewport" content="w">'
        '<header>Box</header><p>Box <img alt="a>b"><a href="/box">box</a></p>'
    )
    frame = spark.createDataFrame([(1, html, "document"), (2, html, "sheet")], "page_id long, html string, kind string")
    ready = dictionary(spark, [("Box", "Nest")])
    rows = scrub.scrub_pipeline(frame, ready, remove_links=True, clear_edges=True, kind="kind").orderBy("page_id").collect()
    props = '<meta name="author" content=""><meta content="" name=title ><meta name="author" content=""><meta name="viewport" content="w">'
    assert rows[0]["html"] == props + "<p>Nest nest</p>"
    assert rows[1]["html"] == props + '<p>Nest <img alt="a>b">nest</p>'
    counts = ["replacements", "links_removed", "images_removed", "edges_cleared", "props_cleared"]
    assert [rows[0][c] for c in counts] == [4, 1, 1, 1, 2] and [rows[1][c] for c in counts] == [4, 1, 0, 1, 2]
