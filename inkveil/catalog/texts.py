"""Registered queries over texts: redaction, counts, units and scrubbing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.catalog import inputs
from inkveil.catalog.core import Catalog, Source, in_sql, literal
from inkveil.catalog.redaction_sql import (
    MAPPING_ROWS,
    count_sql,
    details_sql,
    mapping_sql,
    pattern_sql,
    redacted_sql,
    replaced_sql,
)
from inkveil.functions import markup, redaction, texts
from inkveil.operators import redact as R
from inkveil.operators import scrub
from inkveil.operators.dictionary import Dictionary
from inkveil.operators.mapping import tier_rank
from inkveil.operators.passes import redact_in_passes
from inkveil.operators.provenance import pdf_metadata
from inkveil.operators.stitch import first_format, link_run_split, run_stitch
from inkveil.sources import units
from inkveil.sources.sinks import write_scrubbed
from inkveil.session import shared_dir

catalog = Catalog()
add = catalog.add

DELETIONS = [(1, "and", ""), (2, "of the", ""), (3, "der", "")]
# A long s matches an s, but the match is not in the lookup.
UNKNOWN = [(1, "The", "Thy"), (2, "eſ", "X")]


def mapping(source: Source, rows: list[tuple] | None = None) -> DataFrame:
    return source.spark.sql(mapping_sql(rows or MAPPING_ROWS))


def dictionary(source: Source, rows: list[tuple] | None = None) -> Dictionary:
    return Dictionary.build(mapping(source, rows))


def documents(source: Source, *columns: str) -> DataFrame:
    return source.spread("documents", "doc_id", "text", *columns)


TEXT = redacted_sql(MAPPING_ROWS, "text")
COUNT = count_sql(MAPPING_ROWS, "text")
DETAILS = details_sql(MAPPING_ROWS, "documents", "doc_id")


@add("redact_single_pass", f"SELECT doc_id, {TEXT} AS redacted, {COUNT} AS replacements FROM documents")
def redact_single_pass(s: Source) -> DataFrame:
    return R.redact(documents(s), dictionary(s)).drop("text")


# The dictionary of this query grows with its table: every word.
WORDS_SQL = """
SELECT min(item_id) * 1000000 + min(place) AS ordinal, word AS original, reverse(word) AS replacement
FROM (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM benchmark))
GROUP BY word"""


def benchmark_words(s: Source) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return (
        s.table("benchmark").select("item_id", F.posexplode(words).alias("place", "original"))
        .groupBy("original")
        .agg((F.min("item_id") * 1_000_000 + F.min("place")).alias("ordinal"))
        .select("ordinal", "original", F.reverse("original").alias("replacement"))
    )


LARGE_SQL = f"""
WITH words AS ({WORDS_SQL}),
parts AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM documents),
flat AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS nr FROM parts)
SELECT doc_id, string_agg(CASE WHEN w.original IS NULL THEN part
    WHEN part = upper(part) AND part <> lower(part) THEN upper(w.replacement)
    WHEN part = lower(part) AND part <> upper(part) THEN lower(w.replacement)
    ELSE w.replacement END, '' ORDER BY nr) AS redacted,
  count(w.original) AS replacements
FROM flat LEFT JOIN words AS w ON w.original = lower(part) GROUP BY doc_id"""


@add("redact_large_dictionary", LARGE_SQL)
def redact_large_dictionary(s: Source) -> DataFrame:
    """The distributed form, which a dictionary of any size can take."""
    large = Dictionary.build(benchmark_words(s), max_keys=0)
    return R.redact(documents(s), large).drop("text")


@add("redact_table_dictionary", LARGE_SQL)
def redact_table_dictionary(s: Source) -> DataFrame:
    """The same dictionary in the form that its measured size selects."""
    return R.redact(documents(s), Dictionary.build(benchmark_words(s))).drop("text")


@add("case_preserve", f"""
SELECT hit AS matched, {replaced_sql(MAPPING_ROWS, 'hit')} AS replaced, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, {pattern_sql([r[1] for r in MAPPING_ROWS])})) AS hit FROM documents) AS h
GROUP BY 1, 2""")
def case_preserve(s: Source) -> DataFrame:
    found = R.with_entries(documents(s), dictionary(s), "text", ["doc_id"])
    hits = found.select(F.explode(F.filter("_found", lambda x: x["entry"].isNotNull())).alias("x"))
    return (
        hits.groupBy(F.col("x.part").alias("matched"), F.col("x.entry.replacement").alias("to"))
        .agg(F.count("*").alias("n"))
        .select("matched", redaction.in_case_of(F.col("matched"), F.col("to")).alias("replaced"), "n")
    )


@add("replacement_count", f"SELECT doc_id, {COUNT} AS replacements FROM documents")
def replacement_count(s: Source) -> DataFrame:
    found = R.with_entries(documents(s), dictionary(s), "text", ["doc_id"])
    return found.select("doc_id", redaction.hit_count(F.col("_found")).alias("replacements"))


@add("replacement_details", DETAILS)
def replacement_details(s: Source) -> DataFrame:
    return R.replacement_details(documents(s), dictionary(s))


CONV_DETAILS = details_sql(MAPPING_ROWS, "conversations", "conv_id AS doc_id").replace("GROUP BY conv_id AS doc_id", "GROUP BY doc_id").replace(
    "SELECT conv_id AS doc_id, m.original", "SELECT doc_id, m.original"
)


@add("merge_details", f"""
SELECT doc_id, original, CAST(sum(occurrences) AS BIGINT) AS occurrences
FROM ({DETAILS} UNION ALL {CONV_DETAILS}) AS d GROUP BY doc_id, original""")
def merge_details(s: Source) -> DataFrame:
    turns = s.spread("conversations", "conv_id", "turn", "text").withColumnRenamed("conv_id", "doc_id")
    ready = dictionary(s)
    second = R.replacement_details(turns, ready)
    return R.merge_details(R.replacement_details(documents(s), ready), second)


def _passes_sql() -> str:
    companies = ["Inc.", "Corp.", "LLC", "Ltd."]
    ranked = sorted(
        MAPPING_ROWS,
        key=lambda r: (1 if any(c in r[1] for c in companies) else 2 if " " in r[1] else 3, -len(r[1]), r[0]),
    )
    steps = ["p0 AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS n FROM documents)"]
    for i, row in enumerate(ranked, 1):
        steps.append(
            f"p{i} AS MATERIALIZED (SELECT doc_id, {redacted_sql([row], 'text')} AS text, n + {count_sql([row], 'text')} AS n FROM p{i - 1})"
        )
    return f"WITH {', '.join(steps)} SELECT doc_id, text AS redacted, n AS replacements FROM p{len(ranked)}"


@add("redact_multi_pass", _passes_sql())
def redact_multi_pass(s: Source) -> DataFrame:
    return redact_in_passes(documents(s), tier_rank(mapping(s))).drop("text")


@add("delete_term", f"""
SELECT doc_id, {redacted_sql(DELETIONS, 'text')} AS redacted, {count_sql(DELETIONS, 'text')} AS replacements
FROM documents""")
def delete_term(s: Source) -> DataFrame:
    return R.redact(documents(s), dictionary(s, DELETIONS)).drop("text")


GAPPY = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END"


@add("null_passthrough", f"""
SELECT doc_id, {TEXT} AS redacted, {COUNT} AS replacements
FROM (SELECT doc_id, {GAPPY} AS text FROM documents) AS d""")
def null_passthrough(s: Source) -> DataFrame:
    gappy = documents(s).withColumn("text", F.expr(GAPPY))
    return R.redact(gappy, dictionary(s)).drop("text")


@add("unknown_match_fallback", f"""
SELECT doc_id, {redacted_sql(UNKNOWN[:1], 'text')} AS redacted, {count_sql(UNKNOWN[:1], 'text')} AS replacements,
  CAST(len(regexp_extract_all(text, '(?i)\\bes\\b')) AS BIGINT) AS unknown_matches
FROM documents""")
def unknown_match_fallback(s: Source) -> DataFrame:
    found = R.with_entries(documents(s), dictionary(s, UNKNOWN), "text", ["doc_id"])
    known = redaction.hit_count(F.col("_found"))
    return found.select(
        "doc_id", redaction.rewritten(F.col("_found")).alias("redacted"), known.alias("replacements"),
        (F.floor(F.size("_found") / 2) - known).alias("unknown_matches"),
    )


RUNS = "turn % 4 = 1 AND conv_id % 3 = 0"


def runs(s: Source) -> DataFrame:
    return s.spread("conversations", "conv_id", "turn", "role", "text").withColumns(
        {"run_no": F.col("turn"), "in_link": F.expr(RUNS)}
    )


@add("run_stitch", f"""
SELECT conv_id, {TEXT} AS redacted, {COUNT} AS replacements
FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id) AS c""")
def stitch(s: Source) -> DataFrame:
    return run_stitch(runs(s), dictionary(s), ["conv_id"])


@add("link_run_split", f"""
WITH linked AS (SELECT DISTINCT conv_id FROM conversations WHERE {RUNS}),
parts AS (
  SELECT conv_id, turn AS part_no, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM linked)
  UNION ALL
  SELECT conv_id, 0, string_agg(text, '' ORDER BY turn) FROM conversations
  WHERE conv_id NOT IN (SELECT conv_id FROM linked) GROUP BY conv_id)
SELECT conv_id, CAST(part_no AS BIGINT) AS part_no, {TEXT} AS redacted, {COUNT} AS replacements FROM parts""")
def split_at_links(s: Source) -> DataFrame:
    return link_run_split(runs(s), dictionary(s), ["conv_id"])


FORMATS = {
    "bold": "turn % 2 = conv_id % 2",
    "italic": "role = 'user'",
    "font_size": "CAST(length(text) % 12 + 8 AS BIGINT)",
    "font_name": "CASE WHEN length(text) % 3 = 0 THEN 'Serif' ELSE 'Sans' END",
}


@add("first_format", f"""
SELECT conv_id, {', '.join(f"arg_min({e}, turn) AS {n}" for n, e in FORMATS.items())}
FROM conversations GROUP BY conv_id""")
def formats(s: Source) -> DataFrame:
    formatted = runs(s).withColumns({name: F.expr(e) for name, e in FORMATS.items()})
    return first_format(formatted, ["conv_id"], list(FORMATS))


def _kind_sql(name: str) -> str:
    cases = [f"WHEN {name} IN ({', '.join(map(literal, names))}) THEN '{kind}'" for kind, names in markup.UNIT_KINDS.items() if kind != "block"]
    return f"CASE WHEN {name} IN ('', 'a', '/a') THEN NULL {' '.join(cases)} ELSE 'block' END"


def _target_sql(tag: str) -> str:
    """The target of a link tag without its quotes, empty where there is none."""
    return f"regexp_replace(regexp_extract({tag}, {literal(markup.TARGET)}, 1), '^[\"'']|[\"'']$', '', 'g')"


# The same rule with windows over the rows of a page instead of one pass over its runs.
UNITS_SQL = f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS unit_no, unit_kind, text, url, in_link FROM (
  SELECT page_id, i, text, CASE WHEN name = 'a' AND tag_url <> '' THEN tag_url END AS url, in_link,
    CASE WHEN in_link THEN 'link' WHEN footers > 0 THEN 'footer' WHEN headers > 0 THEN 'header' ELSE kind END AS unit_kind
  FROM (
    SELECT *, coalesce(last_value({_kind_sql('name')} IGNORE NULLS) OVER w, 'block') AS kind,
      coalesce(last_value(CASE name WHEN 'a' THEN true WHEN '/a' THEN false END IGNORE NULLS) OVER w, false) AS in_link,
      sum(CASE name WHEN 'footer' THEN 1 WHEN '/footer' THEN -1 ELSE 0 END) OVER w AS footers,
      sum(CASE name WHEN 'header' THEN 1 WHEN '/header' THEN -1 ELSE 0 END) OVER w AS headers
    FROM (
      SELECT page_id, i, regexp_replace(run, {literal(markup.INLINE)}, '', 'g') AS text, {_target_sql('tag')} AS tag_url,
        lower(regexp_extract(tag, {literal(markup.TAG_NAME)}, 1)) AS name
      FROM (
        SELECT page_id, generate_subscripts(runs, 1) AS i, unnest(runs) AS run, unnest(list_prepend('', tags)) AS tag
        FROM (SELECT page_id, regexp_split_to_array(html, {literal(markup.BORDER)}) AS runs,
                regexp_extract_all(html, {literal(markup.BORDER)}) AS tags FROM pages) AS c) AS f) AS n
    WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS s) AS u
WHERE regexp_matches(text, '[^\\s\\x0B]') OR url IS NOT NULL"""
LINKS_SQL = f"SELECT * FROM ({UNITS_SQL}) AS u WHERE url IS NOT NULL"


def links(s: Source) -> DataFrame:
    """The units that begin a link."""
    return units.page_units(s.spread("pages", "page_id", "html")).filter("url is not null")


@add("url_rewrite", f"""
SELECT page_id, CAST(unit_no AS BIGINT) AS unit_no, {redacted_sql(MAPPING_ROWS, 'url')} AS url, {count_sql(MAPPING_ROWS, 'url')} AS replacements
FROM ({LINKS_SQL}) AS l""")
def url_rewrite(s: Source) -> DataFrame:
    done = R.redact(links(s).select("page_id", F.col("unit_no").cast("long"), "url"), dictionary(s), "url", ["page_id", "unit_no"])
    return done.select("page_id", "unit_no", F.col("redacted").alias("url"), "replacements")


NAMES = """
SELECT o_custkey AS doc, o_orderkey AS sheet_no, o_orderpriority AS old_name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Alpha' WHEN '2' THEN 'ALPHA' WHEN '3' THEN '5-low'
    WHEN '4' THEN 'Alpha_' || CAST(o_orderkey % 3 AS STRING) ELSE o_orderpriority END AS new_name
FROM {orders}"""


@add("name_dedupe", f"""
WITH names AS (SELECT *, lower(new_name) AS wanted FROM ({in_sql(NAMES)}) AS n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, wanted ORDER BY CASE WHEN old_name = new_name THEN 0 ELSE 1 END, sheet_no) AS place FROM names),
taken AS (SELECT doc, regexp_extract(wanted, '^(.*)_([1-9][0-9]*)$', 1) AS wanted,
  list(CAST(regexp_extract(wanted, '^(.*)_([1-9][0-9]*)$', 2) AS BIGINT)) AS numbers
  FROM (SELECT DISTINCT doc, wanted FROM names) AS d WHERE regexp_matches(wanted, '^.*_[1-9][0-9]*$') GROUP BY ALL)
SELECT r.doc, sheet_no, old_name, new_name, CASE WHEN place = 1 THEN new_name ELSE new_name || '_' || CAST(
    list_filter(range(1, 1000), lambda k: NOT list_contains(coalesce(numbers, []), k))[place - 1] AS VARCHAR) END AS final_name
FROM ranked AS r LEFT JOIN taken AS t ON t.doc = r.doc AND t.wanted = r.wanted""")
def name_dedupe(s: Source) -> DataFrame:
    return scrub.name_dedupe(s.derived(NAMES), ["doc"], "old_name", "new_name", "sheet_no")


NUMBERS = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || '.5'
  WHEN 2 THEN p_name WHEN 3 THEN CAST(p_size AS STRING) || '.079999923706055'
  WHEN 4 THEN ' -' || CAST(p_size AS STRING) || ' '
  WHEN 5 THEN CAST(p_size AS STRING) || 'd' WHEN 6 THEN CAST(p_size AS STRING) || '.5f'
  ELSE CASE p_partkey % 3 WHEN 0 THEN '99999999999999999999' || CAST(p_size AS STRING) WHEN 1 THEN repeat('9', 45) ELSE NULL END
  END AS value FROM {part}"""


@add("tolerant_int", f"""
SELECT p_partkey, CASE WHEN regexp_matches(trim(value), '^-?[0-9]+$') THEN TRY_CAST(trim(value) AS DECIMAL(38,0))
  ELSE coalesce(CAST(round_even(TRY_CAST(value AS DOUBLE), 0) AS DECIMAL(38,0)), 0) END AS number
FROM ({in_sql(NUMBERS)}) AS n""")
def tolerant_int(s: Source) -> DataFrame:
    return s.derived(NUMBERS).select("p_partkey", texts.tolerant_int(F.col("value")).alias("number"))


@add("truncate_display", """
SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS shown FROM documents""")
def truncate_display(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", texts.truncated(F.col("text")).alias("shown"))


@add("clean_metadata", """
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(10), '\\n'), '\\\\[nrtf]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned
FROM documents""")
def clean_metadata(s: Source) -> DataFrame:
    escaped = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return documents(s).select("doc_id", texts.clean_metadata(escaped).alias("cleaned"))


@add("size_kb", "SELECT doc_id, CAST(round_even(n_chars / 1024, 0) AS BIGINT) AS size_kb FROM documents")
def size_kb(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", texts.size_kb(F.col("n_chars")).alias("size_kb"))


PDF_TEXT = """
SELECT page_id, '%PDF-1.4 ' || CASE WHEN page_id % 2 = 0 THEN html ELSE '' END || '/Producer (' || split_part(url, '/', 3) || ')'
  || CASE page_id % 3 WHEN 0 THEN ' /Creator   (Some' || chr(92) || 'nWriter  ' || CAST(page_id AS STRING) || ')' WHEN 1 THEN ' /Creator()' ELSE '' END
  || html AS content FROM {pages}"""


@add("pdf_field_extract", f"""
SELECT page_id, coalesce(nullif(regexp_extract(content, '/Producer\\s*\\(([^)]+)\\)', 1), ''), 'Not found') AS producer,
  trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(content, '/Creator\\s*\\(([^)]+)\\)', 1), ''), 'Not found'),
    '\\\\[nrtf]', ' ', 'g'), '\\s+', ' ', 'g')) AS creator
FROM ({in_sql(PDF_TEXT)}) AS p""")
def pdf_field_extract(s: Source) -> DataFrame:
    fields = pdf_metadata(F.col("content").cast("binary"))
    return s.derived(PDF_TEXT).select("page_id", *[column.alias(name) for name, column in fields.items()])


@add("text_units", f"""
SELECT 'page' AS origin, page_id AS doc_id, unit_kind, CAST(unit_no AS BIGINT) AS unit_no, text, url, in_link FROM ({UNITS_SQL}) AS p
UNION ALL
SELECT 'document', doc_id, 'line', CAST(unit_no - 1 AS BIGINT), line, NULL, false
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit_no FROM documents) AS d
UNION ALL
SELECT 'conversation', conv_id, 'turn', turn, text, NULL, false FROM conversations""")
def text_units(s: Source) -> DataFrame:
    columns = ["origin", "doc_id", "unit_kind", F.col("unit_no").cast("long").alias("unit_no"), "text", "url", "in_link"]
    pages = units.page_units(s.spread("pages", "page_id", "html")).withColumnsRenamed({"page_id": "doc_id"})
    lines = units.document_units(documents(s))
    turns = units.conversation_units(s.table("conversations")).select(
        F.col("conv_id").alias("doc_id"), "unit_kind", F.col("run_no").alias("unit_no"), "text",
        F.lit(None).cast("string").alias("url"), F.lit(False).alias("in_link"),
    )
    parts = [("page", pages), ("document", lines), ("conversation", turns)]
    named = [part.withColumn("origin", F.lit(origin)).select(*columns) for origin, part in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


TAGS = f"regexp_extract_all(html, {literal(markup.BORDER)})"
RUNS_OF = f"regexp_split_to_array(html, {literal(markup.BORDER)})"
LINK_COUNT = f"CAST(len(list_filter({TAGS}, lambda t: regexp_extract(t, {literal(markup.TARGET)}, 1) <> '')) AS BIGINT)"


def _woven_sql(runs: str, tags: str) -> str:
    return f"array_to_string(list_transform(list_zip({runs}, list_append({tags}, '')), lambda z: z[1] || z[2]), '')"


def _unlinked_sql(tags: str) -> str:
    name = f"lower(regexp_extract(t, {literal(markup.TAG_NAME)}, 1))"
    return f"list_transform({tags}, lambda t: CASE WHEN {name} IN ('a', '/a') THEN '' ELSE t END)"


UNLINKED = _woven_sql(RUNS_OF, _unlinked_sql(TAGS))


@add("unlink_doc", f"SELECT page_id, {UNLINKED} AS html, {LINK_COUNT} AS links_removed FROM pages")
def unlink_doc(s: Source) -> DataFrame:
    return scrub.unlink_doc(s.spread("pages", "page_id", "html"))


@add("unlink_cells", f"""
SELECT page_id, CAST(unit_no AS BIGINT) AS row_no, text AS value, CAST(NULL AS VARCHAR) AS url,
  count(url) OVER (PARTITION BY page_id) AS links_removed FROM ({LINKS_SQL}) AS l""")
def unlink_cells(s: Source) -> DataFrame:
    cells = links(s).select("page_id", F.col("unit_no").cast("long").alias("row_no"), F.col("text").alias("value"), "url")
    cleaned, counts = scrub.unlink_cells(cells, ["page_id"])
    return cleaned.join(counts, "page_id")


@add("unlink_shapes", f"""
SELECT conv_id, turn, text, CASE WHEN kind IN ('run', 'click_action') AND shape_type <> 'group' THEN NULL ELSE url END AS url,
  CAST(CASE WHEN kind IN ('run', 'click_action') AND shape_type <> 'group' AND url IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS removed
FROM ({in_sql(inputs.SHAPES)}) AS s""")
def unlink_shapes(s: Source) -> DataFrame:
    return scrub.unlink_shapes(s.derived(inputs.SHAPES)).select("conv_id", "turn", "text", "url", "removed")


@add("drop_images_doc", f"""
SELECT u.conv_id, u.turn, u.text, c.images_removed, c.drawings_removed FROM ({in_sql(inputs.UNITS)}) AS u
JOIN (SELECT conv_id, count(*) FILTER (unit_kind = 'drawing' AND has_picture) AS images_removed,
        count(*) FILTER (unit_kind = 'drawing') AS drawings_removed FROM ({in_sql(inputs.UNITS)}) AS u GROUP BY conv_id) AS c
  ON c.conv_id = u.conv_id
WHERE u.unit_kind <> 'drawing'""")
def drop_images_doc(s: Source) -> DataFrame:
    kept, counts = scrub.drop_images_doc(s.derived(inputs.UNITS), ["conv_id"])
    return kept.select("conv_id", "turn", "text").join(counts, "conv_id")


@add("drop_images_slides", f"""
SELECT conv_id, count(*) FILTER (shape_type = 'picture' AND depth = 0) AS images_removed,
  count(*) FILTER (NOT (shape_type = 'picture' AND depth = 0)) AS shapes_kept
FROM ({in_sql(inputs.SHAPES)}) AS s GROUP BY conv_id""")
def drop_images_slides(s: Source) -> DataFrame:
    kept, counts = scrub.drop_images_slides(s.derived(inputs.SHAPES), ["conv_id"])
    left = kept.groupBy("conv_id").agg(F.count("*").alias("shapes_kept"))
    return counts.join(left, "conv_id", "left").fillna(0, ["shapes_kept"])


@add("clear_headers_footers", f"""
SELECT conv_id, turn, CASE WHEN unit_kind IN ('header', 'footer') THEN '' ELSE text END AS text,
  CAST(CASE WHEN unit_kind IN ('header', 'footer') AND trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END AS BIGINT) AS cleared
FROM ({in_sql(inputs.UNITS)}) AS u""")
def clear_headers_footers(s: Source) -> DataFrame:
    return scrub.clear_headers_footers(s.derived(inputs.UNITS)).select("conv_id", "turn", "text", "cleared")


PROP_VALUES = ["author", "title", "company", "keywords"]


def _props(fields: list[str], strip, name: str) -> None:
    # One column per property afterwards, and how many of them held something before.
    filled = [f for f in fields if f in PROP_VALUES]
    selected = ", ".join(f"'' AS {f}" for f in fields)
    before = " + ".join(f"CASE WHEN {f} <> '' THEN 1 ELSE 0 END" for f in filled) or "0"

    @add(name, f"""
SELECT doc_id, {selected}, CAST(1 AS BIGINT) AS revision, CAST(NULL AS VARCHAR) AS version,
  CAST({before} AS BIGINT) AS had_values FROM ({in_sql(inputs.PROPS)}) AS p""")
    def build(s: Source) -> DataFrame:
        rows = s.derived(inputs.PROPS)
        values = [F.col(f) if f in rows.columns else F.lit("kept").alias(f) for f in [*fields, "revision", "version"]]
        packed = rows.select("doc_id", F.struct(*values).alias("props"), F.expr(f"cast({before} as bigint)").alias("had_values"))
        return strip(packed).select(
            "doc_id", *[f"props.{f}" for f in fields], F.col("props.revision").cast("long").alias("revision"),
            "props.version", "had_values",
        )


_props(scrub.DOCUMENT_PROPS, scrub.strip_props_doc, "strip_props_doc")
_props(scrub.SHEET_PROPS, scrub.strip_props_sheet, "strip_props_sheet")
_props(scrub.SLIDE_PROPS, scrub.strip_props_slides, "strip_props_slides")


def _redacted_tag_sql() -> str:
    around = literal(markup.AROUND_TARGET)
    to = redacted_sql(MAPPING_ROWS, _target_sql("t"))
    return (
        f"CASE WHEN regexp_extract(t, {literal(markup.TARGET)}, 1) = '' THEN t "
        f"ELSE regexp_extract(t, {around}, 1) || '\"' || {to} || '\"' || regexp_extract(t, {around}, 3) END"
    )


# Pieces of text are replaced one by one here; the tables have no key that reaches across an inline tag.
_PIECES = f"regexp_split_to_array(r, {literal(markup.INLINE)})"
_LEFT = f"list_filter(regexp_extract_all(r, {literal(markup.INLINE)}), lambda t: true)"
_NEW_RUN = _woven_sql(
    f"list_transform({_PIECES}, lambda p: {redacted_sql(MAPPING_ROWS, 'p')})",
    f"list_transform({_LEFT}, lambda t: CASE WHEN regexp_matches(t, {literal(scrub.IMAGE_TAG)}) THEN '' ELSE t END)",
)
_RUN_HITS = f"list_sum(list_transform({_PIECES}, lambda p: {count_sql(MAPPING_ROWS, 'p')}))"


@add("scrub_pipeline", f"""
WITH cut AS (SELECT page_id, {RUNS_OF} AS runs, {TAGS} AS tags FROM pages),
redacted AS (SELECT page_id, list_transform(runs, lambda r: {_NEW_RUN}) AS runs, list_transform(tags, lambda t: {_redacted_tag_sql()}) AS tags,
  CAST(list_sum(list_transform(runs, lambda r: {_RUN_HITS}))
    + list_sum(list_transform(tags, lambda t: {count_sql(MAPPING_ROWS, _target_sql('t'))})) AS BIGINT) AS replacements,
  CAST(len(list_filter(tags, lambda t: regexp_extract(t, {literal(markup.TARGET)}, 1) <> '')) AS BIGINT) AS links_removed,
  CAST(list_sum(list_transform(runs, lambda r: len(list_filter({_LEFT}, lambda t: regexp_matches(t, {literal(scrub.IMAGE_TAG)}))))) AS BIGINT)
    AS images_removed FROM cut),
joined AS (SELECT page_id, replacements, links_removed, images_removed, {_woven_sql('runs', _unlinked_sql('tags'))} AS html FROM redacted),
edged AS (SELECT * REPLACE (regexp_replace(html, {literal(scrub.EDGE_ELEMENT)}, '', 'g') AS html),
  CAST(len(list_filter(regexp_extract_all(html, {literal(scrub.EDGE_ELEMENT)}, 1),
    lambda x: trim(regexp_replace(x, {literal(scrub.TAG)}, '', 'g')) <> '')) AS BIGINT) AS edges_cleared FROM joined)
SELECT * REPLACE (regexp_replace(regexp_replace(html, {literal(scrub.PAGE_PROPS[0])}, '\\1""', 'g'), {literal(scrub.PAGE_PROPS[1])}, '\\1""\\3', 'g') AS html),
  CAST(len(regexp_extract_all(html, {literal(scrub.PAGE_PROPS[0])})) + len(regexp_extract_all(html, {literal(scrub.PAGE_PROPS[1])})) AS BIGINT) AS props_cleared
FROM edged""")
def scrub_pipeline(s: Source) -> DataFrame:
    return scrub.scrub_pipeline(
        s.spread("pages", "page_id", "html"), dictionary(s), remove_links=True, remove_images=True, clear_edges=True
    )


@add("scrubbed_sink", f"""
SELECT source AS top_folder, doc_id, CAST(unit_no - 1 AS BIGINT) AS unit_no, {redacted_sql(MAPPING_ROWS, 'line')} AS text
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS unit_no FROM documents) AS d""")
def scrubbed_sink(s: Source) -> DataFrame:
    docs = documents(s, "source").select(
        F.col("source").alias("top_folder"), "doc_id", F.posexplode(F.split("text", "\n")).alias("unit_no", "text")
    )
    done = R.redact(docs, dictionary(s), "text", ["doc_id", "unit_no"]).select(
        "top_folder", "doc_id", F.col("unit_no").cast("long").alias("unit_no"), F.col("redacted").alias("text")
    )
    path = shared_dir(s.spark, "scrubbed")
    write_scrubbed(done, path)
    return s.spark.read.schema(done.schema).parquet(path)


@add("dictionary_hits", f"""
SELECT doc_id, word AS term, count(*) AS occurrences
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) AS w
WHERE word IN (SELECT original FROM ({WORDS_SQL}) AS k) GROUP BY doc_id, word""")
def dictionary_hits(s: Source) -> DataFrame:
    return R.dictionary_hits(documents(s), benchmark_words(s))


LEAKY = [(1, "The", "Of the and"), (2, "with", "Der"), (3, "der", "and"), (4, "and", "")]


@add("residual_leaks", f"""
SELECT doc_id, leaks FROM (SELECT doc_id, {count_sql(LEAKY, 'redacted')} AS leaks
  FROM (SELECT doc_id, {redacted_sql(LEAKY, 'text')} AS redacted FROM documents) AS r) AS l WHERE leaks > 0""")
def residual_leaks(s: Source) -> DataFrame:
    """Replacements that contain keys leave some behind, which this check finds."""
    ready = dictionary(s, LEAKY)
    return R.residual_leaks(R.redact(documents(s), ready), ready)


@add("combine_pattern", f"SELECT doc_id, {COUNT} AS matches FROM documents")
def combine_pattern(s: Source) -> DataFrame:
    pattern = dictionary(s).pattern
    return documents(s).select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("matches"))
