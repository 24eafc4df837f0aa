"""Registered queries over file records: listings, rules, reconciliation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.catalog import inputs
from inkveil.catalog.core import Catalog, Source, in_sql, literal
from inkveil.catalog.redaction_sql import MAPPING_ROWS, mapping_sql
from inkveil.catalog.texts import DETAILS, LINK_COUNT, LINKS_SQL, dictionary, documents, links, mapping
from inkveil.functions import texts
from inkveil.operators import reconcile, report, rules
from inkveil.operators.redact import replacement_details
from inkveil.operators.scrub import link_count
from inkveil.plans.batch import report_tables
from inkveil.session import shared_dir
from inkveil.sources import files as L
from inkveil.sources.sinks import read_report, write_report

catalog = Catalog()
add = catalog.add


def quoted(words: list[str]) -> str:
    return "(" + ", ".join(literal(w) for w in words) + ")"


WORK = f"extension IN {quoted(L.PROCESSABLE)}"
COPY = f"extension IN {quoted(L.PASS_THROUGH)}"

FILES_SQL = f"""
WITH raw AS ({in_sql(inputs.FILES)}),
named AS (SELECT *, regexp_extract(rel_path, '[^/]*$') AS filename FROM raw),
files AS (SELECT *, regexp_extract(filename, '^.+(\\.[^.]+)$', 1) AS suffix,
  lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS extension,
  CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE 'root' END AS folder,
  CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE 'root' END AS top_folder,
  contains(lower(filename), 'tracker') AS is_tracker FROM named),
outputs AS ({in_sql(inputs.OUTPUTS)}),
checked AS (
  SELECT f.* EXCLUDE (status, error, replacements, images_removed, hyperlinks_removed),
    CASE WHEN bad THEN 'failed' ELSE status END AS status,
    CASE WHEN bad AND o_size IS NULL THEN '{reconcile.NOT_CREATED}' WHEN bad THEN '{reconcile.EMPTY}' ELSE error END AS error,
    CASE WHEN bad THEN 0 ELSE replacements END AS replacements,
    CASE WHEN bad THEN 0 ELSE images_removed END AS images_removed,
    CASE WHEN bad THEN 0 ELSE hyperlinks_removed END AS hyperlinks_removed
  FROM (SELECT f.*, o.size AS o_size, f.status = 'success' AND coalesce(o.size, 0) = 0 AS bad
        FROM files AS f LEFT JOIN outputs AS o ON o.rel_path = f.rel_path) AS f),
totals AS (
  SELECT folder, count(*) AS files, count(*) FILTER (status = 'success') AS succeeded,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
    CAST(coalesce(sum(replacements) FILTER (status = 'success'), 0) AS BIGINT) AS replacements,
    CAST(coalesce(sum(images_removed) FILTER (status = 'success'), 0) AS BIGINT) AS images_removed,
    CAST(coalesce(sum(hyperlinks_removed) FILTER (status = 'success'), 0) AS BIGINT) AS hyperlinks_removed
  FROM checked GROUP BY folder)
"""
RATE = "round(100.0 * succeeded / greatest(files, 1), 1)"


def raw(s: Source) -> DataFrame:
    return s.derived(inputs.FILES)


def described(s: Source) -> DataFrame:
    return L.described(raw(s))


def checked(s: Source) -> DataFrame:
    return reconcile.in_out_reconcile(described(s), s.derived(inputs.OUTPUTS))


@add("file_inventory", FILES_SQL + f"SELECT rel_path, size, folder, extension FROM files WHERE {WORK} AND NOT is_tracker")
def file_inventory(s: Source) -> DataFrame:
    return L.file_inventory(raw(s)).select("rel_path", "size", "folder", "extension")


@add("tracker_exclusion", FILES_SQL + "SELECT count(*) AS discovered, count(*) FILTER (is_tracker) AS excluded FROM files")
def tracker_exclusion(s: Source) -> DataFrame:
    return L.tracker_exclusion(raw(s))[1]


@add("type_routing", FILES_SQL + """
SELECT rel_path, CASE WHEN extension = '.docx' THEN 'docx' WHEN extension = '.pptx' THEN 'pptx'
  WHEN extension IN ('.xlsx', '.xlsm') THEN 'xlsx' WHEN extension = '.xls' THEN 'xls'
  WHEN extension IN ('.doc', '.ppt') THEN 'convert' ELSE 'skipped' END AS route FROM files""")
def type_routing(s: Source) -> DataFrame:
    return described(s).select("rel_path", L.route(F.col("extension")).alias("route"))


MANIFEST_SQL = f"""
SELECT rel_path AS original_path, CASE WHEN {COPY} THEN 'output/root/' || rel_path END AS output_path,
  extension AS file_type, filename, CASE WHEN {COPY} THEN 'copied' ELSE 'unhandled' END AS handling
FROM files WHERE NOT is_tracker AND NOT {WORK}"""


@add("copy_manifest", FILES_SQL + MANIFEST_SQL)
def copy_manifest(s: Source) -> DataFrame:
    return L.copy_manifest(raw(s), "output/root")


@add("output_path_plan", FILES_SQL + """
SELECT rel_path, 'out/room_1/' || CASE WHEN extension = '.xls' THEN left(rel_path, length(rel_path) - 4) || '.xlsx' ELSE rel_path END AS output_path,
  'pdf/room_1/' || left(rel_path, length(rel_path) - length(suffix)) || '.pdf' AS pdf_path FROM files""")
def output_path_plan(s: Source) -> DataFrame:
    return L.output_path_plan(raw(s), "out", "pdf", "room", "_1").select("rel_path", "output_path", "pdf_path")


@add("folder_preview", FILES_SQL + f"""
, firsts AS (SELECT top_folder, string_agg(filename, ', ' ORDER BY nr) AS samples FROM (
    SELECT top_folder, filename, row_number() OVER (PARTITION BY top_folder ORDER BY filename, rel_path) AS nr
    FROM files WHERE {WORK} AND NOT is_tracker) AS r WHERE nr <= 5 GROUP BY top_folder)
SELECT f.top_folder, count(*) FILTER ({WORK} AND NOT is_tracker) AS file_count,
  count(*) FILTER (extension IN ('.docx', '.doc')) AS n_docx, count(*) FILTER (extension IN ('.xlsx', '.xlsm', '.xls')) AS n_xlsx,
  count(*) FILTER (extension IN ('.pptx', '.ppt')) AS n_pptx, count(*) FILTER (extension = '.pdf') AS n_pdf,
  count(*) FILTER (extension = '.png') AS n_png, count(*) FILTER (extension IN ('.jpg', '.jpeg')) AS n_jpg,
  count(DISTINCT folder) FILTER (folder <> f.top_folder) AS subfolders, coalesce(max(samples), '') AS samples,
  round(count(*) FILTER ({WORK} AND NOT is_tracker) * 5 / 60, 1) AS est_minutes
FROM files AS f LEFT JOIN firsts AS x ON x.top_folder = f.top_folder GROUP BY f.top_folder""")
def folder_preview(s: Source) -> DataFrame:
    return L.folder_preview(raw(s))


@add("path_normalise", """
SELECT doc_id, trim(replace('  ' || source || chr(92) || lang || '/' || CAST(doc_id AS VARCHAR) || ' ', chr(92), '/')) AS path FROM documents""")
def path_normalise(s: Source) -> DataFrame:
    path = F.concat(F.lit("  "), "source", F.lit("\\"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(" "))
    return s.table("documents").select("doc_id", texts.normalised_path(path).alias("path"))


@add("path_parts", FILES_SQL + """
SELECT rel_path, filename, left(filename, length(filename) - length(suffix)) AS stem, suffix, folder, top_folder FROM files""")
def path_parts(s: Source) -> DataFrame:
    path = F.col("rel_path")
    return raw(s).select(
        "rel_path", texts.file_name(path).alias("filename"), texts.file_stem(path).alias("stem"),
        texts.file_suffix(path).alias("suffix"), texts.parent_folder(path).alias("folder"), texts.top_folder(path).alias("top_folder"),
    )


RULES_SQL = f"""
rules AS (SELECT DISTINCT source, trim(replace(unnest(string_split(rules, ',')), chr(92), '/')) AS rule FROM ({in_sql(inputs.RULE_LISTS)}) AS l),
used AS (SELECT * FROM rules WHERE rule <> '')
"""


def parsed_rules(s: Source) -> DataFrame:
    return rules.rule_list_parse(s.derived(inputs.RULE_LISTS), "rules").select("source", "rule")


@add("rule_list_parse", f"WITH {RULES_SQL} SELECT source, rule FROM used")
def rule_list_parse(s: Source) -> DataFrame:
    return parsed_rules(s)


@add("image_rule_prefix", FILES_SQL + f"""
, {RULES_SQL}
SELECT rel_path, EXISTS (SELECT 1 FROM used AS u WHERE starts_with(f.rel_path, u.rule)) AS rule_match FROM files AS f""")
def image_rule_prefix(s: Source) -> DataFrame:
    return rules.image_rule_prefix(raw(s), parsed_rules(s)).select("rel_path", "rule_match")


@add("image_rule_folder", FILES_SQL + f"""
, {RULES_SQL}
SELECT rel_path, folder, EXISTS (SELECT 1 FROM used AS u WHERE f.folder = u.rule OR ends_with(f.folder, '/' || u.rule)) AS rule_match FROM files AS f""")
def image_rule_folder(s: Source) -> DataFrame:
    return rules.image_rule_folder(described(s), parsed_rules(s)).select("rel_path", "folder", "rule_match")


@add("rule_override_flag", FILES_SQL + f"""
, {RULES_SQL}
SELECT rel_path, decision, decision <> preset AS overridden FROM (
  SELECT rel_path, doc_id % 2 = 0 AS preset,
    doc_id % 2 = 0 OR EXISTS (SELECT 1 FROM used AS u WHERE starts_with(f.rel_path, u.rule)) AS decision FROM files AS f) AS d""")
def rule_override_flag(s: Source) -> DataFrame:
    preset = F.col("doc_id") % 2 == 0
    decision = rules.image_decision(F.col("rule_match"), preset)
    return rules.image_rule_prefix(raw(s), parsed_rules(s)).select(
        "rel_path", decision.alias("decision"), rules.rule_override_flag(decision, preset).alias("overridden")
    )


@add("in_out_reconcile", FILES_SQL + "SELECT rel_path, status, error, replacements FROM checked")
def in_out_reconcile(s: Source) -> DataFrame:
    return checked(s).select("rel_path", "status", "error", "replacements")


PARTIAL = [r for r in MAPPING_ROWS if r[1] != "with"]
PARTIAL_SQL = mapping_sql(PARTIAL)


def details(s: Source) -> DataFrame:
    return replacement_details(documents(s), dictionary(s))


@add("details_to_mapping", f"""
SELECT doc_id, d.original, occurrences, CASE WHEN m.replacement IS NULL THEN '[UNKNOWN]' WHEN m.replacement = '' THEN '[DELETED]' ELSE m.replacement END AS replacement
FROM ({DETAILS}) AS d LEFT JOIN ({PARTIAL_SQL}) AS m ON m.original = d.original""")
def details_to_mapping(s: Source) -> DataFrame:
    return reconcile.details_to_mapping(details(s), mapping(s, PARTIAL))


FALLBACK = [(1, "the", "low"), (2, "and", "same"), (3, "der", "Der"), (4, "le", "il")]


@add("details_fallback", f"""
SELECT doc_id, d.original, occurrences, coalesce(a.replacement, b.replacement, '?') AS replacement
FROM ({DETAILS}) AS d LEFT JOIN ({mapping_sql(FALLBACK)}) AS a ON a.original = d.original
LEFT JOIN ({mapping_sql(FALLBACK)}) AS b ON b.original = lower(d.original)""")
def details_fallback(s: Source) -> DataFrame:
    return reconcile.details_fallback(details(s), mapping(s, FALLBACK))


@add("run_totals", FILES_SQL + """
SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(failed) AS BIGINT) AS failed,
  CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(replacements) AS BIGINT) AS replacements,
  CAST(sum(images_removed) AS BIGINT) AS images_removed, CAST(sum(hyperlinks_removed) AS BIGINT) AS hyperlinks_removed FROM totals""")
def run_totals(s: Source) -> DataFrame:
    return report.run_totals(checked(s))


@add("folder_stats", FILES_SQL + "SELECT * FROM totals")
def folder_stats(s: Source) -> DataFrame:
    return report.folder_stats(checked(s))


@add("top_folder_groups", FILES_SQL + f"SELECT top_folder, count(*) AS files FROM files WHERE {WORK} AND NOT is_tracker GROUP BY top_folder")
def top_folder_groups(s: Source) -> DataFrame:
    return L.file_inventory(raw(s)).groupBy("top_folder").agg(F.count("*").alias("files"))


@add("success_rate", FILES_SQL + f"SELECT folder, {RATE} AS success_rate FROM totals")
def success_rate(s: Source) -> DataFrame:
    rate = report.success_rate(F.col("succeeded"), F.col("files"))
    return report.folder_stats(checked(s)).select("folder", rate.alias("success_rate"))


@add("replacements_by_doc_term", DETAILS)
def replacements_by_doc_term(s: Source) -> DataFrame:
    return details(s)


@add("file_summary", f"""
SELECT doc_id, CAST(sum(occurrences) AS BIGINT) AS total_replacements, count(original) AS unique_terms FROM ({DETAILS}) AS d GROUP BY doc_id""")
def file_summary(s: Source) -> DataFrame:
    return report.file_summary(details(s), "doc_id")


@add("term_frequency", f"""
SELECT original, CAST(sum(occurrences) AS BIGINT) AS hits, count(DISTINCT doc_id) AS files FROM ({DETAILS}) AS d GROUP BY original""")
def term_frequency(s: Source) -> DataFrame:
    return report.term_frequency(details(s), "doc_id")


KIND = """CASE WHEN extension IN ('.docx', '.doc') THEN 'DOCX' WHEN extension IN ('.xlsx', '.xlsm', '.xls') THEN 'XLSX'
  WHEN extension IN ('.pptx', '.ppt') THEN 'PPTX' WHEN extension = '.pdf' THEN 'PDF' WHEN extension = '.png' THEN 'PNG'
  WHEN extension IN ('.jpg', '.jpeg') THEN 'JPG/JPEG' END"""


@add("type_counts", FILES_SQL + f"SELECT {KIND} AS kind, count(*) AS files FROM files WHERE {KIND} IS NOT NULL GROUP BY 1")
def type_counts(s: Source) -> DataFrame:
    return L.type_counts(raw(s))


@add("type_union", FILES_SQL + """
SELECT rel_path, 'document' AS kind FROM files WHERE extension IN ('.docx', '.doc')
UNION ALL SELECT rel_path, 'sheet' FROM files WHERE extension IN ('.xlsx', '.xlsm', '.xls')
UNION ALL SELECT rel_path, 'slides' FROM files WHERE extension IN ('.pptx', '.ppt')""")
def type_union(s: Source) -> DataFrame:
    kinds = {"document": L.DOCUMENTS, "sheet": L.SHEETS, "slides": L.SLIDES}
    return L.type_union(raw(s), kinds).select("rel_path", "kind")


@add("integrity_status", FILES_SQL + f"""
, n AS (SELECT
  (SELECT count(*) FROM files WHERE {WORK}) AS discovered,
  (SELECT count(*) FROM files WHERE {WORK} AND is_tracker) AS trackers,
  (SELECT count(*) FROM files WHERE {COPY} AND NOT is_tracker) AS copied,
  (SELECT count(*) FROM checked WHERE {WORK} AND NOT is_tracker AND status = 'success') AS succeeded,
  (SELECT count(*) FROM checked WHERE {WORK} AND NOT is_tracker AND status = 'failed') AS failed,
  (SELECT count(*) FROM checked WHERE extension IN ('.docx', '.pptx', '.xlsx') AND NOT is_tracker AND status = 'success'
     AND replacements = 0 AND images_removed = 0) AS suspicious)
SELECT *, succeeded + copied AS outputs, discovered - trackers + copied AS expected,
  CASE WHEN succeeded <> discovered - trackers OR failed > 0 THEN 'MISMATCH!'
    WHEN suspicious > 0 THEN 'WARNING (' || CAST(suspicious AS VARCHAR) || ' suspicious files)' ELSE 'VERIFIED' END AS integrity
FROM n""")
def integrity_status(s: Source) -> DataFrame:
    found = described(s).filter(F.col("extension").isin(L.PROCESSABLE))
    done = checked(s).filter(F.col("extension").isin(L.PROCESSABLE) & ~F.col("is_tracker"))
    copied = L.copy_manifest(raw(s), "out").filter("handling = 'copied'")
    return report.integrity_status(done, found, copied)


@add("suspicious_files", FILES_SQL + """
SELECT rel_path FROM checked WHERE status = 'success' AND replacements = 0 AND images_removed = 0 AND extension IN ('.docx', '.pptx', '.xlsx')""")
def suspicious_files(s: Source) -> DataFrame:
    return report.suspicious_files(checked(s)).select("rel_path")


@add("pdf_outcomes", FILES_SQL + """
SELECT count(*) FILTER (size % 5 <> 0) AS pdf_successes, count(*) FILTER (size % 5 = 0) AS pdf_failures FROM checked WHERE status = 'success'""")
def pdf_outcomes(s: Source) -> DataFrame:
    converted = checked(s).filter("status = 'success'").withColumn("pdf_success", F.col("size") % 5 != 0)
    return report.pdf_outcomes(converted)


@add("error_log", FILES_SQL + "SELECT rel_path, error FROM checked WHERE error <> ''")
def error_log(s: Source) -> DataFrame:
    return report.error_log(checked(s))


@add("link_audit", f"""
SELECT CASE page_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'pptx' END AS file_type, count(*) AS files,
  CAST(sum({LINK_COUNT}) AS BIGINT) AS links FROM pages GROUP BY 1""")
def link_audit(s: Source) -> DataFrame:
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'pptx' END")
    return s.spread("pages", "page_id", "html").groupBy(kind.alias("file_type")).agg(
        F.count("*").alias("files"), F.sum(link_count(F.col("html"))).alias("links")
    )


# Links with a host of each kind in place of the page links, which all stay within one site.
HOSTED = """CASE unit_no % 4 WHEN 0 THEN url WHEN 1 THEN 'https://docs.example.com' || url
  WHEN 2 THEN 'https://drive.example.org' || url ELSE 'http://www.example.net' || url END"""


@add("link_categories", f"""
SELECT category, count(*) AS links FROM (
  SELECT CASE WHEN NOT regexp_matches(target, '^https?://') THEN 'internal navigation'
    WHEN regexp_matches(regexp_extract(target, '^https?://([^/]+)', 1), '(^|\\.)(docs|drive)\\.') THEN 'cloud drive' ELSE 'company site' END AS category
  FROM (SELECT {HOSTED} AS target FROM ({LINKS_SQL}) AS l) AS t) AS c GROUP BY category""")
def link_categories(s: Source) -> DataFrame:
    target = links(s).select(F.expr(HOSTED).alias("target"))
    host = F.regexp_extract("target", "^https?://([^/]+)", 1)
    return target.groupBy(report.link_category(host, host == "").alias("category")).agg(F.count("*").alias("links"))


@add("time_per_file", FILES_SQL + """
SELECT folder, round(sum(n_sum) / sum(n), 2) AS seconds_per_file,
  CAST(CAST(floor(sum(n_sum) / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(sum(n_sum) % 60) AS BIGINT) AS VARCHAR) || 's' AS elapsed
FROM (SELECT folder, sum(size) / 1000 AS n_sum, count(*) AS n FROM files GROUP BY folder) AS f GROUP BY folder""")
def time_per_file(s: Source) -> DataFrame:
    # Milliseconds add up exactly in any order.
    millis = F.sum(F.round(F.col("processing_time") * 1000).cast("long"))
    timed = described(s).groupBy("folder").agg((millis / 1000).alias("seconds"), F.count("*").alias("n"))
    return timed.select(
        "folder", F.round(F.col("seconds") / F.col("n"), 2).alias("seconds_per_file"), report.elapsed(F.col("seconds")).alias("elapsed")
    )


@add("details_sort", f"SELECT doc_id, original, occurrences FROM ({DETAILS}) AS d ORDER BY doc_id, occurrences DESC, original")
def details_sort(s: Source) -> DataFrame:
    return details(s).orderBy("doc_id", F.desc("occurrences"), "original")


@add("folder_sort", FILES_SQL + "SELECT folder, files FROM totals ORDER BY folder")
def folder_sort(s: Source) -> DataFrame:
    return report.folder_stats(checked(s)).select("folder", "files").orderBy("folder")


@add("path_sort", FILES_SQL + "SELECT rel_path FROM files WHERE extension = '.pdf' ORDER BY rel_path")
def path_sort(s: Source) -> DataFrame:
    return described(s).filter("extension = '.pdf'").select("rel_path").orderBy("rel_path")


@add("pdf_scan", FILES_SQL + "SELECT rel_path, filename, size FROM files WHERE extension = '.pdf' ORDER BY rel_path")
def pdf_scan(s: Source) -> DataFrame:
    return described(s).filter("extension = '.pdf'").select("rel_path", "filename", "size").orderBy("rel_path")


@add("sample_first_n", FILES_SQL + f"""
SELECT top_folder, filename, nr AS rank FROM (SELECT top_folder, filename,
  row_number() OVER (PARTITION BY top_folder ORDER BY filename, rel_path) AS nr FROM files WHERE {WORK} AND NOT is_tracker) AS r WHERE nr <= 5""")
def sample_first_n(s: Source) -> DataFrame:
    firsts = report.first_n(L.file_inventory(raw(s)), ["top_folder"], [F.asc("filename"), F.asc("rel_path")], 5)
    return firsts.select("top_folder", "filename", "rank")


@add("limit_n", FILES_SQL + "SELECT rel_path FROM files WHERE extension = '.pdf' ORDER BY rel_path LIMIT 5")
def limit_n(s: Source) -> DataFrame:
    return path_sort(s).limit(5)


@add("top_terms_per_doc", f"""
SELECT doc_id, original, occurrences, row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, original) AS rank
FROM ({DETAILS}) AS d""")
def top_terms_per_doc(s: Source) -> DataFrame:
    return report.top_terms(details(s), "doc_id")


@add("output_union", FILES_SQL + f"""
SELECT rel_path, 'processed' AS origin FROM checked WHERE status = 'success' AND {WORK} AND NOT is_tracker
UNION ALL SELECT rel_path, 'copied' FROM files WHERE {COPY} AND NOT is_tracker""")
def output_union(s: Source) -> DataFrame:
    done = checked(s).filter((F.col("status") == "success") & F.col("extension").isin(L.PROCESSABLE) & ~F.col("is_tracker"))
    copied = L.copy_manifest(raw(s), "out").filter("handling = 'copied'")
    return done.select("rel_path", F.lit("processed").alias("origin")).unionByName(
        copied.select(F.col("original_path").alias("rel_path"), F.lit("copied").alias("origin"))
    )


def tables(s: Source) -> dict[str, DataFrame]:
    records = raw(s)
    paths = records.select("doc_id", "rel_path")
    per_file = details(s).join(paths, "doc_id").select("rel_path", "original", "occurrences")
    return report_tables(records, s.derived(inputs.OUTPUTS), per_file, mapping(s), "output/root")


@add("report_sink", FILES_SQL + f"""
SELECT 'file_details' AS sheet, rel_path AS item, status AS label, CAST(replacements AS BIGINT) AS amount FROM checked
UNION ALL SELECT 'folder_summary', folder, CAST({RATE} AS VARCHAR), replacements FROM totals
UNION ALL SELECT 'run_summary', 'run', '', CAST(sum(replacements) AS BIGINT) FROM totals
UNION ALL SELECT 'error_log', rel_path, error, CAST(NULL AS BIGINT) FROM checked WHERE error <> ''
UNION ALL SELECT 'mappings', original, CASE WHEN replacement = '' THEN '[DELETED]' ELSE replacement END, NULL FROM ({mapping_sql(MAPPING_ROWS)}) AS m
UNION ALL SELECT 'copied_files', original_path, handling, NULL FROM ({MANIFEST_SQL}) AS c
UNION ALL SELECT 'detailed_replacements', f.rel_path || ' ' || d.original, CASE WHEN m.replacement = '' THEN '[DELETED]' ELSE m.replacement END, occurrences
  FROM ({DETAILS}) AS d JOIN files AS f ON f.doc_id = d.doc_id JOIN ({mapping_sql(MAPPING_ROWS)}) AS m ON m.original = d.original""")
def report_sink(s: Source) -> DataFrame:
    """Write the seven tables, read them back and show a digest of each."""
    path = shared_dir(s.spark, "report")
    write_report(tables(s), path)
    digests = {
        "file_details": ("rel_path", F.col("status"), F.col("replacements")),
        "folder_summary": ("folder", F.col("success_rate").cast("string"), F.col("replacements")),
        "run_summary": (F.lit("run"), F.lit(""), F.col("replacements")),
        "error_log": ("rel_path", F.col("error"), F.lit(None)),
        "mappings": ("original", F.col("replacement"), F.lit(None)),
        "copied_files": ("original_path", F.col("handling"), F.lit(None)),
        "detailed_replacements": (F.concat_ws(" ", "rel_path", "original"), F.col("replacement"), F.col("occurrences")),
    }
    shown = None
    for name, (item, label, amount) in digests.items():
        item = F.col(item) if isinstance(item, str) else item
        part = read_report(s.spark, path, name).select(
            F.lit(name).alias("sheet"), item.alias("item"), label.alias("label"), amount.cast("long").alias("amount")
        )
        shown = part if shown is None else shown.unionByName(part)
    return shown
