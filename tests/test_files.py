"""File trees, rules, reconciliation, scrubbing and sinks on small fixtures."""

from pyspark.sql import functions as F

from inkveil.operators import provenance, reconcile, report, rules, scrub
from inkveil.sources import files as L
from inkveil.sources.sinks import read_report, write_report, write_scrubbed

FILES = (
    "rel_path string, extension string, status string, replacements long, images_removed long, "
    "hyperlinks_removed long, processing_time double, error string"
)


def test_listing_of_a_real_tree(spark, tmp_path):
    for name in ("a/one.docx", "a/b/TWO.XLSX", "My Tracker.xlsx", "a/scan.pdf", "note.md", "a/.hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = L.list_files(spark, str(tmp_path))
    assert {r["rel_path"] for r in L.file_inventory(listed).collect()} == {"a/one.docx", "a/b/TWO.XLSX"}
    handled = {r["original_path"]: r["handling"] for r in L.copy_manifest(listed, "out").collect()}
    assert handled["a/scan.pdf"] == "copied" and handled["note.md"] == "unhandled"
    assert [r["rel_path"] for r in L.list_files(spark, str(tmp_path), "*.pdf").collect()] == ["a/scan.pdf"]
    assert tuple(L.tracker_exclusion(listed)[1].first())[1] == 1


def test_prefix_rule_needs_no_separator_unless_asked(spark):
    files = spark.createDataFrame([("1. Financials/a.docx",), ("2/b.docx",), ("1. Fin",)], "rel_path string")
    wanted = spark.createDataFrame([("1. Fin",)], "rule string")
    plain = rules.image_rule_prefix(files, wanted).filter("rule_match")
    assert {r[0] for r in plain.collect()} == {"1. Financials/a.docx", "1. Fin"}
    strict = rules.image_rule_prefix(files, wanted, whole_folders=True).filter("rule_match")
    assert {r[0] for r in strict.collect()} == {"1. Fin"}
    none = rules.image_rule_prefix(files, wanted.filter("false"))
    assert none.filter("rule_match").count() == 0


def test_folder_rule(spark):
    files = spark.createDataFrame([("a/b",), ("b",), ("ab",), ("x/a/b",)], "folder string")
    wanted = spark.createDataFrame([("a\\b ",)], "rule string")
    assert {r[0] for r in rules.image_rule_folder(files, wanted).filter("rule_match").collect()} == {"a/b", "x/a/b"}


def test_reconcile_and_integrity(spark):
    rows = [("a.docx", ".docx", "success", 3, 0, 1, 1.0, ""), ("b.docx", ".docx", "success", 0, 0, 0, 1.0, ""),
            ("c.docx", ".docx", "success", 9, 9, 9, 1.0, "")]
    files = spark.createDataFrame(rows, FILES)
    outputs = spark.createDataFrame([("a.docx", 5), ("b.docx", 0)], "rel_path string, size long")
    done = {r["rel_path"]: (r["status"], r["error"], r["replacements"]) for r in reconcile.in_out_reconcile(files, outputs).collect()}
    assert done == {
        "a.docx": ("success", "", 3), "b.docx": ("failed", reconcile.EMPTY, 0), "c.docx": ("failed", reconcile.NOT_CREATED, 0)
    }


def test_integrity_warning(spark):
    rows = [(f"{i}.docx", ".docx", "success", 0 if i == 0 else 4, 0, 0, 1.0, "") for i in range(4)]
    found = spark.createDataFrame([(i == 4,) for i in range(5)], "is_tracker boolean")
    status = report.integrity_status(spark.createDataFrame(rows, FILES), found, spark.range(2)).first()
    assert (status["outputs"], status["expected"], status["integrity"]) == (6, 6, "WARNING (1 suspicious files)")


def test_labels(spark):
    details = spark.createDataFrame([("f", "Box", 1), ("f", "Cat", 2), ("f", "Dog", 3)], "rel_path string, original string, occurrences long")
    mapping = spark.createDataFrame([(1, "Box", ""), (2, "cat", "c")], "ordinal long, original string, replacement string")
    labels = {r["original"]: r["replacement"] for r in reconcile.details_to_mapping(details, mapping).collect()}
    assert labels == {"Box": "[DELETED]", "Cat": "[UNKNOWN]", "Dog": "[UNKNOWN]"}
    fallback = {r["original"]: r["replacement"] for r in reconcile.details_fallback(details, mapping).collect()}
    assert fallback == {"Box": "", "Cat": "c", "Dog": "?"}


def test_allowlist(spark):
    rows = spark.createDataFrame([("Adobe PDF Library 15.0", None), ("Skia/PDF m116", None), (None, None)], "producer string, creator string")
    done = provenance.allowlist_match(rows, provenance.allowlist_union())
    assert [r["is_approved"] for r in done.collect()] == [True, False, False]


def test_pdf_metadata_is_found_however_late(spark):
    late = b"x" * 100_000 + b"/Producer (Late) /Producer (Later)"
    rows = spark.createDataFrame([(bytearray(b"/Producer  (A\\nB  C) /Creator()"),), (bytearray(late),)], "content binary")
    done = rows.select(*[c.alias(n) for n, c in provenance.pdf_metadata(F.col("content")).items()]).collect()
    assert [tuple(r) for r in done] == [("A B C", "Not found"), ("Late", "Not found")]


def test_duplicate_names(spark):
    rows = spark.createDataFrame([(1, 1, "A", "X"), (1, 2, "X", "X"), (1, 3, "B", "X"), (2, 1, "A", "X")], "doc long, n long, old string, new string")
    done = scrub.name_dedupe(rows, ["doc"], "old", "new", "n").orderBy("doc", "n").collect()
    assert [r["final_name"] for r in done] == ["X_1", "X", "X_2", "X"]


def test_unlink_keeps_text(spark):
    page = spark.createDataFrame([(1, '<p><A class=x href="/y">see</A> and <a name="z">z</a><abbr>q</abbr></p>')], "page_id long, html string")
    done = scrub.unlink_doc(page).first()
    assert (done["html"], done["links_removed"]) == ("<p>see and z<abbr>q</abbr></p>", 1)


def test_repeated_outputs_and_keys_give_one_row(spark):
    files = spark.createDataFrame([("a", "success", None)], "rel_path string, status string, error string")
    outputs = spark.createDataFrame([("a", 0), ("a", 5)], "rel_path string, size long")
    assert [tuple(r) for r in reconcile.in_out_reconcile(files, outputs).collect()] == [("a", "success", None)]
    details = spark.createDataFrame([(1, "x")], "doc_id long, original string")
    mapping = spark.createDataFrame([(1, "x", "old"), (2, "x", "new")], "ordinal long, original string, replacement string")
    assert [r["replacement"] for r in reconcile.details_to_mapping(details, mapping).collect()] == ["new"]
    assert [r["replacement"] for r in reconcile.details_fallback(details, mapping).collect()] == ["new"]


def test_sinks(spark, tmp_path):
    units = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "top_folder string, doc_id long, text string")
    write_scrubbed(units, str(tmp_path / "units"))
    assert {p.name for p in (tmp_path / "units").iterdir() if p.is_dir()} == {"top_folder=a", "top_folder=b"}
    write_report({"error_log": units}, str(tmp_path / "report"), "csv")
    assert read_report(spark, str(tmp_path / "report"), "error_log", "csv").count() == 2
