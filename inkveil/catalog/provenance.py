"""Registered queries over file provenance, as tables and as streams of arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.catalog import inputs
from inkveil.catalog.core import Catalog, Source, in_sql, literal
from inkveil.catalog.redaction_sql import MAPPING_ROWS, count_sql, redacted_sql
from inkveil.catalog.texts import PDF_TEXT, catalog as text_catalog, dictionary
from inkveil.operators import provenance as P
from inkveil.streaming import arrivals as A

catalog = Catalog()
add = catalog.add


def approved_sql(allowed: list[str]) -> str:
    tests = [
        f"contains(lower(coalesce({column}, '')), {literal(name.lower())})"
        for name in allowed
        for column in ("producer", "creator")
    ]
    return "(" + " OR ".join(tests) + ")"


APPROVED = approved_sql(P.APPROVED)
CHECKED = f"SELECT *, {APPROVED} AS is_approved FROM ({in_sql(inputs.PROVENANCE)}) AS p"


def checked(s: Source) -> DataFrame:
    return P.allowlist_match(s.derived(inputs.PROVENANCE), P.allowlist_union())


@add("allowlist_match", f"SELECT page_id, file, producer, creator, is_approved FROM ({CHECKED}) AS c")
def allowlist_match(s: Source) -> DataFrame:
    return checked(s)


@add("allowlist_split", f"""
SELECT page_id, 'approved' AS list FROM ({CHECKED}) AS c WHERE is_approved
UNION ALL SELECT page_id, 'violation' FROM ({CHECKED}) AS c WHERE NOT is_approved""")
def allowlist_split(s: Source) -> DataFrame:
    approved, violations = P.allowlist_split(checked(s))
    return approved.select("page_id", F.lit("approved").alias("list")).unionByName(
        violations.select("page_id", F.lit("violation").alias("list"))
    )


@add("allowlist_summary", f"""
SELECT count(*) AS total, count(*) FILTER (is_approved) AS approved, count(*) FILTER (NOT is_approved) AS violations FROM ({CHECKED}) AS c""")
def allowlist_summary(s: Source) -> DataFrame:
    return P.allowlist_summary(checked(s))


CUSTOM = ["Office Writer", "Adobe PDF"]


@add("allowlist_union", f"SELECT page_id, {approved_sql(P.APPROVED + ['Office Writer'])} AS is_approved FROM ({in_sql(inputs.PROVENANCE)}) AS p")
def allowlist_union(s: Source) -> DataFrame:
    return P.allowlist_match(s.derived(inputs.PROVENANCE), P.allowlist_union(CUSTOM)).select("page_id", "is_approved")


def stream(s: Source, table: str, statement: str) -> DataFrame:
    """A derived input over a table that is read as a stream."""
    path = f"{s.folder}/{table}.parquet"
    rows = A.table_stream(s.spark, path, s.table(table).schema)
    return s.spark.sql(statement, **{table: rows})


def arriving(s: Source) -> DataFrame:
    return stream(s, "events", inputs.ARRIVALS)


ARRIVALS = in_sql(inputs.ARRIVALS)
JUDGED = f"SELECT *, error = '' AND {APPROVED} AS is_approved FROM ({ARRIVALS}) AS a"


@add("arrival_source", text_catalog.sql["pdf_field_extract"])
def arrival_source(s: Source) -> DataFrame:
    content = stream(s, "pages", PDF_TEXT)
    fields = P.pdf_metadata(F.col("content").cast("binary"))
    return A.collected(content.select("page_id", *[column.alias(name) for name, column in fields.items()]))


# An arrival is offered to the next three polls of a five-minute timer.
TICK = "CAST(ceil(unix_micros(created) / 300000000) AS BIGINT) * 300000000"


def polled(s: Source) -> DataFrame:
    polls = arriving(s).select(
        "event_id", "file", "created", F.explode(F.expr("sequence(0L, 2L)")).alias("poll_no")
    )
    at = F.timestamp_micros(F.expr(TICK) + F.col("poll_no") * 300_000_000)
    return A.recent_arrivals(polls, at)


POLLED = f"""
SELECT event_id, file, poll_no FROM (SELECT *, unnest([0, 1, 2]) AS poll_no FROM ({ARRIVALS}) AS a) AS p
WHERE epoch_us(created) >= CAST(ceil(epoch_us(created) / 300000000) AS BIGINT) * 300000000 + poll_no * 300000000 - 600000000"""


@add("recent_arrivals", f"SELECT event_id, CAST(poll_no AS BIGINT) AS poll_no FROM ({POLLED}) AS p")
def recent_arrivals(s: Source) -> DataFrame:
    return A.collected(polled(s).select("event_id", "poll_no"))


@add("arrival_dedupe", f"SELECT DISTINCT event_id, file FROM ({POLLED}) AS p")
def arrival_dedupe(s: Source) -> DataFrame:
    return A.collected(A.arrival_dedupe(polled(s), ["event_id"]).select("event_id", "file"))


def judged(s: Source) -> DataFrame:
    return A.stream_allowlist(arriving(s), P.allowlist_union())


@add("stream_allowlist", f"SELECT event_id, producer, creator, is_approved FROM ({JUDGED}) AS j")
def stream_allowlist(s: Source) -> DataFrame:
    return A.collected(judged(s).select("event_id", "producer", "creator", "is_approved"))


@add("action_routing", f"""
SELECT event_id, CASE chosen WHEN 'MOVE_TO_QUARANTINE' THEN 'quarantine' WHEN 'DELETE' THEN 'delete'
  WHEN 'NOTIFY_ONLY' THEN 'notify' ELSE 'unknown' END AS action FROM ({JUDGED}) AS j WHERE NOT is_approved""")
def action_routing(s: Source) -> DataFrame:
    def work(batch: DataFrame) -> DataFrame:
        return A.action_routing(batch, F.col("chosen")).select("event_id", "action")

    return A.foreach_batch(judged(s), work)


@add("audit_trail", f"""
SELECT event_id, 'Not written by an approved tool; producer: ' || coalesce(producer, 'Unknown') || '; creator: ' || coalesce(creator, 'Unknown') AS comment
FROM ({JUDGED}) AS j WHERE NOT is_approved""")
def audit_trail(s: Source) -> DataFrame:
    violations = A.action_routing(judged(s), F.col("chosen"))
    return A.collected(A.audit_trail(violations, "event_id")).drop("detected")


@add("violation_report", f"""
WITH v AS (SELECT created FROM ({JUDGED}) AS j WHERE NOT is_approved),
w AS (SELECT time_bucket(INTERVAL 5 MINUTES, created) - step AS from_time
  FROM v, (SELECT unnest([INTERVAL 0 MINUTES, INTERVAL 5 MINUTES]) AS step) AS s)
SELECT strftime(from_time, '%Y-%m-%d %H:%M:%S') AS from_time, count(*) AS violations FROM w GROUP BY 1""")
def violation_report(s: Source) -> DataFrame:
    violations = A.action_routing(judged(s), F.col("chosen"))
    return A.violation_report(violations).select(F.date_format("from_time", "yyyy-MM-dd HH:mm:ss").alias("from_time"), "violations")


@add("error_channel", f"SELECT event_id, error AS problem FROM ({ARRIVALS}) AS a WHERE error <> ''")
def error_channel(s: Source) -> DataFrame:
    _, failing = A.error_channel(arriving(s), F.when(F.col("error") != "", F.col("error")))
    return A.collected(failing.select("event_id", "problem"))


@add("stream_redact", f"""
SELECT doc_id, {redacted_sql(MAPPING_ROWS, 'text')} AS redacted, {count_sql(MAPPING_ROWS, 'text')} AS replacements FROM documents""")
def stream_redact(s: Source) -> DataFrame:
    texts = stream(s, "documents", "SELECT doc_id, text FROM {documents}")
    return A.stream_redact(texts, dictionary(s)).drop("text")
