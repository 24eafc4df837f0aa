"""Statements that derive inputs from the tables, valid in Spark SQL and in DuckDB."""

# One file per document.  Names, states and amounts follow from the document.
FILES = """
SELECT doc_id,
  CASE WHEN doc_id % 17 = 0 THEN ''
       WHEN doc_id % 3 = 0 THEN source || '/'
       ELSE source || '/' || lang || '/' END
  || CASE WHEN doc_id % 19 = 0 THEN 'Anon Tracker ' ELSE 'file ' END || CAST(doc_id AS STRING)
  || CASE doc_id % 13 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.xlsm'
       WHEN 4 THEN '.pptx' WHEN 5 THEN '.doc' WHEN 6 THEN '.xls' WHEN 7 THEN '.ppt' WHEN 8 THEN '.pdf'
       WHEN 9 THEN '.PNG' WHEN 10 THEN '.jpeg' WHEN 11 THEN '.md' ELSE '' END AS rel_path,
  n_chars AS size,
  CASE WHEN doc_id % 11 = 5 THEN 'failed' WHEN doc_id % 7 = 3 THEN 'skipped' ELSE 'success' END AS status,
  CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars % 23 END AS replacements,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END AS images_removed,
  n_chars % 3 AS hyperlinks_removed,
  CAST(n_chars AS DOUBLE) / 1000 AS processing_time,
  CASE WHEN doc_id % 11 = 5 THEN 'Processing error: ' || lang ELSE '' END AS error
FROM {documents}
"""

# What came out: some outputs are missing, some are empty.
OUTPUTS = f"""
SELECT rel_path, CASE WHEN doc_id % 29 = 1 THEN 0 ELSE size END AS size
FROM ({FILES}) AS f WHERE doc_id % 23 <> 2
"""

# Comma-separated image rules, one list per source.
RULE_LISTS = """
SELECT source, source || '/' || min(lang) || ', ' || source || chr(92) || max(lang) || ' ,, file' AS rules
FROM {documents} GROUP BY source
"""

# Mapping workbooks, one per supplier, filled from the parts.
CELLS = """
WITH books AS (SELECT s_suppkey AS book, 1 + s_suppkey % 4 AS head FROM {supplier}),
rows AS (
  SELECT b.book, b.head + 1 + p.place AS row_no, p.*
  FROM (SELECT *, p_partkey % (SELECT count(*) FROM {supplier}) AS book_no,
          CAST(floor(p_partkey / (SELECT count(*) FROM {supplier})) AS BIGINT) AS place FROM {part}) AS p
  JOIN books AS b ON b.book = p.book_no
),
mapping AS (
  SELECT book, head AS row_no, 0 AS col_no, 'No' AS value FROM books
  UNION ALL SELECT book, head, 1, CASE book % 2 WHEN 0 THEN 'Original Name' ELSE 'Before' END FROM books
  UNION ALL SELECT book, head, 2, CASE book % 2 WHEN 0 THEN 'Replacement' ELSE 'AFTER' END FROM books
  UNION ALL SELECT book, head, 3, CASE book % 5 WHEN 0 THEN 'Alias (new)' ELSE 'Remark' END FROM books
  UNION ALL SELECT book, row_no, 0, CAST(p_partkey AS STRING) FROM rows
  UNION ALL SELECT book, row_no, 1,
    CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Inc.' WHEN 2 THEN p_name || ', CEO'
      WHEN 3 THEN ' ' || CAST(p_size AS STRING) || '.0' WHEN 4 THEN '  ' || p_brand || '  '
      WHEN 5 THEN upper(p_name) WHEN 6 THEN NULL WHEN 7 THEN p_type ELSE 'v' || CAST(p_size AS STRING) || '.0' END
    FROM rows
  UNION ALL SELECT book, row_no, 2,
    CASE p_partkey % 5 WHEN 0 THEN 'Alias ' || CAST(p_partkey AS STRING) WHEN 1 THEN NULL WHEN 2 THEN '   '
      WHEN 3 THEN 'Name' || CAST(p_partkey AS STRING) || ' Inc.' ELSE CAST(p_size AS STRING) || '.0' END
    FROM rows
  UNION ALL SELECT book, row_no, 3, 'Other ' || CAST(p_partkey AS STRING) FROM rows
)
SELECT book, 1 AS sheet_no, 'Notes' AS sheet, false AS is_active, 1 AS row_no, 0 AS col_no, 'Internal' AS value
FROM books
UNION ALL
SELECT book, 2, CASE book % 3 WHEN 0 THEN 'Data' ELSE 'Anon Tracker' END, true, row_no, col_no, value
FROM mapping
UNION ALL
SELECT book, 3, 'Aliases old', false, 1, 0, 'nothing' FROM books WHERE book % 2 = 0
"""

# Links of pages as spreadsheet cells; what a producer field may hold.
PROVENANCE = """
SELECT page_id, 'page ' || CAST(page_id AS STRING) || '.pdf' AS file,
  CASE page_id % 6 WHEN 0 THEN 'Adobe PDF Library 15.0' WHEN 1 THEN 'Skia/PDF m116' WHEN 2 THEN 'ADOBE ACROBAT 9'
    WHEN 3 THEN NULL WHEN 4 THEN split_part(url, '/', 3) ELSE 'Office Writer 7' END AS producer,
  CASE page_id % 5 WHEN 0 THEN 'Adobe InDesign CS6' WHEN 1 THEN NULL ELSE split_part(url, '/', 4) END AS creator
FROM {pages}
"""

# Arrivals of files, one per event.
ARRIVALS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS created, 'file ' || CAST(event_id AS STRING) || '.pdf' AS file,
  CASE event_type WHEN 'click' THEN 'Adobe PDF Library 15.0' WHEN 'view' THEN 'Skia/PDF m116'
    WHEN 'purchase' THEN NULL ELSE 'Office Writer ' || CAST(user_id % 9 AS STRING) END AS producer,
  CASE WHEN event_id % 7 = 0 THEN 'adobe indesign' ELSE 'creator ' || CAST(user_id AS STRING) END AS creator,
  CASE WHEN event_id % 31 = 0 THEN 'unreadable' ELSE '' END AS error,
  CASE event_id % 4 WHEN 0 THEN 'MOVE_TO_QUARANTINE' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'NOTIFY_ONLY'
    ELSE 'ARCHIVE' END AS chosen
FROM {events}
"""

# Document properties.
PROPS = """
SELECT doc_id, source AS author, lang AS language, text AS title, source || ' Inc.' AS company,
  CAST(n_chars AS STRING) AS keywords, CAST(doc_id % 9 + 2 AS INT) AS revision, 'v' || CAST(doc_id AS STRING) AS version
FROM {documents}
"""

# Shapes of slides: one per turn of a conversation.
SHAPES = """
SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'click_action' ELSE 'note' END AS kind,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'group' WHEN 1 THEN 'picture' ELSE 'text' END AS shape_type,
  turn % 2 AS depth,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'https://host.example/' || CAST(turn AS STRING) END AS url
FROM {conversations}
"""

# Drawings, headers and footers between the paragraphs of documents: one unit per document line number.
UNITS = """
SELECT conv_id, turn, text,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'drawing' WHEN 1 THEN 'header' WHEN 2 THEN 'footer' ELSE 'paragraph' END AS unit_kind,
  conv_id % 2 = 0 AS has_picture
FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '  ' ELSE text END AS text FROM {conversations}) AS c
"""
