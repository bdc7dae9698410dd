"""Expected results as SQL, computed from the tables and never by parsing log text."""

from __future__ import annotations

from workload.fixture import (
    BODY_SQL, DUCKDB_LAYOUTS, FORMAT_NAMES, ROTATE_EVENTS, SERVICES,
)
from workload.queries import FIND_FROM, FIND_TERM, FRENCH_MONTHS, PART_BYTES

_TIMESTAMP = " ".join(
    f"WHEN {n} THEN strftime(ts, '{layout}')" for n, layout in enumerate(DUCKDB_LAYOUTS)
)
_FORMAT = " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(FORMAT_NAMES))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _has(text: str, needle: str) -> str:
    return f"contains({_lower(text)}, '{needle.lower()}')"


# headers: one row per event. entries: one row per entry of each log file.
# doc: one row per line, with its place in the merged document.
def _base(layout: str = f"user_id % {SERVICES}") -> str:
    """The tables below; ``layout`` is the number of the layout that an event is rendered in."""
    return f"""
WITH headers AS (
  SELECT *, user_id % {SERVICES} AS service,
         lpad(CAST(event_id // {ROTATE_EVENTS} AS VARCHAR), 6, '0') AS segment,
         CASE {layout} {_TIMESTAMP} END AS stamp,
         CASE WHEN {layout} IN (0, 4)
              THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '000'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS key,
         CASE {layout} {_TIMESTAMP} END || {BODY_SQL} AS header,
         (event_id % 7) * 1000000000 + event_id AS place
  FROM events
),
own AS (
  SELECT 'svc-' || service || '-' || segment || '.log' AS file, * FROM headers
),
placed AS (
  SELECT * FROM own
  UNION ALL
  SELECT 'zz-mirror-' || segment || '.log' AS file, * FROM headers
  WHERE service = 0 AND event_id % 3 = 0
),
files AS (
  SELECT file, row_number() OVER (ORDER BY file) - 1 AS file_ord FROM (SELECT DISTINCT file FROM placed)
),
entries AS (
  SELECT f.file_ord, p.file, row_number() OVER (PARTITION BY p.file ORDER BY place) AS entry_no,
         key AS sort_key, length(stamp) AS span, event_id, event_type, service, place,
         CASE WHEN event_type = 'error'
              THEN [header, chr(9) || 'at svc.Handler.run(Handler.java:' || (event_id % 100) || ')',
                    chr(9) || 'at svc.Main.main(Main.java:7)']
              ELSE [header] END AS lines
  FROM placed p JOIN files f ON p.file = f.file
  UNION ALL
  SELECT file_ord, file, 0, '', 0, NULL, 'banner', NULL, -1,
         ['starting ' || file, 'configuration of ' || file || ' loaded']
  FROM files WHERE file LIKE 'svc-%'
),
flat AS (
  SELECT file_ord, file, entry_no, sort_key, span, event_id, event_type, service, place, lines[1] AS header,
         len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS line_in_entry
  FROM entries
),
doc AS (
  SELECT *, row_number() OVER (ORDER BY sort_key, file_ord, entry_no, line_in_entry) - 1 AS doc_line_no,
         row_number() OVER (PARTITION BY file ORDER BY entry_no, line_in_entry) - 1 AS line_no
  FROM flat
),
level_of AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                            WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO' ELSE '(none)' END AS level
  FROM entries
)
"""

_EXPRESSION = (
    f"(({_has('line', 'error')} AND NOT {_has('line', 'user=8 ')}) OR {_has('line', 'java:17)')}"
    f" OR ({_has('line', 'warning')} AND {_has('line', 'user=1')}))"
)

_REPORT = "CASE WHEN file LIKE 'zz-%' THEN 'logback' ELSE CASE CAST(substr(file, 5, 1) AS INT) " + _FORMAT + " END END"


def _from_doc(select: str, *layout: str) -> str:
    return _base(*layout) + select


def _hit(pick: str, ahead: str) -> str:
    return _from_doc(
        f"SELECT coalesce({pick}(CASE WHEN {ahead} THEN doc_line_no END), {pick}(doc_line_no)) AS position"
        f" FROM doc WHERE {_has('line', FIND_TERM)}"
    )


def _key_oracle(layout: int) -> str:
    return _from_doc("SELECT event_id, key AS sort_key, length(stamp) AS span FROM headers", str(layout))


_MONTH = "month(ts + to_months(CAST(event_id % 12 AS INT)))"
_FRENCH = "[" + ", ".join(f"'{m}'" for m in FRENCH_MONTHS) + "]"
_MONTH_NAME = (
    f"CASE WHEN event_id % 2 = 0 THEN upper(strftime(ts + to_months(CAST(event_id % 12 AS INT)), '%b'))"
    f" ELSE ({_FRENCH})[{_MONTH}] END"
)

_DEDUPED = "doc d WHERE NOT (file LIKE 'zz-%')"

_CHANGED = "(file LIKE 'svc-2%' AND place % 2 = 1)"

# Format keys cut to the second.
_SECONDS = "CASE WHEN sort_key = '' THEN '' ELSE substr(sort_key, 1, 19) END"

ORACLES: dict[str, str] = {
    "read_lines": _from_doc("""
, picked AS (
  SELECT file, row_number() OVER (ORDER BY file DESC) - 1 AS back FROM files
), ordered AS (
  SELECT file, back AS file_ord FROM picked
  UNION ALL
  SELECT file, (SELECT count(*) FROM picked) FROM picked WHERE back = 0
)
SELECT o.file_ord, o.file, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes
FROM ordered o JOIN doc d ON o.file = d.file GROUP BY 1, 2"""),
    "split_lines": """
WITH l AS (
  SELECT 'doc-' || (doc_id // 500) AS file, unnest(string_split(text, chr(10))) AS line FROM documents
)
SELECT file, count(*) AS n_lines, count(*) FILTER (WHERE line = '') AS n_empty,
       CAST(sum(strlen(line)) AS BIGINT) AS n_bytes,
       count(*) FILTER (WHERE contains(line, chr(13))) AS n_with_cr
FROM l GROUP BY file""",
    "read_gzip": _from_doc("SELECT file, line FROM doc"),
    "read_tree": _from_doc("SELECT file, line FROM doc"),
    "read_tree_excluding": _from_doc("SELECT file, line FROM doc"),
    "input_warnings": _from_doc("""
SELECT file, count(*) AS n_lines, CAST(NULL AS VARCHAR) AS skipped FROM doc GROUP BY file
UNION ALL SELECT 'zz-damaged.log', NULL, 'damaged content'
UNION ALL SELECT 'missing.log', NULL, 'not readable'
UNION ALL SELECT 'folder.log', NULL, 'not readable'
UNION ALL SELECT 'zz-vanishing.log', NULL, 'not read'"""),
    "format_catalog": _from_doc("""
, sampled AS (SELECT * FROM doc WHERE line_no < 2000)
SELECT file,
       CASE WHEN file LIKE 'zz-%' OR file LIKE 'svc-0%' THEN 'to-the-second'
            WHEN file LIKE 'svc-1%' THEN 'web' END AS format,
       CASE WHEN file LIKE 'zz-%' OR file LIKE 'svc-0%' OR file LIKE 'svc-1%'
            THEN count(*) FILTER (WHERE entry_no > 0 AND line_in_entry = 0) ELSE 0 END AS votes
FROM sampled GROUP BY file"""),
    "reread_merged": _from_doc("""
SELECT row_number() OVER (ORDER BY sort_key, file_ord, entry_no, line_in_entry) - 1 AS doc_line_no,
       sort_key, line
FROM doc""", "0"),
    "write_merged": _from_doc("SELECT doc_line_no, line FROM doc"),
    "export_visible": _from_doc(
        f"SELECT row_number() OVER (ORDER BY doc_line_no) - 1 AS doc_line_no, line FROM doc WHERE {_EXPRESSION}"
    ),
    "sort_key": _key_oracle(0),
    "weekday_prefix": _key_oracle(2),
    "twelve_hour": _key_oracle(3),
    "sort_key_custom_pattern": """
SELECT event_id, '0000-' || strftime(ts, '%m-%d %H:%M:%S.%f') || '000' AS sort_key FROM events""",
    "timestamp_span": _from_doc("SELECT file, span, count(*) AS n_entries FROM entries GROUP BY 1, 2"),
    "month_names": f"""
SELECT event_id,
       strftime(ts + to_months(CAST(event_id % 12 AS INT)), '%Y-%m-%d') || strftime(ts, ' %H:%M:%S') AS sort_key,
       17 + strlen({_MONTH_NAME}) AS span
FROM events""",
    "fraction_precision": """
SELECT event_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S.')
         || rpad(substr(strftime(ts, '%f') || '123456', 1, CAST(least(event_id % 12 + 1, 9) AS INT)), 9, '0') AS sort_key,
       20 + event_id % 12 + 1 + 2 AS span
FROM events""",
    "level_of_header": _from_doc(
        "SELECT event_id, level FROM level_of WHERE event_id IS NOT NULL AND file NOT LIKE 'zz-%'"
    ),
    "detect_format": _from_doc(f"""
SELECT file, {_REPORT} AS format,
       count(*) FILTER (WHERE entry_no > 0 AND line_in_entry = 0 AND line_no < 2000) AS votes, 'vote' AS via
FROM doc GROUP BY file"""),
    "detect_format_late": _from_doc(f"SELECT file, {_REPORT} AS format, 0 AS votes, 'first_match' AS via FROM files"),
    "format_pinning": _from_doc("""
, cut AS (
  SELECT *, CAST(entry_no > 0 AND event_id % 10 <> 0 AS INT) AS starts FROM entries
), grouped AS (
  SELECT *, sum(starts) OVER (PARTITION BY file ORDER BY entry_no) AS grp FROM cut
)
SELECT file, CAST(grp AS BIGINT) AS entry_no, max(CASE WHEN starts = 1 THEN sort_key END) AS sort_key,
       CAST(sum(len(lines)) AS BIGINT) AS n_lines
FROM grouped WHERE grp > 0 GROUP BY file, grp""", "0"),
    "format_report": _from_doc(f"SELECT file_ord, file, {_REPORT} AS format FROM files"),
    "group_entries": _from_doc("SELECT file_ord, entry_no, sort_key, len(lines) AS n_lines FROM entries"),
    "preamble_entry": _from_doc(
        "SELECT file, entry_no, line_in_entry, sort_key, line FROM doc WHERE entry_no = 0"
    ),
    "entry_content": _from_doc(
        "SELECT file_ord, entry_no, len(lines) AS n_lines, 0 AS part,"
        " array_to_string(lines, chr(10)) || chr(10) AS content FROM entries"
    ),
    "entry_parts": _from_doc(f"""
, cut AS (
  SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY file_ord, entry_no ORDER BY line_in_entry) - strlen(line) - 1) // {PART_BYTES} AS part
  FROM flat
)
SELECT file_ord, entry_no, any_value(n_lines) AS n_lines, CAST(part AS BIGINT) AS part,
       string_agg(line || chr(10), '' ORDER BY line_in_entry) AS content
FROM cut GROUP BY file_ord, entry_no, part"""),
    "concat_files": _from_doc("""
SELECT file_ord, count(*) * 2 AS n_lines, count(*) FILTER (WHERE line_in_entry = 0) * 2 AS n_entries
FROM doc GROUP BY file_ord"""),
    "merge_chronological": _from_doc("SELECT sort_key, file_ord, entry_no, line_in_entry, line FROM doc"),
    "dedup_entries": _from_doc(f"SELECT sort_key, file_ord, entry_no, line_in_entry, line FROM {_DEDUPED}"),
    "filter_substring": _from_doc(
        f"SELECT file_ord, entry_no, line_in_entry, line FROM doc WHERE {_has('line', 'error')}"
    ),
    "filter_expression": _from_doc(
        f"SELECT file_ord, entry_no, line_in_entry, line FROM doc WHERE {_EXPRESSION}"
    ),
    "filter_regexp": _from_doc(r"""
SELECT file_ord, entry_no, line_in_entry, line FROM doc
WHERE regexp_matches(line, '^\d{4}-.*error.*id=\d*7\b', 'i')
   OR regexp_matches(line, 'handler\.java:[12]\)$', 'i')"""),
    "line_counts": _from_doc(
        f"SELECT count(*) FILTER (WHERE {_EXPRESSION}) AS visible_lines, count(*) AS total_lines FROM doc"
    ),
    "ascii_lower": f"SELECT doc_id, {_lower('text')} AS lowered FROM documents",
    "ascii_iequals": f"""
SELECT conv_id, turn, TRUE AS same_role, {_lower('text')} = {_lower('upper(text)')} AS same_text
FROM conversations""",
    "ascii_icontains": f"""
SELECT doc_id, {_has('text', 'the')} AS has_word, contains(text, 'É') AS has_accent,
       contains({_lower('text')}, {_lower('lang')}) AS has_lang, TRUE AS has_empty
FROM documents""",
    "number_lines": _from_doc("SELECT doc_line_no, file_ord, entry_no, line_in_entry, line FROM doc"),
    "find_from": _hit("min", f"doc_line_no >= {FIND_FROM}"),
    "find_next": _hit("min", "FALSE"),
    "find_previous": _hit("max", f"doc_line_no < {FIND_FROM}"),
    "find_spans": _from_doc(f"""
, pieces AS (
  SELECT doc_line_no, string_split({_lower('line')}, 'er') AS parts FROM doc
), spots AS (
  SELECT doc_line_no, parts, unnest(range(1, len(parts))) AS k FROM pieces
)
SELECT doc_line_no,
       CAST(list_sum(list_transform(parts[1:k], lambda p: strlen(p))) + 2 * (k - 1) AS BIGINT) AS start,
       CAST(2 AS BIGINT) AS length
FROM spots"""),
    "slice_lines": _from_doc(f"""
, visible AS (
  SELECT row_number() OVER (ORDER BY doc_line_no) - 1 AS n, line FROM doc WHERE {_has('line', 'error')}
)
SELECT n AS doc_line_no, line FROM visible WHERE n BETWEEN 700 AND 1200"""),
    "tail_lines": _from_doc("""
SELECT sort_key, file_ord, entry_no, line_in_entry, line FROM doc
ORDER BY doc_line_no DESC LIMIT 50"""),
    "entry_context": _from_doc("""
SELECT file_ord, entry_no, line_in_entry, line FROM doc
WHERE event_type = 'error' AND event_id % 100 = 17"""),
    "visible_headers": _from_doc(
        "SELECT file_ord, entry_no, sort_key, lines[1] AS header FROM entries WHERE entry_no > 0"
    ),
    "level_counts": _from_doc("SELECT level, count(*) AS count FROM level_of WHERE file NOT LIKE 'zz-%' GROUP BY level"),
    "level_share": _from_doc("""
, visible AS (
  SELECT level, count(*) AS count FROM level_of
  WHERE event_type IN ('error', 'banner') OR contains(lines[1], 'user=8') GROUP BY level
)
SELECT level, count, CAST(sum(count) OVER () AS BIGINT) AS total_entries,
       round(100.0 * count / sum(count) OVER (), 2) AS share
FROM visible"""),
    "dir_snapshot": _from_doc(
        "SELECT file, CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM doc GROUP BY file"
    ),
    "snapshot_diff": _from_doc("""
SELECT file, CASE WHEN file LIKE 'svc-0%' THEN 'removed' WHEN file LIKE 'svc-4%' THEN 'added'
                  WHEN file LIKE 'svc-2%' THEN 'modified' ELSE 'same' END AS status
FROM files"""),
    "check_changes": _from_doc(f"""
, before AS (
  SELECT count(DISTINCT file) AS baseline_files, CAST(sum(strlen(line) + 1) AS BIGINT) AS baseline_bytes
  FROM doc WHERE NOT (file LIKE 'svc-4%')
),
after AS (
  SELECT count(DISTINCT file) AS baseline_files, CAST(sum(strlen(line) + 1) AS BIGINT) AS baseline_bytes
  FROM doc WHERE NOT (file LIKE 'svc-0%') AND NOT {_CHANGED}
)
SELECT 'same' AS case_name, 'unchanged' AS status, * FROM before
UNION ALL SELECT 'later', 'changed', * FROM after
UNION ALL SELECT 'incomplete', 'inconclusive', * FROM before"""),
    "refresh_incremental": _from_doc(f"""
, kept AS (SELECT * FROM entries WHERE NOT {_CHANGED}),
renumbered AS (
  SELECT file, sort_key, lines,
         CASE WHEN entry_no = 0 THEN 0
              ELSE row_number() OVER (PARTITION BY file, entry_no = 0 ORDER BY entry_no) END AS entry_no
  FROM kept
)
SELECT file, entry_no, unnest(range(len(lines))) AS line_in_entry, sort_key, unnest(lines) AS line
FROM renumbered"""),
    "refreshed_levels": _from_doc(f"SELECT level, count(*) AS count FROM level_of WHERE NOT {_CHANGED} GROUP BY level"),
    "stream_new_files": _from_doc("SELECT file_ord, file, entry_no, line_in_entry, sort_key, line FROM doc"),
}
