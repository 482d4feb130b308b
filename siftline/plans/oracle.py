"""DuckDB SQL for the registered queries, computed from the source columns.

The SQL does not parse log lines: it derives what parsing must give from the
columns the lines were rendered from.
"""

from __future__ import annotations

from siftline.plans import catalog
from siftline.schema import SEVERITY_ORDER

_PHRASE = """CASE event_type WHEN 'click' THEN 'button clicked' WHEN 'error' THEN 'request failed'
    WHEN 'purchase' THEN 'order placed' WHEN 'signup' THEN 'account created' WHEN 'view' THEN 'page viewed' END"""
_LEVEL = """CASE event_type WHEN 'click' THEN 'DEBUG' WHEN 'error' THEN 'ERROR'
    WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'WARNING' END"""
_MONEY = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"
_MS = "strftime(ts, '%Y-%m-%d %H:%M:%S,') || lpad(CAST(extract(millisecond FROM ts) % 1000 AS VARCHAR), 3, '0')"

_SRC = f"""
src AS (
  SELECT event_id, user_id, event_type, value, props, ts,
    'app-' || CAST(user_id % 4 AS VARCHAR) || '.log' AS file,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS lineno,
    row_number() OVER (ORDER BY user_id % 4, event_id) AS seq,
    {_LEVEL} AS lvl,
    {_PHRASE} || ' user=' || CAST(user_id AS VARCHAR) || ' value ' || {_MONEY} AS msg,
    date_trunc('second', ts) AS ts_s,
    date_trunc('millisecond', ts) AS ts_ms
  FROM events)"""

_PLAIN = f"""{_SRC},
stamped AS (
  SELECT *,
    CASE event_id % 6
      WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
      WHEN 1 THEN {_MS}
      WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
      WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
      WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%SZ') END || ' ' AS head
  FROM src),
ev AS (
  SELECT event_id, user_id, event_type, file, lineno, seq,
    CASE WHEN lvl = 'WARNING' THEN 'WARN' ELSE lvl END AS level,
    CASE event_id % 6 WHEN 1 THEN ts_ms WHEN 3 THEN ts_s WHEN 4 THEN ts_s WHEN 5 THEN NULL ELSE ts END AS ts,
    CASE event_id % 6 WHEN 2 THEN 0 WHEN 3 THEN 7200 END AS ts_offset,
    head || CASE event_type WHEN 'click' THEN 'DEBUG  ' WHEN 'error' THEN 'ERROR - '
      WHEN 'purchase' THEN 'INFO  ' WHEN 'signup' THEN 'Warning: ' ELSE '' END || msg AS raw,
    CASE WHEN lvl IS NULL THEN head || msg ELSE msg END AS message
  FROM stamped)"""

_JSON = f"""{_SRC},
js AS (
  SELECT event_id, file, lineno, seq, user_id, value, props,
    NOT (event_id % 11 = 5 OR event_id % 13 = 7) AS sound,
    CASE WHEN sound THEN lvl END AS level,
    CASE WHEN sound THEN CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts_s WHEN 3 THEN ts_s END END AS ts,
    CASE WHEN sound THEN CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 7200 WHEN 3 THEN -5400 END END AS ts_offset,
    CASE WHEN sound THEN msg END AS message
  FROM src)"""

_LOGFMT = f"""{_SRC},
lf AS (
  SELECT event_id, file, lineno, seq, user_id, value,
    event_id % 9 = 4 AS stray,
    lvl AS level,
    CASE WHEN NOT stray THEN CASE event_id % 3 WHEN 2 THEN ts_ms ELSE ts END END AS ts,
    CASE WHEN NOT stray AND event_id % 3 = 0 THEN 0 END AS ts_offset,
    CASE event_id % 3 WHEN 0 THEN 'time' WHEN 1 THEN 'ts' ELSE 'timestamp' END AS clock_key,
    CASE event_id % 3 WHEN 0 THEN strftime(ts_us, '%Y-%m-%dT%H:%M:%S.%fZ')
      WHEN 1 THEN strftime(ts_us, '%Y-%m-%d %H:%M:%S.%f')
      ELSE replace(ms_text, ' ', 'T') END AS clock_text,
    msg AS message
  FROM (SELECT *, ts AS ts_us, {_MS} AS ms_text FROM src))"""

_DOC = r"""
doc AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) AS lineno, unnest(parts) AS raw
  FROM (SELECT doc_id, string_split(
      CASE WHEN norm LIKE '%' || chr(10) THEN left(norm, length(norm) - 1) ELSE norm END, chr(10)) AS parts
    FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS norm
          FROM documents WHERE text <> '')))"""
_PAGE = _DOC.replace("doc AS", "page AS").replace("doc_id", "page_id").replace("text", "html").replace("documents", "pages")
_CONV = (
    _DOC.replace("doc AS", "conv AS").replace("doc_id", "conv_id, turn").replace("documents", "conversations")
)

_TS_TEXT = """CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END
    || CASE WHEN ts_offset IS NULL THEN '' WHEN ts_offset = 0 THEN '+00:00' ELSE '+02:00' END"""

_FROM = f"TIMESTAMP '{catalog.FROM}'"
_TO = f"TIMESTAMP '{catalog.TO.replace('T', ' ')}'"
# the hit pattern: ERROR lines of two-digit users 10..19
_IS_HIT = "(coalesce(level = 'ERROR', false) AND user_id BETWEEN 10 AND 19)"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def _near(n: int, hit: str, source: str = "ev", key: str = "", order: str = "seq") -> str:
    """CTE ``near``: rows within n of a hit, numbered by group."""
    part = f"PARTITION BY {key} " if key else ""
    return f"""
marked AS (SELECT *, {hit} AS hit FROM {source}),
kept AS (
  SELECT *, max(CAST(hit AS INTEGER)) OVER ({part}ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS k
  FROM marked),
gaps AS (
  SELECT *, coalesce({order} - lag({order}) OVER ({part}ORDER BY {order}) > 1, false) AS new_group FROM kept WHERE k = 1),
near AS (
  SELECT *, CAST(sum(CAST(new_group AS INTEGER)) OVER ({part}ORDER BY {order}) AS BIGINT) AS group_id FROM gaps)"""


_ANY_LITERAL = "(" + " OR ".join(f"contains(lower(raw), '{p.lower()}')" for p in catalog.TEXT_LITERALS) + ")"
_ANY_REGEX = "(" + " OR ".join(f"regexp_matches(raw, '(?i){p}')" for p in catalog.TEXT_REGEXES) + ")"
_COMBINED = f"""(coalesce(level IN ('ERROR', 'INFO'), false) AND user_id BETWEEN 10 AND 19
    AND coalesce(ts BETWEEN {_FROM} AND {_TO}, false))"""

_SEEN = "SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (WHERE " + _IS_HIT + ") AS BIGINT) AS matched FROM ev"

_TEMPLATES = f"""{_PLAIN},
shaped AS (
  SELECT event_id, CASE event_type
      WHEN 'click' THEN 'button clicked <*> value <*>' WHEN 'error' THEN 'request failed <*> value <*>'
      WHEN 'purchase' THEN 'order placed <*> value <*>' WHEN 'signup' THEN 'account created <*> value <*>'
      ELSE CASE WHEN event_id % 6 IN (2, 3) THEN '' ELSE '<*> ' END || '<*> page viewed <*> value <*>' END AS template
  FROM ev),
counts AS (
  SELECT template, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_seq FROM shaped GROUP BY template)"""



def _merge_rounds(rounds: int) -> str:
    """CTEs from ``texts(id, raw)``: the merges of template mining, written out for a number of rounds; ``mined(template, n, first_seq)``."""
    steps = [
        """
shapes AS (
  SELECT array_to_string(list_transform(string_split(raw, ' '),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS shape, count(*) AS n, min(id) AS id
  FROM texts GROUP BY shape),
routed AS (SELECT *, string_split(shape, ' ') AS t, len(string_split(shape, ' ')) AS w, string_split(shape, ' ')[1] AS f FROM shapes),
branches AS (
  SELECT w, f, f AS branch FROM routed WHERE f <> '<*>' GROUP BY w, f
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY min(id), f) < 100),
live0 AS (SELECT id, w, coalesce(branch, '<*>') AS branch, t, true AS able FROM routed LEFT JOIN branches USING (w, f))"""
    ]
    for i in range(1, rounds + 1):
        old = f"live{i - 1}"
        steps.append(
            f"""
tok{i} AS (SELECT id, w, branch, able, unnest(t) AS token, unnest(range(len(t))) AS pos FROM {old}),
key{i} AS (SELECT * FROM tok{i} WHERE token <> '<*>' AND (pos > 0 OR branch = '<*>' OR w <= 2)),
named{i} AS (SELECT w, branch, pos, token, min(id) AS rep FROM key{i} GROUP BY ALL HAVING count(*) > 1),
votes{i} AS (
  SELECT id, w, branch, rep, count(*) AS n FROM key{i} JOIN named{i} USING (w, branch, pos, token) WHERE able AND id <> rep GROUP BY ALL),
best{i} AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, rep) AS r,
    (sum(n) OVER (PARTITION BY id) + CASE WHEN branch = '<*>' OR w <= 2 THEN 0 ELSE 1 END) / w AS named FROM votes{i}),
pairs{i} AS (
  SELECT b.id, b.rep, b.w, array_to_string(list_transform(range(1, b.w + 1),
    lambda p: CASE WHEN x.t[p] = y.t[p] AND x.t[p] <> '<*>' THEN '1' ELSE '0' END), '') AS mask
  FROM best{i} b JOIN {old} x ON x.id = b.id JOIN {old} y ON y.id = b.rep WHERE r <= 3 AND named >= 0.4),
partners{i} AS (SELECT *, length(replace(mask, '0', '')) AS ones FROM pairs{i}),
edges{i} AS (SELECT * FROM partners{i} WHERE ones / w >= 0.4),
still{i} AS (
  SELECT * FROM edges{i} WHERE rep NOT IN (SELECT id FROM edges{i})
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ones DESC, rep) = 1),
masks{i} AS (
  SELECT rep, w, mask, row_number() OVER (PARTITION BY rep ORDER BY count(*) DESC, ones DESC, mask DESC) AS turn
  FROM still{i} GROUP BY rep, w, mask, ones),
lost{i} AS (
  SELECT rep, w, pos, min(turn) AS turn FROM (SELECT rep, w, turn, mask, unnest(range(1, w + 1)) AS pos FROM masks{i})
  WHERE mask[pos] = '0' GROUP BY ALL),
ends{i} AS (
  -- the turn in which more tokens would be lost than the template can spare
  SELECT rep, min(turn) AS stop FROM (
    SELECT a.rep, a.w, a.turn, count(*) AS gone FROM lost{i} a JOIN lost{i} b ON a.rep = b.rep AND b.turn <= a.turn
    GROUP BY a.rep, a.w, a.turn, a.pos) WHERE (w - gone) / w < 0.4 GROUP BY rep),
chosen{i} AS (
  SELECT rep, string_agg(CASE WHEN l.turn < coalesce(stop, 1 << 30) THEN '0' ELSE '1' END, '' ORDER BY pos) AS chosen
  FROM (SELECT DISTINCT rep, w, unnest(range(1, w + 1)) AS pos FROM masks{i}) LEFT JOIN lost{i} l USING (rep, w, pos) LEFT JOIN ends{i} USING (rep)
  GROUP BY rep),
joins{i} AS (SELECT id, rep, chosen FROM still{i} JOIN chosen{i} USING (rep) WHERE mask LIKE replace(chosen, '0', '_')),
live{i} AS (
  SELECT l.id, w, branch, able, chosen IS NOT NULL AS new, CASE WHEN chosen IS NULL THEN t ELSE list_transform(range(1, w + 1),
    lambda p: CASE WHEN chosen[p] = '1' THEN t[p] ELSE '<*>' END) END AS t
  FROM (SELECT id, w, branch, t FROM {old}) l
  LEFT JOIN (SELECT DISTINCT rep AS id, chosen FROM joins{i}) c ON c.id = l.id
  LEFT JOIN (SELECT DISTINCT id, true AS a FROM partners{i}) p ON p.id = l.id
  CROSS JOIN LATERAL (SELECT coalesce(a, false) AS able)
  WHERE l.id NOT IN (SELECT id FROM joins{i}) AND (chosen IS NOT NULL OR able))"""
        )
    links = " UNION ALL ".join(f"SELECT id, rep FROM joins{i}" for i in range(1, rounds + 1))
    made = " UNION ALL ".join(f"SELECT id, t, {i} AS i FROM live{i} WHERE new" for i in range(1, rounds + 1))
    steps.append(
        f"""
links AS ({links}),
root AS (
  SELECT id, id AS root FROM shapes WHERE id NOT IN (SELECT id FROM links)
  UNION ALL SELECT l.id, r.root FROM root r JOIN links l ON l.rep = r.id),
made AS (SELECT id AS root, arg_max(array_to_string(t, ' '), i) AS template FROM ({made}) GROUP BY id),
mined AS (
  SELECT coalesce(template, shape) AS template, CAST(sum(n) AS BIGINT) AS n, min(s.id) AS first_seq
  FROM shapes s JOIN root USING (id) LEFT JOIN made USING (root) GROUP BY ALL)"""
    )
    return "WITH RECURSIVE " + ",".join(steps)


_NORMAL = {
    "iso_z": ("ts", "0"),
    "iso_offset": ("date_trunc('second', ts)", "19800"),
    "iso_west": ("date_trunc('millisecond', ts)", "-25200"),
    "iso_bare": ("date_trunc('second', ts)", "NULL"),
    "lower_t": ("date_trunc('second', ts) + to_milliseconds((extract(millisecond FROM ts) % 1000) // 10 * 10)", "NULL"),
    "space": ("ts", "NULL"),
    "comma": ("date_trunc('millisecond', ts)", "NULL"),
    "wide": ("date_trunc('second', ts)", "NULL"),
    "short": ("date_trunc('second', ts)", "NULL"),
    "access": ("date_trunc('second', ts)", "0"),
}


def _normalize() -> str:
    parts = []
    for shape in catalog.STAMPS:
        ts, offset = _NORMAL.get(shape, ("NULL", "NULL"))
        parts.append(
            f"SELECT event_id, '{shape}' AS shape, CAST({ts} AS TIMESTAMP) AS ts, CAST({offset} AS INTEGER) AS ts_offset FROM events"
        )
    return "\nUNION ALL ".join(parts)


def _report() -> str:
    return _with(
        _JSON,
        """
SELECT 'total' AS section, 'Total lines' AS label, format('{:,}', count(*)) AS value FROM js
UNION ALL
SELECT 'level', coalesce(level, '(no level)'), format('{:,}', count(*)) FROM js GROUP BY level
UNION ALL
SELECT 'span', 'From', strftime(arg_min(ts, ts - to_seconds(ts_offset)), '%Y-%m-%d %H:%M:%S') FROM js
UNION ALL
SELECT 'span', 'To', strftime(arg_max(ts, ts - to_seconds(ts_offset)), '%Y-%m-%d %H:%M:%S') FROM js""",
    )


_ALL_RAW = _with(_PLAIN, "SELECT seq, raw FROM ev")

_UNION = _with(
    _PLAIN,
    """
, args(ordinal, file) AS (VALUES (1, 'app-2.log'), (2, 'app-0.log'), (3, 'app-3.log'), (4, 'app-1.log'), (5, 'app-0.log'))
SELECT row_number() OVER (ORDER BY ordinal, lineno) AS seq, raw FROM args JOIN ev USING (file)""",
)

_MIXED_FORMAT = "CASE file WHEN 'app-0.log' THEN 'json' WHEN 'app-1.log' THEN 'logfmt' ELSE 'plaintext' END"

_MIXED = f"""{_PLAIN},
{_JSON.replace(_SRC, "").lstrip(", ").strip()},
{_LOGFMT.replace(_SRC, "").lstrip(", ").strip()}"""

SQL: dict[str, str] = {
    "scan_text": _ALL_RAW,
    "scan_gz": _ALL_RAW,
    "scan_bz2": _ALL_RAW,
    "multi_file_union": _UNION,
    "glob_scan": _with(_SRC, "SELECT file AS log, CAST(count(*) AS BIGINT) AS n FROM src GROUP BY file"),
    "line_numbers": _with(_SRC, "SELECT event_id, file, lineno FROM src"),
    "global_seq": _with(_SRC, "SELECT event_id, seq FROM src"),
    "lines_from_table": _with(_DOC, "SELECT doc_id, lineno, raw FROM doc"),
    "lines_from_pages": _with(_PAGE, "SELECT page_id, lineno, raw FROM page"),
    "lines_from_conversations": _with(_CONV, "SELECT conv_id, turn, lineno, raw FROM conv"),
    "sample_head": _with(_PLAIN, "SELECT seq, raw FROM ev WHERE seq <= 20"),
    "detect_format": _with(
        _MIXED,
        f"""
SELECT js.file, {_MIXED_FORMAT.replace("file", "js.file")} AS fmt,
  avg(CASE WHEN js.file = 'app-0.log' AND sound THEN 1.0 ELSE 0.0 END) AS json_share,
  avg(CASE WHEN js.file = 'app-1.log' THEN 1.0 ELSE 0.0 END) AS logfmt_share
FROM js WHERE lineno <= 20 GROUP BY js.file""",
    ),
    "parse_mixed": _with(
        _MIXED,
        f"""
SELECT event_id, {_MIXED_FORMAT} AS fmt, level, ts, ts_offset, message FROM js WHERE file = 'app-0.log'
UNION ALL
SELECT event_id, {_MIXED_FORMAT}, level, ts, ts_offset, message FROM lf WHERE file = 'app-1.log'
UNION ALL
SELECT event_id, {_MIXED_FORMAT}, level, ts, ts_offset, message FROM ev WHERE file IN ('app-2.log', 'app-3.log')""",
    ),
    "parse_json": _with(_JSON, "SELECT event_id, level, ts, ts_offset, message FROM js"),
    "json_extras": _with(
        _JSON,
        r"""
SELECT event_id, 'user' AS name, CAST(user_id AS VARCHAR) AS val FROM js WHERE sound
UNION ALL SELECT event_id, 'value', CAST(value AS VARCHAR) FROM js WHERE sound
UNION ALL SELECT event_id, 'props', replace(props, ' ', '') FROM js WHERE sound
UNION ALL SELECT event_id, 'ok', 'true' FROM js WHERE sound""",
    ),
    "parse_logfmt": _with(_LOGFMT, "SELECT event_id, level, ts, ts_offset, message FROM lf"),
    "logfmt_extras": _with(
        _LOGFMT,
        f"""
SELECT event_id, 'user' AS name, CASE WHEN event_id % 7 = 3 THEN 'again' ELSE CAST(user_id AS VARCHAR) END AS val FROM lf
UNION ALL SELECT event_id, 'value', {_MONEY} FROM lf
UNION ALL SELECT event_id, 'note', '' FROM lf
UNION ALL SELECT event_id, 'stray ' || clock_key, clock_text FROM lf WHERE stray""",
    ),
    "parse_plain": _with(_PLAIN, "SELECT event_id, level, ts, ts_offset, message FROM ev"),
    "parsed_lines": _with(
        _PLAIN,
        """
SELECT event_id, raw, level, ts, message, 0 AS n_extras, CAST(-1 AS BIGINT) AS cluster_id,
  CAST(NULL AS VARCHAR) AS template FROM ev""",
    ),
    "normalize_ts": _normalize(),
    "filter_level": _with(_PLAIN, "SELECT event_id, level FROM ev WHERE level IN ('ERROR', 'WARN')"),
    "filter_literal": _with(_DOC, f"SELECT * FROM doc WHERE contains(lower(raw), '{catalog.TEXT_PATTERN}')"),
    "filter_regex": _with(_DOC, f"SELECT * FROM doc WHERE regexp_matches(raw, '(?i){catalog.TEXT_REGEXES[0]}')"),
    "filter_any_literal": _with(_DOC, f"SELECT * FROM doc WHERE {_ANY_LITERAL}"),
    "filter_any_regex": _with(_DOC, f"SELECT * FROM doc WHERE {_ANY_REGEX}"),
    "filter_none": _with(_DOC, "SELECT doc_id, lineno FROM doc"),
    "filter_mixed_patterns": _with(
        _PAGE,
        r"""SELECT * FROM page WHERE regexp_matches(raw, '(?i)lang="de"') OR regexp_matches(raw, '(?i)track\(\d*7\)')""",
    ),
    "filter_time_range": _with(_PLAIN, f"SELECT event_id, ts FROM ev WHERE ts BETWEEN {_FROM} AND {_TO}"),
    "filter_time_from": _with(_PLAIN, f"SELECT event_id, ts FROM ev WHERE ts >= {_FROM}"),
    "filter_time_to": _with(_PLAIN, f"SELECT event_id, ts FROM ev WHERE ts <= {_TO}"),
    "filter_combined": _with(_PLAIN, f"SELECT event_id, level, ts FROM ev WHERE {_COMBINED}"),
    "filter_invert": _with(_PLAIN, f"SELECT event_id, level, ts FROM ev WHERE NOT {_COMBINED}"),
    "custom_predicate": _with(
        _DOC, "SELECT doc_id, lineno FROM doc WHERE length(raw) - length(replace(raw, 'e', '')) >= 20"
    ),
    "search": _with(
        _PLAIN,
        f"""
SELECT {_TS_TEXT} AS ts, level, message AS msg, file, lineno FROM ev
WHERE level = 'ERROR' AND ts BETWEEN {_FROM} AND {_TO}""",
    ),
    "search_json": _with(
        _JSON, f"SELECT event_id, level, ts, message FROM js WHERE level IN ('WARNING', 'ERROR') AND ts <= {_TO}"
    ),
    "search_logfmt": _with(
        _LOGFMT, f"SELECT event_id, level, ts, message FROM lf WHERE level IN ('WARNING', 'ERROR') AND ts >= {_FROM}"
    ),
    "render_text": _with(
        _PLAIN,
        "SELECT file || ':' || CAST(lineno AS VARCHAR) || ':' || raw AS line FROM ev WHERE level = 'ERROR'",
    ),
    "render_json": _with(
        _PLAIN,
        f"""
SELECT '{{"ts":' || CASE WHEN ts IS NULL THEN 'null' ELSE '"' || {_TS_TEXT} || '"' END || ',"level":"' || level
  || '","msg":"' || message || '","file":null,"lineno":' || CAST(lineno AS VARCHAR) || '}}' AS line
FROM ev WHERE level = 'ERROR'""",
    ),
    "render_csv": _with(
        _PLAIN, f"SELECT {_TS_TEXT} AS ts, level, message AS msg, file, lineno FROM ev WHERE level = 'WARN'"
    ),
    "level_tag": _with(
        _JSON, "SELECT event_id, CASE WHEN level IS NULL THEN '' ELSE '[' || level || '] ' END AS tag FROM js"
    ),
    "highlight": _with(
        _DOC, r"SELECT doc_id, lineno, regexp_replace(raw, '(?i)(?:the)|(?:\d+\.\d+)', '<<\0>>', 'g') AS text FROM doc"
    ),
    "output_record": _with(_PLAIN, f"SELECT {_TS_TEXT} AS ts, level, message AS msg, file, lineno FROM ev"),
    "context_global": _with(
        _PLAIN + "," + _near(2, _IS_HIT), "SELECT seq, event_id, hit, group_id, new_group FROM near"
    ),
    "context_dense": _with(
        _PLAIN + "," + _near(1, "coalesce(level = 'ERROR', false)"),
        "SELECT seq, event_id, hit, group_id, new_group FROM near",
    ),
    "context_per_file": _with(
        _DOC + "," + _near(1, _ANY_LITERAL, "doc", "doc_id", "lineno"),
        "SELECT doc_id, lineno, raw, hit, group_id, new_group FROM near",
    ),
    "context_groups": _with(
        _PLAIN + "," + _near(3, _IS_HIT),
        """
SELECT group_id, min(seq) AS first_seq, max(seq) AS last_seq, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits
FROM near GROUP BY group_id""",
    ),
    "context_invert": _with(
        _PLAIN + "," + _near(1, "event_type = 'view'"), "SELECT seq, hit, group_id, new_group FROM near"
    ),
    "context_zero": _with(
        _PLAIN,
        f"SELECT seq, true AS hit, CAST(0 AS BIGINT) AS group_id, false AS new_group FROM ev WHERE {_IS_HIT}",
    ),
    "context_text": _with(
        _PLAIN + "," + _near(1, _IS_HIT),
        "SELECT raw AS line FROM near UNION ALL SELECT '--' FROM near WHERE new_group",
    ),
    "summary_total": "SELECT CAST(count(*) AS BIGINT) AS total FROM events",
    "summary_by_level": _with(
        _PLAIN, "SELECT level, CAST(count(*) AS BIGINT) AS n FROM ev WHERE level IS NOT NULL GROUP BY level"
    ),
    "summary_unparsed": _with(_JSON, "SELECT CAST(count(*) AS BIGINT) AS unparsed FROM js WHERE level IS NULL"),
    "summary_time_span": _with(
        _PLAIN,
        """
SELECT arg_min(ts, ts - to_seconds(coalesce(ts_offset, 0))) AS first_ts,
  arg_max(ts, ts - to_seconds(coalesce(ts_offset, 0))) AS last_ts FROM ev""",
    ),
    "summary": _with(
        _PLAIN,
        f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE level IS NULL) AS BIGINT) AS unparsed,
  CAST(count(DISTINCT level) AS BIGINT) AS n_levels,
  (SELECT string_agg(level || '=' || n, ', ' ORDER BY coalesce(list_position({list(SEVERITY_ORDER)}, level), 99), level)
    FROM (SELECT level, count(*) AS n FROM ev WHERE level IS NOT NULL GROUP BY level)) AS by_level,
  arg_min(ts, ts - to_seconds(coalesce(ts_offset, 0))) AS first_ts,
  arg_max(ts, ts - to_seconds(coalesce(ts_offset, 0))) AS last_ts FROM ev""",
    ),
    "summary_report": _report(),
    "summary_report_templates": _with(
        _TEMPLATES,
        """
SELECT 'total' AS section, 'Total lines' AS label, format('{:,}', count(*)) AS value FROM ev
UNION ALL
SELECT 'level', coalesce(level, '(no level)'), format('{:,}', count(*)) FROM ev GROUP BY level
UNION ALL
SELECT 'span', 'From', strftime(arg_min(ts, ts - to_seconds(coalesce(ts_offset, 0))), '%Y-%m-%d %H:%M:%S') FROM ev
UNION ALL
SELECT 'span', 'To', strftime(arg_max(ts, ts - to_seconds(coalesce(ts_offset, 0))), '%Y-%m-%d %H:%M:%S') FROM ev
UNION ALL
SELECT 'template', template, format('{:,}', n) FROM (SELECT * FROM counts ORDER BY n DESC, first_seq LIMIT 10)""",
    ),
    "search_files_detected": _with(
        _MIXED,
        """
SELECT file AS log, level, message, CAST(count(*) AS BIGINT) AS n FROM (
SELECT file, level, message FROM js WHERE file = 'app-0.log' AND level IN ('ERROR', 'WARNING', 'WARN')
UNION ALL SELECT file, level, message FROM lf WHERE file = 'app-1.log' AND level IN ('ERROR', 'WARNING', 'WARN')
UNION ALL SELECT file, level, message FROM ev WHERE file IN ('app-2.log', 'app-3.log') AND level IN ('ERROR', 'WARN'))
GROUP BY ALL""",
    ),
    "file_formats": _with(
        _PLAIN,
        """
SELECT DISTINCT file AS log, CASE file WHEN 'app-0.log' THEN 'json' WHEN 'app-1.log' THEN 'logfmt' ELSE 'plaintext' END AS fmt,
  true AS bounded FROM ev""",
    ),
    "search_detected": _with(
        _MIXED,
        """
SELECT event_id, level, message FROM js WHERE file = 'app-0.log' AND level IN ('ERROR', 'WARNING', 'WARN')
UNION ALL SELECT event_id, level, message FROM lf WHERE file = 'app-1.log' AND level IN ('ERROR', 'WARNING', 'WARN')
UNION ALL SELECT event_id, level, message FROM ev WHERE file IN ('app-2.log', 'app-3.log') AND level IN ('ERROR', 'WARN')""",
    ),
    "search_braces": _with(_JSON, "SELECT event_id FROM js WHERE CAST(value AS VARCHAR) LIKE '5%'"),
    "search_many_literals": _with(
        _DOC,
        "SELECT * FROM doc WHERE "
        + " OR ".join(f"contains(lower(raw), '{literal.lower()}')" for literal in catalog.MANY_LITERALS),
    ),
    "template_mine_text": _with(
        _DOC,
        r"SELECT doc_id, lineno, greatest(len(regexp_extract_all(raw, '[^\s]+')), 1) AS n_tokens, true AS sound FROM doc",
    ),
    "severity_rollup": _with(
        _LOGFMT,
        """
SELECT CAST(count(*) FILTER (WHERE level IN ('ERROR', 'FATAL', 'CRITICAL')) AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE level IN ('WARN', 'WARNING')) AS BIGINT) AS warnings FROM lf""",
    ),
    "scan_metrics": _with(_PLAIN, _SEEN),
    "scan_report": _with(_PLAIN, f"SELECT *, true AS timed, scanned AS rows_read FROM ({_SEEN})"),
    "top_messages": _with(
        _DOC,
        """
SELECT raw, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id * 4294967296 + lineno) AS BIGINT) AS first_seq
FROM doc GROUP BY raw ORDER BY n DESC, first_seq LIMIT 10""",
    ),
    "template_label": _with(
        _DOC,
        "SELECT doc_id, lineno, CASE WHEN length(raw) > 53 THEN left(raw, 52) || '…' ELSE raw END AS label FROM doc",
    ),
    "template_text": _with(_PLAIN, "SELECT event_id, message AS text FROM ev"),
    "template_passthrough": _with(
        _LOGFMT, "SELECT event_id, CAST(-1 AS BIGINT) AS cluster_id, message AS template FROM lf"
    ),
    "template_mine": _with(
        _TEMPLATES,
        """
SELECT event_id, cluster_id, template FROM shaped
JOIN (SELECT template, row_number() OVER (ORDER BY first_seq) AS cluster_id FROM counts) USING (template)""",
    ),
    "template_rounds": _merge_rounds(4).replace(
        "WITH RECURSIVE ",
        """WITH RECURSIVE texts AS (
  SELECT p_partkey AS id, concat_ws(' ', p_type, p_name, CASE p_size % 5 WHEN 0 THEN 'in stock' WHEN 1 THEN 'in size ' || p_size
    WHEN 2 THEN 'on order since monday by mail' WHEN 3 THEN 'moved to ' || p_brand
    ELSE 'on order since friday by ' || string_split(p_name, ' ')[1] END) AS raw FROM part),""",
        1,
    )
    + " SELECT template, n, first_seq FROM mined",
    "summary_templates": _with(_TEMPLATES, "SELECT template, n, first_seq FROM counts"),
    "top_templates": _with(
        _TEMPLATES, "SELECT template AS label, n FROM counts ORDER BY n DESC, first_seq LIMIT 10"
    ),
    "follow_scan": _with(_PLAIN, "SELECT raw FROM ev"),
    "follow_from_now": _with(_PLAIN, "SELECT raw FROM ev WHERE event_id % 2 = 1"),
    "follow_filter": _with(_PLAIN, f"SELECT raw AS line FROM ev WHERE level = 'ERROR' AND ts >= {_FROM}"),
    "stream_summary": _with(_PLAIN, "SELECT level, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY level"),
    "stream_metrics": _with(_PLAIN, _SEEN),
}
