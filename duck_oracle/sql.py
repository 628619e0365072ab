"""DuckDB SQL oracle for the check queries.

An independent formulation in plain SQL: the lens renders ``events`` as log
lines with the same text as the Spark lens, the lines are parsed with RE2
patterns per format (first match wins via CASE), years come from candidate
timestamps / LAG / running SUM, and each check selects the same columns.
The events lens is ASCII and the documents lens has non-ASCII text only in the
message ('.+'), so RE2's ASCII classes agree with the Unicode ones there.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
MONTH_LIST = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

# RE2 patterns of the formats (same grammar as the Spark catalog).
RE_WITH_LEVEL = (r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?\s+([\w\-.]+)\s+([\w\-./]+)"
                 r"(?:\[(\d+)\])?:\s*\[([A-Z]+)\]\s*(.+)$")
RE_TRADITIONAL = (r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?\s+([\w\-.]+)\s+([\w\-./]+)"
                  r"(?:\[(\d+)\])?:\s*(.+)$")
RE_SIMPLE = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+([\w\-.]+)\s+([\w\-./]+):\s*(.+)$"
RE_ISO = (r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z)?(?:\s+([+-]\d{4}))?\s+([\w\-.]+)\s+"
          r"([\w\-./]+)(?:\[(\d+)\])?:\s*(.+)$")
RE_ERROR_WORDS = r"(?i)\b(error|failed|failure|exception|critical|panic)\b"


def _lens(shift: int) -> str:
    return f"""
ev AS (
  SELECT event_id, ts - INTERVAL {shift} DAY AS t, user_id, event_type, props,
         CASE event_type WHEN 'error' THEN 'kernel' WHEN 'click' THEN 'nginx' WHEN 'view' THEN 'web.ui'
              WHEN 'signup' THEN 'auth-d' WHEN 'purchase' THEN 'shop/pay' END AS svc
  FROM events
),
tailed AS (
  SELECT *, 'host' || CAST(user_id % 8 AS VARCHAR) || ' ' || svc
         || CASE WHEN event_id % 3 <> 0 THEN '[' || CAST(event_id AS VARCHAR) || ']' ELSE '' END
         || ': '
         || CASE WHEN event_id % 5 = 0 THEN '[' || (['ERROR','WARN','INFO','CRIT','DEBUG','FATAL'])[event_id % 6 + 1] || '] ' ELSE '' END
         || 'user ' || CAST(user_id AS VARCHAR) || ' '
         || CASE WHEN event_type = 'error'
                 THEN (['error','failed','failure','exception','critical','panic','errors','Error'])[event_id % 8 + 1]
                 ELSE event_type END
         || ' props ' || props AS tail
  FROM ev
),
lens AS (
  SELECT event_id AS line_seq,
    CASE
      WHEN event_id % 13 = 2 THEN 'no timestamp on this line ' || CAST(event_id AS VARCHAR)
      WHEN event_id % 17 = 3 THEN strftime(t, '%b') || ' 32 10:00:00 host0 cron: impossible date'
      WHEN event_id % 11 = 1 THEN strftime(t, '%Y-%m-%d') || 'T' || strftime(t, '%H:%M:%S') || '.'
                                  || strftime(t, '%f') || 'Z ' || tail
      ELSE strftime(t, '%b') || ' ' || lpad(CAST(day(t) AS VARCHAR), 2, ' ') || ' ' || strftime(t, '%H:%M:%S')
           || CASE WHEN event_id % 7 = 0 THEN '.' || strftime(t, '%f') ELSE '' END || ' ' || tail
    END AS line
  FROM tailed
)"""


def _doc_lens() -> str:
    two = "lpad(CAST({x} AS VARCHAR), 2, '0')"
    return f"""
lens AS (
  SELECT doc_id AS line_seq,
    'Jan ' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, ' ') || ' '
    || {two.format(x='doc_id % 24')} || ':' || {two.format(x='(doc_id // 24) % 60')} || ':'
    || {two.format(x='(doc_id // 1440) % 60')}
    || ' docs ' || source || '[' || CAST(doc_id AS VARCHAR) || ']: ' || CASE WHEN doc_id % 4 = 0 THEN '[ERROR] ' ELSE '' END
    || trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) AS line
  FROM documents
)"""


# RE2 patterns of the two other ISO formats.
RE_JOURNALD = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\+\d{4})\s+([\w\-.]+)\s+(\w+)\[(\d+)\]:\s*(.+)$"
RE_RAINER = (r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})\.(\d[\d+,\-./:]+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:?\s+"
             r"(?:\[(\w+)\]\s+)?(.+)$")


def mixed_sql(offsets: str = "utc", simple: bool = False) -> str:
    """WITH-chain over the mixed lens ending in ``classified`` (all lines) and ``entries``."""
    pid = "'[' || event_id || ']'"
    iso = "strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H:%M:%S')"
    millis = "strftime(ts, '%g')"
    pick = "(['{}','{}','{}','{}'])[event_id % 4 + 1]"
    plus = pick.format("+0000", "+0130", "+0545", "+2359")
    blank = pick.format("+0000", "+0130", "-0500", "+0545")
    colon = pick.format("+00:00", "+01:30", "-05:00", "+05:45")
    x = lambda g: (f"CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', {g[0]}) "
                   f"WHEN 'journald' THEN regexp_extract(line, '{RE_JOURNALD}', {g[1]}) "
                   f"WHEN 'rainerscript_enhanced' THEN regexp_extract(line, '{RE_RAINER}', {g[2]}) "
                   f"ELSE regexp_extract(line, '{RE_SIMPLE}', {g[3]}) END")
    bsd_name = "traditional_simple" if simple else "traditional"
    has_off = "off <> ''"
    bad = ("(length(frac) > 6 OR (format = 'rainerscript_enhanced' AND frac = '') OR (z <> '' AND off <> '')"
           + (f" OR {has_off}" if offsets == "drop" else "") + ")")
    iso_formats = "" if simple else f"""
         WHEN regexp_matches(line, '{RE_ISO}') THEN 'iso8601'
         WHEN regexp_matches(line, '{RE_JOURNALD}') THEN 'journald'
         WHEN regexp_matches(line, '{RE_RAINER}') THEN 'rainerscript_enhanced'"""
    return f"""WITH ev AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'kernel' WHEN 'click' THEN 'nginx' WHEN 'view' THEN 'web.ui'
              WHEN 'signup' THEN 'auth-d' WHEN 'purchase' THEN 'shop/pay' END AS svc,
         'host' || CAST(user_id % 8 AS VARCHAR) || ' ' AS host0,
         'user ' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' props ' || props AS m
  FROM events
),
lens AS (
  SELECT event_id AS line_seq, CASE event_id % 10
    WHEN 0 THEN {iso} || {plus} || ' ' || host0 || translate(svc, '.-/', '___') || {pid} || ': ' || m
    WHEN 1 THEN {iso} || '.' || strftime(ts, '%f') || {colon} || ' ' || host0 || svc || {pid} || ': ['
         || (['ERROR','WARN','INFO','CRIT','DEBUG','FATAL'])[event_id % 6 + 1] || '] ' || m
    WHEN 2 THEN {iso} || '.' || {millis} || {blank} || ' ' || host0 || svc || ' ' || m
    WHEN 3 THEN strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') || ' ' || host0 || svc || ': ' || m
    WHEN 4 THEN '  ' || {iso} || '.' || {millis} || ' ' || host0 || svc || {pid} || ':  ' || m || '   '
    WHEN 5 THEN {iso} || '.' || {millis} || '  ' || {blank} || ' ' || host0 || svc || ': ' || m
    WHEN 6 THEN CASE event_id % 3 WHEN 0 THEN {iso} || '.' || strftime(ts, '%f') || '12 ' || host0 || svc || ': ' || m
         WHEN 1 THEN strftime(ts, '%Y-%m-%d') || 'T10:00:60 ' || host0 || svc || ': ' || m
         ELSE '2023-02-29T' || strftime(ts, '%H:%M:%S') || ' ' || host0 || svc || ': ' || m END
    WHEN 7 THEN strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S')
         || ' ' || host0 || svc || ': ' || m
    WHEN 8 THEN {iso} || 'Z +0100 ' || host0 || svc || ': ' || m
    ELSE {iso} || '.' || strftime(ts, '%f') || '789+01:00 ' || host0 || svc || ': ' || m END AS raw
  FROM ev
),
fmt AS (
  SELECT line_seq, trim(raw) AS line,
    CASE WHEN substr(line, 1, 1) BETWEEN 'A' AND 'Z'
              THEN CASE WHEN regexp_matches(line, '{RE_SIMPLE}') THEN '{bsd_name}' END{iso_formats} END AS format
  FROM lens
),
fields AS (
  SELECT *, {x((1, 1, 1, 0))} AS date_s, {x((2, 2, 2, 3))} AS clock, {x((6, 4, 4, 4))} AS host,
    {x((7, 5, 5, 5))} AS service, {x((9, 7, 8, 6))} AS msg,
    CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 8)
         WHEN 'journald' THEN regexp_extract(line, '{RE_JOURNALD}', 6)
         WHEN 'rainerscript_enhanced' THEN regexp_extract(line, '{RE_RAINER}', 6) END AS pid,
    CASE format WHEN 'rainerscript_enhanced' THEN regexp_extract(line, '{RE_RAINER}', 7) END AS level,
    CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 3)
         WHEN 'rainerscript_enhanced' THEN regexp_extract(regexp_extract(line, '{RE_RAINER}', 3),
              '^([0-9]{{1,6}})(?:[+-][0-9]{{2}}:?[0-9]{{2}})?$', 1) ELSE '' END AS frac,
    CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 5)
         WHEN 'journald' THEN regexp_extract(line, '{RE_JOURNALD}', 3)
         WHEN 'rainerscript_enhanced' THEN replace(regexp_extract(regexp_extract(line, '{RE_RAINER}', 3),
              '^[0-9]{{1,6}}([+-][0-9]{{2}}:?[0-9]{{2}})?$', 1), ':', '') ELSE '' END AS off,
    CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 4) ELSE '' END AS z
  FROM fmt
),
stamped AS (
  SELECT *, CASE
    WHEN format IS NULL OR {bad} THEN NULL
    WHEN format = '{bsd_name}' THEN coalesce(
      CASE WHEN try_strptime('2024 ' || substr(line, 1, 15), '%Y %b %d %H:%M:%S') <= {AS_OF}
           THEN try_strptime('2024 ' || substr(line, 1, 15), '%Y %b %d %H:%M:%S') END,
      try_strptime('2023 ' || substr(line, 1, 15), '%Y %b %d %H:%M:%S'))
    WHEN CAST(substr(clock, 7, 2) AS INT) < 60 THEN
      try_cast(date_s || ' ' || clock AS TIMESTAMP) + to_microseconds(CAST(rpad(frac, 6, '0') AS INT))
      - to_minutes(CASE WHEN off = '' THEN 0 ELSE (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END)
                   * (CAST(substr(off, 2, 2) AS INT) * 60 + CAST(substr(off, 4, 2) AS INT)) END) END AS ts0
  FROM fields
),
classified AS (
  SELECT *, CASE WHEN ts0 >= {AS_OF} - INTERVAL 45 DAY AND ts0 <= {AS_OF} + INTERVAL 1 DAY THEN ts0 END AS ts
  FROM stamped
)
"""


def _mixed_rows(fmt: str, **kw) -> str:
    return mixed_sql(**kw) + f"""SELECT line_seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, host, service,
      nullif(pid, '') AS pid, nullif(level, '') AS level, trim(msg) AS message, line AS raw_line
    FROM classified WHERE ts IS NOT NULL AND format = '{fmt}'"""


def _ts(y: str, m: str, d: str, hh: str, mi: str, ss: str, us: str) -> str:
    return (f"CASE WHEN {hh} < 24 AND {mi} < 60 AND {ss} < 60 THEN "
            f"try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', {y}, {m}, {d}, {hh}, {mi}, {ss}) AS TIMESTAMP)"
            f" + to_microseconds({us}) END")


def entries_sql(shift: int = 0, max_days: int = 45, year_mode: str = "rollback", base_year: int = 2024,
                error_mode: str = "word",
                source: str = "events") -> str:
    """A WITH-chain that ends in relations ``classified`` (all lines) and ``entries``."""
    error_text = (f"regexp_matches(message, '{RE_ERROR_WORDS}')" if error_mode == "word" else
                  "(" + " OR ".join(f"contains(lower(message), '{w}')"
                                    for w in ("error", "failed", "failure", "exception", "critical", "panic")) + ")")
    if year_mode == "rollback":
        year_cte = f"""
yr AS (
  SELECT *, CASE WHEN route = 'bsd' THEN
      CASE WHEN {_ts('2024', 'mo', 'dd', 'hh', 'mi', 'ss', 'us')} IS NULL
             OR {_ts('2024', 'mo', 'dd', 'hh', 'mi', 'ss', 'us')} > {AS_OF} THEN 2023 ELSE 2024 END
    ELSE yy END AS year
  FROM parts
)"""
    else:
        if year_mode == "sequential":
            year_expr = f"{base_year} + sum(step) OVER (ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        else:
            year_expr = f"{base_year} + step"
        year_cte = f"""
bsd_steps AS (
  SELECT line_seq, CASE WHEN prev = 12 AND mo = 1 THEN 1 WHEN prev = 1 AND mo = 12 THEN -1 ELSE 0 END AS step
  FROM (SELECT line_seq, mo, lag(mo) OVER (ORDER BY line_seq) AS prev FROM parts WHERE route = 'bsd' AND format IS NOT NULL)
),
bsd_years AS (SELECT line_seq, {year_expr} AS year FROM bsd_steps),
yr AS (
  SELECT p.*, CASE WHEN p.route = 'bsd' THEN b.year ELSE p.yy END AS year
  FROM parts p LEFT JOIN bsd_years b USING (line_seq)
)"""
    lens_cte = _lens(shift) if source == "events" else _doc_lens()
    return f"""WITH {lens_cte},
routed AS (
  SELECT line_seq, line,
    CASE WHEN length(line) >= 15 AND substr(line, 1, 3) IN ('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec') THEN 'bsd'
         WHEN length(line) >= 15 AND regexp_matches(line, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'iso' END AS route
  FROM lens
),
fmt AS (
  SELECT *,
    CASE WHEN route = 'bsd' AND regexp_matches(line, '{RE_WITH_LEVEL}') THEN 'with_level'
         WHEN route = 'bsd' AND regexp_matches(line, '{RE_TRADITIONAL}') THEN 'traditional'
         WHEN route = 'bsd' AND regexp_matches(line, '{RE_SIMPLE}') THEN 'traditional_simple'
         WHEN route = 'iso' AND regexp_matches(line, '{RE_ISO}') THEN 'iso8601' END AS format
  FROM routed
),
fields AS (
  SELECT line_seq, line, route, format,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 1)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 1) END AS mon,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 2)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 2) END AS day_s,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 3)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 3)
                WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 2) END AS clock,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 4)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 4)
                WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 3) END AS frac,
    CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 1) END AS date_s,
    CASE format WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 5) END AS boff,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 5)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 5)
                WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 6) END AS host,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 6)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 6)
                WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 7) END AS service,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 7)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 7)
                WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 8) END AS pid,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 8) END AS level_s,
    CASE format WHEN 'with_level' THEN regexp_extract(line, '{RE_WITH_LEVEL}', 9)
                WHEN 'traditional' THEN regexp_extract(line, '{RE_TRADITIONAL}', 8)
                WHEN 'iso8601' THEN regexp_extract(line, '{RE_ISO}', 9) END AS msg
  FROM fmt
),
parts AS (
  SELECT *,
    CASE WHEN route = 'bsd' THEN list_position({MONTH_LIST}, mon) ELSE CAST(substr(date_s, 6, 2) AS INT) END AS mo,
    CASE WHEN route = 'bsd' THEN CAST(day_s AS INT) ELSE CAST(substr(date_s, 9, 2) AS INT) END AS dd,
    CAST(substr(clock, 1, 2) AS INT) AS hh, CAST(substr(clock, 4, 2) AS INT) AS mi,
    CAST(substr(clock, 7, 2) AS INT) AS ss,
    CASE WHEN frac IS NULL OR frac = '' THEN 0 ELSE CAST(rpad(substr(frac, 1, 6), 6, '0') AS INT) END AS us,
    CASE WHEN route = 'iso' THEN CAST(substr(date_s, 1, 4) AS INT) END AS yy,
    (route = 'iso' AND (length(frac) > 6 OR boff <> '')) AS bad
  FROM fields
),
{year_cte},
stamped AS (
  SELECT *, CASE WHEN format IS NULL OR bad THEN NULL
                 ELSE {_ts('year', 'mo', 'dd', 'hh', 'mi', 'ss', 'us')} END AS ts0
  FROM yr
),
classified AS (
  SELECT *, CASE WHEN ts0 >= {AS_OF} - INTERVAL {max_days} DAY AND ts0 <= {AS_OF} + INTERVAL 1 DAY
                 THEN ts0 END AS ts
  FROM stamped
),
entries0 AS (
  SELECT ts AS timestamp, trim(service) AS service, trim(msg) AS message,
         nullif(level_s, '') AS level, nullif(host, '') AS host, nullif(pid, '') AS pid,
         line AS raw_line, format, CAST(ts AS DATE) AS log_date, strftime(ts, '%H:00') AS hour_bucket,
         line_seq
  FROM classified WHERE ts IS NOT NULL
),
entries1 AS (
  SELECT *, (coalesce(upper(level) IN ('ERROR','CRITICAL','FATAL'), false) OR {error_text}) AS is_error
  FROM entries0
),
entries AS (
  SELECT * FROM entries1
)
"""


TS_TEXT = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
DATE_TEXT = "strftime({c}, '%Y-%m-%d')"


def _t(c: str) -> str:
    return TS_TEXT.format(c=c)


def _d(c: str) -> str:
    return DATE_TEXT.format(c=c)


def _hits(where: str) -> str:
    return entries_sql() + f"SELECT line_seq, {_t('timestamp')} AS timestamp, service, level, message FROM entries WHERE {where}"


def _iso_text(c: str) -> str:
    return (f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 <> 0 "
            f"THEN '.' || strftime({c}, '%f') ELSE '' END")


def _hit_text(width: int, with_level: bool) -> str:
    stamp = (f"strftime(timestamp, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(timestamp) % 1000000 <> 0 "
             f"THEN '.' || strftime(timestamp, '%f') ELSE '' END")
    lvl = " || coalesce(level, 'N/A') || ': '" if with_level else ""
    return f"{stamp} || ' [' || service || '] '{lvl} || substr(message, 1, {width}) || '...'"


def _cluster_pattern() -> str:
    return ("CASE WHEN len(regexp_split_to_array(trim(message), '\\s+')) > 3 "
            "THEN array_to_string(regexp_split_to_array(trim(message), '\\s+')[1:3], ' ') || '...' "
            "ELSE message END")


SEVERITY = """CASE
        WHEN level IS NOT NULL THEN CASE upper(level) WHEN 'ERROR' THEN 'red' WHEN 'ERR' THEN 'red'
             WHEN 'FATAL' THEN 'bold red' WHEN 'WARN' THEN 'yellow' WHEN 'WARNING' THEN 'yellow'
             WHEN 'INFO' THEN 'green' WHEN 'DEBUG' THEN 'blue' WHEN 'CRIT' THEN 'bold red'
             WHEN 'CRITICAL' THEN 'bold red' ELSE 'white' END
        WHEN contains(lower(message), 'error') OR contains(lower(message), 'failed')
             OR contains(lower(message), 'failure') OR contains(lower(message), 'exception')
             OR contains(lower(message), 'critical') THEN 'red'
        ELSE 'white' END"""


def _tree_rows(limit: int, mode: str, trunc: int, source: str = "events") -> str:
    if mode == "full":
        body = "message"
    else:
        body = f"CASE WHEN length(message) > {trunc} THEN substr(message, 1, {trunc}) || '...' ELSE message END"
    return entries_sql(source=source) + f""",
nodes AS (SELECT log_date, service, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors
          FROM entries GROUP BY log_date, service),
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_date, service ORDER BY timestamp, line_seq) AS rn
           FROM entries),
shown AS (SELECT r.*, nd.n FROM ranked r JOIN nodes nd USING (log_date, service) WHERE rn <= {limit}),
shown_err AS (SELECT log_date, service, count(*) FILTER (WHERE is_error) AS se FROM shown GROUP BY log_date, service)
SELECT {_d('log_date')} AS log_date, NULL::VARCHAR AS service, 'date' AS kind, 0::BIGINT AS rn, 0::BIGINT AS part,
       {_d('log_date')} AS text, NULL::VARCHAR AS severity FROM (SELECT DISTINCT log_date FROM nodes)
UNION ALL
SELECT {_d('log_date')}, service, 'service', 0, 0,
       '├── ' || service || CASE WHEN errors > 0 THEN ' [errors: ' || errors || ']' ELSE '' END, NULL FROM nodes
UNION ALL
SELECT {_d('log_date')}, service, 'entry', rn, 0,
       CASE WHEN rn = least(n, {limit}) THEN '│   └── ' ELSE '│   ├── ' END
       || '[' || strftime(timestamp, '%H:%M:%S') || '] '
       || CASE WHEN level IS NOT NULL THEN '[' || level || '] ' ELSE '' END || {body}, {SEVERITY} FROM shown
UNION ALL
SELECT {_d('log_date')}, nd.service, 'overflow', {limit + 1}, 0,
       '│   └── ... (' || (n - {limit}) || ' more logs'
       || CASE WHEN errors - se > 0 THEN ', ' || (errors - se) || ' errors' ELSE '' END || ')', NULL
FROM nodes nd JOIN shown_err s USING (log_date, service) WHERE n > {limit}
"""


def _by_seq(**kw) -> str:
    return entries_sql(**kw) + f"SELECT line_seq, {_t('timestamp')} AS timestamp FROM entries"


def oracle_queries() -> dict[str, str]:
    E = entries_sql()
    q: dict[str, str] = {}
    q["entries"] = E + (f"SELECT {_t('timestamp')} AS timestamp, service, message, level, host, pid, raw_line, format, "
                        f"{_d('log_date')} AS log_date, hour_bucket, is_error, line_seq FROM entries")
    q["entries_iso"] = E + (f"SELECT line_seq, {_t('timestamp')} AS timestamp, host, service, pid, message "
                            f"FROM entries WHERE format = 'iso8601'")
    q["entries_levels"] = E + "SELECT line_seq, format, level, message FROM entries WHERE level IS NOT NULL"
    q["format_counts"] = E + ("SELECT CASE WHEN ts IS NOT NULL THEN format END AS format, count(*) AS n "
                              "FROM classified GROUP BY 1")
    q["parse_quality"] = E + ("SELECT count(*) AS lines, count(ts) AS entries, "
                              "coalesce(round(count(ts) * 100.0 / nullif(count(*), 0), 1), 0.0)::DOUBLE AS success_pct "
                              "FROM classified")
    q["year_rollback"] = _by_seq(shift=15)
    q["year_transition"] = _by_seq(shift=15, year_mode="transition", base_year=2023)
    q["year_sequential"] = _by_seq(shift=15, year_mode="sequential", base_year=2023)
    q["day_window"] = _by_seq(max_days=7)
    q["entries_journald"] = _mixed_rows("journald")
    q["entries_rainerscript"] = _mixed_rows("rainerscript_enhanced")
    q["entries_offsets"] = _mixed_rows("iso8601")
    q["entries_simple"] = _mixed_rows("traditional_simple", simple=True)
    counts = ("SELECT CASE WHEN ts IS NOT NULL THEN format END AS format, count(*) AS n FROM classified GROUP BY 1")
    q["format_counts_mixed"] = mixed_sql() + counts
    q["offsets_dropped"] = mixed_sql(offsets="drop") + counts
    q["errors_word"] = E + "SELECT line_seq, is_error FROM entries"
    q["errors_substring"] = entries_sql(error_mode="substring") + "SELECT line_seq, is_error FROM entries"
    q["find_errors"] = _hits("is_error")
    q["find_errors_service"] = _hits("is_error AND service = 'kernel'")
    q["filter_service"] = _hits("regexp_matches(service, 'web\\.|^auth')")
    q["filter_level"] = _hits("level = 'ERROR'")
    q["filter_message"] = _hits("contains(lower(message), 'fail')")
    q["filter_combined"] = _hits("regexp_matches(service, 'n') AND level = 'WARN' AND contains(lower(message), 'user 1')")
    q["tail_errors"] = E + (f"SELECT line_seq, {_hit_text(100, False)} AS text FROM entries WHERE is_error "
                            f"ORDER BY timestamp DESC, line_seq DESC LIMIT 10")
    q["tail_matches"] = E + (f"SELECT line_seq, {_hit_text(80, True)} AS text FROM entries "
                             f"WHERE contains(lower(message), 'click') ORDER BY timestamp DESC, line_seq DESC LIMIT 20")
    q["severity"] = E + f"SELECT line_seq, {SEVERITY} AS severity FROM entries"
    q["summary"] = E + (f"SELECT count(*) AS total_entries, count(DISTINCT service) AS unique_services, "
                        f"{_d('min(log_date)')} AS date_min, {_d('max(log_date)')} AS date_max, "
                        f"count(DISTINCT log_date) AS days_with_logs, "
                        f"count(*) FILTER (WHERE is_error) AS error_count FROM entries")
    q["summary_lines"] = E + """,
sm AS (SELECT count(*) AS total, count(DISTINCT service) AS svc, min(log_date) AS dmin, max(log_date) AS dmax,
              count(DISTINCT log_date) AS days, count(*) FILTER (WHERE is_error) AS errs FROM entries),
sc AS (SELECT service, count(*) AS n FROM entries GROUP BY service ORDER BY n DESC, service LIMIT 5),
lv AS (SELECT upper(level) AS key, count(*) AS n FROM entries WHERE level IS NOT NULL GROUP BY 1)
SELECT 0::BIGINT AS line_no, 'Summary:' AS text
UNION ALL SELECT 1, '  Total entries: ' || format('{:,}', total) FROM sm
UNION ALL SELECT 2, '  Unique services: ' || svc FROM sm
UNION ALL SELECT 3, '  Date range: ' || coalesce(strftime(dmin, '%Y-%m-%d'), '') || ' to '
                    || coalesce(strftime(dmax, '%Y-%m-%d'), '') FROM sm
UNION ALL SELECT 4, '  Days with logs: ' || days FROM sm
UNION ALL SELECT 5, '  Error count: ' || format('{:,}', errs) FROM sm
UNION ALL SELECT 6, '  Top services: ' || coalesce((SELECT string_agg(service || ' (' || format('{:,}', n) || ')', ', '
                    ORDER BY n DESC, service) FROM sc), '')
UNION ALL SELECT 7, '  Level distribution:' WHERE (SELECT count(*) FROM lv) > 0
UNION ALL SELECT 7 + row_number() OVER (ORDER BY n DESC, key), '    ' || key || ': ' || format('{:,}', n) FROM lv
"""
    q["ranked_distributions"] = E + """,
dist AS (SELECT 'service' AS kind, service AS key, count(*) AS n FROM entries GROUP BY ALL
         UNION ALL SELECT 'level', upper(level), count(*) FROM entries WHERE level IS NOT NULL GROUP BY ALL
         UNION ALL SELECT 'hour', hour_bucket, count(*) FROM entries GROUP BY ALL)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS rank, key, n FROM dist"""
    q["unique_services"] = E + "SELECT DISTINCT service FROM entries"
    q["date_range"] = E + (f"SELECT {_d('min(log_date)')} AS date_min, {_d('max(log_date)')} AS date_max, "
                           f"count(DISTINCT log_date) AS days_with_logs FROM entries")
    q["level_distribution"] = E + "SELECT upper(level) AS key, count(*) AS n FROM entries WHERE level IS NOT NULL GROUP BY 1"
    q["hourly_distribution"] = E + "SELECT hour_bucket AS key, count(*) AS n FROM entries GROUP BY 1"
    q["service_counts"] = E + "SELECT service AS key, count(*) AS n FROM entries GROUP BY 1"
    q["top_services"] = E + "SELECT service AS key, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, key LIMIT 5"
    tree_nodes = E + """,
nodes AS (SELECT log_date, service, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors
          FROM entries GROUP BY log_date, service),
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_date, service ORDER BY timestamp, line_seq) AS rn FROM entries),
shown_err AS (SELECT log_date, service, count(*) FILTER (WHERE is_error) AS se FROM ranked WHERE rn <= 5
              GROUP BY log_date, service),
tn AS (SELECT log_date, service, n, errors, greatest(n - 5, 0) AS overflow, errors - se AS overflow_errors
       FROM nodes JOIN shown_err USING (log_date, service))
"""
    q["tree_nodes"] = tree_nodes + f"SELECT {_d('log_date')} AS log_date, service, n, errors, overflow, overflow_errors FROM tn"
    q["tree_first_n"] = E + f"""SELECT {_d('log_date')} AS log_date, service, rn, line_seq FROM (
        SELECT *, row_number() OVER (PARTITION BY log_date, service ORDER BY timestamp, line_seq) AS rn FROM entries)
        WHERE rn <= 5"""
    q["tree_overflow"] = tree_nodes + (f"SELECT {_d('log_date')} AS log_date, service, overflow, overflow_errors "
                                       f"FROM tn WHERE overflow > 0")
    q["tree_rows"] = _tree_rows(5, "truncate", 80)
    q["tree_rows_truncated"] = _tree_rows(5, "truncate", 20)
    q["tree_rows_full"] = _tree_rows(5, "full", 80)
    q["error_clusters"] = E + (f"SELECT {_cluster_pattern()} AS pattern, count(*) AS n FROM entries WHERE is_error "
                               f"GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
    q["error_clusters_by_service"] = E + (f"SELECT service, {_cluster_pattern()} AS pattern, count(*) AS n "
                                          f"FROM entries WHERE is_error GROUP BY 1, 2")
    q["csv_frame"] = E + (f"SELECT {_iso_text('timestamp')} AS \"Timestamp\", service AS \"Service\", "
                          f"coalesce(level, '') AS \"Level\", coalesce(host, '') AS \"Host\", "
                          f"coalesce(pid, '') AS \"PID\", message AS \"Message\" FROM entries")
    D = entries_sql(source="documents")
    q["doc_entries"] = D + (f"SELECT line_seq, {_t('timestamp')} AS timestamp, service, pid, is_error, "
                            f"length(message) AS msg_chars, message FROM entries")
    q["doc_tree_rows"] = _tree_rows(5, "truncate", 80, source="documents")
    q["doc_error_clusters_by_service"] = D + (f"SELECT service, {_cluster_pattern()} AS pattern, count(*) AS n "
                                              f"FROM entries WHERE is_error GROUP BY 1, 2")
    q["plugin_busiest_minute"] = E + f""",
minutes AS (SELECT service, date_trunc('minute', timestamp) AS minute, count(*) AS c FROM entries GROUP BY ALL),
best AS (SELECT service, sum(c)::BIGINT AS n, count(*) AS active_minutes, first(minute ORDER BY c DESC, minute) AS busiest,
                max(c) AS busiest_n FROM minutes GROUP BY service)
SELECT service, n, active_minutes, {_t('busiest')} AS busiest, busiest_n FROM best"""
    # the same answers from a landed log
    for name in ("tree_rows", "tree_overflow", "summary", "parse_quality", "format_counts", "error_clusters"):
        q[f"landed_{name}"] = q[name]
    measured = {"services": "service", "hosts": "host", "messages": "message",
                "error_patterns": f"CASE WHEN is_error THEN {_cluster_pattern()} END"}
    q["landed_distinct"] = E + " UNION ALL ".join(
        f"SELECT '{what}' AS what, count(DISTINCT {value}) AS n, true AS near FROM entries"
        for what, value in measured.items())
    # two batches by the parity of the line; the day that the window's end cuts is one piece
    q["landed_top_patterns"] = E + f""",
counted AS (
    SELECT CASE WHEN log_date > DATE '2024-01-31' THEN -1 ELSE line_seq % 2 END AS batch, log_date,
           {_cluster_pattern()} AS pattern, count(*) AS n FROM entries WHERE is_error GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY batch, log_date ORDER BY n DESC, pattern) AS rank FROM counted
), listed AS (
    SELECT * FROM ranked WHERE rank <= CASE WHEN batch < 0 THEN 1000 ELSE 25 END
), cuts AS (
    SELECT batch, log_date, max(n) AS cut FROM ranked
    WHERE rank > CASE WHEN batch < 0 THEN 1000 ELSE 25 END GROUP BY ALL
), bounds AS (
    SELECT pattern, sum(n)::BIGINT AS n, (sum(n) + (SELECT coalesce(sum(cut), 0) FROM cuts)
           - sum(coalesce(cut, 0)))::BIGINT AS n_max
    FROM listed LEFT JOIN cuts USING (batch, log_date) GROUP BY pattern
), top AS (SELECT * FROM bounds ORDER BY n DESC, pattern LIMIT 10)
SELECT pattern, n, n_max, n >= greatest((SELECT coalesce(sum(cut), 0) FROM cuts),
       coalesce((SELECT max(n_max) FROM bounds WHERE pattern NOT IN (SELECT pattern FROM top)), 0)) AS sure
FROM top"""
    profile = ("SELECT '{}' AS file_path, CASE WHEN ts IS NOT NULL THEN nullif(host, '') END AS host, "
               "CASE WHEN ts IS NOT NULL THEN format END AS format, count(*) AS n FROM classified GROUP BY ALL")
    q["format_profile"] = E + profile.format("events")
    q["format_profile_mixed"] = mixed_sql() + profile.format("mixed")
    return q
