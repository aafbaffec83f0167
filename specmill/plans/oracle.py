"""ANSI-style SQL for the registered queries, run by another engine on the same tables."""

from __future__ import annotations

from specmill.functions.units import CONVERSIONS
from specmill.operators.records import ALL_PASSED, NO_PART, STATUS_WORDS, TABLE_COLUMNS
from specmill.operators.replies import PROMPT_TAIL, RETRY_NOTE, prompt_head
from specmill.operators.selection import FALLBACK_PAGES, KEYWORDS, MAX_CHARS, MIN_SCORE
from specmill.plans.derivations import (
    ANSI,
    attempts_sql,
    files_sql,
    ledger_sql,
    reidentified_batch_sql,
    reidentified_old_sql,
    replies_sql,
    upsert_rows_sql,
)
from specmill.sources.rules import FieldRule, RuleSet

# Words of the four languages of the documents; the default phrases do not occur there.
TEST_KEYWORDS = ("the", "tion", "und", "que", "License", "ich", "los", "en el", "output", "er")
SHORT = 20


def many_keywords() -> list[str]:
    """All pairs of letters and all numbers of three digits."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [a + b for a in letters for b in letters] + [str(n) for n in range(100, 1000)]


MANY_KEYWORDS = (
    "SELECT list(w) AS words FROM (SELECT chr(97 + a::int) || chr(97 + b::int) AS w FROM range(26) x(a), range(26) y(b) "
    "UNION ALL SELECT n::varchar AS w FROM range(100, 1000) z(n)) k"
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- replies and validation ------------------------------------------------------

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
BARE = f"trim(reply, {BLANKS})"
INSIDE = f"substr({BARE}, 4, length({BARE}) - 6)"
UNTAGGED = f"trim(case when starts_with({INSIDE}, 'json') then substr({INSIDE}, 5) else {INSIDE} end, {BLANKS})"
FENCED = f"starts_with({BARE}, '```') and ends_with({BARE}, '```') and length({BARE}) >= 6"
BODY = f"case when {FENCED} then {UNTAGGED} else reply end"
NUMBER = r"[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"


def _number_raw(r: FieldRule) -> str:
    entry = f"json_extract(body, '$.{r.name}')"
    is_object = f"json_type({entry}) = 'OBJECT'"
    return (
        f"case when {is_object} then json_extract({entry}, '$.value') else {entry} end AS {r.name}_j, "
        f"json_extract_string({r.name}_j, '$') AS {r.name}_t, json_type({r.name}_j) AS {r.name}_k, "
        f"case when {is_object} then json_extract_string({entry}, '$.unit') end AS {r.name}_unit"
    )


def raw_sql(rules: RuleSet, source: str) -> str:
    """Raw values of usable replies: <number>_t, <number>_k, <number>_unit and <text>_t."""
    parts = [
        _number_raw(r) if r.kind == "number" else f"json_extract_string(body, '$.{r.name}') AS {r.name}_t"
        for r in rules.fields
    ]
    return f"SELECT *, {', '.join(parts)} FROM (SELECT *, {BODY} AS body FROM ({source}) replies) bodies"


def _convert(r: FieldRule) -> str:
    arms = " ".join(
        f"when {_q(spelling)} then ({r.name}_n + {shift!r}::double) * {factor!r}::double / {divisor!r}::double"
        for spelling, (shift, factor, divisor) in CONVERSIONS[r.unit].items()
    )
    norm = f"lower(regexp_replace({r.name}_unit, '[\\s°º]', '', 'g'))"
    return f"case when {r.name}_unit is null then {r.name}_n else case {norm} {arms} end end"


def _shown(value: str) -> str:
    return f"case when {value} = floor({value}) then cast(cast({value} as bigint) as varchar) else cast({value} as varchar) end"


def _entry(field: str, code: str, severity: str, message: str, condition: str) -> str:
    return (
        f"case when {condition} then {{'field': {_q(field)}, 'code': {_q(code)}, "
        f"'severity': {_q(severity)}, 'message': {message}}} end"
    )


def checked_sql(rules: RuleSet, source: str | None = None) -> str:
    """Validated replies: one column per field, ``problems`` and ``status``."""
    parsed, finals, found = [], [], []
    for r in rules.fields:
        f, text = r.name, f"trim({r.name}_t)"
        blank = f"({f}_t is null or {text} = '')"
        if r.required:
            found.append(_entry(f, "missing", "error", "'Required field not found'", blank))
        if r.kind == "number":
            parsed.append(
                f"case when {f}_k = 'BOOLEAN' then case when {f}_t = 'true' then 1.0::double else 0.0::double end "
                f"when regexp_full_match({text}, '{NUMBER}') then try_cast(replace({text}, '_', '') as double) end AS {f}_p, "
                f"case when isfinite({f}_p) then {f}_p end AS {f}_n, {_convert(r)} AS {f}_c, round({f}_c, 3) + 0.0 AS {f}"
            )
            finals.append(f)
            found.append(_entry(
                f, "not_a_number", "error",
                f"'Expected a finite number, got ' || case when {f}_k = 'VARCHAR' then '''' || {f}_t || '''' else {f}_t end",
                f"not {blank} and {f}_n is null"))
            found.append(_entry(
                f, "missing_unit", "warning", _q(f"No unit given, assumed {r.unit}"),
                f"{f}_n is not null and {f}_unit is null"))
            found.append(_entry(
                f, "unknown_unit", "error", f"'Cannot convert unit ''' || {f}_unit || ''' to {r.unit}'",
                f"{f}_n is not null and {f}_unit is not null and {f}_c is null"))
            found.append(_entry(
                f, "out_of_range", "warning",
                f"{_shown(f)} || {_q(f' {r.unit} is outside the expected {r.low} to {r.high}')}",
                f"{f} < {r.low} or {f} > {r.high}"))
        elif r.kind == "enum":
            arms = " ".join(f"when {_q(a.lower())} then {_q(a)}" for a in r.allowed)
            parsed.append(
                f"case lower({text}) {arms} end AS {f}_known, "
                f"case when not {blank} then coalesce({f}_known, {text}) end AS {f}")
            finals.append(f)
            listing = _q("' is not one of: " + ", ".join(r.allowed))
            found.append(_entry(
                f, "invalid_enum", "warning", f"'''' || {text} || {listing}", f"not {blank} and {f}_known is null"))
        else:
            parsed.append(f"case when not {blank} then {text} end AS {f}")
            finals.append(f)
            if r.pattern:
                tail = _q(f"' does not match the expected pattern {r.pattern}")
                found.append(_entry(
                    f, "pattern_mismatch", "warning", f"'''' || {text} || {tail}",
                    f"not {blank} and not regexp_full_match({text}, {_q(r.pattern)})"))
    raw = raw_sql(rules, source or replies_sql(ANSI))
    return f"""
      SELECT seq, source_file, source_hash, {', '.join(finals)}, problems,
        case when len(list_filter(problems, lambda p: p.severity = 'error')) > 0 then 'error'
             when len(problems) > 0 then 'warning' else 'ok' end AS status
      FROM (SELECT *, list_filter([{', '.join(found)}], lambda p: p is not null) AS problems
            FROM (SELECT *, {', '.join(parsed)} FROM ({raw}) raw) parsed) judged"""


def records_sql(rules: RuleSet) -> str:
    return (
        "SELECT *, seq + 1 AS id, date '2024-01-01' + cast(seq % 365 as integer) AS extracted_on "
        f"FROM ({checked_sql(rules)}) checked"
    )


# -- pages ------------------------------------------------------------------------

STRIPPED = "trim(page, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8239) || chr(8195) || chr(12288))"
PAGES = f"""SELECT doc_id, sha256(text) AS source_hash, page_no, {STRIPPED} AS text
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS page,
               generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents) lines"""


def score_sql(keywords: tuple[str, ...]) -> str:
    return " + ".join(f"(case when contains(lower(text), {_q(k.lower())}) then 1 else 0 end)" for k in keywords)


def excerpts_sql(keywords: tuple[str, ...], min_score: int, cap: int, fallback: int, pages: str = PAGES) -> str:
    return f"""
      SELECT d.doc_id, coalesce(e.excerpt, '') AS excerpt FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg('--- page ' || page_no || ' ---' || chr(10) || substr(text, 1, cast({cap} - used as bigint)),
                                  chr(10) || chr(10) ORDER BY page_no) AS excerpt
        FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY rank_score DESC, page_no
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
              FROM (SELECT *, case when best >= {min_score} then score else 0 end AS rank_score
                    FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best
                          FROM (SELECT *, {score_sql(keywords)} AS score FROM ({pages}) p) s) b
                    WHERE case when best >= {min_score} then score >= {min_score} else page_no <= {fallback} end) r) u
        WHERE used < {cap} AND length(text) > 0 GROUP BY doc_id) e ON d.doc_id = e.doc_id"""


# -- all queries ------------------------------------------------------------------


def oracle_queries(rules: RuleSet) -> dict[str, str]:
    names = ", ".join(rules.names)
    records = f"({records_sql(rules)}) records"
    checked = f"({checked_sql(rules)}) checked"
    files, old = f"({files_sql(ANSI)}) files", f"({ledger_sql(ANSI)}) ledger"
    head, tail = _q(prompt_head(rules)), _q(PROMPT_TAIL)
    part = "coalesce(part_number, '')"
    base = "regexp_extract(source_file, '[^/]*$')"
    totals = f"SELECT doc_id, sum(length(text)) AS total, count(*) AS pages FROM ({PAGES}) p GROUP BY doc_id"
    words = "case status " + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS_WORDS.items()) + " end"
    excerpts = excerpts_sql(TEST_KEYWORDS, 4, 600, 3)
    full = excerpts_sql(KEYWORDS, MIN_SCORE, MAX_CHARS, FALLBACK_PAGES)
    # What the model of the scoring queries is shown, once per content.
    scored = f"""SELECT sha256(d.text) AS source_hash, min(length(e.excerpt)) AS chars FROM documents d
        JOIN ({full}) e ON d.doc_id = e.doc_id JOIN ({totals}) t ON d.doc_id = t.doc_id WHERE t.total >= {SHORT} GROUP BY 1"""

    # Every path of a first run whose model runs out of quota, with what a healthy model makes of its content.
    first_run = f"""
      SELECT d.doc_id AS seq, c.first_seq, c.total, c.pages, c.chars, c.total >= {SHORT} AND c.chars % 400 = 7 AS quota,
        case when c.total < {SHORT} then 'skipped' when c.chars % 400 = 7 or c.chars % 10 = 0 then 'failed' else 'stored' end AS now,
        case when c.total < {SHORT} then 'skipped' when c.chars % 10 = 0 then 'failed' else 'stored' end AS healthy
      FROM documents d JOIN (
        SELECT sha256(x.text) AS h, min(x.doc_id) AS first_seq, min(t.total) AS total, min(t.pages) AS pages, min(length(e.excerpt)) AS chars
        FROM documents x JOIN ({full}) e ON x.doc_id = e.doc_id JOIN ({totals}) t ON x.doc_id = t.doc_id GROUP BY 1) c
      ON sha256(d.text) = c.h"""

    known = f"""
      SELECT f.seq, f.source_file, f.source_hash, l.outcome AS old, l.record_id AS old_id, c.first_seq,
        (l.outcome IS NULL OR l.outcome = 'failed') AS todo,
        case when length(c.content) < {SHORT} then 'skipped' when c.first_seq % 5 = 0 then 'failed' else 'stored' end AS now
      FROM ({files_sql(ANSI)}) f
      JOIN (SELECT sha256(text) AS source_hash, min(doc_id) AS first_seq, min(text) AS content
            FROM documents GROUP BY sha256(text)) c ON f.source_hash = c.source_hash
      LEFT JOIN ({ledger_sql(ANSI)}) l ON f.source_hash = l.source_hash"""
    outcomes = f"""
      SELECT seq, source_file, source_hash,
        case when not todo or (seq > first_seq and now <> 'failed') then 'unchanged' else now end AS outcome,
        case when not todo then 'already ' || old when seq > first_seq and now <> 'failed' then 'already ' || now
             when now = 'failed' then 'RuntimeError: down' when now = 'skipped' then 'too short' end AS reason,
        case when not todo then old_id when now = 'stored' then 1000000 + first_seq end AS record_id,
        case when todo and seq = first_seq and now = 'stored' then 'ok' end AS status,
        case when todo and seq = first_seq and now = 'stored' then 'P-' || first_seq end AS part_number,
        case when todo and seq = first_seq and now = 'stored' then first_seq % 3 else 0 end AS problem_count
      FROM ({known}) known"""

    attempts = f"({attempts_sql(ANSI)}) attempts"
    usable = f"error IS NULL AND case when json_valid({BODY}) then json_type({BODY}) end = 'OBJECT'"
    judged = f"""
      SELECT *, case when {usable} then attempt end AS good, case when error is not null then attempt end AS bad,
        case when error is null and not coalesce({usable}, false) then
          case when json_valid({BODY}) then 'reply is JSON but not an object: list' else 'reply is not valid JSON' end end AS trouble
      FROM {attempts} WHERE attempt <= 3"""
    resolved = f"""
      SELECT source_hash, min(seq) AS seq,
        min(good) AS first_good, min(bad) AS first_bad, min_by(reply, good) AS reply,
        min_by(error, bad) AS first_error, max_by(trouble, case when trouble is not null then attempt end) AS last_trouble,
        min(bad) is not null and (min(good) is null or min(bad) < min(good)) AS beaten
      FROM ({judged}) judged GROUP BY source_hash"""
    resolution = f"""
      SELECT source_hash, seq, case when not beaten then first_good end AS attempt,
        case when beaten and first_error like '%429%' then 'API quota exhausted (HTTP 429); run again later'
             when beaten then first_error
             when first_good is null then 'No usable reply after 3 attempt(s): ' || last_trouble end AS failure,
        coalesce(beaten and (first_error like '%429%' or first_error like '%RESOURCE_EXHAUSTED%'), false) AS quota,
        case when not beaten then json_extract_string({BODY}, '$.part_number') end AS part_number
      FROM ({resolved}) resolved"""

    ident = "case when part_number is null then 'h|' || source_hash else 'p|' || coalesce(manufacturer, '?') || '|' || part_number end AS ident"
    upsert = f"""
      WITH old AS (SELECT *, {ident} FROM ({upsert_rows_sql(0, 2)}) o), new AS (SELECT *, {ident} FROM ({upsert_rows_sql(1)}) n),
      last AS (SELECT ident, max(seq) AS seq, min(seq) AS first FROM new GROUP BY ident),
      fresh AS (SELECT ident, row_number() OVER (ORDER BY first) + (SELECT max(seq) + 1 FROM old) AS id
                FROM last WHERE ident NOT IN (SELECT ident FROM old))
      SELECT seq + 1 AS id, source_hash, manufacturer, part_number, p_size FROM old WHERE ident NOT IN (SELECT ident FROM new)
      UNION ALL
      SELECT coalesce(o.seq + 1, f.id) AS id, n.source_hash, n.manufacturer, n.part_number, n.p_size
      FROM last l JOIN new n ON l.seq = n.seq LEFT JOIN old o ON o.ident = l.ident LEFT JOIN fresh f ON f.ident = l.ident"""
    # The batch is built so that its row-by-row result can be written down; see its derivation.
    reidentified = f"""
      WITH old AS ({reidentified_old_sql()}), new AS ({reidentified_batch_sql()}),
      born AS (SELECT seq FROM new WHERE seq % 10 = 2 UNION ALL SELECT 16 WHERE EXISTS (SELECT 1 FROM new WHERE seq = 17)
               UNION ALL SELECT min(seq) FROM new WHERE part_number = 'HOT' AND seq > 17 HAVING count(*) > 0),
      ids AS (SELECT seq, row_number() OVER (ORDER BY seq) + (SELECT max(id) FROM old) AS id FROM born),
      ends AS (
        SELECT k + 1 AS id, case when k % 4 = 0 then 10 * k + 4 else 10 * k + 1 end AS seq FROM (SELECT id - 1 AS k FROM old) o WHERE k % 6 = 0
        UNION ALL SELECT i.id, case when (i.seq // 10) % 4 = 0 then i.seq + 3 else i.seq end FROM ids i WHERE i.seq % 10 = 2
        UNION ALL SELECT i.id, 17 FROM ids i WHERE i.seq = 16
        UNION ALL SELECT i.id, (SELECT max(seq) FROM new WHERE part_number = 'HOT') FROM ids i WHERE i.seq % 10 = 6 AND i.seq <> 16)
      SELECT id, source_hash, part_number, p_size FROM old WHERE id NOT IN (SELECT id FROM ends)
      UNION ALL SELECT e.id, n.source_hash, n.part_number, n.p_size FROM ends e JOIN new n ON e.seq = n.seq"""

    facets = f"SELECT id, part_number, manufacturer, sensor_type, status, operating_temp_min FROM {records}"
    brands = "manufacturer IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#17') AND "
    facet_where = (
        f"WHERE {brands}status IN ('warning', 'error') "
        f"AND contains(lower({part}), 'ring') AND operating_temp_min <= -5 AND weight > 100"
    )
    hit = f"(manufacturer IN ('Brand#1', 'Brand#5') AND operating_temp_min <= -20 AND contains(lower({part}), 'bolt'))"

    return {
        "q_fingerprint_dups": f"""SELECT source_hash, min(seq) AS seq, min_by(source_file, seq) AS source_file,
            max(seq) AS last_seq, max_by(source_file, seq) AS last_file, count(*) AS copies FROM {files} GROUP BY source_hash""",
        "q_paginate": f"SELECT doc_id, page_no, length(text) AS chars, sha256(text) AS page_hash FROM ({PAGES}) p",
        "q_no_text": f"""SELECT doc_id, 'doc-' || doc_id || '.pdf: only ' || total || ' characters of text across ' || pages
            || ' page(s). Is this a scanned image?' AS skip_reason FROM ({totals}) t WHERE total < {SHORT}""",
        "q_page_score": f"SELECT doc_id, page_no, {score_sql(TEST_KEYWORDS)} AS score FROM ({PAGES}) p",
        "q_page_score_many": "SELECT doc_id, page_no, "
        "cast(len(list_filter(words, lambda w: contains(lower(text), w))) as integer) AS score "
        f"FROM ({PAGES}) p, ({MANY_KEYWORDS}) many",
        "q_page_select": f"SELECT doc_id, length(excerpt) AS chars, sha256(excerpt) AS excerpt_hash FROM ({excerpts}) e",
        "q_page_select_long": f"SELECT doc_id, length(excerpt) AS chars, sha256(excerpt) AS excerpt_hash FROM ({excerpts}) e",
        "q_prompt_length": f"""SELECT doc_id, length(p) AS chars, sha256(p) AS prompt_hash, sha256(p || {_q(RETRY_NOTE)}) AS retry_hash
            FROM (SELECT doc_id, {head} || replace(text, '\"\"\"', '''''''''') || {tail} AS p FROM documents) t""",
        "q_first_valid_reply": f"SELECT source_hash, attempt, failure, quota, part_number FROM ({resolution}) r",
        "q_enforce_schema": f"""SELECT seq, manufacturer_t AS manufacturer, part_number_t AS part_number, weight_t AS weight_value,
            weight_unit, operating_temp_min_t AS temp_value, operating_temp_min_unit AS temp_unit, response_time_t AS response_value,
            case response_time_k when 'BOOLEAN' then 'BOOLEAN' when 'VARCHAR' then 'STRING' end AS response_kind
            FROM ({raw_sql(rules, replies_sql(ANSI))}) raw""",
        "q_quota_deferral": f"""WITH r AS ({resolution}), cut AS (SELECT min(seq) AS c FROM r WHERE quota)
            SELECT seq, case when seq > c then 'deferred' when failure is not null then 'failed' else 'stored' end AS outcome
            FROM r LEFT JOIN cut ON true""",
        "q_units": f"""SELECT seq, operating_temp_min, operating_temp_min_unit AS temp_unit, weight, weight_unit,
            supply_voltage_min, supply_voltage_min_unit AS volt_unit
            FROM ({checked_sql(rules).replace('SELECT seq, source_file', 'SELECT operating_temp_min_unit, weight_unit, supply_voltage_min_unit, seq, source_file', 1)}) c""",
        "q_number_guard": f"""SELECT seq, response_time, list_filter(problems, lambda p: p.field = 'response_time')[1].code AS code
            FROM {checked}""",
        "q_enum_pattern": f"""SELECT seq, sensor_type, output_signal, ip_rating,
            len(list_filter(problems, lambda p: p.code = 'invalid_enum')) AS bad_enums,
            len(list_filter(problems, lambda p: p.code = 'pattern_mismatch')) AS bad_patterns FROM {checked}""",
        "q_validate_problems": f"""SELECT seq, position, p.field AS field, p.code AS code, p.severity AS severity, p.message AS message
            FROM (SELECT seq, unnest(problems) AS p, generate_subscripts(problems, 1) - 1 AS position FROM {checked}) e""",
        "q_validated_values": f"SELECT seq, status, {names} FROM {checked}",
        "q_status_counts": f"SELECT status, count(*) AS records FROM {checked} GROUP BY status",
        "q_on_file": f"""SELECT total, flagged, case when flagged > 0 then total || ' records on file, ' || flagged || ' need attention'
            else total || ' records on file' end AS text
            FROM (SELECT count(*) AS total, count(*) FILTER (status <> 'ok') AS flagged FROM {checked}) c""",
        "q_severity_slices": f"""SELECT source_hash, manufacturer, part_number, status,
            len(list_filter(problems, lambda p: p.severity = 'error')) AS errors,
            len(list_filter(problems, lambda p: p.severity = 'warning')) AS warnings FROM {checked}""",
        "q_unseen": f"SELECT seq, source_file, source_hash FROM {files} WHERE source_hash NOT IN (SELECT source_hash FROM {old} WHERE outcome <> 'failed')",
        "q_seen_filter": outcomes,
        "q_ledger_merge": f"""SELECT source_hash, source_file, outcome, reason, record_id FROM (
              SELECT source_hash, source_file, outcome, reason, record_id FROM {old}
              WHERE source_hash NOT IN (SELECT source_hash FROM ({outcomes}) o WHERE outcome <> 'unchanged')
              UNION ALL
              SELECT source_hash, source_file, outcome, reason, record_id FROM ({outcomes}) o
              WHERE outcome <> 'unchanged' AND seq IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))) m""",
        "q_run_summary": f"""SELECT position, k.outcome AS outcome, count(o.outcome) AS files
            FROM (VALUES (0, 'stored'), (1, 'skipped'), (2, 'failed'), (3, 'deferred'), (4, 'unchanged')) k(position, outcome)
            LEFT JOIN ({outcomes}) o ON o.outcome = k.outcome GROUP BY position, k.outcome""",
        "q_outcome_lines": f"""SELECT seq, rpad({base}, 36, ' ') || ' ' || rpad(outcome, 10, ' ') || ' ' ||
            case when outcome = 'stored' then rpad(status, 8, ' ') || ' ' || rpad(part_number, 18, ' ') || ' ' || problem_count || ' problem(s)'
                 else coalesce(reason, '') end AS line FROM ({outcomes}) o""",
        "q_upsert_fast": upsert,
        "q_upsert_reidentify": reidentified,
        "q_record_get": f"SELECT id, manufacturer, part_number, status FROM {records} WHERE id = 8",
        "q_record_count": f"SELECT count(*) AS records FROM {records}",
        "q_list_ordered": f"SELECT id, {', '.join(c for c, _ in TABLE_COLUMNS if c != 'status_word')}, {words} AS status_word FROM {records}",
        "q_find": f"SELECT id, manufacturer, part_number, operating_temp_min, status FROM {records} WHERE operating_temp_min < -20",
        "q_find_text": f"SELECT id, part_number, sensor_type FROM {records} WHERE sensor_type <> 'temperature'",
        "q_facet_filter": f"{facets} {facet_where}",
        "q_facet_search": f"{facets} {facet_where.replace(brands, '')}",
        "q_facet_values": f"SELECT DISTINCT manufacturer AS value FROM {records} WHERE manufacturer <> ''",
        "q_flatten": f"""SELECT id, status, {words} AS status_word, len(problems) AS problem_count, {base} AS source_file,
            problems[1].severity AS first_severity, problems[1].field AS first_field, problems[1].message AS first_message FROM {records}""",
        "q_json_export": f"""SELECT id, manufacturer, sensor_type, weight, operating_temp_min, ip_rating, len(problems) AS problem_count,
            problems[1].code AS first_code FROM {records}""",
        "q_span_report": f"""SELECT id, case when {part} <> '' then part_number else {base} end AS label, operating_temp_min AS start,
            operating_temp_max - operating_temp_min AS span, operating_temp_max AS "end" FROM {records}
            WHERE operating_temp_min is not null AND operating_temp_max is not null""",
        "q_match_kpi": f"""SELECT total, matched, flagged, case when total = 0 then 'none' when matched = 0
              then 'No sensors match. Loosen a filter to see more.'
              else matched || ' of ' || total || case when matched = 1 then ' sensor matches.' else ' sensors match.' end ||
                case when flagged > 0 then ' ' || flagged || ' of them need attention.' else '' end end AS text
            FROM (SELECT count(*) AS total, count(*) FILTER (coalesce({hit}, false)) AS matched,
                  count(*) FILTER (coalesce({hit}, false) AND status <> 'ok') AS flagged FROM {records}) c""",
        "q_problem_detail": f"""SELECT id, case when {part} <> '' then part_number else {_q(NO_PART)} end AS heading, {base} AS source_file,
            strftime(extracted_on, '%Y-%m-%d') AS extracted_on, position, p.severity AS severity, replace(p.field, '_', ' ') AS field,
            coalesce(p.message, {_q(ALL_PASSED)}) AS message
            FROM (SELECT *, unnest(case when len(problems) = 0 then [null] else problems end) AS p,
                    unnest(case when len(problems) = 0 then [null] else generate_series(0, len(problems) - 1) end) AS position
                  FROM {records}) e""",
        "q_page_of_results": f"""SELECT id, part_number, weight FROM {records}
            ORDER BY weight DESC NULLS LAST, id LIMIT 15 OFFSET 45""",
        "q_score_job": f"""SELECT source_hash, attempt, case when chars % 10 = 0 then false when chars % 5 = 0 then attempt = 2 else true end AS usable
            FROM ({scored}) s, unnest([1, 2, 3]) t(attempt)
            WHERE attempt <= case when chars % 10 = 0 then 3 when chars % 5 = 0 then 2 else 1 end""",
        "q_reply_journal": f"""SELECT source_hash, paid, paid AS last_number, true AS usable, 0 AS errors
            FROM (SELECT source_hash, case when chars % 5 = 0 then 2 else 1 end AS paid FROM ({scored}) s) p""",
        "q_stream_files": f"""SELECT source_hash, case when chars % 10 = 0 then 'failed' else 'stored' end AS outcome,
              chars % 10 <> 0 AS has_record, chars % 10 = 0 AS waits FROM ({scored}) s
            UNION ALL SELECT DISTINCT sha256(text), 'skipped', false, false FROM documents
              WHERE doc_id IN (SELECT doc_id FROM ({totals}) t WHERE total < {SHORT})""",
        "q_run_quota": f"""
            SELECT seq, case when seq > cut then 'deferred' when seq > first_seq and now <> 'failed' then 'unchanged' else now end AS outcome,
              case when seq > cut then 'API quota exhausted; run again later'
                   when seq > first_seq and now <> 'failed' then 'already ' || now
                   when now = 'skipped' then 'doc-' || first_seq || '.pdf: only ' || total || ' characters of text across ' || pages
                     || ' page(s). Is this a scanned image?'
                   when quota then 'API quota exhausted (HTTP 429); run again later'
                   when now = 'failed' then 'No usable reply after 3 attempt(s): reply is not valid JSON' end AS reason
            FROM ({first_run}) r LEFT JOIN (SELECT min(first_seq) AS cut FROM ({first_run}) q WHERE quota) c ON true""",
        "q_run_resume": f"""
            SELECT seq, case when (first_seq < cut and now <> 'failed') or (seq > first_seq and healthy <> 'failed') then 'unchanged' else healthy end AS outcome,
              healthy AS in_ledger, case when healthy = 'stored' then 'P' || chars end AS part_number,
              case when healthy = 'stored' then 'error' end AS record_status
            FROM ({first_run}) r LEFT JOIN (SELECT coalesce(min(first_seq), 1000000000) AS cut FROM ({first_run}) q WHERE quota) c ON true""",
        "q_dashboard": f"""
            WITH f AS (SELECT * FROM {records}), m AS (SELECT * FROM f WHERE manufacturer = 'Brand#1' AND contains(lower({part}), 'in')
              AND operating_temp_min <= -5)
            SELECT 'row' AS part, id, part_number AS text, cast(null as double) AS span FROM m
            UNION ALL SELECT 'answer', null, case when total = 0 then 'none' when matched = 0 then 'No sensors match. Loosen a filter to see more.'
              else matched || ' of ' || total || case when matched = 1 then ' sensor matches.' else ' sensors match.' end ||
                case when flagged > 0 then ' ' || flagged || ' of them need attention.' else '' end end, null
            FROM (SELECT (SELECT count(*) FROM f) AS total, count(*) AS matched, count(*) FILTER (status <> 'ok') AS flagged FROM m) c
            UNION ALL SELECT 'span', id, case when {part} <> '' then part_number else {base} end, operating_temp_max - operating_temp_min
            FROM m WHERE operating_temp_min is not null AND operating_temp_max is not null""",
        "q_stream_incremental": f"""SELECT source_hash, case when chars % 20 = 0 then 'failed' else 'stored' end AS outcome,
              chars % 20 <> 0 AS has_record FROM ({scored}) s
            UNION ALL SELECT DISTINCT sha256(text), 'skipped', false FROM documents WHERE doc_id IN (SELECT doc_id FROM ({totals}) t WHERE total < {SHORT})""",
    }
