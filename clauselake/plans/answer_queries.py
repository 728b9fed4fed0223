"""Registered queries for answer validation; answers are built from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import answers as M
from clauselake.plans import fixtures as X

# the same text is valid in both engines
_BODY = """'{"finding_type": "' || CASE event_id % 6 WHEN 0 THEN 'present_risky' WHEN 1 THEN 'ABSENT' WHEN 2 THEN 'ambiguous'
 WHEN 3 THEN 'none' WHEN 4 THEN 'harmless' ELSE 'absent' END || '", "severity": "' || CASE event_id % 7 WHEN 0 THEN 'critical'
 WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'urgent' ELSE 'info' END || '", "summary": "' || repeat(event_type || ' ', 1 + user_id % 250)
 || '", "rationale": "user ' || user_id || '", "negotiation_ask": ' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '"ask ' || event_type || '"' END
 || ', "clause_ordinals": [' || (event_id % 40) || ', "x", "' || (event_id % 5 + 1) || '"], "suggested_edits": [{"original_text": "old ' || user_id
 || '", "revised_text": "new"}, "junk", {"original_text": "", "revised_text": "c"}, {"original_text": "o2", "revised_text": "r2", "comment": "'
 || event_type || '"}], "citation_basis": "' || CASE event_id % 3 WHEN 0 THEN 'statutory' WHEN 1 THEN 'Doctrinal' ELSE 'doctrinal' END || '"}'"""
_CONTENT = f"""CASE event_id % 11 WHEN 3 THEN 'sorry, no answer {{' WHEN 5 THEN '[1, 2]' WHEN 7 THEN 'Here: ' || {_BODY} || ' done'
 WHEN 9 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' ELSE {_BODY} END"""
_RESPONSE = f"""SELECT CAST((event_id - event_id % 2) / 2 AS BIGINT) AS request_id, CAST(event_id % 2 + 1 AS INTEGER) AS attempt,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE {_CONTENT} END AS content, CASE WHEN event_id % 9 = 0 THEN 'timeout' END AS error,
 CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, 'model-' || (user_id % 3) AS model,
 'domain_' || (event_id % 18) AS domain, CAST(event_id % 1000 AS BIGINT) AS version_id, user_id, event_type, ts FROM events"""

_BATCH = """SELECT event_id AS batch_id, CAST(event_id % 4 AS INTEGER) AS expected, CASE event_id % 7
 WHEN 0 THEN 'garbage' WHEN 1 THEN '[' || item || ', ' || item2 || ']' WHEN 2 THEN '{"items": [' || item2 || ']}'
 WHEN 3 THEN '{"results": [' || item || ', 5]}' WHEN 4 THEN '{"other": 1}' ELSE '{"changes": [' || item || ', ' || item2 || ', ' || item || ']}' END AS content
 FROM (SELECT event_id, '{"index": 9, "materiality": "' || CASE event_id % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'Immaterial' WHEN 2 THEN 'maybe'
 WHEN 3 THEN '' ELSE 'immaterial' END || '", "materiality_reason": "because ' || event_type || '"}' AS item,
 '{"materiality": "material", "reason": "' || repeat(event_type, 1 + CAST(user_id % 150 AS INTEGER)) || '"}' AS item2 FROM events) e"""

_SUMMARY = """SELECT event_id AS version_id, CAST(user_id % 4 AS INTEGER) AS n_clauses, CASE WHEN event_id % 8 = 0 THEN 'down' END AS error,
 CASE event_id % 5 WHEN 0 THEN '{"ringkasan": "r ' || event_type || '"}' WHEN 1 THEN '{"summary": "s ' || user_id || '", "ringkasan": ""}'
 WHEN 2 THEN 'no json' WHEN 3 THEN '["list"]' ELSE '{"other":"o ' || event_type || '"}' END AS content FROM events"""


def _events(spark, sf_dir, sql):
    events = X.dealt(X.read(spark, sf_dir, "events"), "event_id")
    text = sql.replace("FROM events", "FROM {events}").replace("user_id % 250", "CAST(user_id % 250 AS INT)")
    return X.run_sql(spark, text, events=events)


def responses(spark, sf_dir):
    return _events(spark, sf_dir, _RESPONSE)


def _findings(spark, sf_dir):
    return M.parse_finding(M.extract_json(responses(spark, sf_dir)))


def _extract(spark, sf_dir):
    out = M.extract_json(responses(spark, sf_dir))
    return out.select(
        "request_id", "attempt", "parse_status", M._get(F.col("answer"), "rationale").alias("rationale")
    )


def _finding(spark, sf_dir):
    return _findings(spark, sf_dir).select(
        "request_id", "attempt", "finding_status", "finding_type", "severity", "negotiation_ask"
    )


def _keyed(spark, sf_dir):
    """Each round-trip on its own: request ids made unique per attempt."""
    key = (F.col("request_id") * 2 + F.col("attempt") - 1).alias("request_id")
    rows = responses(spark, sf_dir)
    return M.extract_json(rows.select(key, *[c for c in rows.columns if c != "request_id"]))


def _edits(spark, sf_dir):
    return M.parse_edits(_keyed(spark, sf_dir))


def _basis(spark, sf_dir):
    return M.citation_basis(_keyed(spark, sf_dir)).select("request_id", "citation_basis")


def _clause(spark, sf_dir):
    clauses = X.line_rows(spark, sf_dir).select(
        F.col("doc_id").alias("version_id"),
        F.col("pos").alias("ordinal"),
        F.concat_ws(":", "doc_id", "pos").alias("clause_id"),
    )
    answers = _keyed(spark, sf_dir).select("request_id", "version_id", "answer")
    return M.resolve_clause(answers, clauses).select("request_id", "version_id", "clause_id")


def _persist(spark, sf_dir):
    found = M.persist_findings(M.parse_finding(_keyed(spark, sf_dir)))
    return found.select(
        "request_id", "finding_type", "severity", "summary", "rationale", "negotiation_ask", "oversized"
    )


def _persist_edits(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return M.persist_edits(M.parse_edits(keyed), M.parse_finding(keyed))


def _materiality(spark, sf_dir):
    return M.parse_materiality(_events(spark, sf_dir, _BATCH))


def _attempts(spark, sf_dir):
    return M.resolve_attempts(responses(spark, sf_dir))


def _meter(spark, sf_dir):
    return M.meter_attempts(responses(spark, sf_dir))


def _meter_batches(spark, sf_dir):
    """Every event as the call of a change batch."""
    rows = responses(spark, sf_dir)
    key = (F.col("request_id") * 2 + F.col("attempt") - 1).alias("batch_id")
    return M.meter_batches(rows.select(key, "error", "input_tokens", "output_tokens", "model"))


def usage(spark, sf_dir):
    rows = responses(spark, sf_dir)
    failed = F.col("error").isNotNull()
    return rows.select(
        "user_id",
        F.when(~failed, F.col("input_tokens")).alias("input_tokens"),
        F.when(~failed, F.col("output_tokens")).alias("output_tokens"),
        F.when(~failed, F.col("model")).alias("model"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.col("ts").alias("created_at"),
    )


def _rollup(spark, sf_dir):
    return M.usage_rollup(usage(spark, sf_dir))


def _subtotals(spark, sf_dir):
    return M.usage_subtotals(usage(spark, sf_dir))


def _summary(spark, sf_dir):
    return M.summary_outcome(_events(spark, sf_dir, _SUMMARY))


QUERIES = {
    "extract_json": _extract,
    "parse_finding": _finding,
    "parse_edits": _edits,
    "citation_basis": _basis,
    "resolve_clause": _clause,
    "persist_findings": _persist,
    "persist_edits": _persist_edits,
    "parse_materiality": _materiality,
    "resolve_attempts": _attempts,
    "meter_attempts": _meter,
    "meter_batches": _meter_batches,
    "usage_rollup": _rollup,
    "usage_subtotals": _subtotals,
    "summary_outcome": _summary,
}

_types = "'present_risky', 'absent', 'ambiguous', 'none'"
_sevs = "'critical', 'high', 'medium', 'info'"


def _json(c: str) -> str:
    fenced = f"regexp_extract({c}, '```(?:json)?\\s*([\\s\\S]+?)\\s*```', 1)"
    braced = f"regexp_extract({c}, '\\{{[\\s\\S]+\\}}')"
    return (
        f"CASE WHEN json_valid(trim({c})) THEN trim({c}) WHEN json_valid({fenced}) THEN {fenced}"
        f" WHEN json_valid({braced}) THEN {braced} END"
    )


_BASE = f"""WITH response AS MATERIALIZED ({_RESPONSE}),
answer AS MATERIALIZED (SELECT *, {_json('content')} AS j, request_id * 2 + attempt - 1 AS rid FROM response),
vocab AS (SELECT *, lower(j ->> '$.finding_type') AS ft, lower(j ->> '$.severity') AS sv FROM answer),
checked AS MATERIALIZED (SELECT *, coalesce(ft IN ({_types}) AND sv IN ({_sevs}), false) AS ok FROM vocab),
edit AS MATERIALIZED (SELECT rid AS request_id, CAST(n AS INTEGER) AS edit_no, e ->> '$.original_text' AS original_text, e ->> '$.revised_text' AS revised_text,
  coalesce(e ->> '$.comment', '') AS comment, ok, ft FROM (SELECT rid, ok, ft, unnest(l) AS e, generate_subscripts(l, 1) AS n FROM
  (SELECT rid, ok, ft, CAST(j -> '$.suggested_edits' AS JSON[]) AS l FROM checked WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'))
  WHERE json_type(e) = 'OBJECT' AND e ->> '$.original_text' <> '' AND e ->> '$.revised_text' <> ''),
tried AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'call' WHEN ok THEN 'ok' ELSE 'parse' END AS state FROM checked),
performed AS MATERIALIZED (SELECT t.*, attempt = 1 OR (attempt = 2 AND EXISTS (SELECT 1 FROM tried f
  WHERE f.request_id = t.request_id AND f.attempt = 1 AND f.state = 'parse')) AS expected FROM tried t)"""

ORACLES = {
    "extract_json": f"{_BASE} SELECT request_id, attempt, CASE WHEN j IS NULL THEN 'failed' ELSE 'ok' END AS parse_status, j ->> '$.rationale' AS rationale FROM answer",
    "parse_finding": f"""{_BASE} SELECT request_id, attempt, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS finding_status,
  CASE WHEN ok THEN ft END AS finding_type, CASE WHEN ok THEN sv END AS severity, CASE WHEN ok THEN j ->> '$.negotiation_ask' END AS negotiation_ask FROM checked""",
    "parse_edits": f"{_BASE} SELECT request_id, edit_no, original_text, revised_text, comment FROM edit",
    "citation_basis": f"{_BASE} SELECT rid AS request_id, CASE WHEN j ->> '$.citation_basis' IN ('statutory', 'doctrinal') THEN j ->> '$.citation_basis' END AS citation_basis FROM answer",
    "resolve_clause": f"""{_BASE}, {X.LINES}, listed AS (SELECT rid, version_id, unnest(l) AS o, generate_subscripts(l, 1) AS n FROM
  (SELECT rid, version_id, CAST(j ->> '$.clause_ordinals' AS VARCHAR[]) AS l FROM answer WHERE json_type(j) = 'OBJECT')),
hit AS (SELECT rid, arg_min(doc_id || ':' || pos, n) AS clause_id FROM listed JOIN lines ON doc_id = version_id AND pos = TRY_CAST(o AS INTEGER) GROUP BY rid)
SELECT a.rid AS request_id, version_id, clause_id FROM answer a LEFT JOIN hit USING (rid)""",
    "persist_findings": f"""{_BASE} SELECT rid AS request_id, ft AS finding_type, sv AS severity, j ->> '$.summary' AS summary,
  j ->> '$.rationale' AS rationale, j ->> '$.negotiation_ask' AS negotiation_ask,
  coalesce(length(j ->> '$.summary') > 1000, false) AS oversized FROM checked WHERE ok AND ft <> 'none'""",
    "persist_edits": f"{_BASE} SELECT request_id, edit_no, original_text, revised_text, comment, false AS oversized FROM edit WHERE ok AND ft <> 'none'",
    "parse_materiality": f"""WITH batch AS ({_BATCH}), parsed AS (SELECT *, {_json('content')} AS j FROM batch WHERE expected > 0),
listed AS (SELECT *, CASE WHEN j IS NULL THEN NULL WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[])
  ELSE coalesce(CAST(j -> '$.changes' AS JSON[]), CAST(j -> '$.items' AS JSON[]), CAST(j -> '$.results' AS JSON[]), CAST([] AS JSON[])) END AS l FROM parsed),
usable AS (SELECT *, coalesce(len(list_filter(l, lambda x: json_type(x) <> 'OBJECT')) = 0, false) AS u FROM listed),
place AS (SELECT *, unnest(range(1, expected + 1)) AS place FROM usable),
item AS (SELECT *, CASE WHEN u AND place <= len(l) THEN l[place] END AS e FROM place),
value AS (SELECT *, lower(coalesce(e ->> '$.materiality', '')) AS m FROM item)
SELECT batch_id, CAST(place AS INTEGER) AS place, CASE WHEN m IN ('material', 'immaterial') THEN m END AS materiality,
  CASE WHEN m IN ('material', 'immaterial') THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN NOT u THEN 'Respons model tidak dapat diurai' WHEN e IS NULL THEN 'Respons model tidak lengkap untuk entri ini'
    WHEN m IN ('material', 'immaterial') THEN coalesce(nullif(e ->> '$.materiality_reason', ''), nullif(e ->> '$.reason', ''), 'Tidak ada alasan diberikan')
    WHEN m = '' THEN 'Model tidak memberikan klasifikasi' ELSE 'Jawaban model di luar vokabulari: ''' || m || '''' END AS reason FROM value""",
    "resolve_attempts": f"""{_BASE}, o AS (SELECT request_id, max(attempt) AS attempts, min(attempt) FILTER (WHERE state = 'ok') AS winner, arg_max(state, attempt) AS last FROM performed WHERE expected GROUP BY request_id),
a AS (SELECT request_id, count(*) AS n FROM performed GROUP BY request_id)
SELECT request_id, attempts, winner, CASE WHEN winner IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN winner IS NULL THEN last END AS failure, n - attempts AS surplus FROM o JOIN a USING (request_id)""",
    "meter_attempts": f"""{_BASE} SELECT request_id, attempt, CASE WHEN state <> 'call' THEN input_tokens END AS input_tokens, CASE WHEN state <> 'call' THEN output_tokens END AS output_tokens,
  CASE WHEN state <> 'call' THEN model END AS model, CASE WHEN NOT expected THEN 'surplus' WHEN state = 'ok' THEN 'ok' ELSE 'failed' END AS status,
  CASE state WHEN 'call' THEN 'llm_call:' || domain WHEN 'parse' THEN 'json_parse:' || domain END AS failure_stage FROM performed""",
    "meter_batches": f"""WITH u AS ({_RESPONSE}) SELECT request_id * 2 + attempt - 1 AS batch_id, CASE WHEN error IS NULL THEN input_tokens END AS input_tokens,
  CASE WHEN error IS NULL THEN output_tokens END AS output_tokens, CASE WHEN error IS NULL THEN model END AS model,
  CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, CASE WHEN error IS NOT NULL THEN 'materiality_llm' END AS failure_stage FROM u""",
    "usage_rollup": f"""WITH u AS ({_RESPONSE}) SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN error IS NULL THEN model END AS model, count(*) AS calls,
  count(*) FILTER (WHERE error IS NULL) AS ok_calls, count(*) FILTER (WHERE error IS NOT NULL) AS failed_calls,
  CAST(sum(input_tokens) FILTER (WHERE error IS NULL) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (WHERE error IS NULL) AS BIGINT) AS output_tokens,
  count(*) FILTER (WHERE error IS NOT NULL OR input_tokens IS NULL) AS unmetered_calls FROM u GROUP BY 1, 2, 3""",
    "usage_subtotals": f"""WITH u AS ({_RESPONSE}), c AS (SELECT *, CASE WHEN error IS NULL THEN model END AS used, CAST(ts AS DATE) AS of_day FROM u),
l AS (SELECT unnest(['model', 'day', 'user', 'total']) AS level)
SELECT level, CASE WHEN level <> 'total' THEN user_id END AS user_id, CASE WHEN level IN ('model', 'day') THEN of_day END AS day,
  CASE WHEN level = 'model' THEN used END AS model, count(*) AS calls, count(*) FILTER (WHERE error IS NULL) AS ok_calls, count(*) FILTER (WHERE error IS NOT NULL) AS failed_calls,
  CAST(sum(input_tokens) FILTER (WHERE error IS NULL) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (WHERE error IS NULL) AS BIGINT) AS output_tokens,
  count(*) FILTER (WHERE error IS NOT NULL OR input_tokens IS NULL) AS unmetered_calls FROM c, l GROUP BY 1, 2, 3, 4""",
    "summary_outcome": f"""WITH s AS ({_SUMMARY}), p AS (SELECT *, {_json('content')} AS j FROM s),
q AS (SELECT *, coalesce(error IS NULL AND json_type(j) = 'OBJECT', false) AS ok FROM p)
SELECT version_id, CASE WHEN n_clauses = 0 THEN 'Dokumen tidak memiliki klausul yang dapat diekstrak.' WHEN ok THEN coalesce(nullif(j ->> '$.ringkasan', ''), nullif(j ->> '$.summary', ''), j) END AS summary,
  CASE WHEN n_clauses = 0 OR ok THEN 'ok' ELSE 'failed' END AS summary_status FROM q""",
}
