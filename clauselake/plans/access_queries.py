"""Registered queries for tenancy, login abuse, invites and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clauselake.operators import access as A
from clauselake.operators import raw_attempts as R
from clauselake.operators import retention as T
from clauselake.plans import entities as E
from clauselake.plans import fixtures as X
from clauselake.sources.storage import storage_key

NOW = datetime(2001, 2, 15)
SESSIONS_NOW = datetime(2024, 1, 15)
DAY = 24 * 3600

_ATTEMPTS = """SELECT event_id AS attempt_id, user_id AS identifier, CAST({k} AS BIGINT) % 8 AS ip,
  event_type <> 'error' AS success, ts AS created_at FROM events"""


def attempts(spark, sf_dir):
    return E._run(spark, sf_dir, _ATTEMPTS.replace("{k}", "get_json_object(props, '$.k')"), "events")


ATTEMPTS = f"attempt AS MATERIALIZED ({_ATTEMPTS.replace('{k}', "json_extract_string(props, '$.k')")})"


def _owned_edits(spark, sf_dir):
    docs = A.live_documents(E.documents(spark, sf_dir))
    versions = A.owned(E.versions(spark, sf_dir), docs, "document_id")
    jobs = A.owned(E.jobs(spark, sf_dir), versions, "version_id")
    findings = A.owned(E.findings(spark, sf_dir), jobs, "job_id")
    edits = A.owned(E.edits(spark, sf_dir), findings, "flag_id")
    return edits.select("edit_id", "user_id")


def _audit(spark, sf_dir):
    """Jobs carry their own user; orders of the odd part of the customers are booked to another one."""
    jobs = E.jobs(spark, sf_dir).select("job_id", "version_id", (F.col("job_id") % 25).alias("user_id"))
    docs = E.documents(spark, sf_dir)
    owners = A.owned(E.versions(spark, sf_dir), A.live_documents(docs), "document_id")
    return A.cross_tenant_audit(jobs, owners, "version_id")


_SESSIONS = """SELECT event_id AS session_id, user_id, event_type = 'error' AS revoked,
  ts + INTERVAL '1' DAY * CAST(floor(value) AS INTEGER) AS expires_at FROM events"""


def _sessions(spark, sf_dir):
    sessions = E._run(spark, sf_dir, _SESSIONS, "events")
    users = X.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    return A.valid_sessions(sessions, users, SESSIONS_NOW).select("session_id", "user_id")


def _window(spark, sf_dir):
    rows = A.failed_attempts_window(
        attempts(spark, sf_dir), {"identifier": "identifier_failures", "ip": "address_failures"}, DAY
    )
    return rows.select("attempt_id", "identifier_failures", "address_failures")


def _lockouts(spark, sf_dir):
    rows = A.lockouts(attempts(spark, sf_dir), DAY, 3, 40)
    return rows.select("attempt_id", "identifier_failures", "address_failures", "verdict")


def _lockouts_default(spark, sf_dir):
    rows = A.lockouts(attempts(spark, sf_dir))
    return rows.select("attempt_id", "identifier_failures", "address_failures", "verdict")


def _raw_lockouts(spark, sf_dir):
    """Events as calls as they came in; refused ones leave no record. SQL has no ordered replay:
    the tests compare with one."""
    rows = R.raw_lockouts(attempts(spark, sf_dir), DAY, 3, 40)
    return rows.select("attempt_id", "identifier_failures", "address_failures", "verdict", "recorded")


_CHALLENGES = """SELECT o_orderkey AS challenge_id, o_custkey AS user_id, o_orderstatus = 'F' AS used,
  o_orderdate + INTERVAL '1' DAY * 400 AS expires_at, {hash} AS otp_hash FROM orders"""


def _challenges(spark, sf_dir):
    return E._run(spark, sf_dir, _CHALLENGES.replace("{hash}", "sha2(CAST(o_orderkey % 3 AS STRING), 256)"), "orders")


def _users(spark, sf_dir):
    return X.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.col("c_name"), F.lit("@Example.org")).alias("email"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def _identifiers(spark, sf_dir):
    events = X.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), (F.col("event_id") * 2).alias("challenge_id")
    )
    return A.attempt_identifier(events, _challenges(spark, sf_dir), _users(spark, sf_dir))


def _verify(spark, sf_dir):
    items = X.read(spark, sf_dir, "lineitem")
    tries = items.select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("attempt_id"),
        (F.col("l_orderkey") + F.col("l_suppkey") % 5 * 100).alias("challenge_id"),
        (F.col("l_partkey") % 3).cast("string").alias("otp"),
        F.col("l_shipdate").alias("attempted_at"),
    )
    rows = A.verify_outcomes(tries, _challenges(spark, sf_dir), _users(spark, sf_dir))
    return rows.groupBy("challenge_id", "result").agg(F.count("*").alias("attempts"))


_INVITES = """SELECT 'inv-' || c_custkey AS code, CASE WHEN c_custkey % 3 > 0 THEN 'User' || (c_custkey % 50) || '@x.org' END AS email,
  {day}2020-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 300 AS INTEGER) AS created_at,
  CASE WHEN c_acctbal < 2000 THEN {day}2021-01-01' END AS redeemed_at FROM customer"""


def _invites(spark, sf_dir):
    return E._run(spark, sf_dir, _INVITES, "customer")


def _invite_status(spark, sf_dir):
    return A.invite_status(_invites(spark, sf_dir)).select("code", "email", "status")


def _redeem(spark, sf_dir):
    requests = X.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("inv-"), F.col("o_custkey").cast("string")).alias("code"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 50 + F.col("o_orderkey") % 2).cast("string"), F.lit("@X.org")).alias("email"),
    )
    users = X.read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("user"), (F.col("s_suppkey") % 20).cast("string"), F.lit("@x.org")).alias("email")
    )
    return A.redeem_check(requests, _invites(spark, sf_dir), users).select("request_id", "result")


def keyed_versions(spark, sf_dir):
    docs = E.documents(spark, sf_dir).select("document_id", "user_id")
    return storage_key(E.versions(spark, sf_dir).join(docs, "document_id"))


def _purge(spark, sf_dir):
    return T.purge_set(E.documents(spark, sf_dir), keyed_versions(spark, sf_dir), NOW)


def _usage(spark, sf_dir):
    return X.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("usage_id"), F.col("event_id").alias("job_id")
    )


def _dependents(spark, sf_dir):
    """Rows that hang on versions, jobs and findings, keyed; differences hang on two versions."""
    lines = X.line_rows(spark, sf_dir)
    turns = X.read(spark, sf_dir, "conversations")
    versions = E.versions(spark, sf_dir)
    later = versions.filter("version_no > 1")
    return {
        "clauses": lines.select(
            F.col("doc_id").alias("version_id"), F.concat_ws(":", "doc_id", "pos").alias("key")
        ),
        "comments": turns.select(
            F.col("conv_id").alias("version_id"), F.concat_ws(":", "conv_id", "turn").alias("key")
        ),
        "redaction_mappings": versions.select(
            "version_id", F.concat(F.lit("[EMAIL_1]:"), "version_id").alias("key")
        ),
        "version_diffs": later.select(
            (F.col("version_id") - 1).alias("from_version"),
            F.col("version_id").alias("to_version"),
            F.concat_ws(":", F.col("version_id") - 1, "version_id").alias("key"),
        ),
        "domain_runs": E.runs(spark, sf_dir).select(
            "job_id", F.concat_ws(":", "job_id", "domain_key").alias("key")
        ),
        "citations": E.citations(spark, sf_dir).select(
            "flag_id", F.col("citation_id").cast("string").alias("key")
        ),
    }


def _cascade(spark, sf_dir):
    """Keys of all surviving rows; a usage row that lost its job is told apart."""
    tables = T.purge_cascade(
        E.documents(spark, sf_dir), E.versions(spark, sf_dir), E.jobs(spark, sf_dir),
        E.findings(spark, sf_dir), E.edits(spark, sf_dir), _usage(spark, sf_dir), NOW,
        dependents=_dependents(spark, sf_dir),
    )
    keys = {
        "documents": F.col("document_id"),
        "versions": F.col("version_id"),
        "jobs": F.col("job_id"),
        "findings": F.col("flag_id"),
        "edits": F.col("edit_id"),
        "usage": F.concat_ws(":", "usage_id", F.when(F.col("job_id").isNull(), "unlinked")),
    }
    out = None
    for name, df in tables.items():
        key = keys.get(name, F.col("key")).cast("string").alias("key")
        rows = df.select(F.lit(name).alias("table_name"), key)
        out = rows if out is None else out.unionByName(rows)
    return out


def _orphans(spark, sf_dir):
    """The inventory lags: exports lie around, blobs of emptied accounts are gone."""
    versions = keyed_versions(spark, sf_dir)
    customers = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_id"), "c_acctbal")
    priced = versions.join(customers, "version_id")
    stored = priced.filter("c_acctbal > 0").select("storage_key").unionByName(
        priced.filter("c_acctbal > 5000").select(F.concat("storage_key", F.lit(".export")).alias("storage_key"))
    )
    return T.orphan_blobs(stored, versions)


def _schedule(spark, sf_dir):
    return T.retention_schedule(E.documents(spark, sf_dir), NOW)


QUERIES = {
    "owned_edits": _owned_edits,
    "cross_tenant_audit": _audit,
    "valid_sessions": _sessions,
    "failed_attempts_window": _window,
    "lockouts": _lockouts,
    "lockouts_default_limits": _lockouts_default,
    "lockouts_raw": _raw_lockouts,
    "attempt_identifier": _identifiers,
    "verify_outcomes": _verify,
    "invite_status": _invite_status,
    "redeem_check": _redeem,
    "purge_set": _purge,
    "purge_cascade": _cascade,
    "orphan_blobs": _orphans,
    "retention_schedule": _schedule,
}

_HASH = _CHALLENGES.replace("{hash}", "sha256(CAST(o_orderkey % 3 AS VARCHAR))")
_USERS = "usr AS (SELECT c_custkey AS user_id, c_name || '@Example.org' AS email, c_acctbal > 0 AS is_active FROM customer)"
KEYED = f"{E.DOCUMENTS}, {E.VERSIONS}, keyed AS (SELECT v.*, 'documents/' || user_id || '/' || document_id || '/v' || version_no || '/' || source_filename AS storage_key FROM vers v JOIN docs USING (document_id))"
_GONE = "gone AS (SELECT document_id FROM docs WHERE deleted_at < TIMESTAMP '2001-01-16')"


def _locked(seconds: int, per_id: int, per_ip: int) -> str:
    frame = f"""(SELECT count(*) FROM attempt f WHERE NOT f.success AND f.%s = a.%s AND f.created_at > a.created_at - INTERVAL {seconds} SECOND
      AND (f.created_at, f.attempt_id) < (a.created_at, a.attempt_id))"""
    return f"""WITH {ATTEMPTS}, c AS (SELECT attempt_id, {frame % ('identifier', 'identifier')} AS identifier_failures, {frame % ('ip', 'ip')} AS address_failures FROM attempt a)
SELECT *, CASE WHEN address_failures >= {per_ip} THEN 'locked_address' WHEN identifier_failures >= {per_id} THEN 'locked_identifier' ELSE 'allowed' END AS verdict FROM c"""


ORACLES = {
    "owned_edits": f"""WITH {E.DOCUMENTS}, {E.VERSIONS}, {E.JOBS}, {E.FINDINGS}, {E.EDITS} SELECT edit_id, d.user_id FROM edit JOIN jobs USING (job_id)
  JOIN vers USING (version_id) JOIN docs d USING (document_id) WHERE deleted_at IS NULL""",
    "cross_tenant_audit": f"""WITH {E.DOCUMENTS}, {E.VERSIONS}, {E.JOBS}, o AS (SELECT version_id, d.user_id AS parent_user_id FROM vers JOIN docs d USING (document_id) WHERE deleted_at IS NULL),
j AS (SELECT job_id, version_id, job_id % 25 AS user_id FROM jobs)
SELECT version_id, job_id, user_id, parent_user_id, CASE WHEN parent_user_id IS NULL THEN 'orphan' ELSE 'foreign_owner' END AS problem
FROM j LEFT JOIN o USING (version_id) WHERE parent_user_id IS NULL OR parent_user_id <> user_id""",
    "valid_sessions": f"""WITH s AS ({_SESSIONS}) SELECT session_id, user_id FROM s WHERE NOT revoked AND expires_at > TIMESTAMP '2024-01-15'
  AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "failed_attempts_window": f"""WITH {ATTEMPTS} SELECT attempt_id,
  (SELECT count(*) FROM attempt f WHERE NOT f.success AND f.identifier = a.identifier AND f.created_at > a.created_at - INTERVAL 1 DAY AND f.created_at <= a.created_at) AS identifier_failures,
  (SELECT count(*) FROM attempt f WHERE NOT f.success AND f.ip = a.ip AND f.created_at > a.created_at - INTERVAL 1 DAY AND f.created_at <= a.created_at) AS address_failures FROM attempt a""",
    "lockouts": _locked(DAY, 3, 40),
    "lockouts_default_limits": _locked(900, 5, 15),
    "attempt_identifier": f"""WITH c AS ({_HASH}), {_USERS} SELECT event_id AS attempt_id, event_id * 2 AS challenge_id, coalesce(lower(email), 'challenge:' || (event_id * 2)) AS identifier
  FROM events LEFT JOIN (c JOIN usr USING (user_id)) ON challenge_id = event_id * 2""",
    "verify_outcomes": f"""WITH c AS ({_HASH}), {_USERS}, k AS (SELECT * FROM c JOIN usr USING (user_id)),
t AS (SELECT l_orderkey + l_suppkey % 5 * 100 AS challenge_id, CAST(l_partkey % 3 AS VARCHAR) AS otp, l_shipdate AS tried_at FROM lineitem)
SELECT t.challenge_id, CASE WHEN k.challenge_id IS NULL THEN 'unknown' WHEN used THEN 'used' WHEN expires_at < tried_at THEN 'expired' WHEN otp_hash <> sha256(otp) THEN 'wrong_code'
  WHEN NOT is_active THEN 'inactive' ELSE 'ok' END AS result, count(*) AS attempts FROM t LEFT JOIN k ON k.challenge_id = t.challenge_id GROUP BY ALL""",
    "invite_status": f"WITH i AS ({E._duck(_INVITES)}) SELECT code, email, CASE WHEN redeemed_at IS NULL THEN 'available' ELSE 'used' END AS status FROM i",
    "redeem_check": f"""WITH i AS ({E._duck(_INVITES)}), r AS (SELECT o_orderkey AS request_id, 'inv-' || o_custkey AS code, 'user' || (o_custkey % 50 + o_orderkey % 2) || '@X.org' AS email FROM orders),
u AS (SELECT DISTINCT 'user' || (s_suppkey % 20) || '@x.org' AS email FROM supplier)
SELECT request_id, CASE WHEN i.code IS NULL THEN 'invalid_code' WHEN coalesce(i.email, '') <> '' AND lower(i.email) <> lower(r.email) THEN 'wrong_email'
  WHEN u.email IS NOT NULL THEN 'already_registered' ELSE 'ok' END AS result FROM r LEFT JOIN i ON i.code = r.code AND i.redeemed_at IS NULL LEFT JOIN u ON u.email = lower(r.email)""",
    "purge_set": f"WITH {KEYED}, {_GONE} SELECT document_id, version_id, storage_key FROM keyed WHERE document_id IN (SELECT document_id FROM gone)",
    "purge_cascade": f"""WITH {E.DOCUMENTS}, {E.VERSIONS}, {E.JOBS}, {E.RUNS}, {E.FINDINGS}, {E.EDITS}, {E.CITATIONS}, {_GONE}, {X.LINES},
v AS (SELECT * FROM vers WHERE document_id NOT IN (SELECT document_id FROM gone)), j AS (SELECT * FROM jobs WHERE version_id IN (SELECT version_id FROM v)),
f AS (SELECT * FROM finding WHERE job_id IN (SELECT job_id FROM j))
SELECT 'documents' AS table_name, CAST(document_id AS VARCHAR) AS key FROM docs WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'versions', CAST(version_id AS VARCHAR) FROM v UNION ALL SELECT 'jobs', CAST(job_id AS VARCHAR) FROM j
UNION ALL SELECT 'findings', CAST(flag_id AS VARCHAR) FROM f UNION ALL SELECT 'edits', CAST(edit_id AS VARCHAR) FROM edit WHERE flag_id IN (SELECT flag_id FROM f)
UNION ALL SELECT 'usage', event_id || CASE WHEN event_id IN (SELECT job_id FROM j) THEN '' ELSE ':unlinked' END FROM events
UNION ALL SELECT 'clauses', doc_id || ':' || pos FROM lines WHERE doc_id IN (SELECT version_id FROM v)
UNION ALL SELECT 'comments', conv_id || ':' || turn FROM conversations WHERE conv_id IN (SELECT version_id FROM v)
UNION ALL SELECT 'redaction_mappings', '[EMAIL_1]:' || version_id FROM v
UNION ALL SELECT 'version_diffs', (version_id - 1) || ':' || version_id FROM vers WHERE version_no > 1 AND version_id IN (SELECT version_id FROM v) AND version_id - 1 IN (SELECT version_id FROM v)
UNION ALL SELECT 'domain_runs', job_id || ':' || domain_key FROM runs WHERE job_id IN (SELECT job_id FROM j)
UNION ALL SELECT 'citations', CAST(citation_id AS VARCHAR) FROM cite WHERE flag_id IN (SELECT flag_id FROM f)""",
    "orphan_blobs": f"""WITH {KEYED}, p AS (SELECT storage_key, c_acctbal FROM keyed JOIN customer ON c_custkey = version_id)
SELECT storage_key, 'no_object' AS problem FROM p WHERE c_acctbal <= 0 UNION ALL SELECT storage_key || '.export', 'no_row' FROM p WHERE c_acctbal > 5000""",
    "retention_schedule": f"""WITH {E.DOCUMENTS} SELECT document_id, user_id, CAST(deleted_at AS DATE) + 30 AS purge_on,
  greatest(date_diff('day', DATE '2001-02-15', CAST(deleted_at AS DATE) + 30), 0) AS days_left FROM docs WHERE deleted_at IS NOT NULL""",
}
