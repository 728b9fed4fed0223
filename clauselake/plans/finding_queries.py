"""Registered queries over findings, edits and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import findings as Q
from clauselake.operators import jobs as J
from clauselake.operators import redact as R
from clauselake.operators import redline as RL
from clauselake.plans import entities as E
from clauselake.plans import fixtures as X
from clauselake.session import stored


def _of_jobs(spark, sf_dir):
    chosen = J.latest_job(E.jobs(spark, sf_dir), "done_finished")
    return Q.findings_of_jobs(E.findings(spark, sf_dir), chosen).select("flag_id", "job_id", "severity")


def _ordered(spark, sf_dir):
    return Q.order_by_severity(E.findings(spark, sf_dir)).select(
        "job_id", "flag_id", "severity_rank", "place", "created_at"
    )


def _nested(spark, sf_dir):
    rows = Q.findings_nested(
        E.findings(spark, sf_dir), E.edits(spark, sf_dir), E.citations(spark, sf_dir)
    )
    return rows.select(
        "flag_id",
        "severity",
        F.array_join(F.transform("suggested_edits", lambda e: e["revised_text"]), "|").alias("edits"),
        F.array_join(F.transform("citations", lambda c: c["basis"]), "|").alias("citations"),
    )


def _counts(spark, sf_dir):
    return Q.severity_counts(E.findings(spark, sf_dir))


def _groups(spark, sf_dir):
    return Q.findings_by_group(E.findings(spark, sf_dir))


def _tally(keys):
    return lambda spark, sf_dir: Q.edit_tally(E.edits(spark, sf_dir), keys)


def _exportable(accepted_only):
    def run(spark, sf_dir):
        return Q.exportable_edits(E.edits(spark, sf_dir), accepted_only).select("edit_id", "accepted")

    return run


def _asks(spark, sf_dir):
    return Q.actionable_asks(E.findings(spark, sf_dir))


def _reference(spark, sf_dir):
    jobs = E.jobs(spark, sf_dir)
    refs = jobs.select("job_id", F.concat(F.lit("SUPPLIER "), (F.col("job_id") % 100).cast("string"), F.lit(" ")).alias("reference"))
    return Q.find_by_reference(E.findings(spark, sf_dir), refs)


def _documents(spark, sf_dir):
    return Q.document_list(E.documents(spark, sf_dir), E.versions(spark, sf_dir), E.jobs(spark, sf_dir))


def _history(spark, sf_dir):
    rows = Q.version_history(E.documents(spark, sf_dir), E.versions(spark, sf_dir))
    return rows.select("document_id", "user_id", "version_id", "version_no", "uploaded_at")


def comments(spark, sf_dir):
    turns = X.read(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("version_id"), F.col("turn").alias("ordinal"))


def _bundle(spark, sf_dir):
    rows = Q.results_bundle(
        E.jobs(spark, sf_dir), E.versions(spark, sf_dir), E.runs(spark, sf_dir),
        E.findings(spark, sf_dir), E.edits(spark, sf_dir), comments(spark, sf_dir),
    )
    return rows.withColumn("failed_domains", F.concat_ws(",", "failed_domains"))


def _bundle_findings(spark, sf_dir):
    done = E.jobs(spark, sf_dir).filter("state = 'done'")
    # lines are numbered once and not for each table; the columns are those that the rows below show
    found = E.findings(spark, sf_dir).select("flag_id", "job_id", "severity", "summary", "created_at")
    found = stored(found, "findings")
    rows = Q.bundle_findings(
        done, found, E.edits(spark, sf_dir, found), E.citations(spark, sf_dir, found)
    )
    return rows.select(
        "job_id",
        "place",
        "flag_id",
        F.array_join(F.transform("suggested_edits", lambda e: e["revised_text"]), "|").alias("edits"),
        F.array_join(
            F.transform("citations", lambda c: F.coalesce(c["basis"], F.lit("-"))), "|"
        ).alias("citations"),
    )


def _export(spark, sf_dir):
    """The export of the newest finished jobs: edits that may leave, originals put back, redlines.

    The clause of a finding is its summary and an address under a token; its two edits
    change one word each, and only exportable ones are applied.
    """
    chosen = J.latest_job(E.jobs(spark, sf_dir), "done_finished")
    found = Q.findings_of_jobs(E.findings(spark, sf_dir), chosen)
    allowed = Q.exportable_edits(E.edits(spark, sf_dir)).select("flag_id", "edit_id", "edit_no")
    word = F.when(F.col("edit_no") == 0, F.lit("mail")).otherwise(F.lit("now"))
    new = F.when(F.col("edit_no") == 0, F.lit("Mail")).otherwise(F.lit("later"))
    edits = allowed.select(
        F.col("flag_id").alias("clause_id"), "edit_no", word.alias("original_text"), new.alias("revised_text")
    )
    clauses = found.select(
        F.col("flag_id").alias("version_id"),
        F.concat("summary", F.lit(" mail to [EMAIL_1] now")).alias("redacted_text"),
    )
    mapping = found.select(
        F.col("flag_id").alias("version_id"),
        F.lit("[EMAIL_1]").alias("token"),
        F.concat(F.lit("a"), F.col("job_id").cast("string"), F.lit("@example.org")).alias("original"),
    )
    texts = R.expand(clauses, mapping).select(F.col("version_id").alias("clause_id"), "text")
    redlines = RL.accept_all(RL.apply_edits(texts, edits))
    counted = edits.groupBy("clause_id").agg(F.count("*").cast("int").alias("edits"))
    return redlines.join(counted, "clause_id").select(
        F.col("clause_id").alias("flag_id"), "edits", "accepted_text"
    )


def _portfolio(spark, sf_dir):
    return Q.portfolio_risk(
        E.findings(spark, sf_dir), E.jobs(spark, sf_dir), E.versions(spark, sf_dir), E.documents(spark, sf_dir)
    )


def _cube(spark, sf_dir):
    return Q.portfolio_cube(
        E.findings(spark, sf_dir), E.jobs(spark, sf_dir), E.versions(spark, sf_dir), E.documents(spark, sf_dir)
    )


def _decided(spark, sf_dir):
    """Decisions from the event stream, by the owner and by somebody else."""
    owned = (
        E.edits(spark, sf_dir)
        .join(E.jobs(spark, sf_dir).select("job_id", "user_id"), "job_id")
        .select("edit_id", "user_id", "accepted")
    )
    events = X.read(spark, sf_dir, "events")
    third = F.floor(F.col("event_id") / 3)  # three decisions per edit
    edit_id = ((third * 10 + third % 7 + 1) * 100 + 1) * 2 + third % 2
    decisions = events.select(
        edit_id.alias("edit_id"),
        (F.col("user_id") % 25).alias("user_id"),
        F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False).alias("accepted"),
        F.col("ts").alias("decided_at"),
        F.col("event_id").alias("decision_id"),
    )
    own = decisions.drop("user_id").join(owned.select("edit_id", "user_id"), "edit_id")
    foreign = decisions.select(*own.columns)
    return Q.apply_decisions(owned, own.unionByName(foreign)).select("edit_id", "accepted")


QUERIES = {
    "findings_of_jobs": _of_jobs,
    "order_by_severity": _ordered,
    "findings_nested": _nested,
    "severity_counts": _counts,
    "findings_by_group": _groups,
    "edit_tally_by_job": _tally(["job_id"]),
    "edit_tally_by_finding": _tally(["flag_id"]),
    "exportable_edits": _exportable(False),
    "exportable_edits_accepted": _exportable(True),
    "actionable_asks": _asks,
    "find_by_reference": _reference,
    "document_list": _documents,
    "version_history": _history,
    "results_bundle": _bundle,
    "bundle_findings": _bundle_findings,
    "export_redlines": _export,
    "portfolio_risk": _portfolio,
    "portfolio_cube": _cube,
    "apply_decisions": _decided,
}

_LEVELS = ["critical", "high", "medium", "info"]
_SEV = ", ".join(f"'{s}'" for s in _LEVELS)


def _tally_sql(key: str) -> str:
    return f"""WITH {E.FINDINGS}, {E.EDITS} SELECT {key}, count(*) AS total, count(*) FILTER (WHERE accepted) AS accepted,
  count(*) FILTER (WHERE NOT accepted) AS rejected, count(*) FILTER (WHERE accepted IS NULL) AS undecided FROM edit GROUP BY {key}"""


ORACLES = {
    "findings_of_jobs": f"""WITH {E.JOBS}, {E.FINDINGS}, newest AS (SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY finished_at DESC, job_id DESC) AS rn
  FROM jobs WHERE state = 'done') WHERE rn = 1) SELECT flag_id, job_id, severity FROM finding WHERE job_id IN (SELECT job_id FROM newest)""",
    "order_by_severity": f"WITH {E.FINDINGS} SELECT job_id, flag_id, {E.SEVERITY_RANK} AS severity_rank, row_number() OVER (PARTITION BY job_id ORDER BY {E.SEVERITY_RANK}, created_at, flag_id) AS place, created_at FROM finding",
    "findings_nested": f"""WITH {E.FINDINGS}, {E.EDITS}, {E.CITATIONS} SELECT f.flag_id, f.severity,
  coalesce((SELECT string_agg(revised_text, '|' ORDER BY edit_id) FROM edit e WHERE e.flag_id = f.flag_id), '') AS edits,
  coalesce((SELECT string_agg(basis, '|' ORDER BY citation_id) FROM cite c WHERE c.flag_id = f.flag_id), '') AS citations FROM finding f""",
    "severity_counts": f"""WITH {E.FINDINGS} SELECT job_id, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in _LEVELS)} FROM finding GROUP BY job_id""",
    "findings_by_group": f"""WITH {E.FINDINGS} SELECT job_id, CASE WHEN finding_type = 'absent' THEN 'absent' ELSE severity END AS display_group, count(*) AS findings
  FROM finding WHERE finding_type = 'absent' OR severity IN ({_SEV}) GROUP BY ALL""",
    "edit_tally_by_job": _tally_sql("job_id"),
    "edit_tally_by_finding": _tally_sql("flag_id"),
    "exportable_edits": f"WITH {E.FINDINGS}, {E.EDITS} SELECT edit_id, accepted FROM edit WHERE accepted IS NOT FALSE",
    "exportable_edits_accepted": f"WITH {E.FINDINGS}, {E.EDITS} SELECT edit_id, accepted FROM edit WHERE accepted",
    "actionable_asks": f"""WITH {E.FINDINGS}, asked AS (SELECT *, finding_type <> 'absent' AND severity IN ('critical', 'high', 'medium') AS strong FROM finding WHERE negotiation_ask <> ''),
chosen AS (SELECT * FROM asked a WHERE strong OR NOT EXISTS (SELECT 1 FROM asked b WHERE b.job_id = a.job_id AND b.strong)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY {E.SEVERITY_RANK}, created_at, flag_id) AS INTEGER) AS ask_no FROM chosen)
SELECT job_id, ask_no, flag_id, severity, summary, negotiation_ask FROM ranked""",
    "find_by_reference": f"""WITH {E.FINDINGS}, m AS (SELECT f.*, contains(lower(summary), ref) OR contains(lower(rationale), ref) AS matched
  FROM finding f JOIN (SELECT o_orderkey, 'supplier ' || (o_orderkey % 100) || ' ' AS ref FROM orders) ON o_orderkey = job_id)
SELECT job_id, flag_id, matched FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY NOT matched, {E.SEVERITY_RANK}, created_at, flag_id) AS rn FROM m) WHERE rn = 1""",
    "document_list": f"""WITH {E.DOCUMENTS}, {E.VERSIONS}, {E.JOBS},
lv AS (SELECT document_id, count(*) AS version_count, arg_max(version_id, version_no) AS latest_version_id, max(version_no) AS latest_version_no FROM vers GROUP BY document_id),
lj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version_id, user_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1)
SELECT d.document_id, d.user_id, title, counterparty, d.created_at, coalesce(version_count, 0) AS version_count, latest_version_id, latest_version_no, job_id AS latest_job_id, state AS latest_job_state
FROM docs d LEFT JOIN lv USING (document_id) LEFT JOIN lj ON lj.version_id = latest_version_id AND lj.user_id = d.user_id WHERE deleted_at IS NULL""",
    "version_history": f"WITH {E.DOCUMENTS}, {E.VERSIONS} SELECT document_id, user_id, version_id, version_no, uploaded_at FROM vers JOIN docs USING (document_id) WHERE deleted_at IS NULL",
    "results_bundle": f"""WITH {E.VERSIONS}, {E.JOBS}, {E.RUNS}, {E.FINDINGS}, {E.EDITS},
r AS (SELECT job_id, count(*) AS domains_total, count(*) FILTER (WHERE status = 'failed') AS domains_failed, coalesce(string_agg(domain_key, ',' ORDER BY domain_key) FILTER (WHERE status = 'failed'), '') AS fd FROM runs GROUP BY job_id),
f AS (SELECT job_id, count(*) AS findings, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in _LEVELS)} FROM finding GROUP BY job_id),
e AS (SELECT job_id, count(*) AS edits, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS n, count(*) FILTER (WHERE accepted IS NULL) AS u FROM edit GROUP BY job_id),
c AS (SELECT conv_id AS version_id, count(*) AS comments FROM conversations GROUP BY conv_id)
SELECT job_id, version_id, document_id, state, tc_parse_status, comments_parse_status, summary_status, quota_refunded, coalesce(fd, '') AS failed_domains,
  state = 'done' AND coalesce(domains_failed, 0) = 0 AND tc_parse_status IS DISTINCT FROM 'failed' AND comments_parse_status IS DISTINCT FROM 'failed' AND summary_status IS DISTINCT FROM 'failed' AS review_complete,
  {', '.join(f"coalesce({s}, 0) AS {s}" for s in _LEVELS)}, coalesce(findings, 0) AS findings, coalesce(edits, 0) AS edits, coalesce(a, 0) AS edits_accepted, coalesce(n, 0) AS edits_rejected,
  coalesce(u, 0) AS edits_undecided, coalesce(domains_total, 0) AS domains_total, coalesce(domains_failed, 0) AS domains_failed, coalesce(comments, 0) AS comments
FROM jobs LEFT JOIN vers USING (version_id) LEFT JOIN r USING (job_id) LEFT JOIN f USING (job_id) LEFT JOIN e USING (job_id) LEFT JOIN c USING (version_id)""",
    "bundle_findings": f"""WITH {E.JOBS}, {E.FINDINGS}, {E.EDITS}, {E.CITATIONS}, done AS (SELECT job_id FROM jobs WHERE state = 'done')
SELECT f.job_id, row_number() OVER (PARTITION BY f.job_id ORDER BY {E.SEVERITY_RANK}, created_at, f.flag_id) AS place, f.flag_id,
  coalesce((SELECT string_agg(revised_text, '|' ORDER BY edit_id) FROM edit e WHERE e.flag_id = f.flag_id), '') AS edits,
  coalesce((SELECT string_agg(coalesce(basis, '-'), '|' ORDER BY citation_id) FROM cite c WHERE c.flag_id = f.flag_id), '') AS citations
FROM finding f WHERE f.job_id IN (SELECT job_id FROM done)""",
    "export_redlines": f"""WITH {E.JOBS}, {E.FINDINGS}, {E.EDITS}, newest AS (SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY finished_at DESC, job_id DESC) AS rn
  FROM jobs WHERE state = 'done') WHERE rn = 1),
f AS (SELECT * FROM finding WHERE job_id IN (SELECT job_id FROM newest)),
e AS (SELECT flag_id, edit_id % 2 AS n, accepted FROM edit),
t AS (SELECT f.flag_id, f.summary, 'mail to a' || f.job_id || '@example.org now' AS m, a.accepted IS NOT FALSE AS x, b.accepted IS NOT FALSE AS y
  FROM f JOIN e a ON a.flag_id = f.flag_id AND a.n = 0 JOIN e b ON b.flag_id = f.flag_id AND b.n = 1)
SELECT flag_id, CAST(x::INT + y::INT AS INTEGER) AS edits, summary || ' ' || CASE WHEN y THEN replace(CASE WHEN x THEN 'Mail' || substr(m, 5) ELSE m END, ' now', ' later')
  ELSE CASE WHEN x THEN 'Mail' || substr(m, 5) ELSE m END END AS accepted_text FROM t WHERE x OR y""",
    "portfolio_risk": f"""WITH {E.DOCUMENTS}, {E.VERSIONS}, {E.JOBS}, {E.FINDINGS} SELECT counterparty, domain, severity, count(*) AS findings, count(DISTINCT version_id) AS versions_hit
  FROM finding JOIN jobs USING (job_id) JOIN vers USING (version_id) JOIN docs USING (document_id) GROUP BY ALL""",
    "portfolio_cube": f"""WITH {E.DOCUMENTS}, {E.VERSIONS}, {E.JOBS}, {E.FINDINGS}, reviewed AS (SELECT DISTINCT version_id, counterparty FROM jobs JOIN vers USING (version_id) JOIN docs USING (document_id)),
hit AS (SELECT counterparty, domain, severity, grouping(counterparty) = 0 AS by_counterparty, grouping(domain) = 0 AS by_domain, grouping(severity) = 0 AS by_severity,
  count(*) AS findings, count(DISTINCT version_id) AS versions_hit
  FROM finding JOIN jobs USING (job_id) JOIN vers USING (version_id) JOIN docs USING (document_id) GROUP BY CUBE (counterparty, domain, severity)),
sized AS (SELECT *, CASE WHEN by_counterparty THEN (SELECT count(*) FROM reviewed r WHERE r.counterparty IS NOT DISTINCT FROM hit.counterparty)
  ELSE (SELECT count(*) FROM reviewed) END AS versions FROM hit)
SELECT *, CAST(versions_hit AS DOUBLE) / versions AS share FROM sized""",
    "apply_decisions": f"""WITH {E.JOBS}, {E.FINDINGS}, {E.EDITS}, d AS (SELECT ((event_id // 3 * 10 + event_id // 3 % 7 + 1) * 100 + 1) * 2 + event_id // 3 % 2 AS edit_id,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accepted, ts, event_id FROM events),
newest AS (SELECT edit_id, accepted FROM (SELECT *, row_number() OVER (PARTITION BY edit_id ORDER BY ts DESC, event_id DESC) AS rn FROM d) WHERE rn = 1)
SELECT e.edit_id, CASE WHEN n.edit_id IS NOT NULL THEN n.accepted ELSE e.accepted END AS accepted FROM edit e JOIN jobs USING (job_id) LEFT JOIN newest n ON n.edit_id = e.edit_id""",
}
