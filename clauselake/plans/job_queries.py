"""Registered queries for job, completeness and quota accounting."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clauselake.operators import jobs as J
from clauselake.plans import entities as E
from clauselake.plans import fixtures as X

NOW = datetime(2001, 6, 1)


def _outcome(spark, sf_dir):
    return J.job_outcome(E.runs(spark, sf_dir))


def _messages(spark, sf_dir):
    return J.failure_message(_outcome(spark, sf_dir), E.jobs(spark, sf_dir))


def _carry(spark, sf_dir):
    jobs = E.jobs(spark, sf_dir)
    waiting = jobs.filter(F.col("state").isin("queued", "running"))
    return J.carry_forward(waiting, jobs, E.runs(spark, sf_dir))


def _carried_findings(spark, sf_dir):
    """Findings here are keyed by the run's domain: the line number part of the key."""
    rows = E.findings(spark, sf_dir).withColumn(
        "domain", F.concat(F.lit("domain_"), (F.floor(F.col("flag_id") / 100) % 10).cast("string"))
    )
    return J.copy_findings(rows, _carry(spark, sf_dir))


def _copy(spark, sf_dir):
    return _carried_findings(spark, sf_dir).select("flag_id", "job_id", "domain", "summary")


def _copy_edits(spark, sf_dir):
    copies = J.copy_children(E.edits(spark, sf_dir), _carried_findings(spark, sf_dir))
    return copies.select("flag_id", "job_id", "edit_no", "revised_text", "accepted")


def users(spark, sf_dir):
    counted = E.jobs(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", (F.col("n") % 40).alias("analyses_used"))


def _refunds(spark, sf_dir):
    return J.quota_refunds(_outcome(spark, sf_dir), E.jobs(spark, sf_dir), users(spark, sf_dir))


def _ledger(spark, sf_dir):
    return J.quota_ledger(E.jobs(spark, sf_dir))


def _failed(spark, sf_dir):
    rows = J.failed_domains(E.runs(spark, sf_dir))
    return rows.withColumn("failed_domains", F.concat_ws(",", "failed_domains"))


def _complete(spark, sf_dir):
    rows = J.review_complete(E.jobs(spark, sf_dir), E.versions(spark, sf_dir), E.runs(spark, sf_dir))
    return rows.select("job_id", "review_complete")


def _latest(variant):
    def run(spark, sf_dir):
        return J.latest_job(E.jobs(spark, sf_dir), variant).select("version_id", "job_id", "state")

    return run


def _inflight(spark, sf_dir):
    return J.inflight_jobs(E.jobs(spark, sf_dir), NOW)


QUERIES = {
    "domain_runs": E.runs,
    "job_outcome": _outcome,
    "error_digest": lambda spark, sf_dir: J.error_digest(E.runs(spark, sf_dir)),
    "failure_message": _messages,
    "carry_forward": _carry,
    "copy_findings": _copy,
    "copy_edits": _copy_edits,
    "quota_refunds": _refunds,
    "quota_ledger": _ledger,
    "failed_domains": _failed,
    "review_complete": _complete,
    "latest_job_created": _latest("created"),
    "latest_job_done_finished": _latest("done_finished"),
    "latest_job_done_created": _latest("done_created"),
    "inflight_jobs": _inflight,
}

_TOTALS = f"""{E.RUNS}, totals AS MATERIALIZED (SELECT job_id, count(*) AS domains_total, count(*) FILTER (WHERE status = 'failed') AS domains_failed FROM runs GROUP BY job_id),
outcome AS (SELECT *, CASE WHEN domains_failed * 2 > domains_total THEN 'failed' ELSE 'done' END AS outcome FROM totals)"""
_CARRY = f"""{E.JOBS}, {E.RUNS}, {E.FINDINGS}, {E.EDITS},
prior AS (SELECT c.job_id, (SELECT p.job_id FROM jobs p WHERE p.version_id = c.version_id AND p.job_id <> c.job_id ORDER BY p.created_at DESC, p.job_id DESC LIMIT 1) AS prior_job_id
  FROM jobs c WHERE c.state IN ('queued', 'running')),
carry AS MATERIALIZED (SELECT prior.job_id, prior_job_id, domain_key FROM prior JOIN jobs j ON j.job_id = prior_job_id AND j.state = 'failed'
  JOIN runs r ON r.job_id = prior_job_id AND r.status = 'ok'),
copied AS MATERIALIZED (SELECT c.job_id || '>' || f.flag_id AS flag_id, f.flag_id AS old, c.job_id, 'domain_' || (f.flag_id // 100 % 10) AS domain, f.summary
  FROM finding f JOIN carry c ON c.prior_job_id = f.job_id AND c.domain_key = 'domain_' || (f.flag_id // 100 % 10))"""


def _newest(where: str, order: str) -> str:
    return (
        f"WITH {E.JOBS} SELECT version_id, job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY version_id"
        f" ORDER BY {order} DESC, job_id DESC) AS rn FROM jobs WHERE {where}) WHERE rn = 1"
    )


ORACLES = {
    "domain_runs": f"WITH {E.RUNS} SELECT * FROM runs",
    "job_outcome": f"WITH {_TOTALS} SELECT * FROM outcome",
    "error_digest": f"""WITH {_TOTALS}, line AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY domain_key) AS r FROM runs WHERE status = 'failed')
SELECT job_id, 'Analisis selesai: ' || (any_value(domains_total) - any_value(domains_failed)) || '/' || any_value(domains_total) || ' domain berhasil, ' || any_value(domains_failed)
  || ' domain gagal:' || chr(10) || string_agg(domain_key || ': ' || error, chr(10) ORDER BY r) AS error_message FROM line JOIN totals USING (job_id) GROUP BY job_id""",
    "failure_message": f"""WITH {_TOTALS}, {E.JOBS} SELECT job_id, 'Analisis gagal: ' || domains_failed || ' dari ' || domains_total || ' pemeriksaan tidak dapat diselesaikan. '
  || CASE WHEN quota_refunded THEN '' ELSE 'Kuota analisis Anda telah dikembalikan. ' END || 'Silakan coba lagi — pemeriksaan yang sudah berhasil tidak akan diulang. Jika masalah berlanjut, unggah ulang dokumen dan pastikan formatnya .docx dan terstruktur.' AS error_message FROM outcome JOIN jobs USING (job_id) WHERE outcome = 'failed'""",
    "carry_forward": f"WITH {_CARRY} SELECT * FROM carry",
    "copy_findings": f"WITH {_CARRY} SELECT flag_id, job_id, domain, summary FROM copied",
    "copy_edits": f"WITH {_CARRY} SELECT c.flag_id, c.job_id, edit_no, revised_text, CAST(NULL AS BOOLEAN) AS accepted FROM edit e JOIN copied c ON c.old = e.flag_id",
    "quota_refunds": f"""WITH {_TOTALS}, {E.JOBS}, usr AS (SELECT user_id, count(*) % 40 AS analyses_used FROM jobs GROUP BY user_id),
due AS (SELECT user_id, count(*) AS n FROM jobs JOIN outcome USING (job_id) WHERE outcome = 'failed' AND NOT quota_refunded GROUP BY user_id)
SELECT user_id, coalesce(n, 0) AS refunds, greatest(analyses_used - coalesce(n, 0), 0) AS analyses_used FROM usr LEFT JOIN due USING (user_id)""",
    "quota_ledger": f"""WITH {E.JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, job_id) AS nth FROM jobs)
SELECT job_id, user_id, CAST(date_trunc('month', created_at) AS DATE) AS period, nth, nth <= 8 AS admitted, CAST(least(100, nth / 8 * 100) AS DOUBLE) AS percent_used FROM n""",
    "failed_domains": f"""WITH {E.RUNS} SELECT job_id, count(*) AS domains_total, count(*) FILTER (WHERE status = 'failed') AS domains_failed,
  coalesce(string_agg(domain_key, ',' ORDER BY domain_key) FILTER (WHERE status = 'failed'), '') AS failed_domains FROM runs GROUP BY job_id""",
    "review_complete": f"""WITH {_TOTALS}, {E.JOBS}, {E.VERSIONS} SELECT job_id, state = 'done' AND coalesce(domains_failed, 0) = 0 AND tc_parse_status IS DISTINCT FROM 'failed'
  AND comments_parse_status IS DISTINCT FROM 'failed' AND summary_status IS DISTINCT FROM 'failed' AS review_complete FROM jobs LEFT JOIN totals USING (job_id) LEFT JOIN vers USING (version_id)""",
    "latest_job_created": _newest("true", "created_at"),
    "latest_job_done_finished": _newest("state = 'done'", "finished_at"),
    "latest_job_done_created": _newest("state = 'done'", "created_at"),
    "inflight_jobs": f"""WITH {E.JOBS} SELECT job_id, version_id, state, date_diff('second', created_at, TIMESTAMP '2001-06-01') AS age_seconds, state = 'running' AS requeue_on_restart
  FROM jobs WHERE state IN ('queued', 'running')""",
}
