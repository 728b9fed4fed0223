"""Job outcomes, completeness and quota accounting.

Jobs: ``job_id, version_id, user_id, state, created_at, finished_at,
quota_refunded, summary_status``. Runs: ``job_id, domain_key, status, error,
created_at``, one row per job and domain.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import epoch_micros, latest, running_total

def _failed() -> Column:
    return F.col("status") == "failed"


def domain_runs(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """One row per job and domain; the latest outcome wins."""
    return latest(outcomes, ["job_id", "domain_key"], order)


def _totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("job_id").agg(
        F.count("*").alias("domains_total"), F.count_if(_failed()).alias("domains_failed")
    )


def job_outcome(runs: DataFrame) -> DataFrame:
    """``failed`` when more than half of the checks failed, else ``done``."""
    totals = _totals(runs)
    majority = F.col("domains_failed") * 2 > F.col("domains_total")
    return totals.withColumn("outcome", F.when(majority, "failed").otherwise("done"))


def error_lines(runs: DataFrame) -> DataFrame:
    """``job_id, place, domain_key, line``: every failed check, placed in domain order."""
    rank = F.coalesce(
        *[F.when(F.col("domain_key") == d, i) for i, d in enumerate(K.DOMAINS)],
        F.lit(len(K.DOMAINS)),
    )
    line = F.concat_ws(": ", "domain_key", F.coalesce("error", F.lit("")))
    order = Window.partitionBy("job_id").orderBy("_rank", "domain_key")
    return (
        runs.filter(_failed())
        .select("job_id", "domain_key", line.alias("line"), rank.alias("_rank"))
        .withColumn("place", F.row_number().over(order))
        .select("job_id", "place", "domain_key", "line")
    )


def error_digest(runs: DataFrame, lines: int | None = None, chars: int | None = None) -> DataFrame:
    """Message of jobs with failed checks: the header and the error lines in domain order.

    Whole unless the caller sets a number of ``lines`` or ``chars``. A job has one run per
    domain of the vocabulary.
    """
    kept = error_lines(runs)
    if lines is not None:
        kept = kept.filter(F.col("place") <= lines)
    gathered = kept.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("_lines")
    )
    joined = gathered.join(_totals(runs), "job_id")
    ok = F.col("domains_total") - F.col("domains_failed")
    header = F.format_string(K.PARTIAL_HEADER, ok, "domains_total", "domains_failed")
    body = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    message = F.concat(header, body)
    return joined.select(
        "job_id",
        (message if chars is None else F.substring(message, 1, chars)).alias("error_message"),
    )


def failure_message(outcomes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Message of majority-failed jobs; it mentions the quota only when this failure returns it."""
    failed = outcomes.filter("outcome = 'failed'").join(
        jobs.select("job_id", "quota_refunded"), "job_id"
    )
    returned = F.when(~F.col("quota_refunded"), K.QUOTA_RETURNED).otherwise("")
    return failed.select(
        "job_id",
        F.concat(
            F.format_string(K.MAJORITY_FAILED, "domains_failed", "domains_total"),
            returned,
            F.lit(K.RETRY_HINT),
        ).alias("error_message"),
    )


def carry_forward(current: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Domains a job may reuse: the ``ok`` runs of the newest other job of its version, if that failed.

    The two newest jobs per version answer this for every current job; the rank
    filter is applied before the shuffle, so a version with very many jobs stays small.
    """
    newest = Window.partitionBy("version_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    top = (
        jobs.select("version_id", "job_id", "state", "created_at")
        .withColumn("_rank", F.row_number().over(newest))
        .filter("_rank <= 2")
    )
    two = top.groupBy("version_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "job_id", "state"))).alias("_top")
    )
    prior = current.select("job_id", "version_id").join(two, "version_id")
    other = F.get(F.filter("_top", lambda j: j["job_id"] != F.col("job_id")), F.lit(0))
    prior = prior.withColumn("_prior", other).filter("_prior.state = 'failed'")
    ok = runs.filter("status = 'ok'").select(F.col("job_id").alias("prior_job_id"), "domain_key")
    return prior.select("job_id", F.col("_prior.job_id").alias("prior_job_id")).join(
        ok, "prior_job_id"
    )


def copy_findings(findings: DataFrame, carry: DataFrame) -> DataFrame:
    """Findings of carried domains under the new job, with a derived key."""
    reuse = carry.select(
        F.col("job_id").alias("_new_job"),
        F.col("prior_job_id").alias("job_id"),
        F.col("domain_key").alias("domain"),
    )
    joined = findings.join(reuse, ["job_id", "domain"])
    return joined.select(
        F.concat_ws(">", "_new_job", "flag_id").alias("flag_id"),
        F.col("flag_id").alias("copied_from"),
        F.col("_new_job").alias("job_id"),
        *[c for c in findings.columns if c not in ("flag_id", "job_id")],
    )


def copy_children(children: DataFrame, copies: DataFrame) -> DataFrame:
    """Edits or citations of copied findings, re-keyed; a copied edit is undecided again."""
    keys = copies.select(
        F.col("copied_from").alias("flag_id"),
        F.col("flag_id").alias("_new_flag"),
        F.col("job_id").alias("_new_job"),
    )
    columns = [
        F.lit(None).cast("boolean").alias("accepted") if c == "accepted" else F.col(c)
        for c in children.columns
        if c not in ("flag_id", "job_id")
    ]
    return children.join(keys, "flag_id").select(
        F.col("_new_flag").alias("flag_id"), F.col("_new_job").alias("job_id"), *columns
    )


def quota_refunds(outcomes: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """One refund per majority-failed job not refunded before; the counter stops at zero."""
    due = jobs.filter(~F.col("quota_refunded")).join(
        outcomes.filter("outcome = 'failed'"), "job_id", "left_semi"
    )
    per_user = due.groupBy("user_id").agg(F.count("*").alias("refunds"))
    return users.join(per_user, "user_id", "left").select(
        "user_id",
        F.coalesce("refunds", F.lit(0)).alias("refunds"),
        F.greatest(
            F.col("analyses_used") - F.coalesce("refunds", F.lit(0)), F.lit(0)
        ).alias("analyses_used"),
    )


def quota_ledger(jobs: DataFrame, quota: int = K.DEFAULT_QUOTA) -> DataFrame:
    """Each job's place in its user's month against the quota."""
    rows = jobs.select(
        "job_id", "user_id", F.date_trunc("month", "created_at").alias("period"), "created_at"
    )
    counted = running_total(rows, ["user_id", "period"], ["created_at", "job_id"], F.lit(1), "nth")
    share = F.least(F.lit(100.0), F.col("nth") / F.lit(quota) * 100) if quota > 0 else F.lit(0.0)
    return counted.select(
        "job_id",
        "user_id",
        F.to_date("period").alias("period"),
        "nth",
        (F.col("nth") <= quota).alias("admitted"),
        share.alias("percent_used"),
    )


def failed_domains(runs: DataFrame) -> DataFrame:
    """Totals and the sorted failed keys per job; keys come from the domain vocabulary."""
    return runs.groupBy("job_id").agg(
        F.count("*").alias("domains_total"),
        F.count_if(_failed()).alias("domains_failed"),
        F.sort_array(F.collect_set(F.when(_failed(), F.col("domain_key")))).alias("failed_domains"),
    )


def review_complete(jobs: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """True only when every contributing check succeeded; a null layer status passes."""
    layers = versions.select("version_id", "tc_parse_status", "comments_parse_status")
    rows = jobs.join(_totals(runs), "job_id", "left").join(layers, "version_id", "left")
    return rows.withColumn("review_complete", layers_passed())


def layers_passed() -> Column:
    """Done, no failed domain, and no layer whose status is failed (null passes)."""
    passed = lambda c: ~F.col(c).eqNullSafe("failed")
    return (
        (F.col("state") == "done")
        & (F.coalesce("domains_failed", F.lit(0)) == 0)
        & passed("tc_parse_status")
        & passed("comments_parse_status")
        & passed("summary_status")
    )


def latest_job(jobs: DataFrame, variant: str = "created") -> DataFrame:
    """Newest job per version: ``created`` of any state, or newest done by ``done_finished`` / ``done_created``."""
    order = {
        "created": ["created_at", "job_id"],
        "done_finished": ["finished_at", "job_id"],
        "done_created": ["created_at", "job_id"],
    }[variant]
    rows = jobs if variant == "created" else jobs.filter("state = 'done'")
    return latest(rows, ["version_id"], order)


def inflight_jobs(jobs: DataFrame, now: datetime) -> DataFrame:
    """Queued or running jobs with their age at ``now`` (same clock as the table); running
    ones are requeued after a restart."""
    at = int((now - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    age = ((F.lit(at) - epoch_micros(jobs, "created_at")) / 1_000_000).cast("bigint")
    return jobs.filter(F.col("state").isin("queued", "running")).select(
        "job_id",
        "version_id",
        "state",
        age.alias("age_seconds"),
        (F.col("state") == "running").alias("requeue_on_restart"),
    )
