"""Retention: what is purged, what survives, what is left behind."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import moment


def expired_documents(
    documents: DataFrame, now: datetime, days: int = K.RETENTION_DAYS
) -> DataFrame:
    cutoff = moment(now - timedelta(days=days))
    return documents.filter(F.col("deleted_at") < cutoff).select("document_id")


def purge_set(
    documents: DataFrame, versions: DataFrame, now: datetime, days: int = K.RETENTION_DAYS
) -> DataFrame:
    """Storage keys of documents soft-deleted before the cutoff."""
    gone = expired_documents(documents, now, days)
    return versions.join(gone, "document_id", "left_semi").select(
        "document_id", "version_id", "storage_key"
    )


def purge_cascade(
    documents: DataFrame,
    versions: DataFrame,
    jobs: DataFrame,
    findings: DataFrame,
    edits: DataFrame,
    usage: DataFrame,
    now: datetime,
    days: int = K.RETENTION_DAYS,
    dependents: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Surviving rows of every dependent table; usage stays, with its job set to null.

    ``dependents`` are further tables by name: clauses, comments, redaction mappings,
    version differences, domain runs, citations. A row of theirs survives when everything
    it names survives: its ``version_id``, ``from_version``, ``to_version``, ``job_id`` and
    ``flag_id``, whichever the table has.
    """
    gone = expired_documents(documents, now, days)
    kept_versions = versions.join(gone, "document_id", "left_anti")
    kept_jobs = jobs.join(kept_versions, "version_id", "left_semi")
    kept_findings = findings.join(kept_jobs, "job_id", "left_semi")
    alive = kept_jobs.select("job_id", F.lit(True).alias("_alive"))
    kept_usage = usage.join(alive, "job_id", "left").withColumn(
        "job_id", F.when(F.col("_alive"), F.col("job_id"))
    )
    kept = {
        "documents": documents.join(gone, "document_id", "left_anti"),
        "versions": kept_versions,
        "jobs": kept_jobs,
        "findings": kept_findings,
        "edits": edits.join(kept_findings, "flag_id", "left_semi"),
        "usage": kept_usage.drop("_alive"),
    }
    owners = {
        "version_id": kept_versions.select("version_id"),
        "from_version": kept_versions.select(F.col("version_id").alias("from_version")),
        "to_version": kept_versions.select(F.col("version_id").alias("to_version")),
        "job_id": kept_jobs.select("job_id"),
        "flag_id": kept_findings.select("flag_id"),
    }
    for name, table in (dependents or {}).items():
        named = [c for c in owners if c in table.columns]
        if not named:
            raise ValueError(f"{name} names nothing that is purged")
        for c in named:
            table = table.join(owners[c], c, "left_semi")
        kept[name] = table
    return kept


def orphan_blobs(inventory: DataFrame, versions: DataFrame) -> DataFrame:
    """Stored objects without a live row, and rows without an object."""
    stored = inventory.select("storage_key").distinct()
    named = versions.select("storage_key").distinct()
    extra = stored.join(named, "storage_key", "left_anti").withColumn("problem", F.lit("no_row"))
    lost = named.join(stored, "storage_key", "left_anti").withColumn("problem", F.lit("no_object"))
    return extra.unionByName(lost)


def retention_schedule(
    documents: DataFrame, now: datetime, days: int = K.RETENTION_DAYS
) -> DataFrame:
    """Days until purge per soft-deleted document, zero once due."""
    purge_at = F.date_add(F.to_date("deleted_at"), days)
    left = F.greatest(F.datediff(purge_at, F.lit(now.date())), F.lit(0))
    return documents.filter("deleted_at is not null").select(
        "document_id", "user_id", purge_at.alias("purge_on"), left.alias("days_left")
    )
