"""Finding queries.

Findings: ``flag_id, job_id, domain, severity, finding_type, summary, rationale,
negotiation_ask, created_at``. Edits: ``edit_id, flag_id, job_id, ...,
accepted`` (true, false, or null for undecided). Citations: ``citation_id,
flag_id, job_id, basis``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import latest, running_total

def _accepted(value: bool) -> Column:
    return F.col("accepted").eqNullSafe(value)


def severity_rank(c: str = "severity") -> Column:
    """Critical, high, medium, everything else."""
    rank = F.lit(len(K.SEVERITIES))
    for i, name in reversed(list(enumerate(K.SEVERITIES[:-1], 1))):
        rank = F.when(F.col(c) == name, i).otherwise(rank)
    return rank


def findings_of_jobs(findings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Findings of exactly the given runs, never of another run of the same version."""
    return findings.join(jobs.select("job_id").distinct(), "job_id", "left_semi")


def order_by_severity(findings: DataFrame) -> DataFrame:
    """``severity_rank`` and ``place``, the finding's place in its job's display order.

    The order is a column, not a sort of the table: the next step would lose that.
    """
    ranked = findings.withColumn("severity_rank", severity_rank())
    keys = ["severity_rank", "created_at", "flag_id"]
    places = running_total(ranked.select("job_id", *keys), ["job_id"], keys, F.lit(1), "place")
    return ranked.join(places.select("flag_id", "place"), "flag_id")


def findings_nested(findings: DataFrame, edits: DataFrame, citations: DataFrame) -> DataFrame:
    """Each finding with arrays of its edits and citations.

    Both children are gathered per finding, in one aggregate, before the join; a finding's
    edits come from one answer of bounded length.
    """
    edit = F.struct("edit_id", "original_text", "revised_text", "accepted")
    children = edits.select("flag_id", edit.alias("_edit")).unionByName(
        citations.select("flag_id", F.struct("citation_id", "basis").alias("_citation")), allowMissingColumns=True
    )
    lists = {"suggested_edits": "_edit", "citations": "_citation"}
    gathered = children.groupBy("flag_id").agg(
        *[F.array_sort(F.collect_list(c)).alias(name) for name, c in lists.items()]  # nulls are left out
    )
    joined = findings.join(gathered, "flag_id", "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.array().cast(gathered.schema[name].dataType)) for name in lists}
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Four zero-filled counts per job; an unknown severity is in none of them."""
    return findings.groupBy("job_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES]
    )


def findings_by_group(findings: DataFrame) -> DataFrame:
    """Display groups per job: one per severity, absences on their own, empty groups left out."""
    group = F.when(F.col("finding_type") == "absent", "absent").when(
        F.col("severity").isin(K.SEVERITIES), F.col("severity")
    )
    grouped = findings.withColumn("display_group", group).filter("display_group is not null")
    return grouped.groupBy("job_id", "display_group").agg(F.count("*").alias("findings"))


def edit_tally(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by decision, each one counted."""
    return edits.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(_accepted(True)).alias("accepted"),
        F.count_if(_accepted(False)).alias("rejected"),
        F.count_if(F.col("accepted").isNull()).alias("undecided"),
    )


def exportable_edits(edits: DataFrame, accepted_only: bool = False) -> DataFrame:
    """Accepted or undecided edits; rejected ones never leave."""
    return edits.filter(_accepted(True) if accepted_only else ~_accepted(False))


def actionable_asks(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """The asks for a job's negotiation letter, numbered in severity order.

    All of them unless the caller sets a ``limit``. Findings with an ask, not absent, at least medium; a job without any such
    falls back to all its findings with an ask.
    """
    asked = findings.filter(F.coalesce("negotiation_ask", F.lit("")) != "").withColumn(
        "_strong",
        F.coalesce(
            (F.col("finding_type") != "absent") & F.col("severity").isin(K.SEVERITIES[:3]),
            F.lit(False),
        ),
    )
    has_strong = asked.groupBy("job_id").agg(F.max("_strong").alias("_any"))
    chosen = asked.join(has_strong, "job_id").filter(F.col("_strong") | ~F.col("_any"))
    keys = ["_severity", "created_at", "flag_id"]
    ranked = chosen.withColumn("_severity", severity_rank())
    numbers = running_total(ranked.select("job_id", *keys), ["job_id"], keys, F.lit(1), "ask_no")
    if limit is not None:
        numbers = numbers.filter(F.col("ask_no") <= limit)
    return ranked.join(numbers.select("flag_id", F.col("ask_no").cast("int")), "flag_id").select(
        "job_id", "ask_no", "flag_id", "severity", "summary", "negotiation_ask"
    )


def find_by_reference(findings: DataFrame, references: DataFrame) -> DataFrame:
    """Per job the first finding that mentions the reference text, else its first finding.

    ``references``: ``job_id, reference``. A minimum over (no match, severity,
    time, key) combines map-side; no ranking of whole jobs.
    """
    ref = F.lower("reference")
    hit = F.contains(F.lower("summary"), ref) | F.contains(F.lower("rationale"), ref)
    rows = findings.join(references, "job_id").withColumn("matched", F.coalesce(hit, F.lit(False)))
    place = F.struct((~F.col("matched")), severity_rank(), "created_at", "flag_id")
    return rows.groupBy("job_id").agg(
        F.min_by(F.struct("flag_id", "matched"), place).alias("_r")
    ).select("job_id", "_r.flag_id", "_r.matched")


def document_list(documents: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Live documents with version count, latest version and that version's latest job.

    Versions are reduced to one row per document first, jobs to one row per
    latest version; both are aggregates, so a long history costs no ranking.
    """
    live = documents.filter("deleted_at is null")
    newest = versions.groupBy("document_id").agg(
        F.count("*").alias("version_count"),
        F.max_by("version_id", "version_no").alias("latest_version_id"),
        F.max("version_no").alias("latest_version_no"),
    )
    rows = live.join(newest, "document_id", "left")
    own = jobs.join(
        rows.select(F.col("latest_version_id").alias("version_id"), "user_id"),
        ["version_id", "user_id"],
        "left_semi",
    )
    last = latest(
        own.select("version_id", "job_id", "state", "created_at"), ["version_id"], ["created_at", "job_id"]
    ).toDF("latest_version_id", "latest_job_id", "latest_job_state", "_job_created")
    joined = rows.join(last.drop("_job_created"), "latest_version_id", "left")
    return joined.select(
        "document_id",
        "user_id",
        "title",
        "counterparty",
        "created_at",
        F.coalesce("version_count", F.lit(0)).alias("version_count"),
        "latest_version_id",
        "latest_version_no",
        "latest_job_id",
        "latest_job_state",
    )


def version_history(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions of live documents; ``version_no`` is their order."""
    live = documents.filter("deleted_at is null").select("document_id", "user_id")
    return versions.join(live, "document_id")


def results_bundle(
    jobs: DataFrame,
    versions: DataFrame,
    runs: DataFrame,
    findings: DataFrame,
    edits: DataFrame,
    comments: DataFrame,
) -> DataFrame:
    """One row per job: state, layers, completeness, counts of findings, edits and comments.

    A job whose version is missing stays, with null version columns. The findings
    themselves are rows (``bundle_findings``), so that no job's findings have to fit into
    one cell. Every table is reduced once, to its key, before it is joined.
    """
    from clauselake.operators.jobs import failed_domains, layers_passed

    tally = edit_tally(edits, ["job_id"]).toDF("job_id", "edits", "edits_accepted", "edits_rejected", "edits_undecided")
    counted = findings.groupBy("job_id").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES],
    )
    bubbles = comments.groupBy("version_id").agg(F.count("*").alias("comments"))
    layers = versions.select(
        "version_id", "document_id", "tc_parse_status", "comments_parse_status"
    ).join(bubbles, "version_id", "left")
    rows = (
        jobs.join(failed_domains(runs), "job_id", "left")
        .join(counted, "job_id", "left")
        .join(tally, "job_id", "left")
        .join(layers, "version_id", "left")
        .withColumn("review_complete", layers_passed())
    )
    zero = [*K.SEVERITIES, "findings", "edits", "edits_accepted", "edits_rejected", "edits_undecided",
            "domains_total", "domains_failed", "comments"]
    return rows.select(
        "job_id",
        "version_id",
        "document_id",
        "state",
        "tc_parse_status",
        "comments_parse_status",
        "summary_status",
        "review_complete",
        "quota_refunded",
        F.coalesce("failed_domains", F.array().cast("array<string>")).alias("failed_domains"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
    )


def bundle_findings(
    jobs: DataFrame, findings: DataFrame, edits: DataFrame, citations: DataFrame
) -> DataFrame:
    """The findings of the given jobs as rows in display order, with edits and citations."""
    chosen = order_by_severity(findings_of_jobs(findings, jobs))
    return findings_nested(chosen, edits, citations)


def portfolio_risk(findings: DataFrame, jobs: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Findings per counterparty, domain and severity, with the number of versions hit."""
    where = (
        jobs.select("job_id", "version_id")
        .join(versions.select("version_id", "document_id"), "version_id")
        .join(documents.select("document_id", "counterparty"), "document_id")
        .select("job_id", "version_id", "counterparty")
    )
    keys = ["counterparty", "domain", "severity"]
    per_version = (
        findings.select("job_id", "domain", "severity")
        .join(where, "job_id")
        .groupBy(*keys, "version_id")
        .agg(F.count("*").alias("n"))
    )
    return per_version.groupBy(*keys).agg(
        F.sum("n").alias("findings"), F.count("*").alias("versions_hit")
    )


def portfolio_cube(findings: DataFrame, jobs: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """``portfolio_risk`` at every level of counterparty, domain and severity, with shares.

    ``by_counterparty, by_domain, by_severity`` say which keys a row is cut by; the others
    are null. ``versions`` are the reviewed ones of the counterparty, or all of them, with
    findings or without; ``share`` is the part of them that is hit. A version counts once at
    each level: what it has is summed per version, domain and severity first, and of these
    rows the first of the version, of its domain and of its severity are marked. A cell then
    holds the sums of its marks, from which the wider levels follow, so no version is copied
    for a level and nothing distinct is counted over raw findings.
    """
    where = (
        jobs.select("job_id", "version_id")
        .join(versions.select("version_id", "document_id"), "version_id")
        .join(documents.select("document_id", "counterparty"), "document_id")
        .select("job_id", "version_id", "counterparty")
    )
    reviewed = where.select("version_id", "counterparty").distinct()
    bases = (
        reviewed.rollup("counterparty")
        .agg((F.grouping("counterparty") == 0).alias("by_counterparty"), F.count("*").alias("versions"))
        .withColumnRenamed("counterparty", "_counterparty")
    )
    keys = ["domain", "severity"]
    per_version = (
        findings.select("job_id", *keys)
        .join(where, "job_id")
        .groupBy("counterparty", "version_id", *keys)
        .agg(F.count("*").alias("n"))
    )
    of_version = Window.partitionBy("counterparty", "version_id")
    by_domain, by_severity = of_version.orderBy("domain", "severity"), of_version.orderBy("severity")

    def fresh(key: str, order: WindowSpec) -> Column:
        """Is the row its version's first with this value? Equal values follow each other."""
        return (F.row_number().over(order) == 1) | ~F.lag(key).over(order).eqNullSafe(F.col(key))

    marked = per_version.select(
        "counterparty",
        *keys,
        "n",
        (F.row_number().over(by_domain) == 1).cast("int").alias("_once"),
        fresh("domain", by_domain).cast("int").alias("_domain"),
        fresh("severity", by_severity).cast("int").alias("_severity"),
    )
    narrow = marked.groupBy("counterparty", *keys).agg(
        F.sum("n").alias("findings"),
        F.count("*").alias("_both"),
        *[F.sum(c).alias(c) for c in ("_once", "_domain", "_severity")],
    )
    marks = {(True, True): "_both", (True, False): "_domain", (False, True): "_severity", (False, False): "_once"}
    levels = [
        F.struct(
            F.lit(d).alias("by_domain"),
            F.lit(s).alias("by_severity"),
            F.when(F.lit(d), F.col("domain")).alias("domain"),
            F.when(F.lit(s), F.col("severity")).alias("severity"),
            F.col(mark).alias("versions_hit"),
        )
        for (d, s), mark in marks.items()
    ]
    level = ["by_domain", "by_severity", *keys]
    cells = (
        narrow.select("counterparty", "findings", F.inline(F.array(*levels)))
        .groupBy("counterparty", *level)
        .agg(F.sum("findings").alias("findings"), F.sum("versions_hit").alias("versions_hit"))
    )
    whole = cells.groupBy(*level).agg(
        F.lit(None).cast("string").alias("counterparty"),
        F.sum("findings").alias("findings"),
        F.sum("versions_hit").alias("versions_hit"),  # a version has one counterparty
    )
    every = cells.withColumn("by_counterparty", F.lit(True)).unionByName(
        whole.withColumn("by_counterparty", F.lit(False))
    )
    same = F.expr("e.by_counterparty = b.by_counterparty AND e.counterparty <=> b._counterparty")
    return every.alias("e").join(bases.alias("b"), same).select(
        "e.by_counterparty",
        "by_domain",
        "by_severity",
        "counterparty",
        "domain",
        "severity",
        "findings",
        "versions_hit",
        "versions",
        (F.col("versions_hit") / F.col("versions")).alias("share"),
    )


def apply_decisions(edits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set ``accepted`` to the newest decision per edit.

    A decision may reset an edit to undecided; that null wins over an older value,
    so presence is carried by a flag and not by the value. Only edits of the
    deciding user change: both tables carry ``user_id``.
    """
    newest = latest(
        decisions.select("edit_id", "user_id", "accepted", "decided_at", "decision_id"),
        ["edit_id", "user_id"],
        ["decided_at", "decision_id"],
    ).select("edit_id", "user_id", F.col("accepted").alias("_new"), F.lit(True).alias("_decided"))
    joined = edits.join(newest, ["edit_id", "user_id"], "left")
    value = F.when(F.col("_decided"), F.col("_new")).otherwise(F.col("accepted"))
    return joined.select(*[value.alias(c) if c == "accepted" else F.col(c) for c in edits.columns])
