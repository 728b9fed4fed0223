"""Corpus rule scans: pattern, polarity, exemption and severity over a table of documents.

Rules are small configuration lists. Each pattern is a literal of its own, so it
compiles once, and the rules of a document are listed by a generator, not a join.
Patterns are tested line by line, without regard to case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    kind: str  # HAS, NOT; anything else fails
    rule_id: str
    pattern: str
    description: str = ""


@dataclass(frozen=True)
class ScanRule:
    rule_id: str
    level: str  # FAIL or WARN
    pattern: str


def parse_rubric(lines: list[str]) -> list[Check]:
    """``KIND|id|regex|description`` lines; the regex may contain bars, comments and blanks are skipped."""
    checks = []
    for line in lines:
        if not line or line.startswith("#") or "|" not in line:
            continue
        kind, _, rest = line.partition("|")
        rule_id, _, rest = rest.partition("|")
        pattern, _, description = rest.rpartition("|")
        checks.append(Check(kind, rule_id, pattern or rest, description))
    return checks


def _present(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda line: line.rlike("(?iU)" + pattern))


def _with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))


def rubric_eval(docs: DataFrame, rubric: list[Check]) -> DataFrame:
    """One row per document and check with ``passed``; an unknown kind never passes."""

    def passed(check: Check) -> Column:
        if check.kind not in ("HAS", "NOT"):
            return F.lit(False)
        found = _present(F.col("_lines"), check.pattern)
        return found if check.kind == "HAS" else ~found

    results = F.array(
        *[
            F.struct(
                F.lit(c.rule_id).alias("rule_id"), F.lit(c.kind).alias("kind"), passed(c).alias("passed")
            )
            for c in rubric
        ]
    )
    return _with_lines(docs).select("doc_id", F.inline(results))


def rubric_verdict(docs: DataFrame, rubric: list[Check]) -> DataFrame:
    """Overall verdict per document: number of checks, failed ids, PASS or FAIL."""
    unknown = [c.rule_id for c in rubric if c.kind not in ("HAS", "NOT")]
    failed = []
    for c in rubric:
        if c.rule_id in unknown:
            failed.append(F.lit(c.rule_id))
        else:
            found = _present(F.col("_lines"), c.pattern)
            failed.append(F.when(~found if c.kind == "HAS" else found, F.lit(c.rule_id)))
    ready = _with_lines(docs).select("doc_id", F.array_compact(F.array(*failed)).alias("failed"))
    return ready.select(
        "doc_id",
        F.lit(len(rubric)).alias("checks"),
        "failed",
        F.when(F.size("failed") == 0, "PASS").otherwise("FAIL").alias("verdict"),
    )


def rule_scan(docs: DataFrame, rules: list[ScanRule], exemptions: DataFrame) -> DataFrame:
    """Hits per document and rule with their level; an exempt failure is a warning.

    ``exemptions``: ``doc_id, rule_id``.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _present(F.col("_lines"), r.pattern),
                    F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level")),
                )
                for r in rules
            ]
        )
    )
    found = _with_lines(docs).select("doc_id", F.inline(hits))
    exempt = exemptions.select("doc_id", "rule_id").distinct().withColumn("exempt", F.lit(True))
    joined = found.join(exempt, ["doc_id", "rule_id"], "left")
    level = F.when(F.col("exempt"), "WARN").otherwise(F.col("level"))
    return joined.select(
        "doc_id", "rule_id", level.alias("level"), F.coalesce("exempt", F.lit(False)).alias("exempt")
    )


def denylist_hits(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """Documents that come from a denied host or mention one. Input ``page_id, url, text``."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/:?#]+)", 1))

    def verdicts(h: str) -> Column:
        return F.struct(
            F.lit(h).alias("host"),
            ((F.col("_host") == h) | F.endswith(F.col("_host"), F.lit("." + h))).alias("from_host"),
            F.contains(F.col("text"), F.lit(h)).alias("mentions"),
        )

    listed = F.array(*[verdicts(h) for h in hosts])
    rows = pages.withColumn("_host", host).select("page_id", F.inline(listed))
    return rows.filter("from_host or mentions")


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, target`` for every link of a page, each target once."""
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.explode(refs).alias("target"))


def orphan_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees and verdict per node: no link in or out FAIL, none in WARN, else PASS.

    ``nodes``: ``node_id, name``; ``edges``: ``source_id, target`` (a node's name). A
    link of a node to itself does not count as inbound.
    """
    distinct = edges.distinct()
    out = distinct.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("out_degree"))
    into = distinct.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("_in"))
    own = distinct.select(
        F.col("source_id").alias("node_id"), F.col("target").alias("name"), F.lit(1).alias("_self")
    )
    rows = (
        nodes.join(out, "node_id", "left").join(into, "name", "left").join(own, ["node_id", "name"], "left")
    )
    inbound = F.coalesce("_in", F.lit(0)) - F.coalesce("_self", F.lit(0))
    outbound = F.coalesce("out_degree", F.lit(0))
    return rows.select(
        "node_id",
        "name",
        inbound.alias("in_degree"),
        outbound.alias("out_degree"),
        F.when(inbound > 0, "PASS").when(outbound > 0, "WARN").otherwise("FAIL").alias("verdict"),
    )


def required_sections(docs: DataFrame, markers: dict[str, str], exempt: str | None = None) -> DataFrame:
    """Documents that lack a mandatory marker (``name: pattern``), with the missing names.

    A document with a line that matches ``exempt`` is skipped.
    """
    missing = F.array_compact(
        F.array(
            *[F.when(~_present(F.col("_lines"), p), F.lit(name)) for name, p in markers.items()]
        )
    )
    rows = _with_lines(docs)
    if exempt:
        rows = rows.filter(~_present(F.col("_lines"), exempt))
    # through a generator: a filter on the list would be pushed into a second evaluation
    listed = rows.select("doc_id", F.explode(F.array(missing)).alias("missing"))
    return listed.filter(F.size("missing") > 0)
