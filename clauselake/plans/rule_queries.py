"""Registered queries for corpus rule scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import rules as C
from clauselake.plans import fixtures as X

RUBRIC = C.parse_rubric(
    [
        "# checks of the test corpus",
        "HAS|r-sentence|^[[:upper:]].*\\.$|a line that is a sentence",
        "HAS|r-article|(^| )(the|der|la|le)( |$)|an article",
        "NOT|r-secret|token = \"[0-9a-f]{8,}\"|no secrets",
        "NOT|r-license|licen[sc]e|no license text",
        "MAY|r-unknown|x|a kind nobody knows",
    ]
)
# POSIX classes are spelled differently in the two engines' dialects
RUBRIC = [
    C.Check(c.kind, c.rule_id, c.pattern.replace("[[:upper:]]", "[A-Z]"), c.description) for c in RUBRIC
]
SCAN = [
    C.ScanRule("secret", "FAIL", 'token = "[0-9a-f]+"'),
    C.ScanRule("license", "WARN", "licen[sc]e"),
    C.ScanRule("mail", "FAIL", "[a-z0-9.]+@[a-z0-9.]+"),
    C.ScanRule("imperative", "FAIL", "(^| )(the|und) +(of|der|die)( |$)"),
]
HOSTS = ["example.com", "thther.example.org", "ththre.example.com", "The", "aulich"]
MARKERS = {"by": "(^| )by( |$)", "que": "que", "digit": "[0-9]"}
EXEMPT = "^(by|die|un) "


def _texts(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", "text")


def _eval(spark, sf_dir):
    return C.rubric_eval(_texts(spark, sf_dir), RUBRIC)


def _verdict(spark, sf_dir):
    rows = C.rubric_verdict(_texts(spark, sf_dir), RUBRIC)
    return rows.withColumn("failed", F.concat_ws(",", "failed"))


def _scan(spark, sf_dir):
    """Labelled documents of good quality have their license and secret hits exempted."""
    good = X.read(spark, sf_dir, "labels").filter("quality = 1")
    names = F.array(F.lit("secret"), F.lit("license"))
    exemptions = good.select("doc_id", F.explode(names).alias("rule_id"))
    return C.rule_scan(_texts(spark, sf_dir), SCAN, exemptions)


def _deny(spark, sf_dir):
    pages = X.read(spark, sf_dir, "pages").withColumnRenamed("html", "text")
    return C.denylist_hits(pages, HOSTS)


def _orphans(spark, sf_dir):
    pages = X.read(spark, sf_dir, "pages")
    first_word = F.regexp_extract("html", r"<title>([A-Za-z]+)", 1)
    nodes = pages.select(
        F.col("page_id").alias("node_id"), F.concat(F.lit("/"), F.lower(first_word)).alias("name")
    )
    edges = C.page_links(pages).select(F.col("page_id").alias("source_id"), F.lower("target").alias("target"))
    return C.orphan_links(nodes, edges)


def _sections(spark, sf_dir):
    rows = C.required_sections(_texts(spark, sf_dir), MARKERS, EXEMPT)
    return rows.withColumn("missing", F.concat_ws(",", "missing"))


QUERIES = {
    "rubric_eval": _eval,
    "rubric_verdict": _verdict,
    "rule_scan": _scan,
    "denylist_hits": _deny,
    "orphan_links": _orphans,
    "required_sections": _sections,
}


def _hit(pattern: str) -> str:
    """A match inside one line."""
    return f"len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i){pattern}'))) > 0"


def _passed(c: C.Check) -> str:
    return {"HAS": _hit(c.pattern), "NOT": f"NOT ({_hit(c.pattern)})"}.get(c.kind, "false")


ORACLES = {
    "rubric_eval": " UNION ALL ".join(
        f"SELECT doc_id, '{c.rule_id}' AS rule_id, '{c.kind}' AS kind, {_passed(c)} AS passed FROM documents" for c in RUBRIC
    ),
    "rubric_verdict": "WITH f AS (SELECT doc_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT ({_passed(c)}) THEN '{c.rule_id}' END" for c in RUBRIC)
    + f") AS failed FROM documents) SELECT doc_id, {len(RUBRIC)} AS checks, failed, CASE WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f",
    "rule_scan": "WITH h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.level}' AS level FROM documents WHERE {_hit(r.pattern)}" for r in SCAN)
    + """), e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT h.doc_id, rule_id, CASE WHEN x THEN 'WARN' ELSE level END AS level, x AS exempt FROM (SELECT h.*, e.doc_id IS NOT NULL AND rule_id IN ('secret', 'license') AS x
  FROM h LEFT JOIN e USING (doc_id)) h""",
    "denylist_hits": "WITH p AS (SELECT page_id, html, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/:?#]+)', 1)) AS h FROM pages), v AS ("
    + " UNION ALL ".join(f"SELECT page_id, '{h}' AS host, h = '{h}' OR suffix(h, '.{h}') AS from_host, contains(html, '{h}') AS mentions FROM p" for h in HOSTS)
    + ") SELECT * FROM v WHERE from_host OR mentions",
    "orphan_links": """WITH e AS (SELECT DISTINCT page_id AS s, lower(t) AS t FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages)),
n AS (SELECT page_id, '/' || lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)) AS name FROM pages),
d AS (SELECT page_id, name, (SELECT count(*) FROM e WHERE t = name AND s <> page_id) AS i, (SELECT count(*) FROM e WHERE s = page_id) AS o FROM n)
SELECT page_id AS node_id, name, i AS in_degree, o AS out_degree, CASE WHEN i > 0 THEN 'PASS' WHEN o > 0 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM d""",
    "required_sections": "WITH m AS (SELECT doc_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT ({_hit(p)}) THEN '{name}' END" for name, p in MARKERS.items())
    + f") AS missing FROM documents WHERE NOT ({_hit(EXEMPT)})) SELECT * FROM m WHERE missing <> ''",
}
