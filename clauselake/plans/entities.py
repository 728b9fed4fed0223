"""Users, documents, versions, jobs, runs, findings and edits derived from the star schema.

A document is three customers (its versions), an order is a job on a version, an
order line is a finding or a domain run of that job.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.plans import fixtures as X

# The same text runs in both engines.
_DOCUMENTS = """SELECT document_id, document_id % 25 AS user_id, min(c_name) AS title, min(c_mktsegment) AS counterparty,
  {day}1995-01-01' + INTERVAL '1' DAY * CAST(document_id % 1000 AS INTEGER) AS created_at,
  CASE WHEN min(c_acctbal) < 0 THEN {day}2001-01-01' + INTERVAL '1' DAY * CAST(document_id % 60 AS INTEGER) END AS deleted_at
  FROM (SELECT *, CAST(floor(c_custkey / 3.0) AS BIGINT) AS document_id FROM customer) c GROUP BY document_id"""
_VERSIONS = """SELECT c_custkey AS version_id, CAST(floor(c_custkey / 3.0) AS BIGINT) AS document_id, CAST(c_custkey % 3 + 1 AS INTEGER) AS version_no,
  'file' || c_custkey || '.docx' AS source_filename, {day}1996-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 700 AS INTEGER) AS uploaded_at,
  CASE WHEN c_custkey % 4 = 0 THEN 'failed' WHEN c_custkey % 4 < 3 THEN 'ok' END AS tc_parse_status,
  CASE WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 5 < 4 THEN 'ok' END AS comments_parse_status FROM customer"""
_JOBS = """SELECT o_orderkey AS job_id, o_custkey AS version_id, CAST(floor(o_custkey / 3.0) AS BIGINT) % 25 AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'running' END END AS state,
  o_orderdate AS created_at, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 9 AS INTEGER) END AS finished_at,
  o_orderkey % 10 = 0 AS quota_refunded, CASE WHEN o_orderkey % 8 = 0 THEN 'failed' WHEN o_orderkey % 8 < 7 THEN 'ok' END AS summary_status FROM orders"""
_OUTCOMES = """SELECT l_orderkey AS job_id, 'domain_' || l_linenumber AS domain_key, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 'part ' || l_partkey || ' failed' END AS error, l_shipdate AS created_at,
  l_partkey * 1000 + l_suppkey AS tie, l_extendedprice AS price FROM lineitem"""
_FINDING_COLUMNS = """(l_orderkey * 10 + l_linenumber) * 100 + copy_no AS flag_id, l_orderkey AS job_id, 'domain_' || (l_partkey % 18) AS domain,
  CASE WHEN l_quantity >= 40 THEN 'critical' WHEN l_quantity >= 25 THEN 'high' WHEN l_quantity >= 10 THEN 'medium' WHEN l_quantity >= 3 THEN 'info' ELSE 'odd' END AS severity,
  CASE WHEN l_linestatus = 'O' THEN 'present_risky' WHEN l_returnflag = 'A' THEN 'absent' ELSE 'ambiguous' END AS finding_type,
  'part ' || l_partkey || ' at risk' AS summary, 'supplier ' || l_suppkey || ' status ' || l_linestatus AS rationale,
  CASE WHEN l_tax > 0 THEN 'ask supplier ' || l_suppkey END AS negotiation_ask, l_shipdate AS created_at"""

# the few lines of one order and number are ranked among themselves; wholly equal ones are alike
_FINDINGS = f"""SELECT {_FINDING_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_linestatus, l_returnflag) AS copy_no FROM lineitem) AS numbered"""

_INTERVAL_DAY = "TIMESTAMP_NTZ'"


def _run(spark, sf_dir, sql, table):
    text = sql.replace(f"FROM {table}", "FROM {" + table + "}").replace("{day}", _INTERVAL_DAY)
    return X.run_sql(spark, text, **{table: X.read(spark, sf_dir, table)})


def documents(spark, sf_dir):
    return _run(spark, sf_dir, _DOCUMENTS, "customer")


def versions(spark, sf_dir):
    return _run(spark, sf_dir, _VERSIONS, "customer")


def jobs(spark, sf_dir):
    return _run(spark, sf_dir, _JOBS, "orders")


def outcomes(spark, sf_dir):
    return _run(spark, sf_dir, _OUTCOMES, "lineitem")


def runs(spark, sf_dir):
    from clauselake.operators.jobs import domain_runs

    return domain_runs(outcomes(spark, sf_dir), ["created_at", "tie", "price"]).drop("tie", "price")


def findings(spark, sf_dir):
    """One finding per order line; lines that share a number are numbered among themselves."""
    return _run(spark, sf_dir, _FINDINGS, "lineitem")


def edits(spark, sf_dir, rows=None):
    """Two edits per finding with a three-valued decision; ``rows`` are the findings if they are there."""
    rows = findings(spark, sf_dir) if rows is None else rows
    edit = lambda n: F.struct(
        (F.col("flag_id") * 2 + n).alias("edit_id"),
        F.lit(n).cast("int").alias("edit_no"),
        F.concat(F.lit("old "), F.col("flag_id").cast("string")).alias("original_text"),
        F.concat(F.lit(f"new {n} "), "summary").alias("revised_text"),
    )
    listed = rows.select("flag_id", "job_id", F.inline(F.array(edit(0), edit(1))))
    return listed.withColumn(
        "accepted", F.when(F.col("edit_id") % 3 == 0, True).when(F.col("edit_id") % 3 == 1, False)
    )


def citations(spark, sf_dir, rows=None):
    rows = findings(spark, sf_dir) if rows is None else rows
    basis = (
        F.when(F.col("severity") == "critical", F.lit("statutory"))
        .when(F.col("flag_id") % 2 == 0, F.lit("doctrinal"))
    )
    return rows.select("flag_id", "job_id", (F.col("flag_id") * 3).alias("citation_id"), basis.alias("basis"))


def _duck(sql: str) -> str:
    return sql.replace("{day}", "TIMESTAMP '")


DOCUMENTS = f"docs AS MATERIALIZED ({_duck(_DOCUMENTS)})"
VERSIONS = f"vers AS MATERIALIZED ({_duck(_VERSIONS)})"
JOBS = f"jobs AS MATERIALIZED ({_duck(_JOBS)})"
RUNS = f"""runs AS MATERIALIZED (SELECT job_id, domain_key, status, error, created_at FROM (SELECT *, row_number() OVER
  (PARTITION BY job_id, domain_key ORDER BY created_at DESC, tie DESC, price DESC) AS rn FROM ({_OUTCOMES})) WHERE rn = 1)"""
FINDINGS = f"finding AS MATERIALIZED ({_FINDINGS})"
EDITS = """edit AS MATERIALIZED (SELECT *, CASE edit_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accepted FROM
  (SELECT flag_id, job_id, flag_id * 2 + n AS edit_id, CAST(n AS INTEGER) AS edit_no, 'old ' || flag_id AS original_text,
   'new ' || n || ' ' || summary AS revised_text FROM finding, (VALUES (0), (1)) t(n)))"""
CITATIONS = """cite AS MATERIALIZED (SELECT flag_id, job_id, flag_id * 3 AS citation_id, CASE WHEN severity = 'critical' THEN 'statutory' WHEN flag_id % 2 = 0 THEN 'doctrinal' END AS basis
  FROM finding)"""
SEVERITY_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
