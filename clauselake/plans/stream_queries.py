"""Registered streaming queries: each reads its table as a stream to the end, then its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.plans import access_queries as A
from clauselake.plans import fixtures as X
from clauselake.plans import redact_queries as R
from clauselake.plans.fixtures import BLANKS
from clauselake.session import scratch_path
from clauselake.sources import corpus as C
from clauselake.streaming import streams as S


def _stream(spark, sf_dir, table):
    """The table as a stream, be it one file or a folder of files.

    A stream starts from a folder or a pattern; a pattern that only the table matches takes both.
    """
    schema = X.read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _run(spark, start):
    """Start a stream with a fresh sink and checkpoint, wait for the end, give the sink's folder."""
    sink, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "checkpoint")
    start(sink, checkpoint).awaitTermination()
    return sink


def _segment(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("version_id"), F.expr(f"text || {R.PLANTED}").alias("text"))
    sink = _run(spark, lambda path, cp: S.stream_segment_redact(texts, path, cp))
    return spark.read.parquet(sink).select("version_id", "ordinal", "text", "char_start", "char_end")


def _attempt_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    ip = F.get_json_object("props", "$.k").cast("bigint") % 8
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("identifier"),
        ip.alias("ip"),
        (F.col("event_type") != "error").alias("success"),
        F.col("ts").alias("created_at"),
    )


def _lockouts(spark, sf_dir):
    attempts = _attempt_stream(spark, sf_dir)
    sink = _run(spark, lambda path, cp: S.stream_lockouts(attempts, path, cp, A.DAY))
    rows = S.verdicts(spark, sink, 3, 40)
    return rows.select("attempt_id", "identifier_failures", "address_failures", "verdict")


def _usage_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select(
        "user_id",
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100)).alias("input_tokens"),
        F.col("ts").alias("created_at"),
    )


def _usage(spark, sf_dir):
    events = _usage_stream(spark, sf_dir)
    return S.current_usage(spark, _run(spark, lambda path, cp: S.stream_usage(events, path, cp)))


def _final_usage(spark, sf_dir):
    """The windows that end an hour or more before the last event."""
    events = _usage_stream(spark, sf_dir)
    return spark.read.parquet(_run(spark, lambda path, cp: S.stream_final_usage(events, path, cp)))


def _dedupe(spark, sf_dir):
    """Fingerprints of the documents, each once; a document arrives as many seconds after the first as its id says."""
    texts = C.content_fingerprint(_stream(spark, sf_dir, "documents")).select(
        "sha256", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("arrived_at")
    )
    sink = _run(spark, lambda path, cp: S.stream_dedupe(texts, path, cp))
    return spark.read.parquet(sink).select("sha256")


def _job_state(spark, sf_dir):
    changes = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("state"),
        F.col("ts").alias("changed_at"),
        F.col("event_id").alias("change_id"),
    )
    sink = _run(spark, lambda path, cp: S.stream_job_state(changes, path, cp))
    return S.current_job_state(spark, sink)


QUERIES = {
    "stream_segment_redact": _segment,
    "stream_lockouts": _lockouts,
    "stream_usage": _usage,
    "stream_final_usage": _final_usage,
    "stream_job_state": _job_state,
    "stream_dedupe": _dedupe,
}

ORACLES = {
    "stream_segment_redact": f"""{R._BASE}, para AS (SELECT version_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM
  (SELECT version_id, string_split(regexp_replace(text, '(\\n\\n+)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM t6)),
located AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY version_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM para),
kept AS (SELECT *, trim(piece, '{BLANKS}') AS t, s + length(piece) - length(ltrim(piece, '{BLANKS}')) AS cs FROM located)
SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY i) AS INTEGER) AS ordinal, t AS text, CAST(cs AS BIGINT) AS char_start,
  CAST(cs + length(t) AS BIGINT) AS char_end FROM kept WHERE t <> ''""",
    "stream_lockouts": A.ORACLES["lockouts"],
    "stream_usage": """SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed_calls,
  CAST(sum(floor(value * 100)) FILTER (WHERE event_type <> 'error') AS BIGINT) AS input_tokens FROM events GROUP BY 1, 2""",
    "stream_final_usage": """SELECT window_start, user_id, calls, failed_calls, input_tokens FROM (
  SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed_calls,
    CAST(sum(floor(value * 100)) FILTER (WHERE event_type <> 'error') AS BIGINT) AS input_tokens FROM events GROUP BY 1, 2)
  WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_dedupe": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
    "stream_job_state": "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS changed_at, arg_max(event_id, (ts, event_id)) AS change_id FROM events GROUP BY user_id",
}
