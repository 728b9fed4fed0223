"""The same operators over arriving data.

Sinks write one folder per micro-batch and overwrite it when a batch is repeated,
so a restart changes nothing. State that has to last lies in the checkpoint's state store,
never in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from clauselake import constants as K
from clauselake.functions.running import epoch_micros, latest
from clauselake.operators.access import lockout_verdict
from clauselake.operators.redact import redacted
from clauselake.operators.segment import segment
from clauselake.sources.writes import read_buckets, upsert_buckets


def _batch_folder(path: str, epoch: int) -> str:
    return f"{path}/batch={epoch}"


def segment_redact(texts: DataFrame) -> DataFrame:
    """Redacted clauses of each text: redact the whole version, then cut it.

    Stateless per version; usable on a batch and on a stream. The mapping of the
    version travels with each of its clauses as a count only.
    """
    done = redacted(texts.select("version_id", "text"))
    clean = done.select(
        "version_id",
        F.col("redaction.text").alias("text"),
        F.size("redaction.tokens").alias("tokens"),
    )
    return segment(clean)


def stream_segment_redact(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        segment_redact(texts)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# an attempt in the state: its time, its id (0 where ``named`` is false), and whether it failed
_ATTEMPT = np.dtype([("t", "<i8"), ("attempt_id", "<i8"), ("named", "?"), ("failure", "?")])
_GIVEN = 100_000  # rows given out at once


class _Window(StatefulProcessor):
    """Failures before each attempt of one key, given out when no earlier attempt can come.

    The state is one row a key: the attempts that wait for the watermark and the failures of
    one window, packed, and the timer that is set. It is read and written once a call.
    """

    def __init__(self, seconds: int):
        self.width = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer bigint, failures binary, waiting binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        parts = []
        for part in rows:
            packed = np.empty(len(part), _ATTEMPT)
            for name in _ATTEMPT.names:
                packed[name] = part[name].to_numpy()
            timed = part["timed"].to_numpy(dtype=bool)
            parts.append(packed[timed])
            # an attempt without a time lies in no window
            yield from _counts(key, packed[~timed], None)
        yield from self._given(key, parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        fired = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._given(key, [], timerValues.getCurrentWatermarkInMs(), fired)

    def _given(
        self, key: tuple, new: list[np.ndarray], watermark: int, fired: int | None = None
    ) -> Iterator[pd.DataFrame]:
        timer, kept, waiting = self.held.get() or (None, b"", b"")
        kept = np.frombuffer(kept, "<i8")
        held = np.concatenate([np.frombuffer(waiting, _ATTEMPT), *new])
        passed = held["t"] <= watermark * 1000
        ready, rest = held[passed], held[~passed]
        ready = ready[np.lexsort((ready["failure"], ready["attempt_id"], ready["named"], ready["t"]))]
        times = ready["t"][ready["failure"]]
        # of the failures before an attempt, those that the window has left behind are none
        left = ready["t"] - self.width
        earlier = np.cumsum(ready["failure"]) - ready["failure"]
        failures = earlier - np.searchsorted(times, left, side="right")
        failures += len(kept) - np.searchsorted(kept, left, side="right")
        over = np.sort(np.concatenate([kept, times]))
        over = over[over > watermark * 1000 - self.width]
        # wake up for the next attempt that waits, or when the last failure is out of the window
        due = None
        if len(rest):
            due = -(-int(rest["t"].min()) // 1000)
        elif len(over):
            due = -(-(int(over[-1]) + self.width) // 1000)
        if timer is not None and timer not in (due, fired):  # one that has fired goes by itself
            self.handle.deleteTimer(timer)
        if due is not None and (due != timer or due == fired):
            self.handle.registerTimer(due)
        if due is not None:
            self.held.update((due, over.tobytes(), rest.tobytes()))
        elif timer is not None:
            self.held.clear()
        yield from _counts(key, ready, failures)

    def close(self) -> None:
        pass


def _counts(key: tuple, attempts: np.ndarray, failures: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Rows of the result: without ``failures`` the attempts have no time and none before them."""
    for at in range(0, len(attempts), _GIVEN):
        part = attempts[at : at + _GIVEN]
        zero = np.zeros(len(part), np.int64)
        yield pd.DataFrame(
            {
                "kind": key[0],
                "value": key[1],
                "attempt_id": pd.arrays.IntegerArray(part["attempt_id"].copy(), ~part["named"]),
                "t": pd.arrays.IntegerArray(part["t"].copy(), np.full(len(part), failures is None)),
                "failures": zero if failures is None else failures[at : at + _GIVEN],
            }
        )


def attempt_counts(attempts: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """``attempt_id, t, kind, failures`` of a stream of attempts, per address and identifier."""
    micros = epoch_micros(attempts, "created_at")
    kinds = F.array(
        *[
            F.struct(
                F.lit(c).alias("kind"),
                # a missing key is a key like any other
                F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("value"),
            )
            for c in ("ip", "identifier")
        ]
    )
    rows = (
        attempts.select(
            # watermarks count whole milliseconds: rounded up, the last attempt is reached too
            F.timestamp_micros(F.ceil(micros / 1000) * 1000).alias("_at"),
            # without nulls, which would turn whole columns of numbers into floats on their way
            F.coalesce(micros, F.lit(0)).alias("t"),
            micros.isNotNull().alias("timed"),
            F.coalesce(F.col("attempt_id").cast("bigint"), F.lit(0)).alias("attempt_id"),
            F.col("attempt_id").cast("bigint").isNotNull().alias("named"),
            (~F.coalesce("success", F.lit(False))).alias("failure"),
            kinds.alias("_k"),
        )
        .withWatermark("_at", lateness)
        .select("_at", "t", "timed", "attempt_id", "named", "failure", F.inline("_k"))
    )
    return rows.groupBy("kind", "value").transformWithStateInPandas(
        _Window(seconds),
        "kind string, value string, attempt_id bigint, t bigint, failures bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_lockouts(
    attempts: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int = K.LOCKOUT_WINDOW_SECONDS,
    lateness: str = "0 seconds",
) -> StreamingQuery:
    """Failures before each attempt, written once, when the watermark has passed the attempt.

    Attempts may come ``lateness`` after later ones; one that comes later still is dropped,
    as it would change what is written. An address and an identifier are keyed states of
    their own that hold the waiting attempts and one window of failures; a timer empties
    them. The last ``lateness`` of a stream waits for more to come. Read the result with
    ``verdicts``.
    """
    spark = attempts.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query keeps the settings that it starts with
        return (
            attempt_counts(attempts, seconds, lateness)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def verdicts(
    spark: SparkSession,
    path: str,
    per_identifier: int = K.LOCKOUT_PER_IDENTIFIER,
    per_address: int = K.LOCKOUT_PER_ADDRESS,
) -> DataFrame:
    """``attempt_id, address_failures, identifier_failures, verdict`` of what a stream has written."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("failures")))
    counts = spark.read.parquet(path).groupBy("attempt_id").agg(
        of("ip").alias("address_failures"), of("identifier").alias("identifier_failures")
    )
    return counts.withColumn("verdict", lockout_verdict(per_identifier, per_address))


def usage_windows(usage: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Calls per user and tumbling window; built-in partial aggregation before the shuffle.

    A watermark needs a time with zone: the table's clock is read as UTC for it and
    written back the same way.
    """
    timed = usage.withColumn("_at", F.timestamp_micros(epoch_micros(usage, "created_at")))
    counted = (
        timed.withWatermark("_at", lateness)
        .groupBy(F.window("_at", width), "user_id")
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.col("status") == "failed").alias("failed_calls"),
            F.sum("input_tokens").alias("input_tokens"),
        )
    )
    start = F.expr(
        "TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, 0, CAST(unix_seconds(window.start) AS DECIMAL(18, 6)))"
    )
    return counted.select(
        start.alias("window_start"),
        "user_id",
        "calls",
        "failed_calls",
        "input_tokens",
    )


def stream_usage(
    usage: DataFrame, path: str, checkpoint: str, width: str = "1 day", lateness: str = "1 hour"
) -> StreamingQuery:
    """Every window as it stands after each batch; the newest count of a window is the right one.

    Open windows are written too, so the last ones are not lost when the stream ends. Read
    the result with ``current_usage``.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(_batch_folder(path, epoch))

    return (
        usage_windows(usage, width, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_usage(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every user and window."""
    return latest(spark.read.parquet(path), ["window_start", "user_id"], ["batch"]).drop("batch")


def stream_final_usage(
    usage: DataFrame, path: str, checkpoint: str, width: str = "1 day", lateness: str = "1 hour"
) -> StreamingQuery:
    """Every window once, when the watermark has passed its end; nothing is written over.

    Rows may come ``lateness`` after later ones; what comes for a window already written is
    dropped and counted by the query's progress. Windows that are open when the stream ends
    stay in its state until more comes: ``stream_usage`` shows them as they stand.
    """
    return (
        usage_windows(usage, width, lateness)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "sha256",
    at: str = "arrived_at",
    within: str = "30 days",
) -> StreamingQuery:
    """The first arrival of every ``key``; a copy up to ``within`` after it is dropped.

    ``at`` is the arrival time. A key leaves the state when the watermark is ``within`` past
    its first arrival, so the state holds the keys of that span and no more; a copy that
    comes later counts as new, as the intake's own check against stored versions decides.
    """
    timed = texts.withColumn("_at", F.timestamp_micros(epoch_micros(texts, at)))
    return (
        timed.withWatermark("_at", within)
        .dropDuplicatesWithinWatermark([key])
        .drop("_at")
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_job_state(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Newest state per job, as a table of one row per job.

    ``changes``: ``job_id, state, changed_at, change_id``, in any order. The newest change of
    each job is the stream's state; what a batch changes is put into a table of key buckets,
    of which other buckets stay as they are. A repeated batch changes nothing. Read the result
    with ``current_job_state``.
    """
    newest = changes.groupBy("job_id").agg(F.max(F.struct("changed_at", "change_id", "state")).alias("_row"))

    def batch(df: DataFrame, epoch: int) -> None:
        upsert_buckets(df, path, ["job_id"], ["changed_at", "change_id"], buckets)

    return (
        newest.select("job_id", "_row.*")
        .writeStream.outputMode("update")
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_job_state(spark: SparkSession, path: str) -> DataFrame:
    return read_buckets(spark, path).select("job_id", "state", "changed_at", "change_id")
