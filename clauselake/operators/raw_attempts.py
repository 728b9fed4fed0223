"""Verdicts on raw login attempts, of which refused ones leave no record.

A refused call is not counted later, so a verdict depends on the verdicts before it, and
as an attempt counts for its address and its identifier, the two limits interact. What has
to be decided in order is little, though:

1. All failures of the window, recorded or not, are at least as many as the recorded ones.
   An attempt for which both counts stay below the limits is allowed for certain.
2. The other failures are open. An open one depends on earlier open failures of a key only
   within one window, so each key's open failures fall into stretches of time, and only
   stretches in which the key's own limit can be met matter. Stretches that share an open
   failure form an island; islands do not depend on each other.
3. An island is one ordered fold over its open failures and the certain ones that they
   count. The rows stream through; held are the recorded times of one window, at most as
   many as the limit for each key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.graph import components
from clauselake.functions.running import epoch_micros
from clauselake.operators.access import failed_attempts_window, lockouts
from clauselake.session import stored

_KEYS = ("ip", "identifier")


def _failures(attempts: DataFrame, seconds: int, per_identifier: int, per_address: int) -> DataFrame:
    """Failures with their time in microseconds, whether they are open, and for which keys."""
    rows = attempts.select("attempt_id", "created_at", "success", *_KEYS)
    most = failed_attempts_window(rows, {"ip": "_of_ip", "identifier": "_of_identifier"}, seconds, True)
    met = {"ip": F.col("_of_ip") >= per_address, "identifier": F.col("_of_identifier") >= per_identifier}
    keys = [
        F.struct(
            F.lit(c).alias("kind"),
            # a missing key is a key like any other
            F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("value"),
            met[c].alias("met"),
        )
        for c in _KEYS
    ]
    return stored(
        most.filter(~F.coalesce("success", F.lit(False))).select(
            "attempt_id",
            epoch_micros(attempts, "created_at").alias("t"),
            (met["ip"] | met["identifier"]).alias("open"),
            F.inline(F.array(*keys)),
        ),
        "failures",
    )


def _stretches(failures: DataFrame, width: int) -> DataFrame:
    """``kind, value, bucket, stretch, own`` of the buckets of each stretch and the one before it.

    Time is cut into buckets of one window. A stretch is a run of buckets that hold open
    failures of the key, in one of which at least its limit can be met.
    """
    bucket = F.floor(F.col("t") / width)
    held = failures.filter("open").groupBy("kind", "value", bucket.alias("bucket")).agg(F.max("met").alias("met"))
    of_key = Window.partitionBy("kind", "value")
    run = F.col("bucket") - F.row_number().over(of_key.orderBy("bucket"))
    of_run = Window.partitionBy("kind", "value", "_run")
    runs = (
        held.withColumn("_run", run)
        .withColumns({"met": F.max("met").over(of_run), "first": F.min("bucket").over(of_run)})
        .filter("met")
    )
    place = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    before = F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(False).alias("own"))
    return runs.select(
        "kind",
        "value",
        F.concat_ws(":", "kind", "first", "value").alias("stretch"),
        F.inline(F.when(F.col("bucket") == F.col("first"), F.array(place, before)).otherwise(F.array(place))),
    )


def _refusals(width: int, limits: dict[str, int]):
    """Fold the rows of one island after the other; gives the attempts that are refused."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island = None
        held: dict[str, deque] = {}
        seen = 0
        for batch in batches:
            refused = []
            columns = [batch.column(c).to_pylist() for c in ("island", "t", "attempt_id", "open", *_KEYS)]
            for own, t, attempt, open_, ip, identifier in zip(*columns, strict=True):
                if own != island:
                    island, held = own, {}
                seen += 1
                if seen % 65_536 == 0:  # keys whose failures are all out of the window
                    held = {k: times for k, times in held.items() if times and times[-1] > t - width}
                touched = []
                locked = False
                for kind, key in (("ip", ip), ("identifier", identifier)):
                    if key is None:
                        continue
                    times = held.setdefault(key, deque())
                    while times and times[0] <= t - width:
                        times.popleft()
                    locked = locked or len(times) >= limits[kind]
                    touched.append(times)
                if open_ and locked:
                    refused.append(attempt)
                    continue
                for times in touched:
                    times.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(refused, batch.schema.field("attempt_id").type)], names=["attempt_id"]
            )

    return fold


def refused_failures(
    attempts: DataFrame,
    seconds: int = K.LOCKOUT_WINDOW_SECONDS,
    per_identifier: int = K.LOCKOUT_PER_IDENTIFIER,
    per_address: int = K.LOCKOUT_PER_ADDRESS,
) -> DataFrame:
    """``attempt_id`` of the failed attempts that a limit refuses."""
    width = seconds * 1_000_000
    failures = _failures(attempts, seconds, per_identifier, per_address)
    stretches = stored(_stretches(failures, width), "stretches")
    placed = stored(
        failures.withColumn("bucket", F.floor(F.col("t") / width))
        .join(stretches, ["kind", "value", "bucket"])
        .filter("own OR NOT open")
        .select("attempt_id", "t", "open", "kind", "stretch"),
        "placed",
    )
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("stretch"))).alias(kind)
    open_ = placed.filter("open").groupBy("attempt_id", "t", "open").agg(*[of(k) for k in _KEYS])
    shared = open_.select(F.col("ip").alias("a"), F.col("identifier").alias("b")).dropna()
    islands = components(shared).toDF("stretch", "_island")
    certain = placed.filter("NOT open").select(
        "attempt_id",
        "t",
        "open",
        *[F.when(F.col("kind") == k, F.col("stretch")).alias(k) for k in _KEYS],
    )
    rows = open_.union(certain).withColumn("stretch", F.coalesce(*_KEYS))
    dealt = (
        rows.join(islands, "stretch", "left")
        .withColumn("island", F.coalesce("_island", "stretch"))
        .select("island", "t", "attempt_id", "open", *_KEYS)
        .repartition("island")
        .sortWithinPartitions("island", "t", "attempt_id")
    )
    kind = attempts.schema["attempt_id"].dataType.simpleString()
    return dealt.mapInArrow(
        _refusals(width, {"ip": per_address, "identifier": per_identifier}), f"attempt_id {kind}"
    )


def raw_lockouts(
    attempts: DataFrame,
    seconds: int = K.LOCKOUT_WINDOW_SECONDS,
    per_identifier: int = K.LOCKOUT_PER_IDENTIFIER,
    per_address: int = K.LOCKOUT_PER_ADDRESS,
) -> DataFrame:
    """Verdict per raw attempt, and whether it was recorded.

    ``attempts``: ``attempt_id`` (unique; it orders attempts of one instant), ``created_at,
    identifier, ip, success``, where ``success`` says that the code was right. Counted are
    the recorded failures of the window before the attempt; a locked attempt is refused,
    right code or not, and leaves no record. A missing ``success`` is a failure. Columns are
    those of ``lockouts`` and ``recorded``.
    """
    refused = refused_failures(attempts, seconds, per_identifier, per_address).withColumn(
        "_refused", F.lit(True)
    )
    marked = attempts.join(refused, "attempt_id", "left").withColumns(
        {"_right": F.col("success"), "success": F.coalesce("_refused", "success")}
    )
    judged = lockouts(marked.drop("_refused"), seconds, per_identifier, per_address)
    return judged.withColumns(
        {"success": F.col("_right"), "recorded": F.col("verdict") == "allowed"}
    ).drop("_right")
