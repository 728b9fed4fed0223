"""Tenancy, sessions, login abuse and invites."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import epoch_micros, moment, running_total


def live_documents(documents: DataFrame) -> DataFrame:
    return documents.filter("deleted_at is null").select("document_id", "user_id")


def owned(child: DataFrame, owners: DataFrame, key: str, user_id=None) -> DataFrame:
    """Child rows whose parent is visible, with the owner attached.

    ``owners`` has one row per ``key`` with ``user_id``; chain the call for further
    hops (documents, versions, findings, edits). With ``user_id`` the filter is
    applied to the owners first, so the scan of the children is reduced by it.
    A batch that sees everything simply does not call this.
    """
    visible = owners.select(key, "user_id")
    if user_id is not None:
        visible = visible.filter(F.col("user_id") == user_id)
    return child.drop("user_id").join(visible, key)


def cross_tenant_audit(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose owner differs from the parent's, or that have no parent."""
    owner = parent.select(key, F.col("user_id").alias("parent_user_id"))
    joined = child.join(owner, key, "left")
    problem = F.when(F.col("parent_user_id").isNull(), "orphan").when(
        ~F.col("user_id").eqNullSafe(F.col("parent_user_id")), "foreign_owner"
    )
    return joined.withColumn("problem", problem).filter("problem is not null")


def valid_sessions(sessions: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    """Sessions that are not revoked and not expired, of active users."""
    open_sessions = sessions.filter(~F.col("revoked") & (F.col("expires_at") > moment(now)))
    return open_sessions.join(users.filter("is_active").select("user_id"), "user_id", "left_semi")


def failed_attempts_window(
    attempts: DataFrame, keys: dict[str, str], seconds: int, recorded_only_before: bool = False
) -> DataFrame:
    """Failures in the trailing window, per attempt and per key column.

    ``attempts``: ``attempt_id, created_at, success`` and the key columns; ``keys``
    maps a key column to the name of its count. Counted are failures strictly newer
    than ``created_at - seconds``, up to and including the attempt's time, or only
    those recorded before the attempt when ``recorded_only_before`` is set.

    A count over a window is the difference of two running totals, one read at the
    attempt and one at the window's start. Every attempt contributes its failure
    and two such readings per key; one distributed running total serves them all,
    so neither a busy address nor a busy quarter of an hour meets in one task.
    """
    micros = epoch_micros(attempts, "created_at")
    failure = F.when(F.col("success"), 0).otherwise(1)
    width = F.lit(seconds * 1_000_000).cast("bigint")
    last = F.lit(1 << 62).cast("bigint")
    # order inside one instant: (tie, step); an attempt's own failure comes at step 1
    attempt = F.col("attempt_id").cast("bigint")
    at_attempt = (micros, attempt, 0) if recorded_only_before else (micros, last, 2)

    def mark(place: tuple, amount: Column, sign: int) -> Column:
        t, tie, step = place
        return F.struct(
            t.alias("t"),
            tie.alias("tie"),
            F.lit(step).alias("step"),
            amount.alias("amount"),
            F.lit(sign).alias("sign"),
        )

    own, start = (micros, attempt, 1), (micros - width, last, 2)
    nothing = F.lit(0)
    marks = F.array(mark(own, failure, 0), mark(at_attempt, nothing, 1), mark(start, nothing, -1))
    key_rows = F.array(
        *[
            F.struct(F.lit(c).alias("key_name"), F.col(c).cast("string").alias("key_value"))
            for c in keys
        ]
    )
    placed = attempts.select("attempt_id", key_rows.alias("_k"), marks.alias("_m"))
    rows = placed.select("attempt_id", F.explode("_k").alias("_k"), "_m").select(
        "attempt_id", "_k.*", F.inline("_m")
    )
    totals = running_total(
        rows,
        ["key_name", "key_value"],
        ["t", "tie", "step", "attempt_id", "sign"],
        F.col("amount"),
        "_running",
    )
    counts = (
        totals.filter("sign <> 0")
        .groupBy("attempt_id")
        .agg(
            *[
                F.sum(F.when(F.col("key_name") == c, F.col("sign") * F.col("_running"))).alias(name)
                for c, name in keys.items()
            ]
        )
    )
    return attempts.join(counts, "attempt_id")


def lockouts(
    attempts: DataFrame,
    seconds: int = K.LOCKOUT_WINDOW_SECONDS,
    per_identifier: int = K.LOCKOUT_PER_IDENTIFIER,
    per_address: int = K.LOCKOUT_PER_ADDRESS,
) -> DataFrame:
    """Verdict per attempt on the recorded log: the address limit first, then the identifier's.

    Only failures recorded before the attempt count. The log holds recorded
    attempts; a refused call leaves no row in it.
    """
    counted = failed_attempts_window(
        attempts, {"ip": "address_failures", "identifier": "identifier_failures"}, seconds, True
    )
    return counted.withColumn("verdict", lockout_verdict(per_identifier, per_address))


def lockout_verdict(per_identifier: int, per_address: int) -> Column:
    return (
        F.when(F.col("address_failures") >= per_address, "locked_address")
        .when(F.col("identifier_failures") >= per_identifier, "locked_identifier")
        .otherwise("allowed")
    )


def attempt_identifier(attempts: DataFrame, challenges: DataFrame, users: DataFrame) -> DataFrame:
    """Lower-cased e-mail of the challenged user, or the challenge id when it does not resolve."""
    known = challenges.select("challenge_id", "user_id").join(
        users.select("user_id", "email"), "user_id"
    )
    joined = attempts.join(known.select("challenge_id", "email"), "challenge_id", "left")
    name = F.coalesce(
        F.lower("email"), F.concat(F.lit("challenge:"), F.col("challenge_id").cast("string"))
    )
    return joined.withColumn("identifier", name).drop("email")


def verify_outcomes(attempts: DataFrame, challenges: DataFrame, users: DataFrame) -> DataFrame:
    """First failing check per attempt: unknown, used, expired, wrong code, inactive; else ok.

    ``attempts``: ``attempt_id, challenge_id, otp, attempted_at``.
    """
    known = challenges.join(users.select("user_id", "is_active"), "user_id")
    known = known.withColumn("_known", F.lit(True)).drop("user_id")
    joined = attempts.join(known, "challenge_id", "left")
    result = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("used"), "used")
        .when(F.col("expires_at") < F.col("attempted_at"), "expired")
        .when(~F.col("otp_hash").eqNullSafe(F.sha2("otp", 256)), "wrong_code")
        .when(~F.col("is_active"), "inactive")
        .otherwise("ok")
    )
    return joined.select("attempt_id", "challenge_id", result.alias("result"))


def invite_status(invites: DataFrame) -> DataFrame:
    """Available or used; ``place`` numbers them from 1, the newest first, ties by code.

    The order is a column: a sort would be lost in the next step. Places come from running
    totals over ranges of rows, so no task holds all invites.
    """
    state = F.when(F.col("redeemed_at").isNull(), "available").otherwise("used")
    keyed = invites.withColumns(
        {"status": state, "_newest": -epoch_micros(invites, "created_at"), "_all": F.lit(0)}
    )
    return running_total(keyed, ["_all"], ["_newest", "code"], F.lit(1), "place").drop("_newest", "_all")


def redeem_check(requests: DataFrame, invites: DataFrame, users: DataFrame) -> DataFrame:
    """Answer to each redemption: invalid code, other e-mail, already registered, or ok."""
    unused = invites.filter("redeemed_at is null").select(
        "code", F.lower("email").alias("_bound"), F.lit(True).alias("_valid")
    )
    known = users.select(F.lower("email").alias("_email"), F.lit(True).alias("_registered")).distinct()
    rows = requests.withColumn("_email", F.lower("email"))
    joined = rows.join(unused, "code", "left").join(known, "_email", "left")
    other = F.coalesce(F.col("_bound"), F.lit("")) != ""
    result = (
        F.when(F.col("_valid").isNull(), "invalid_code")
        .when(other & (F.col("_bound") != F.col("_email")), "wrong_email")
        .when(F.col("_registered"), "already_registered")
        .otherwise("ok")
    )
    return joined.select(*requests.columns, result.alias("result"))
