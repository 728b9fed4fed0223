"""Raw attempts, of which refused ones leave no record, against a plain replay."""

import random
from datetime import datetime, timedelta

import pytest

from clauselake.operators import raw_attempts as A

SCHEMA = "attempt_id long, identifier string, ip string, success boolean, created_at timestamp_ntz"
START = datetime(2024, 1, 1)


def replay(rows, seconds, per_identifier, per_address):
    log, out = [], set()
    for i, identifier, ip, success, at in sorted(rows, key=lambda r: (r[4], r[0])):
        recent = [r for r in log if r[2] > at - timedelta(seconds=seconds)]
        of_ip = sum(r[1] == ip for r in recent)
        of_identifier = sum(r[0] == identifier for r in recent)
        verdict = "allowed"
        if of_ip >= per_address:
            verdict = "locked_address"
        elif of_identifier >= per_identifier:
            verdict = "locked_identifier"
        elif not success:
            log.append((identifier, ip, at))
        out.add((i, of_ip, of_identifier, verdict, verdict == "allowed"))
    return out


def verdicts(spark, rows, *limits):
    got = A.raw_lockouts(spark.createDataFrame(rows, SCHEMA), *limits).collect()
    assert len(got) == len(rows) and {(r.attempt_id, r.success) for r in got} == {(r[0], r[3]) for r in rows}
    return {(r.attempt_id, r.address_failures, r.identifier_failures, r.verdict, r.recorded) for r in got}


def test_five_are_counted_and_the_right_code_is_refused_too(spark):
    rows = [(i, "a@x.org", "testclient", i == 8, START + timedelta(seconds=i)) for i in range(9)]
    got = {r[0]: r[2:] for r in verdicts(spark, rows)}
    assert got == {i: (min(i, 5), "allowed" if i < 5 else "locked_identifier", i < 5) for i in range(9)}


def test_lock_ends_when_recorded_failures_are_old(spark):
    """Refused calls do not prolong a lock: it opens a window after the first recorded failure."""
    rows = [(i, "a", f"ip{i}", False, START + timedelta(minutes=i)) for i in range(40)]
    allowed = sorted(i for i, *_, recorded in verdicts(spark, rows) if recorded)
    assert allowed == [*range(5), *range(15, 20), *range(30, 35)]


def test_one_address_locks_fresh_identifiers(spark):
    rows = [(i, f"challenge:{i}", "ip", False, START + timedelta(seconds=i)) for i in range(17)]
    got = {r[0]: r[3] for r in verdicts(spark, rows)}
    assert got == {i: "allowed" if i < 15 else "locked_address" for i in range(17)}


@pytest.mark.parametrize("seed", range(4))
def test_any_log_equals_its_replay(spark, seed):
    rng = random.Random(seed)
    names, addresses, span = [(3, 2, 4000), (12, 3, 3000), (4, 30, 20_000), (40, 6, 2000)][seed]
    rows = []
    for i in rng.sample(range(10_000), 700):
        hot = rng.random() < 0.3
        rows.append((
            i,
            rng.choice([None, *(f"u{k}" for k in range(names))]),
            "hot" if hot else rng.choice([None, *(f"ip{k}" for k in range(addresses))]),
            rng.choice([True, False, False, None]),
            START + timedelta(seconds=rng.randint(0, span)),
        ))
    assert verdicts(spark, rows, 300, 3, 5) == replay(rows, 300, 3, 5)


def test_empty_log(spark):
    assert A.raw_lockouts(spark.createDataFrame([], SCHEMA)).count() == 0
