"""Counts and totals that must hold when one key has most of the rows."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from clauselake.functions.running import latest, running_total
from clauselake.operators import access as A
from clauselake.operators import jobs as J
from clauselake.sources import storage as S
from clauselake.sources import writes as W
from clauselake.streaming import streams

START = dt.datetime(2024, 1, 1)
ATTEMPT = "attempt_id long, identifier string, ip string, success boolean, created_at timestamp_ntz"


def test_running_total_with_a_hot_and_a_missing_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(7)
    want, total = {}, collections.Counter()
    for k, i, x in rows:
        total[k] += x
        want[i] = total[k]
    out = running_total(df, ["k"], ["i"], F.col("x"), "t")
    assert {r.i: r.t for r in out.collect()} == want


def test_latest_breaks_ties_by_the_whole_order(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {tuple(r) for r in latest(df, ["k"], ["t", "v"]).collect()} == {(1, 5, "b"), (2, 1, "c")}


def _attempts(spark, rows):
    return spark.createDataFrame(
        [(i, who, ip, ok, START + dt.timedelta(seconds=s)) for i, (who, ip, ok, s) in enumerate(rows)], ATTEMPT
    )


def test_five_wrong_codes_then_locked(spark):
    rows = [("a", f"ip{i}", False, i) for i in range(8)]
    got = A.lockouts(_attempts(spark, rows)).orderBy("attempt_id").collect()
    assert [r.verdict for r in got] == ["allowed"] * 5 + ["locked_identifier"] * 3


def test_old_failures_do_not_count(spark):
    rows = [("a", "ip", False, i) for i in range(5)] + [("a", "ip", False, 16 * 60 + 5)]
    got = A.lockouts(_attempts(spark, rows)).orderBy("attempt_id").collect()
    assert got[-1].verdict == "allowed"


def test_window_is_strictly_newer(spark):
    rows = [("a", "ip", False, 0), ("a", "ip", False, 900)]
    got = A.failed_attempts_window(_attempts(spark, rows), {"ip": "n"}, 900).orderBy("attempt_id").collect()
    assert [r.n for r in got] == [1, 1]


def test_address_limit_over_many_identifiers(spark):
    rows = [(f"u{i}", "ip", False, i) for i in range(17)]
    got = A.lockouts(_attempts(spark, rows)).orderBy("attempt_id").collect()
    assert [r.verdict for r in got][-3:] == ["allowed", "locked_address", "locked_address"]


def test_rolling_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.choice(["x", "x", "y", None]), rng.random() < 0.3, rng.randint(0, 4000)) for _ in range(300)]
    df = _attempts(spark, rows)
    got = A.failed_attempts_window(df, {"identifier": "n", "ip": "m"}, 900).collect()
    for r in got:
        who, ip, _, s = rows[r.attempt_id]
        inside = [x for x in rows if not x[2] and s - 900 < x[3] <= s]
        assert r.n == sum(x[0] == who for x in inside)
        assert r.m == sum(x[1] == ip for x in inside)


def test_stream_lockouts_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted(((rng.choice("ab"), rng.choice("xy"), rng.random() < 0.2, i * 40) for i in range(120)), key=lambda r: r[3])
    df = _attempts(spark, rows)
    source = str(tmp_path / "in")
    for part in range(3):
        df.filter(F.floor(F.col("attempt_id") / 40) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_lockouts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.attempt_id: r.verdict for r in streams.verdicts(spark, str(tmp_path / "out")).collect()}
    assert got == {r.attempt_id: r.verdict for r in A.lockouts(df).collect()}


def test_stream_job_state_keeps_the_newest(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "job_id int, state string, changed_at timestamp_ntz, change_id int"
    for batch in ([(1, "queued", START, 1), (2, "queued", START, 2)], [(1, "done", START, 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_job_state(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = streams.current_job_state(spark, str(tmp_path / "out")).collect()
    assert {(r.job_id, r.state) for r in rows} == {(1, "done"), (2, "queued")}


def test_slices_on_disk_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    W.write_slices(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "v int, x string"), path, ["v"])
    W.write_slices(spark.createDataFrame([(1, "z")], "v int, x string"), path, ["v"])
    assert {(r.v, r.x) for r in spark.read.parquet(path).collect()} == {(1, "z"), (2, "c")}


def test_keys_cannot_leave_the_root(spark):
    df = spark.createDataFrame([("documents/7/../../../etc/passwd", 7), ("documents/8/d/v1/f", 7), ("x/7/d/f", 7)], "storage_key string, user_id int")
    got = [(r.path, r.verdict) for r in S.parse_storage_key(df).collect()]
    assert got == [("documents/7/etc/passwd", "ok"), ("documents/8/d/v1/f", "denied"), ("x/7/d/f", "invalid")]


def test_only_a_failed_newest_job_is_carried(spark):
    schema = "job_id int, version_id int, state string, created_at timestamp_ntz"
    day = lambda n: START + dt.timedelta(days=n)
    jobs = spark.createDataFrame([(1, 1, "failed", day(1)), (2, 1, "queued", day(2)), (3, 2, "failed", day(1)), (4, 2, "done", day(2)), (5, 2, "queued", day(3))], schema)
    runs = spark.createDataFrame([(1, "a", "ok"), (1, "b", "failed"), (3, "a", "ok"), (4, "a", "ok")], "job_id int, domain_key string, status string")
    got = J.carry_forward(jobs.filter("state = 'queued'"), jobs, runs).collect()
    assert [(r.job_id, r.prior_job_id, r.domain_key) for r in got] == [(2, 1, "a")]
