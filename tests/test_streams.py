"""Arrival in any order gives what the batch operators give."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clauselake.operators import access as A
from clauselake.streaming import streams as S

ATTEMPTS = "attempt_id long, identifier string, ip string, success boolean, created_at timestamp_ntz"
START = datetime(2024, 1, 1)


def _source(spark, folder, schema, batches):
    """A stream that reads one file per batch, in the given order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        for name in os.listdir(f"{folder}/in/{i}"):
            os.utime(f"{folder}/in/{i}/{name}", (1_700_000_000 + i * 100,) * 2)
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(f"{folder}/in")
    )


def _stream_verdicts(spark, folder, batches, lateness, seconds=900, per_identifier=5, per_address=15):
    stream = _source(spark, folder, ATTEMPTS, batches)
    query = S.stream_lockouts(stream, f"{folder}/out", f"{folder}/cp", seconds, lateness)
    query.awaitTermination()
    got = S.verdicts(spark, f"{folder}/out", per_identifier, per_address).collect()
    return {(r.attempt_id, r.identifier_failures, r.address_failures, r.verdict) for r in got}, query


def test_lockouts_of_late_attempts(spark, tmp_path):
    """Attempts that come up to the lateness after later ones count as if they had come in order."""
    rng = random.Random(3)
    rows = [
        (
            i,
            rng.choice([None, "u0", "u1", "u2"]),
            f"ip{rng.randint(0, 1)}",
            rng.choice([True, False, False, False, None]),
            START + timedelta(seconds=rng.randint(0, 3600)),
        )
        for i in range(160)
    ]
    want = {
        (r.attempt_id, r.identifier_failures, r.address_failures, r.verdict)
        for r in A.lockouts(spark.createDataFrame(rows, ATTEMPTS), 900, 5, 15).collect()
    }
    # each comes up to five minutes after its time, and a last one lets the others through
    rows.sort(key=lambda r: r[4] + timedelta(seconds=rng.randint(0, 300)))
    batches = [rows[k : k + 20] for k in range(0, 160, 20)]
    batches.append([(1000, "end", "end", True, START + timedelta(days=1))])
    got, _ = _stream_verdicts(spark, tmp_path, batches, "5 minutes")
    assert got == want and len({r[3] for r in want}) == 3


def test_lockouts_too_late_are_dropped(spark, tmp_path):
    rows = [(i, "u", "ip", False, START + timedelta(minutes=i)) for i in range(9)]
    got, _ = _stream_verdicts(spark, tmp_path, [rows[2:8], rows[8:], rows[:2]], "0 seconds")
    assert {r[0]: r[1] for r in got} == {i: i - 2 for i in range(2, 9)}


def test_state_of_lockouts_stays_flat(spark, tmp_path):
    """The same ten keys an hour a batch: a batch leaves no more than one window behind."""
    batches = [
        [
            (b * 100 + i, f"u{i % 5}", f"ip{i % 5}", False, START + timedelta(hours=b, seconds=i))
            for i in range(40)
        ]
        for b in range(12)
    ]
    got, query = _stream_verdicts(spark, tmp_path, batches, "0 seconds")
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(got) == 480 and len(rows) >= 12 and max(rows[6:]) <= max(rows[1:6])


def test_usage_keeps_open_windows(spark, tmp_path):
    schema = "user_id long, status string, input_tokens long, created_at timestamp_ntz"
    day = lambda d, h: datetime(2024, 1, d, h)
    batches = [
        [(1, "ok", 5, day(1, 3)), (1, "failed", None, day(1, 4))],
        [(1, "ok", 7, day(1, 20)), (2, "ok", 1, day(2, 1))],
        [(2, "ok", 2, day(2, 2))],
    ]
    stream = _source(spark, tmp_path, schema, batches)
    S.stream_usage(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in S.current_usage(spark, str(tmp_path / "out")).collect())
    assert got == [(day(1, 0), 1, 3, 1, 12), (day(2, 0), 2, 2, 0, 3)]


def test_job_state_is_the_newest_change(spark, tmp_path):
    """Changes in and out of order; jobs that a batch leaves alone keep their files."""
    schema = "job_id long, state string, changed_at timestamp_ntz, change_id long"
    batches = [
        [(j, f"s{b}", START + timedelta(hours=b if j % 2 else -b), b * 10 + j) for j in range(3)] for b in range(5)
    ]
    batches.append([(7, "only", START, 1), (7, "same instant", START, 2)])
    stream = _source(spark, tmp_path, schema, batches)
    out = str(tmp_path / "out")
    S.stream_job_state(stream, out, str(tmp_path / "cp"), buckets=16).awaitTermination()
    got = {r.job_id: r.state for r in S.current_job_state(spark, out).collect()}
    assert got == {0: "s0", 1: "s4", 2: "s0", 7: "same instant"}
    files = [f for folder, _, names in os.walk(out) for f in names if f.startswith("part-")]
    assert len(files) <= 4


def test_final_usage_is_written_once(spark, tmp_path):
    schema = "user_id long, status string, input_tokens long, created_at timestamp_ntz"
    at = lambda d, h: datetime(2024, 1, d, h)
    batches = [
        [(1, "ok", 5, at(1, 3)), (2, "failed", None, at(1, 4))],
        [(1, "ok", 7, at(2, 0))],  # the first day's end, but not an hour past it
        [(1, "ok", 9, at(1, 23))],  # late, and in time
        [(1, "ok", 1, at(2, 5))],
        [(1, "ok", 1, at(3, 5))],
        [(1, "ok", 1000, at(1, 5)), (1, "ok", 2, at(3, 6))],  # too late
        [(1, "ok", 3, at(9, 0))],
    ]
    stream = _source(spark, tmp_path, schema, batches)
    query = S.stream_final_usage(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(at(1, 0), 1, 2, 0, 14), (at(1, 0), 2, 1, 1, None), (at(2, 0), 1, 2, 0, 8), (at(3, 0), 1, 2, 0, 3)]
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert late == 1


def test_dedupe_across_batches(spark, tmp_path):
    """Copies within the span are dropped; afterwards the key is out of the state."""
    schema = "sha256 string, arrived_at timestamp_ntz"
    day = lambda d: START + timedelta(days=d)
    batches = [
        [("a", day(0)), ("b", day(0))],
        [("a", day(5)), ("c", day(5)), ("c", day(6))],
        [("b", day(29))],
        *[[(f"x{k}", day(40 + 40 * k))] for k in range(4)],
        [("a", day(160))],
    ]
    stream = _source(spark, tmp_path, schema, batches)
    query = S.stream_dedupe(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.sha256 for r in got) == ["a", "a", "b", "c", "x0", "x1", "x2", "x3"]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 5 and held[-1] == 3  # of eight keys


def test_stream_of_a_table_in_one_file_or_many(spark, tmp_path):
    """A table is a file or a folder of files; other tables beside it are not read."""
    from clauselake.plans import stream_queries as Q

    rows = [(1, "a\n\nb"), (2, "mail x1@example.org"), (3, "a\n\nb"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many, one = tmp_path / "many", tmp_path / "one"
    docs.repartition(3).write.parquet(f"{many}/documents.parquet")
    docs.limit(1).write.parquet(f"{many}/documents.parquet.old")
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    part = next(p for p in (tmp_path / "part").iterdir() if p.name.startswith("part-"))
    one.mkdir()
    (one / "documents.parquet").write_bytes(part.read_bytes())
    for folder in (many, one):
        for name, count in (("stream_dedupe", 3), ("stream_segment_redact", 5)):
            got = Q.QUERIES[name](spark, str(folder)).collect()
            assert len(got) == count, (folder, name, got)
    found = Q.QUERIES["stream_segment_redact"](spark, str(many)).collect()
    assert sorted({r.version_id for r in found}) == [1, 2, 3]
