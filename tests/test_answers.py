import json

from clauselake.operators import answers as M
from clauselake.operators import quality as Q

RESPONSE = "request_id int, attempt int, content string, input_tokens int, output_tokens int, model string, error string, domain string"
GOOD = json.dumps({"finding_type": "Absent", "severity": "high"})


def _findings(spark, contents):
    df = spark.createDataFrame(list(enumerate(contents)), "request_id int, content string")
    return M.parse_finding(M.extract_json(df)).orderBy("request_id").collect()


def test_json_cascade(spark):
    contents = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so {"a": 3} done', "nothing", '{"a": 1} {"b": 2}', "", None]
    rows = _findings(spark, contents)
    assert [r.parse_status for r in rows] == ["ok", "ok", "ok"] + ["failed"] * 4


def test_outside_the_vocabulary_is_failed_not_coerced(spark):
    bodies = [
        {"finding_type": "absent", "severity": "info"},
        {"finding_type": "weird", "severity": "info"},
        {"severity": "info"},
        {"finding_type": "absent", "severity": "urgent"},
        [1, 2],
    ]
    rows = _findings(spark, [json.dumps(b) for b in bodies])
    assert [(r.finding_status, r.finding_type) for r in rows] == [("ok", "absent")] + [("failed", None)] * 4


def _materiality(spark, content, expected):
    df = spark.createDataFrame([(1, content, expected)], "batch_id int, content string, expected int")
    return [(r.materiality, r.status) for r in M.parse_materiality(df).orderBy("place").collect()]


def test_materiality_counts_by_position(spark):
    item = lambda m: {"index": 5, "materiality": m}
    body = lambda *items: json.dumps({"changes": list(items)})
    failed = (None, "failed")
    assert _materiality(spark, body(item("Material")), 1) == [("material", "ok")]
    assert _materiality(spark, body(item("perhaps")), 1) == [failed]
    assert _materiality(spark, body({"index": 1}), 1) == [failed]
    assert _materiality(spark, body(item("immaterial")), 3) == [("immaterial", "ok"), failed, failed]
    assert _materiality(spark, "garbage", 2) == [failed, failed]
    assert _materiality(spark, json.dumps([item("material"), item("material")]), 1) == [("material", "ok")]


def test_failed_always_goes_with_null(spark):
    rows = [(c, s) for c in ("material", "immaterial", None, "odd") for s in ("ok", "low_confidence", "failed", None)]
    df = spark.createDataFrame(rows, "materiality string, classification_status string")
    bad = {tuple(r) for r in Q.joint_state_audit(df).collect()}
    honest = {(None, "failed")} | {(c, s) for c in ("material", "immaterial") for s in ("ok", "low_confidence")}
    assert bad == set(rows) - honest


def test_retry_and_metering(spark):
    rows = [
        (1, 1, GOOD, 5, 1, "m", None, "d"),
        (2, 1, "junk", 6, 1, "m", None, "d"), (2, 2, GOOD, 7, 1, "m", None, "d"),
        (3, 1, None, 8, 1, "m", "down", "d"), (3, 2, GOOD, 9, 1, "m", None, "d"),
        (4, 1, "junk", 1, 1, "m", None, "d"), (4, 2, "junk", 2, 1, "m", None, "d"), (4, 3, GOOD, 3, 1, "m", None, "d"),
    ]
    df = spark.createDataFrame(rows, RESPONSE)
    got = {r.request_id: (r.status, r.attempts, r.winner, r.failure) for r in M.resolve_attempts(df).collect()}
    assert got == {1: ("ok", 1, 1, None), 2: ("ok", 2, 2, None), 3: ("failed", 1, None, "call"), 4: ("failed", 2, None, "parse")}
    usage = {(r.request_id, r.attempt): (r.input_tokens, r.status, r.failure_stage) for r in M.meter_attempts(df).collect()}
    assert usage == {
        (1, 1): (5, "ok", None), (2, 1): (6, "failed", "json_parse:d"), (2, 2): (7, "ok", None),
        (3, 1): (None, "failed", "llm_call:d"), (3, 2): (9, "surplus", None), (4, 3): (3, "surplus", None), (4, 1): (1, "failed", "json_parse:d"), (4, 2): (2, "failed", "json_parse:d"),
    }


def test_failed_batch_calls_have_no_tokens(spark):
    df = spark.createDataFrame(
        [(1, 5, 6, "m", None), (2, 7, 8, "m", "down")],
        "batch_id int, input_tokens int, output_tokens int, model string, error string",
    )
    got = {r.batch_id: (r.input_tokens, r.status, r.failure_stage) for r in M.meter_batches(df).collect()}
    assert got == {1: (5, "ok", None), 2: (None, "failed", "materiality_llm")}


def test_summary_states(spark):
    rows = [(1, 0, None, "down"), (2, 3, None, "down"), (3, 3, '{"ringkasan": "r"}', None), (4, 3, "[1]", None)]
    df = spark.createDataFrame(rows, "version_id int, n_clauses int, content string, error string")
    got = {r.version_id: (r.summary, r.summary_status) for r in M.summary_outcome(df).collect()}
    assert got[1][0] and got[1][1] == "ok"
    assert got[2] == (None, "failed") and got[3] == ("r", "ok") and got[4] == (None, "failed")


def test_coverage_floor(spark):
    rows = [(1, "docx", "x" * 51, 60000, None, None), (2, "docx", "x" * 600, 1000, None, None), (3, "pdf_text", "", 0, 2, None),
            (4, "image", "x", 0, None, 100), (5, "image", "", 0, None, 100)]
    df = spark.createDataFrame(rows, "version_id int, source_format string, text string, available_chars long, pages int, bytes long")
    got = {r.version_id: (r.coverage, r.extraction_ok) for r in Q.coverage_gate(df).collect()}
    assert got == {1: ("partial", False), 2: ("ok", True), 3: ("needs_ocr", False), 4: ("ok", True), 5: ("empty", False)}


def test_unreadable_layer_is_not_an_empty_one(spark):
    rows = [(1, "docx", True, True, False), (2, "docx", False, True, True), (3, "pdf_text", True, None, None)]
    df = spark.createDataFrame(rows, "v int, source_format string, extraction_ok boolean, tc_readable boolean, comments_readable boolean")
    got = {r.v: (r.tc_parse_status, r.comments_parse_status) for r in Q.stage_status(df).collect()}
    assert got == {1: ("ok", "failed"), 2: (None, None), 3: (None, None)}


def test_metering_sends_no_table_through_the_driver(spark):
    """The retry rule joins two tables of a row per request: a shuffle at any size, answers parsed once."""
    df = spark.createDataFrame([(1, 1, "junk", 6, 1, "m", None, "d"), (None, 1, GOOD, 7, 1, "m", None, "d")], RESPONSE)
    out = M.meter_attempts(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "parse_json" not in plan
    assert [(r.request_id, r.status) for r in out.collect()] == [(1, "failed")]
