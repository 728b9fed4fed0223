"""Nothing is cut away: what does not fit goes into further parts."""

from pyspark.sql import functions as F

from clauselake.operators import answers as M
from clauselake.operators import findings as Q
from clauselake.operators import jobs as J
from clauselake.operators import retention as T
from clauselake.operators import route as D
from clauselake.sources.lexicon import lexicon_from_rows

CLAUSES = "version_id int, ordinal int, heading_path string, text string"
LEXICON = lexicon_from_rows([("exclusivity", "pay"), ("non_compete", "absent-word")])


def _clauses(spark, texts):
    return spark.createDataFrame([(1, i + 1, None, t) for i, t in enumerate(texts)], CLAUSES)


def test_context_parts_hold_every_clause(spark):
    texts = ["pay " * n for n in (3, 10, 1, 40, 2, 2, 60, 5)]
    clauses = _clauses(spark, texts)
    rows = D.pack_context(D.route_clauses(clauses, LEXICON), clauses, max_chars=100).collect()
    for domain in ("exclusivity", "non_compete"):
        parts = sorted((r.part_no, r) for r in rows if r.domain == domain)
        assert [p for p, _ in parts] == list(range(1, len(parts) + 1))
        entries = "\n\n".join(r.context for _, r in parts).split("\n\n")
        assert entries == [f"[Klausul {i + 1}]\n{t}" for i, t in enumerate(texts)]
        for _, r in parts:
            assert r.oversized == (len(r.context) - 2 * (r.entries - 1) > 100)
            assert r.entries == 1 or not r.oversized


def test_an_absent_domain_stands_for_all_clauses(spark):
    routed = D.route_clauses(_clauses(spark, ["we pay", "other"]), LEXICON).collect()
    assert sorted((r.domain, r.ordinal, r.matched) for r in routed if r.matched) == [("exclusivity", 1, True)]
    assert [(r.domain, r.ordinal) for r in routed if not r.matched] == [("non_compete", None)]


def test_sample_parts_join_to_the_whole_text(spark):
    texts = ["a" * 7, "", "b" * 50, "c"]
    rows = D.summary_sample(_clauses(spark, texts), max_chars=20).orderBy("part_no").collect()
    whole = "".join(f"[Klausul {i + 1}] {t}\n" for i, t in enumerate(texts))
    assert "".join(r.sample for r in rows) == whole
    assert all(len(r.sample) == 20 for r in rows[:-1])


def test_comment_parts_share_their_tokens(spark):
    schema = "version_id int, ordinal int, author string, body string, anchor_text string"
    rows = [(1, i, "x", f"mail a{i % 2}@b.org", "t" * 300) for i in range(5)]
    parts = D.pack_comments(spark.createDataFrame(rows, schema), limit=2).orderBy("part_no").collect()
    assert [r.n_comments for r in parts] == [2, 2, 1]
    lines = "\n".join(r.comments for r in parts).split("\n")
    assert [("[EMAIL_1]" in x, "[EMAIL_2]" in x, "t" * 300 in x) for x in lines] == [
        (i % 2 == 0, i % 2 == 1, True) for i in range(5)
    ]


def test_requests_cover_context_and_comment_parts(spark):
    clauses = _clauses(spark, ["pay " * 30, "pay " * 30])
    versions = spark.createDataFrame([(1,), (2,)], "version_id int")
    none = spark.createDataFrame([], "version_id int, summary string")
    notes = spark.createDataFrame(
        [(1, i, None, f"note {i}", None) for i in range(3)],
        "version_id int, ordinal int, author string, body string, anchor_text string",
    )
    contexts = D.pack_context(D.route_clauses(clauses, LEXICON), clauses, max_chars=150)
    requests = D.build_requests(versions, LEXICON, contexts, none, D.pack_comments(notes, limit=1))
    got = {(r.version_id, r.domain, r.part_no): r.request for r in requests.collect()}
    assert sorted(k[2] for k in got if k[:2] == (1, "exclusivity")) == [1, 2, 3]
    assert [k for k in got if k[0] == 2] and all(k[2] == 1 for k in got if k[0] == 2)
    assert "note 2" in got[1, "exclusivity", 3] and "[Klausul" not in got[1, "exclusivity", 3]


def test_error_digest_is_whole_unless_asked(spark):
    runs = spark.createDataFrame(
        [(1, f"d{i:02}", "failed", "e" * 300, i) for i in range(18)],
        "job_id int, domain_key string, status string, error string, created_at int",
    )
    whole = J.error_digest(runs).first().error_message
    assert whole.count("e" * 300) == 18
    assert J.error_digest(runs, lines=3).first().error_message.count("e" * 300) == 3
    assert len(J.error_digest(runs, chars=50).first().error_message) == 50
    assert [r.place for r in J.error_lines(runs).orderBy("domain_key").collect()] == list(range(1, 19))


def _responses(spark, rows):
    schema = (
        "request_id int, attempt int, content string, input_tokens int, output_tokens int,"
        " model string, error string, domain string"
    )
    return spark.createDataFrame(rows, schema)


def test_odd_json_shapes(spark):
    shapes = ["5],[", "[1]", '"x"', "1, 2", '{"a": 1} tail', "]", "null", '{"a": 1}, "#end"', '5,"#end"],[1']
    rows = _responses(spark, [(i, 1, s, 1, 1, "m", None, "d") for i, s in enumerate(shapes)])
    got = {r.request_id: r.parse_status for r in M.extract_json(rows).collect()}
    assert got == {0: "failed", 1: "ok", 2: "ok", 3: "failed", 4: "ok", 5: "failed", 6: "ok", 7: "ok", 8: "failed"}


def test_the_last_of_repeated_keys_wins(spark):
    rows = _responses(spark, [(1, 1, '{"severity": "low", "severity": "high", "finding_type": "absent"}', 1, 1, "m", None, "d")])
    assert M.parse_finding(M.extract_json(rows)).first().severity == "high"


def test_surplus_attempts_are_metered(spark):
    good = '{"finding_type": "absent", "severity": "info"}'
    rows = _responses(
        spark,
        [(1, 1, good, 5, 5, "m", None, "d"), (1, 2, good, 6, 6, "m", None, "d"), (1, 3, "x", 7, 7, "m", None, "d"),
         (2, 1, "x", 1, 1, "m", None, "d"), (2, 2, good, 2, 2, "m", None, "d")],
    )
    got = sorted((r.request_id, r.attempt, r.status, r.input_tokens) for r in M.meter_attempts(rows).collect())
    assert got == [(1, 1, "ok", 5), (1, 2, "surplus", 6), (1, 3, "surplus", 7), (2, 1, "failed", 1), (2, 2, "ok", 2)]
    out = {r.request_id: (r.attempts, r.status, r.surplus) for r in M.resolve_attempts(rows).collect()}
    assert out == {1: (1, "ok", 2), 2: (2, "ok", 0)}


def test_stored_texts_stay_whole(spark):
    long = "s" * 5000
    rows = _responses(spark, [(1, 1, f'{{"finding_type": "absent", "severity": "info", "summary": "{long}"}}', 1, 1, "m", None, "d")])
    found = M.parse_finding(M.extract_json(rows))
    kept = M.persist_findings(found).first()
    assert (len(kept.summary), kept.oversized) == (5000, True)
    assert len(M.persist_findings(found, cut=True).first().summary) == 1000


def test_a_job_without_its_version_stays_in_the_bundle(spark):
    jobs = spark.createDataFrame(
        [(1, 10, "done", False, "ok"), (2, 99, "done", False, "ok")],
        "job_id int, version_id int, state string, quota_refunded boolean, summary_status string",
    )
    versions = spark.createDataFrame([(10, 7, "ok", "ok")], "version_id int, document_id int, tc_parse_status string, comments_parse_status string")
    runs = spark.createDataFrame([(1, "d", "ok")], "job_id int, domain_key string, status string")
    findings = spark.createDataFrame([(5, 2, "high")], "flag_id int, job_id int, severity string")
    edits = spark.createDataFrame([(6, 2, True)], "edit_id int, job_id int, accepted boolean")
    comments = spark.createDataFrame([(10, 1)], "version_id int, ordinal int")
    got = {r.job_id: r for r in Q.results_bundle(jobs, versions, runs, findings, edits, comments).collect()}
    assert got[2].document_id is None and got[2].high == 1 and got[2].edits == 1 and got[2].comments == 0
    assert got[1].document_id == 7 and got[1].comments == 1 and got[1].review_complete


def test_purge_reaches_every_named_owner(spark):
    from datetime import datetime

    old = datetime(2020, 1, 1)
    documents = spark.createDataFrame([(1, old), (2, None)], "document_id int, deleted_at timestamp_ntz")
    versions = spark.createDataFrame([(10, 1), (20, 2), (21, 2)], "version_id int, document_id int")
    jobs = spark.createDataFrame([(100, 10), (200, 20)], "job_id int, version_id int")
    findings = spark.createDataFrame([(5, 100), (6, 200)], "flag_id int, job_id int")
    edits = spark.createDataFrame([(7, 5), (8, 6)], "edit_id int, flag_id int")
    usage = spark.createDataFrame([(1, 100), (2, 200)], "usage_id int, job_id int")
    more = {
        "version_diffs": spark.createDataFrame([(20, 21), (10, 20)], "from_version int, to_version int"),
        "citations": spark.createDataFrame([(5, 1), (6, 2)], "flag_id int, citation_id int"),
    }
    left = T.purge_cascade(documents, versions, jobs, findings, edits, usage, datetime(2024, 1, 1), dependents=more)
    assert [tuple(r) for r in left["version_diffs"].select("from_version", "to_version").collect()] == [(20, 21)]
    assert [r.citation_id for r in left["citations"].collect()] == [2]
    assert left["usage"].filter(F.col("job_id").isNull()).count() == 1


def test_a_packed_text_is_one_row_for_all_its_domains(spark):
    """A text moves once, whatever the number of domains; requests are the same either way."""
    lexicon = lexicon_from_rows([("exclusivity", "pay"), ("moral_rights", "zz1"), ("non_compete", "zz2")])
    clauses = _clauses(spark, ["pay " * 30, "other", "pay " * 30])
    versions = spark.createDataFrame([(1,), (1,), (2,), (None,)], "version_id int")
    summaries = spark.createDataFrame([(1, "s"), (1, "t")], "version_id int, summary string")
    notes = spark.createDataFrame([(1, 0, None, "note", None)], "version_id int, ordinal int, author string, body string, anchor_text string")
    routed, blocks = D.route_clauses(clauses, lexicon), D.pack_comments(notes)
    single = D.pack_context(routed, clauses, max_chars=150)
    shared = D.pack_context(routed, clauses, max_chars=150, shared=True)
    texts = [(r.version_id, r.part_no, r.context) for r in shared.collect()]
    assert len(texts) < single.count()
    flat = sorted((r.part_no, d, r.context) for r in shared.collect() for d in r.domains)
    assert flat == sorted((r.part_no, r.domain, r.context) for r in single.collect())
    both = [
        sorted(tuple(r) for r in D.build_requests(versions, lexicon, c, summaries, blocks).collect())
        for c in (single, shared)
    ]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {1, 2}
    assert sum(r[:3] == (1, "exclusivity", 1) for r in both[0]) == 2  # one a summary


def test_parts_across_chunks_and_what_stands_beside_them(spark):
    """Parts that lie in several chunks are whole, and bring summary and comments along."""
    lexicon = lexicon_from_rows([("exclusivity", "pay"), ("non_compete", "zz"), ("moral_rights", "qq")])
    texts = [f"{'pay ' * (i % 7)}clause {i}" + (" zz" if i % 50 == 0 else "") for i in range(300)]
    rows = [(v, i + 1, None, t) for v in (1, 2) for i, t in enumerate(texts)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    versions = spark.createDataFrame([(1,)], "version_id int")
    summaries = spark.createDataFrame([(1, "s")], "version_id int, summary string")
    blocks = spark.createDataFrame([(1, 2, "c")], "version_id int, part_no int, comments string")
    beside = D.sections_beside(versions, summaries, blocks)
    routed = D.route_clauses(clauses, lexicon)
    found = D.pack_context(routed, clauses, max_chars=500).collect()
    for domain, wanted in (("exclusivity", "pay"), ("non_compete", "zz"), ("moral_rights", "")):
        parts = sorted((r.part_no, r) for r in found if r.domain == domain and r.version_id == 2)
        entries = "\n\n".join(r.context for _, r in parts).split("\n\n")
        assert entries == [f"[Klausul {i + 1}]\n{t}" for i, t in enumerate(texts) if wanted in t]
        assert [p for p, _ in parts] == list(range(1, len(parts) + 1))
    near = D.pack_context(routed, clauses, max_chars=500, shared=True, beside=beside)
    assert {(r.version_id, r.summary, r.comments) for r in near.filter("part_no = 2").collect()} == {(1, "s", "c")}
    plain = D.pack_context(routed, clauses, max_chars=500, shared=True)
    requests = [
        sorted(tuple(r) for r in D.build_requests(versions, lexicon, c, summaries, blocks).collect()) for c in (near, plain)
    ]
    assert requests[0] == requests[1]
    assert len(requests[0]) == sum(r.version_id == 1 for r in found) + 1  # a block of comments alone


def test_an_audit_of_sections_counts_every_request(spark):
    """A section that requests share is searched once and counts for each of them."""
    from clauselake.operators import redact as R

    lexicon = lexicon_from_rows([("exclusivity", "pay"), ("moral_rights", "zz1"), ("non_compete", "zz2")])
    clauses = _clauses(spark, ["pay a@b.org 08", "12 3456 and jalan x", "c@d.org 0812-3456-77"])
    versions = spark.createDataFrame([(1,), (2,)], "version_id int")
    summaries = spark.createDataFrame([(1, "call 0812"), (2, None)], "version_id int, summary string")
    notes = spark.createDataFrame([(2, 1, "e@f.org"), (2, 2, "g@h.org"), (1, 1, "77 no")], "version_id int, part_no int, comments string")
    contexts = D.pack_context(D.route_clauses(clauses, lexicon), clauses, shared=True)
    whole = D.build_requests(versions, lexicon, contexts, summaries, notes)
    parts = D.build_requests(versions, lexicon, contexts, summaries, notes, sections=True)

    def counts(texts):
        left = R.residual_pii_audit(texts).groupBy("version_id", "type").agg(F.sum("matches"))
        return sorted(tuple(r) for r in left.collect())

    got = counts(parts)
    assert got == counts(whole.select("version_id", F.col("request").alias("text")))
    assert (2, "EMAIL", 6) in got and parts.count() < 3 * whole.count()


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    from clauselake.session import stored

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    before = shuffled()
    kept = stored(spark.range(2000).repartition(7, "id"), "numbers")
    assert not shuffled() - before
    assert kept.count() == 2000
