"""Steps that are done once: parsing, numbering, moving a row, reading a key's state."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clauselake.llm import kept, trie_bpe
from clauselake.operators import answers as M
from clauselake.operators import findings as Q
from clauselake.plans import entities as E
from clauselake.plans import finding_queries
from clauselake.sources import writes as W
from clauselake.streaming import streams as S


class _Handle:
    """One key's state and timers, and how often they are asked."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class _Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


class _Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


def _attempts(rows):
    frame = pd.DataFrame(rows, columns=["t", "attempt_id", "failure"])
    return frame.assign(timed=True, named=True)


def test_a_key_with_many_attempts_asks_its_state_a_few_times():
    rng = random.Random(4)
    second = 1_000_000
    rows = [(rng.randint(1, 5000) * second, i, rng.random() < 0.5) for i in range(3000)]
    handle, window = _Handle(), S._Window(60)
    window.init(handle)
    out = [*window.handleInputRows(("ip", "x"), iter([_attempts(rows[:2000]), _attempts(rows[2000:])]), _Times(0))]
    assert not out and handle.calls <= 4 and handle.timers == {min(r[0] for r in rows) // 1000}
    for watermark in (2_500_000, 10_000_000):
        (fired,) = handle.timers
        out += [*window.handleExpiredTimer(("ip", "x"), _Times(watermark), _Fired(fired))]
        handle.timers.discard(fired)  # as Spark does
    assert handle.calls <= 10 and handle.value is None and not handle.timers
    got = {r.attempt_id: r.failures for part in out for r in part.itertuples()}
    want = {
        i: sum(f and t - 60 * second < s and (s, j) < (t, i) for s, j, f in rows) for t, i, _ in rows
    }
    assert got == want


def test_attempts_without_time_lie_in_no_window():
    rows = _attempts([(0, 1, True), (0, 0, False), (5_000_000, 3, True)])
    rows["timed"], rows["named"] = [False, False, True], [True, False, True]
    window = S._Window(60)
    window.init(_Handle())
    (out,) = window.handleInputRows(("ip", ""), iter([rows]), _Times(0))
    assert out.t.isna().all() and out.failures.tolist() == [0, 0]
    assert out.attempt_id[0] == 1 and out.attempt_id.isna().tolist() == [False, True]
    assert isinstance(out.failures.to_numpy()[0], np.int64)


def test_an_answer_is_parsed_once(spark):
    texts = [
        (1, 7, '{"clause_ordinals": ["x", 9, "2", 1]}'),
        (1, 8, "nothing"),
        (2, 7, '{"clause_ordinals": [1]}'),
        (2, 7, '{"clause_ordinals": [1]}'),
        (3, 8, '{"clause_ordinals": 5}'),
        (None, 7, '{"clause_ordinals": [1]}'),
    ]
    rows = spark.createDataFrame(texts, "request_id long, version_id long, content string")
    clauses = spark.createDataFrame([(7, 1, "7:1"), (7, 2, "7:2"), (8, 1, "8:1")], "version_id long, ordinal int, clause_id string")
    got = M.resolve_clause(M.extract_json(rows).select("request_id", "version_id", "answer"), clauses)
    got = got.select("request_id", "version_id", "clause_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, 7, "7:2"), (1, 8, "7:2"), (2, 7, "7:1"), (2, 7, "7:1"), (3, 8, None), (None, 7, None)], key=str
    )
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(") == 1  # the value of the answer


def test_no_version_is_copied_for_a_level(spark):
    findings = spark.createDataFrame(
        [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, None, "x"), (2, "a", None), (2, "a", "x"), (2, "a", "x"), (3, None, None)],
        "job_id long, domain string, severity string",
    )
    jobs = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12)], "job_id long, version_id long")
    versions = spark.createDataFrame([(10, 5), (11, 6), (12, 6)], "version_id long, document_id long")
    documents = spark.createDataFrame([(5, "p"), (6, None)], "document_id long, counterparty string")
    cube = Q.portfolio_cube(findings, jobs, versions, documents)
    got = {tuple(r)[:6]: tuple(r)[6:9] for r in cube.collect()}
    of = {1: ("p", 10), 2: ("p", 10), 3: (None, 11)}
    raw = [(*of[r.job_id], r.domain, r.severity) for r in findings.collect()]
    want = {}
    for c, d, s in [(c, d, s) for c in (True, False) for d in (True, False) for s in (True, False)]:
        for cp, v, dom, sev in raw:
            cell = (c, d, s, cp if c else None, dom if d else None, sev if s else None)
            n, hit = want.setdefault(cell, (0, set()))
            want[cell] = (n + 1, hit | {v})
    reviewed = {"p": 1, None: 2}
    assert got == {k: (n, len(hit), reviewed[k[3]] if k[0] else 3) for k, (n, hit) in want.items()}
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert sums and not [line for line in sums if "version_id" in line and "by_domain" in line]


def test_a_batch_moves_each_row_of_the_table_once(spark, tmp_path, monkeypatch):
    path, written = str(tmp_path / "t"), []
    kept_apart = W.stored
    monkeypatch.setattr(W, "stored", lambda df, purpose: written.append(purpose) or kept_apart(df, purpose))
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d"), (None, 3, "e"), (4, 1, "f")]
    W.write_buckets(spark.createDataFrame(rows, "id long, t int, v string"), path, ["id"], 8, ["t"])
    assert {(r.id, r.v) for r in W.read_buckets(spark, path).collect()} == {(1, "b"), (2, "c"), (None, "e"), (4, "f")}
    # rows of the table that share a key stay as they are until a batch names it
    W.write_buckets(spark.createDataFrame(rows, "id long, t int, v string"), path, ["id"], 8)
    batch = spark.createDataFrame([(2, 0, "new"), (None, 1, "old"), (None, 2, "none")], "id long, t int, v string")
    W.upsert_buckets(batch, path, ["id"], ["t"], 8)
    got = sorted((str(r.id), r.v) for r in W.read_buckets(spark, path).collect())
    assert got == [("1", "a"), ("1", "b"), ("2", "new"), ("4", "f"), ("None", "none")]
    assert written == ["batch"]


def test_findings_of_a_bundle_are_numbered_once(spark, sf_dir, monkeypatch):
    asked, findings = [], E.findings
    monkeypatch.setattr(E, "findings", lambda *a: asked.append(a) or findings(*a))
    rows = finding_queries.QUERIES["bundle_findings"](spark, sf_dir)
    assert len(asked) == 1 and rows.filter(F.col("edits") == "").count() == 0


def test_other_work_lets_go_of_what_a_worker_keeps(monkeypatch):
    monkeypatch.setattr(trie_bpe, "TrieEncoder", lambda path: [path])
    first = trie_bpe.encoder("x")
    assert trie_bpe.encoder("x") is first
    kept.release()
    assert trie_bpe.encoder("x") is not first and len(kept._KEPT) == 1
    kept.release()
