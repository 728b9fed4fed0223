"""The pipeline against the brute-force form of each of its stages."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from clauselake.llm import mil_quality, queries
from clauselake.session import _own_scratch, children, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _draw int, score double, kept int"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def near_duplicates(rows):
    sets = []
    for r in rows:
        w = (r["text"] or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s or () for j in by[x])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s or ():
            by[x].append(i)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] == least[root(i)]]


def repeated_passages(rows):
    data = [(r["text"] or "").encode() for r in rows]
    seen = collections.Counter(hash(b[i : i + 250]) for b in data for i in range(len(b) - 249))
    out = []
    for r, b in zip(rows, data, strict=True):
        runs = []
        for i in range(len(b) - 249):
            if seen[hash(b[i : i + 250])] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + 250
                else:
                    runs.append([i, i + 250])
        stops = [0, *(x for run in runs for x in run), len(b)]
        text = "".join(b[x:y].decode("utf-8", "ignore") for x, y in zip(stops[::2], stops[1::2], strict=True))
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def sizes_by_source(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].split())
    return sizes


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Output of every stage, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = mil_quality.train(stages[0], labels)
    import numpy as np

    want = set()
    for r in rows_of(stages[0]):
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        if model.score(data, 0, len(data)) >= 0.3:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in rows_of(stages[1])} == want
    known = {r["doc_id"]: r["label"] for r in rows_of(labels)}
    kept = [known[i] for i in want if i in known]
    dropped = [known[r["doc_id"]] for r in rows_of(stages[0]) if r["doc_id"] in known and r["doc_id"] not in want]
    assert sum(kept) / len(kept) > 0.95 and sum(dropped) <= 0.05 * len(known)


def test_near_duplicates(stages):
    want = near_duplicates(rows_of(stages[1]))
    key = lambda r: r["doc_id"]
    assert sorted(rows_of(stages[2]), key=key) == sorted(want, key=key)


def test_repeated_passages(stages):
    want = repeated_passages(rows_of(stages[2]))
    key = lambda r: r["doc_id"]
    assert sorted(rows_of(stages[3]), key=key) == sorted(want, key=key)


def test_mixture(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    times = collections.Counter(r["doc_id"] for r in after)
    known = {r["doc_id"]: r for r in before}
    assert all(n <= 3 for n in times.values()) and all(r == known[r["doc_id"]] for r in after)
    have, got = sizes_by_source(before), sizes_by_source(after)
    largest = max(len(r["text"].split()) for r in before)
    assert math.isclose(sum(got.values()), sum(have.values()), rel_tol=0.05)
    for i, s in enumerate(sorted(have)):
        assert got[s] <= 3 * have[s]
        if i % 3 == 0:  # weight 5: as much as there may be
            assert got[s] >= min(3 * have[s], have[s]) - largest


def test_encoding(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    want = collections.Counter()
    for r in rows_of(stages[4]):
        ids = library.encode(r["text"], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), raw] += 1
    got = collections.Counter(
        (r["doc_id"], r["n_tokens"], r["ids_sha256"], bytes(r["ids"])) for r in rows_of(stages[5])
    )
    assert got == want


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    found = P.run(spark, sf_dir)
    assert found.exceptAll(stages[-1]).isEmpty() and stages[-1].exceptAll(found).isEmpty()


def test_awkward_rows_pass_every_stage(spark, sf_dir, tmp_path):
    text = "one two three four five six seven " * 200
    rows = [
        (1, text), (1, text), (2, text), (3, None), (4, ""), (None, "alone in the dark"), (5, " \n"),
        (6, "quite other words here and there"), (6, "the same id with another text"),
    ]
    docs = spark.createDataFrame([(i, t, None, None if i == 4 else "s", 0, 1, 2, 0.0, 1) for i, t in rows], SCHEMA)
    kept = docs
    for k, (_, stage) in enumerate(P.STAGES):
        kept = stage(spark, kept, sf_dir)
        if k + 1 < len(P.STAGES):
            assert kept.columns == docs.columns
            kept.write.parquet(str(tmp_path / str(k)))
            kept = spark.read.parquet(str(tmp_path / str(k)))
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept.collect()
    unique = {(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, sf_dir).collect()}
    assert len(unique) == len({r for r in rows}) - 1 and (2, text) not in unique


@pytest.mark.parametrize(
    "name, left", [("near_duplicates", ["similar"]), ("repeated_passages", ["runs"]), ("mixture", [])]
)
def test_stages_leave_no_working_tables(spark, sf_dir, name, left):
    said = " ".join(f"word{i}" for i in range(200))
    near = said.replace("word199", "end")
    cut = " ".join(f"other{i}" for i in range(90)) + said[300:900] + " tail"
    rows = [(1, said), (2, said), (3, near), (4, cut), (5, "quite alone here"), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, 2, 0.0, 1) for i, t in rows], SCHEMA)
    docs = stored(docs, "input")
    there = set(children(spark, _own_scratch(spark)))
    found = dict(P.STAGES)[name](spark, docs, sf_dir)
    first = sorted(map(str, found.collect()))
    made = set(children(spark, _own_scratch(spark))) - there
    assert sorted(m.rpartition("-")[0] for m in made) == left
    assert first and sorted(map(str, found.collect())) == first  # the result reads nothing that is gone
    if name == "near_duplicates":
        assert {r["doc_id"] for r in found.collect()} == {1, 4, 5, None}
    if name == "repeated_passages":
        want = {(r["doc_id"], r["text"]) for r in repeated_passages(rows_of(docs))}
        assert {(r["doc_id"], r["text"] or "") for r in found.collect()} == {(i, t or "") for i, t in want}


def test_run_keeps_one_stage_at_a_time(spark, sf_dir):
    there = set(children(spark, _own_scratch(spark)))
    P.run(spark, sf_dir)
    made = set(children(spark, _own_scratch(spark))) - there
    assert [m.rpartition("-")[0] for m in made if m.rpartition("-")[0] in dict(P.STAGES)] == ["mixture"]
