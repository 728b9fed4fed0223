"""One pass for all keywords against one search per keyword; buckets on disk."""

import os
import random
import time

from pyspark.sql import functions as F

from clauselake.operators import route as D
from clauselake.sources import writes as W
from clauselake.sources.lexicon import Domain, lexicon_from_rows

LETTERS = "abAB .*+?[](){}|^$\\-é日/"


def brute(text, lexicon):
    low = (text or "").lower()
    hits = [(d.key, sum(w.lower() in low for w in d.keywords)) for d in lexicon]
    return [h for h in hits if h[1]]


def test_overlapping_keywords_all_count(spark):
    rng = random.Random(1)
    draw = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    words = sorted({draw(rng.randint(1, 5)) for _ in range(150)} | {"ab", "abb", "ba", "b", "bab", "ABBA"})
    lexicon = [Domain(f"d{i}", tuple(w for w in words if hash(w) % 6 == i or len(w) == i)) for i in range(6)]
    lexicon.append(Domain("none", ()))
    texts = [draw(rng.randint(0, 60)) for _ in range(300)] + [None, "", "abbabba", "line\nab\n"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "version_id int, ordinal int, text string")
    got = {}
    for r in D.match_domains(df, lexicon).collect():
        got.setdefault(r.version_id, []).append((r.domain, r.keywords))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute(t, lexicon), t


def test_an_empty_keyword_and_an_empty_lexicon(spark):
    df = spark.createDataFrame([(1, 1, "text"), (2, 1, None)], "version_id int, ordinal int, text string")
    always = [Domain("a", ("", "text")), Domain("b", ("zz",))]
    rows = {(r.version_id, r.domain, r.keywords) for r in D.match_domains(df, always).collect()}
    assert rows == {(1, "a", 2), (2, "a", 1)}
    assert D.match_domains(df, [Domain("b", ())]).count() == 0


def test_cost_is_flat_in_the_number_of_keywords(spark):
    rng = random.Random(2)
    draw = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 12)))
    texts = [(i, 1, " ".join(draw() for _ in range(400))) for i in range(300)]
    df = spark.createDataFrame(texts, "version_id int, ordinal int, text string").repartition(4).cache()
    df.count()
    seconds = {}
    for n in (18, 2000):
        lexicon = lexicon_from_rows([(f"d{i % 18}", draw()) for i in range(n)])
        for _ in range(2):  # the second run counts
            start = time.time()
            D.match_domains(df, lexicon).agg(F.sum("keywords")).collect()
            seconds[n] = time.time() - start
        plan = D.match_domains(df, lexicon)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("regexp_extract_all") <= 2 and "contains" not in plan
    assert seconds[2000] < 20 * seconds[18] + 10  # 111 times as many keywords


def test_a_small_batch_leaves_most_buckets_as_they_are(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.range(1000).select("id", F.lit(0).alias("t"), F.lit("old").alias("v"))
    W.write_buckets(base, path, ["id"], 64)

    def files():
        return {f"{folder}/{f}" for folder, _, names in os.walk(path) for f in names if f.startswith("part-")}

    before = files()
    rows = [(i, t, f"new{t}") for i in (3, 500, 2000, None) for t in (1, 2)]
    batch = spark.createDataFrame(rows, "id long, t int, v string")
    n = W.upsert_buckets(batch, path, ["id"], ["t"], 64)
    assert n <= 4 and len(before - files()) <= 4
    want = {i: ("new2" if i in (3, 500) else "old") for i in range(1000)} | {2000: "new2", None: "new2"}
    assert {r.id: r.v for r in W.read_buckets(spark, path).collect()} == want
    assert W.read_buckets(spark, path).count() == 1002
    W.upsert_buckets(batch, path, ["id"], ["t"], 64)  # again: nothing changes
    assert {r.id: r.v for r in W.read_buckets(spark, path).collect()} == want
    assert W.upsert_buckets(batch.limit(0), path, ["id"], ["t"], 64) == 0
