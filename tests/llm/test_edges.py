"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import (
    feistel,
    hilbert_search,
    lsh_forest,
    mil_quality,
    mixing,
    preferences,
    queries,
    repeated_spans,
    sorted_passes,
    trie_bpe,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _n int, place int, key int, r int"


def documents(spark, rows):
    """Rows of (doc_id, text, source) with extra columns named like internal ones."""
    return spark.createDataFrame([(i, t, None, s, None, 1, 2, 3, 4) for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i * 7919 % 10007}x{i}" for i in range(40_000))
AWKWARD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "one", "b"),
    (3, "one", "b"),
    (None, "one", None),
    (4, LONG, "b"),
    (5, LONG + " end", "c"),
    (6, " \n\t ", "c"),
    (7, "three little words", "c"),
    (8, "é" * 500, "c"),
    (9, "x" + "é" * 500, "c"),
]


def awkward(spark):
    return documents(spark, AWKWARD)


def test_feistel_is_a_permutation_and_computable():
    for n in (1, 2, 3, 10, 97, 1000):
        places = feistel.permute(np.arange(n), n, 5)
        assert sorted(places.tolist()) == list(range(n))
        assert (feistel.permute(places, n, 5, back=True) == np.arange(n)).all()
        for row in range(0, n, 7):
            shard, slot = feistel.locate(row, n, 4, 5)
            assert feistel.row_at(shard, slot, n, 4, 5) == row


def test_shards(spark):
    rows = awkward(spark).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), "place")
    got = feistel.shard_rows(rows, ["doc_id", "c"], 4, seed=1).collect()
    assert len(got) == len(AWKWARD)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert feistel.locate(r.row, len(AWKWARD), 4, 1) == (r.shard, r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert feistel.shard_rows(rows.limit(0), ["doc_id"], 4).count() == 0


def test_sharding_query_describes_the_texts(spark, sf_dir):
    """Sizes and checksums of the query from the texts' bytes; shards even, slots without gaps."""
    rows = queries.op5_feistel_sharding(spark, sf_dir).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i, len(data) + 16, zlib.crc32(data)) for i, data in texts
    )
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_mixing_edges(spark):
    rows = mixing.mix(awkward(spark), [5, 2, 1], shards=4, block_words=100).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.size for r in rows if r.doc_id in (1, 2, 6)} == {0}
    assert all(len(r.draws) <= 3 for r in rows)
    assert [r.source for r in rows if r.doc_id is None] == [None]
    assert mixing.mix(awkward(spark).limit(0), [5, 2, 1]).count() == 0
    again = mixing.mix(awkward(spark), [5, 2, 1], shards=4, block_words=100).collect()
    key = lambda r: (r.doc_id or 0, r.size, str(r.draws))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixing_targets_and_shards(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 5 else "big") for i in range(3000)]
    mixed = mixing.mix(documents(spark, rows), [5, 2, 1], shards=8, block_words=50)
    taken, target, size = collections.Counter(), {}, {}
    shards = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += r.size * len(r.draws)
        target[r.source], size[r.source] = r.target, r.source_size
        for d in r.draws:
            shards[d.shard] += 1
    assert math.isclose(sum(target.values()), sum(size.values()), rel_tol=1e-9)
    for s in target:
        assert abs(taken[s] - target[s]) <= 8 and target[s] <= 3 * size[s]
    assert len(shards) == 8 and max(shards.values()) < 1.5 * min(shards.values())
    flat = mixing.mixed_rows(mixed)
    assert flat.count() == sum(shards.values())


def test_the_draws_decide_what_is_taken(spark):
    """Quotas, tree and blocks replayed in plain Python, document by document; the seed matters."""
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{i % 4}" if i % 3 else "big") for i in range(600)]
    for seed in (0, 1):
        mixed = mixing.mix(documents(spark, rows), [5, 2, 1], shards=6, seed=seed).collect()
        sources = sorted({r.source for r in mixed})
        plans, quotas = {}, []
        for s in sources:
            own = [r for r in mixed if r.source == s]
            size, target = own[0].source_size, own[0].target
            words = max(1, -(-size // 1024))
            passes = int(target // size)
            rest = target - passes * size
            plans[s] = (words, passes, rest, size // words + 1)
            quotas.append(passes * (size // words + 1) + int(rest // words) + 1)
        ends = np.cumsum(mixing.split_quotas(quotas, 6, seed), axis=0)
        for k, s in enumerate(sources):
            words, passes, rest, blocks = plans[s]
            own = sorted(
                (r for r in mixed if r.source == s),
                key=lambda r: (hashlib.md5(f"{seed}:{r.doc_id}".encode()).hexdigest(), r.doc_id),
            )
            before = 0
            for r in own:
                want = []
                for p in range(passes + 1):
                    index = p * blocks + before // words
                    shard = int((ends[:, k] <= index).sum())
                    if shard < 6 and (p < passes or before + r.size / 2 <= rest):
                        want.append((p, shard))
                assert [(d["pass"], d.shard) for d in r.draws] == want
                before += r.size
            taken = sum(r.size * len(r.draws) for r in own)
            assert abs(taken - own[0].target) <= max(0.01 * own[0].target, max(r.size for r in own) / 2)


def test_too_many_blocks_are_refused():
    with pytest.raises(ValueError, match="billion"):
        mixing.split_quotas([600_000_000, 600_000_000], 4, 0)


def test_split_quotas():
    quotas = [100, 0, 7, 1, 5000]
    for shards in (1, 3, 16):
        counts = mixing.split_quotas(quotas, shards, 3)
        assert counts.sum(axis=0).tolist() == quotas and (counts >= 0).all()
        assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1 + int(math.log2(shards))
        assert (counts == mixing.split_quotas(quotas, shards, 3)).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_equals_the_library(spark, library):
    texts = [t for _, t, _ in AWKWARD] + [
        "It's L'LL <|endoftext|>x<|startoftext|> 12 ünïcödé İΣ \x85 \x1c ſ 😀😀 é 日本語 한국어 </w> w</w>",
        "a" * 5000,
        "́start   middle",
    ]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in trie_bpe.encode(docs, queries.vocabulary()).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert trie_bpe.encode(docs.limit(0), queries.vocabulary()).count() == 0


def test_bpe_of_very_long_words(library):
    """A word of 400,000 letters, in time that grows with its length, and ids beyond 16 bits."""
    own = trie_bpe.TrieEncoder(queries.vocabulary())
    rng = np.random.default_rng(9)
    for text in ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400_000)), "ab" * 50_000, "!?" * 20_000):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == want


def test_bpe_of_a_vocabulary_beyond_16_bits(library, tmp_path):
    """The same vocabulary with its ids moved up gives the same tokens, moved up."""
    spec = json.loads(open(queries.vocabulary(), encoding="utf-8").read())
    spec["model"]["vocab"] = {t: i + 70_000 for t, i in spec["model"]["vocab"].items()}
    for t in spec["added_tokens"]:
        t["id"] += 70_000
    spec["post_processor"] = None
    path = tmp_path / "moved.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "It's a very ordinary sentence, with numbers 123 and ünïcödé; unbelievably so!"
    got = np.frombuffer(next(trie_bpe.TrieEncoder(str(path)).encode([text])), "<u4")
    assert (got - 70_000).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "HELD", 50)
    own = trie_bpe.TrieEncoder(queries.vocabulary())
    texts = [LONG[i : i + 300] for i in range(0, 30_000, 300)] * 2
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_quality_edges(spark):
    docs = awkward(spark)
    labels = docs.select("doc_id", F.lit(1).alias("label"))
    only = mil_quality.train(docs, labels)
    scores = mil_quality.score(docs, only, carry=["_n"]).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scores)
    none = mil_quality.train(docs.limit(0), labels.limit(0))
    assert mil_quality.score(docs, none).count() == len(AWKWARD)
    assert mil_quality.score(docs.limit(0), only).count() == 0


def test_quality_streams_long_texts():
    rng = np.random.default_rng(1)
    bags = [mil_quality.bag(" ".join(rng.choice(["abc", "XYZ!!", "q1"], 300)).encode()) for _ in range(20)]
    model = mil_quality.fit(bags, np.arange(20) % 2, rounds=2)
    data = np.frombuffer(LONG.encode() * 3, np.uint8)
    at_once = model.scores(data, np.array([0, len(data)]))[0]
    step, mil_quality.STEP = mil_quality.STEP, 100
    try:
        assert math.isclose(model.score(data, 0, len(data)), at_once, rel_tol=1e-5)
    finally:
        mil_quality.STEP = step


def test_scores_equal_gated_attention_in_plain_steps(spark):
    """Every score from the model's weights, passage by passage, without whole arrays."""
    rng = np.random.default_rng(2)
    words = ["abc", "XYZ!!", "q1", "é", "\n"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 900, 40)] + [None, "", LONG[:20_000]]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    labels = docs.select("doc_id", (F.length("text") % 2).alias("label"))
    model = mil_quality.train(docs, labels)
    p = {k: v.astype(float) for k, v in model.weights.items()}

    def score(text):
        data = (text or "").encode()
        logits, states = [], []
        for at in range(0, max(1, len(data)), mil_quality.PASSAGE):
            piece = np.frombuffer(data[at : at + mil_quality.PASSAGE], np.uint8)
            x = mil_quality.passage_features(piece, np.array([0]), np.array([len(piece)]))[0]
            h = [math.tanh(sum(a * b for a, b in zip((x - model.mean) / model.scale, w)) + b0) for w, b0 in zip(p["w"].T, p["b"])]
            e = 0.0
            for v, u, a in zip(p["v"].T, p["u"].T, p["a"]):
                gate = 1 / (1 + math.exp(-sum(s * t for s, t in zip(h, u))))
                e += a * math.tanh(sum(s * t for s, t in zip(h, v))) * gate
            logits.append(e)
            states.append(h)
        share = [math.exp(e - max(logits)) for e in logits]
        mean = [sum(w * h[k] for w, h in zip(share, states)) / sum(share) for k in range(len(states[0]))]
        return 1 / (1 + math.exp(-(sum(m * c for m, c in zip(mean, p["c"][:, 0])) + p["d"][0])))

    got = {r.doc_id: r.score for r in mil_quality.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert math.isclose(got[i], score(text), rel_tol=1e-3, abs_tol=1e-5)


def test_training_sees_whole_texts_within_its_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil_quality, "fit", lambda bags, labels, seed: seen.append([len(b) for b in bags]))
    sizes = [100, 5000, 40_000, 3000, 700]
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("label")).filter(~mil_quality.held_out(F.col("doc_id")))
    mil_quality.train(docs, labels)
    mil_quality.train(docs, labels, sample_bytes=10_000)
    kept = {r.doc_id for r in labels.collect()}
    passages = [-(-n // mil_quality.PASSAGE) for i, n in enumerate(sizes) if i in kept]
    assert seen[0] == passages
    assert seen[1] == [n for n in passages if n * mil_quality.PASSAGE < 10_000]


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def test_walk_up_meets_every_pair_of_a_node():
    """Whatever deeper nodes have united: the same groups as comparing all pairs at once."""
    rng = np.random.default_rng(0)
    for t in range(200):
        n, level = int(rng.integers(2, 30)), int(rng.integers(1, 9))
        labels = rng.integers(0, 2, (n, 8)).astype(np.uint32)
        labels[:, :level] = 7
        sigs = rng.integers(0, 2, (n, 16)).astype(np.uint8)
        side = None if t % 2 else rng.random(n) < 0.5
        near = lsh_forest.agreement(sigs, sigs) >= 0.8
        if side is not None:
            near &= side[:, None] != side[None, :]
        met = np.zeros((n, n), bool)
        met[np.arange(n), lsh_forest.walk_up(labels, sigs, side, level, 0.8)] = True
        roots = [lsh_forest.spread_roots(m) for m in (met | met.T, near)]
        assert (roots[0] == roots[1]).all()


def test_prefixes_shorten_until_the_recall_is_met(spark):
    """Pairs that agree on short prefixes only pull the depth down to them."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        low = rng.integers(0, 1 << 31, 128).astype(np.uint32)
        other = low.copy()
        other.reshape(16, 8)[:, 3] += 1  # every tree: three leading values agree, of 8
        rows += [(bytes([i, k]), bytes(16), x.tobytes()) for k, x in enumerate((low, other))]
    table = spark.createDataFrame(rows, "sid binary, sig binary, paths binary")
    measure = lambda df, recall: lsh_forest.measured_depth(df, 0.8, 16, 8, recall, 64, 0)
    assert measure(table, 0.998) == 3
    same = table.union(spark.createDataFrame([(bytes([200, i, k]), bytes(16), bytes(512)) for i in range(2) for k in range(40)], table.schema))
    assert measure(same, 0.5) == 8 and measure(same.limit(0), 0.998) == 8


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], least[root(i)]) for i in range(len(rows)))


def test_similar_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t, _ in AWKWARD if i is not None]
    base = [f"v{k}" for k in range(120)]
    for i in range(100, 400):  # a large group of near copies, and pieces of it
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            words[at] = f"u{rng.integers(0, 9)}"
        rows.append((i, " ".join(words[: 120 if i % 3 else 100])))
    docs = documents(spark, [(i, t, "s") for i, t in rows] + [(None, "one", None)])
    got = lsh_forest.similar_documents(docs, walk_block=16, block=8).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert lsh_forest.similar_documents(docs.limit(0)).count() == 0


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(
        b[i : i + length] for b in data for i in range(len(b) - length + 1)
    )
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_spans(spark, monkeypatch, small):
    if small:  # many runs, ranges and seams between them
        monkeypatch.setattr(repeated_spans, "RUN", 40)
    rng = np.random.default_rng(4)
    texts = [t[:6000] if t else t for _, t, _ in AWKWARD] + ["ab" * 400, "The " * 300, "xy" * 90]
    passage = "".join(rng.choice(list("abcdefgh "), 900))
    for i in range(60):
        own = "".join(rng.choice(list("abcdefgh "), int(rng.integers(1, 700))))
        start, end = sorted(rng.integers(0, 900, 2))
        texts.append(own + passage[start:end] + own[::-1][: int(rng.integers(0, 300))])
        if i % 10 == 0:
            texts.append(texts[-1])
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")])
    got = repeated_spans.repeated_spans(docs, 200, carry=["r"], gram=64).collect()
    mine = sorted(
        (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
        for r in got
    )
    assert mine == brute_spans([*texts, texts[0]], 200)
    assert {r.r for r in got} == {4}


def test_repeated_spans_as_text_and_empty(spark):
    got = repeated_spans.repeated_spans(awkward(spark), 400, as_text=True).collect()
    cut = {r.doc_id: r.kept for r in got}
    assert cut[8] == "" and cut[9] == "x" and cut[7] == "three little words" and cut[1] == ""
    assert repeated_spans.repeated_spans(awkward(spark).limit(0), 400).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rid int, dim int, part int"


def vectors(spark, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(8)
    rows = [
        (1000, None, 1), (1001, [], 1), (1002, [0.0] * 8, 1), (1003, [1.0, None] + [0.0] * 6, 1),
        (1004, [float("nan")] + [1.0] * 7, 1), (1005, [float("inf")] + [1.0] * 7, 1),
        (1006, base.tolist(), None), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.0], 1),
        (1009, (base * 2).tolist(), 2),
    ]
    rows += [(i, (base + rng.standard_normal(8) * 0.12).tolist(), 1) for i in range(300)]
    rows += [(i, rng.standard_normal(8).tolist(), int(i % 3)) for i in range(300, 600)]
    rows += [(i, rows[20][1], 1) for i in range(600, 640)]
    rows.append(rows[15])
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    return rows, spark.createDataFrame([(*r, 1, 2, 3) for r in shuffled], VECTORS)


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicate_vectors(spark):
    rows, table = vectors(spark)
    got = sorted(
        (r.vec_id, r.n_links, r.component_id, r.kept)
        for r in sorted_passes.near_duplicates(table, 0.93, window=32, halo=8, block=16).collect()
    )
    x = [np.array(r[1], np.float32).astype(float) if sound(r[1]) else None for r in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if x[i] is None or x[j] is None or len(x[i]) != len(x[j]):
                continue
            if rows[i][2] is None or rows[i][2] != rows[j][2]:
                continue
            if x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = sorted((r[0], n[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))
    assert got == want
    assert sorted_passes.near_duplicates(table.limit(0), 0.93).count() == 0


@pytest.mark.parametrize("cone", [2.0, 0.0])
def test_links_of_skewed_and_even_vectors(spark, cone):
    """Vectors in a cone share their leading bits in large numbers; none of their links is lost."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32))
    x = x / np.linalg.norm(x, axis=1)[:, None] + cone * np.eye(32)[0]
    x = np.vstack([x, x[:300] + rng.standard_normal((300, 32)) * 0.05 * (1 + cone)])
    x = x.astype(np.float32).astype(float)
    table = spark.createDataFrame(
        [(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"
    )
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    threshold = 0.93 if cone else 0.9
    links = (unit @ unit.T >= threshold).sum(axis=1) - 1
    got = sorted_passes.near_duplicates(table, threshold, window=32, halo=8, block=16).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist())) and links.any()


def test_passes_grow_with_the_table():
    need = [sorted_passes.passes_needed(n, 256, 0.93, 0.9999) for n in (0, 100, 10_000, 10**8)]
    assert need == sorted(need) and need[-1] < 300


def test_nearest(spark):
    rows, table = vectors(spark)
    got = collections.defaultdict(list)
    for r in hilbert_search.nearest(table, F.col("vec_id") % 20 == 0, k=5, chunk=200).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows if sound(r[1])]
    hits = total = 0
    for at, (i, q) in enumerate(good):
        if i % 20:
            continue
        near = sorted(
            (-(q * v).sum(), j) for k, (j, v) in enumerate(good) if k != at and len(v) == len(q)
        )[:5]
        found = sorted(got.pop(i))
        assert [f[0] for f in found] == list(range(1, 6))
        score = {(j, round(-s, 9)) for s, j in near}
        hits += len(score & {(j, round(s, 9)) for _, j, s in found})
        total += 5
        keys = [(-round(s, 12), j) for _, j, s in found]
        assert keys == sorted(keys)
    assert not got and hits >= 0.9 * total
    assert hilbert_search.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_keys_are_a_curve():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        keys = hilbert_search.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(1 << (axes * bits)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_ties_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5], None) for i in range(500)] + [(500, [0.0, 1.0, 0.0], None)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)
    got = hilbert_search.nearest(table, F.col("vec_id") == 20, k=6, recall=1.0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4, 5]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>ü\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" * 9000
    rows = [
        (1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999),
        (6, "u", "x" * 999), (None, "u", big), (7, "u", "y\n" * 1000), (7, "u", "y\n" * 1000), (8, "u", "\r\n"),
        (0, "u", "y\n" * 1000),
    ]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, row int, no int")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk=1000)
    chunks = warc.read_chunks(spark, path)
    got = sorted(
        (r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1)
        for r in warc.records(chunks).collect()
    )
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None] if len(data) >= 1000 else []
        revisit = i is not None and same and i < max(same)
        want.append(
            (i or -1 if i is not None else -1, len(data), hashlib.sha1(data).hexdigest(),
             "revisit" if revisit else "response", max(same) if revisit else -1)
        )
    assert got == sorted(want)
    assert all(r.intact for r in warc.records(chunks).collect())
    assert chunks.agg(F.max(F.octet_length("chunk"))).first()[0] <= 1000
    parts = sorted((r.record_id, r.chunk_no, bytes(r.chunk)) for r in chunks.filter("page_id = 2").collect())
    assert b"".join(p[2] for p in parts) == big.encode()
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.records(warc.read_chunks(spark, str(tmp_path / "none"))).count() == 0


def test_warc_notices_a_lost_chunk(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), chunk=1000)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    assert warc.records(chunks).first().intact
    assert not warc.records(chunks.filter("chunk_no <> 2")).first().intact


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "chosen", 2, "user", None),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 5, "user", "same"),
        (3, "chosen", 0, None, None), (3, "rejected", 0, None, ""),
        (4, "rejected", 0, "assistant", "alone"),
        (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"),
    ]
    table = spark.createDataFrame(
        [(*t, 1, 2) for t in turns], "pair_id long, side string, turn int, role string, text string, place int, n int"
    )
    got = {r.pair_id: r for r in preferences.preference_pairs(table).collect()}
    assert set(got) == {1, 2, 3, 4}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1].prompt == say("user", "hi") and got[1].prompt_turns == 1
    assert got[1].chosen == say("assistant", "good") + say("user", "")
    assert [tuple(m) for m in got[1].chosen_mask] == [(0, len(say("assistant", "good")))]
    assert got[1].rejected == say("assistant", "bad")
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == (say("user", "same"), "", "")
    assert got[3].prompt == "" and got[3].chosen == got[3].rejected == say("", "")
    assert got[4].chosen == "" and got[4].rejected_mask[0].end == len(got[4].rejected)
    assert preferences.preference_pairs(table.limit(0)).count() == 0


def test_anchors_cover_every_window_once(monkeypatch):
    rng = np.random.default_rng(6)
    text = np.concatenate([rng.integers(97, 100, 3000), np.tile([97, 98], 400), rng.integers(97, 100, 500)])
    text = np.concatenate([text, text[1000:2500]]).astype(np.uint8)
    for piece in (1 << 20, 700, 101):
        monkeypatch.setattr(repeated_spans, "PIECE", piece)
        offset = {}
        for place, _, first, last in repeated_spans.text_anchors(text, 100, 32):
            for start in range(first, last + 1):
                assert start not in offset and start <= place <= start + 68
                offset[start] = place - start
        assert sorted(offset) == list(range(len(text) - 99))
        seen = {}
        for start, at in offset.items():
            assert seen.setdefault(text[start : start + 100].tobytes(), at) == at


def test_merge_of_front_coded_runs():
    from clauselake.llm import front_coding as C

    rng = np.random.default_rng(7)
    rows = [
        (bytes(rng.integers(97, 99, int(rng.integers(0, 12))).astype(np.uint8)), i.to_bytes(16, "big"), b"o" * (i % 3))
        for i in range(500)
    ]
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rows[i::k]) for i in range(k)]
        assert [[r[:3] for r in C.unpack(C.pack(run))] for run in runs] == runs
        merged = list(C.merge([C.unpack(C.pack(run)) for run in runs]))
        assert [r[:3] for r in merged] == sorted(rows)
        for above, row in zip(merged, merged[1:], strict=False):
            assert row[3] == C.common(above[0], row[0])
    assert list(C.merge([])) == []
