"""Benchmark passages in documents against a word-by-word search."""

import random
import re

import pyarrow as pa
import pytest

from clauselake.llm import suffix_leaks
from clauselake.llm import words as word_module

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, text string, n_words int, matches int, item_id int, c0 int"


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, window):
    """Per row: words, words hit, ids found, and all matches that grow no further."""
    out = []
    for _, text in docs:
        w, hit, ids, found = words(text), set(), set(), set()
        for item_id, item in items:
            v = words(item)
            need = min(window, len(v))
            for i in range(len(w)):
                for j in range(len(v)):
                    if i and j and w[i - 1] == v[j - 1]:
                        continue
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if need and n >= need:
                        found.add((item_id, j, i, n))
                        hit.update(range(i, i + n))
                        ids.add(item_id)
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None), found))
    return out


def awkward():
    rng = random.Random(3)
    letters = ["a", "B", "c,", "é", "D9"]
    draw = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, draw(rng.randint(1, 14))) for i in range(12)]
    items += [(None, draw(9)), (50, None), (51, ""), (52, " .,- "), (53, items[0][1].upper()), (0, draw(8)), (54, "Zebra")]
    docs = [(i, draw(rng.randint(0, 60))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "...")]
    docs += [(103, f"x {items[3][1]} y {items[3][1].lower()}"), (103, docs[5][1]), (None, items[12][1])]
    docs += [(104, "q " * 300 + items[4][1] + " zebra" + " q" * 300), (105, "a " * 80)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_matches_are_all_found(spark, monkeypatch, block):
    """Items in one block, and in many blocks with a pass for each."""
    monkeypatch.setattr(suffix_leaks, "BLOCK", block)
    docs, items = awkward()
    window = 5
    table = spark.createDataFrame([(i, t, 1, 2, 3, k) for k, (i, t) in enumerate(docs)], SCHEMA)
    asked = spark.createDataFrame(items, "item_id int, text string")
    leaks = suffix_leaks.find_leaks(table, asked, window, carry=["c0", "item_id"])
    got = sorted(leaks.collect(), key=lambda r: r.c0)
    want = brute(docs, items, window)
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [w[:3] for w in want]
    assert all(r.item_id == 3 for r in got)
    for r, (_, _, _, found) in zip(got, want, strict=True):
        mine = {(m.item_id, m.item_start, m.doc_start, m.n_words) for m in r.matches}
        assert mine == found
    clean = suffix_leaks.without_leaks(table, asked, window)
    assert clean.columns == table.columns
    assert sorted(r.c0 for r in clean.collect()) == [k for k, w in enumerate(want) if not w[1]]
    best = {r.item_id: r.n_words for r in suffix_leaks.longest_matches(leaks).collect()}
    every = [f for w in want for f in w[3]]
    assert best == {i: max(f[3] for f in every if f[0] == i) for i in {f[0] for f in every}}


@pytest.mark.parametrize(("shard", "followed", "stretch"), [(16, 5, 9), (64, 1000, 8 << 20)])
def test_small_shards_and_stretches(monkeypatch, shard, followed, stretch):
    """Matches over the seams of shards and of pieces of a text."""
    monkeypatch.setattr(suffix_leaks, "SHARD", shard)
    monkeypatch.setattr(suffix_leaks, "FOLLOWED", followed)
    monkeypatch.setattr(word_module, "STRETCH", stretch)
    docs, items = awkward()
    block = suffix_leaks.make_block([(i, 0, pa.array(words(t), pa.large_binary())) for i, t in items], 5)
    numbered, counts = suffix_leaks._numbered(pa.array([t for _, t in docs], pa.string()), block.vocabulary)
    assert counts.tolist() == [len(words(t)) for _, t in docs]
    starts = [1 + sum(counts[:k]) + k for k in range(len(docs) + 1)]
    got = [set() for _ in docs]
    for place, test, n in zip(*suffix_leaks.matches(numbered, block, 5), strict=True):
        row = max(k for k in range(len(docs)) if starts[k] <= place)
        for i in block.ids[block.item[test]]:
            got[row].add((i, int(block.start[test]), int(place) - starts[row], int(n)))
    assert got == [w[3] for w in brute(docs, items, 5)]


def test_pieces_of_a_long_item(monkeypatch):
    """An item beyond a block: every window of it lies in one of its pieces."""
    monkeypatch.setattr(suffix_leaks, "BLOCK", 12)

    class Rows:
        def toLocalIterator(self):  # noqa: N802
            return iter([(1, " ".join(f"w{k}" for k in range(40))), (2, "w1 w2 w3"), (3, "")])

    made = list(suffix_leaks.blocks(Rows(), 5))
    assert all(len(b.words) - len(b.ids) <= 12 for b in made)
    seen = {
        tuple(b.vocabulary.take(pa.array(b.words[k : k + 5] - 1)).to_pylist())
        for b in made
        for k in range(len(b.words))
        if b.left[k] >= 5
    }
    assert seen == {tuple(f"w{j}".encode() for j in range(k, k + 5)) for k in range(36)}
    assert sum(b.whole.sum() for b in made) == 1


def test_empty_tables(spark):
    docs, items = awkward()
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], SCHEMA)
    asked = spark.createDataFrame(items, "item_id int, text string")
    none = suffix_leaks.find_leaks(table, asked.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.matches for r in none)
    assert sorted(r.n_words for r in none) == sorted(len(words(t)) for _, t in docs)
    assert suffix_leaks.find_leaks(table.limit(0), asked).count() == 0


def test_order_by_words_however_many_fit_one_number():
    """Two words to a number, then ranks; the order is that of plain slices."""
    import numpy as np

    rng = random.Random(1)
    given = np.array([rng.choice([0, 1, 2, 1 << 30]) for _ in range(400)], np.int32)
    order = suffix_leaks.suffix_array(given, 50, 390, 7, (1 << 31) - 1)
    at = lambda i: tuple(given[i : i + 7].tolist()) + (0,) * max(0, i + 7 - 400)
    assert sorted(order.tolist()) == [i for i in range(50, 390) if given[i]]
    assert [at(i) for i in order] == sorted(at(i) for i in order)


def test_equal_items_share_a_suffix():
    block = suffix_leaks.make_block([(1, 0, pa.array([b"a", b"b"], pa.large_binary()))] * 2)
    assert block.ids == [[1, 1]] and len(block.words) == 3
