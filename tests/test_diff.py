import difflib
import random

from pyspark.sql import functions as F

from clauselake.operators import diff as V
from clauselake.operators import redline as E

CLAUSES = "version_id int, ordinal int, heading_path string, text string"


def _diff(spark, old, new, headings=None):
    headings = headings or {}
    rows = [(v, i + 1, headings.get((v, i + 1)), t) for v, texts in ((1, old), (2, new)) for i, t in enumerate(texts)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    pairs = spark.createDataFrame([(9, 1, 2)], "pair_id int, from_version int, to_version int")
    out = V.diff_rows(pairs, clauses).orderBy("block_no", "place").collect()
    return [(r.change_kind, r.clause_ref, r.before_text, r.after_text) for r in out]


def test_equal_or_missing_sides_give_no_rows(spark):
    assert _diff(spark, ["a", "b"], ["a", "b"]) == []
    assert _diff(spark, ["a"], []) == []
    assert _diff(spark, [], ["a"]) == []


def test_modified_keeps_the_heading(spark):
    got = _diff(spark, ["old"], ["new"], {(1, 1): "Pasal 5", (2, 1): "Pasal 5"})
    assert got == [("modified", "Pasal 5", "old", "new")]


def test_added_and_removed(spark):
    assert _diff(spark, ["a"], ["a", "b"]) == [("added", "Klausul 2", None, "b")]
    assert _diff(spark, ["a", "b"], ["a"]) == [("removed", "Klausul 2", "b", None)]


def test_uneven_blocks_pair_by_position(spark):
    assert [r[0] for r in _diff(spark, ["x"], ["p", "q", "r"])] == ["modified", "added", "added"]
    assert [r[0] for r in _diff(spark, ["p", "q", "r"], ["x"])] == ["modified", "removed", "removed"]


def test_outer_blanks_are_no_change(spark):
    assert _diff(spark, ["same text"], ["  same text \n"]) == []


def _places(spark, old, new):
    rows = [(v, i + 1, None, t) for v, side in ((1, old), (2, new)) for i, t in enumerate(side)]
    pairs = spark.createDataFrame([(9, 1, 2)], "pair_id int, from_version int, to_version int")
    changes = V.align_clauses(pairs, spark.createDataFrame(rows, CLAUSES))
    found = changes.orderBy("block_no", "place").collect()
    return [(r.block_no, r.old_ordinal, r.new_ordinal) for r in found]


def test_unchanged_clauses_cut_blocks(spark):
    assert _places(spark, "abcde", "abXde") == [(2, 3, 3)]
    assert _places(spark, "abcde", "bcdeX") == [(0, 1, None), (4, None, 5)]


def test_a_moved_clause_gives_way(spark):
    assert _places(spark, "abcd", "bcda") == [(0, 1, None), (3, None, 4)]
    assert _places(spark, "abcd", "dabc") == [(0, None, 1), (3, 4, None)]
    assert _places(spark, "abcde", "cdeab") == [(0, 1, None), (0, 2, None), (3, None, 4), (3, None, 5)]
    assert _places(spark, "ab", "ba") == [(0, None, 1), (1, 2, None)]


def test_two_stretches_are_judged_apart(spark):
    assert _places(spark, "abcdXefgh", "bcdaXhefg") == [
        (0, 1, None), (3, None, 4), (4, None, 6), (7, 9, None),
    ]


def test_repeated_clauses_match_in_the_longest_block(spark):
    assert _places(spark, "arrb", "arrb") == []
    assert _places(spark, "arrb", "arrrb") == [(3, None, 4)]
    assert _places(spark, "arrb", "arb") == [(2, 3, None)]
    assert _places(spark, "rar", "rrar") == [(0, None, 1)]
    assert _places(spark, "rrr", "rr") == [(2, 3, None)]
    assert _places(spark, "rs" * 500, "X" + "rs" * 500) == [(0, None, 1)]


def _changes(old, new):
    """What the standard matcher reports, by blocks and places."""
    out, kept = [], 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            kept += i2 - i1
            continue
        for k in range(max(i2 - i1, j2 - j1)):
            old_at, new_at = i1 + k + 1, j1 + k + 1
            out.append((kept, k + 1, old_at if old_at <= i2 else None, new_at if new_at <= j2 else None))
    return out


def test_any_lists_give_what_the_matcher_gives(spark):
    """Lists with few and many repeats, with moves, with edits of an own past, and equal ones."""
    rng = random.Random(13)
    lists = []
    for p in range(400):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 6, 12, 26])]
        old = rng.choices(letters, k=rng.randint(1, 30))
        if p % 4 == 0:
            new = rng.choices(letters, k=rng.randint(1, 30))
        elif p % 4 == 1:  # planted edits
            new = [t + "!" if rng.random() < 0.2 else t for t in old if rng.random() < 0.9] or ["z"]
            new.insert(rng.randint(0, len(new)), "added")
        elif p % 4 == 2:  # distinct texts, a stretch of them moved
            old = rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 26))
            cut = sorted(rng.choices(range(len(old) + 1), k=3))
            new = old[: cut[0]] + old[cut[1] : cut[2]] + ["X"] + old[cut[0] : cut[1]] + old[cut[2] :]
        else:
            new = list(old)
            new[rng.randrange(len(new))] = rng.choice("abZ")
        lists.append((old, new))
    rows = [(p * 2 + s, 10 * i + 7, None, t) for p, pair in enumerate(lists) for s, ts in enumerate(pair) for i, t in enumerate(ts)]
    rng.shuffle(rows)
    pairs = spark.createDataFrame([(p, p * 2, p * 2 + 1) for p in range(400)], "pair_id int, from_version int, to_version int")
    at = lambda ordinal: None if ordinal is None else (ordinal - 7) // 10 + 1
    got = {p: [] for p in range(400)}
    for r in V.align_clauses(pairs, spark.createDataFrame(rows, CLAUSES)).collect():
        got[r.pair_id].append((r.block_no, r.place, at(r.old_ordinal), at(r.new_ordinal)))
    for p, (old, new) in enumerate(lists):
        assert sorted(got[p], key=lambda r: r[:2]) == _changes(old, new), (old, new)


def test_long_lists_with_repeats():
    """Blocks of lists in which every clause repeats, without a step for each equal pair."""
    rng = random.Random(3)
    for size, letters in ((3000, "abc"), (20_000, "r")):
        a, b = rng.choices(letters, k=size), rng.choices(letters, k=size)
        found = V.matching_blocks(a, [False] * size, b, [False] * size)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
        if size == 3000:
            match = difflib.SequenceMatcher(None, a, b, autojunk=False)
            pairs = lambda blocks: {(i + k, j + k) for i, j, n in blocks for k in range(n)}
            assert pairs(found) == pairs(match.get_matching_blocks())


def test_places_cover_both_sides_in_order(spark):
    """Whatever the lists, kept clauses are equal and in order, and every other one is reported."""
    rng = random.Random(7)
    lists = [["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(60)] for _ in (0, 1)]
    rows = [(p * 2 + s, i + 1, None, t) for s in (0, 1) for p, ts in enumerate(lists[s]) for i, t in enumerate(ts)]
    pairs = spark.createDataFrame([(p, p * 2, p * 2 + 1) for p in range(60)], "pair_id int, from_version int, to_version int")
    got = {p: ([], []) for p in range(60)}
    for r in V.align_clauses(pairs, spark.createDataFrame(rows, CLAUSES)).collect():
        got[r.pair_id][0].append(r.old_ordinal)
        got[r.pair_id][1].append(r.new_ordinal)
    for p in range(60):
        kept = [[t for i, t in enumerate(lists[s][p], 1) if i not in got[p][s]] for s in (0, 1)]
        assert kept[0] == kept[1]


def test_one_moved_clause_removes_only_itself(spark):
    assert _places(spark, "abcdefgh", "hbcXdefga") == [(0, 1, 1), (2, None, 4), (6, 8, 9)]
    old = [f"clause {i}" for i in range(1000)]
    assert len(_places(spark, old, [old[-1], *old[1:500], "added", *old[500:-1], old[0]])) == 3


def test_moves_keep_as_many_clauses_as_the_matcher(spark):
    rng = random.Random(11)
    old = [rng.sample("abcdefghijkl", rng.randint(1, 12)) for _ in range(40)]
    new = [rng.sample(texts, len(texts)) + ["X"] for texts in old]
    rows = [(p * 2 + s, i + 1, None, t) for s, side in enumerate((old, new)) for p, ts in enumerate(side) for i, t in enumerate(ts)]
    pairs = spark.createDataFrame([(p, p * 2, p * 2 + 1) for p in range(40)], "pair_id int, from_version int, to_version int")
    kept = [len(texts) for texts in old]
    for r in V.align_clauses(pairs, spark.createDataFrame(rows, CLAUSES)).collect():
        kept[r.pair_id] -= r.old_ordinal is not None
    for p in range(40):
        match = difflib.SequenceMatcher(None, old[p], new[p], autojunk=False)
        assert kept[p] >= sum(block.size for block in match.get_matching_blocks())


def _redline(spark, text, edits):
    clauses = spark.createDataFrame([("c", text)], "clause_id string, text string")
    rows = [("c", i + 1, a, b) for i, (a, b) in enumerate(edits)]
    df = spark.createDataFrame(rows, "clause_id string, edit_no int, original_text string, revised_text string")
    out = E.accept_all(E.reject_all(E.apply_edits(clauses, df))).first()
    assert out.rejected_text == text
    return out.tracked, out.comment_only, out.accepted_text


def test_edits_apply_in_order_to_the_remaining_text(spark):
    assert _redline(spark, "pay in 30 days", [("30 days", "14 days")]) == (1, 0, "pay in 14 days")
    assert _redline(spark, "a b c b", [("b", "X"), ("b", "Y")]) == (2, 0, "a X c Y")
    assert _redline(spark, "a b", [("zzz", "X")]) == (0, 1, "a b")
    assert _redline(spark, "a b", [("b", "X"), ("a", "Y")]) == (1, 1, "a X")


def test_unresolved_and_open_comment_ranges(spark):
    runs = spark.createDataFrame(
        [(1, 0, None, " one "), (1, 70, None, "two"), (1, 71, "del", "gone"), (1, 140, "ins", "three ")],
        "doc_id int, pos int, kind string, text string",
    )
    ranges = spark.createDataFrame(
        [(1, "1", 0, 140), (1, "2", 70, 71), (1, "3", 5, None), (1, "4", 10, 20)],
        "doc_id int, comment_id string, start_pos int, end_pos int",
    )
    got = {r.comment_id: r.anchor_text for r in V.anchor_comments(ranges, runs).collect()}
    assert got == {"1": "one twothree", "2": "two", "3": None, "4": ""}


def test_revisions(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0, None, None, "pay "), (1, 0, 1, "del", "b", "30"), (1, 0, 2, "ins", "a", "14"), (1, 1, 3, None, None, "same"),
         (1, 2, 4, "ins", "", "new")],
        "doc_id int, para int, pos int, kind string, author string, text string",
    )
    rows = V.revision_texts(runs)
    assert [(r.para, r.original_text, r.revised_text, r.authors) for r in rows.orderBy("para").collect()] == [
        (0, "pay 30", "pay 14", ["a", "b"]),
        (2, "", "new", []),
    ]
    kinds = V.revisions_to_diff(rows).orderBy("block_no").select("change_kind", "clause_ref").collect()
    assert [tuple(k) for k in kinds] == [("modified", "Paragraf 1"), ("added", "Paragraf 3")]


def test_unknown_materiality_needs_review(spark):
    df = spark.createDataFrame(
        [("material", "ok"), ("immaterial", "ok"), (None, "failed"), ("odd", "ok"), (None, None)],
        "materiality string, classification_status string",
    )
    assert [r.bucket for r in V.display_bucket(df).collect()] == ["material", "immaterial"] + ["needs_review"] * 3


def test_anchors_move_less_than_their_texts(spark):
    """Overlapping ranges get their texts where the runs are; pieces of split ones are joined."""
    import random

    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) + " " for _ in range(5000)]
    runs = spark.createDataFrame(
        [(1, i, "del" if i % 9 == 4 else None, w) for i, w in enumerate(words)], "doc_id long, pos int, kind string, text string"
    )
    spans = [(1, str(i), i, i + (i * 7) % 300) for i in range(0, 5000, 2)]
    spans += [(1, "open", 3, None), (1, "none", None, 5), (1, "back", 9, 2), (2, "far", 0, 3), (1, "whole", 0, 5000), spans[7]]
    ranges = spark.createDataFrame(spans, "doc_id long, comment_id string, start_pos int, end_pos int")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        import os

        found = manager.getAllFiles().mkString("\n").split("\n")
        return {x: os.path.getsize(x) for x in found if "/shuffle_" in x and x.endswith(".data")}

    before = shuffled()
    got = {r.comment_id: r.anchor_text for r in V.anchor_comments(ranges, runs).collect()}
    moved = sum(n for x, n in shuffled().items() if x not in before)
    want = {
        c: "".join(w for i, w in enumerate(words) if d == 1 and s <= i <= e and i % 9 != 4).strip()
        if s is not None and e is not None and e >= s
        else None
        for d, c, s, e in spans
    }
    assert got == want
    assert moved < sum(len(t or "") for t in want.values()) / 4
