"""Clause-level differences between two versions, and what is read from them.

Clauses: ``version_id, ordinal, heading_path, text``. Pairs: ``pair_id,
from_version, to_version``. Diff rows: ``pair_id, seq, change_kind, clause_ref,
before_text, after_text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import running_total
from clauselake.functions.text import strip
from clauselake.operators.segment import reference


def prior_version(versions: DataFrame) -> DataFrame:
    """Version n with n-1 of the same document; a gap in the numbers has no prior."""
    prior = versions.select(
        "document_id",
        (F.col("version_no") + 1).alias("version_no"),
        F.col("version_id").alias("prior_version_id"),
    )
    return versions.join(prior, ["document_id", "version_no"], "left")


def _sides(pairs: DataFrame, clauses: DataFrame) -> DataFrame:
    """``pair_id, side, ordinal, key`` of both versions of every pair; no text moves."""
    keys = clauses.select(
        F.col("version_id").alias("_v"), "ordinal", F.xxhash64("text", F.length("text")).alias("key")
    )
    sides = F.array(
        F.struct(F.lit("old").alias("side"), F.col("from_version").alias("_v")),
        F.struct(F.lit("new").alias("side"), F.col("to_version").alias("_v")),
    )
    return pairs.select("pair_id", F.inline(sides)).join(keys, "_v").drop("_v").repartition("pair_id")


def _pieces(sides: DataFrame) -> DataFrame:
    """Clauses with their place, cut where no matching block can cross or span the cut.

    A cut lies between texts that both sides have when those before it stand wholly before
    those after it on either side, and a clause that one side alone has lies in between. So
    every block lies in one piece, and matching the pieces apart is matching the whole.
    ``_common``: the other side has the text; ``_plain``: each text of the piece occurs once
    on either side and all keep their order, so that all of them match.
    """
    old, new = F.col("side") == "old", F.col("side") == "new"
    of_pair = Window.partitionBy("pair_id")
    listed = sides.withColumn(
        "_at", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("ordinal"))
    )
    filled = listed.withColumn("_sides", F.max(old).over(of_pair) & F.max(new).over(of_pair)).filter("_sides")
    same = Window.partitionBy("pair_id", "key")
    known = filled.withColumns(
        {
            "_old": F.count_if(old).over(same),
            "_new": F.count_if(new).over(same),
            "_old_first": F.min(F.when(old, F.col("_at"))).over(same),
            "_old_last": F.max(F.when(old, F.col("_at"))).over(same),
            "_new_first": F.min(F.when(new, F.col("_at"))).over(same),
            "_new_last": F.max(F.when(new, F.col("_at"))).over(same),
        }
    ).withColumn("_common", (F.col("_old") > 0) & (F.col("_new") > 0))
    pair = Window.partitionBy("pair_id", "_common")
    onward = pair.orderBy(F.desc("_old_first")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = pair.orderBy("_old_first").rangeBetween(Window.unboundedPreceding, -1)
    upto = pair.orderBy("_old_first").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = known.withColumn("_new_from", F.min("_new_first").over(onward)).withColumns(
        {"_old_upto": F.max("_old_last").over(before), "_new_upto": F.max("_new_last").over(before)}
    )
    old_step = F.col("_old_first") - F.coalesce("_old_upto", F.lit(0))
    new_step = F.col("_new_from") - F.coalesce("_new_upto", F.lit(0))
    cut = (old_step > 0) & (new_step > 0) & ((old_step > 1) | (new_step > 1))
    ordered = (F.col("_old") == 1) & (F.col("_new") == 1) & (
        F.col("_new_first") > F.coalesce("_new_upto", F.lit(0))
    )
    piece = Window.partitionBy("pair_id", "_common", "_piece")
    return (
        bounded.withColumns({"_piece": F.count_if(cut).over(upto), "_ordered": ordered})
        .withColumn("_start", F.row_number().over(piece.orderBy("side", "_at")) == 1)
        .withColumn("_plain", F.coalesce(F.min("_ordered").over(piece), F.lit(False)))
        .select("pair_id", "side", "ordinal", "key", "_at", "_common", "_piece", "_plain", "_start")
    )


def _longest(a: list, a_gap: list, b: list, b_gap: list, region: tuple) -> tuple[int, int, int]:
    """``i, j, length`` of the longest block of a region, the first in ``a``, then in ``b``.

    The substrings of ``b`` are held in a suffix automaton, so repeats cost no more than
    other clauses. A gap before a clause (a text of one side alone) ends a block.
    """
    a_from, a_to, b_from, b_to = region
    link, size, end, steps = [-1], [0], [-1], [{}]
    last = 0
    for j in range(b_from, b_to):
        for symbol in ((None, j), b[j]) if b_gap[j] else (b[j],):
            state = len(size)
            link.append(0), size.append(size[last] + 1), end.append(j), steps.append({})
            at = last
            while at >= 0 and symbol not in steps[at]:
                steps[at][symbol] = state
                at = link[at]
            if at >= 0:
                onto = steps[at][symbol]
                if size[onto] != size[at] + 1:
                    twin = len(size)
                    link.append(link[onto]), size.append(size[at] + 1)
                    end.append(end[onto]), steps.append(dict(steps[onto]))
                    while at >= 0 and steps[at].get(symbol) == onto:
                        steps[at][symbol] = twin
                        at = link[at]
                    link[onto] = twin
                    onto = twin
                link[state] = onto
            last = state
    state = n = best = 0
    found = (0, 0, 0)
    for i in range(a_from, a_to):
        if a_gap[i]:
            state = n = 0
        while state and a[i] not in steps[state]:
            state = link[state]
            n = size[state]
        if a[i] in steps[state]:
            state, n = steps[state][a[i]], n + 1
        if n > best:
            best, found = n, (i - n + 1, end[state] - n + 1, n)
    return found


def matching_blocks(a: list, a_gap: list, b: list, b_gap: list) -> list[tuple[int, int, int]]:
    """The longest block, then the longest on either side of it, and so on."""
    blocks, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a_from, a_to, b_from, b_to = region = open_.pop()
        if a_from == a_to or b_from == b_to:
            continue
        i, j, n = _longest(a, a_gap, b, b_gap, region)
        if n:
            blocks.append((i, j, n))
            open_ += [(a_from, i, b_from, j), (i + n, a_to, j + n, b_to)]
    return blocks


def _matched(rows: pa.Table) -> np.ndarray:
    """Which clauses of one piece match, its old side behind its new one."""
    new = rows["side"].to_numpy() == "new"
    place, key = rows["_at"].to_numpy(), rows["key"].to_numpy()
    gap = np.ones(len(new), bool)
    gap[1:] = place[1:] != place[:-1] + 1
    first, hit = int(new.sum()), np.zeros(len(new), bool)
    gap[first : first + 1] = True
    sides = [x[at].tolist() for at in (slice(first, None), slice(0, first)) for x in (key, gap)]
    for i, j, n in matching_blocks(*sides):
        hit[first + i : first + i + n] = True
        hit[j : j + n] = True
    return hit


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add whether each clause matches. Rows come piece by piece; one open piece is held."""

    def given(rows: pa.Table, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        slim = rows.select(["pair_id", "side", "ordinal"]).append_column("hit", pa.array(hit))
        yield from slim.to_batches()

    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        settled = rows["_plain"].to_numpy() | ~rows["_common"].to_numpy()
        yield from given(rows.filter(pa.array(settled)), rows["_common"].to_numpy()[settled])
        rest = rows.filter(pa.array(~settled))
        starts = np.flatnonzero(rest["_start"].to_numpy()).tolist()
        cuts = [0, *starts, len(rest)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k and held:  # a piece starts, so the one held is whole
                whole = pa.concat_tables(held)
                yield from given(whole, _matched(whole))
                held = []
            if hi > lo:
                held.append(rest.slice(lo, hi - lo))
    if held:
        whole = pa.concat_tables(held)
        yield from given(whole, _matched(whole))


def align_clauses(pairs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Changed places per pair: ``block_no, place, old_ordinal, new_ordinal``.

    Clauses match by the longest block of equal texts, then by the longest on either side of
    it, and so on; of blocks as long the first in the old version counts, then the first in
    the new one. Matched clauses cut both sides into blocks; ``block_no`` is the number of
    them before it, and inside a block both sides are paired by place. Pairs without clauses
    on one side are left out: nothing was extracted there.

    A pair's keys pass through windows, and are cut into pieces that match apart (see
    ``_pieces``). Pieces of texts that occur once and keep their order match as they are;
    of the others one at a time is held, with a key and a place for each clause.
    """
    pieces = _pieces(_sides(pairs, clauses))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    flagged = pieces.sortWithinPartitions("pair_id", "_common", "_piece", "side", "_at").mapInArrow(
        _flagged, f"pair_id {kinds['pair_id']}, side string, ordinal {kinds['ordinal']}, hit boolean"
    )
    upto = Window.partitionBy("pair_id", "side").orderBy("ordinal")
    blocks = flagged.repartition("pair_id").withColumn("block_no", F.count_if("hit").over(upto).cast("int"))
    inside = Window.partitionBy("pair_id", "side", "block_no").orderBy("ordinal")
    placed = blocks.filter(~F.col("hit")).withColumn("place", F.row_number().over(inside))
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("ordinal")))
    changed = placed.groupBy("pair_id", "block_no", "place").agg(
        side("old").alias("old_ordinal"), side("new").alias("new_ordinal")
    )
    versions = pairs.select("pair_id", "from_version", "to_version")
    return changed.join(versions, "pair_id").select(
        "pair_id", "from_version", "to_version", "block_no", "place", "old_ordinal", "new_ordinal"
    )


def pair_replaced(places: DataFrame) -> DataFrame:
    """Both sides present: modified; leftovers of a block are removed or added."""
    kind = (
        F.when(F.col("old_ordinal").isNull(), "added")
        .when(F.col("new_ordinal").isNull(), "removed")
        .otherwise("modified")
    )
    return places.withColumn("change_kind", kind)


def drop_whitespace_changes(changes: DataFrame) -> DataFrame:
    """Modified pairs that are equal after a strip are no change."""
    same = strip(F.col("before_text")) == strip(F.col("after_text"))
    return changes.filter(~((F.col("change_kind") == "modified") & F.coalesce(same, F.lit(False))))


def diff_rows(pairs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Added, removed and modified clauses; texts are joined to the changed ordinals only."""
    changes = pair_replaced(align_clauses(pairs, clauses))
    side = clauses.select(
        "version_id", "ordinal", "text", reference(F.col("heading_path"), F.col("ordinal")).alias("ref")
    )
    old = side.toDF("from_version", "old_ordinal", "before_text", "_old_ref")
    new = side.toDF("to_version", "new_ordinal", "after_text", "_new_ref")
    joined = changes.join(old, ["from_version", "old_ordinal"], "left").join(
        new, ["to_version", "new_ordinal"], "left"
    )
    kept = drop_whitespace_changes(joined)
    return kept.select(
        "pair_id",
        "block_no",
        "place",
        "change_kind",
        F.coalesce("_new_ref", "_old_ref").alias("clause_ref"),
        "before_text",
        "after_text",
    )


def number_changes(diffs: DataFrame) -> DataFrame:
    """``seq`` of each change within its pair, from block and place; texts take no part."""
    keys = ["pair_id", "block_no", "place"]
    seq = running_total(diffs.select(*keys), keys[:1], keys[1:], F.lit(1), "seq")
    return diffs.join(seq.withColumn("seq", F.col("seq").cast("int")), keys)


def revision_texts(runs: DataFrame) -> DataFrame:
    """Original and revised text per paragraph from revision-marked runs.

    Runs: ``doc_id, para, pos, kind (null, 'ins', 'del'), author, text``. Kept are
    paragraphs with marks whose two texts differ.
    """
    parts = runs.groupBy("doc_id", "para").agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("_r"),
        F.sort_array(
            F.collect_set(
                F.when(F.col("kind").isin("ins", "del"), F.nullif(F.col("author"), F.lit("")))
            )
        ).alias("authors"),
        F.max(F.coalesce(F.col("kind").isin("ins", "del"), F.lit(False))).alias("_marked"),
    )

    def without(kind: str) -> Column:
        kept = F.filter("_r", lambda r: ~r["kind"].eqNullSafe(kind))
        return strip(F.array_join(F.transform(kept, lambda r: r["text"]), ""))

    texts = parts.filter("_marked").select(
        "doc_id",
        "para",
        without("ins").alias("original_text"),
        without("del").alias("revised_text"),
        "authors",
    )
    return texts.filter("original_text <> revised_text")


def revisions_to_diff(revisions: DataFrame) -> DataFrame:
    """Both texts: modified; only revised: added; only original: removed."""
    original, revised = F.col("original_text"), F.col("revised_text")
    kind = (
        F.when((original != "") & (revised != ""), "modified")
        .when(revised != "", "added")
        .otherwise("removed")
    )
    return revisions.select(
        F.col("doc_id").alias("pair_id"),
        F.col("para").alias("block_no"),
        F.lit(1).alias("place"),
        kind.alias("change_kind"),
        F.concat(F.lit(f"{K.PARAGRAPH_LABEL} "), (F.col("para") + 1).cast("string")).alias("clause_ref"),
        F.nullif(original, F.lit("")).alias("before_text"),
        F.nullif(revised, F.lit("")).alias("after_text"),
    )


def choose_diff_source(pairs: DataFrame, revisions: DataFrame, text_diff: DataFrame) -> DataFrame:
    """Revision marks where they are readable and present, else the text comparison.

    ``pairs`` carries ``tc_parse_status`` (null: not applicable); both diffs are
    keyed by ``pair_id``.
    """
    marked = revisions.select("pair_id").distinct().withColumn("_marks", F.lit(True))
    readable = ~F.col("tc_parse_status").eqNullSafe("failed")
    use = pairs.join(marked, "pair_id", "left").select(
        "pair_id",
        (readable & F.coalesce("_marks", F.lit(False))).alias("_tracked"),
    )
    label = lambda df, name: df.withColumn("diff_source", F.lit(name))
    tracked = revisions.join(use.filter("_tracked"), "pair_id", "left_semi")
    compared = text_diff.join(use.filter("not _tracked"), "pair_id", "left_semi")
    return label(tracked, "tracked_changes").unionByName(label(compared, "text_diff"))


_BLOCKS = 16  # blocks of runs that lie in one row


def anchor_comments(ranges: DataFrame, runs: DataFrame, bucket: int = 64) -> DataFrame:
    """Text inside each comment's range; an open or empty range stays unresolved.

    ``ranges``: ``doc_id, comment_id, start_pos, end_pos``. Runs are packed into blocks of
    ``bucket`` positions, each with its whole visible text, and neighbouring blocks into a
    row. A range comes to the rows it touches, takes inner blocks whole and looks at single
    runs only in the blocks at its two ends; so its text is made where the runs are, and only
    the pieces of a range that touches several rows move. Deleted runs carry no visible text.
    A range that is given twice comes once.
    """
    span = bucket * _BLOCKS
    closed = F.coalesce(F.col("end_pos") >= F.col("start_pos"), F.lit(False))
    first, last = F.floor(F.col("start_pos") / span), F.floor(F.col("end_pos") / span)
    # an open range has no text and may come to any row
    somewhere = F.coalesce(first, F.pmod(F.xxhash64(*ranges.columns), F.lit(span)))
    fields = [c for c in ranges.columns if c != "doc_id"]
    touched = (
        ranges.select("doc_id", F.struct(*fields).alias("_r"), F.explode(F.when(closed, F.sequence(first, last)).otherwise(F.array(somewhere))).alias("_row"))
        .groupBy("doc_id", "_row")
        .agg(F.collect_set("_r").alias("_ranges"))
    )
    at = ["doc_id", "_row"]
    blocks = (
        runs.filter(~F.col("kind").eqNullSafe("del"))
        .select("doc_id", F.floor(F.col("pos") / span).alias("_row"), "pos", F.coalesce("text", F.lit("")).alias("text"))
        # small numbers beside the words: less moves than with a row a run
        .groupBy(*at)
        .agg(
            F.collect_list((F.col("pos") - F.col("_row") * span).cast("smallint" if span < 1 << 15 else "int")).alias("pos"),
            F.collect_list("text").alias("text"),
        )
        .select(*at, F.inline(F.arrays_zip("pos", "text")))
        .select(*at, (F.col("pos") + F.col("_row") * span).alias("pos"), "text")
        .groupBy(*at, F.floor(F.col("pos") / bucket).alias("_b"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_runs"))
        .withColumn("_whole", F.array_join("_runs.text", ""))
        .groupBy(*at)
        .agg(F.sort_array(F.collect_list(F.struct("_b", "_whole", "_runs"))).alias("_blocks"))
    )
    found = touched.join(blocks, at, "left")

    def text(r: Column) -> Column:
        start, end = F.floor(r["start_pos"] / bucket), F.floor(r["end_pos"] / bucket)
        inside = lambda runs: F.filter(runs, lambda x: x["pos"].between(r["start_pos"], r["end_pos"]))
        part = lambda b: F.when(
            (b["_b"] == start) | (b["_b"] == end), F.array_join(F.transform(inside(b["_runs"]), lambda x: x["text"]), "")
        ).otherwise(b["_whole"])
        parts = F.transform(F.filter("_blocks", lambda b: b["_b"].between(start, end)), part)
        return F.coalesce(F.array_join(parts, ""), F.lit(""))

    def is_closed(r: Column) -> Column:
        return F.coalesce(r["end_pos"] >= r["start_pos"], F.lit(False))

    def is_split(r: Column) -> Column:
        return is_closed(r) & (F.floor(r["start_pos"] / span) < F.floor(r["end_pos"] / span))

    def pieces(wanted: Callable[[Column], Column]) -> DataFrame:
        rows = F.transform(
            F.filter("_ranges", wanted),
            lambda r: F.struct(*[r[c].alias(c) for c in fields], F.when(is_closed(r), text(r)).alias("_text")),
        )
        return found.select("doc_id", "_row", F.inline(rows))

    split = (
        pieces(is_split)
        .groupBy(*ranges.columns)
        .agg(F.array_sort(F.collect_list(F.struct("_row", "_text"))).alias("_t"))
        .select(*ranges.columns, F.array_join("_t._text", "").alias("_text"))
    )
    return pieces(lambda r: ~F.coalesce(is_split(r), F.lit(False))).drop("_row").unionByName(split).select(
        *ranges.columns, strip(F.col("_text")).alias("anchor_text")
    )


def order_comments(comments: DataFrame) -> DataFrame:
    """Sort keys per document: numeric when all ids are numbers, else text; stored ordinal."""
    number = F.when(F.col("comment_id").rlike(r"^\d+$"), F.col("comment_id").try_cast("bigint"))
    flags = comments.groupBy("doc_id").agg(F.min(number.isNotNull()).alias("_numeric"))
    return comments.join(flags, "doc_id").select(
        *comments.columns,
        F.when(F.col("_numeric"), number).alias("numeric_key"),
        F.when(~F.col("_numeric"), F.col("comment_id")).alias("text_key"),
        F.coalesce(number, F.lit(0)).alias("ordinal"),
    )


def diff_counts(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by counting each state, never by subtraction."""
    return diffs.groupBy(*keys).agg(
        F.count("*").alias("total_changes"),
        F.count_if(F.col("materiality") == "material").alias("material_count"),
        F.count_if(F.col("materiality") == "immaterial").alias("immaterial_count"),
        F.count_if(F.col("classification_status") == "failed").alias("unclassified_count"),
    )


def diff_order(diffs: DataFrame) -> DataFrame:
    """``display_rank``: material and unclassified changes are 1, the others 2.

    A pair is shown by this rank, then by reference, missing references last; the sort is
    left to whoever shows a pair.
    """
    urgent = (F.col("materiality") == "material") | (F.col("classification_status") == "failed")
    rank = F.when(F.coalesce(urgent, F.lit(False)), 1).otherwise(2)
    return diffs.withColumn("display_rank", rank)


def display_bucket(diffs: DataFrame) -> DataFrame:
    """Total mapping to a bucket: anything unknown needs review and survives the material filter."""
    bucket = (
        F.when(F.col("classification_status") == "failed", "needs_review")
        .when(F.col("materiality").isin(K.MATERIALITIES), F.col("materiality"))
        .otherwise("needs_review")
    )
    return diffs.withColumn("bucket", bucket).withColumn(
        "in_material_view", F.col("bucket") != "immaterial"
    )


def diff_availability(versions: DataFrame, counts: DataFrame, done: DataFrame) -> DataFrame:
    """Five distinct states of a version's diff, plus ``available``.

    ``versions``: output of ``prior_version`` with ``tc_parse_status``; ``counts``:
    ``version_id, total_changes``; ``done``: versions with a finished job.
    """
    finished = done.select("version_id").distinct().withColumn("_done", F.lit(True))
    rows = versions.join(counts.select("version_id", "total_changes"), "version_id", "left").join(
        finished, "version_id", "left"
    )
    state = (
        F.when(F.col("version_no") == 1, "first_version")
        .when(F.col("prior_version_id").isNull(), "prior_missing")
        .when(F.coalesce("total_changes", F.lit(0)) > 0, "available")
        .when(F.col("_done").isNull(), "not_computed")
        .when(F.col("tc_parse_status") == "failed", "unreadable_revisions")
        .otherwise("unchanged")
    )
    return rows.select(*versions.columns, state.alias("diff_state"))


def diff_review_complete(counts: DataFrame) -> DataFrame:
    """Every change classified and the revision layer readable (null status passes)."""
    complete = (F.col("unclassified_count") == 0) & ~F.col("tc_parse_status").eqNullSafe("failed")
    return counts.withColumn("review_complete", complete)


def clause_churn(diffs: DataFrame) -> DataFrame:
    """Changes per document, clause reference and kind across all versions."""
    return diffs.groupBy("document_id", "clause_ref", "change_kind").agg(F.count("*").alias("changes"))
