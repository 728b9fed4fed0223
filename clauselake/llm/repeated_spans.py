"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of ``length`` bytes that starts at two places is found without sorting every
suffix. Each text is sampled at anchors: of the ``K``-byte strings in every window of
``length`` bytes, the one of least hash (the last of equals). Equal windows have their
anchor at the same offset, so two places share a window exactly when their anchors agree
``L`` bytes to the left and ``R`` to the right with ``L + R >= length``. What an anchor
removes is then one run around it, from its largest such ``L`` to its largest ``R``.

1. Anchors whose hash occurs once go. Regions (the union of an anchor's windows) that
   occur more than once are removed whole and stay as one row.
2. The distinct regions are sorted as suffixes from their anchor on, and as reversed
   prefixes from it back: tasks make sorted front-coded runs, the runs are exchanged, and
   a loser tree merges them without comparing known prefixes again. A class (suffixes of
   equal anchors) lies in one range; a large one is cut by sampled splitters. Neighbours in either order give the largest ``L`` and ``R`` there can be, and
   pairs of near neighbours mostly show that they are reached.
3. Where they do not, the windows of the anchor's class are counted by their hashes.

Equal strings are split among tasks by their names, so a passage that a third of all
texts share does not meet in one task.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.front_coding import common, merge, pack, unpack
from clauselake.llm.groups import streamed
from clauselake.llm.kept import release
from clauselake.llm.shingles import (
    BACK,
    BASE,
    PIECE,
    powers,
    scramble,
    small_batches,
    text_bytes,
)
from clauselake.session import discard, stored

RUN = 20_000  # suffixes sorted into a run at once, and about as many in a merged range
NEAR = 4  # neighbours looked at before an entry
SPLITTERS = 20_000  # strings drawn to cut the ranges of large classes, about
LISTED = 100_000  # large classes that are sent to every task; more are joined
PLACE = 21  # bits for a place within a piece of text
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(data: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of every string of ``size`` bytes."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=sums[1:])
        back = BACK if base == BASE else np.uint64(pow(int(base), -1, 1 << 64))
        return scramble((sums[size:] - sums[:-size]) * powers(back, n)[: n - size + 1])


def anchors(data: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """Place, hash, first and last window start of each anchor of one piece of text."""
    grams = window_hashes(data, size)
    span = length - size + 1
    mask = np.uint64((1 << PLACE) - 1)
    low = ((grams >> np.uint64(PLACE)) << np.uint64(PLACE)) | (
        mask - np.arange(len(grams), dtype=np.uint64)
    )
    wide = 1
    while wide * 2 <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    place = (mask - (low & mask)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    return place[first], grams[place[first]], first, last


def text_anchors(text: np.ndarray, length: int, size: int) -> Iterator[tuple[int, ...]]:
    """``place, hash, first window, last window`` for a whole text, in overlapping pieces.

    Pieces share ``length - 1`` bytes, so that each window lies in one of them; an anchor
    at a seam comes with the windows of either piece, which are rows of their own.
    """
    for start in range(0, max(1, len(text) - length + 1), PIECE):
        part = text[start : start + PIECE + length - 1]
        if len(part) >= length:
            place, gram, first, last = anchors(part, length, size)
            yield from zip(
                (place + start).tolist(), gram.tolist(), (first + start).tolist(),
                (last + start).tolist(), strict=True,
            )


def _row_key(doc_id: object, text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16, key=str(doc_id).encode()[:64]).digest()


def _texts(part: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    data, offsets = text_bytes(part.column(1))
    for i, doc_id in enumerate(part.column(0).to_pylist()):
        own = data[offsets[i] : offsets[i + 1]]
        yield _row_key(doc_id, own.tobytes()), own


def _sorted_neighbours(
    contexts: DataFrame, length: int, size: int, back: bool, shelf: list[str]
) -> DataFrame:
    """``region, plus, left, right`` from one sorted order (several rows a region).

    ``plus`` is the most bytes shared with any other region on the sorted side; ``left``
    and ``right`` are the largest of neighbours that share a whole window.
    """
    total = contexts.count()
    ranges = max(1, -(-total // RUN))
    key, aside = ("back_key", "ahead") if back else ("ahead_key", "back")
    # only suffixes of a class share an anchor: a class goes whole to the range of its hash,
    # and those of more than RUN suffixes to ranges cut by a sample of bounded size
    large = stored(
        contexts.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RUN),
        "large",
        shelf,
    )
    classes, many = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    drawn = (
        contexts.join(large, "cls", "left_semi")
        .select(F.col(key).alias("string"), "region")
        .sample(fraction=min(1.0, SPLITTERS / max(1, many)), seed=7)
    )
    picked = sorted((bytes(r[0]), bytes(r[1])) for r in drawn.collect()) if classes else []
    parts = min(-(-many // RUN), len(picked))
    cuts = [picked[len(picked) * i // parts] for i in range(1, parts)]
    marks = large.select("cls", F.lit(True).alias("split"))
    rows = contexts.join(F.broadcast(marks) if classes <= LISTED else marks, "cls", "left").select(
        F.col(key).alias("string"), "region", F.col(aside).alias("other"), "split"
    )

    def target(string: bytes, region: bytes, split: bool | None) -> int:
        if split:
            return ranges + bisect.bisect_right(cuts, (string, region))
        return int.from_bytes(region[:8], "big") % ranges

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes, bool | None]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
            for string, region, other, split in held:
                dealt.setdefault(target(string, region, split), []).append((string, region, other))
            for number, run in dealt.items():
                run.sort()
                coded = pack(run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), *(pa.array([v], pa.binary()) for v in coded.values())],
                    names=["target", *coded],
                )
            held.clear()

        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(held) >= RUN:
                yield from flush()
        if held:
            yield from flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, ["target"]):
            coded = [{k: r[k] for k in r if k != "target"} for r in table.to_pylist()]
            yield from _report(merge([unpack(c) for c in coded]), table["target"][0].as_py())

    def _report(entries: Iterator[tuple], target: int) -> Iterator[pa.RecordBatch]:
        near: list[list] = []  # [string, name, other, plus, left, right, shared with the one before]
        out: list[list] = []
        first = last = None
        for string, name, other, shared in entries:
            if near and near[-1][1] == name:
                continue  # a text that is there twice brings its regions twice
            row = [string, name, other, 0, 0, 0, shared]
            _meet(row, near, length, size, back)
            near.append(row)
            first, last = first or row, row
            if len(near) > NEAR:
                out.append(near.pop(0))
            if len(out) >= 10_000:
                yield _batch(out, target, None, None)
                out = []
        out.extend(near)
        yield _batch(out, target, first, last)

    coded = "target int, shared binary, sizes binary, rest binary, names binary, other_sizes binary, others binary"
    schema = "region binary, plus int, left int, right int, target int, edge int, string binary, other binary"
    made = stored(
        rows.mapInArrow(runs, coded).repartition("target").sortWithinPartitions("target").mapInArrow(merged, schema),
        "neighbours",
        shelf,
    )

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = None
        for batch in batches:
            for r in batch.to_pylist():
                row = [r["string"], r["region"], r["other"], 0, 0, 0, 0]
                if r["edge"] == 1 and above:
                    row[6] = common(above[0], row[0])
                    _meet(row, [above], length, size, back)
                    yield _batch([above, row], r["target"], None, None)
                above = row

    # a large class goes on from range to range: the last of one and the first of the next,
    # two rows per such range, are neighbours too. They meet by class, in the order of ranges
    edges = made.filter(f"edge > 0 AND target >= {ranges}").withColumn(
        "cls", F.substring("region", F.lit(1), F.lit(8))
    )
    edges = edges.repartition("cls").sortWithinPartitions("cls", "target", "edge").drop("cls")
    return made.filter("edge = 0").union(edges.mapInArrow(seams, schema)).select(
        "region", "plus", "left", "right"
    )


def _meet(row: list, near: list[list], length: int, size: int, back: bool) -> None:
    shared = row[6]
    for i in range(len(near) - 1, -1, -1):
        if shared < size:
            return
        other = near[i]
        aside = common(row[2], other[2])
        left, right = (shared - size, size + aside) if back else (aside, shared)
        plus = left if back else right
        for r in (row, other):
            r[3] = max(r[3], plus)
            if left + right >= length:
                r[4], r[5] = max(r[4], left), max(r[5], right)
        shared = min(shared, other[6])


def _batch(rows: list[list], target: int, first: list | None, last: list | None) -> pa.RecordBatch:
    tagged = [(r, 0) for r in rows] + [(r, i) for i, r in ((1, first), (2, last)) if r is not None]
    strings = [r[0] if edge else None for r, edge in tagged]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[1] for r, _ in tagged], pa.binary()),
            *(pa.array([r[k] for r, _ in tagged], pa.int32()) for k in (3, 4, 5)),
            pa.array([target] * len(tagged), pa.int32()),
            pa.array([edge for _, edge in tagged], pa.int32()),
            pa.array(strings, pa.binary()),
            pa.array([r[2] if edge else None for r, edge in tagged], pa.binary()),
        ],
        names=["region", "plus", "left", "right", "target", "edge", "string", "other"],
    )


def _counted_windows(
    unclear: DataFrame, contexts: DataFrame, length: int, shelf: list[str]
) -> DataFrame:
    """Exact ``region, left, right`` of unclear regions, from the windows of their classes."""
    classes = unclear.select("cls").distinct()
    wanted = (
        contexts.join(classes, "cls", "left_semi")
        .join(unclear.select("region", F.lit(1).alias("asked")), "region", "left")
        .select("region", "back", "ahead_key", F.coalesce("asked", F.lit(0)).alias("asked"))
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["back"][::-1] + r["ahead_key"], np.uint8)
                one = window_hashes(data, length)
                two = window_hashes(data, length, OTHER)
                left = len(r["back"]) - np.arange(len(one))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["region"]] * len(one), pa.binary()),
                        pa.array(np.full(len(one), r["asked"], np.int32)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array(left.astype(np.int32)),
                    ],
                    names=["region", "asked", "one", "two", "left"],
                )

    all_windows = stored(
        wanted.mapInArrow(windows, "region binary, asked int, one long, two long, left int"),
        "windows",
        shelf,
    )
    twice = all_windows.groupBy("one", "two").agg(
        F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked")
    ).filter("n > 1 AND asked = 1").select("one", "two")
    return (
        all_windows.filter("asked = 1")
        .join(twice, ["one", "two"])
        .groupBy("region")
        .agg(F.max("left").alias("left"), (F.lit(length) - F.min("left")).alias("right"))
    )


def repeated_spans(
    docs: DataFrame,
    length: int = 400,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
    as_text: bool = False,
    gram: int = 128,
) -> DataFrame:
    """One row per row: ``doc_id``, carried columns, ``n_bytes, spans, kept``.

    ``spans`` are the maximal removed runs ``(start, end)`` in bytes: every byte under a
    string of ``length`` bytes that also starts elsewhere, in the same text or another.
    ``kept`` is binary: the other bytes, joined; with ``as_text`` it is a string, without
    the characters that a run cuts through. A null text counts as empty. Repeated
    rows are places of their own, so their texts repeat each other; null ids are allowed.
    Columns named in ``carry`` come along unchanged, others do not. An empty table gives
    an empty table. ``docs`` is read three times: pass a table, not a long computation.
    """
    small_batches(docs.sparkSession)
    carry = carry or []
    gram = min(gram, length)
    shelf: list[str] = []
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
    )
    kind = slim.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                keys, names, columns = [], [], ([], [], [])
                for key, data in _texts(batch.slice(i, 200)):
                    whole, met = data.tobytes(), {}
                    for place, hashed, first, last in text_anchors(data, length, gram):
                        region = hashlib.blake2b(whole[first : last + length], digest_size=8)
                        name = hashed.to_bytes(8, "big") + region.digest()
                        # a region that a text repeats is one row with all its places
                        met.setdefault(name, ([], place - first, last + length - place))[0].append(place)
                    keys.extend([key] * len(met))
                    names.extend(met)
                    for row in met.values():
                        for c, v in zip(columns, row, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array(names, pa.binary()),
                        pa.array(columns[0], pa.list_(pa.int64())),
                        pa.array(columns[1], pa.int32()),
                        pa.array(columns[2], pa.int32()),
                    ],
                    names=["key", "region", "places", "back", "ahead"],
                )

    found = stored(
        slim.select("doc_id", "text").mapInArrow(
            find, "key binary, region binary, places array<bigint>, back int, ahead int"
        ),
        "anchors",
        shelf,
    ).withColumn("cls", F.substring("region", F.lit(1), F.lit(8)))
    often = found.groupBy("cls").agg(F.sum(F.size("places")).alias("_n")).filter("_n > 1").select("cls")
    regions = stored(
        found.join(often, "cls")
        .withColumn("place", F.get("places", F.lit(0)))
        .groupBy("region")
        .agg(
            F.sum(F.size("places")).alias("n"),
            *[F.first(c).alias(c) for c in ("cls", "key", "place", "back", "ahead")],
        ),
        "regions",
        shelf,
    )
    open_classes = (
        regions.groupBy("cls")
        .agg(F.count(F.lit(1)).alias("_m"), F.min("n").alias("_least"))
        .filter("_m > 1 AND _least = 1")
        .select("cls")
    )
    sought = regions.join(open_classes, "cls").select(
        "key", F.struct("region", "place", "back", "ahead").alias("r")
    )

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = [(key, press.compress(data.tobytes())) for key, data in _texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in range(part.num_columns) if c != 1),
                        pa.array([r[0] for r in rows], pa.binary()),
                        pa.array([r[1] for r in rows], pa.binary()),
                    ],
                    names=["doc_id", *names, "key", "pressed"],
                )

    names = [f"c{i}" for i in range(len(carry))]
    kinds = [f"{n} {slim.schema[n].dataType.simpleString()}" for n in names]
    pressed = slim.mapInArrow(squeeze, ", ".join([f"doc_id {kind}", *kinds, "key binary", "pressed binary"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, places in zip(batch.column(0), batch.column(1), strict=True):
                whole = zstandard.decompress(packed.as_py())
                rows = places.as_py()
                ahead = [whole[r["place"] : r["place"] + r["ahead"]] for r in rows]
                back = [whole[r["place"] - r["back"] : r["place"]][::-1] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["region"] for r in rows], pa.binary()),
                        pa.array(ahead, pa.binary()),
                        pa.array([a[:gram][::-1] + b for a, b in zip(ahead, back, strict=True)], pa.binary()),
                        pa.array(back, pa.binary()),
                        pa.array([a[gram:] for a in ahead], pa.binary()),
                    ],
                    names=["region", "ahead_key", "back_key", "back", "ahead"],
                )

    listed = sought.groupBy("key").agg(F.collect_list("r").alias("r"))  # as long as the text
    contexts = stored(
        pressed.select("key", "pressed")
        .join(listed, "key")
        .select("pressed", "r")
        .mapInArrow(cut, "region binary, ahead_key binary, back_key binary, back binary, ahead binary"),
        "contexts",
        shelf,
    ).withColumn("cls", F.substring("region", F.lit(1), F.lit(8)))
    ahead = _sorted_neighbours(contexts, length, gram, False, shelf).select(
        "region", F.col("plus").alias("right_most"), F.lit(0).alias("left_most"), "left", "right"
    )
    behind = _sorted_neighbours(contexts, length, gram, True, shelf).select(
        "region", F.lit(0).alias("right_most"), F.col("plus").alias("left_most"), "left", "right"
    )
    measured = stored(
        ahead.union(behind)
        .groupBy("region")
        .agg(*[F.max(c).alias(c) for c in ("left_most", "right_most", "left", "right")])
        .join(regions.select("region", "cls", "n"), "region")
        .filter((F.col("n") == 1) & (F.col("left_most") + F.col("right_most") >= length)),
        "measured",
        shelf,
    )
    clear = (F.col("left") == F.col("left_most")) & (F.col("right") == F.col("right_most"))
    decided = (
        regions.filter("n > 1")
        .select("region", F.col("back").alias("left"), F.col("ahead").alias("right"))
        .union(measured.filter(clear).select("region", "left", "right"))
        .union(_counted_windows(measured.filter(~clear), contexts, length, shelf).select("region", "left", "right"))
    )
    runs = stored(
        found.join(decided, "region")
        .select("key", F.struct("places", "left", "right").alias("run"))
        .groupBy("key")
        .agg(F.collect_list("run").alias("runs")),  # as long as the text
        "runs",
    )
    discard(docs.sparkSession, shelf)  # anchors and contexts are nearly as large as the texts

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for packed, runs_ in zip(batch.column(0), batch.column(1), strict=True):
                whole = zstandard.decompress(packed.as_py())
                joined: list[list[int]] = []
                cut = [(p - r["left"], p + r["right"]) for r in runs_.as_py() or [] for p in r["places"]]
                for r in sorted(cut):
                    if joined and r[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], r[1])
                    else:
                        joined.append([*r])
                stops = [0, *(x for r in joined for x in r), len(whole)]
                sizes.append(len(whole))
                spans.append([{"start": a, "end": b} for a, b in joined])
                pieces = [whole[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True)]
                if as_text:
                    kept.append("".join(p.decode("utf-8", "ignore") for p in pieces))
                else:
                    kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[2:],
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.string() if as_text else pa.binary()),
                ],
                names=["doc_id", *names, "n_bytes", "spans", "kept"],
            )

    out = (
        pressed.join(runs, "key", "left")
        .select("pressed", "runs", "doc_id", *names)
        .mapInArrow(
            remove,
            ", ".join([f"doc_id {kind}", *kinds, "n_bytes long",
                       "spans array<struct<start:bigint,end:bigint>>",
                       "kept string" if as_text else "kept binary"]),
        )
    )
    return out.select(
        "doc_id", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "n_bytes", "spans", "kept"
    )
