"""Similarity join on word shingles with a MinHash LSH forest.

Every distinct shingle set has a signature, dealt to ``trees`` labels of ``depth``
values: a label is a path in that tree's prefix trie, and a tree's sorted labels are the
trie's leaves in order.

1. Prefixes are shortened from the full depth, one value at a time, until the share of a
   sample's similar pairs (all rows are searched for them) that agree on one in some tree
   reaches ``recall``, and so does the chance of a pair right at the threshold. Where the
   data need it, prefixes get shorter than that chance alone would have them.
2. The sets under one node of that depth stand together, sorted by label. The walk goes up
   from the deepest common prefixes: at each depth only sets that are new to each other
   there are compared, by whole signatures, and united where their estimate is not far
   below the threshold; what deeper nodes have united is passed over. A node with many sets
   comes in pairs of bounded blocks.
3. Inside the united groups all pairs are verified exactly on their shingle sets, again in
   pairs of blocks, which gives every link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.groups import block_pairs, components, dealt, spread_roots, streamed
from clauselake.llm.kept import release
from clauselake.llm.shingles import shingle_sets, small_batches, text_bytes
from clauselake.session import discard, stored


def stop_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Longest prefix at which a pair at ``threshold`` meets with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def measured_depth(
    classes: DataFrame, threshold: float, trees: int, depth: int, recall: float, sample: int, seed: int
) -> int:
    """Longest prefix that the share ``recall`` of a sample's similar pairs agree on somewhere.

    ``sample`` sets are compared with all by signature; without similar pairs, ``depth``.
    """
    drawn = classes.orderBy(F.xxhash64("sid", F.lit(seed)), "sid").limit(sample).collect()
    if not drawn:
        return depth
    names = {bytes(r["sid"]) for r in drawn}
    paths = np.stack([np.frombuffer(r["paths"], np.uint32) for r in drawn])

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(depth + 1, np.int64)
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                same = paths == np.frombuffer(held, np.uint32)
                for row in np.flatnonzero(same.mean(axis=1) >= threshold):
                    if name not in names or name != bytes(drawn[row]["sid"]):
                        # the longest run of equal leading values of any tree
                        runs = np.logical_and.accumulate(same[row].reshape(trees, depth), axis=1).sum(axis=1)
                        found[runs.max()] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(depth + 1), pa.int32()), pa.array(found)], names=["shared", "pairs"]
        )

    counted = classes.select("sid", "paths").mapInArrow(agreed, "shared int, pairs long")
    pairs = np.zeros(depth + 1, np.int64)
    for r in counted.groupBy("shared").agg(F.sum("pairs").alias("pairs")).collect():
        pairs[r["shared"]] = r["pairs"]
    while depth > 1 and pairs[depth:].sum() < recall * pairs.sum():
        depth -= 1
    return depth


def multipliers(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, count])
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Smallest value of each multiplied hash (its upper half), over the set."""
    low = np.full(len(odd), 0xFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            turned = (shingles[i : i + 512, None] * odd[None, :]) >> np.uint64(32)
            low = np.minimum(low, turned.min(axis=0))
    return low.astype(np.uint32)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal signature bytes of all rows of ``x`` with all of ``y``."""
    out = np.empty((len(x), len(y)), dtype=np.float32)
    for i in range(len(x)):
        out[i] = (x[i] == y).mean(axis=1)
    return out


def shared(sets: list[np.ndarray], others: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets with all others (or among themselves)."""
    both = sets if others is None else sets + others
    sizes = np.array([len(s) for s in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    flat = np.concatenate(both) if both else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
    name = np.cumsum(fresh) - 1
    common = np.bincount(name) > 1 if len(name) else np.zeros(0, bool)
    keep = common[name] if len(name) else np.zeros(0, bool)
    owner, name = owner[keep], (np.cumsum(common) - 1)[name[keep]]
    n = len(sets)
    out = np.zeros((n, n if others is None else len(others)))
    for start in range(0, int(common.sum()), 4096):
        some = (name >= start) & (name < start + 4096)
        ones = np.zeros((len(both), 4096), dtype=np.float32)
        ones[owner[some], name[some] - start] = 1
        out += ones[:n] @ (ones if others is None else ones[n:]).T
    return out


def walk_up(labels: np.ndarray, sigs: np.ndarray, side: np.ndarray | None, level: int, close: float) -> np.ndarray:
    """Smallest united row of each row of one trie node, whose prefix has ``level`` values.

    Nodes below it are met from the deepest on: sets under one child have met before, so
    only sets of different children are compared, unless they are united already. With
    ``side`` a pair counts only between its two sides; the others meet elsewhere.
    """
    order = np.lexsort(labels.T[::-1])
    labels, n = labels[order], len(order)
    same = np.logical_and.accumulate(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    root = np.arange(n)  # of sorted rows
    for depth in range(labels.shape[1], level - 1, -1):
        child = np.cumsum(np.append(True, same <= depth))  # nodes one value deeper
        cuts = [0, *(np.flatnonzero(same < depth) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2 or (root[lo:hi] == root[lo]).all():
                continue
            rows = order[lo:hi]
            fresh = root[lo:hi, None] != root[None, lo:hi]
            if depth < labels.shape[1]:
                fresh &= child[lo:hi, None] != child[None, lo:hi]
            if side is not None:
                fresh &= side[rows][:, None] != side[rows][None, :]
            near = np.zeros_like(fresh)
            asking = np.flatnonzero(fresh.any(axis=1))
            near[asking] = agreement(sigs[rows[asking]], sigs[rows]) >= close
            near &= fresh
            if near.any():
                # rows united deeper down stay so
                joined = near | (root[lo:hi, None] == root[None, lo:hi])
                root[lo:hi] = lo + spread_roots(joined)
    out = np.arange(n)
    out[order] = order[root]
    return out


def _sets(docs: DataFrame, width: int, schema: str, row) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [row(s) for s in shingle_sets(*text_bytes(part.column(1)), width)]
                made = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)

    return docs.mapInArrow(run, schema)


def _name(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    trees: int = 16,
    depth: int = 8,
    recall: float = 0.998,
    slack: float = 0.2,
    sample: int = 64,
    walk_block: int = 256,
    block: int = 64,
    seed: int = 0,
) -> DataFrame:
    """One row per row with an id: ``doc_id, n_links, class_id, kept``.

    Documents link when the Jaccard similarity of their shingle sets reaches the
    threshold. ``n_links`` counts linked rows, equal texts included; ``class_id`` is the
    smallest id reachable by links; ``kept`` marks that document. Texts that are null or
    have no words link with nothing; texts of fewer words than ``width`` link with those
    of the same words. Rows with a null id are left out; rows that repeat an id are rows
    of their own. Other columns are not carried. An empty table gives an empty table.
    ``sample`` sets measure how deep prefixes may be.
    """
    odd = multipliers(trees * depth, seed)
    shelf: list[str] = []

    def describe(shingles: np.ndarray) -> tuple[bytes | None, bytes, bytes]:
        if not len(shingles):
            return None, b"", b""
        low = signature(shingles, odd)
        return _name(shingles), (low & 0xFF).astype(np.uint8).tobytes(), low.tobytes()

    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    ).filter(F.col("doc_id").isNotNull())
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = stored(
        _sets(slim, width, f"doc_id {kind}, sid binary, sig binary, paths binary", describe),
        "signatures",
        shelf,
    )
    worded = rows.filter(F.col("sid").isNotNull())
    classes = stored(
        worded.groupBy("sid").agg(
            F.min("doc_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.first("sig").alias("sig"),
            F.first("paths").alias("paths"),
        ),
        "classes",
        shelf,
    )
    level = min(
        stop_depth(threshold, trees, depth, recall),
        measured_depth(classes, threshold, trees, depth, recall, sample, seed),
    )
    step = 4 * depth
    label = F.substring("paths", F.col("tree") * step + 1, F.lit(step))
    nodes = classes.select(
        "sid",
        "paths",
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
    ).select(
        "sid",
        "tree",
        F.xxhash64(F.substring("paths", F.col("tree") * step + 1, F.lit(4 * level))).alias("prefix"),
    )
    close = threshold - slack

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, ["tree", "prefix", "lo", "hi"]):
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8)
            labels = np.frombuffer(b"".join(table["label"].to_pylist()), np.uint32)
            lo = table["block"].to_numpy() == table["lo"].to_numpy()
            root = walk_up(
                labels.reshape(len(table), depth),
                sigs.reshape(len(table), -1),
                None if lo.all() else lo,
                level,
                close,
            )
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                names = table["sid"].combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(moved)), names.take(pa.array(root[moved]))], names=["a", "b"]
                )

    met = block_pairs(nodes, ["tree", "prefix"], "sid", walk_block)
    described = met.join(classes.select("sid", "sig", "paths"), "sid").withColumn("label", label).drop("paths")
    candidates = components(
        dealt(described, ["tree", "prefix", "lo", "hi"], ["sid"]).mapInArrow(walk, "a binary, b binary"),
        shelf,
    )
    members = stored(candidates.select(F.col("node").alias("sid"), "component"), "members", shelf)

    chosen = members.join(classes.select("sid", "least", "copies"), "sid").select(
        F.col("sid").alias("wanted"), F.col("least").alias("doc_id"), "copies"
    )
    texts = slim.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = (
        _sets(texts, width, f"doc_id {kind}, sid binary, shingles binary",
              lambda s: (_name(s), s.tobytes()))
        .join(chosen.select(F.col("wanted").alias("sid"), "doc_id", "copies"), ["sid", "doc_id"])
        .groupBy("sid")
        .agg(F.first("shingles").alias("shingles"), F.first("copies").alias("copies"))
    )
    sets = stored(sets, "sets", shelf)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, ["component", "lo", "hi"]):
            sids = table["sid"].to_pylist()
            own = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
            copies, sizes = table["copies"].to_numpy(), np.array([len(s) for s in own])
            inside = (table["block"].to_numpy() == table["lo"].to_numpy()).all()
            lo = np.flatnonzero(table["block"].to_numpy() == table["lo"].to_numpy())
            hi = lo if inside else np.setdiff1d(np.arange(len(own)), lo)
            both = shared([own[i] for i in lo], None if inside else [own[i] for i in hi])
            union = sizes[lo][:, None] + sizes[hi][None, :] - both
            link = both >= threshold * union - 1e-9
            near = np.zeros((len(own), len(own)), dtype=bool)
            near[np.ix_(lo, hi)] = link
            near |= near.T
            np.fill_diagonal(near, False)
            root = spread_roots(near)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sids, pa.binary()),
                    pa.array([sids[r] for r in root], pa.binary()),
                    pa.array(near @ copies.astype(np.int64)),
                ],
                names=["a", "b", "links"],
            )

    pairs = block_pairs(members, ["component"], "sid", block)
    checked = stored(
        dealt(pairs.join(sets, "sid"), ["component", "lo", "hi"], ["block", "sid"]).mapInArrow(
            verify, "a binary, b binary, links long"
        ),
        "links",
        shelf,
    )
    found = components(checked.filter("links > 0"), shelf)
    least = (
        found.join(classes.select(F.col("sid").alias("node"), "least"), "node")
        .groupBy("component")
        .agg(F.min("least").alias("class_id"))
    )
    named = found.join(least, "component").select(F.col("node").alias("sid"), "class_id")
    links = checked.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    whole = (
        classes.select("sid", "least", "copies")
        .join(named, "sid", "left")
        .join(links, "sid", "left")
        .select(
            "sid",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("class_id", "least").alias("class_id"),
        )
    )
    similar = stored(
        rows.select("doc_id", "sid")
        .join(whole, "sid", "left")
        .select(
            "doc_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            (F.col("doc_id") == F.coalesce("class_id", "doc_id")).alias("kept"),
        ),
        "similar",
    )
    discard(docs.sparkSession, shelf)  # signatures and sets are nearly as large as the texts
    return similar
