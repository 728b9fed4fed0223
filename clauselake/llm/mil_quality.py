"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention learned
from document labels alone weighs the passages, and the weighted mean representation is
scored. Only texts and labels are looked at.

Training uses a bounded sample of labelled documents (``sample`` documents, of
``sample_bytes`` together) and every passage of each. Scoring reads every passage of every
document in the document's own partition; passages are streamed in pieces of bounded
size, as softmax sums can be carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.kept import release
from clauselake.llm.shingles import small_batches, text_bytes

PASSAGE = 512  # bytes
BINS = 512  # hashed pairs of byte classes
EXTRA = 8
STEP = 1024  # passages encoded at once


def _byte_classes() -> np.ndarray:
    """Lower letters stand for themselves, upper letters and digits are one class each."""
    kinds = np.arange(256, dtype=np.uint16)
    kinds[65:91] = 65
    kinds[48:58] = 48
    kinds[9:14] = 10
    kinds[128:192] = 128
    kinds[192:] = 192
    return kinds


CLASSES = _byte_classes()


def passage_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row per passage ``data[start:end]``: root-scaled shares of pairs, and a few rates."""
    n = len(starts)
    sizes = (ends - starts).astype(np.int64)
    out = np.zeros((n, BINS + EXTRA), dtype=np.float32)
    if sizes.sum() == 0:
        return out
    own = np.repeat(np.arange(n), sizes)
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    byte = data[at]
    kind = CLASSES[byte].astype(np.uint32)
    following = np.append(kind[1:], 0)
    last = np.append(own[1:] != own[:-1], True)
    code = ((kind * 0x9E37 + following * 0x85EB) >> 3) % BINS
    keep = ~last
    pairs = np.bincount(own[keep] * BINS + code[keep], minlength=n * BINS).reshape(n, BINS)
    share = pairs / np.maximum(1, sizes - 1)[:, None]
    out[:, :BINS] = np.sqrt(share)
    size = np.maximum(1, sizes)
    rates = [
        (byte >= 65) & (byte < 91),
        (byte >= 97) & (byte < 123),
        (byte >= 48) & (byte < 58),
        (byte == 32) | (byte == 10),
        byte >= 128,
    ]
    for i, hit in enumerate(rates):
        out[:, BINS + i] = np.bincount(own[hit], minlength=n) / size
    out[:, BINS + 5] = (share**2).sum(axis=1) * 10
    out[:, BINS + 6] = (pairs > 0).sum(axis=1) / size
    out[:, BINS + 7] = np.log1p(sizes) / 6
    return out


def _cuts(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(start, max(end, start + 1), PASSAGE)
    return starts, np.minimum(starts + PASSAGE, end)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the encoder (w, b), the gates (v, u, a) and the head (c, d)."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representation and attention logit of each passage."""
        p = self.weights
        h = np.tanh(((x - self.mean) / self.scale) @ p["w"] + p["b"])
        return h, (np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"])) @ p["a"]

    def score(self, data: np.ndarray, start: int, end: int) -> float:
        """Score of one document, its passages taken in pieces."""
        starts, ends = _cuts(start, end)
        top, total, mass = -np.inf, 0.0, 0.0
        for i in range(0, len(starts), STEP):
            h, e = self.encode(passage_features(data, starts[i : i + STEP], ends[i : i + STEP]))
            high = max(top, float(e.max()))
            share = np.exp(e - high)
            fade = np.exp(top - high)
            total = total * fade + share @ h
            mass, top = mass * fade + share.sum(), high
        return float(_sigmoid((total / mass) @ self.weights["c"] + self.weights["d"])[0])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of consecutive documents; short ones are encoded together."""
        out = np.zeros(len(offsets) - 1)
        held: list[int] = []
        count = 0

        def flush() -> None:
            if not held:
                return
            cuts = [_cuts(int(offsets[i]), int(offsets[i + 1])) for i in held]
            sizes = np.array([len(c[0]) for c in cuts])
            first = np.cumsum(sizes) - sizes
            x = passage_features(
                data, np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
            )
            h, e = self.encode(x)
            top = np.maximum.reduceat(e, first)
            share = np.exp(e - np.repeat(top, sizes))
            mean = np.add.reduceat(h * share[:, None], first) / np.add.reduceat(share, first)[:, None]
            out[held] = _sigmoid(mean @ self.weights["c"] + self.weights["d"])[:, 0]
            held.clear()

        for i in range(len(out)):
            passages = max(1, -(-int(offsets[i + 1] - offsets[i]) // PASSAGE))
            if passages > STEP:
                out[i] = self.score(data, int(offsets[i]), int(offsets[i + 1]))
                continue
            if count + passages > STEP:
                flush()
                count = 0
            held.append(i)
            count += passages
        flush()
        return out


def fit(
    bags: list[np.ndarray], labels: np.ndarray, rounds: int = 30, seed: int = 0,
    hidden: int = 24, gate: int = 12, rate: float = 0.003, decay: float = 1e-4, steps: int = 400,
) -> Model:
    """Train by Adam on document labels, ``rounds`` times and ``steps`` steps at least; classes
    weigh alike by half.

    Without both classes the model answers the only label's share for every document.
    """
    rng = np.random.default_rng(seed)
    width = bags[0].shape[1] if bags else BINS + EXTRA
    x = np.concatenate(bags) if bags else np.zeros((1, width), dtype=np.float32)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.01
    p = {
        "w": rng.normal(0, width**-0.5, (width, hidden)),
        "b": np.zeros(hidden),
        "v": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "u": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "a": rng.normal(0, gate**-0.5, gate),
        "c": np.zeros((hidden, 1)),
        "d": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    y = np.asarray(labels, dtype=np.float32)
    if len(set(y.tolist())) < 2:
        p["d"][:] = 0 if not len(y) else 3 * (2 * y[0] - 1)
        return Model(p, mean, scale)
    x = ((x - mean) / scale).astype(np.float32)
    sizes = np.array([len(b) for b in bags])
    first = np.cumsum(sizes) - sizes
    weigh = np.where(y == 1, (len(y) / (2 * y.sum())) ** 0.5, (len(y) / (2 * (1 - y).sum())) ** 0.5)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, parts = 0, max(1, len(bags) // 64)
    for _ in range(max(rounds, -(-steps // parts))):
        deal = rng.permutation(len(bags))
        for chosen in np.array_split(deal, parts):
            n = sizes[chosen]
            at = np.cumsum(n) - n
            rows = np.repeat(first[chosen] - at, n) + np.arange(n.sum())
            part = x[rows]
            own = np.repeat(np.arange(len(chosen)), n)
            h = np.tanh(part @ p["w"] + p["b"])
            t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
            e = (t * g) @ p["a"]
            share = np.exp(e - np.maximum.reduceat(e, at)[own])
            share /= np.add.reduceat(share, at)[own]
            z = np.add.reduceat(h * share[:, None], at)
            out = _sigmoid(z @ p["c"] + p["d"])[:, 0]
            back = ((out - y[chosen]) * weigh[chosen] / len(chosen))[:, None]
            dz = back @ p["c"].T
            dh = dz[own] * share[:, None]
            da = (dz[own] * h).sum(axis=1)
            de = share * (da - np.add.reduceat(share * da, at)[own])
            dt = de[:, None] * p["a"] * g * (1 - t**2)
            dg = de[:, None] * p["a"] * t * g * (1 - g)
            dh += dt @ p["v"].T + dg @ p["u"].T
            inner = dh * (1 - h**2)
            grads = {
                "w": part.T @ inner, "b": inner.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg,
                "a": (t * g).T @ de, "c": z.T @ back, "d": back.sum(axis=0),
            }
            step += 1
            for k, grad in grads.items():
                grad = grad + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                fixed = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                p[k] -= (fixed * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
    return Model(p, mean, scale)


def bag(data: bytes) -> np.ndarray:
    """Features of all passages of one text."""
    whole = np.frombuffer(data, dtype=np.uint8)
    return passage_features(whole, *_cuts(0, len(whole)))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 16 << 20, seed: int = 0
) -> Model:
    """Fit on labelled documents outside the held-out fifth, drawn by hash, with whole texts.

    ``labels`` is ``doc_id, label`` (0 or 1; null labels and ids are left out; of
    differing labels of one id the larger counts). Documents are drawn until there are
    ``sample`` of them or their texts have ``sample_bytes`` together; a text that alone has
    more than the rest of that is passed over.
    """
    drawn = (
        labels.select("doc_id", F.col("label").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers on the broadcast side
    rows = (
        docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
        .filter(F.octet_length("data") <= sample_bytes)
        .join(F.broadcast(drawn), "doc_id")
    )
    sized = rows.select("doc_id", F.octet_length("data").alias("n"), F.xxhash64("data").alias("h"))
    order = (F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "h", "n")
    left, taken = sample_bytes, []
    for r in sized.orderBy(*order).limit(sample).collect():  # three numbers a row
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["doc_id"], r["h"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, h long").distinct()
    chosen = rows.join(
        F.broadcast(picked), (rows["doc_id"] == picked["doc_id"]) & (F.xxhash64(rows["data"]) == picked["h"])
    ).select(rows["doc_id"], "h", "label", "data")
    bags, marks = [], []
    for row in chosen.orderBy("doc_id", "h").limit(len(taken)).toLocalIterator():
        bags.append(bag(bytes(row["data"])))
        marks.append(row["label"])
    return fit(bags, np.array(marks), seed=seed)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, score`` and the columns named in ``carry``, for every row.

    A null or empty text is a bag of one empty passage. Null ids and repeated rows are
    kept; columns not named are not carried. The weights are some tens of kilobytes and
    travel with the function.
    """
    small_batches(docs.sparkSession)
    carry = carry or []
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                data, offsets = text_bytes(part.column(1))
                found = pa.array(model.scores(data, offsets), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), found, *part.columns[2:]], names=["doc_id", "score", *names]
                )

    slim = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
    )
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    listed = [f"doc_id {kinds['doc_id']}", "score double", *[f"{n} {kinds[n]}" for n in names]]
    return slim.mapInArrow(run, ", ".join(listed)).select(
        "doc_id", "score", *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)]
    )
