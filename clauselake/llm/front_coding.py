"""Sorted runs of byte strings, front-coded, and their merge by a loser tree.

A run is sorted by ``(string, name)``. Each entry says how many bytes it shares with the
entry before and holds only the rest. The tree knows for every waiting head how much it
shares with the last string given out, so a match compares two heads only from there on,
and only when both share equally much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NAME = 16  # bytes of an entry's name


def common(x: bytes, y: bytes, at: int = 0) -> int:
    """Length of the common prefix, given that the first ``at`` bytes agree."""
    n = min(len(x), len(y))
    if x[at:n] == y[at:n]:
        return n
    differ = int.from_bytes(x[at:n], "big") ^ int.from_bytes(y[at:n], "big")
    return n - (differ.bit_length() + 7) // 8


def pack(run: list[tuple[bytes, bytes, bytes]]) -> dict[str, bytes]:
    """Columns of a sorted run of ``(string, name, other)``."""
    shared, above = [], b""
    for string, _, _ in run:
        shared.append(common(above, string))
        above = string
    rest = [r[0][k:] for r, k in zip(run, shared, strict=True)]
    return {
        "shared": np.array(shared, np.int32).tobytes(),
        "sizes": np.array([len(r) for r in rest], np.int32).tobytes(),
        "rest": b"".join(rest),
        "names": b"".join(r[1] for r in run),
        "other_sizes": np.array([len(r[2]) for r in run], np.int32).tobytes(),
        "others": b"".join(r[2] for r in run),
    }


def unpack(run: dict[str, bytes]) -> Iterator[tuple[bytes, bytes, bytes, int]]:
    """``(string, name, other, shared with the entry before)`` in order."""
    shared = np.frombuffer(run["shared"], np.int32).tolist()
    sizes = np.frombuffer(run["sizes"], np.int32).tolist()
    others = np.frombuffer(run["other_sizes"], np.int32).tolist()
    above, at, at_other = b"", 0, 0
    for i, (k, size, other) in enumerate(zip(shared, sizes, others, strict=True)):
        above = above[:k] + run["rest"][at : at + size]
        held = run["others"][at_other : at_other + other]
        yield above, run["names"][NAME * i : NAME * (i + 1)], held, k
        at, at_other = at + size, at_other + other


def merge(runs: list[Iterator[tuple[bytes, bytes, bytes, int]]]) -> Iterator[tuple]:
    """All entries in order: ``(string, name, other, shared with the entry given before)``."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    known = [0] * k  # what each head shares with the last winner it met
    losers = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser then knows its share with the winner."""
        x, y = heads[i], heads[j]
        if x is None:
            return j, i
        if y is None or known[i] > known[j]:
            return i, j
        if known[j] > known[i]:
            return j, i
        a, b = x[0], y[0]
        n = common(a, b, known[i])
        if n == len(a):
            first = n < len(b) or x[1] <= y[1]
        else:
            first = n < len(b) and a[n] < b[n]
        if first:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    winner = build(1) if k > 1 else 0
    while (head := heads[winner]) is not None:
        yield head[0], head[1], head[2], known[winner]
        heads[winner] = following = next(runs[winner], None)
        known[winner] = following[3] if following else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
