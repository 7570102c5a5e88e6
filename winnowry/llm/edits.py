"""Edit distances of many pairs of lines at once (runs inside tasks).

The table of distances of a pair is gone through by its antidiagonals, of which only the cells within the
allowed distance of the main diagonal are kept. A step works on the same antidiagonal of all pairs of a batch,
so the cost of a pair is its length times the distance allowed and not the square of its length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells that a step works on, and characters of a batch of pairs.
CELLS, CHARS = 1 << 15, 1 << 22
#: Distance that the first round allows.
FIRST = 32
#: Steps after which pairs that are too far apart are left out.
LOOK = 64
#: Code points, and the two fillers that no character equals.
POINTS, BEFORE, AFTER = 0x110000, 0, 1


def shared(x: str, y: str) -> int:
    """Characters that both begin with."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def middles(x: str, y: str) -> tuple[str, str]:
    """Both without what they begin and end with alike, which leaves their distance as it is."""
    p = shared(x, y)
    x, y = x[p:], y[p:]
    q = shared(x[::-1], y[::-1])
    return x[: len(x) - q], y[: len(y) - q]


def points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def columns(codes: np.ndarray, sizes: np.ndarray, rows: int, front: int, fill: int, backwards: bool) -> np.ndarray:
    """A column for each text, from row ``front`` down, or from there up."""
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((rows, len(sizes)), fill, codes.dtype)
    out[front - at if backwards else front + at, np.repeat(np.arange(len(sizes)), sizes)] = codes
    return out


def batch_distances(xs: list[str], ys: list[str], caps: np.ndarray) -> np.ndarray:
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    far = int(caps.max())
    cx, cy = points(xs), points(ys)
    there = np.zeros(POINTS, bool)
    there[cx] = there[cy] = True
    known = np.flatnonzero(there)
    kind = np.uint8 if len(known) < 254 else np.uint32
    table = np.zeros(POINTS, kind)
    table[known] = np.arange(2, len(known) + 2)
    width = far + far % 2  # diagonals from -width to width
    pad, last = width + 2, int((n + m).max())
    long_x, long_y = int(n.max()), int(m.max())
    rows = max(long_x, long_y, last // 2 + 1) + 2 * pad + width
    x = columns(table[cx], n, rows, pad, BEFORE, False)
    foot = rows - 1 - pad
    y = columns(table[cy], m, rows, foot, AFTER, True)

    cell = np.uint8 if far < 250 else np.uint32
    most = cell(far + 1)
    even = np.full((width + 1, len(n)), most, cell)
    even[width // 2] = 0
    odd = np.full((width + 2, len(n)), most, cell)  # with a row of the most before and after
    limit = np.full((width + 1, len(n)), most, cell)  # as an array, with which numpy is ten times as quick as with one value
    out = np.where(n + m == 0, 0, far + 1)
    total, diagonal, pair = n + m, n - m, np.arange(len(n))
    order = np.argsort(total, kind="stable")
    ends = np.searchsorted(total[order], np.arange(last + 2))
    for s in range(1, last + 1):
        part = s % 2
        lo = (s + part - width) // 2 - 1  # of the first cell: its place in x, from 0
        there_y = (s - part + width) // 2 - 1
        count = width + 1 - part
        differ = (x[pad + lo : pad + lo + count] != y[foot - there_y : foot - there_y + count]).view(np.uint8)
        if part:
            own, step = odd[1:-1], np.minimum(even[:-1], even[1:])
        else:
            own, step = even, np.minimum(odd[:-1], odd[1:])
        step += cell(1)
        np.add(own, differ, out=own, casting="unsafe")
        np.minimum(own, step, out=own)
        np.minimum(own, limit[:count], out=own)
        if ends[s] < ends[s + 1]:
            done = order[ends[s] : ends[s + 1]]
            out[pair[done]] = own[(diagonal[done] + width - part) // 2, done]
        if s % LOOK == 0:
            open_ = (np.minimum(even.min(0), odd.min(0)) <= caps[pair]) & (total > s)
            if np.count_nonzero(open_) < 0.8 * len(open_):
                x, y, even, odd, limit = (np.ascontiguousarray(z[:, open_]) for z in (x, y, even, odd, limit))
                total, diagonal, pair = total[open_], diagonal[open_], pair[open_]
                if not len(pair):
                    break
                order = np.argsort(total, kind="stable")
                ends = np.searchsorted(total[order], np.arange(last + 2))
    return out


def distances(xs: Sequence[str], ys: Sequence[str], caps: np.ndarray) -> np.ndarray:
    """The edit distance of each pair, or one more than its cap where it exceeds that."""
    n, m = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    size, caps = np.maximum(n, m), np.minimum(np.asarray(caps, np.int64), np.maximum(n, m))
    out = np.where(np.minimum(n, m) == 0, size, -1)
    out[np.abs(n - m) > caps] = np.iinfo(np.int64).max
    todo = np.flatnonzero(out < 0)
    todo = todo[np.lexsort((size[todo], caps[todo]))]
    lo = 0
    while lo < len(todo):
        hi, longest = lo, 0
        while hi < len(todo):
            longest = max(longest, int(size[todo[hi]]))
            widest = int(caps[todo[hi]]) + 1
            if hi > lo and ((hi - lo + 1) * widest > CELLS or (hi - lo + 1) * (longest + 3 * widest) > CHARS):
                break
            hi += 1
        some = todo[lo:hi]
        out[some] = batch_distances([xs[i] for i in some], [ys[i] for i in some], caps[some])
        lo = hi
    return np.minimum(out, caps + 1)


def similar(xs: Sequence[str], ys: Sequence[str], similarity: float) -> np.ndarray:
    """Whether the edit similarity of each pair is reached, exactly, whatever the lengths.

    Each round allows four times the distance of the one before, up to what the similarity allows, so a pair costs its length times its own distance.
    """
    most = np.array([int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(xs, ys, strict=True)], np.int64)
    linked, open_ = np.zeros(len(most), bool), []
    pairs = {}
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if abs(len(x) - len(y)) > most[i]:
            continue
        u, v = middles(x, y)
        if max(len(u), len(v)) <= most[i]:
            linked[i] = True
        else:
            pairs[i] = u, v
            open_.append(i)
    todo, allowed = np.array(open_, np.int64), FIRST
    while len(todo):
        caps = np.minimum(most[todo], allowed)
        near = distances([pairs[i][0] for i in todo], [pairs[i][1] for i in todo], caps) <= caps
        linked[todo[near]] = True
        todo = todo[~near & (caps < most[todo])]
        allowed *= 4
    return linked
