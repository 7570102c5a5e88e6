"""Keys and SimHashes of many lines at once, from the grams of their bytes (runs inside tasks).

A changed letter touches no more grams than a gram has bytes, wherever it stands, so lines with changes all over
still have most grams in common. Of each gram a hash is taken; the keys of a line are hashes of a few minima of these under
different orders, and its SimHash takes the majority of each bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from winnowry.llm.textops import mix, pieces, signed, splitmix

#: Bytes of a gram for keys: in lines below ``UPPER`` characters the first, from ``LOWER`` on the second; of similar lines both have one of them.
SHORT, LONG = 6, 7
LOWER, UPPER = 100, 112
#: Keys of a line, and minima in a key.
BANDS, MINIMA = 16, 3
#: Bytes of a gram for SimHashes.
FINE = 4
#: Bytes of lines that are worked on at once, small enough for a core's cache.
BYTES = 1 << 17
VALUES = splitmix(256, 31)
ORDERS = (splitmix(BANDS * MINIMA, 7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Grams that a lane of 16 bits counts at most.
LANE = (1 << 16) - 1


def grams(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of each line, and each line's first; a shorter line is one gram, and none may be empty."""
    size = np.diff(offsets)
    values = np.concatenate([VALUES[data], np.zeros(width, np.uint64)])
    hashes = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            hashes = hashes * FACTOR + values[i : i + len(data)]
        small = np.flatnonzero(size < width)  # lines that no gram fits in, without what comes after them
        begin = (offsets - offsets[0])[:-1][small]
        hashes[begin] = 0
        for i in range(width):
            hashes[begin] = hashes[begin] * FACTOR + np.where(i < size[small], values[begin + i], np.uint64(0))
        hashes = mix(hashes)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    whole = (at + width <= np.repeat(size, size)) | (at == 0)
    count = np.maximum(size - width + 1, 1)
    return hashes[whole], np.cumsum(count) - count


def keys(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """``BANDS`` keys of each line; lines share one with the chance that ``MINIMA`` minima agree."""
    hashes, first = grams(data, offsets, width)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(first), width * BANDS + band, np.uint64)
            for order in ORDERS[band * MINIMA : (band + 1) * MINIMA]:
                key = mix(key ^ np.minimum.reduceat(short * order, first).astype(np.uint64)) + np.uint64(1)
            out[:, band] = key
    return signed(out)


def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the rows that have a line, with ``keys`` in place of it; size is its length in characters."""
    for batch in batches:
        some = batch.filter(pa.array(batch.column("size").to_numpy() > 0))
        for rows, data, offsets in pieces([some], "line", BYTES):
            size = rows.column("size").to_numpy()
            lengths, made = np.diff(offsets), {}
            for width, which in ((SHORT, size < UPPER), (LONG, size >= LOWER)):
                if which.any():
                    made[width] = which, keys(data[np.repeat(which, lengths)], np.concatenate([[0], np.cumsum(lengths[which])]), width)
            count = sum(which.astype(np.int64) for which, _ in made.values()) * BANDS
            first = np.concatenate([[0], np.cumsum(count)])
            flat, filled = np.empty(first[-1], np.int64), first[:-1].copy()
            for which, found in made.values():
                flat[(filled[which][:, None] + np.arange(BANDS)).ravel()] = found.ravel()
                filled[which] += BANDS
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
            names = [c for c in rows.schema.names if c != "line"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), lists], [*names, "keys"])


def simhashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each line: bit i is set if most of its grams' hashes have it. Four counters of 16 bits share a word."""
    hashes, first = grams(data, offsets, FINE)
    count = np.diff(np.append(first, len(hashes)))
    parts = -(-count // LANE)  # of a line too long for the counters
    owner = np.repeat(np.arange(len(first)), parts)
    begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * LANE
    of_line = np.cumsum(parts) - parts
    out = np.zeros(len(first), np.uint64)
    lanes, lowest = np.uint64(0x0001000100010001), np.uint64(0xFFFF)
    for i in range(16):
        summed = np.add.reduceat((hashes >> np.uint64(i)) & lanes, begin)
        for lane in range(4):
            votes = np.add.reduceat((summed >> np.uint64(16 * lane)) & lowest, of_line).astype(np.int64)
            out |= (2 * votes > count).astype(np.uint64) << np.uint64(i + 16 * lane)
    return signed(out)


def signs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, size, sim) of lines (id, size, line)."""
    for rows, data, offsets in pieces(batches, "line", BYTES):
        yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("size"), pa.array(simhashes(data, offsets))], ["id", "size", "sim"])
