"""12-character shingles of many lines at once, in numpy: sketches, signatures and exact set sizes.

No query uses this since line dedup runs in native expressions; it holds the plain sets of the tests.

A line's characters are code points; a line of under 12 has no shingle here, as
nothing but an equal line is near it. Hashes of all windows come from four
doublings of a polynomial, so a character costs the same in any line, and
lines are read in stretches of bounded size, however long they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 12
_FACTOR = 0x9E3779B97F4A7C15
_STRETCH, _AT_ONCE = 1 << 18, 1 << 20
EMPTY = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all windows of 12 characters."""
    one = mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR))
    power = lambda n: np.uint64(pow(_FACTOR, n, 2**64))
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    return mixed(eight[: len(codes) - WIDTH + 1] * power(4) + four[8 : 8 + len(codes) - WIDTH + 1])


def characters(lines: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All lines' code points in one array, and the lines' bounds in it (one more than lines)."""
    lines = lines.cast(pa.large_string())
    bounds = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(data) or data.max() < 128:
        return data, bounds
    try:
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    except UnicodeDecodeError:  # not UTF-8: bytes stand for characters
        return data, bounds
    begun = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return codes, begun[bounds]


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of lines (from, to) of about a million characters together; a longer line is alone."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _AT_ONCE, "right")) - 1)
        yield at, to
        at = to


def least_by_bin(codes: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """Per line the least hash in each of 2^bits bins, the bin being a hash's first bits; EMPTY where there is none."""
    out = np.full((len(bounds) - 1, 1 << bits), EMPTY)
    first, last = bounds[:-1], bounds[1:] - WIDTH + 1  # of window starts, the end excluded
    for at in range(0, len(codes) - WIDTH + 1, _STRETCH):
        h = _window_hashes(codes[at : at + _STRETCH + WIDTH - 1])
        low, high = np.searchsorted(bounds[1:], at, "right"), np.searchsorted(first, at + len(h))
        lo, hi = np.maximum(first[low:high], at) - at, np.minimum(last[low:high], at + len(h)) - at
        some = np.flatnonzero(lo < hi)
        if not len(some):
            continue
        ends = np.stack([lo[some], hi[some]], axis=1).ravel()
        bin_of = (h >> np.uint64(64 - bits)).astype(np.uint8)
        for b in range(1 << bits):
            mine = np.append(np.where(bin_of == b, h, EMPTY), EMPTY)
            rows = low + some
            out[rows, b] = np.minimum(out[rows, b], np.minimum.reduceat(mine, ends)[::2])
    return out


def filled(least: np.ndarray) -> np.ndarray:
    """An empty bin takes the next one's hash, round the end; a line without shingles stays EMPTY."""
    out = least.copy()
    bins = out.shape[1]
    for at in range(2 * bins - 1, -1, -1):
        here, after = at % bins, (at + 1) % bins
        out[:, here] = np.where(out[:, here] == EMPTY, out[:, after], out[:, here])
    return out


def bands(least: np.ndarray, rows: int, step: int) -> np.ndarray:
    """A number for every ``rows`` bins in a row, from every ``step``-th bin, round the end."""
    starts = np.arange(0, least.shape[1], step)
    out = mixed(np.broadcast_to(starts.astype(np.uint64) + np.uint64(1), (len(least), len(starts))) * np.uint64(_FACTOR))
    for k in range(rows):
        out = mixed(out * np.uint64(_FACTOR) + least[:, (starts + k) % least.shape[1]])
    return out


def distinct(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every line's distinct shingles, ascending."""
    n = np.maximum(np.diff(bounds) - WIDTH + 1, 0)
    if not n.sum():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    h = _window_hashes(codes)[place]
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1]))
    return line[new], h[new]


def odd_sketch(line: np.ndarray, h: np.ndarray, lines: int, words: int) -> np.ndarray:
    """Per line 64 x ``words`` bits; each distinct shingle flips one."""
    out = np.zeros((lines, words), dtype=np.uint64)
    np.bitwise_xor.at(out, (line, ((h >> np.uint64(6)) % np.uint64(words)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
    return out


def signature(lines: pa.StringArray, bits: int, rows: int, step: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct shingles, odd sketch and bands of 2^bits minima, per line."""
    codes, bounds = characters(lines)
    size, sketch, band = [], [], []
    for at, to in slices(bounds):
        own = bounds[at : to + 1] - bounds[at]
        line, h = distinct(codes[bounds[at] : bounds[to]], own)
        size.append(np.bincount(line, minlength=to - at))
        sketch.append(odd_sketch(line, h, to - at, words))
        least = np.full((to - at, 1 << bits), EMPTY)
        bin_of = (h >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, (bin_of[1:] != bin_of[:-1]) | (line[1:] != line[:-1]))[: len(h)])
        least[line[first], bin_of[first]] = h[first]
        band.append(bands(filled(least), rows, step))
    return tuple(np.concatenate(x) for x in (size, sketch, band))


def shared(x: pa.StringArray, y: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of lines: shingles in both, and the two sets' sizes together."""
    (cx, bx), (cy, by) = characters(x), characters(y)
    both, total = [], []
    for at, to in slices(bx + by):
        sides = [distinct(c[b[at] : b[to]], b[at : to + 1] - b[at]) for c, b in ((cx, bx), (cy, by))]
        line, h = (np.concatenate(part) for part in zip(*sides, strict=True))
        order = np.lexsort((h, line))
        line, h = line[order], h[order]
        twice = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        both.append(np.bincount(line[1:][twice], minlength=to - at))
        total.append(np.bincount(line, minlength=to - at))
    return np.concatenate(both), np.concatenate(total)
