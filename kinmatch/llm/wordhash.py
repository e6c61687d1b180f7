"""64-bit hashes of words, runs of words and windows of a text, vectorised over its bytes.

A run's hash is a polynomial in an odd base modulo 2**64, read off prefix sums: with an inverse of the base, the sum over
a range is brought to the same power whatever place it stands at. Results are mixed, so every bit depends on all.
"""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Values that are hashed at once; the tables of powers hold one entry more at most.
SEGMENT = (1 << 18) - 1


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = 1 << max(14, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(n, np.uint64)
            p[1:] = b
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _raw(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """The polynomial of values[start:end] for each pair, with the power 0 at the start."""
    power, inverse = _table(_BASES[which], len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, power[: len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def _long(values: np.ndarray, start: int, end: int, which: int) -> int:
    """The same of one run that is longer than a segment, put together from segments."""
    power, _ = _table(_BASES[which], SEGMENT + 1)
    total = 0
    for at in range(start, end, SEGMENT):
        part = values[at : min(end, at + SEGMENT)]
        total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(_BASES[which], at - start, 1 << 64)
    return total % (1 << 64)


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of values[start:end] for each pair, starts ascending; of equal runs it is equal, wherever they stand.

    Long arrays are done by segments, so what is held beside them does not grow with the longest text.
    """
    if len(values) <= SEGMENT:
        raw = _raw(values, starts, ends, which)
    else:
        raw, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            base = int(starts[at])
            to = int(np.searchsorted(starts, base + SEGMENT // 2))
            stop = min(len(values), base + SEGMENT)
            some = ends[at:to]
            raw[at:to] = _raw(values[base:stop], starts[at:to] - base, np.minimum(some, stop) - base, which)
            for k in np.flatnonzero(some > stop).tolist():
                raw[at + k] = _long(values, int(starts[at + k]), int(some[k]), which)
            at = to
    # The length is part of the result, so zeros at an end do count.
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of span values."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = span - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def words(text: str, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words (runs of anything but ASCII white space) of the UTF-8 text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = _SPACE[data]
    change = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = change[0::2], change[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    if lower:
        data = _LOWER[data]
    return runs(data, starts, ends), starts, ends
