"""Vectorised text kernels over Arrow string buffers (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that words are hashed in at once; a longer document is cut at white space.
WINDOW = 1 << 20
#: Bytes of text that a task works on at once, about.
SLICE = 1 << 18
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(30))
        h = h * _M1
        h = h ^ (h >> U(27))
        h = h * _M2
        return h ^ (h >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_ARROW = {"boolean": pa.bool_(), "double": pa.float64()}
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for windows of the usual length."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, WINDOW + 1), base, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= WINDOW + 1:
            _POWERS[base] = have
    return have[:n]


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes, or one longer row."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def per_text(f, kind: str):
    """A column function of a text column by ``f`` (Arrow array to Arrow array), which gets about SLICE bytes of texts
    at once; only the texts go to Python, the other columns stay in the JVM."""
    from pyspark.sql import functions as F

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            done = [f(part.column("text")) for part in slices(batch, "text")]
            yield pa.concat_arrays(done) if done else pa.array([], _ARROW[kind])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    table = _BYTE_LOWER if lower else _BYTE
    out, at = [np.zeros(0, U)], 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + WINDOW, side="right")))
            a, b = start[at], end[to - 1]
            c = np.zeros(b - a + 1, U)
            np.cumsum(table[buf[a:b]] * powers(_BASE, b - a), out=c[1:])
            s, e = start[at:to] - a, end[at:to] - a
            # sum of table[byte] * base**(place in the word), whatever the window
            out.append(mix((c[e] - c[s]) * powers(_INVERSE, b - a)[s] + (e - s).astype(U)))
            at = to
    return start, end, np.concatenate(out)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values."""
    if len(h) < n:
        return np.zeros(0, U)
    g = np.zeros(len(h) - n + 1, U)
    with np.errstate(over="ignore"):
        for j in range(n):
            g = g * _M2 + h[j : len(h) - n + 1 + j]
        return mix(g + U(n))


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the texts' offsets in them."""
    if not len(buf):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    out = buf[at].astype(np.uint32)
    for low, size, bits in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        mine = np.flatnonzero((out >= low) & (out < (low | bits) + 1))
        if len(mine):
            value = out[mine] & bits
            for j in range(1, size):
                value = value << 6 | buf[at[mine] + j] & 0x3F
            out[mine] = value | 0x80000000  # so that no later length takes it
    out &= 0x7FFFFFFF
    places = np.concatenate(([0], np.cumsum(lead)))
    return out, places[offs]


def stretches(buf: np.ndarray, offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The bytes and offsets of texts, or, of a single text of more than ``limit`` bytes, stretches of it that begin
    at a character; the last value tells whether a stretch goes on from the one before."""
    if len(offs) != 2 or len(buf) <= limit:
        yield buf, offs, False
        return
    at = 0
    while at < len(buf):
        to = min(len(buf), at + limit)
        while to < len(buf) and buf[to] & 0xC0 == 0x80:
            to += 1
        yield buf[at:to], np.array([0, to - at]), at > 0
        at = to


def owner(offs: np.ndarray) -> np.ndarray:
    """The text that each element belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def sums(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n texts; own ascends."""
    out = np.zeros((n, *values.shape[1:]), np.float64)
    if len(own):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] = np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out
