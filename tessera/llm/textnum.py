"""Numpy views of Arrow text columns: words, lines, hashes and shingles.

Text is handled as UTF-8 bytes in slices of a few MB, whole documents at a
time, so that what a task holds does not grow with its partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: The separators of words: space and the bytes 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: A to Z in lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if n <= 1 << 21:  # what an unusually long text needs isn't kept
            _powers[base] = p
    return p[:n]


def slices(batch: pa.RecordBatch, text: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has about ``size`` bytes of ``text``, or one row."""
    at = offsets(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, min(n, j) - i)
        i = j


def gathered(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut as by ``slices``, and joined while they have ``size`` bytes in all at most."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        for b in slices(batch, text, size):
            if held and have + b.nbytes > size:
                yield pa.concat_batches(held)
                held, have = [], 0
            held.append(b)
            have += b.nbytes
    if held:
        yield pa.concat_batches(held)


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls and each row's offsets in them."""
    at = offsets(column) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of true values that stay within a row."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    border = np.zeros(n + 1, bool)
    border[at] = True
    before = np.ones(n, bool)
    np.logical_not(inside[:-1], out=before[1:])
    after = np.ones(n, bool)
    np.logical_not(inside[1:], out=after[:-1])
    start = np.flatnonzero(inside & (before | border[:n]))
    end = np.flatnonzero(inside & (after | border[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SEPARATOR[raw], at)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal wherever the bytes are."""
    n = len(raw)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODES[raw] * powers(BASE, n), out=total[1:])
    h = (total[end] - total[start]) * powers(INVERSE, n + 1)[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(code: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of k-word shingles; a row of fewer words is one shingle.

    ``code`` holds word hashes, by row and in order.
    """
    count = np.bincount(row, minlength=n_rows)
    n = len(code)
    h = np.zeros(n, U64)
    step = powers(0xC2B2AE3D27D4EB4F, k)
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    left = first[1:][row] - np.arange(n)  # words from here to the row's end
    for j in range(k):
        m = n - j
        if m > 0:
            h[:m] += np.where(left[:m] > j, code[j:] * step[j], U64(0))
    whole = np.minimum(left, k)
    keep = (left >= k) | ((count[row] < k) & (left == count[row]))
    return mix(h[keep] + whole[keep].astype(U64) * U64(0xA24BAED4963EE407)), row[keep]


def unique_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted by row and hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, row


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; 0 for empty rows."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
