"""Vectorised word and shingle fingerprints over Arrow string columns.

Shared by the operators that work on word sequences.  A word is a maximal run of bytes
outside ``[\\x20\\x09-\\x0D]``.  A word's 64-bit fingerprint is a polynomial hash over
randomised byte values followed by a mixing step, so equal words are equal on every
executor and no dictionary has to be agreed upon.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: Bytes hashed at once; bounds the memory of a task whatever the length of a text.
BLOCK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; `seed` selects one of many independent functions."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values(fold_case: bool) -> np.ndarray:
    table = mix(np.arange(256, dtype=U), 77)
    if fold_case:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_TABLES = {fold: _byte_values(fold) for fold in (False, True)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=U)
    out[0] = 1
    done = 1
    while done < n:
        step = U(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


_POW = _powers(_BASE, BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def _hash_block(data: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, starts and ends of the words of a block that cuts no word."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(data) and not space[-1]:
        edge = np.concatenate((edge, [len(data)]))
    start, end = edge[0::2], edge[1::2]
    value = _TABLES[fold_case][data]
    value *= _POW[: len(data)]
    prefix = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(value, out=prefix[1:])
    raw = (prefix[end] - prefix[start]) * _INV[start]
    return mix(raw + (end - start).astype(U) * U(0x9FB21C651E98DF25)), start, end


def _long_word(data: np.ndarray, fold_case: bool) -> np.ndarray:
    """Fingerprint of one word longer than a block, from the fingerprints of its blocks."""
    total = U(0)
    for k, at in enumerate(range(0, len(data), BLOCK)):
        part = data[at : at + BLOCK]
        value = _TABLES[fold_case][part] * _POW[: len(part)]
        total = mix(np.array([total], dtype=U), k + 3)[0] + value.sum(dtype=U)
    return mix(np.array([total], dtype=U), len(data))


def hash_words(data: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, byte starts, byte ends) of the words of UTF-8 bytes of any length."""
    if len(data) <= BLOCK:
        return _hash_block(data, fold_case)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                stop = at
                while stop < len(data):
                    gap = np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop += BLOCK
                stop = min(stop, len(data))
                if stop - at > BLOCK:
                    parts.append((_long_word(data[at:stop], fold_case), np.array([at]), np.array([stop])))
                    at = stop
                    continue
        h, s, e = _hash_block(data[at:stop], fold_case)
        parts.append((h, s + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def text_slices(column: pa.Array):
    """Yield (first row, row byte offsets, bytes) for runs of rows of about BLOCK bytes.

    Nulls read as empty texts.  A row longer than BLOCK gets a run of its own.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    lengths = np.where(null, 0, np.diff(offsets))
    row = 0
    while row < n:
        stop, total = row, 0
        while stop < n and (stop == row or total + lengths[stop] + 1 <= BLOCK) and not (null[stop] and stop > row):
            total += lengths[stop] + 1
            stop += 1
        if null[row]:
            yield row, np.zeros(2, dtype=np.int64), data[:0]
            row += 1
            continue
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def row_words(column: pa.Array, fold_case: bool = False):
    """Yield (row, fingerprints, starts, ends, bytes) for each row of a string column.

    Rows are hashed many at a time; words never run across rows.
    """
    for first, offsets, data in text_slices(column):
        rows = len(offsets) - 1
        if rows == 1:
            yield first, *hash_words(data, fold_case), data
            continue
        # One separator after each row keeps words apart.
        spaced = np.full(len(data) + rows, 32, dtype=np.uint8)
        keep = np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))
        spaced[keep] = data
        h, s, e = _hash_block(spaced[:BLOCK], fold_case) if len(spaced) <= BLOCK else hash_words(spaced, fold_case)
        bounds = offsets + np.arange(rows + 1)
        cut = np.searchsorted(s, bounds)
        for k in range(rows):
            a, b = cut[k], cut[k + 1]
            yield first + k, h[a:b], s[a:b] - bounds[k], e[a:b] - bounds[k], data[offsets[k] : offsets[k + 1]]


def fold_ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all n consecutive items of `h`, in order-sensitive combination."""
    if len(h) < n:
        return h[:0]
    size = len(h) - n + 1
    out = mix(h[:size].copy(), 1)
    for k in range(1, n):
        out = mix(out ^ h[k : k + size], k + 1)
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of n items, by doubling: O(log n) passes."""
    if len(h) < n:
        return h[:0]
    size = len(h) - n + 1
    out, done, block, width = None, 0, mix(h.copy(), 11), 1
    left = n
    while left:
        if left & 1:
            piece = block[done : done + size]
            out = mix(piece.copy(), 12) if out is None else mix(out * U(0x9E3779B97F4A7C15) ^ piece, 13 + width)
            done += width
        left >>= 1
        if left:
            block = mix(block[: len(block) - width] * U(0xC2B2AE3D27D4EB4F) ^ block[width:], 14 + width)
            width *= 2
    return out


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct sorted n-word shingle fingerprints; fewer than n words make one shingle."""
    if len(h) == 0:
        return h
    if len(h) < n:
        out = U(len(h))
        for x in h:
            out = mix(np.array([out ^ x], dtype=U), 5)[0]
        return np.array([out], dtype=U)
    return np.unique(fold_ngrams(h, n))
