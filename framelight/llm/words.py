"""Vectorised words and shingles of UTF-8 texts.

A word is a run of bytes other than space and 0x09-0x0D.  Words and shingles are represented by
64-bit hashes that depend on nothing but their bytes, so they agree between tasks and runs.
"""

from __future__ import annotations

import numpy as np

from . import worker

BLOCK = 1 << 20
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drop() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_MUL, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hash_block(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(_SPACE[buf], prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    power, inverse = _tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf] if lower else buf] * power[: len(buf)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * inverse[start], 1)


def word_hashes(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text plus the end) of UTF-8 ``bytes`` or None."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    data = b"\n".join(t or b"" for t in texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(buf):
        stop = min(len(buf), at + BLOCK)
        if stop < len(buf):  # a block ends at white space; one word longer than a block stays whole
            cut = next((k for k in range(stop, max(at, stop - 4096), -1) if _SPACE[buf[k - 1]]), 0)
            if not cut:
                ahead = np.flatnonzero(_SPACE[buf[stop:]])
                cut = stop + int(ahead[0]) + 1 if len(ahead) else len(buf)
            stop = cut
        s, h = _hash_block(buf[at:stop], lower)
        starts.append(s + at)
        hashes.append(h)
        at = stop
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    words, first = word_hashes(texts)
    total = max(0, len(words) - k + 1)
    rolling = np.zeros(total, np.uint64)
    for j in range(k):
        rolling += words[j : j + total] * _PLACE[j]
    rolling = mix(rolling, 100 + k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(rolling[a : b - k + 1]))
        elif n:
            out.append(mix((words[a:b] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True), 100 + int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def blocks(texts: list, most: int = BLOCK):
    """Index ranges of consecutive texts of at most ``most`` bytes together (one text may be larger)."""
    worker.enter("words", _drop)
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if texts:
        yield at, len(texts)


def utf8(column) -> list:
    """An Arrow string column as ``bytes`` or None."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist() if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()).to_pylist()
