"""Vectorised 64-bit hashes of words and word shingles over Arrow string columns (numpy, deterministic)."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit value for each byte; capital letters have those of small ones.
_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_MULT))[_LOWER]


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one entry more than rows)."""
    space = _SPACE[raw]
    before = np.ones(len(raw) + 1, bool)
    before[1:] = space
    before[offsets[offsets < len(raw)]] = True
    after = np.ones(len(raw), bool)
    after[:-1] = space[1:]
    edge = offsets[(offsets > 0) & (offsets <= len(raw))] - 1
    after[edge] = True
    starts = np.flatnonzero(~space & before[:-1])
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word with A-Z lower-cased, and the index of each row's first word."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # pieces of about _CHUNK bytes, cut between words
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * _power(_MULT, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * _power(_INVERSE, hi - lo + 1)[s])
        i = j
    return out, first


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; fewer words than width make one, no word none."""
    words, first = word_hashes(column)
    factor = np.uint64(0xD6E8FEB86659FD93)
    whole = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        whole = whole * factor + words[k : len(words) - width + 1 + k]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = np.uint64((int(h) * int(factor) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h], np.uint64) ^ np.uint64(0xA0761D6478BD642F)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit identity of a set of hashes."""
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sub_batches(batch: pa.RecordBatch, text: str, most: int = 8 << 20):
    """Slices of a record batch with about `most` bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
