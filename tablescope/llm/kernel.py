"""Word kernels over Arrow text columns: spans, counts, hashes and shingle sets.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z in every hash. Hashes are 64 bits wide: a
keyed polynomial over the bytes of a word, and a keyed sum over the words of a shingle, both finished by a bijective mix.
Nothing here knows Spark: the operators call these functions on the record batches that Spark hands to a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19       # working arrays stay in cache; a longer text is worked on alone
SHINGLE_WORDS = 5

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_draw = np.random.default_rng(20240607)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _draw.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place_values(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES)
        rows = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            rows.append(np.multiply.accumulate(p))
        _powers = tuple(rows)
    return _powers


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over consecutive rows of about CHUNK_BYTES."""
    buf, offs = as_bytes(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, buf[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; the words of row i are first[i]:first[i + 1]."""
    inside = ~SPACE[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    begins[offs[full]] = inside[offs[full]]
    ends[offs[full + 1] - 1] = inside[offs[full + 1] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_counts(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for a, b, buf, offs in chunks(texts):
        out[a:b] = np.diff(spans(buf, offs)[2])
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _place_values(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its 5-word shingles; a text of 1 to 4 words is one shingle, an empty one none."""
    for _, _, buf, offs in chunks(texts):
        starts, ends, first = spans(buf, offs)
        words = word_hashes(buf, starts, ends)
        n = len(words)
        padded = np.concatenate([words, np.zeros(SHINGLE_WORDS, np.uint64)])
        whole = np.zeros(n, np.uint64)
        for j in range(SHINGLE_WORDS):
            whole += padded[j:j + n] * _PLACE[j]
        whole = mix(whole + np.uint64(SHINGLE_WORDS))
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= SHINGLE_WORDS:
                yield np.unique(whole[a:b - SHINGLE_WORDS + 1])
            elif b > a:
                yield mix(np.sum(words[a:b] * _PLACE[:b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
