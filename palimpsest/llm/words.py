"""Words of a whole Arrow column at once, as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """data: the texts' bytes; starts, ends: byte bounds of each word; hashes: of each word; first: index of each text's
    first word, and the number of words last; texts: byte offset of each text, and the number of bytes last."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    texts: np.ndarray


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls and the offset of each text."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bytes outside space begin and end; none crosses the bounds of a text."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    inside = ~space[data]
    before = np.empty(n, bool)
    before[:1], before[1:] = True, ~inside[:-1]
    after = np.empty(n, bool)
    after[-1:], after[:-1] = True, ~inside[1:]
    return np.flatnonzero(inside & (before | edge[:-1])), np.flatnonzero(inside & (after | edge[1:])) + 1


def split(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words are runs of bytes outside space; lower: A-Z count as a-z."""
    data, bounds = raw(texts)
    starts, ends = runs(data, bounds, space)
    hashes = np.zeros(0, np.uint64)
    if len(starts):
        lengths, inside = ends - starts, ~space[data]
        place = np.flatnonzero(inside).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        place -= np.repeat(starts.astype(place.dtype), lengths)
        weighed = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()), _BASE)]))[place]
        weighed *= (_LOWER if lower else _BYTE)[data[inside]]
        hashes = mix(np.add.reduceat(weighed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds), bounds)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n-1 have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * U(0x2545F4914F6CDD1D) + hashes[i : len(hashes) - n + 1 + i] + U(i + 1))
    return out
