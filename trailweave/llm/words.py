"""Words of many texts at once: a hash of each, without a Python object for any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trailweave.llm.common import utf8

_space = np.zeros(256, bool)
_space[[*range(9, 14), *range(28, 33)]] = True
_values = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)
_factor = np.uint64(0x9E3779B97F4A7C15)


def finish(x: np.ndarray) -> np.ndarray:
    """64 bits mixed well."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space, as ``str.split`` has it."""
    out = _space[data]
    for lead, second, thirds in ((0xC2, (0x85, 0xA0), ()), (0xE1, (0x9A,), ((0x80, 0x80),)), (0xE2, (0x80,), ((0x80, 0x8A), (0xA8, 0xA9), (0xAF, 0xAF))), (0xE2, (0x81,), ((0x9F, 0x9F),)), (0xE3, (0x80,), ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        at = at[at < len(data) - 1 - bool(thirds)]
        at = at[np.isin(data[at + 1], second)]
        if thirds and len(at):
            third = data[at + 2]
            at = at[np.any([(third >= a) & (third <= b) for a, b in thirds], axis=0)]
        for k in range(2 + bool(thirds)):
            out[at + k] = True
    return out


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word between white space, and where each text's words start, with
    the end of the last. Case counts; null is empty."""
    data, edges = utf8(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    visible = ~white(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    after = np.concatenate(([True], ~visible[:-1])) | edge[:-1]
    starts = np.flatnonzero(visible & after)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    letters = data[visible]
    # Where a word starts among the visible bytes.
    at = np.flatnonzero(after[visible])
    sizes = np.diff(at, append=len(letters))
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _factor))
    h = np.add.reduceat(_values[letters] * powers[np.arange(len(letters)) - np.repeat(at, sizes)], at)
    return finish(h + sizes.astype(np.uint64)), np.searchsorted(starts, edges)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """First row and rows of slices of some ``most`` bytes, so that the arrays made of one stay
    small however long the texts are."""
    _, edges = utf8(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + most)))
        yield first, texts.slice(first, last - first)
        first = last
