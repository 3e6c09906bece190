"""Word shingles of whole texts as sets of 64-bit hashes, computed over Arrow string buffers with numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's hash is a polynomial over its
bytes and a shingle's one over the mixed hashes of its words, both modulo 2**64 and taken from running sums, so a batch
costs a few vector operations per byte. Random hashes of 64 bits are taken for equality within pairs of sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
NO_HASH = (1 << 63) - 1

_rng = np.random.default_rng(20011)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_VALUES[_SPACE] = 0
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64 for k below `length`."""
    held = _powers.get(base)
    if held is None or len(held[0]) < length:
        size = max(length, CHUNK + 1)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held = np.cumprod(up), np.cumprod(down)
        if size == CHUNK + 1:
            _powers[base] = held
    return held


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix; each seed is another random order of the hashes."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs_of(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]:
    """Hashes of all runs of `width` words, the first word of each text, and the hash of a shorter text's words."""
    n = len(data)
    up, down = _power_tables(_BYTE_BASE, n + 1)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = bounds[:-1][(bounds[:-1] < n) & (bounds[:-1] < bounds[1:])]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=running[1:])
    ends = np.append(starts[1:], n)
    words = mix((running[ends] - running[starts]) * down[starts])
    m = len(words)
    up, down = _power_tables(_WORD_BASE, m + 1)
    summed = np.zeros(m + 1, np.uint64)
    np.cumsum(words * up[:m], out=summed[1:])
    runs = mix((summed[width:] - summed[: m + 1 - width]) * down[: m + 1 - width], 1) if m >= width else np.zeros(0, np.uint64)
    of_doc = np.searchsorted(starts, bounds)
    return runs, of_doc, lambda a, b: mix((summed[b : b + 1] - summed[a : a + 1]) * down[a], 1 + b - a + width)


def _sets_of(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    runs, of_doc, short = _runs_of(data, bounds, width)
    for a, b in zip(of_doc[:-1].tolist(), of_doc[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield short(a, b)
        else:
            yield runs[:0]


def _minima_of(data: np.ndarray, bounds: np.ndarray, width: int, classes: int) -> np.ndarray:
    runs, of_doc, short = _runs_of(data, bounds, width)
    texts = len(bounds) - 1
    least = np.full((texts, classes), NO_HASH, np.int64)
    words = np.diff(of_doc)
    owner = np.repeat(np.arange(texts), words)[: len(runs)]
    inside = np.arange(len(runs)) <= of_doc[1:][owner] - width
    held = runs[inside]
    np.minimum.at(least.ravel(), owner[inside] * classes + (held % np.uint64(classes)).astype(np.int64), (held >> np.uint64(1)).view(np.int64))
    for k in np.flatnonzero((words > 0) & (words < width)).tolist():
        (one,) = short(int(of_doc[k]), int(of_doc[k + 1])).tolist()
        least[k, one % classes] = one >> 1
    return least


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and bounds of texts, about CHUNK bytes at a time."""
    texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, len(texts))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow string array; empty for nulls and blanks."""
    for data, bounds in _chunks(texts):
        yield from _sets_of(data, bounds, width)


def shingle_minima(texts: pa.Array, classes: int, width: int = WIDTH) -> np.ndarray:
    """For every text the least shingle hash (less its last bit) of each class, the classes told by the hash's last bits; NO_HASH where there is none."""
    return np.concatenate([np.zeros((0, classes), np.int64), *(_minima_of(data, bounds, width, classes) for data, bounds in _chunks(texts))])
