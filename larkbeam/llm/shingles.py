"""Sets of word shingles as 64-bit numbers, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from larkbeam.llm.spans import mixed, span_hashes, spans

#: Bytes of text that are taken together.
BLOCK = 1 << 19

_FACTOR = np.uint64(0x9FB21C651E98DF25)


def _joined(hashes: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on."""
    out = np.full(len(places), np.uint64(width))
    for i in range(width):
        out = mixed(out * _FACTOR + hashes[places + i])
    return out


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its different shingles of ``width`` words.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A to Z. A text of fewer
    words is one shingle, one without words none.
    """
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        waiting.append((text or "").encode().lower())
        size += len(waiting[-1])
        if size >= BLOCK:
            yield from _block(waiting, width)
            waiting, size = [], 0
    if waiting:
        yield from _block(waiting, width)


def _block(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = spans(data)
    hashes = span_hashes(data, starts, ends)
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    first = np.concatenate([[0], upto[:-1]])
    whole = np.arange(max(0, len(hashes) - width + 1))
    shingles = _joined(hashes, whole, width) if len(whole) else np.empty(0, np.uint64)
    for a, b in zip(first.tolist(), upto.tolist()):
        if b - a >= width:
            yield np.unique(shingles[a : b - width + 1])
        elif b > a:
            yield _joined(hashes, np.array([a]), b - a)
        else:
            yield np.empty(0, np.uint64)


class Circulant:
    """Circulant MinHash: two permutations give all coordinates of a signature.

    The first scatters shingles over ``1 << bits`` positions. The second gives
    every position a value; coordinate k is the smallest value of a set's
    positions in the second permutation shifted circularly by k.
    """

    def __init__(self, coordinates: int, bits: int = 22, seed: int = 1):
        self.coordinates, self.size = coordinates, 1 << bits
        self.scatter = np.uint64(int(np.random.default_rng(seed).integers(1, 1 << 62)))
        values = np.random.default_rng(seed + 1).permutation(self.size).astype(np.uint32)
        # repeated at the end, so that a shifted row is a run of neighbours
        self._rows = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([values, values[: coordinates - 1]]), coordinates
        )

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = mixed(shingles ^ self.scatter) & np.uint64(self.size - 1)
        out = np.full(self.coordinates, self.size, np.uint32)
        for i in range(0, len(places), 4096):
            np.minimum(out, self._rows[places[i : i + 4096]].min(axis=0), out=out)
        return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of coordinates, which also tells bands apart."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        out = mixed(out * _FACTOR + rows[:, i])
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets share ``percent`` of their union, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(a) + len(b) - same)
