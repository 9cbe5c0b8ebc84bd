"""Sets of hashed word shingles, one-permutation signatures with optimal densification, and band keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tapeloom.llm.common import mix, odd_numbers, pieces, word_hashes

_PLACES = odd_numbers(16, 21)
_LENGTH = int(odd_numbers(1, 22)[0])
_SECOND = odd_numbers(1, 23)[0]


def _mark(n: int) -> np.uint64:
    return np.uint64(_LENGTH * n % 2**64)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in row order.

    A text with fewer than ``width`` words is one shingle of all its words; one without words gives an empty set.
    """
    places = _PLACES[:width] if width <= len(_PLACES) else odd_numbers(width, 21)
    for at, end, data, offsets in pieces(column):
        words, bounds = word_hashes(data, offsets)
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            rolled += words[k: k + n] * places[k]
        rolled = mix(rolled + _mark(width))
        for row in range(end - at):
            a, b = int(bounds[row]), int(bounds[row + 1])
            if b - a >= width:
                yield np.unique(rolled[a: b - width + 1])
            elif b > a:
                yield mix((words[a:b] * places[: b - a]).sum(keepdims=True, dtype=np.uint64) + _mark(b - a))
            else:
                yield np.zeros(0, np.uint64)


class Signer:
    """One-permutation signatures of ``bands * rows`` bins, hashed by bands.

    A set's hashes fall into equal ranges of the hash space; each bin keeps its least hash. An empty bin takes the
    value of the first filled bin in its own random order of bins (optimal densification), so that equal bins of two
    sets agree as often as the sets resemble each other, however few elements they hold.
    """

    def __init__(self, bands: int, rows: int, seed: int = 31) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.probe = np.stack([rng.permutation(self.bins) for _ in range(self.bins)], axis=1).astype(np.int32)
        self.weights = odd_numbers(rows, seed + 1)
        self.salts = odd_numbers(bands, seed + 2)

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band keys, one line per non-empty set."""
        values = np.zeros((len(sets), self.bins), np.uint64)
        filled = np.zeros((len(sets), self.bins), bool)
        for i, hashes in enumerate(sets):
            spot = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
            least = np.flatnonzero(np.diff(spot, prepend=-1))
            values[i, spot[least]] = hashes[least]
            filled[i, spot[least]] = True
        line, bin_ = np.nonzero(~filled)
        for order in self.probe:
            if not len(line):
                break
            source = order[bin_]
            found = filled[line, source]
            values[line[found], bin_[found]] = values[line[found], source[found]]
            line, bin_ = line[~found], bin_[~found]
        grouped = mix(values).reshape(len(sets), self.bands, self.rows)
        return mix((grouped * self.weights).sum(axis=2, dtype=np.uint64) + self.salts)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set, equal for equal sets."""
    both = np.array([hashes.sum(dtype=np.uint64), mix(hashes ^ _SECOND).sum(dtype=np.uint64)]).view(np.int64)
    return int(both[0]), int(both[1])
