"""Tokenising by distinct segments.

A text is cut only where no token can reach across, so the tokens of a text
are those of its segments, one after the other.  Each distinct segment is
tokenised once by the library; a table sorted by content hash keeps the answers
for the life of the worker.  Each answer is kept with the segment's own bytes,
and a segment whose bytes differ from those under its hash is tokenised by
itself, so equal hashes can't give wrong answers.  The table is emptied when it
is full, so memory stays bounded and answers stay the same.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from itertools import chain

import numpy as np

from ._blocks import ragged

#: Segments, and integers of their runs and bytes of their texts, that a table holds before it is emptied.
MOST, MOST_RUNS = 1_200_000, 12_000_000
#: New keys are gathered up to this number before they join the others.
YOUNG = 1 << 17


class Growing:
    """An array that is added to at its end, in place as long as there is room."""

    def __init__(self, dtype: type) -> None:
        self.data, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, x: np.ndarray) -> int:
        """Where x begins."""
        at, self.n = self.n, self.n + len(x)
        if self.n > len(self.data):
            more = np.zeros(max(self.n, len(self.data) * 3 // 2), self.data.dtype)
            more[:at] = self.data[:at]
            self.data = more
        self.data[at : self.n] = x
        return at


class SegmentTable:
    """Bytes of a segment -> run of integers in one flat array."""

    def __init__(self, dtype: type) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.text = Growing(self.dtype), Growing(np.uint8)
        self.at, self.size, self.text_at, self.text_size = (Growing(np.int32) for _ in range(4))
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]  # sorted keys and their entries

    def __len__(self) -> int:
        return self.at.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        out = np.full(len(keys), -1, np.int64)
        for have, entry in self.levels:
            if len(have):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                out[hit] = entry[i[hit]]
        return out

    def _runs(self, runs: list) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of runs that are added to the flat array."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        at = self.flat.add(np.fromiter(chain.from_iterable(runs), self.dtype, int(size.sum())))
        return at + np.cumsum(size) - size, size

    def add(self, keys: np.ndarray, text: np.ndarray, text_size: np.ndarray, runs: list) -> None:
        """Sorted new keys with the bytes of their segments, laid end to end, and their runs."""
        at, size = self._runs(runs)
        text_at = self.text.add(text) + np.cumsum(text_size) - text_size
        entry = np.arange(len(self), len(self) + len(keys), dtype=np.int32)
        for column, x in ((self.at, at), (self.size, size), (self.text_at, text_at), (self.text_size, text_size)):
            column.add(x)
        old, young = self.levels
        spot = np.searchsorted(young[0], keys)
        young = np.insert(young[0], spot, keys), np.insert(young[1], spot, entry)
        if len(young[0]) > YOUNG:
            spot = np.searchsorted(old[0], young[0])
            old, young = (np.insert(old[0], spot, young[0]), np.insert(old[1], spot, young[1])), (young[0][:0], young[1][:0])
        self.levels = [old, young]

    def lookup(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, tokenise: Callable[[list[str]], list]) -> tuple[np.ndarray, np.ndarray]:
        """Place and length in the flat array of each segment's run; unknown ones are tokenised first."""
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self) + len(keys) > MOST or max(self.flat.n, self.text.n) > MOST_RUNS:
            self.clear()
        entry = self.find(keys)
        new = np.flatnonzero(entry < 0)
        data = buf.tobytes()

        def ask(i: np.ndarray) -> list:
            on = gc.isenabled()
            gc.disable()  # many small lists, none of them in a cycle
            try:
                return tokenise([data[a:b].decode() for a, b in zip(start[i].tolist(), end[i].tolist())])
            finally:
                if on:
                    gc.enable()

        if len(new):
            i = first[new]
            n = end[i] - start[i]
            entry[new] = np.arange(len(self), len(self) + len(new))
            self.add(keys[new], buf[ragged(start[i], n)], n, ask(i))
        i = entry[back]
        at, size = self.at.data[i].astype(np.int64), self.size.data[i].astype(np.int64)
        other = self._others(buf, start, end, i)
        if len(other):
            at[other], size[other] = self._runs(ask(other))
        return at, size

    def _others(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Which segments are not, byte for byte, those of the entries i."""
        size = end - start
        differ = size != self.text_size.data[i]
        same = np.flatnonzero(~differ & (size > 0))
        if len(same):
            n = size[same]
            equal = buf[ragged(start[same], n)] == self.text.data[ragged(self.text_at.data[i[same]].astype(np.int64), n)]
            differ[same] = ~np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return np.flatnonzero(differ)

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.flat.data[ragged(at, size)]
