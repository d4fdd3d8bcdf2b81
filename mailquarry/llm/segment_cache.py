"""Token ids of whole texts from the ids of their segments, each encoded once.

A text is cut only where no token of the vocabulary can reach across, so the
concatenated ids of the segments are the ids of the whole text. A hash of its
bytes leads to a remembered segment, and the bytes themselves are compared
before its ids are taken, so ids never come from another segment.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from mailquarry.llm.bytetext import mix, pieces, powers, same_runs

#: Segments remembered by a worker; the memory is emptied when it is full.
REMEMBERED = 600_000
#: Bytes that are cut and looked up at once.
CHUNK = 1 << 19


class SegmentCache:
    """Encodes texts given as one UTF-8 buffer with offsets.

    ``cut(data, offs)`` gives (first byte of each segment, flags of the texts
    that must be encoded whole); every text that isn't empty starts a segment.
    ``encode(segments)`` encodes segments, ``whole(text)`` one whole text.
    """

    def __init__(self, cut: Callable, encode: Callable[[list[bytes]], list[list[int]]], whole: Callable[[bytes], list[int]], remembered: int = REMEMBERED):
        self.cut, self.encode, self.whole, self.most = cut, encode, whole, remembered
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.odd = np.zeros(0, np.uint8)
        self.text, self.text_at, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def noted(self, segments: list[bytes], ids: list[list[int]]) -> list[int]:
        """A flag, 0 or 1, of each new segment; a text has the flags of all its segments."""
        return [0] * len(segments)

    def _rows(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of each segment in the memory; new ones are encoded and remembered."""
        span = np.diff(np.r_[at, len(data)])
        rank = np.arange(len(data)) - np.repeat(at, span)
        with np.errstate(over="ignore"):
            h = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers(int(span.max()) + 1)[rank], at))
        found, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == found[inside]
        new = np.flatnonzero(~known)
        if len(new):
            rows = self._remember(data, at[first[new]], span[first[new]])
            self.hashes = np.insert(self.hashes, place[new], found[new])
            self.rows = np.insert(self.rows, place[new], rows)
            place = np.searchsorted(self.hashes, found)
        out = self.rows[place][back]
        other = np.flatnonzero(~same_runs(data, at, span, self.text, self.text_at[out], self.text_size[out]))
        if len(other):  # another segment has this hash: these are encoded by themselves and no hash leads to them
            out[other] = self._remember(data, at[other], span[other])
        return out

    def _remember(self, data: np.ndarray, at: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Encode segments and append them to the memory; their rows."""
        raw = data.tobytes()
        segments = [raw[a : a + n] for a, n in zip(at.tolist(), span.tolist(), strict=True)]
        ids = self.encode(segments)
        self.odd = np.r_[self.odd, np.array(self.noted(segments, ids), np.uint8)]
        sizes = np.array([len(x) for x in ids], np.int64)
        rows = len(self.starts) + np.arange(len(at))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.text_at = np.r_[self.text_at, len(self.text) + np.cumsum(span) - span]
        self.text_size = np.r_[self.text_size, span]
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(segments), np.uint8)])
        return rows

    def ids(self, data: np.ndarray, offs: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets into them, flags by text); ``end`` is appended to each text."""
        out, sizes, flags = [], [], []
        for i, j in pieces(offs, CHUNK):
            x, n, f = self._piece(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end)
            out.append(x), sizes.append(n), flags.append(f)
        if not out:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint8)
        return np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(flags)

    def _piece(self, data: np.ndarray, offs: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(offs) - 1
        if len(self.starts) > self.most or len(self.text) > 32 * self.most:
            self._forget()
        at, whole = self.cut(data, offs) if len(data) else (np.zeros(0, np.int64), np.zeros(n, bool))
        rows = self._rows(data, at) if len(at) else np.zeros(0, np.int64)
        by = np.searchsorted(at, offs)
        size = self.sizes[rows] if len(rows) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(size)]
        here = np.repeat(self.starts[rows] - total[:-1], size) + np.arange(total[-1]) if len(rows) else np.zeros(0, np.int64)
        ids = self.flat[here]
        counts = np.diff(total[by])
        odd = np.zeros(n, np.uint8)
        if len(rows) and self.odd.any():
            odd = (np.diff(np.r_[0, np.cumsum(self.odd[rows] > 0)][by]) > 0).astype(np.uint8)
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            raw = data.tobytes()
            for d in np.flatnonzero(whole):
                parts[d] = np.array(self.whole(raw[offs[d] : offs[d + 1]]), np.uint32)
                counts[d] = len(parts[d])
            ids = np.concatenate(parts)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            counts = counts + 1
        return ids, counts, odd
