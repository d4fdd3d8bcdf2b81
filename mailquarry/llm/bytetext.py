"""Vectorised views of text columns as bytes: words, word digests, shingles.

A batch of texts is one UTF-8 buffer with offsets, as Arrow holds it. All
functions work on pieces of at most ``PIECE`` bytes (or one longer text), so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def table_of(values: dict[int, int]) -> np.ndarray:
    """256 codes by byte; 0 marks a separator."""
    out = np.zeros(256, np.uint16)
    for byte, code in values.items():
        out[byte] = code
    return out


def _lower(byte: int) -> int:
    return byte + 32 if 65 <= byte <= 90 else byte


#: Words are runs of anything but space and \t..\r; A-Z is lowered.
SPACED = table_of({b: _lower(b) + 1 for b in range(256) if b != 32 and not 9 <= b <= 13})
#: Words are runs of ASCII letters and digits and of all bytes of other characters.
LETTERED = table_of({b: _lower(b) + 1 for b in range(256) if b >= 128 or chr(b).isalnum()})


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(n, 4096), _B)])
    return _powers


def same_runs(data: np.ndarray, starts: np.ndarray, span: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_span: np.ndarray) -> np.ndarray:
    """Whether each run of ``data`` has the bytes of the run beside it in ``other``."""
    same = span == other_span
    ask = np.flatnonzero(same & (span > 0))
    if len(ask):
        n = span[ask]
        total = np.cumsum(n)
        rank = np.arange(total[-1]) - np.repeat(total - n, n)
        equal = data[np.repeat(starts[ask], n) + rank] == other[np.repeat(other_starts[ask], n) + rank]
        same[ask] = np.logical_and.reduceat(equal, total - n)
    return same


def digests(data: np.ndarray, starts: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each run of bytes, as two 64-bit lanes.

    A quick hash brings equal runs together, their bytes are then compared, so
    only one of them is digested; a run whose bytes differ from those of the
    first with its quick hash is digested on its own.
    """
    rank = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    with np.errstate(over="ignore"):
        value = (data[np.repeat(starts, span) + rank].astype(np.uint64) + np.uint64(1)) * powers(int(span.max()) + 1)[rank]
        quick = mix(np.add.reduceat(value, np.cumsum(span) - span))
    _, first, back = np.unique(quick, return_index=True, return_inverse=True)
    model = first[back]
    odd = np.flatnonzero(~same_runs(data, starts, span, data, starts[model], span[model]))
    ask = np.concatenate([first, odd])
    raw = data.tobytes()
    found = b"".join([hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(starts[ask].tolist(), span[ask].tolist(), strict=True)])
    lanes = np.frombuffer(found, "<u8").reshape(-1, 2)
    out = lanes[: len(first)][back]
    out[odd] = lanes[len(first) :]
    return out


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit digests as two lanes, starts, word offsets by text) of all words."""
    code = table[data]
    inside = code > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros((0, 2), np.uint64), starts, np.zeros(len(offs), np.int64)
    inner = np.r_[0, np.cumsum(inside)]
    span = np.diff(inner[np.r_[starts, len(data)]])  # bytes of a word up to the next start are all inside or none is
    return digests((code - 1).astype(np.uint8), starts, span), starts, np.searchsorted(starts, offs)


def word_prefixes(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes (6 at most) of each word, or all of a shorter one, spelled in one number: exact."""
    code = np.concatenate([table[data], np.zeros(size, table.dtype)])
    h, alive = np.full(len(starts), np.uint64(size)), np.ones(len(starts), bool)
    stop = offs[np.searchsorted(offs, starts, "right")] if len(starts) else starts
    for k in range(size):
        c = code[starts + k]
        alive &= (c > 0) & (starts + k < stop)
        h = (h << np.uint64(9)) | np.where(alive, c, 0).astype(np.uint64)
    return h


def _chained(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The two lanes of a shingle, each from its own lane of the next word."""
    return np.stack([mix(acc[:, 0] * _B + word[:, 0]), mix(acc[:, 1] * _M2 + word[:, 1])], 1)


def shingles(h: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit values as two lanes, text of each) of the k-word shingles; a shorter text is one shingle."""
    n = np.diff(woffs)
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            acc = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                acc = _chained(acc, h[i : len(h) - k + 1 + i])
            keep = doc[: len(acc)] == doc[k - 1 :]
            out, of = acc[keep], doc[: len(acc)][keep]
        else:
            out, of = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra = []
            for d in short:
                acc = np.full((1, 2), np.uint64(n[d])) * _M2
                for x in h[woffs[d] : woffs[d + 1]]:
                    acc = _chained(acc, x[None])
                extra.append(acc[0])
            out, of = np.concatenate([out, np.array(extra, np.uint64)]), np.r_[of, short]
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of


def distinct_pairs(x: np.ndarray) -> np.ndarray:
    """The distinct rows of two lanes, sorted by the first lane and then the second."""
    order = np.argsort(x[:, 0], kind="stable")
    x = x[order]
    equal = x[1:, 0] == x[:-1, 0]
    if (equal & (x[1:, 1] != x[:-1, 1])).any():
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        equal = x[1:, 0] == x[:-1, 0]
    return x[np.r_[True, ~(equal & (x[1:, 1] == x[:-1, 1]))]] if len(x) else x


def distinct_shingles(data: np.ndarray, offs: np.ndarray, k: int, table: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of every text, as rows of two lanes."""
    h, _, woffs = words(data, offs, table)
    s, of = shingles(h, woffs, k)
    at = np.searchsorted(of, np.arange(len(offs)))
    return [distinct_pairs(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
