"""Repeated byte strings across documents, by two-stage suffix sorting of dealt-out text.

A string of ``span`` bytes that two documents share has the same smallest
k-byte gram in both, at the same place. These grams (anchors) deal the text
around them to shards: a shard gets every text, in the whole corpus, that
could share a string around its anchors, sorts the suffixes and reads off the
common prefixes. Anchors that only one document has are never sent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.bytetext import mix, pieces, text_buffer
from mailquarry.llm.storage import bounded_batches, documents, dropped, freed, fresh_path, stored, stored_at, trimmed

SPAN = 50
#: Bytes of an anchor.
GRAM = 20
#: Bytes of text in which anchors are looked for at once; a longer text goes alone.
PIECE = 1 << 18
#: Contexts that are cut out, and contexts that are sorted, at once.
CHUNK, SORTED = 20_000, 30_000
#: Rows (document ids) that are broadcast to leave copies out; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
#: Bits by which the anchors of a bucket are told apart; four more say how often one occurs.
_LOW = np.uint64((1 << 36) - 1)
#: Bytes of text in one part of the corpus, about; the number of parts follows from the input.
PART_BYTES = 32 << 20
#: An anchor is hot if it occurs about so often, in several documents.
HOT_CONTEXTS = 200_000
#: Bytes before a hot anchor that split its contexts.
BEFORE = 8
_HOT = np.uint64(1 << 63)
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte substring."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        block, size, power = data.astype(np.uint64) + np.uint64(1), 1, _B
        acc, at, rest = np.zeros(n, np.uint64), 0, k
        while rest:
            if rest & 1:
                acc = acc * power + block[at : at + n]
                at += size
            rest >>= 1
            if rest:
                block = block[:-size] * power + block[size:]
                size, power = 2 * size, power * power
        return mix(acc)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    if width > size:
        x = pick(x[: len(x) - (width - size)], x[width - size :])
    return x


def anchors(data: np.ndarray, offs: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, texts) of the grams that are smallest in some string of ``span`` bytes within a text."""
    width = span - gram + 1
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = rolling(data, gram)
    least = _sliding(h, width, np.minimum)
    end = np.repeat(offs[1:], np.diff(offs))
    inside = np.arange(len(least)) + span <= end[: len(least)]
    least = np.where(inside, least, 0)  # strings over a text's end choose nothing
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((most == h) & (h > 0))
    return at, h[at], np.searchsorted(offs, at, "right") - 1


def contexts(data: np.ndarray, offs: np.ndarray, at: np.ndarray, of: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes around each anchor, bytes of the text there are to the left, to the right); zeros outside the text."""
    side = span - gram
    left = np.minimum(at - offs[of], side)
    right = np.minimum(offs[of + 1] - at - gram, side)
    pad = np.zeros(side, np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, data, pad]), 2 * side + gram)[at]
    column = np.arange(-side, gram + side, dtype=np.int32)[None]
    out[(column < -left[:, None].astype(np.int32)) | (column >= gram + right[:, None].astype(np.int32))] = 0
    return out, left, right


def context_codes(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row of bytes (a multiple of 8 wide), as two 64-bit lanes."""
    one, two = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
    with np.errstate(over="ignore"):
        for w in full.view("<u8").T:
            one = mix(one * _B + w + np.uint64(1))
            two = mix((two ^ w) * _C + _D)
    return one, two


def equal_groups(ctx: np.ndarray) -> tuple[np.ndarray, int]:
    """(group of each row, number of groups): rows of a group have the same bytes, compared whole."""
    wide = -(-ctx.shape[1] // 8) * 8
    code = np.zeros(len(ctx), np.uint64)
    for a in range(0, len(ctx), CHUNK):
        full = np.zeros((len(ctx[a : a + CHUNK]), wide), np.uint8)
        full[:, : ctx.shape[1]] = ctx[a : a + CHUNK]
        code[a : a + CHUNK] = context_codes(full)[0]
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    model = first[back]
    odd = [a + np.flatnonzero((ctx[a : a + CHUNK] != ctx[model[a : a + CHUNK]]).any(1)) for a in range(0, len(ctx), CHUNK)]
    odd = np.concatenate(odd) if odd else np.zeros(0, np.int64)
    back[odd] = len(first) + np.arange(len(odd))
    return back, len(first) + len(odd)


def _words(padded: np.ndarray, at: np.ndarray, span: int) -> list[np.ndarray]:
    """The ``span`` bytes from each position as big-endian 64-bit words."""
    view = np.ndarray((padded.size - 8,), ">u8", padded, 0, (1,))
    out = []
    for k in range(0, span, 8):
        w = view[at + k].astype(np.uint64)
        if span - k < 8:
            w &= np.uint64(~((1 << 8 * (8 - span + k)) - 1) & (1 << 64) - 1)
        out.append(w)
    return out


def two_stage_order(rows: np.ndarray, starts: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of the texts in ``rows`` that begin in their first ``starts`` bytes, and common prefixes.

    Returns (row * width + offset in sorted order, common prefix of each with
    the one before, at most ``span``). Only suffixes smaller than their
    successors are sorted directly, by their bytes; the others are induced: a
    scan over the buckets of first bytes, in order, puts each suffix's
    predecessor, if that is larger than its successor, at the next place in
    its own bucket. Order is exact up to ``span`` bytes.
    """
    m, width = rows.shape
    t = np.ascontiguousarray(rows.T)
    small = np.zeros((width, m), bool)  # suffix smaller than its successor; a row's end is smallest of all
    for j in range(width - 2, -1, -1):
        small[j] = (t[j] < t[j + 1]) | ((t[j] == t[j + 1]) & small[j + 1])
    tail = small[starts - 1 :]
    limit = np.where(tail.any(0), starts - 1 + tail.argmax(0), width)  # the first directly sorted one that the last needed one leads to
    member = np.arange(width)[:, None] <= limit[None]
    flat_small, flat_t = np.ascontiguousarray(small.T).ravel(), np.ascontiguousarray(rows).ravel()
    padded = np.zeros((m, width + span + 8), np.uint8)
    padded[:, :width] = rows
    padded, wide = padded.ravel(), width + span + 8

    where = lambda p: p // width * wide + p % width
    direct = np.flatnonzero(np.ascontiguousarray((small & member).T).ravel())
    keys = _words(padded, where(direct), span)
    direct = direct[np.lexsort(keys[::-1])]
    of = flat_t[direct]
    cut = np.searchsorted(of, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(before: list[np.ndarray], above: int) -> None:
        """Hand the predecessors of scanned suffixes to the buckets after ``above``, in scan order."""
        p = np.concatenate(before) if before else np.zeros(0, np.int64)
        p = p[flat_t[p].astype(np.int64) > above]
        if len(p):
            order = np.argsort(flat_t[p], kind="stable")
            p, c = p[order], flat_t[p][order]
            edges = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            for a, b in zip(edges, [*edges[1:], len(c)], strict=True):
                induced[c[a]].append(p[a:b])

    def larger_before(p: np.ndarray) -> np.ndarray:
        p = p[p % width > 0] - 1
        return p[~flat_small[p]]

    deal([np.flatnonzero(limit == width) * width + width - 1], -1)
    out = []
    for c in range(256):
        queue = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        before = []
        while len(queue):  # suffixes that begin with a run of this byte follow within the bucket
            out.append(queue)
            p = larger_before(queue)
            before.append(p)
            queue = p[flat_t[p] == c]
        own = direct[cut[c] : cut[c + 1]]
        out.append(own)
        before.append(larger_before(own))
        deal(before, c)
    order = np.concatenate(out)
    order = order[order % width < starts]
    prefix = np.zeros(len(order), np.int64)
    if len(order) > 1:
        open_ = np.ones(len(order) - 1, bool)
        for k, w in enumerate(_words(padded, where(order), span)):
            off = w[1:] ^ w[:-1]
            same = open_ & (off == 0)
            part = np.flatnonzero(open_ & (off != 0))
            lead = np.zeros(len(part), np.int64)
            for byte in range(7):
                lead += (off[part] >> np.uint64(56 - 8 * byte) == 0)
            prefix[1:][part] = 8 * k + lead
            open_ = same
        prefix[1:][open_] = span
    return order, np.minimum(prefix, span)


def shared_strings(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, smallest doc with the same string) of each whole string of ``span`` bytes in the contexts."""
    starts, width = span - gram + 1, rows.shape[1]
    order, prefix = two_stage_order(rows, starts, span)
    row, off = order // width, order % width
    whole = (off >= starts - 1 - left[row]) & (off <= right[row])
    # the common prefix with the last whole one before is the least of those in between
    group = np.cumsum(prefix < span)[whole]
    row, off = row[whole], off[whole]
    if not len(row):
        return row, off, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(doc[row], first)
    return row, off, np.repeat(least, np.diff(np.r_[first, len(row)]))


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by [start, stop)."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[np.r_[new[1:] - 1, len(start) - 1]] if len(start) else reach


def _packed(entries: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in entries], pa.int32()), pa.array([x.tobytes() for _, x in entries], pa.binary())], names=["bucket", "blob"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], buckets: int, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """part, doc_id, text -> (part, bucket, blob of the distinct anchors in the part; the lowest four bits: 0 for one document, else the logarithm of the occurrences)."""
    for batch in batches:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offs = text_buffer(batch.column(2))
        for i, j in pieces(offs, PIECE):
            _, h, of = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], span, gram)
            for p in np.unique(part[i:j]):
                own = part[i:j][of] == p
                found.setdefault(int(p), []).append((h[own], doc[i:j][of[own]]))
        for p, xs in found.items():
            h, d = (np.concatenate(z) for z in zip(*xs, strict=True))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            times = np.where(several, np.clip(np.log2(np.diff(np.r_[first, len(h)])), 1, 15), 0).astype(np.uint64)
            h = h[first]
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            entry = ((h & _LOW) << np.uint64(4)) | times
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            entry = entry[order].view(np.uint8).reshape(-1, 8)[:, :5]
            rows = [(b, entry[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b + 1] > cut[b]]
            packed = _packed(rows)
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int32()), *packed.columns], names=["part", "bucket", "blob"])
        trimmed()


def _five(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _shared_rows(table: pa.Table, hot: int) -> pa.Table:
    """One bucket -> (part, bucket, blob of the anchors there that more than one row, or one with several documents, has).

    The highest bit of an anchor tells that it occurs about ``hot`` times or
    more; all parts are told the same.
    """
    parts = table.column("part").to_pylist()
    rows = [_five(b) for b in table.column("blob").to_pylist()]
    entry = np.concatenate(rows)
    h, times = entry >> np.uint64(4), entry & np.uint64(15)
    found, back, n = np.unique(h, return_inverse=True, return_counts=True)
    several = np.zeros(len(found), bool)
    several[back[times > 0]] = True
    often = np.bincount(back, weights=np.exp2(times.astype(float)), minlength=len(found)) >= hot
    good = ((n > 1) | several)[back]
    h = h | np.where(often, _HOT, np.uint64(0))[back]
    of = np.repeat(np.array(parts), [len(r) for r in rows])
    kept, of = h[good], of[good]
    out = [(int(p), np.unique(kept[of == p])) for p in np.unique(of)]
    return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()), "blob": pa.array([x.tobytes() for _, x in out], pa.binary())})


def _flagged(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted anchors, whether each is hot)."""
    low = values & ~_HOT
    order = np.argsort(low, kind="stable")
    return low[order], (values[order] & _HOT) > 0


def hot_buckets(full: np.ndarray, low: np.ndarray, buckets: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each context of a hot anchor: by the bytes before it, and by those after it.

    A common string that begins BEFORE bytes or more ahead of the anchor has
    the same bytes before it in both documents; one that begins later has the
    same span - gram - BEFORE + 1 bytes after it. So every common string has a
    bucket that all its contexts are in, and no anchor fills one bucket.
    """
    side = span - gram
    ahead = np.ascontiguousarray(full[:, side - BEFORE : side]).view("<u8")[:, 0]
    size = side - BEFORE + 1
    after = np.zeros((len(full), -(-size // 8) * 8), np.uint8)
    after[:, :size] = full[:, side + gram : side + gram + size]
    with np.errstate(over="ignore"):
        one, two = mix((low ^ ahead) * _C + _D), low * _C
        for w in after.view("<u8").T:
            two = mix(two * _B + w + np.uint64(1))
    return (one % np.uint64(buckets)).astype(np.int64), (two % np.uint64(buckets)).astype(np.int64)


def _context_rows(texts: pa.Table, shared: pa.Table, buckets: int, span: int, gram: int) -> pa.Table:
    """A part's texts and shared anchors -> its distinct contexts for each bucket, and where they occur."""
    trimmed()
    width = 2 * span - gram
    split = span - gram >= BEFORE
    known = {b: _flagged(np.concatenate([np.frombuffer(x, "<u8") for x, c in zip(shared.column("blob").to_pylist(), shared.column("bucket").to_pylist(), strict=True) if c == b])) for b in set(shared.column("bucket").to_pylist())}
    rows: list[tuple[int, int, bytes]] = []
    if known and texts.num_rows:
        texts = texts.sort_by([("doc_id", "ascending")])  # so the first text with a context is the one with the smallest doc_id
        part = texts.column("part")[0].as_py()
        doc = texts.column("doc_id").to_numpy()
        tid = texts.column("tid").to_numpy()
        data, offs = text_buffer(texts.column("text"))
        size = -(-(width + 2) // 8) * 8
        kind = np.dtype([("id", "<u4"), ("doc", "<i8"), ("ctx", "u1", width + 2)])
        seen, other, number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)  # both lanes and the id of each context
        blobs: dict[int, list[bytes]] = {}
        occ: list[bytes] = []
        made = 0
        for i, j in pieces(offs, PIECE):
            own, at_offs = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            at, h, of = anchors(own, at_offs, span, gram)
            bucket, low = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), h & _LOW
            good, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, (have, flag) in known.items():
                mine = order[cut[b] : cut[b + 1]]
                spot = np.searchsorted(have, low[mine])
                spot[spot == len(have)] = 0
                good[mine] = have[spot] == low[mine]
                hot[mine] = flag[spot] & split
            at, of, bucket, low, hot = at[good], of[good], bucket[good], low[good], hot[good]
            for k in range(0, len(at), CHUNK):
                a, o, b_of = at[k : k + CHUNK], of[k : k + CHUNK], bucket[k : k + CHUNK]
                full = np.zeros((len(a), size), np.uint8)
                full[:, :width], full[:, width], full[:, width + 1] = contexts(own, at_offs, a, o, span, gram)
                one, two = context_codes(full)
                found, first, back = np.unique(one, return_index=True, return_inverse=True)
                spot = np.searchsorted(seen, found)
                spot[spot == len(seen)] = 0
                new = seen[spot] != found if len(seen) else np.ones(len(found), bool)
                lane, ids = two[first], np.zeros(len(found), np.int64)
                lane[~new], ids[~new] = other[spot[~new]], number[spot[~new]]
                ids[new] = made + np.arange(new.sum())
                made += int(new.sum())
                ids_of = ids[back]
                odd = np.flatnonzero(two != lane[back])  # another context with this first lane: sent for itself
                ids_of[odd] = made + np.arange(len(odd))
                made += len(odd)
                where = np.zeros(len(a), [("id", "<u4"), ("text", "<i4"), ("at", "<i4")])
                where["id"], where["text"], where["at"] = ids_of, o + i, a - at_offs[o]
                occ.append(where.tobytes())
                sent = np.concatenate([first[new], odd])
                put = np.searchsorted(seen, found[new])
                seen, other, number = np.insert(seen, put, found[new]), np.insert(other, put, lane[new]), np.insert(number, put, ids[new].astype(np.uint32))
                to = b_of[sent]
                warm = np.flatnonzero(hot[k : k + CHUNK][sent])
                if len(warm):  # in place of the anchor's bucket, two others
                    x, y = hot_buckets(full[sent[warm]], low[k : k + CHUNK][sent[warm]], buckets, span, gram)
                    to[warm] = x
                    sent, to = np.concatenate([sent, sent[warm]]), np.concatenate([to, y])
                order = np.argsort(to, kind="stable")
                sent, to = sent[order], to[order]
                rec = np.zeros(len(sent), kind)
                rec["id"], rec["doc"], rec["ctx"] = ids_of[sent], doc[o[sent] + i], full[sent, : width + 2]
                cut = np.searchsorted(to, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    blobs.setdefault(int(b), []).append(rec[cut[b] : cut[b + 1]].tobytes())
        if occ:
            rows = [(b, part, b"".join(x)) for b, x in blobs.items()]
            rows += [(-1, part, b"".join(occ)), (-2, part, np.stack([doc, tid]).astype("<i8").tobytes())]
    blobs = occ = texts = data = None  # only the rows are needed from here on
    out = pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})
    rows.clear()
    trimmed()
    return out


def _sorted_rows(span: int, gram: int):
    width, starts = 2 * span - gram, span - gram + 1
    kind = np.dtype([("id", "<u4"), ("doc", "<i8"), ("ctx", "u1", width + 2)])
    runs_kind = np.dtype([("id", "<u4"), ("doc", "<i8"), ("from", "u1"), ("to", "u1")])

    def sort(table: pa.Table) -> pa.Table:
        """One shard -> for each part the runs of offsets of its contexts with the smallest document that has the string."""
        trimmed()
        blobs = [np.frombuffer(b, kind) for b in table.column("blob").to_pylist()]
        cuts = np.r_[0, np.cumsum([len(b) for b in blobs])]
        rec = np.concatenate(blobs)
        blobs.clear()
        back, groups = equal_groups(rec["ctx"])
        doc = np.full(groups, np.iinfo(np.int64).max)
        np.minimum.at(doc, back, rec["doc"])
        one = np.zeros(groups, np.int64)
        one[back] = np.arange(len(rec))
        ctx = rec["ctx"][one]
        # shards of text of a bounded size: equal strings have equal anchors, so anchors are never split
        gram_hash = np.zeros(len(ctx), np.uint64)
        with np.errstate(over="ignore"):
            for c in range(span - gram, span):
                gram_hash = gram_hash * _B + ctx[:, c] + np.uint64(1)
        order = np.argsort(gram_hash, kind="stable")
        result = []
        a = 0
        while a < len(order):
            b = min(len(order), a + SORTED)
            while b < len(order) and gram_hash[order[b]] == gram_hash[order[b - 1]]:
                b += 1
            own = order[a:b]
            row, off, least = shared_strings(ctx[own][:, :width], ctx[own][:, width].astype(np.int64), ctx[own][:, width + 1].astype(np.int64), doc[own], span, gram)
            sort_ = np.lexsort((off, row))
            row, off, least = own[row[sort_]], off[sort_], least[sort_]
            if len(row):
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1) | (least[1:] != least[:-1])])
                last = np.r_[first[1:] - 1, len(row) - 1]
                runs = np.zeros(len(first), [("group", "<i8"), *runs_kind.descr[1:]])
                runs["group"], runs["doc"], runs["from"], runs["to"] = row[first], least[first], off[first], off[last]
                result.append(runs)
            a = b
        if not result:
            return pa.table({"part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        runs = np.concatenate(result)
        runs = runs[np.argsort(runs["group"], kind="stable")]
        out = []
        for p, a, b in zip(table.column("part").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = back[a:b]
            lo, hi = np.searchsorted(runs["group"], mine), np.searchsorted(runs["group"], mine, "right")
            n = hi - lo
            take = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            told = np.zeros(len(take), runs_kind)
            told["id"] = np.repeat(rec["id"][a:b], n)
            for x in ("doc", "from", "to"):
                told[x] = runs[x][take]
            out.append((int(p), told.tobytes()))
        trimmed()
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def spans(places: pa.Table, runs: pa.Table) -> pa.Table:
        """A part's occurrences and runs -> removed spans of its texts."""
        side = span - gram
        empty = {"part": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "tid": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())}
        if not places.num_rows or not runs.num_rows:
            return pa.table(empty)
        blob = dict(zip(places.column("bucket").to_pylist(), places.column("blob").to_pylist(), strict=True))
        occ = np.frombuffer(blob[-1], [("id", "<u4"), ("text", "<i4"), ("at", "<i4")])
        doc, tid = np.frombuffer(blob[-2], "<i8").reshape(2, -1)
        r = np.concatenate([np.frombuffer(b, runs_kind) for b in runs.column("blob").to_pylist()])
        r = r[np.argsort(r["id"], kind="stable")]
        lo, hi = np.searchsorted(r["id"], occ["id"]), np.searchsorted(r["id"], occ["id"], "right")
        n = hi - lo
        take = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        o = np.repeat(np.arange(len(occ)), n)
        text = occ["text"][o]
        good = r["doc"][take] < doc[text]
        if not good.any():
            return pa.table(empty)
        text, start = text[good], occ["at"][o][good].astype(np.int64) - side + r["from"][take][good]
        stop = occ["at"][o][good].astype(np.int64) - side + r["to"][take][good] + span
        order = np.argsort(text, kind="stable")
        text, start, stop = text[order], start[order], stop[order]
        cut = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else []
        ids, blobs = [], []
        for a, b in zip(cut, [*cut[1:], len(text)], strict=True):
            x, y = merged_spans(start[a:b], stop[a:b])
            ids.append(int(text[a]))
            blobs.append(np.stack([x, y]).astype("<i8").tobytes())
        part = places.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(ids), pa.int32()), "doc_id": pa.array(doc[ids], pa.int64()), "tid": pa.array(tid[ids], pa.int64()), "spans": pa.array(blobs, pa.binary())})

    return sort, spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tid, text, spans -> what is left of the texts."""
    for batch in batches:
        data, offs = text_buffer(batch.column(2))
        raw = data.tobytes()
        kept, removed, runs = [], [], []
        for k, blob in enumerate(batch.column(3).to_pylist()):
            x, y = np.frombuffer(blob, "<i8").reshape(2, -1)
            text, at, out = raw[offs[k] : offs[k + 1]], 0, []
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                out.append(text[at:a])
                at = b
            kept.append(b"".join([*out, text[at:]]))
            removed.append(int((y - x).sum()))
            runs.append(len(x))
        columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame, str, str]:
    """(doc_id, tid, n_bytes, sha256, rows, first) of every distinct row, and (doc_id, tid, n_removed, n_spans, kept) of
    the texts that lose something but not everything; kept is binary. Then the catalog table of the texts and its place, to drop later."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    info = base.select("doc_id", F.xxhash64("text").alias("tid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    info = info.groupBy("doc_id", "sha256").agg(F.first("tid").alias("tid"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("rows"))
    info = stored(info, "texts_info")
    firsts = info.where(F.col("n_bytes") >= span).groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    info, _ = stored_at(info.join(firsts.where("copies > 1").select("sha256", "first"), "sha256", "left"), "texts_info")
    whole = info.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // PART_BYTES))
    copies = info.where("first < doc_id").select("doc_id", "tid")
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = base.where(F.octet_length("text") >= span).withColumn("tid", F.xxhash64("text")).join(F.broadcast(copies) if few else copies, ["doc_id", "tid"], "left_anti")
    twice = info.where((F.col("rows") > 1) & (F.col("n_bytes") >= span)).select("doc_id", "tid")
    some = twice.limit(BROADCAST_IDS + 1).count()
    if some:  # only rows that are repeated as a whole pay for being made distinct
        twice = F.broadcast(twice) if some <= BROADCAST_IDS else twice
        own = own.join(twice, ["doc_id", "tid"], "left_anti").unionByName(own.join(twice, ["doc_id", "tid"], "left_semi").distinct())

    name = f"mailquarry_texts_{uuid.uuid4().hex}"
    parted = own.select(F.pmod(F.xxhash64(F.lit(3), "doc_id", "tid"), F.lit(n)).cast("int").alias("part"), "doc_id", "tid", "text").repartition(n, "part")
    texts_at = fresh_path(spark, "texts")
    parted.write.bucketBy(n, "part").sortBy("part").option("path", texts_at).option("compression", "zstd").saveAsTable(name)
    freed(spark)
    texts = spark.table(name)

    rows = texts.select("part", "doc_id", "text").mapInArrow(lambda it: _anchor_rows(it, n, span, gram), "part int, bucket int, blob binary")
    hot = HOT_CONTEXTS
    shared = stored(rows.groupBy("bucket").applyInArrow(lambda t: _shared_rows(t, hot), "part int, bucket int, blob binary"), "shared_anchors")
    freed(spark)
    made, made_at = stored_at(
        texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda x, y: _context_rows(x, y, n, span, gram), "bucket int, part int, blob binary"),
        "contexts",
        "zstd",
    )
    freed(spark)
    sort, spans = _sorted_rows(span, gram)
    runs = stored(made.where("bucket >= 0").groupBy("bucket").applyInArrow(sort, "part int, blob binary"), "runs")
    found = stored(made.where("bucket < 0").groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(spans, "part int, doc_id long, tid long, spans binary"), "spans")
    dropped(spark, made_at)
    freed(spark)
    # the texts are already dealt by part, which is enough to bring equal rows together
    left = texts.join(found, ["part", "doc_id", "tid"]).select("doc_id", "tid", "text", "spans").mapInArrow(_kept, "doc_id long, tid long, n_removed long, n_spans long, kept binary")
    return info, left, name, texts_at


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, tid, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; tid is xxhash64 of the text.

    Every byte is removed that is covered by a ``span``-byte string which also
    starts in a document with a smaller doc_id; all is judged on the input.
    ``kept`` is binary and null where the text stays as it is. A null text
    counts as empty; rows without doc_id are left out; rows that are repeated
    as a whole give one row, and texts under the same doc_id don't remove from
    each other. Only doc_id and text are looked at.
    """
    spark = docs.sparkSession
    info, left, name, texts_at = repeated_spans(docs, span, gram)
    subset = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(subset, "true")
    spark.conf.set(subset, "false")
    try:
        left = stored(left.withColumn("kept_sha", F.sha2("kept", 256)), "kept")
    finally:
        spark.conf.set(subset, before)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dropped(spark, texts_at)
    freed(spark)
    whole = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return info.join(left, ["doc_id", "tid"], "left").select(
        "doc_id",
        "tid",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha256")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes over the whole documents table."""
    return remove_repeats(documents(spark, sf_dir)).drop("kept", "tid")
