"""SentencePiece models on the tokenizers library: encoding, decoding, parity."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.bytetext import pieces, text_buffer
from mailquarry.llm.segment_cache import SegmentCache
from mailquarry.llm.storage import bounded_batches, documents, trimmed

#: Segments that a worker remembers.
REMEMBERED = 1_500_000
#: Threads of one call into the libraries; Spark's tasks already fill the cores, so few.
THREADS = 2
# Fixed values of the SentencePiece model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed32 and fixed64 as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        if at + size > len(data):
            raise ValueError("truncated model")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a model file says: pieces with scores and types, and how text is normalised."""

    kind: int = UNIGRAM
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    byte_fallback: bool = False
    unk_id: int = 0
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse_model(data: bytes) -> PieceModel:
    out = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 24:
                    out.suffix = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
                elif n == 40:
                    out.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
                elif n == 5:
                    out.escape = bool(v)
    unknown = [i for i, (_, _, t) in enumerate(out.pieces) if t == UNKNOWN]
    out.unk_id = unknown[0] if unknown else out.unk_id
    if out.kind not in (UNIGRAM, BPE) or out.suffix or not out.escape or any(t == USER_DEFINED for *_, t in out.pieces):
        raise ValueError("only unigram and BPE models with a prefix marker and without user-defined pieces are supported")
    return out


def _merges(pieces: list[tuple[str, float, int]], ids: dict[str, int]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score of the third first."""
    found = []
    for i, (piece, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    found.append((-score, i, a, b))
    return [(pieces[a][0], pieces[b][0]) for *_, a, b in sorted(found)]


class PieceTokenizer:
    """A SentencePiece model rebuilt with the tokenizers library.

    The normaliser's character map, the space marker with its dummy prefix,
    unigram scores or BPE merges, and byte fallback are taken from the model
    file. ``threads`` is what one call of ``encode_batch`` may use.
    """

    def __init__(self, path: str, threads: int = THREADS, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.model = m = parse_model(f.read())
        usable = {p: i for i, (p, _, t) in enumerate(m.pieces) if t == NORMAL}
        if m.kind == BPE:
            vocab = {p: i for i, (p, *_) in enumerate(m.pieces)}
            core = models.BPE(vocab=vocab, merges=_merges(m.pieces, usable), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
        self.core = Tokenizer(core)
        self.core.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.map = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.hidden = {i for i, (_, _, t) in enumerate(m.pieces) if t == CONTROL}
        #: No piece has text and then a marker, so no token reaches over the start of a word.
        self.by_word = all(re.search(f"[^{SPACE}]{SPACE}", p) is None for p, _, t in m.pieces if t == NORMAL)
        self.threads, self.other = threads, None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = SegmentCache(self._cut, self._encode, lambda t: self._encode([t])[0], REMEMBERED)
        self.cache.noted = self._noted
        #: Normalisation leaves the text as it is, but for the dummy prefix.
        self.plain = self.map is None and not m.squeeze and m.dummy_prefix

    def normal(self, text: str) -> str:
        """The normalised text with the dummy prefix, markers as spaces; empty stays empty."""
        if self.map is not None:
            text = self.map.normalize_str(text)
        text = text.replace(SPACE, " ")
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (" " if self.model.dummy_prefix else "") + text if text else ""

    def _normal_buffer(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, offsets, whether decoding can give the text back) after normalisation."""
        size = np.diff(offs)
        raw = data.tobytes()
        if self.plain and SPACE.encode() not in raw:
            full = size > 0
            return np.insert(data, offs[:-1][full], np.uint8(32)), np.r_[0, np.cumsum(size + full)], np.ones(len(size), bool)
        texts = [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        changed = [self.normal(t).encode() for t in texts]
        same = [(n[1:] if self.model.dummy_prefix else n) == t.encode() for n, t in zip(changed, texts, strict=True)]
        return np.frombuffer(b"".join(changed), np.uint8), np.r_[0, np.cumsum([len(c) for c in changed])].astype(np.int64), np.array(same, bool)

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(data), bool)
        if self.by_word:
            first[1:] = (data[1:] == 32) & (data[:-1] != 32)
        first[offs[:-1][np.diff(offs) > 0]] = True
        return np.flatnonzero(first), np.zeros(len(offs) - 1, bool)

    def _encode(self, segments: list[bytes]) -> list[list[int]]:
        """Ids of segments, all in one multithreaded call."""
        texts = b"\0".join(segments).decode().replace(" ", SPACE).split("\0")
        if len(texts) != len(segments):  # a text has that character itself
            texts = [s.decode().replace(" ", SPACE) for s in segments]
        return [e.ids for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]

    def _noted(self, segments: list[bytes], ids: list[list[int]]) -> list[int]:
        """1 where decoding gives another text than the segment."""
        back = self.core.decode_batch(ids, skip_special_tokens=False)
        return [int(x != s.decode()) for x, s in zip(back, segments, strict=True)]

    def checked(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """(ids, offsets, whether the other library agrees, whether decoding gives the text back) of a buffer of texts.

        The other library encodes every whole text. Decoding is asked once for
        each distinct segment, as no piece reaches over two of them.
        """
        ready, at, same = self._normal_buffer(data, offs)
        ids, ends, flags = self.cache.ids(ready, at)
        parity = np.ones(len(offs) - 1, bool)
        if self.other is not None:
            raw = data.tobytes()
            for i, j in pieces(offs):
                texts = [raw[a:b].decode() for a, b in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True)]
                theirs = self.other.encode(texts, num_threads=self.threads)
                size = np.array([len(x) for x in theirs])
                flat = np.fromiter(chain.from_iterable(theirs), np.uint32, int(size.sum()))
                own, n = ids[ends[i] : ends[j]], np.diff(ends[i : j + 1])
                parity[i:j] = n == size
                if len(own) == len(flat) and parity[i:j].all():
                    wrong = np.flatnonzero(own != flat)
                    parity[i - 1 + np.searchsorted(ends[i : j + 1] - ends[i], wrong, "right")] = False
                else:
                    cut = np.r_[0, np.cumsum(size)]
                    for k in np.flatnonzero(parity[i:j]):
                        parity[i + k] = bool((ids[ends[i + k] : ends[i + k + 1]] == flat[cut[k] : cut[k + 1]]).all())
        return ids, ends, parity.tolist(), (same & (flags & 1 == 0)).tolist()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        raw = [t.encode() for t in texts]
        ids, at, *_ = self.checked(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64))
        return [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces have none."""
        text = self.core.decode([i for i in ids if i not in self.hidden], skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_tokenizers: dict[tuple, PieceTokenizer] = {}


def tokenizer(path: str, threads: int = THREADS, verify: bool = True) -> PieceTokenizer:
    """One tokenizer for each worker and model."""
    key = (path, threads, verify)
    if key not in _tokenizers:
        _tokenizers[key] = PieceTokenizer(path, threads, verify)
    return _tokenizers[key]


def encode_documents(docs: DataFrame, path: str, threads: int = THREADS, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity, round_trip[, ids]) for every whole text.

    ``parity``: the sentencepiece library gives the same ids for the whole
    text, which it encodes on its own. Every row gives one row, also with a
    null or repeated doc_id. ``round_trip``:
    decoding gives the text back; it is false where the text holds the space
    marker itself or the normaliser changes it. A null or empty text has no
    ids. Columns other than doc_id and text are not looked at.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, threads)
        for batch in batches:
            ids, at, parity, trip = tok.checked(*text_buffer(batch.column(1)))
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(parity, pa.bool_()), pa.array(trip, pa.bool_())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * keep_ids)
            trimmed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tok.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document by the 32k BPE model, with parity and round trip."""
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
