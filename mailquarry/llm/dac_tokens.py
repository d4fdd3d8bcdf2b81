"""Token ids in binary files of directly addressable codes.

A shard file holds the ids of consecutive documents. Each id is cut into
8-bit chunks, lowest first; level k has the k-th chunks of the ids that have
one, a bitmap says which of them continue on the next level, and a directory
of the ones before each 512-bit block turns a position on one level into the
position on the next. Any token is read from its chunks alone.

Layout, all integers little-endian: magic ``DAC1``; uint32 number of levels;
uint64 documents; uint64 tokens; int64 doc_id of each document; uint64 first
token of each document and the end; then for each level uint64 chunks, the
chunks (one byte each) and, but for the last level, the bitmap (bit i of byte
i // 8 is i % 8) and the directory (uint64 for each block).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.llm.bytetext import text_buffer
from mailquarry.llm.segment_cache import SegmentCache
from mailquarry.llm.storage import bounded_batches, documents, fresh_path, settled, stored, trimmed

MAGIC, BLOCK = b"DAC1", 512
#: A shard is closed when it has so many tokens.
SHARD_TOKENS = 4_000_000
END = 0


def pack(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file from document ids, token offsets (one more than documents) and token ids."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(offsets, "<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k + 1 < len(levels):
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class Shard:
    """A reader of one shard file, over its bytes or a memory map."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a DAC1 file")
        n_levels, self.n_docs, self.n_tokens = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = np.zeros(0, np.uint8)
            if k + 1 < n_levels:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
                at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """Token i, from one chunk and one rank for each of its levels."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if len(bits):
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= value << np.uint32(8)
            value = here
        return value

    def document(self, k: int) -> list[int]:
        return [self.token(i) for i in range(self.offsets[k], self.offsets[k + 1])]


# Kinds of bytes: ASCII white space, letters (ASCII, and Latin-1 in two bytes), other ASCII.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1
_CONTROL = np.zeros(256, bool)
_CONTROL[[11, 12, 28, 29, 30, 31]] = True


def _cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts before white space that follows other text, and after a run of letters before other ASCII.

    Texts with other white space or with anything beyond Latin-1 letters and
    ASCII are encoded whole.
    """
    kind = _KIND[data]
    first = np.zeros(len(data), bool)
    first[1:] = ((kind[1:] == 0) & (kind[:-1] != 0)) | ((kind[1:] == 2) & (kind[:-1] == 1))
    first[offs[:-1][np.diff(offs) > 0]] = True
    strange = _CONTROL[data] | (data > 0xC3) | (data == 0xC2)
    strange[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    whole = np.zeros(len(offs) - 1, bool)
    if strange.any():
        whole[np.searchsorted(offs, np.flatnonzero(strange), "right") - 1] = True
    return np.flatnonzero(first), whole


#: A segment that the pattern takes as one word: it goes straight to the merges.
_WORD = re.compile(b" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_alphabet() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(others)) for b in range(256)}


def byte_level_encoder(path: str) -> SegmentCache:
    """Ids by the tokenizers library for a byte-level BPE file whose words are cut by the usual pattern."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    merge = tok.model.tokenize
    letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def whole(text: bytes) -> list[int]:
        return tok.encode(text.decode(), add_special_tokens=False).ids

    def encode(segments: list[bytes]) -> list[list[int]]:
        return [[t.id for t in merge(s.decode("latin-1").translate(letters))] if _WORD.fullmatch(s) else whole(s) for s in segments]

    return SegmentCache(_cut, encode, whole)


_encoders: dict[str, SegmentCache] = {}


def _write(batches: Iterator[pa.RecordBatch], vocabulary: str, folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    store, base = fs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    if vocabulary not in _encoders:
        _encoders[vocabulary] = byte_level_encoder(vocabulary)
    encoder = _encoders[vocabulary]
    docs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    seq = total = 0

    def close() -> pa.RecordBatch:
        nonlocal seq, total
        offsets = np.r_[0, np.cumsum(np.concatenate(sizes))]
        name = f"{part:08d}-{seq:06d}.dac"
        draft = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(pack(np.concatenate(docs), offsets, np.concatenate(parts)))
        store.move(draft, f"{base}/{name}")  # a repeated task puts the same bytes in the same place
        row = pa.RecordBatch.from_pylist([{"shard": name, "docs": len(offsets) - 1, "tokens": int(offsets[-1])}])
        docs.clear(), sizes.clear(), parts.clear()
        trimmed()
        seq, total = seq + 1, 0
        return row

    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        ids, at, _ = encoder.ids(data, offs, END)
        if len(offs) > 1:
            docs.append(batch.column(0).to_numpy())
            sizes.append(np.diff(at))
            parts.append(ids)
            total += len(ids)
        if total >= SHARD_TOKENS:
            yield close()
    if total:
        yield close()


def write_shards(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Write the ids of every document, in ascending doc_id order, as shard files; (shard, docs, tokens).

    Names of the files sort as the documents do. A null or empty text has the
    end id alone. Rows without a doc_id are left out; rows that repeat a doc_id
    are all written, ordered by text. Only doc_id and text are looked at.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    bounded_batches(spark)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(lambda it: _write(it, vocabulary, folder), "shard string, docs long, tokens long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(content.as_buffer())
            ids = shard.all().astype("<u4").tobytes()
            view, at = memoryview(ids), shard.offsets
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * shard.n_docs, pa.string()), pa.array(shard.doc_ids), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, first, n_tokens, ids_crc32) of every document in the files of a folder."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    return files.mapInArrow(_read, "shard string, doc_id long, first long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Write the shard files, read them back: (doc_id, start, n_tokens, ids_crc32, shard)."""
    spark = docs.sparkSession
    manifest = settled(spark, lambda: write_shards(docs, vocabulary, folder), "shards")
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    base = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return read_shards(spark, folder).join(base, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op2_dac(spark, sf_dir: str) -> DataFrame:
    """The whole documents table in files under the shared folder, read back."""
    import public_tokenizers

    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "tokens"))
