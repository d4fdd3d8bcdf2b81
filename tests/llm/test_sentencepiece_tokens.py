from __future__ import annotations

import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from words import thue_morse  # noqa: E402

from mailquarry.llm import sentencepiece_tokens as s  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
MINE = s.PieceTokenizer(PATH)
THEIRS = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.lists(st.one_of(st.sampled_from([*" \n\tabcdeéßñ漢😀.,'", "the", "ing", "  ", "▁", "<s>", "<0x41>"]), st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00")), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_parity_with_the_sentencepiece_library(text):
    ids = THEIRS.encode(text)
    assert MINE.encode(text) == ids
    assert MINE.decode(ids) == THEIRS.decode(ids)


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _bytes(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def write_unigram(path, squeeze):
    """A hand-made unigram model: pieces with their scores, byte fallback, identity normaliser."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [(p, -1.0 - 0.37 * k, 1) for k, p in enumerate(["▁", "e", "t", "a", "▁the", "he", "▁t", "th", "ea", "at", "▁a", "tea", "▁tea", "ate"])]
    data = b""
    for p, score, kind in pieces:
        data += _bytes(1, _bytes(1, p.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(kind))
    data += _bytes(2, b"\x18\x01" + _varint(35 << 3) + b"\x01" + _varint(40 << 3) + b"\x00")
    data += _bytes(3, _bytes(1, b"identity") + b"\x18\x01" + b"\x20" + _varint(int(squeeze)))
    path.write_bytes(data)


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_parity(tmp_path, squeeze):
    path = tmp_path / "u.model"
    write_unigram(path, squeeze)
    mine, theirs = s.PieceTokenizer(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ("the tea ate at", " a  tea", "é the", "", "t", "ateathe heat  "):
        assert mine.encode(text) == theirs.encode(text), text
        assert mine.decode(mine.encode(text)) == theirs.decode(theirs.encode(text))
    raw = "the tea a  tea ".encode()
    _, _, parity, trip = mine.checked(np.frombuffer(raw, np.uint8), np.array([0, 7, len(raw)]))
    assert parity == [True, True] and trip == [True, not squeeze]


def test_query_matches_the_library(spark, tiny):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = s.op3_sentencepiece(spark, tiny).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = np.array(THEIRS.encode(rows[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32, r.parity, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True, True)


def test_odd_rows_and_decoding(spark):
    rows = [(1, None), (2, ""), (3, " lead and trail  "), (4, "word " * 40_000), (5, "\x00x"), (6, "a▁b"), (6, "a▁b")]
    df = spark.createDataFrame([(a, b, True, 0) for a, b in rows], "doc_id long, text string, parity boolean, n_tokens int")
    encoded = s.encode_documents(df, PATH)
    got = {r.doc_id: r for r in encoded.collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0
    assert all(r.parity for r in got.values())
    assert [got[k].round_trip for k in (1, 2, 3, 4, 6)] == [True, True, True, True, False]
    back = {r.doc_id: r.text for r in s.decode_documents(encoded, PATH).collect()}
    assert back[3] == rows[2][1] and back[4] == rows[3][1] and back[1] == ""
    assert s.encode_documents(df.limit(0), PATH).collect() == []


def test_broken_model(tmp_path):
    (tmp_path / "x.model").write_bytes(b"\x0a\xff\x01abc")
    with pytest.raises(ValueError):
        s.PieceTokenizer(str(tmp_path / "x.model"))


def test_words_that_a_polynomial_hash_confuses():
    x, y = thue_morse()
    texts = [f"{x} and {y}", y, x, f"{y} {x}"]
    raw = [t.encode() for t in texts]
    ids, at, parity, trip = s.PieceTokenizer(PATH).checked(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == THEIRS.encode(texts)
    assert all(parity) and all(trip)


def test_parity_sees_a_wrong_id():
    tok = s.PieceTokenizer(PATH)
    tok.encode_batch(["one two three"])
    tok.cache.flat[tok.cache.starts[1]] += 1
    raw = "one two three" + "three one" + "four"
    _, _, parity, _ = tok.checked(np.frombuffer(raw.encode(), np.uint8), np.array([0, 13, 22, 26]))
    assert parity.count(False) >= 1 and parity[2]
