from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from words import thue_morse  # noqa: E402

from mailquarry.llm import dac_tokens as d  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = d.byte_level_encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def plain(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*" \n\t\r.,'!?sdtm|-_09aZéßñα漢😀", "'ll", "'re", "\xa0", "\x1c", "\x0b", "e\u0301", "\u2003"]), st.characters(blacklist_categories=("Cs",))), max_size=40).map("".join), max_size=4))
def test_segments_give_the_ids_of_the_whole_text(texts):
    raw = [t.encode() for t in texts]
    ids, at, _ = ENCODER.ids(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64), 0)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*PLAIN.encode(t, add_special_tokens=False).ids, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_round_trip_and_random_access(ids):
    cut = len(ids) // 3
    shard = d.Shard(d.pack(np.array([5, 9]), np.array([0, cut, len(ids)]), np.array(ids, np.uint32)))
    assert shard.all().tolist() == ids and shard.doc_ids.tolist() == [5, 9]
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert shard.token(i) == ids[i]
    assert shard.document(0) == ids[:cut] and shard.document(1) == ids[cut:]


def check(rows, got):
    start = 0
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = plain(text)
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_query_matches_plain_encoding(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check(rows, d.op2_dac(spark, tiny).collect())


def test_odd_rows_and_files(spark, tmp_path):
    rows = [(7, None), (-3, ""), (2, "<|endoftext|> a"), (10**12, "word " * 50_000), (4, "x\xa0 y \n z")]
    df = spark.createDataFrame([(a, b, "q", 1) for a, b in rows], "doc_id long, text string, shard string, start int")
    folder = f"file://{tmp_path}/tokens"
    check(rows, d.token_files(df, PATH, folder).collect())
    files = [f for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/tokens")) if f.base_name.endswith(".dac")]
    docs = [x for f in sorted(files, key=lambda f: f.base_name) for x in d.Shard(open(f.path, "rb").read()).doc_ids.tolist()]
    assert docs == sorted(a for a, _ in rows)
    assert d.token_files(df.limit(0), PATH, f"file://{tmp_path}/none").collect() == []


def test_words_that_a_polynomial_hash_confuses(spark, tmp_path):
    x, y = thue_morse()
    rows = [(1, f"{x} and {y}"), (2, y), (3, x), (4, f"{y} {y} {x}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(rows, d.token_files(df, PATH, f"file://{tmp_path}/t").collect())


def test_repeated_rows_are_written_each(spark, tmp_path):
    df = spark.createDataFrame([(5, "b c"), (5, "b c"), (5, "a"), (9, None), (None, "lost")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in d.token_files(df, PATH, f"file://{tmp_path}/r").collect())
    assert [g[0] for g in got] == [5, 5, 5, 9] and [g[1] for g in got] == [0, len(plain("a")), len(plain("a")) + len(plain("b c")), len(plain("a")) + 2 * len(plain("b c"))]
