from __future__ import annotations

import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import test_minhash_dedup as near  # noqa: E402
from test_decontamination import shingles  # noqa: E402

import corpus_pipeline  # noqa: E402


def cut(rows, span=50):
    least = {}
    raw = [(d, t.encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - span + 1):
            x = t[i : i + span]
            if least.get(x, d) >= d:
                least[x] = d
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if least[t[i : i + span]] < d:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        if kept or not t:
            yield d, kept.decode(errors="replace")


def brute(rows, items):
    rows = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    groups = near.brute(rows, 5, 80, 100)
    rows = list(cut([(d, t) for d, t in rows if groups[d][1] == d]))
    bad = [s for s in (shingles(t) for t in items) if s]
    rows = [(d, t) for d, t in rows if not any(100 * len(s & mine) >= 80 * len(s) for mine in [shingles(t)] for s in bad)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {}
    for d, t in rows:
        ids = np.array(sp.encode(t), "<u4")
        out[d] = (len(ids), zlib.crc32(ids.tobytes()))
    return out


def test_pipeline_matches_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == brute(rows, items)
    assert all(r.parity for r in got) and len(got) < len(rows)


def test_stages_keep_the_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.dtypes == docs.dtypes
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two", "en", None, 7)], docs.schema)
    left = {"language": [3], "near_duplicates": [1, 2, 3], "repeated_strings": [1, 2, 3], "benchmark": [1, 2, 3], "tokens": [1, 2, 3]}
    for name, stage in corpus_pipeline.STAGES:
        assert sorted(r.doc_id for r in stage(spark, odd, tiny).collect()) == left[name]
        assert stage(spark, odd.limit(0), tiny).count() == 0


def test_repeats_stage_keeps_rows_and_texts_apart(spark, tiny):
    shared = "The same long line is in every one of these documents, word for word. "
    texts = [(1, shared + "first"), (2, shared + "Own end."), (2, shared + "Own end."), (3, shared + "Another end."), (3, "Other text under the same number, long enough to be looked at as well.")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], spark.read.parquet(f"{tiny}/documents.parquet").schema)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.repeats(spark, docs, tiny).collect())
    assert got == sorted([texts[0], (2, "Own end."), (2, "Own end."), (3, "Another end."), texts[4]])


def test_language_stage_without_a_learned_language(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 0), (3, "12 ?!", None, "s", 5), (4, "one two", None, "s", 7), (5, "é 3", None, "s", 3)], schema)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, odd, tiny).collect()) == [4, 5]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    unlabelled = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), tiny)
    same = [r.doc_id for r in corpus_pipeline.language(spark, docs, tiny).collect()]
    assert sorted(r.doc_id for r in unlabelled.collect()) == sorted(same) and same


def test_language_stage_goes_by_the_models(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    own = [(10**6, "漢字仮名交じり文の例です。" * 20, None, "s", 0), (10**6 + 1, "Ω≈ç√∫˜µ≤≥÷" * 20, None, "s", 0), (10**6 + 2, docs.where("lang = 'en'").orderBy("doc_id").first().text, None, "s", 0)]
    more = docs.unionByName(spark.createDataFrame(own, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, more, tiny).select("doc_id").collect()}
    assert {10**6, 10**6 + 1} & kept == set() and 10**6 + 2 in kept
    assert kept >= {r.doc_id for r in docs.where("text rlike '[a-z]'").collect()}
