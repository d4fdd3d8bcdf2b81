from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailquarry.llm.ppm_language import code_lengths, fit, folded, identify, op10_ppm, train


def brute_bits(sample, text):
    """Code length of a text by dictionaries, one byte at a time."""
    fold = lambda t: bytes(folded(np.frombuffer(t.encode(), np.uint8)).tolist())
    symbols = sorted({b for t in sample for b in fold(t)})
    code = {b: i + 1 for i, b in enumerate(symbols)}
    counts = defaultdict(Counter)
    for t in sample:
        xs = [0, 0, 0] + [code[b] for b in fold(t)]
        for i in range(3, len(xs)):
            for k in range(4):
                counts[tuple(xs[i - k : i])][xs[i]] += 1
    bits, xs = 0.0, [0, 0, 0] + [code.get(b, 0) for b in fold(text)]
    for i in range(3, len(xs)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                bits += 8
                break
            c = counts.get(tuple(xs[i - k : i]))
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if c[xs[i]]:
                bits -= math.log2(c[xs[i]] / whole)
                break
            bits -= math.log2(len(c) / whole)
    return bits


def brute_many(sample, rows, symbol):
    """As brute_bits, with the symbols of a model of several languages and the counts made once."""
    fold = lambda t: bytes(folded(np.frombuffer(t.encode(), np.uint8)).tolist())
    counts = defaultdict(Counter)
    for t in sample:
        xs = [0, 0, 0] + [int(symbol[b]) for b in fold(t)]
        for i in range(3, len(xs)):
            for k in range(4):
                counts[tuple(xs[i - k : i])][xs[i]] += 1
    out = []
    for r in rows:
        bits, xs = 0.0, [0, 0, 0] + [int(symbol[b]) for b in fold(r.text)]
        for i in range(3, len(xs)):
            for k in (3, 2, 1, 0, -1):
                c = counts.get(tuple(xs[i - k : i])) if k >= 0 else None
                if k < 0:
                    bits += 8
                elif c:
                    whole = sum(c.values()) + len(c)
                    bits -= math.log2((c[xs[i]] or len(c)) / whole)
                    if c[xs[i]]:
                        break
        out.append(bits)
    return out


def test_code_lengths_match_brute_force():
    sample = ["The cat sat on the mat", "a bat And the hat", "été à la plage"]
    model = fit({"x": sample})
    for text in ("the cat", "zebra ÉTÉ!", "mat mat", "", "q"):
        raw = text.encode()
        got = code_lengths(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0, 0]
        assert got == pytest.approx(brute_bits(sample, text), rel=1e-4, abs=1e-3)


def test_code_lengths_of_real_texts_match_brute_force(spark, small):
    """All statistics of a large sample: no context is left out, and texts are scored whole."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").orderBy("doc_id").limit(700).collect()
    samples = {x: [r.text for r in docs if r.lang == x][:150] for x in sorted({r.lang for r in docs if r.lang})}
    model = fit(samples)
    assert sum(len(level.known) for level in model.levels) > 5000
    texts = [r.text.encode() for r in docs[-12:]]
    got = code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    for k, x in enumerate(model.languages):
        want = brute_many(samples[x], docs[-12:], model.symbol)
        assert np.allclose(got[:, k], want, rtol=1e-4)


def test_learns_from_long_texts_only(spark):
    rows = [(d, ("the and of that " if d % 2 else "le la les des ") * 2000, "en" if d % 2 else "fr") for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, train(docs)).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == [x for *_, x in rows]


def test_ties_go_to_the_first_name(spark):
    model = fit({"b": ["same text"] * 3, "a": ["same text"] * 3})
    got = identify(spark.createDataFrame([(1, "same"), (1, "same"), (None, "text")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in got] == [("a", 0.5)] * 3


def test_texts_do_not_leak_into_each_other():
    model = fit({"x": ["abc abc"], "y": ["xyz xyz"]})
    texts = [b"abc", b"", b"xyz", b"ab"]
    whole = code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), np.array([0, 3, 3, 6, 8]))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], code_lengths(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_held_out_accuracy(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op10_ppm(spark, small).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark):
    model = fit({"en": ["the and of " * 30], "fr": ["le la les des " * 30]})
    rows = [(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (4, "the and of the", None), (5, "les des la", None), (6, "le la " * 60_000, None), (7, "Ω", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["und", "und", "und", "en", "fr", "fr"]
    assert got[7].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got.values())
    assert [r.lang_pred for r in identify(df, None).collect()] == ["und"] * 7
    assert identify(df.limit(0), model).collect() == []
