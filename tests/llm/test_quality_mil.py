from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from mailquarry.llm import quality_mil as q
from mailquarry.llm.sampling import fold


def test_held_out_accuracy(spark, small):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = q.op7_attention(spark, small).collect()
    assert len(got) == 1000 and len({r.doc_id for r in got}) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = {y: [r.predicted == y for r in held if truth[r.doc_id] == y] for y in (0, 1)}
    assert min(np.mean(right[0]), np.mean(right[1])) >= 0.9  # each label on its own: a constant answer fails


def test_query_matches_a_plain_version(spark, small):
    """Every score once more: one document at a time, in loops, from the definition of gated attention."""
    model = q.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0))
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in q.op7_attention(spark, small).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    for d in sorted(rows)[::7]:
        raw = rows[d].encode()
        x, _ = q.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        hidden, energy = [], []
        for f in (x - model.mean) / model.scale:
            h = [math.tanh(sum(f[i] * model.w[i, j] for i in range(len(f))) + model.b[j]) for j in range(q.HIDDEN)]
            gate = [math.tanh(sum(h[i] * model.v[i, j] for i in range(q.HIDDEN))) * sig(sum(h[i] * model.u[i, j] for i in range(q.HIDDEN))) for j in range(q.ATTENTION)]
            hidden.append(h)
            energy.append(math.exp(sum(g * a for g, a in zip(gate, model.a, strict=True))))
        weight = [e / sum(energy) for e in energy]
        bag = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) for j in range(q.HIDDEN)]
        assert abs(got[d].score - sig(sum(b * c for b, c in zip(bag, model.c, strict=True)) + model.c0)) < 1e-6
        assert abs(got[d].top_weight - max(weight)) < 1e-6


def test_gradient_by_finite_difference():
    rng = np.random.RandomState(0)
    first, x = np.array([0, 1, 4, 6]), rng.randn(6, 5)
    shapes = {"w": (5, 4), "b": (4,), "v": (4, 3), "u": (4, 3), "a": (3,), "c": (4,), "c0": (1,)}
    p = {k: rng.randn(*n) for k, n in shapes.items()}
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        prob = q._forward(p, x, first)[-1]
        return -(weight * (y * np.log(prob) + (1 - y) * np.log(1 - prob))).sum()

    grad = q.gradient(p, x, first, y, weight)
    for k, z in p.items():
        for at in np.ndindex(z.shape):
            z[at] += 1e-6
            up = loss()
            z[at] -= 2e-6
            assert abs((up - loss()) / 2e-6 - grad[k][at]) < 1e-6, (k, at)
            z[at] += 1e-6


def test_learns_from_long_texts_only(spark):
    rows = [(d, ("Plain words in a calm sentence go on.\n" if d % 2 else "BUY!! NOW!! %%% ### ") * 1200) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    got = q.score_documents(docs, q.train(docs, labels)).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)


def test_fit_tells_two_kinds_apart():
    good, bad = "Plain words in a calm sentence go on.\n" * 12, "BUY!! NOW!! %%% ### " * 20
    model = q.fit([good, bad] * 20, [1, 0] * 20)
    for text, low, high in ((good, 0.9, 1), (bad, 0, 0.1)):
        raw = text.encode()
        p, _, weight = q.score(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert low <= p[0] <= high and 0 < weight[0] <= 1


def test_encoding_is_by_text(spark):
    texts = [b"One two two.\nThree", b"", b"X" * 1000, b"a b a"]
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    x, first = q.encode(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert first.tolist() == [0, 1, 2, 5, 6]
    for k, t in enumerate(texts):
        alone, _ = q.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone, x[first[k] : first[k + 1]])


def test_odd_rows(spark):
    model = q.fit(["fine words here"] * 5 + ["!!! ### %%%"] * 5, [1] * 5 + [0] * 5)
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x " * 300_000, 3), (4, "\x00\x01", 4), (4, "\x00\x01", 4)], "doc_id long, text string, score int")
    got = q.score_documents(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert q.score_documents(df.limit(0), model).collect() == []
    assert 0 <= q.score_documents(df.limit(1), q.fit([], [])).first().score <= 1
