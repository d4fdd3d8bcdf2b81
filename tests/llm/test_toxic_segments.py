from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from mailquarry.llm.toxic_segments import fit, op8_segments, score_documents, segments, train


def brute_segments(xs):
    """Maximal scoring segments by definition: the best segment, then left and right of it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += xs[j]
                if total > 0 and (top is None or total > top[2] or (total == top[2] and j + 1 - i < top[1] - top[0])):
                    top = (i, j + 1, total)
        return [] if top is None else best(a, top[0]) + [top] + best(top[1], b)

    return best(0, len(xs))


def test_segments_match_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        xs = [rng.choice([-5, -3, -2, -1, 1, 2, 4, 7]) + rng.random() / 7 for _ in range(rng.randrange(25))]
        got = segments(np.array(xs, float))
        want = brute_segments(xs)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_held_out_accuracy(spark, medium):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    got = op8_segments(spark, medium).collect()
    assert len(got) == 10_000 and len({r.doc_id for r in got}) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]  # all labels, whatever the language
    caught = [r.predicted for r in held if truth[r.doc_id] == 1]
    assert len(caught) > 80 and np.mean(caught) >= 0.9
    assert np.mean([truth[r.doc_id] for r in held if r.predicted]) >= 0.85


def test_learns_from_long_texts_only(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["tree", "river", "stone", "cloud", "road"])
    rows = [(d, " ".join("vile" if d % 2 and i % 50 < 3 else word() for i in range(2600))) for d in range(120)]
    assert min(len(t) for _, t in rows) > 12_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, toxic int")
    got = score_documents(docs, train(docs, labels)).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)


def test_odd_rows_and_passage_positions(spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "road"]) for _ in range(60)) for _ in range(60)]
    nasty = [t.replace("tree", "vile", 6) for t in plain]
    model = fit(plain + nasty, [0] * 60 + [1] * 60)
    rows = [(1, None), (2, ""), (3, plain[0]), (4, "river " * 50 + "vile vile VILE " + "stone " * 50), (5, "road " * 40_000), (6, "!!! ...")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in score_documents(df, model).collect()}
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got.values())
    assert got[4].score > 0.5 and max(got[k].score for k in (1, 2, 3, 5, 6)) < 0.3
    seg = got[4].segments[0]
    assert (seg.start, seg.last_word) == (300, 310)
    assert score_documents(df.limit(0), model).collect() == []
    again = df.select("text").unionByName(df.select("text")).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.score for r in score_documents(again, model).collect()) == sorted([r.score for r in got.values()] * 2)


def test_no_labels(spark):
    model = fit([], [])
    got = score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert len(got) == 1 and 0 <= got[0].score <= 1
