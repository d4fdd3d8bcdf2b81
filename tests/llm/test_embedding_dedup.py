from __future__ import annotations

import numpy as np

from mailquarry.llm import embedding_dedup as e


def brute(rows, least=0.9, kind=np.float32):
    ids = [i for i, _ in rows]
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = np.zeros((len(rows), len(rows)), bool)
    for d in {len(rows[k][1]) for k in ok}:
        own = [k for k in ok if len(rows[k][1]) == d]
        m = np.array([rows[k][1] for k in own], kind).astype(np.float64)
        m = m / np.abs(m).max(1, keepdims=True)
        n = np.linalg.norm(m, axis=1)
        link[np.ix_(own, own)] = (m @ m.T) / (n[:, None] * n[None]) >= least
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(link, label[None], 2**62).min(1))
        if (new == label).all():
            return {i: (int(c), int(x)) for i, c, x in zip(ids, link.sum(1), label, strict=True)}
        label = new


def collected(df):
    out = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(got) == len(out)
    return got


def test_query_matches_brute_force(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert collected(e.op6_int8(spark, small)) == brute(rows)


def test_bound_is_rigorous():
    rng = np.random.RandomState(0)
    for d in (1, 3, 64, 300):
        x, y = e.unit(rng.randn(50, d)), e.unit(rng.randn(60, d) * rng.rand(60, 1))
        qx, sx, ex = e.quantised(x)
        qy, sy, ey = e.quantised(y)
        off = np.abs(x @ y.T - (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy[None])
        assert (off <= ex[:, None] + (1 + ex[:, None]) * ey[None]).all()


def test_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK_ROWS", 40)
    monkeypatch.setattr(e, "TILE", 16)
    rng = np.random.RandomState(1)
    centres = rng.randn(12, 16)
    rows = [(i, (centres[i % 12] + rng.randn(16) * 0.33).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)] + [(2000 + i, (centres[0] * (1 + i) + 0.01 * rng.randn(16)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16), (3005, [float("inf")] + [0.0] * 15), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1e30] * 16), (3009, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, rep int")
    assert collected(e.near_duplicates(df)) == brute(rows)
    assert e.near_duplicates(df.limit(0)).collect() == []
    assert collected(e.near_duplicates(df.where("vec_id = 3000"))) == {3000: (0, 3000)}


def test_doubles_of_any_size(spark):
    rng = np.random.RandomState(3)
    base = rng.randn(8)
    rows = [(i, (base * s).tolist()) for i, s in enumerate((1e300, 1e-50, 1.0, 1e-300, 1e200))]
    rows += [(10 + i, rng.randn(8).tolist()) for i in range(40)] + [(60, (base + 0.2 * rng.randn(8)).tolist()), (61, [1e308] * 8), (62, [0.0] * 8), (63, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(e.near_duplicates(df))
    assert got == brute(rows, kind=np.float64) and got[0][0] >= 4


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (4, [0.0, 1.0]), (2, [0.9, 0.1]), (None, [1.0, 0.0]), (3, None)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
