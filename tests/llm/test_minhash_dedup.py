from __future__ import annotations

import random
import re
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from words import thue_morse  # noqa: E402

from mailquarry.llm.components import connected_components  # noqa: E402
from mailquarry.llm.minhash_dedup import near_duplicates, op9_minhash  # noqa: E402

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = _WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num, den):
    """{doc_id: (n_shingles, component_id)} by comparing every pair that shares a shingle."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = defaultdict(int)
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_matches_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = op9_minhash(spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_group_of_near_copies_and_odd_rows(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "Only two"), (4, "only TWO"), (5, "x" * 200_000), (6, "x" * 200_000)]
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, component_id string, key string")
    assert result(near_duplicates(df, 3, 85, 100)) == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 3), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {200: 200, 300: 300, 301: 300}
    assert got == want


def test_words_that_a_polynomial_hash_confuses(spark):
    x, y = thue_morse()
    rows = [(1, x), (2, y), (3, f"{x} {x} {y}"), (4, f"{y} {y} {x}"), (5, f"{x} {x} {y}")]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=85)) == brute(rows, 3, 85, 100)


def test_repeated_and_null_ids(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (7, "other words stand here"), (3, "a b c d"), (None, "a b c d"), (8, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (7, 7, True), (8, 8, True)]
