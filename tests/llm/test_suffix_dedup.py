from __future__ import annotations

import hashlib
import random

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from words import thue_morse  # noqa: E402

from mailquarry.llm import suffix_dedup as s  # noqa: E402


def brute(rows, span=50):
    """Smallest document of every string, then bytes covered by strings of smaller documents."""
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - span + 1):
            x = t[i : i + span]
            if least.get(x, d) >= d:
                least[x] = d
    out = {}
    for d, t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - span + 1):
            if least[t[i : i + span]] < d:
                gone[1 + i : 1 + i + span] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out[d] = (len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    got = df.collect()
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_two_stage_order_and_prefixes():
    rng = np.random.RandomState(0)
    for letters in (1, 2, 3, 256):
        rows = rng.randint(0, letters, (40, 30)).astype(np.uint8)
        rows[20:30] = rows[:10]
        order, prefix = s.two_stage_order(rows, 11, 20)
        strings = [bytes(rows[p // 30, p % 30 : p % 30 + 20]) for p in order]
        assert sorted(order.tolist()) == sorted(r * 30 + o for r in range(40) for o in range(11))
        assert strings == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[k - 1], strings[k]
            assert prefix[k] == next((i for i in range(20) if i >= len(a) or i >= len(b) or a[i] != b[i]), 20)


def test_query_matches_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert result(s.op4_suffix(spark, tiny)) == brute(rows)


def test_odd_texts(spark):
    rng = random.Random(4)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    base = text(400, "abc de")
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 49), (4, "y" * 300), (5, "y" * 50), (6, "y" * 170 + "z"), (7, base), (8, base), (9, base[100:150]), (10, "q" + base[100:149]), (11, "é" * 40 + base[30:200]), (12, "é" * 40)]
    rows += [(20 + i, text(30, "ab") + base[i * 3 : i * 3 + 40 + i] + "\x00" * (i % 60) + text(20, "ab")) for i in range(60)]
    rows += [(100, "\x00" * 120), (101, "\x00" * 119 + "a"), (102, "ab" * 200), (103, "ba" * 60), (104, "word " * 30_000), (105, "word " * 20)]
    df = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "doc_id long, text string, n_bytes int, part string")
    assert result(s.remove_repeats(df)) == brute(rows)
    repeated = df.unionByName(df.where("doc_id in (7, 8)"))
    assert result(s.remove_repeats(repeated)) == brute(rows)
    assert s.remove_repeats(df.limit(0)).collect() == []


def test_repeated_rows_that_lose_a_part(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = word(90)
    rows = [(1, word(40) + shared), (2, word(30) + shared + word(20)), (3, shared)]
    df = spark.createDataFrame(rows + [rows[1]] * 2 + [rows[2]], "doc_id long, text string")
    assert result(s.remove_repeats(df)) == brute(rows)


def test_words_that_a_polynomial_hash_confuses(spark):
    x, y = thue_morse()
    rows = [(1, f"{x} and"), (2, y), (3, f"{y} {x}"), (4, f"no {y}"), (5, x[:700] + y[700:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(s.remove_repeats(df)) == brute(rows)


def test_contexts_with_one_code_stay_apart(monkeypatch):
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [9, 9, 9]], np.uint8)
    monkeypatch.setattr(s, "context_codes", lambda full: (np.zeros(len(full), np.uint64),) * 2)
    back, groups = s.equal_groups(rows)
    assert back[0] == back[2] and len({back[0], back[1], back[3]}) == 3 == groups


def test_contexts_of_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_CONTEXTS", 1)  # every shared anchor counts as hot
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, rows = word(20), []
    for d in range(120):  # one short string everywhere, in surroundings that two or three documents share in part
        near = random.Random(d // 3)
        left, right = ("".join(near.choice("xyz ") for _ in range(40)) for _ in range(2))
        rows.append((d, word(30) + left[rng.randrange(30) :] + common + right[: rng.randrange(40)] + word(30)))
    assert result(s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(x[1] > 0 for x in brute(rows).values()) > 20
