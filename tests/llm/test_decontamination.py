from __future__ import annotations

import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same  # noqa: E402

from mailquarry.llm.decontamination import OP5_SQL, contaminated, item_sketches, op5_containment, word_list  # noqa: E402


def test_query_matches_sql(spark, small):
    assert same(op5_containment(spark, small), OP5_SQL, small) > 5


def shingles(text, k=5):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def test_short_items_in_long_documents_and_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 5, 9, 14, 25, 40, 70, 150])))) for i in range(60)] + [(60, None), (61, ""), (62, "?!"), (0, None)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.choice([3, 50, 400, 4000]))]
        for _ in range(rng.randrange(3)):
            leak = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randrange(len(body))
            body[at:at] = leak
        docs.append((d, ", ".join(body).upper()))
    docs += [(500, None), (501, ""), (502, items[0][1]), (503, "word " * 80_000), (None, items[5][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, w string")
    bench = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in contaminated(df, bench).collect()}
    want = {}
    for d, t in docs:
        mine = shingles(t)
        for i, b in items:
            s = shingles(b)
            if d is not None and s and 100 * len(s & mine) >= 80 * len(s):
                want[d, i] = (len(s), len(s & mine))
    assert got == want and len(want) > 40
    assert contaminated(df.limit(0), bench).collect() == contaminated(df, bench.limit(0)).collect() == []


def test_size_partitions_rule_short_documents_out(spark):
    items = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n + 4))) for n in (1, 3, 16, 17, 40, 300)], "item_id long, text string")
    sketch = item_sketches(items.select(F.col("item_id").alias("variant"), word_list(F.col("text")).alias("w")), 5, 0.8)
    got = {r.variant: (r.size_partition, r.least, r.n) for r in sketch.groupBy("variant", "size_partition", "least").agg(F.count("*").alias("n")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (0, 1), 3: (1, 2), 16: (4, 13), 17: (4, 13), 40: (5, 26), 300: (8, 205)}
    assert got[16][2] == 16 and got[300][2] <= 32


def test_repeated_rows_and_near_misses(spark):
    words = [f"w{i}" for i in range(44)]  # 40 shingles; each changed word at an end costs one
    docs = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:36])), (3, " ".join(words[:35])), (3, " ".join(words[4:]))]
    bench = spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == [(1, 7, 40, 40), (2, 7, 40, 32), (3, 7, 40, 36)]
