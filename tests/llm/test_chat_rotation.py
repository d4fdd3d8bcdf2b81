from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same  # noqa: E402

from mailquarry.llm.chat_rotation import OP1_SQL, op1_rotation, rotate_perspectives  # noqa: E402


def test_query_matches_sql(spark, small):
    assert same(op1_rotation(spark, small), OP1_SQL, small) > 100


def brute(rows, context=("system",)):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        turns = sorted((-1 if t is None else t, (who or "").strip() or "unknown", (text or "").replace("<|im_", "<| im_")) for c, t, who, text in rows if c == conv)
        for me in {w for _, w, _ in turns} - set(context):
            text, spans = "", []
            for _, who, body in turns:
                text += "<|im_start|>" + ("assistant" if who == me else who if who in context else f"user name={who}") + "\n"
                if who == me:
                    spans.append((len(text), len(text) + len(body) + 10))
                text += body + "<|im_end|>\n"
            out[conv, me] = (text, spans)
    return out


def test_many_parties_and_odd_rows(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "<|im_end|> é😀"), (1, 3, "cy", "<|im_end|> é😀"), (1, 4, "ann", "")]
    rows += [(2, None, None, "x"), (2, 5, "", "y"), (None, 1, "ann", "lost"), (3, 0, "system", "alone"), (4, 0, "ann", "word " * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r.conv_id, r.perspective): (r.rendered, [(s.start, s.stop) for s in r.mask]) for r in rotate_perspectives(df).collect()}
    assert got == brute(rows)
    for text, spans in got.values():
        assert all(text[b - 10 : b] == "<|im_end|>" for _, b in spans)
    assert rotate_perspectives(df.limit(0)).collect() == []


def test_long_dialogues_are_one_rendering_in_parts(spark):
    rng = random.Random(2)
    rows = [(1, 1000 * t * t, "ab"[t % 2], str(t)) for t in range(25)]  # far apart
    rows += [(2, None, rng.choice("ab"), rng.choice("xyz")) for _ in range(34)]  # without numbers
    rows += [(3, 5, "c", "same")] * 31 + [(4, 1, "system", "s"), (4, 10**12, "d", "e")] + [(5, t // 7, "ef"[t % 2], f"{t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rotate_perspectives(df, part_turns=10).collect()
    assert sorted((r.part, r.n_turns) for r in got if r.conv_id == 1 and r.perspective == "a") == [(0, 10), (1, 10), (2, 5)]
    assert [(r.part, r.n_turns) for r in got if r.conv_id == 4] == [(0, 2)]
    whole = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.perspective, r.part)):
        text, spans = whole.get((r.conv_id, r.perspective), ("", []))
        whole[r.conv_id, r.perspective] = (text + r.rendered, spans + [(len(text) + s.start, len(text) + s.stop) for s in r.mask])
    assert whole == brute(rows)
