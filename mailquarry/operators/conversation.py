"""Turns of a message: delivered text, forwarded blocks, quoted replies; which one to judge."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.functions.text import action_score, preview
from mailquarry.operators.ranking import target_and_context

#: Labels of header lines in forwarded and quoted blocks.
LABELS = {"from": "from", "da": "from", "de": "from", "von": "from", "to": "to", "a": "to", "para": "to", "an": "to", "à": "to", "date": "date", "data": "date", "fecha": "date", "datum": "date", "sent": "date", "inviato": "date", "enviado": "date", "gesendet": "date", "envoyé": "date", "subject": "subject", "oggetto": "subject", "asunto": "subject", "assunto": "subject", "betreff": "subject", "objet": "subject", "cc": "cc"}
_LABEL = re.compile(r"^[>\s]*\*{0,2}(" + "|".join(sorted(LABELS, key=len, reverse=True)) + r")\*{0,2}\s*:\s*(.*)$", re.I)
_FORWARD = re.compile(r"^[>\s]*-{2,}\s*(forwarded message|messaggio inoltrato|mensaje reenviado|weitergeleitete nachricht|message transféré|original message|messaggio originale|mensaje original|ursprüngliche nachricht)\s*-*\s*$|^begin forwarded message:\s*$", re.I)
_REPLY = re.compile(r"^\s*(?:on|il giorno|el|am|le)\b.+?(?:wrote|ha scritto|escribió|schrieb|a écrit)\s*:\s*$", re.I)

_SEGMENT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "from_raw", "date_raw", "subject", "text")]))


def segments_of(text: str | None) -> list[dict]:
    """Ordered turns; the first is the delivered text, the others forwarded or quoted blocks with their header fields."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    starts: list[tuple[int, str, dict, int]] = [(0, "outer", {}, 0)]

    def block(k: int) -> tuple[dict, int]:
        fields: dict[str, str] = {}
        last = k
        for j in range(k, min(k + 24, len(lines))):
            m = _LABEL.match(lines[j])
            if m:
                fields.setdefault(LABELS[m[1].lower()], m[2].strip())
                last = j + 1
            elif lines[j].strip(" >"):
                break
        return fields, last

    k = 0
    while k < len(lines):
        if _FORWARD.match(lines[k]):
            fields, after = block(k + 1)
            starts.append((k, "forwarded", fields, max(after, k + 1)))
            k = max(after, k + 1)
            continue
        if _REPLY.match(lines[k]):
            who = re.search(r"([^,<>]*<[^<>]+>|\S+@\S+)", lines[k])
            starts.append((k, "quoted", {"from": who[1].strip() if who else lines[k].strip()}, k + 1))
        elif _LABEL.match(lines[k]):
            fields, after = block(k)
            if "from" in fields and len(fields) >= 3:
                starts.append((k, "quoted", fields, after))
                k = after
                continue
        k += 1
    out = []
    for i, (_, kind, fields, body) in enumerate(starts):
        end = starts[i + 1][0] if i + 1 < len(starts) else len(lines)
        own = "\n".join(re.sub(r"^(?:>\s?)+", "", x) for x in lines[body:end]).strip()
        out.append({"kind": kind, "from_raw": fields.get("from"), "date_raw": fields.get("date"), "subject": fields.get("subject"), "text": own})
    return out


@F.pandas_udf(_SEGMENT)
def _segments(text: pd.Series) -> pd.Series:
    return text.map(segments_of)


_OWN = T.StructType([T.StructField("own", T.StringType()), T.StructField("ibans", T.ArrayType(T.StringType())), T.StructField("quoted_ibans", T.ArrayType(T.StringType())), T.StructField("others", _SEGMENT)])


def own_and_others(text: str | None) -> dict:
    """The delivered turn, the accounts it and the quoted turns name, and the other turns without their texts."""
    from mailquarry.operators.payments import ibans_of

    segs = segments_of(text)
    quoted = "\n".join(s["text"] for s in segs if s["kind"] == "quoted")
    return {"own": segs[0]["text"], "ibans": ibans_of(segs[0]["text"]), "quoted_ibans": ibans_of(quoted), "others": [s | {"text": None} for s in segs[1:]]}


@F.arrow_udf(_OWN)
def own_turn(text: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([own_and_others(t) for t in text.to_pylist()], to_arrow_type(_OWN))


def segments(bodies: DataFrame) -> DataFrame:
    """(msg_id, position, kind, from_raw, address, domain, date_raw, subject, text, preview, action_score, recommended_role) of (msg_id, body)."""
    from mailquarry.operators.envelope import address, domain

    s = bodies.select("msg_id", F.posexplode(_segments("body")).alias("position", "s")).select("msg_id", "position", "s.*")
    a = address(F.coalesce("from_raw", F.lit("")))
    s = s.withColumns({"address": a, "domain": domain(a), "preview": preview(F.col("text")), "action_score": action_score(F.col("text"))})
    return target_and_context(s, "msg_id", "position", "action_score")


def forwarded_identity(segs: DataFrame) -> DataFrame:
    """(msg_id, from_raw, address, domain, date_raw, subject): whom the first forwarded turn of a message is from."""
    f = segs.where("kind = 'forwarded'")
    best = f.groupBy("msg_id").agg(F.min_by(F.struct("from_raw", "address", "domain", "date_raw", "subject"), "position").alias("f"))
    return best.select("msg_id", "f.*").where("from_raw is not null")


def manifest(segs: DataFrame) -> DataFrame:
    """The public part: everything but the texts, as one ordered array for each message."""
    fields = [c for c in segs.columns if c not in ("msg_id", "text")]
    return segs.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in fields if c != "position")))).alias("segments"))
