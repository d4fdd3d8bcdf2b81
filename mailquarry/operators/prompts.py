"""What a model is asked, as columns: the parts of a prompt, their order, and the contract of the answer.

The model itself is an input table; these are the questions and the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions.text import clipped, collapsed, guarded

#: Characters of a body that are asked about, and of a subject.
BODY_CHARS, SUBJECT_CHARS = 120_000, 300
#: Members of an answer by stage, in the order in which they are to be written: facts before judgements.
STAGES = {
    "extraction": ["requested_action", "action_channel", "evidence", "signals", "ambiguity"],
    "judgement": ["risk_evidence", "risk_rationale", "risk_assessment", "confidence"],
    "summary": ["content_summary"],
}


def expected_order(stage: str | None = None) -> list[str]:
    """The members of one stage's answer, or of all stages one after the other."""
    return list(STAGES[stage]) if stage else [n for names in STAGES.values() for n in names]


def answer_schema(stage: str) -> str:
    """The DDL of a stage's answer."""
    return ", ".join(f"{n} {'array<string>' if n == 'signals' else 'string'}" for n in STAGES[stage])


def in_order(answer: Column, stage: str) -> Column:
    """Whether the members of a JSON answer come in the expected order, none of them unknown; false for what isn't an object."""
    keys = F.json_object_keys(answer)
    wanted = F.array(*map(F.lit, STAGES[stage]))
    known = F.filter(wanted, lambda k: F.array_contains(keys, k))
    return F.coalesce(keys == known, F.lit(False))


def context_lines(m: DataFrame) -> Column:
    """Technical lines that go before a body: only what is known, one fact a line."""
    fact = lambda label, column: F.when(F.col(column).isNotNull() & (F.col(column).cast("string") != ""), F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))) if column in m.columns else F.lit(None).cast("string")
    pairs = [("SPF", "spf"), ("DKIM", "dkim"), ("DMARC", "dmarc"), ("Sender", "from_address"), ("Replies go to", "reply_address"), ("Links", "link_count"), ("Attachments", "usable_attachments"), ("Reply thread", "threading_level")]
    return F.array_compact(F.array(*(fact(a, b) for a, b in pairs)))


def prompts(m: DataFrame) -> DataFrame:
    """(msg_id, prompt, truncated): the question on each message.

    Subject, technical lines and the guarded body, which can't close its own
    block; a body over BODY_CHARS is cut and ``truncated`` says so.
    """
    head = F.concat(F.lit("Subject: "), F.left(collapsed(guarded(F.coalesce("subject", F.lit("")))), F.lit(SUBJECT_CHARS)))
    body = F.concat(F.lit("<UNTRUSTED_EMAIL>\n"), clipped(guarded(F.col("body")), BODY_CHARS), F.lit("\n</UNTRUSTED_EMAIL>"))
    order = F.lit("Answer with one JSON object: " + ", ".join(expected_order("extraction") + expected_order("judgement")))
    return m.select("msg_id", F.concat_ws("\n", F.concat(head, F.lit("")), F.array_join(context_lines(m), "\n"), body, order).alias("prompt"), (F.length(F.trim(guarded(F.col("body")))) > BODY_CHARS).alias("truncated"))


def requests(m: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(msg_id, section, prompt): the body in pieces where it doesn't fit in one question; whole bodies are section 0."""
    from mailquarry.operators.body import chunked

    rest = m.drop("body", "text")
    pieces = chunked(m.select("msg_id", F.col("body").alias("text")), limit, overlap).withColumnRenamed("text", "body")
    asked = prompts(pieces.withColumnRenamed("section", "_s").join(rest, "msg_id").withColumn("msg_id", F.concat_ws("#", "msg_id", "_s")))
    return asked.select(F.substring_index("msg_id", "#", 1).alias("msg_id"), F.substring_index("msg_id", "#", -1).cast("int").alias("section"), "prompt")
