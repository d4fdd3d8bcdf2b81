"""Graded findings of a message from all its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(level, field: str, message: str, when: Column) -> Column:
    level = F.lit(level) if isinstance(level, str) else level
    return F.when(F.coalesce(when, F.lit(False)) & level.isNotNull(), F.struct(level.alias("level"), F.lit(field).alias("field"), F.lit(message).alias("message")))


def message_flags(m: DataFrame) -> DataFrame:
    """(msg_id, flag_index, level, field, message) of facts on the message itself.

    Reads spf, dkim and dmarc status, spf_conflict, spf_authorised,
    dkim_present, reply_level, return_path_mismatch, is_bulk_sender,
    display_name_spoofing, from_ambiguous, body_incomplete, threading_level,
    invoice_level and payment_level; a column that is missing is unknown.
    """
    c = lambda n, t="boolean": F.col(n) if n in m.columns else F.lit(None).cast(t)
    spf, dkim, dmarc = (F.lower(c(n, "string")) for n in ("spf", "dkim", "dmarc"))
    ok = F.coalesce(c("spf_authorised"), F.lit(False))
    passed = F.coalesce(dmarc.isin("pass", "bestguesspass"), F.lit(False))
    failed = dmarc.isin("fail", "softfail", "temperror", "permerror", "policy", "reject", "quarantine")
    rows = [
        _one("MEDIUM", "SPF", "origin and delivery results differ", ~ok & c("spf_conflict")),
        _one("MEDIUM", "SPF", "not passed", ~ok & ~F.coalesce(c("spf_conflict"), F.lit(False)) & (spf != "pass")),
        _one("INFO", "SPF", "no result", ~ok & spf.isNull()),
        _one(F.when(dkim == "none", "INFO").otherwise("MEDIUM"), "DKIM", "none or not passed", dkim.isNotNull() & (dkim != "pass")),
        _one("INFO", "DKIM", "missing", dkim.isNull() & ~F.coalesce(c("dkim_present"), F.lit(False))),
        _one(F.when(dmarc == "none", "INFO").otherwise("MEDIUM"), "DMARC", "none or not passed", dmarc.isNotNull() & ~dmarc.isin("pass", "bestguesspass")),
        _one("INFO", "DMARC", "no result", dmarc.isNull()),
        _one(F.nullif(c("reply_level", "string"), F.lit("NONE")), "Reply-To", "replies go elsewhere", F.lit(True)),
        _one(F.when(failed & ~F.coalesce(c("is_bulk_sender"), F.lit(False)), "MEDIUM").otherwise("LOW"), "Return-Path", "another domain", c("return_path_mismatch") & ~passed),
        _one("LOW", "Return-Path", "no domain in it", (c("return_path", "string") != "") & (c("return_domain", "string") == "")),
        _one("INFO", "Conversation scope", "an embedded message is judged", c("embedded")),
        _one("INFO", "Body", "formatting was taken away", c("html_stripped")),
        _one("INFO", "Received", "sending server observed", c("injection_ip", "string").isNotNull()),
        _one("HIGH", "Display Name", "shows another address", c("display_name_spoofing")),
        _one("MEDIUM", "From", "not exactly one sender", c("from_ambiguous")),
        _one("MEDIUM", "Analysis coverage", "body was cut", c("body_incomplete")),
        _one(F.nullif(c("threading_level", "string"), F.lit("NONE")), "Reply thread", "reply without a thread", F.lit(True)),
        _one(c("invoice_level", "string"), "Invoice delivery", "document only behind a link", F.lit(True)),
        _one(c("payment_level", "string"), "Payment details", "bank details need checking", F.lit(True)),
    ]
    return m.select("msg_id", F.posexplode(F.array_compact(F.array(*rows))).alias("flag_index", "f")).select("msg_id", "flag_index", "f.*")


def link_flags(links: DataFrame, most: int = 10) -> DataFrame:
    """(msg_id, level, field, message) of links: dangerous downloads, bare addresses, users, redirects, odd ports, other scripts, unsafe schemes."""
    web = F.col("scheme").isin("http", "https")
    rows = [
        _one("HIGH", "Link", "dangerous download", web & F.col("dangerous_download")),
        _one("HIGH", "Link", "bare address", web & F.col("is_ip")),
        _one("HIGH", "Link", "user in the address", web & F.col("has_userinfo")),
        _one("MEDIUM", "Link", "nested redirect", web & (F.size("redirect_targets") > 0)),
        _one("MEDIUM", "Link", "unusual port", web & F.col("nonstandard_port")),
        _one("MEDIUM", "Link", "other scripts in path or query", web & F.col("unicode_path_or_query")),
        _one("HIGH", "Link", "unsafe scheme", F.col("unsafe_scheme")),
    ]
    f = links.select("msg_id", "link_index", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("msg_id", "link_index", "f.*")
    from mailquarry.operators.ranking import top_k

    return top_k(f, ["msg_id", "message"], [F.col("link_index")], most).select("msg_id", "level", "field", "message")


def attachment_flags(attachments: DataFrame) -> DataFrame:
    """(msg_id, level, field, message) of attachments: HIGH on any serious finding, else that there is one."""
    level = F.when(F.col("risk_level") == "high", "HIGH").when(F.col("risk_level") == "medium", "MEDIUM").otherwise("INFO")
    return attachments.where("mime_role = 'attachment'").select("msg_id", level.alias("level"), F.lit("Attachment").alias("field"), F.coalesce(F.array_join(F.transform("findings", lambda f: f["key"]), ", "), F.lit("")).alias("message"))


def alerts(rows: DataFrame, field: str, level: str = "level", message: str = "message", order: list | None = None, most: int | None = None) -> DataFrame:
    """(msg_id, level, field, message) of a table of alerts; rows without a level give none, at most ``most`` for each message."""
    from mailquarry.operators.ranking import top_k

    r = rows.where(F.col(level).isNotNull() & (F.upper(level) != "NONE"))
    if most:
        r = top_k(r, ["msg_id"], order or [F.col(message)], most)
    return r.select("msg_id", F.upper(level).alias("level"), F.lit(field).alias("field"), F.coalesce(F.col(message).cast("string"), F.lit("")).alias("message"))


def graded(severity: Column) -> Column:
    """Level of a finding's severity; low and unknown ones give none."""
    s = F.lower(severity)
    return F.when(s.isin("critical", "high"), "HIGH").when(s == "medium", "MEDIUM")


def incomplete(scans: DataFrame, kind: str) -> DataFrame:
    """One flag for each scan of a kind that could not be finished."""
    return scans.where("not analysis_complete").select("msg_id", F.lit("MEDIUM").alias("level"), F.lit(f"{kind} inspection incomplete").alias("field"), F.concat(F.lit("file "), F.coalesce(F.col("att_index").cast("string"), F.lit("-"))).alias("message"))
