"""Security-event export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.functions.text import blank_to_null, compact_struct, empty_to_null

# Fixed value: version of the export contract.
SCHEMA_VERSION = "1.0"


def verdict_fields(tone: Column) -> list[Column]:
    """classification, severity and risk_score of a tone."""
    pick = lambda a, b, c: F.when(tone == "danger", a).when(tone == "review", b).otherwise(c)
    return [pick("malicious", "suspicious", "likely_legitimate").alias("classification"), pick("high", "medium", "low").alias("severity"), pick(90, 55, 15).alias("risk_score")]


def siem_events(reports: DataFrame) -> DataFrame:
    """(msg_id, event): one JSON object for each message without null, empty or absent members.

    ``reports`` has msg_id, tone, subject, message_id and reasons.
    """
    c, s, r = verdict_fields(F.col("tone"))
    verdict = F.struct(c, s, r, empty_to_null(F.array_distinct("reasons")).alias("reasons"))
    message = F.struct(blank_to_null(F.col("subject")).alias("subject"), blank_to_null(F.col("message_id")).alias("message_id"))
    some = F.col("subject").isNotNull() & (F.col("subject") != "") | F.col("message_id").isNotNull() & (F.col("message_id") != "")
    return reports.select("msg_id", compact_struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("email.analysis").alias("event_type"), verdict.alias("verdict"), F.when(some, message).alias("message")).alias("event"))


# Order in which the risks of an attachment's scans count; the first that any scan gave is the attachment's.
ATTACHMENT_RISKS = ["critical", "high", "malicious", "medium", "suspicious", "unknown", "low", "clean"]


def attachment_risk(*scans: Column) -> Column:
    """The first of ATTACHMENT_RISKS that any of the scans says; null if none does."""
    said = F.array(*scans)
    return F.coalesce(*(F.when(F.array_contains(said, F.lit(r)), F.lit(r)) for r in ATTACHMENT_RISKS))


def evidence_order(findings: DataFrame, confirmed: DataFrame, corroboration: DataFrame, top: int = 3, most: int = 6) -> DataFrame:
    """(msg_id, rank, level, message): what to show first of a message.

    Confirmed indicators, then the first ``top`` HIGH and MEDIUM findings (HIGH
    first, within them PDF files before other attachments before the rest, then
    as they were found), then what corroborates; equal messages once, ``most``
    in all. ``findings`` has finding_index, level, field and message; the
    others have msg_id, position and message.
    """
    kind = F.when(F.lower("field").contains("pdf"), 20).when(F.lower("field").contains("attachment"), 10).otherwise(0)
    weight = F.when(F.col("level") == "HIGH", 100).otherwise(0) + kind
    by = Window.partitionBy("msg_id")
    best = findings.where(F.col("level").isin("HIGH", "MEDIUM")).withColumn("_r", F.row_number().over(by.orderBy(F.desc(weight), "finding_index"))).where(F.col("_r") <= top)
    rows = (
        confirmed.select("msg_id", F.lit(0).alias("_g"), F.col("position").cast("int").alias("_p"), F.lit("HIGH").alias("level"), "message")
        .unionByName(best.select("msg_id", F.lit(1).alias("_g"), F.col("_r").alias("_p"), "level", F.concat_ws(" · ", "field", "message").alias("message")))
        .unionByName(corroboration.select("msg_id", F.lit(2).alias("_g"), F.col("position").cast("int").alias("_p"), F.lit("CHECK").alias("level"), "message"))
    )
    once = rows.groupBy("msg_id", "message").agg(F.min(F.struct("_g", "_p", "level")).alias("f"))
    return once.withColumn("rank", F.row_number().over(by.orderBy("f._g", "f._p"))).where(F.col("rank") <= most).select("msg_id", "rank", "f.level", "message")


def findings_section(findings: DataFrame) -> DataFrame:
    """(msg_id, findings): numbered findings with their signal's id, category and effect."""
    f = findings.withColumn("n", F.row_number().over(Window.partitionBy("msg_id").orderBy("finding_index")))
    one = F.struct("n", F.concat_ws(".", "signal", F.col("n").cast("string")).alias("id"), F.lower("level").alias("severity"), "category", "field", F.col("effect").alias("verdict_effect"), blank_to_null(F.col("message")).alias("description"))
    return f.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("n")).alias("findings"))


def indicators_section(links: DataFrame, hops: DataFrame, files: DataFrame) -> DataFrame:
    """(msg_id, indicators): addresses of links, their domains, addresses of hops and hashes of files; each type and value once."""
    rows = [
        links.where("url <> '' and scheme <> 'mailto'").select("msg_id", F.lit(0).alias("g"), F.col("link_index").cast("int").alias("p"), F.lit("url").alias("type"), F.col("url").alias("value"), F.coalesce("source", F.lit("message_body")).alias("source")),
        links.where("registered_domain <> '' and scheme <> 'mailto'").select("msg_id", F.lit(1).alias("g"), F.col("link_index").cast("int").alias("p"), F.lit("domain").alias("type"), F.col("registered_domain").alias("value"), F.lit("message_link").alias("source")),
        hops.select("msg_id", F.lit(2).alias("g"), F.col("route_index").cast("int").alias("p"), F.lit("ip").alias("type"), F.explode("all_ips").alias("value"), F.lit("received_header").alias("source")),
        files.where("sha256 is not null").select("msg_id", F.lit(3).alias("g"), F.col("att_index").cast("int").alias("p"), F.lit("sha256").alias("type"), F.col("sha256").alias("value"), F.lit("attachment").alias("source")),
    ]
    all_ = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    one = all_.groupBy("msg_id", "type", F.lower("value").alias("_k")).agg(F.min(F.struct("g", "p", "value", "source")).alias("f"))
    entry = F.struct("f.g", "f.p", "type", F.col("f.value").alias("value"), F.col("f.source").alias("source"))
    return one.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("g", "p")).alias("indicators"))


def full_events(messages: DataFrame, verdicts: DataFrame, findings: DataFrame, indicators: DataFrame, attachments: DataFrame, hops: DataFrame, exported_at: Column) -> DataFrame:
    """(msg_id, event): the export of a message with all eleven sections, one JSON object without empty members.

    schema_version, event, email, verdict, authentication, identity, network,
    indicators, attachments, findings, content and analysis; a section of which
    nothing is known is left out.
    """
    none = lambda c: blank_to_null(c.cast("string"))
    files = attachments.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("att_index", none(F.col("filename")).alias("filename"), "content_type", "size_bytes", "sha256", F.col("mime_role").alias("role"), F.col("magic_format").alias("detected_format"), attachment_risk("risk_level").alias("risk"), empty_to_null(F.transform("findings", lambda f: f["key"])).alias("findings")))).alias("files"))
    path = hops.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct((F.col("route_index") + 1).alias("sequence"), "from_host", "by_host", empty_to_null(F.col("all_ips")).alias("source_ips"), "received_at"))).alias("route"))
    m = messages.join(verdicts, "msg_id").join(findings, "msg_id", "left").join(indicators, "msg_id", "left").join(files, "msg_id", "left").join(path, "msg_id", "left")
    col = lambda n, t="string": F.col(n) if n in m.columns else F.lit(None).cast(t)
    auth = lambda p: _some(**{"status": F.lower(col(p))})
    c, s, r = verdict_fields(F.col("tone"))
    return m.select(
        "msg_id",
        compact_struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.struct(F.col("msg_id").alias("id"), F.lit("alert").alias("kind"), F.array(F.lit("email"), F.lit("threat")).alias("category"), F.array(F.lit("info")).alias("type"), exported_at.alias("exported_at")).alias("event"),
            _some(message_id=none(col("message_id")), subject=none(col("subject")), sent_at=none(col("date_raw")), **{"from": none(col("from_raw"))}, to=none(col("to_raw")), reply_to=none(col("reply_to")), return_path=none(col("return_path")), eml_sha256=F.col("msg_id")).alias("email"),
            F.struct(c, s, r, F.col("verdict_decided_by").alias("reason")).alias("verdict"),
            _some(spf=auth("spf"), dkim=auth("dkim"), dmarc=auth("dmarc"), sender_aligned=col("spf_aligned", "boolean"), injection_ip_authorized=col("spf_authorised", "boolean"), reply_to_mismatch=col("reply_to_mismatch", "boolean"), return_path_mismatch=col("return_path_mismatch", "boolean"), display_name_spoofing=col("display_name_spoofing", "boolean")).alias("authentication"),
            _some(risk=col("identity_risk"), decided_by=col("identity_decided_by"), impersonation=col("impersonation_status")).alias("identity"),
            _some(source_ip=col("injection_ip"), hops=empty_to_null(F.transform("route", lambda h: h))).alias("network"),
            empty_to_null(F.col("indicators")).alias("indicators"),
            empty_to_null(F.transform("files", lambda f: f.dropFields("att_index"))).alias("attachments"),
            empty_to_null(F.col("findings")).alias("findings"),
            _some(requested_action=col("requested_action"), action_channel=col("action_channel"), identity_risk=col("identity_risk"), content_risk=col("content_risk"), technical_risk=col("technical_risk")).alias("content"),
            F.struct(F.when(F.coalesce(col("analysis_incomplete", "boolean"), F.lit(False)), "incomplete").otherwise("complete").alias("coverage"), F.lit("body_and_actionable_attachments").alias("coverage_scope")).alias("analysis"),
        ).alias("event"),
    )


def _some(**members: Column) -> Column:
    """A struct of the members, null if all of them are."""
    known = [c.isNotNull() for c in members.values()]
    any_ = known[0]
    for k in known[1:]:
        any_ = any_ | k
    return F.when(any_, F.struct(*(c.alias(n) for n, c in members.items())))


def compacted(column: Column, kind: T.DataType) -> Column:
    """A value without null, empty strings, empty arrays and empty objects at any depth; null if nothing is left."""
    if isinstance(kind, T.StringType):
        return blank_to_null(column)
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(column, lambda x: compacted(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        return _some(**{f.name: compacted(column[f.name], f.dataType) for f in kind.fields})
    return column
