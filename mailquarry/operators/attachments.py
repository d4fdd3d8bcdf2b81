"""Facts and findings of attachments: types, hashes, names, archives, HTML files, calendars. Nothing is opened or run."""

from __future__ import annotations

import io
import re
import time
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of archive inspection.
MAX_DEPTH, MAX_ENTRIES, MAX_DECLARED, MAX_DECOMPRESSED, MAX_MEMBER, RATIO = 2, 250, 50 << 20, 16 << 20, 2 << 20, 100
MAX_SECONDS = 3.0
# First bytes of file formats, the first match wins.
MAGIC = [("504B0304", "zip"), ("25504446", "pdf"), ("4D5A", "exe"), ("7F454C46", "elf"), ("D0CF11E0A1B11AE1", "ole"), ("52617221", "rar"), ("377ABCAF271C", "7z"), ("1F8B", "gzip"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("4C00000001140200", "lnk")]
DANGEROUS = ["exe", "scr", "com", "pif", "js", "jse", "vbs", "vbe", "wsf", "hta", "bat", "cmd", "ps1", "msi", "lnk", "iso", "img", "jar", "cpl", "reg"]
#: Formats that carry another name for good reason.
CONTAINERS = {"zip": ["zip", "docx", "xlsx", "pptx", "odt", "ods", "odp", "jar", "epub", "docm", "xlsm"], "ole": ["doc", "xls", "ppt", "msg", "msi"], "jpeg": ["jpg", "jpeg"], "gzip": ["gz", "tgz"], "exe": ["exe", "dll", "scr", "com", "cpl"]}
MIME_EXTENSIONS = {"application/pdf": ["pdf"], "image/png": ["png"], "image/jpeg": ["jpg", "jpeg"], "image/gif": ["gif"], "text/html": ["html", "htm"], "application/zip": ["zip"], "text/calendar": ["ics"], "text/plain": ["txt", "csv", "log", "md"]}

_FINDING = T.StructType([T.StructField("key", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("evidence", T.StringType())])
_ARCHIVE = T.StructType([T.StructField("findings", T.ArrayType(_FINDING)), T.StructField("entries", T.IntegerType()), T.StructField("complete", T.BooleanType())])


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]{1,10})\s*$", 1))


def magic_format(payload: Column) -> Column:
    head = F.hex(F.substring(payload, 1, 16))
    out = F.when(F.lit(False), "")
    for prefix, kind in MAGIC:
        out = out.when(head.startswith(prefix), kind)
    return out


def attachments(messages: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row for each attachment or inline resource of parsed messages, with hashes, formats, role and file-type findings.

    ``extension_match`` is null where nothing is known about one of the sides.
    The columns ``kept`` of a message stand in each of its rows.
    """
    parts = messages.select("msg_id", *kept, F.posexplode(F.filter("parts", lambda p: (p["disposition"] == "attachment") | p["filename"].isNotNull() | ~p["content_type"].isin("text/plain", "text/html"))).alias("att_index", "p"))
    a = parts.select("msg_id", *kept, "att_index", "p.filename", "p.content_type", "p.disposition", "p.content_id", "p.payload")
    pl = F.col("payload")
    a = a.withColumns({"ext": extension(F.col("filename")), "magic_format": magic_format(pl), "size_bytes": F.octet_length(pl), "md5": F.md5(pl), "sha1": F.sha1(pl), "sha256": F.sha2(pl, 256)})
    a = a.withColumn("mime_role", F.when(F.col("content_id").isNotNull() & F.col("content_type").startswith("image/") & ~F.coalesce(F.col("disposition") == "attachment", F.lit(False)), "inline_resource").otherwise("attachment"))
    holds = F.create_map(*(x for k, v in CONTAINERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    by_mime = F.create_map(*(x for k, v in MIME_EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    fits = F.coalesce(F.array_contains(holds[F.col("magic_format")], F.col("ext")), F.col("magic_format") == F.col("ext"))
    match = F.when((F.col("ext") == "") | F.col("magic_format").isNull(), F.lit(None)).otherwise(fits)
    mime = F.when(F.col("ext") == "", F.lit(None)).otherwise(F.array_contains(by_mime[F.col("content_type")], F.col("ext")))
    double = F.lower(F.coalesce("filename", F.lit(""))).rlike(r"\.(pdf|docx?|xlsx?|jpe?g|png|txt)\s*\.[a-z0-9]{2,4}\s*$") & F.col("ext").isin(DANGEROUS)
    one = lambda key, severity, cond: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity"), F.coalesce("filename", F.lit("")).alias("evidence")))
    findings = F.array_compact(
        F.array(
            one("bidi_name", "high", F.col("filename").rlike("[‪-‮⁦-⁩]")),
            one("double_extension", "high", double),
            one("dangerous_extension", "high", F.col("ext").isin(DANGEROUS)),
            one("dangerous_content", "high", F.col("magic_format").isin("exe", "elf", "lnk") & ~F.col("ext").isin(DANGEROUS)),
            one("html_disguise", "high", (F.col("content_type") == "text/html") & ~F.col("ext").isin("html", "htm", "xhtml", "")),
            one("content_mismatch", "medium", ~match),
            one("mime_mismatch", "low", ~mime),
        )
    )
    return a.withColumns({"extension_match": match, "mime_match": mime, "findings": findings}).withColumn("risk_level", F.when(F.exists("findings", lambda f: f["severity"] == "high"), "high").when(F.exists("findings", lambda f: f["severity"] == "medium"), "medium").otherwise("low"))


def actionable(files: DataFrame) -> DataFrame:
    """Attachments that a reader would open: pictures that a page shows are left out."""
    return files.where("mime_role <> 'inline_resource'")


def field_findings(xml: bytes, name: str) -> list[tuple[str, str, str]]:
    """Fields of a document that fetch or run something: DDE is serious, links from fields need a look."""
    text = re.sub(r"<[^>]+>", "", " ".join(re.findall(r"(?s)<w:instrText[^>]*>(.*?)</w:instrText>|<w:fldSimple[^>]*w:instr=\"[^\"]*\"", xml.decode("utf-8", "replace"))))
    simple = " ".join(re.findall(r'w:instr="([^"]*)"', xml.decode("utf-8", "replace")))
    found = []
    if re.search(r"\bDDE(AUTO)?\b", text + " " + simple):
        found.append(("dde_field", "high", name))
    found += [("hyperlink_field", "low", u[:200]) for u in re.findall(r"HYPERLINK\s+(?:&quot;|\")?(https?://[^\s\"&]+)", text + " " + simple)[:10]]
    return found


def archive_findings(payload: bytes | None, depth: int = 0, budget: list[int] | None = None, until: float | None = None) -> tuple[list[tuple[str, str, str]], int, bool]:
    """(findings, entries, complete) of a ZIP file; limits that are met make it incomplete, never clean."""
    found: list[tuple[str, str, str]] = []
    budget = budget if budget is not None else [MAX_DECOMPRESSED]
    until = until if until is not None else time.monotonic() + MAX_SECONDS
    try:
        z = zipfile.ZipFile(io.BytesIO(payload or b""))
        infos = z.infolist()
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return [("archive_unreadable", "medium", "")], 0, False
    if len(infos) > MAX_ENTRIES:
        found.append(("too_many_entries", "medium", str(len(infos))))
    if sum(i.file_size for i in infos) > MAX_DECLARED:
        found.append(("declared_size", "high", str(sum(i.file_size for i in infos))))
    complete = len(infos) <= MAX_ENTRIES
    for i in infos[:MAX_ENTRIES]:
        if time.monotonic() > until:
            return [*found, ("time_limit", "medium", i.filename)], len(infos), False
        ext = i.filename.rsplit(".", 1)[-1].lower() if "." in i.filename else ""
        if i.flag_bits & 1:
            found.append(("encrypted_member", "medium", i.filename))
            complete = False
            continue
        if ".." in i.filename.replace("\\", "/").split("/") or i.filename.startswith(("/", "\\")):
            found.append(("path_traversal", "high", i.filename))
        if ext in DANGEROUS:
            found.append(("dangerous_member", "high", i.filename))
        if re.search(r"(?i)vbaProject\.bin$", i.filename):
            found.append(("office_macro", "high", i.filename))
        if i.file_size > (64 << 10) and i.file_size > RATIO * max(1, i.compress_size):
            found.append(("compression_bomb", "high", i.filename))
            return found, len(infos), False
        fields = i.filename.endswith("word/document.xml")
        if (fields or ext in ("zip", "docx", "xlsx", "pptx", "rels", "jar")) and not i.is_dir():
            if i.file_size > MAX_MEMBER or i.file_size > budget[0]:
                complete = False
                continue
            try:
                with z.open(i) as f:
                    data = f.read(min(MAX_MEMBER, budget[0]) + 1)
            except (zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError):
                complete = False
                continue
            if len(data) > min(MAX_MEMBER, budget[0]):
                complete = False
                continue
            budget[0] -= len(data)
            if fields:
                found += field_findings(data, i.filename)
            elif ext == "rels":
                for kind, target in re.findall(r'Type="[^"]*/(\w+)"[^>]*Target="([^"]+)"[^>]*TargetMode="External"', data.decode("utf-8", "replace")):
                    if kind in ("attachedTemplate", "oleObject", "frame", "subDocument"):
                        found.append(("external_relationship", "high", target[:200]))
            elif depth + 1 >= MAX_DEPTH + 1:
                found.append(("nested_too_deep", "medium", i.filename))
                complete = False
            else:
                inner, _, ok = archive_findings(data, depth + 1, budget, until)
                found += inner
                complete &= ok
    return found, len(infos), complete


@F.pandas_udf(_ARCHIVE)
def archive_scan(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for p in payload:
        found, entries, complete = archive_findings(p)
        rows.append(([{"key": k, "severity": s, "evidence": e} for k, s, e in found], entries, complete))
    return pd.DataFrame(rows, columns=_ARCHIVE.names)


_SCAN = T.ArrayType(T.StructType([T.StructField("att_index", T.IntegerType()), *_ARCHIVE.fields]))


@F.pandas_udf(_SCAN)
def _message_scan(indexes: pd.Series, payloads: pd.Series) -> pd.Series:
    out = []
    for ids, files in zip(indexes, payloads, strict=True):
        budget = [MAX_DECOMPRESSED]
        rows = []
        for i, p in zip(ids, files, strict=True):
            found, entries, complete = archive_findings(p, 0, budget)
            rows.append({"att_index": int(i), "findings": [{"key": k, "severity": s, "evidence": e} for k, s, e in found], "entries": entries, "complete": complete})
        out.append(rows)
    return pd.Series(out)


def message_archives(attachments: DataFrame) -> DataFrame:
    """(msg_id, att_index, findings, entries, complete) of ZIP files; all files of a message share one budget of unpacked bytes."""
    z = attachments.where("magic_format = 'zip'").groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("att_index", "payload"))).alias("z"))  # a message has 25 attachments at most
    s = z.select("msg_id", _message_scan(F.transform("z", lambda x: x["att_index"]), F.transform("z", lambda x: x["payload"])).alias("s"))
    return s.select("msg_id", F.explode("s").alias("s")).select("msg_id", "s.*")


def office_security(attachments: DataFrame) -> DataFrame:
    """(msg_id, att_index, status, findings, analysis_complete) of Office files.

    Macros and external relations of the zipped formats come from the archive
    scan; the older format needs a library that isn't here, so it only shows
    its marks and says that it is incomplete.
    """
    old = F.col("magic_format") == "ole"
    new = (F.col("magic_format") == "zip") & F.col("ext").isin("docx", "docm", "dotm", "xlsx", "xlsm", "xlsb", "pptx", "pptm")
    text = F.decode("payload", "ISO-8859-1")
    one = lambda key, severity, cond: F.when(cond, F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity"), F.lit("").alias("evidence")))
    marks = F.array_compact(F.array(one("macro_storage", "high", old & (F.contains(text, F.lit("_\x00V\x00B\x00A\x00")) | F.contains(text, F.lit("Attribute VB_")))), one("dde_field", "high", old & text.rlike(r"\bDDE(AUTO)?\b")), one("macro_name", "medium", new & F.col("ext").isin("docm", "dotm", "xlsm", "xlsb", "pptm"))))
    a = attachments.where(old | new)
    return a.select("msg_id", "att_index", F.when(old, "unavailable").otherwise("inspected").alias("status"), marks.alias("findings"), (~old).alias("analysis_complete"))


def qr_inspection(attachments: DataFrame, bodies: DataFrame) -> DataFrame:
    """(msg_id, att_index, status, request, analysis_complete): pictures and PDF files of messages that ask to scan a code.

    Nothing here can read a code, so each is ``unavailable`` and incomplete; without such a file there is one row that says so.
    """
    from mailquarry.functions.text import qr_request

    asked = bodies.select("msg_id", qr_request(F.col("body")).alias("request")).where("request <> ''")
    files = attachments.where(F.col("content_type").startswith("image/") | F.col("magic_format").isin("png", "jpeg", "gif", "pdf")).select("msg_id", "att_index")
    both = asked.join(files, "msg_id", "left")
    return both.select("msg_id", "att_index", F.when(F.col("att_index").isNull(), "not_found").otherwise("unavailable").alias("status"), "request", F.lit(False).alias("analysis_complete"))


def script_behaviours(files: DataFrame, sender_registered: Column, suffixes: DataFrame) -> DataFrame:
    """(msg_id, att_index, behaviours, risk_level) of HTML and SVG files.

    High where fields for secrets go to another site than the sender's, where
    a picture holds a script, and where a script unpacks or drops a file;
    medium on any other behaviour.
    """
    from mailquarry.functions.urls import host
    from mailquarry.operators.hosts import registered_domains
    from mailquarry.operators.html import html_forms

    f = files.withColumn("_text", F.decode("payload", "UTF-8")).withColumn("_own", sender_registered)
    f = f.where(F.col("ext").isin("html", "htm", "xhtml", "svg") | (F.col("content_type").isin("text/html", "image/svg+xml")))
    f = f.select("msg_id", "att_index", "_own", html_file_behaviours(F.col("_text")).alias("behaviours"), html_forms("_text").alias("_forms"))
    t = f.select("msg_id", "att_index", "_own", F.explode("_forms").alias("f")).where("f.sensitive > 0").select("msg_id", "att_index", "_own", host(F.col("f.action")).alias("host"))
    known = registered_domains(t, suffixes).select("host", "registered_domain")
    away = t.join(known, "host").where(~F.col("registered_domain").eqNullSafe(F.col("_own"))).select("msg_id", "att_index", F.lit(True).alias("_away")).distinct()
    out = f.join(away, ["msg_id", "att_index"], "left")
    high = F.coalesce("_away", F.lit(False)) | F.arrays_overlap("behaviours", F.array(*map(F.lit, ("file_drop", "script_in_svg", "decoding"))))
    return out.select("msg_id", "att_index", "behaviours", F.when(high, "high").when(F.size("behaviours") > 0, "medium").otherwise("low").alias("risk_level"))


def archive_summary(findings: DataFrame, samples: int = 4) -> DataFrame:
    """(msg_id, att_index, key, severity, count, samples), high ones first, then by key."""
    g = findings.groupBy("msg_id", "att_index", "key", "severity").agg(F.count("*").alias("count"), F.slice(F.array_sort(F.collect_list("evidence")), 1, samples).alias("samples"))
    return g.orderBy("msg_id", "att_index", F.col("severity") != "high", "key")


def pdf_static(payload: Column) -> Column:
    """Counts of active names in a PDF's syntax; the structure itself isn't parsed, so the scan is never complete."""
    text = F.decode(payload, "ISO-8859-1")
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("int")
    return F.struct(n(r"/JavaScript\b|/JS\b").alias("javascript"), n(r"/OpenAction\b|/AA\b").alias("auto_action"), n(r"/Launch\b").alias("launch"), n(r"/EmbeddedFile\b").alias("embedded_file"), n(r"/URI\s*\(").alias("uri"), F.lit(False).alias("complete"))


def html_file_behaviours(text: Column) -> Column:
    """What the scripts of an HTML or SVG file do; any of them makes the file serious."""
    one = lambda name, p: F.when(text.rlike(p), name)
    return F.array_compact(
        F.array(
            one("redirect", r"(?i)(window|document|top)\.location(\.href)?\s*=|location\.replace\("),
            one("dynamic_code", r"(?i)\beval\s*\(|new\s+Function\s*\(|document\.write\s*\("),
            one("decoding", r"(?i)\batob\s*\(|unescape\s*\(|String\.fromCharCode"),
            one("file_drop", r"(?i)URL\.createObjectURL|msSaveOrOpenBlob|new\s+Blob\s*\("),
            one("external_form", r"(?i)<form[^>]+action\s*=\s*[\"']?https?://"),
            one("script_in_svg", r"(?is)<svg.*<script"),
        )
    )


def calendar_events(text: str | None) -> list[dict]:
    """Events of a calendar part: unfolded lines, unescaped values; at most 20 events and 25 links each."""
    lines = re.sub(r"\r?\n[ \t]", "", (text or "")[: 256 << 10]).splitlines()
    events, current = [], None
    for line in lines:
        name, _, value = line.partition(":")
        key = name.split(";")[0].upper()
        value = value.replace("\\n", "\n").replace("\\N", "\n").replace("\\,", ",").replace("\\;", ";").replace("\\\\", "\\")
        if key == "BEGIN" and value.upper() == "VEVENT":
            current = {"organizer": None, "summary": None, "attendees": 0, "links": []}
        elif key == "END" and value.upper() == "VEVENT" and current is not None:
            if len(events) < 20:
                events.append(current)
            current = None
        elif current is not None:
            if key == "ORGANIZER":
                current["organizer"] = re.sub(r"(?i)^mailto:", "", value).strip().lower()
            elif key == "SUMMARY":
                current["summary"] = value
            elif key == "ATTENDEE":
                current["attendees"] += 1
            current["links"] = list(dict.fromkeys([*current["links"], *re.findall(r"https?://[^\s<>\"\\]+", value)]))[:25]
    return events


_EVENT = T.ArrayType(T.StructType([T.StructField("organizer", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("attendees", T.IntegerType()), T.StructField("links", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_EVENT)
def calendar(text: pd.Series) -> pd.Series:
    return text.map(calendar_events)


def calendar_level(links: Column, organizer_domain: Column, sender_domains: Column) -> Column:
    """Links and another organiser MEDIUM, links INFO, another organiser LOW."""
    other = (organizer_domain != "") & ~F.array_contains(sender_domains, organizer_domain)
    return F.when((links > 0) & other, "MEDIUM").when(links > 0, "INFO").when(other, "LOW")
