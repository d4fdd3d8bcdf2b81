"""PDF files by their syntax: active names, addresses, redirects. Streams aren't decompressed, so no scan claims to be complete."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.functions import urls as ur

#: Names in a PDF's dictionaries -> (indicator, severity).
NAMES = {
    "JavaScript": ("javascript", "high"), "JS": ("javascript", "high"), "Launch": ("launch", "critical"), "OpenAction": ("auto_action", "medium"), "AA": ("auto_action", "medium"),
    "EmbeddedFile": ("embedded_file", "medium"), "RichMedia": ("rich_media", "medium"), "SubmitForm": ("submit_form", "high"), "ImportData": ("import_data", "medium"),
    "GoToR": ("remote_goto", "medium"), "XFA": ("xfa", "medium"), "ObjStm": ("object_stream", "info"), "URI": ("uri", "info"), "Encrypt": ("encrypted", "low"),
}
SEVERITY = ["info", "low", "medium", "high", "critical"]
#: Own marks of parameters and paths that follow a reader.
TRACKING = ["utm_", "track", "click", "campaign", "mc_eid", "recipient"]
#: Own short list of places where anyone can put up a page: (host, path prefix).
PUBLIC_SITES = [("sites.google.com", "/view/"), ("docs.google.com", "/forms/"), ("forms.office.com", ""), ("www.canva.com", ""), ("app.box.com", ""), ("notion.site", "")]
MOST_URLS = 25


def name_unescaped(text: Column) -> Column:
    """PDF names with #xx written as characters; others stay."""
    parts = F.split(text, "#")
    one = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.chr(F.conv(F.left(p, F.lit(2)), 16, 10).cast("int")), F.substring(p, 3, 1 << 20))).otherwise(F.concat(F.lit("#"), p))
    return F.when(F.size(parts) == 1, text).otherwise(F.concat(parts[0], F.array_join(F.transform(F.filter(parts, lambda p, i: i > 0), one), "")))


def static_counts(payload: Column) -> Column:
    """How often each indicator's name stands in the file, as a map; escaped names are read."""
    text = F.decode(payload, "ISO-8859-1")
    found = F.transform(F.regexp_extract_all(text, F.lit(r"/([A-Za-z0-9#]{2,30})"), 1), name_unescaped)
    kinds = F.create_map(*(x for k, (i, _) in NAMES.items() for x in (F.lit(k), F.lit(i))))
    named = F.filter(F.transform(found, lambda n: F.try_element_at(kinds, n)), lambda n: n.isNotNull())
    each = F.array_distinct(named)
    return F.map_from_arrays(each, F.transform(each, lambda k: F.size(F.filter(named, lambda n: n == k))))


def merged_counts(static: DataFrame, structural: DataFrame) -> DataFrame:
    """(att_id, key, count): what a structural scan counted, else what the syntax shows; both are (att_id, key, count)."""
    s = static.select("att_id", "key", F.col("count").alias("_static"))
    t = structural.select("att_id", "key", F.col("count").alias("_structural"))
    return s.join(t, ["att_id", "key"], "full").select("att_id", "key", F.coalesce("_structural", "_static").alias("count")).where("count > 0")


def nested_urls(url: Column) -> Column:
    """Destinations within an address: its redirect parameters' values, then any address inside another value; at most ten."""
    pairs = F.transform(F.split(ur.query(url), "&"), lambda p: ur.decoded_repeatedly(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))
    inside = F.flatten(F.transform(pairs, lambda v: F.regexp_extract_all(v, F.lit(r"(https?://[^\s\"'<>]+)"), 1)))
    return F.slice(F.array_distinct(F.concat(ur.redirect_targets(url), inside)), 1, 10)


def has_tracking(url: Column) -> Column:
    names = F.transform(F.split(ur.query(url), "&"), lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1)))
    where = F.lower(F.concat(ur.host(url), F.lit(" "), ur.path(url)))
    return where.rlike("analytics|track|pixel") | F.exists(names, lambda n: n.rlike("|".join(TRACKING)))


def is_public_site(url: Column) -> Column:
    h, p = ur.host(url), F.lower(ur.path(url))
    hit = F.lit(False)
    for host, prefix in PUBLIC_SITES:
        hit = hit | (((h == host) | h.endswith("." + host)) & p.startswith(prefix))
    return hit


def embedded_urls(*scans: Column) -> Column:
    """The distinct addresses that several scans found, in their order, at most 25."""
    return F.slice(F.array_distinct(F.flatten(F.array(*(F.coalesce(s, F.array().cast("array<string>")) for s in scans)))), 1, MOST_URLS)


_LITERAL = re.compile(rb"/URI\s*\(((?:[^()\\]|\\.){1,2000})\)", re.S)
_HEX = re.compile(rb"/URI\s*<([0-9A-Fa-f\s]{2,4000})>")


def uris_of(payload: bytes | None) -> list[str]:
    """Addresses of URI actions in the plain part of a file, literal or in hex, each as often as it stands there."""
    raw = payload or b""
    found = [(m.start(), re.sub(rb"\\(.)", rb"\1", m[1], flags=re.S)) for m in _LITERAL.finditer(raw)]
    for m in _HEX.finditer(raw):
        digits = re.sub(rb"\s", b"", m[1]).decode()
        found.append((m.start(), bytes.fromhex(digits + "0" * (len(digits) % 2))))
    texts = (t.decode("utf-16" if t[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1", "replace").strip() for _, t in sorted(found))
    return [t for t in texts if re.match(r"(?i)[a-z][a-z0-9+.-]*:", t)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def action_uris(payload: pd.Series) -> pd.Series:
    return payload.map(uris_of)


def uri_evidence(uris: DataFrame) -> DataFrame:
    """(att_id, uris, unique_uris, web, redirects, tracking, public_sites, unsafe) from (att_id, scan, url) rows.

    Every scan counts for itself and the largest count of each kind is taken,
    as scans see the same addresses.
    """
    u = F.col("url")
    facts = {"web": ur.scheme(u).isin("http", "https"), "redirects": F.size(nested_urls(u)) > 0, "tracking": has_tracking(u), "public_sites": is_public_site(u), "unsafe": ur.scheme(u).isin("javascript", "file", "data")}
    by = uris.groupBy("att_id", "scan").agg(F.count("*").alias("uris"), F.count_distinct("url").alias("unique_uris"), *(F.count_if(c).alias(n) for n, c in facts.items()))
    return by.groupBy("att_id").agg(*(F.max(n).alias(n) for n in ("uris", "unique_uris", *facts)))


def assessment(counts: DataFrame) -> DataFrame:
    """(att_id, risk_level, suspicious, indicators) of (att_id, key, count): the worst severity; two kinds of medium make it high."""
    severity = {i: s for i, s in NAMES.values()}
    rank = F.create_map(*(x for k, s in severity.items() for x in (F.lit(k), F.lit(SEVERITY.index(s)))))
    c = counts.withColumn("_r", F.coalesce(rank[F.col("key")], F.lit(0)))
    g = c.groupBy("att_id").agg(F.max("_r").alias("_max"), F.count_if(F.col("_r") == 2).alias("_medium"), F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), (-F.col("count")).alias("n"), "key"))).alias("_all"))
    top = F.when((F.col("_max") == 2) & (F.col("_medium") >= 2), 3).otherwise(F.col("_max"))
    level = F.when(top >= 3, "high").when(top == 2, "medium").when(top == 1, "low").otherwise("clean")
    return g.select("att_id", level.alias("risk_level"), (top >= 3).alias("suspicious"), F.transform("_all", lambda x: F.struct(x["key"].alias("key"), (-x["n"]).alias("count"))).alias("indicators"))


def attachment_scan(attachments: DataFrame) -> DataFrame:
    """(msg_id, att_index, indicators, uris, risk_level, analysis_complete) of the PDF files among attachments."""
    a = attachments.where((F.col("magic_format") == "pdf") | (F.col("ext") == "pdf") | (F.col("content_type") == "application/pdf"))
    a = a.select("msg_id", "att_index", static_counts(F.col("payload")).alias("indicators"), action_uris("payload").alias("uris"))
    severity = {i: s for i, s in NAMES.values()}
    worst = F.array_max(F.transform(F.map_keys("indicators"), lambda k: F.coalesce(F.create_map(*(x for n, s in severity.items() for x in (F.lit(n), F.lit(SEVERITY.index(s)))))[k], F.lit(0))))
    return a.withColumn("_w", F.coalesce(worst, F.lit(0))).withColumn("risk_level", F.when(F.col("_w") >= 3, "high").when(F.col("_w") == 2, "medium").when(F.col("_w") == 1, "low").otherwise("clean")).drop("_w").withColumn("analysis_complete", F.lit(False))
