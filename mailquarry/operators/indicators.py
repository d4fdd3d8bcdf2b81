"""Indicators of messages and their matches in threat-intelligence snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions.urls import refanged


def distinct_indicators(rows: DataFrame, message: str | None = None) -> DataFrame:
    """(…, type, key, value, source, seen): one row for each type and folded value, with the first source's spelling."""
    keys = ([message] if message else []) + ["type", "key"]
    r = rows.where(F.coalesce(F.col("value"), F.lit("")) != "").withColumn("key", F.lower("value"))
    return r.groupBy(*keys).agg(F.min(F.struct("source", "value")).alias("_f"), F.count("*").alias("seen")).select(*keys, F.col("_f.value").alias("value"), F.col("_f.source").alias("source"), "seen")


def normalised(type_: Column, value: Column) -> Column:
    """An indicator as providers spell it; null if it is none of its type."""
    v = refanged(value)
    return (
        F.when((type_ == "url") & v.rlike(r"^(?i)https?://[^\s/]+"), F.concat(F.lower(F.regexp_extract(v, r"^([^/]*//[^/?#]*)", 1)), F.regexp_extract(v, r"^[^/]*//[^/?#]*([^#]*)", 1)))
        .when((type_ == "domain") & v.rlike(r"^(?i)[a-z0-9_-]+(\.[a-z0-9_-]+)+\.?$"), F.lower(F.regexp_replace(v, r"\.$", "")))
        .when((type_ == "ip") & v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+$"), F.lower(v))
        .when((type_ == "sha256") & v.rlike("^[0-9A-Fa-f]{64}$"), F.lower(v))
    )


def candidates(links: DataFrame, route: DataFrame, files: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(msg_id, type, key, value, source, seen): what a message offers to be looked up, each type and value once.

    Sources by rank: 1 links, 2 hosts of links, 3 sender domains, 4 addresses
    of hops, 5 hashes of files; the first one a value has counts.
    """
    rows = [
        links.where(F.col("scheme").isin("http", "https")).select("msg_id", F.lit("url").alias("type"), F.col("url").alias("value"), F.lit(1).alias("source")),
        links.where("host <> ''").select("msg_id", F.when(F.col("is_ip"), "ip").otherwise("domain").alias("type"), F.col("host").alias("value"), F.lit(2).alias("source")),
        envelopes.select("msg_id", F.lit("domain").alias("type"), F.explode(F.array("from_domain", "reply_domain", "return_domain")).alias("value"), F.lit(3).alias("source")),
        route.select("msg_id", F.lit("ip").alias("type"), F.explode("all_ips").alias("value"), F.lit(4).alias("source")),
        files.select("msg_id", F.lit("sha256").alias("type"), F.col("sha256").alias("value"), F.lit(5).alias("source")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return distinct_indicators(out.withColumn("value", normalised(F.col("type"), F.col("value"))), "msg_id")


def capped(indicators: DataFrame, message: str, order: list[Column], k: int = 32) -> DataFrame:
    """At most ``k`` indicators of each message."""
    return indicators.withColumn("_rn", F.row_number().over(Window.partitionBy(message).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def pulse_matches(indicators: DataFrame, pulses: DataFrame, ip_reputation: DataFrame | None = None) -> DataFrame:
    """Exact matches of (type, key): strong where a pulse is tagged malicious, phishing or malware.

    An address matches strongly only if another source calls it malicious too.
    """
    tagged = F.arrays_overlap(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), F.array(*map(F.lit, ("malicious", "phishing", "malware"))))
    p = pulses.select("type", F.lower("value").alias("key"), "pulse_id", "name", "modified", tagged.alias("_tagged"))
    hit = indicators.join(p, ["type", "key"])
    if ip_reputation is not None:
        bad = ip_reputation.where("status = 'malicious'").select(F.lower("ip").alias("key"), F.lit(True).alias("_bad")).distinct()
        hit = hit.join(bad, "key", "left")
    else:
        hit = hit.withColumn("_bad", F.lit(None).cast("boolean"))
    strong = F.col("_tagged") & ((F.col("type") != "ip") | F.coalesce("_bad", F.lit(False)))
    return hit.withColumn("strong", strong).drop("_tagged", "_bad")


def pulse_summary(matches: DataFrame, message: str = "msg_id", top: int = 20) -> DataFrame:
    """Counts, status and the ``top`` matches of each message, strong ones first."""
    rank = F.row_number().over(Window.partitionBy(message).orderBy(F.desc("strong"), "source", "type", "key", "pulse_id"))
    m = matches.withColumn("_rn", rank)
    return m.groupBy(message).agg(
        F.count("*").alias("matches"), F.count_if("strong").alias("strong_matches"), F.when(F.bool_or("strong"), "match").otherwise("context_only").alias("status"),
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= top, F.struct("_rn", "type", "key", "name", "strong")))).alias("listed"),
    )
