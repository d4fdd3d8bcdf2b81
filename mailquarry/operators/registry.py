"""Partner registry: who may send for, and be linked to from, an organisation; with validity and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions.urls import has_userinfo, host, parent_suffixes, path, scheme

ROLES = ["official", "delegated", "documented"]


def brand_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def short_key(name: Column) -> Column:
    """A brand key without legal forms and punctuation."""
    k = F.regexp_replace(brand_key(name), r"[.,]", "")
    return F.trim(F.regexp_replace(k, r"\s+(inc|ltd|llc|gmbh|ag|spa|srl|sa|bv|plc|group|holding)$", ""))


def resolve(names: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """(name, record_id, source): the record of each name that is valid now.

    The exact key before the shortened one, local records before the catalog.
    Two different records at the first step that has any: none.
    ``registry`` has record_id, brand, aliases, source, verified_at, expires_at.
    """
    valid = registry.where((F.col("verified_at") <= now) & (now < F.col("expires_at")))
    called = valid.select("record_id", "source", F.explode(F.concat(F.array("brand"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("called"))
    keys = called.select("record_id", "source", F.explode(F.array(F.struct(F.lit(0).alias("step"), brand_key(F.col("called")).alias("key")), F.struct(F.lit(1).alias("step"), short_key(F.col("called")).alias("key")))).alias("k"))
    keys = keys.select("record_id", "source", "k.step", "k.key").where("key <> ''").distinct()
    asked = names.select("name").distinct()
    asked = asked.select("name", F.explode(F.array(F.struct(F.lit(0).alias("step"), brand_key(F.col("name")).alias("key")), F.struct(F.lit(1).alias("step"), short_key(F.col("name")).alias("key")))).alias("k")).select("name", "k.step", "k.key")
    hit = asked.join(keys, ["step", "key"]).withColumn("rank", F.col("step") * 2 + F.when(F.col("source") == "local", 0).otherwise(1))
    best = hit.withColumn("_best", F.min("rank").over(Window.partitionBy("name"))).where("rank = _best")
    one = best.groupBy("name").agg(F.countDistinct("record_id").alias("n"), F.first("record_id").alias("record_id"), F.first("source").alias("source"))
    return one.where("n = 1").select("name", "record_id", "source")


def authorised_links(links: DataFrame, relations: DataFrame, action: str) -> DataFrame:
    """links (msg_id, link_index, url, record_id) that a relation of the record allows for an action.

    https without a user, the relation's domain or one under it, and the
    relation's path prefix up to a ``/``; no dot segments. ``relations`` has
    record_id, domain, scopes, path_prefix.
    """
    u = F.col("url")
    good = links.where((scheme(u) == "https") & ~has_userinfo(u) & ~path(u).rlike(r"(^|/)\.{1,2}(/|$)|%2e"))
    parts = good.withColumn("_path", path(u)).withColumn("domain", F.explode(parent_suffixes(host(u))))
    r = relations.where(F.array_contains("scopes", action)).select("record_id", "domain", F.regexp_replace(F.coalesce("path_prefix", F.lit("")), "/+$", "").alias("_prefix"))
    hit = parts.join(r, ["record_id", "domain"])
    within = (F.col("_prefix") == "") | (F.col("_path") == F.col("_prefix")) | F.startswith("_path", F.concat(F.col("_prefix"), F.lit("/")))
    return hit.where(within).select("msg_id", "link_index").distinct()


def all_links_accepted(links: DataFrame, accepted: DataFrame) -> DataFrame:
    """(msg_id, all_accepted): a message has links and the host of each is one of its accepted domains or under one."""
    parts = links.select("msg_id", "link_index", F.explode(parent_suffixes(host(F.col("url")))).alias("domain"))
    hit = parts.join(accepted.select("msg_id", "domain", F.lit(True).alias("ok")), ["msg_id", "domain"], "left")
    each = hit.groupBy("msg_id", "link_index").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"))
    return each.groupBy("msg_id").agg(F.bool_and("ok").alias("all_accepted"))


def valid_domain(domain: Column) -> Column:
    d = F.lower(F.trim(domain))
    return F.coalesce(d.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"), F.lit(False))


def checked_import(directory: DataFrame, last_sequence: int) -> DataFrame:
    """Records of an import with a reject_reason: stale sequence, bad interval, role or domain; null for good ones."""
    reason = (
        F.when(F.col("sequence") <= last_sequence, "stale_sequence")
        .when(F.col("verified_at").isNull() | (F.col("expires_at") <= F.col("verified_at")), "bad_interval")
        .when(F.exists("relations", lambda r: ~r["role"].isin(ROLES)), "unknown_role")
        .when(F.exists("relations", lambda r: ~valid_domain(r["domain"])), "bad_domain")
    )
    return directory.withColumn("reject_reason", reason)


def challenge(domain: Column, record_id: Column, secret: str) -> Column:
    """The text record that shows control of a domain, made from a secret that only the registry has."""
    return F.concat(F.lit("mailquarry-verify="), F.sha2(F.concat_ws("|", F.lit(secret), record_id, F.lower(domain)), 256))


def control_verified(relations: DataFrame, text_records: DataFrame, secret: str) -> DataFrame:
    """relations (record_id, domain, ...) with ``verified``: whether a text record of the domain is its challenge."""
    r = relations.withColumn("_c", challenge(F.col("domain"), F.col("record_id"), secret))
    seen = text_records.select(F.lower("domain").alias("_d"), F.col("value").alias("_c"), F.lit(True).alias("_ok")).distinct()
    out = r.join(seen.withColumnRenamed("_d", "_dom").withColumnRenamed("_c", "_val"), (F.lower("domain") == F.col("_dom")) & (F.col("_c") == F.col("_val")), "left")
    return out.withColumn("verified", F.coalesce("_ok", F.lit(False))).drop("_c", "_dom", "_val", "_ok")


def merged(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The registry after additions and removals: ``op`` add or remove by record_id, the last by ``at`` wins."""
    last = changes.withColumn("_rn", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("at")))).where("_rn = 1").drop("_rn")
    kept = registry.join(last.select("record_id"), "record_id", "left_anti")
    return kept.unionByName(last.where("op = 'add'").select(registry.columns))


def baseline_anomalies(current: DataFrame, baseline: DataFrame, now: Column, ttl_days: int = 90) -> DataFrame:
    """(msg_id, new_action_domains, new_reply_domains) against a sender's unexpired baseline; no baseline, no row."""
    b = baseline.where(F.col("written_at") >= now - F.expr(f"INTERVAL {ttl_days} DAYS")).select("partner", "sender", F.col("action_domains").alias("_a"), F.col("reply_domains").alias("_r"))
    j = current.join(b, ["partner", "sender"])
    out = j.select("msg_id", F.array_except("action_domains", "_a").alias("new_action_domains"), F.array_except("reply_domains", "_r").alias("new_reply_domains"))
    return out.where((F.size("new_action_domains") > 0) | (F.size("new_reply_domains") > 0))
