"""Who a message says it is from: organisations it names, what is known of them, and whether that fits its domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.dims import small
from mailquarry.functions.text import exact_span

#: Own words that may follow an organisation's name in a display name.
ROLES = ["support", "security", "billing", "payments", "team", "service", "customer service", "account", "help desk", "assistenza", "sicurezza"]
# What a sentence says that tells a model what to put out.
ORDERS = ["claimed_brand", "claimed_role", "ignore previous instructions", "ignore all previous instructions"]
#: Own words that close a letter, and that speak to its reader.
CLOSINGS = ["regards", "thanks", "thank you", "cheers", "sincerely", "yours", "grazie", "saluti", "grüße", "saludos", "cordialement"]
ADDRESSED = ["your account", "your profile", "your order", "dear customer", "we noticed", "we detected", "we have received", "il tuo account", "gentile cliente", "dein konto", "votre compte", "su cuenta"]
#: Where a name can stand, the strongest place first.
PLACES = ["sender", "subject", "body", "attachment"]
# Seconds that an observation of a name server or a registry holds, found or not found.
CACHE_SECONDS = {("dns", True): 3600, ("dns", False): 120, ("rdap", True): 86_400, ("rdap", False): 300, ("bootstrap", True): 604_800, ("bootstrap", False): 604_800}
RECENT_DAYS = 90


def quoted(name: Column) -> Column:
    """A name as a pattern: taken literally, any blanks or hyphens between its words."""
    words = F.regexp_replace(F.replace(F.trim(name), F.lit(r"\E"), F.lit("")), r"[\s-]+", r"\\E[\\s-]+\\Q")
    return F.concat(F.lit(r"\Q"), words, F.lit(r"\E"))


def brand_in_display(display: Column, brand: Column) -> Column:
    """The display name is the brand's name, or that and one role; more words make another name of it."""
    pattern = F.concat(F.lit("(?i)^"), quoted(brand), F.lit(r"(\s+(" + "|".join(r.replace(" ", r"\s+") for r in ROLES) + "))?$"))
    return F.coalesce((F.length(F.trim(brand)) > 0) & F.regexp_like(F.trim(display), pattern), F.lit(False))


def identity_text(text: Column) -> Column:
    """A text without addresses, links and host names, and without sentences that tell a model what to put out."""
    t = F.coalesce(text, F.lit(""))
    said = lambda s: F.regexp_replace(F.lower(s), r"\s+", " ")
    orders = lambda s: F.exists(F.array(*map(F.lit, ORDERS)), lambda o: F.contains(said(s), o))
    t = F.when(orders(t), F.array_join(F.filter(F.split(t, r"(?<=[.!?\n])"), lambda s: ~orders(s)), "")).otherwise(t)
    t = F.regexp_replace(t, r"\S*(://|@)\S*", " ")
    return F.regexp_replace(t, r"(?i)\b[a-z0-9-]+(\.[a-z0-9-]+){0,10}\.[a-z]{2,24}\b", " ")


def brand_occurrences(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """(msg_id, brand, place, evidence): where a brand's name stands as whole words; the first of each place.

    ``texts`` has msg_id, place and text, ``brands`` one column ``brand``. A
    text meets only the brands whose first word it holds, by an equi join.
    """
    plain = F.regexp_replace(F.lower(F.trim("brand")), r"^[^\p{L}\p{N}]+", "")
    named = brands.where(F.length(F.trim("brand")) >= 2).select(exact_span(F.col("brand"), 80).alias("brand"), F.regexp_extract(plain, r"^([\p{L}\p{N}]+)", 1).alias("word")).where("word <> ''").distinct()
    own = texts.select("msg_id", "place", identity_text(F.col("text")).alias("text"))
    first = own.select("msg_id", "place", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("word"))
    pairs = first.join(named, "word").select("msg_id", "place", "brand").distinct().join(own, ["msg_id", "place"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted(F.col("brand")), F.lit(r"(?![\p{L}\p{N}_])"))
    hit = pairs.withColumn("evidence", F.regexp_substr("text", pattern)).where("evidence is not null")
    return hit.groupBy("msg_id", "brand", "place").agg(F.min("evidence").alias("evidence"))


def visible_identity(messages: DataFrame, names: DataFrame) -> DataFrame:
    """(msg_id, brand): the one organisation that a message presents itself as; none where there are several or only mentions.

    ``messages`` has msg_id, display_name and body, ``names`` name and record_id.
    A name counts that is the display name (with a role or not), signs the
    body, or heads it where the reader is addressed. Names of one record are
    one organisation; the longest is told.
    """
    n = names.select("name", F.coalesce("record_id", F.lower("name")).alias("record_id"), F.regexp_extract(F.lower("name"), r"^([\p{L}\p{N}]+)", 1).alias("word")).where("word <> ''")
    body = F.trim(F.regexp_replace(identity_text(F.col("body")), r"\s+", " "))
    m = messages.select("msg_id", F.coalesce("display_name", F.lit("")).alias("shown"), body.alias("said"))
    words = m.select("msg_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "shown", "said")), F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("word"))
    pairs = words.join(n, "word").drop("word").join(m, "msg_id")
    q = quoted(F.col("name"))
    like = lambda text, *parts: F.regexp_like(text, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    sender = brand_in_display(F.col("shown"), F.col("name"))
    signed = like(F.col("said"), "(?i)(" + "|".join(CLOSINGS) + r")\W{1,5}", q, r"\W*$")
    heads = like(F.col("said"), "(?i)^", q, r"\s+(" + "|".join(ROLES) + r")\b") & F.exists(F.array(*map(F.lit, ADDRESSED)), lambda a: F.contains(F.lower(F.left("said", F.lit(700))), a))
    owns = like(F.col("said"), r"(?i)\byour\s+", q, r"\s+account\b") & like(F.col("shown"), "(?i)^", q, r"\b")
    claims = pairs.where(sender | signed | heads | owns).groupBy("msg_id").agg(F.count_distinct("record_id").alias("n"), F.max(F.struct(F.length("name"), "name")).alias("best"))
    return claims.where("n = 1").select("msg_id", F.col("best.name").alias("brand"))


def protected_brands(messages: DataFrame, known: DataFrame, catalog: DataFrame) -> DataFrame:
    """(msg_id, brand, token, official): the brands a message's hosts are held against.

    The known ones, the first domain of each catalog record, and the
    recipients' own organisations; ``messages`` has msg_id and
    recipient_registered (array). Each official domain once for a message.
    """
    first = catalog.select("brand", F.get("domains", F.lit(0)).alias("official")).where("official is not null")
    token = F.regexp_extract("official", r"^([^.]+)", 1)
    common = known.select("brand", "token", "official", F.lit(0).alias("o")).unionByName(first.select("brand", token.alias("token"), "official", F.lit(1).alias("o")))
    common = common.groupBy("official").agg(F.min(F.struct("o", "brand", "token")).alias("b")).select("b.brand", "b.token", "official")
    ids = messages.select("msg_id")
    own = messages.select("msg_id", F.explode("recipient_registered").alias("official")).where("official <> ''").distinct().select("msg_id", F.col("official").alias("brand"), token.alias("token"), "official")
    fixed = ids.crossJoin(small(common))  # a few rows of dimensions for each message
    return fixed.join(own.select("msg_id", "official"), ["msg_id", "official"], "left_anti").select("msg_id", "brand", "token", "official").unionByName(own)


def lookalike_inputs(links: DataFrame) -> DataFrame:
    """(msg_id, host, first_index): hosts of links and of the destinations within them, with the first link that has each."""
    from mailquarry.functions.urls import host

    own = links.select("msg_id", "link_index", "host")
    inner = links.select("msg_id", "link_index", F.explode("redirect_targets").alias("_u")).select("msg_id", "link_index", host(F.col("_u")).alias("host"))
    return own.unionByName(inner).where("host <> ''").groupBy("msg_id", "host").agg(F.min("link_index").alias("first_index"))


def excluded_domains(*sources: DataFrame) -> DataFrame:
    """The distinct registrable domains of several tables, none of which is asked for its age."""
    out = sources[0].select("registered_domain")
    for s in sources[1:]:
        out = out.unionByName(s.select("registered_domain"))
    return out.where(F.col("registered_domain").cast("string") != "").distinct()


def displays_official(display_domains: Column, official: Column) -> Column:
    """A display name shows one of the organisation's own domains."""
    return F.coalesce(F.arrays_overlap(display_domains, official), F.lit(False))


def recently_registered(registered_at: Column, now: Column) -> Column:
    """Registered within the last 90 whole days; not in the future, and null where nothing is known."""
    age = F.datediff(now.cast("date"), registered_at.cast("date"))
    return (age >= 0) & (age < RECENT_DAYS)


def fresh(observations: DataFrame, now: Column) -> DataFrame:
    """Observations (kind, key, found, observed_at, ...) that still hold: the newest of each key, if it hasn't expired."""
    ttl = F.create_map(*(x for (kind, found), s in CACHE_SECONDS.items() for x in (F.lit(f"{kind} {str(found).lower()}"), F.lit(s))))
    seconds = ttl[F.concat_ws(" ", "kind", F.col("found").cast("string"))]
    last = observations.withColumn("_rn", F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.desc("observed_at")))).where("_rn = 1").drop("_rn")
    return last.withColumn("expires_at", F.timestamp_add("SECOND", seconds, F.col("observed_at"))).where(F.col("expires_at") > now)


#: Own marks of mail exchangers: (suffix of the exchanger, provider, class).
EXCHANGERS = [("google.com", "Google", "hosted"), ("outlook.com", "Microsoft", "hosted"), ("pphosted.com", "Proofpoint", "gateway"), ("mimecast.com", "Mimecast", "gateway"), ("secureserver.net", "GoDaddy", "shared"), ("aruba.it", "Aruba", "shared")]


def provider_class(records: DataFrame) -> DataFrame:
    """(domain, provider, provider_class) from mail exchanger records (domain, preference, exchanger): the preferred one decides.

    An exchanger within the domain itself is ``own``, an unknown one
    ``other``; a domain without any is ``none``.
    """
    best = records.groupBy("domain").agg(F.min_by(F.lower(F.rtrim(F.col("exchanger"), F.lit("."))), F.struct("preference", "exchanger")).alias("mx"))
    mx = F.col("mx")
    provider = kind = None
    for suffix, name, cls in EXCHANGERS:
        c = (mx == suffix) | mx.endswith("." + suffix)
        provider = F.when(c, name) if provider is None else provider.when(c, name)
        kind = F.when(c, cls) if kind is None else kind.when(c, cls)
    own = (mx == F.col("domain")) | mx.endswith(F.concat(F.lit("."), F.col("domain")))
    return best.select("domain", provider.alias("provider"), F.when(mx.isNull() | (mx == ""), "none").otherwise(F.coalesce(kind, F.when(own, "own").otherwise("other"))).alias("provider_class"))


def verified_domains(signatures: DataFrame, senders: DataFrame, suffixes: DataFrame, most: int = 3) -> DataFrame:
    """(msg_id, status, verified_domains): domains whose signature over the whole original bytes holds and belongs to the sender.

    ``signatures`` is a snapshot: msg_id, position, d, has_length, valid. A
    signature over part of the body (l=) doesn't count, nor do those after the
    first ``most``; none checked is ``unavailable``, none that holds ``unverified``.
    """
    from mailquarry.operators.hosts import registered_domains

    s = signatures.where(F.col("position") < most)
    known = registered_domains(s.select(F.col("d").alias("host")).unionByName(senders.select(F.col("from_domain").alias("host"))), suffixes).select("host", "registered_domain")
    mine = senders.join(known.select(F.col("host").alias("from_domain"), F.col("registered_domain").alias("_own")), "from_domain", "left")
    each = mine.join(s.join(known.select(F.col("host").alias("d"), F.col("registered_domain").alias("_theirs")), "d", "left"), "msg_id", "left")
    good = F.coalesce(F.col("valid") & ~F.coalesce("has_length", F.lit(False)) & (F.col("_own") == F.col("_theirs")), F.lit(False))
    g = each.groupBy("msg_id").agg(F.array_sort(F.collect_set(F.when(good, F.col("d")))).alias("verified_domains"), F.count("d").alias("_n"))
    return g.select("msg_id", F.when(F.size("verified_domains") > 0, "verified").when(F.col("_n") > 0, "unverified").otherwise("unavailable").alias("status"), "verified_domains")


def brand_coherence(messages: DataFrame, official: DataFrame, references: DataFrame, sender_mail: list[str]) -> DataFrame:
    """(msg_id, brand, source, sender_status, action_status, reply_status): whether the domains of a message fit the brand it claims.

    ``messages`` has msg_id, brand, from_registered, action_registered and
    reply_registered (arrays); ``official`` (brand, domains) comes from the
    registry and is asked first, ``references`` (brand, domains) is a snapshot
    of public sources. Without either all is ``unverified``; an empty side too.
    """
    o = official.select("brand", F.col("domains").alias("_o"))
    r = references.select("brand", F.col("domains").alias("_r"))
    j = messages.join(o, "brand", "left").join(r, "brand", "left").withColumn("_d", F.coalesce("_o", "_r"))
    source = F.when(F.col("_o").isNotNull(), "registry").when(F.col("_r").isNotNull(), "public_reference").otherwise("none")

    def status(side: Column) -> Column:
        known = F.col("_d").isNotNull() & (F.size(side) > 0)
        return F.when(known, F.when(F.size(F.array_except(side, F.col("_d"))) == 0, "aligned").otherwise("mismatch")).otherwise("unverified")

    single = F.array_compact(F.array(F.nullif(F.col("from_registered"), F.lit(""))))
    free = F.col("from_registered").isin(sender_mail)
    return j.select(
        "msg_id", "brand", source.alias("source"), F.when(free & F.col("_d").isNotNull(), "mismatch").otherwise(status(single)).alias("sender_status"),
        status(F.col("action_registered")).alias("action_status"), status(F.col("reply_registered")).alias("reply_status"),
    )


def public_sites(claims: DataFrame, linked_from: DataFrame, certificates: DataFrame) -> DataFrame:
    """(brand, domains): what snapshots of public sources say an organisation's domains are.

    A domain counts that an official site links to or redirects to, or that a
    certificate of the organisation names and such a site bears out; ``claims``
    has brand and site, ``linked_from`` site and domain, ``certificates`` brand
    and domain.
    """
    direct = claims.select("brand", F.col("site").alias("domain")).unionByName(claims.join(linked_from, "site").select("brand", "domain"))
    borne = certificates.join(linked_from.select("domain").distinct(), "domain", "left_semi").join(claims.select("brand").distinct(), "brand", "left_semi").select("brand", "domain")
    return direct.unionByName(borne).where("domain is not null").groupBy("brand").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def enabled(items: DataFrame, provider: str, disabled: list[str], local_only: bool) -> DataFrame:
    """The items with ``status``: null where the provider is to be asked, ``skipped`` where it is switched off; local-only switches all off."""
    return items.withColumn("status", F.lit("skipped" if local_only or provider in disabled else None).cast("string"))
