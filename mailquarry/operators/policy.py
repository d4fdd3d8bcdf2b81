"""From findings and semantic evidence to risks, verdict and tone; every cascade names the branch that decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.dims import ACTION_PRIORITY, IMPERSONATION_WEIGHTS, LEVEL_EFFECTS, small

# Fields that say nothing about an embedded message, and diagnostics that never count.
EMBEDDED_IGNORED = ["spf", "dkim", "dmarc", "authentication-results", "received", "return-path", "reply-to", "display name", "reply thread"]
IGNORED_PREFIX = "mime "

RISKY_ACTIONS = ["provide_credentials", "pay_or_transfer", "bypass_procedure", "provide_information", "change_account_settings", "verify_account", "claim_reward", "open_attachment", "visit_link", "reply"]


def _map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def first_match(branches: list[tuple[str, Column, str]], otherwise: tuple[str, str]) -> tuple[Column, Column]:
    """(value, decided_by) of an ordered cascade of (branch name, condition, value); null conditions don't match."""
    value = by = None
    for name, condition, result in branches:
        c = F.coalesce(condition, F.lit(False))
        value = F.when(c, result) if value is None else value.when(c, result)
        by = F.when(c, name) if by is None else by.when(c, name)
    return value.otherwise(otherwise[1]), by.otherwise(otherwise[0])


def field_key(field: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(field, r"\s+", " ")))


def verdict_signals(flags: DataFrame, policy: DataFrame, scope: str | None = None, dmarc_passed: str | None = None, reply_level: str | None = None) -> DataFrame:
    """flags (msg_id, level, field, message) with signal, category and effect.

    MIME diagnostics don't count, nor do delivery fields of an embedded
    message (``scope`` column) or Return-Path where DMARC passed
    (``dmarc_passed`` column). A DKIM finding that only says none or missing
    informs. Mail addresses that older reports flagged as links don't count;
    a Reply-To finding has the level that its routing has now (``reply_level``
    column), and goes where that is NONE. Fields without a policy get
    ``static.`` and their slug.
    """
    key = field_key(F.col("field"))
    keep = ~key.startswith(IGNORED_PREFIX)
    if scope:
        keep = keep & ~(F.col(scope).eqNullSafe("embedded_unavailable") & key.isin(EMBEDDED_IGNORED))
    if dmarc_passed:
        keep = keep & ~(F.coalesce(F.col(dmarc_passed), F.lit(False)) & (key == "return-path"))
    keep = keep & ~((key == "link") & F.coalesce(F.lower("message").contains("mailto:"), F.lit(False)))
    if reply_level:
        routed = (key == "reply-to") & F.col(reply_level).isNotNull()
        flags = flags.where(~routed | (F.col(reply_level) != "NONE")).withColumn("level", F.when(routed, F.col(reply_level)).otherwise(F.col("level")))
    out = flags.where(keep).withColumn("field_key", key).join(small(policy), "field_key", "left")
    silent = (F.col("field_key") == "dkim") & F.lower("message").rlike(r"\bnone\b|missing|not present")
    effect = F.when(silent, "informational").otherwise(F.coalesce(_map(LEVEL_EFFECTS)[F.upper("level")], F.lit("informational")))
    slug = F.regexp_replace(F.regexp_replace("field_key", r"[^a-z0-9]+", "-"), "^-|-$", "")
    return out.withColumn("signal", F.coalesce("signal", F.concat(F.lit("static."), slug))).withColumn("category", F.coalesce("category", F.lit("static"))).withColumn("effect", effect).drop("field_key")


def technical_effect(signals: DataFrame) -> DataFrame:
    """(msg_id, effect, labels): the strongest effect of each message and the distinct fields that have it."""
    rank = F.when(F.col("effect") == "decisive", 2).when(F.col("effect") == "supporting", 1).otherwise(0)
    top = signals.withColumn("_r", rank).groupBy("msg_id").agg(F.max("_r").alias("_r"), F.array_sort(F.collect_set(F.struct("_r", "field"))).alias("_all"))
    effect = F.when(F.col("_r") == 2, "decisive").when(F.col("_r") == 1, "supporting").otherwise("informational")
    return top.select("msg_id", effect.alias("effect"), F.transform(F.filter("_all", lambda x: x["_r"] == F.col("_r")), lambda x: x["field"]).alias("labels"))


def worst_risk(risk: Column) -> Column:
    """Place of a scan result among clean < low < unknown < medium < high < critical; nulls count as unknown."""
    return F.coalesce(_map({"clean": 0, "low": 1, "unknown": 2, "medium": 3, "high": 4, "critical": 5})[F.lower(risk)], F.lit(2))


# --- semantic input -------------------------------------------------------------------------------------------------


def enum(value: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(allowed), v).otherwise(default)


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def confidence(value: Column) -> Column:
    """A number within 0 and 1; 0 where there is none."""
    v = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))), F.lit(0.0))


def json_object(text: Column) -> Column:
    """The first object without inner objects, or the span from the first brace to the last, that is valid JSON."""
    flat, wide = F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.try_parse_json(t).isNotNull() & (t != "")
    return F.when(valid(wide), wide).when(valid(flat), flat)


def normalised_extraction(outputs: DataFrame) -> DataFrame:
    """Model output (msg_id, section, raw, body) as policy fields: closed enums, signals, grounded quotation, derived flags."""
    from mailquarry.functions.text import evidence_form

    fields = "requested_action string, action_channel string, evidence string, signals array<string>, risk_assessment string, risk_evidence string, risk_rationale string, confidence string, ambiguity string"
    x = outputs.withColumn("_j", F.from_json(json_object(F.col("raw")), fields))
    action = enum(F.col("_j.requested_action"), list(ACTION_PRIORITY), "none")
    body = evidence_form(F.col("body"))
    grounded = lambda c: F.when((F.length(F.trim(c)) > 0) & F.contains(body, evidence_form(c)), c)
    signals = F.array_sort(F.array_distinct(F.transform(F.coalesce("_j.signals", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))))
    out = x.select(
        "msg_id", "section", F.col("_j").isNotNull().alias("json_valid"),
        action.alias("requested_action"), enum(F.col("_j.action_channel"), ["link", "form", "attachment", "reply", "phone", "none"], "none").alias("action_channel"),
        grounded(F.col("_j.evidence")).alias("evidence"), signals.alias("signals"), enum(F.col("_j.risk_assessment"), ["legitimate", "suspicious", "phishing"], "legitimate").alias("risk_assessment"),
        grounded(F.col("_j.risk_evidence")).alias("risk_evidence"), F.nullif(F.trim(F.col("_j.risk_rationale")), F.lit("")).alias("risk_rationale"),
        confidence(F.col("_j.confidence")).alias("confidence"), enum(F.col("_j.ambiguity"), ["low", "medium", "high"], "low").alias("ambiguity"),
    )
    has = lambda s: F.array_contains("signals", s)
    return (
        out.withColumn("supplied_channel", F.col("action_channel").isin("link", "form", "attachment"))
        .withColumn("urgent", has("urgency") | has("deadline"))
        .withColumn("deceptive", has("pretext") | has("threat") | has("deception"))
    )


def merged_sections(sections: DataFrame) -> DataFrame:
    """One row for each message: the strongest section decides the action, risks are the largest, signals the union.

    A section's strength: its action's weight, +8 with a quotation, -120
    without one for a real action, +3 with a supplied channel, +10 times the
    confidence (half to even), -10 if very ambiguous. Equal ones: the earlier.
    """
    weight = F.coalesce(_map(ACTION_PRIORITY)[F.col("requested_action")], F.lit(0))
    real = ~F.col("requested_action").isin("none", "informational")
    score = (
        weight
        + F.when(F.col("evidence").isNotNull(), 8).otherwise(F.when(real, -120).otherwise(0))
        + F.when(F.col("supplied_channel"), 3).otherwise(0)
        + F.bround(10 * F.col("confidence"), 0).cast("int")
        - F.when(F.col("ambiguity") == "high", 10).otherwise(0)
    )
    risk = F.when(F.col("risk_assessment") == "phishing", 2).when(F.col("risk_assessment") == "suspicious", 1).otherwise(0)
    s = sections.withColumn("_score", score).withColumn("_risk", risk)
    key = F.struct("_score", -F.col("section"))
    best = lambda c: F.max_by(c, key).alias(c)
    riskiest = F.struct("_risk", -F.col("section"))
    return s.groupBy("msg_id").agg(
        *(best(c) for c in ("requested_action", "action_channel", "evidence", "supplied_channel", "confidence", "ambiguity")),
        F.max_by("risk_assessment", riskiest).alias("risk_assessment"), F.max_by("risk_evidence", riskiest).alias("risk_evidence"), F.max_by("risk_rationale", riskiest).alias("risk_rationale"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"), F.bool_or("urgent").alias("urgent"), F.bool_or("deceptive").alias("deceptive"), F.count("*").alias("sections"),
    )


# --- the three risks ------------------------------------------------------------------------------------------------


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def content_risk(m: DataFrame) -> DataFrame:
    """content_risk benign / suspicious / malicious, content_decided_by and content_reasons.

    Reads boolean evidence columns; ones that are missing count as false.
    """
    m = _with_flags(m, CONTENT_FLAGS)
    value, by = first_match(
        [
            ("copy_deception", _flag("high_copy_deception"), "malicious"),
            ("extortion", _flag("structured_extortion") & _flag("payment_requested"), "malicious"),
            ("payment_diversion", _flag("bank_transfer") & _flag("grounded_destination_change") & _flag("bec_or_invoice_scam"), "malicious"),
            ("reward_impersonation", _flag("corroborated_reward"), "malicious"),
            ("workflow_hijack", _flag("payment_workflow_hijack"), "malicious"),
            ("security_lure", _flag("security_lure") & _flag("deterministic_identity_deception"), "malicious"),
            ("credential_submission", _flag("credential_submission") & _flag("risky_channel") | _flag("credential_disclosure"), "malicious"),
            ("bypass_request", _flag("bypass_requested"), "malicious"),
            ("deception", _flag("deceptive") & _flag("deterministic_identity_deception") & (_flag("sensitive_request") | _flag("settings_change") & _flag("supplied_channel")), "malicious"),
            ("grounded_vote", (F.col("risk_assessment") == "phishing") & F.col("risk_evidence").isNotNull() & F.col("risk_rationale").isNotNull() & ~F.coalesce(F.col("second_opinion") == "disagrees", F.lit(False)), "malicious"),
        ],
        ("reasons", "rest"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(_flag("payment_requested"), "payment requested"),
            F.when(_flag("sensitive_request"), "sensitive data requested"),
            F.when(_flag("credentials_mentioned"), "credentials mentioned"),
            F.when((_flag("settings_change") | _flag("verification_requested") | _flag("reward_claim")) & _flag("supplied_channel"), "account action through a supplied channel"),
            F.when(_flag("urgent") & _flag("targeted"), "targeted urgency"),
            F.when(_flag("pretext") & _flag("threat") & _flag("supplied_channel"), "pretext with a threat"),
            F.when(_flag("incentive") & _flag("urgent") & _flag("supplied_channel"), "incentive with urgency"),
            F.when(_flag("unresolved_qr"), "QR code not resolved"),
            F.when((F.col("risk_assessment") != "legitimate") & F.col("risk_evidence").isNull(), "vote without quotation"),
        )
    )
    out = m.withColumn("content_reasons", reasons).withColumn("_v", value)
    return out.withColumn("content_risk", F.when(F.col("_v") != "rest", F.col("_v")).when(F.size("content_reasons") > 0, "suspicious").otherwise("benign")).withColumn("content_decided_by", by).drop("_v")


CONTENT_FLAGS = [
    "high_copy_deception", "structured_extortion", "payment_requested", "bank_transfer", "grounded_destination_change", "bec_or_invoice_scam", "corroborated_reward", "payment_workflow_hijack",
    "security_lure", "deterministic_identity_deception", "credential_submission", "risky_channel", "credential_disclosure", "bypass_requested", "deceptive", "sensitive_request", "settings_change",
    "supplied_channel", "credentials_mentioned", "verification_requested", "reward_claim", "urgent", "targeted", "pretext", "threat", "incentive", "unresolved_qr",
]
IDENTITY_FLAGS = ["claimed_assessed", "display_name_spoofing", "risky_action", "sender_mismatch", "action_mismatch", "public_reference", "claimed_brand_mismatch", "reply_mismatch", "forwarded_identity", "supplied_action", "authenticated", "qualified_spf"]
TECHNICAL_MALICIOUS = ["high_reply_routing", "high_copy_deception", "malicious_reputation", "high_html_attachment", "suspicious_pdf", "strong_otx", "high_from_lookalike", "high_masked_link", "unsafe_scheme", "high_threading", "medium_threading_sensitive", "invoice_dangerous_download"]
TECHNICAL_UNCERTAIN = ["inspection_incomplete", "medium_findings", "ambiguous_from", "direct_ip", "risky_lookalike", "medium_calendar", "unrelated_sensitive_link", "coherence_anomalies"]
VERDICT_FLAGS = ["all_auth_failed", "risky_action", "supplied_action", "payment_requested", "spf_failed_at_sender", "only_qr_mismatch", "benign_unavailable", "local_only_clear"]


def _with_flags(m: DataFrame, names: list[str]) -> DataFrame:
    extra = {n: F.lit(False) for n in names if n not in m.columns}
    text = {n: F.lit(None).cast("string") for n in ("risk_assessment", "risk_evidence", "risk_rationale", "second_opinion", "technical_effect", "impersonation_decision", "impersonation_status", "impersonation_confidence") if n not in m.columns}
    return m.withColumns(extra | text)


def identity_risk(m: DataFrame) -> DataFrame:
    """identity_risk verified / uncertain / spoofing_evidence and identity_decided_by, first match wins."""
    m = _with_flags(m, IDENTITY_FLAGS)
    assessed = _flag("claimed_assessed")
    value, by = first_match(
        [
            ("claimed_phishing", assessed & (F.col("impersonation_decision") == "phishing") & (F.col("impersonation_confidence") == "high"), "spoofing_evidence"),
            ("claimed_consistent_reply", assessed & (F.col("impersonation_status") == "consistent") & _flag("reply_mismatch"), "uncertain"),
            ("claimed_consistent", assessed & (F.col("impersonation_status") == "consistent"), "verified"),
            ("claimed_other", assessed, "uncertain"),
            ("display_name", _flag("display_name_spoofing"), "spoofing_evidence"),
            ("double_mismatch", _flag("risky_action") & _flag("sender_mismatch") & _flag("action_mismatch") & ~_flag("public_reference"), "spoofing_evidence"),
            ("brand_mismatch", _flag("claimed_brand_mismatch"), "spoofing_evidence"),
            ("public_reference", _flag("risky_action") & _flag("public_reference") & (_flag("sender_mismatch") | _flag("action_mismatch")), "uncertain"),
            ("reply", _flag("reply_mismatch"), "uncertain"),
            ("forwarded", _flag("forwarded_identity") & _flag("supplied_action"), "uncertain"),
            ("authenticated", _flag("authenticated") | _flag("qualified_spf"), "verified"),
        ],
        ("unproved", "uncertain"),
    )
    return m.withColumn("identity_risk", value).withColumn("identity_decided_by", by)


def technical_risk(m: DataFrame) -> DataFrame:
    """technical_risk clean / uncertain / malicious with technical_reasons; incomplete is never clean."""
    m = _with_flags(m, TECHNICAL_MALICIOUS + TECHNICAL_UNCERTAIN)
    list_ = lambda names: F.array_compact(F.array(*(F.when(_flag(n), n) for n in names)))
    bad, doubt = list_(TECHNICAL_MALICIOUS), list_(TECHNICAL_UNCERTAIN)
    effect = F.coalesce(F.col("technical_effect"), F.lit(""))
    bad = F.when((F.size(bad) == 0) & (effect == "decisive"), F.array(F.lit("decisive_finding"))).otherwise(bad)
    doubt = F.when(effect == "supporting", F.array_append(doubt, F.lit("supporting_finding"))).otherwise(doubt)
    m = m.withColumn("_bad", bad).withColumn("_doubt", doubt)
    value = F.when(F.size("_bad") > 0, "malicious").when(F.size("_doubt") > 0, "uncertain").otherwise("clean")
    return m.withColumn("technical_risk", value).withColumn("technical_reasons", F.when(F.size("_bad") > 0, F.col("_bad")).otherwise(F.col("_doubt"))).drop("_bad", "_doubt")


def final_verdict(m: DataFrame) -> DataFrame:
    """final_verdict phishing / review / legitimate and verdict_decided_by, from the three risks; first match wins."""
    m = _with_flags(m, VERDICT_FLAGS)
    c, i, t = F.col("content_risk"), F.col("identity_risk"), F.col("technical_risk")
    vote = F.coalesce(F.col("risk_assessment"), F.lit("legitimate"))
    unsure = F.coalesce(F.col("second_opinion").isin("disagrees", "unavailable"), F.lit(False)) | F.col("risk_evidence").isNull() | ((vote == "phishing") & F.col("risk_rationale").isNull())
    value, by = first_match(
        [
            ("malicious", (t == "malicious") | (c == "malicious"), "phishing"),
            ("spoofed_action", (i == "spoofing_evidence") & _flag("supplied_action"), "phishing"),
            ("auth_failed_spoofed", _flag("all_auth_failed") & (i == "spoofing_evidence"), "phishing"),
            ("auth_failed_action", _flag("all_auth_failed") & _flag("risky_action"), "phishing"),
            ("unsupported_vote", vote.isin("suspicious", "phishing") & unsure, "review"),
            ("payment_spf", (c == "suspicious") & _flag("payment_requested") & F.col("risk_evidence").isNotNull() & _flag("spf_failed_at_sender"), "phishing"),
            ("suspicious_corroborated", (c == "suspicious") & ((i == "spoofing_evidence") | ((t == "uncertain") & ~_flag("only_qr_mismatch"))), "phishing"),
            ("doubt", (c == "suspicious") | (i == "spoofing_evidence") | ((i == "uncertain") & _flag("supplied_action") & ~_flag("benign_unavailable") & ~_flag("local_only_clear")) | (t == "uncertain"), "review"),
        ],
        ("otherwise", "legitimate"),
    )
    m = m.withColumn("_v", value).withColumn("_by", by)
    lifted = (F.col("_v") == "legitimate") & F.coalesce(F.col("impersonation_decision") == "review", F.lit(False))
    return m.withColumn("final_verdict", F.when(lifted, "review").otherwise(F.col("_v"))).withColumn("verdict_decided_by", F.when(lifted, "impersonation").otherwise(F.col("_by"))).drop("_v", "_by")


def verdicts(evidence: DataFrame) -> DataFrame:
    """All risks and the verdict from one row of evidence for each message."""
    return final_verdict(technical_risk(identity_risk(content_risk(evidence))))


def derived_signals(m: DataFrame) -> DataFrame:
    """Booleans that follow from the closed set of signals and the action, each also true where the model said so itself."""
    said = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in m.columns else F.lit(False)
    has = lambda s: F.coalesce(F.array_contains("signals", s), F.lit(False))
    urgent = said("urgency_present") | has("urgency")
    risky = ~F.col("requested_action").isin("none", "informational", "other")
    return m.withColumns(
        {
            "financial_pretext_present": said("financial_pretext_present") | has("financial_pretext"), "financial_incentive_present": said("financial_incentive_present") | has("incentive"),
            "threat_or_consequence_present": said("threat_or_consequence_present") | has("threat") | said("coercion"), "urgency_present": urgent,
            "urgency_targets_risky_action": said("urgency_targets_risky_action") | (urgent & risky), "signals": F.array_sort(F.array_distinct("signals")),
        }
    )


def corroboration(verdict: Column, identity: Column, identity_reasons: Column, technical: Column, technical_reasons: Column, most: int = 4) -> Column:
    """What speaks for a decision and what against it, at most four of each: struct(details, caveats).

    For a threat doubts about the sender and the files support it, for a clean
    message proof does; the rest are caveats.
    """
    threat, passed = verdict.isin("phishing", "review"), F.array(F.lit("sender authentication passed"))
    none = F.array().cast("array<string>")
    who, what = F.coalesce(identity_reasons, none), F.coalesce(technical_reasons, none)
    proved, clean = identity == "verified", technical == "clean"
    details = F.when(threat, F.concat(F.when(proved, none).otherwise(who), F.when(clean, none).otherwise(what))).otherwise(F.concat(F.when(proved, passed).otherwise(none), F.when(clean, what).otherwise(none)))
    caveats = F.when(threat, F.concat(F.when(proved, passed).otherwise(none), F.when(clean, what).otherwise(none))).otherwise(F.concat(F.when(proved, F.array_except(who, passed)).otherwise(who), F.when(clean, none).otherwise(what)))
    cut = lambda a: F.slice(F.array_distinct(a), 1, most)
    return F.struct(cut(details).alias("details"), cut(caveats).alias("caveats"))


# How much a kind of scam or threat says.
SCAM_RANK = {"none": 0, "other": 1, "extortion": 2, "sextortion": 3}
THREAT_RANK = {"none": 0, "other": 1, "data_exposure": 2, "reputation_harm": 2, "private_material_exposure": 3}


def verifier_merge(first: Column, second: Column) -> Column:
    """The second look's fields, but an empty asset or amount, and a less specific scam or threat, is taken from the first.

    Both are structs with payment_asset, amount, scam_type and threat_type; an
    unknown type ranks as ``other``.
    """
    rank = lambda ranks, c: F.coalesce(_map(ranks)[F.coalesce(c, F.lit("none"))], F.lit(1))
    filled = lambda n: F.coalesce(F.nullif(second[n], F.lit("")), F.nullif(first[n], F.lit("")))
    better = lambda n, ranks: F.when(rank(ranks, first[n]) > rank(ranks, second[n]), first[n]).otherwise(second[n])
    return F.struct(filled("payment_asset").alias("payment_asset"), filled("amount").alias("amount"), better("scam_type", SCAM_RANK).alias("scam_type"), better("threat_type", THREAT_RANK).alias("threat_type"))


#: Facts that each rule the local clearance out.
CLEARANCE_BARS = [
    "credential_submission", "sensitive_request", "payment_requested", "settings_change", "verification_requested", "reward_claim", "bypass_requested", "deceptive", "deterministic_identity_deception",
    "threat", "forwarded_identity", "spf_conflict", "reply_to_mismatch", "display_name_spoofing", "risky_lookalike", "high_flag", "medium_flag",
]


def local_clearance(m: DataFrame) -> DataFrame:
    """local_only_clear: ordinary mail of a sender whose server proved it, where outside checks are switched off.

    All must hold: local-only operation; benign content and clean files; a
    benign vote with a reason, no doubtful second look, no high ambiguity, a
    confidence of 0.8 where one is given; an action that asks for no secret;
    DMARC passed by the receiving server's own result and neither SPF nor DKIM
    is adverse; none of CLEARANCE_BARS; every link within the sender's domain,
    every attachment inspected and clean, no form.
    """
    m = _with_flags(m, [*CLEARANCE_BARS, "local_only", "dmarc_direct", "links_own", "attachments_clean"])
    col = lambda n, t: F.col(n) if n in m.columns else F.lit(None).cast(t)
    adverse = ["fail", "softfail", "mixed", "permerror", "temperror", "neutral", "policy"]
    ok = (
        _flag("local_only") & (F.col("content_risk") == "benign") & (F.col("technical_risk") == "clean")
        & (F.col("risk_assessment") == "legitimate") & F.col("risk_rationale").isNotNull() & ~F.coalesce(F.col("second_opinion").isin("disagrees", "unavailable"), F.lit(False))
        & ~F.coalesce(col("ambiguity", "string") == "high", F.lit(False)) & F.coalesce(col("confidence", "double") >= 0.8, F.lit(True))
        & F.col("requested_action").isin("visit_link", "open_attachment", "informational") & F.coalesce(F.lower(col("dmarc", "string")) == "pass", F.lit(False)) & _flag("dmarc_direct")
        & ~F.coalesce(F.lower(col("spf", "string")).isin(adverse), F.lit(False)) & ~F.coalesce(F.lower(col("dkim", "string")).isin(adverse), F.lit(False))
        & _flag("links_own") & _flag("attachments_clean") & (F.coalesce(col("forms", "bigint"), F.lit(0)) == 0)
    )
    for bar in CLEARANCE_BARS:
        ok = ok & ~_flag(bar)
    return m.withColumn("local_only_clear", F.coalesce(ok, F.lit(False)))


def tone(m: DataFrame) -> DataFrame:
    """tone danger / review / safe and tone_decided_by; first match wins."""
    m = _with_flags(m, ["confirmed_indicator", "high_html_attachment", "analysis_incomplete", "resource_unverified", "high_flag", "medium_flag", "first_party_notice", "informational_only", "dkim_missing_only", "any_mismatch"])
    verdict = F.coalesce(F.col("final_verdict"), F.lit("none")) if "final_verdict" in m.columns else F.lit("none")
    content = F.coalesce(F.col("content_risk"), F.lit("")) if "content_risk" in m.columns else F.lit("")
    value, by = first_match(
        [
            ("confirmed", _flag("confirmed_indicator") | _flag("high_html_attachment") | _flag("high_flag"), "danger"),
            ("phishing", (verdict == "phishing") | (content == "malicious"), "danger"),
            ("incomplete", _flag("analysis_incomplete"), "review"),
            ("unverified", _flag("resource_unverified"), "review"),
            ("suspicious", content == "suspicious", "review"),
            ("first_party", _flag("first_party_notice"), "safe"),
            ("informational", _flag("informational_only") & _flag("dkim_missing_only") & ~_flag("any_mismatch"), "safe"),
            ("review", (verdict == "review") | _flag("medium_flag"), "review"),
            ("legitimate", verdict == "legitimate", "safe"),
        ],
        ("otherwise", "review"),
    )
    return m.withColumn("tone", value).withColumn("tone_decided_by", by)


def impersonation(signals: DataFrame) -> DataFrame:
    """(msg_id, score, escalated, status, decision) from rows (msg_id, signal, represented, official_known).

    Each signal has a weight and a family; a family counts with its largest
    weight, or its smallest if none is positive. Escalation needs a
    represented entity with known official domains and either two strong
    families or a strong action destination.
    """
    weights = {k: w for k, (w, _) in IMPERSONATION_WEIGHTS.items()}
    families = {k: f for k, (_, f) in IMPERSONATION_WEIGHTS.items()}
    s = signals.withColumn("weight", _map(weights)[F.col("signal")]).withColumn("family", _map(families)[F.col("signal")]).where("weight is not null")
    by_family = s.groupBy("msg_id", "family").agg(
        F.max("weight").alias("_max"), F.min("weight").alias("_min"), F.bool_or("represented").alias("_rep"), F.bool_or("official_known").alias("_off"),
        F.bool_or(F.col("signal") == "sender_domain_mismatch").alias("_mismatch"), F.bool_or(F.col("signal").isin("sensitive_external_action", "action_lookalike")).alias("_dest"),
        F.bool_or(F.col("signal") == "authenticated_documented_sender").alias("_auth"),
    )
    strong = F.col("_max") >= 25
    m = by_family.groupBy("msg_id").agg(
        F.greatest(F.lit(0), F.least(F.lit(100), F.sum(F.when(F.col("_max") > 0, F.col("_max")).otherwise(F.col("_min"))))).cast("int").alias("score"),
        F.count_if(strong).alias("_strong"), F.bool_or(strong & (F.col("family") == "action_destination")).alias("_action"), F.bool_or("_rep").alias("_rep"), F.bool_or("_off").alias("_off"),
        F.bool_or(F.col("_max") > 0).alias("_positive"), F.bool_or(F.col("_mismatch")).alias("_mismatch"), F.bool_or(F.col("_dest")).alias("_dest"), F.bool_or(F.col("_auth")).alias("_auth"),
    )
    escalated = F.coalesce(F.col("_rep") & F.col("_off") & ((F.col("_strong") >= 2) | F.col("_action")), F.lit(False))
    status = F.when((F.col("_strong") > 0) | F.col("_mismatch") | F.col("_dest"), "inconsistent").when(F.col("_auth"), "consistent").otherwise("insufficient_data")
    return m.select("msg_id", "score", escalated.alias("escalated"), status.alias("status"), F.when(escalated, "phishing").when(F.col("_positive"), "review").otherwise("none").alias("decision"))
