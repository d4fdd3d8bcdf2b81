from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailquarry import dims
from mailquarry.functions import text as tx
from mailquarry.functions import urls as ur
from mailquarry.operators import envelope, flags, history, hosts, indicators, policy, registry

# The golden set: what each message shows, and the verdict.
SCENARIOS = {
    "legitimate_order": ({"authenticated": True}, "legitimate"),
    "missing_dkim_only": ({"authenticated": True, "technical_effect": "informational"}, "legitimate"),
    "regular_invoice_iban": ({"authenticated": True, "technical_effect": "informational"}, "legitimate"),
    "fake_reply": ({"authenticated": True, "technical_effect": "supporting"}, "review"),
    "ipfs_link": ({"authenticated": True, "technical_effect": "supporting", "supplied_action": True}, "review"),
    "calendar_invite": ({"authenticated": True, "medium_calendar": True}, "review"),
    "iban_change_foreign": ({"technical_effect": "decisive"}, "phishing"),
    "personalised_login_link": ({"technical_effect": "decisive", "supplied_action": True}, "phishing"),
    "cross_domain_reply_to": ({"high_reply_routing": True}, "phishing"),
    "masked_brand_link": ({"high_masked_link": True}, "phishing"),
    "fabricated_thread": ({"high_threading": True}, "phishing"),
    "svg_script": ({"high_html_attachment": True}, "phishing"),
    "executable_attachment": ({"technical_effect": "decisive"}, "phishing"),
    "sender_lookalike": ({"high_from_lookalike": True}, "phishing"),
    "ai_grounded_phishing": ({"risk_assessment": "phishing", "risk_evidence": "pay now", "risk_rationale": "asks for a secret"}, "phishing"),
}


def evidence(spark, rows: dict[str, dict]):
    names = sorted({k for r in rows.values() for k in r})
    kinds = {k: "string" if k in ("technical_effect", "risk_assessment", "risk_evidence", "risk_rationale", "second_opinion", "impersonation_decision", "impersonation_status", "impersonation_confidence") else "boolean" for k in names}
    return spark.createDataFrame([(n, *(r.get(k) for k in names)) for n, r in rows.items()], "msg_id string, " + ", ".join(f"{k} {kinds[k]}" for k in names))


def test_golden_scenarios(spark):
    got = {r.msg_id: r.final_verdict for r in policy.verdicts(evidence(spark, {n: e for n, (e, _) in SCENARIOS.items()})).collect()}
    assert got == {n: v for n, (_, v) in SCENARIOS.items()}


def test_verdict_branches(spark):
    rows = {
        "spoofed_action": {"display_name_spoofing": True, "supplied_action": True},
        "auth_failed_spoofed": {"display_name_spoofing": True, "all_auth_failed": True},
        "auth_failed_action": {"all_auth_failed": True, "risky_action": True},
        "unsupported_vote": {"risk_assessment": "phishing", "authenticated": True},
        "suspicious_corroborated": {"payment_requested": True, "display_name_spoofing": True},
        "doubt": {"payment_requested": True, "authenticated": True},
        "impersonation": {"authenticated": True, "impersonation_decision": "review"},
        "otherwise": {"authenticated": True},
    }
    got = {r.msg_id: (r.verdict_decided_by, r.final_verdict) for r in policy.verdicts(evidence(spark, rows)).collect()}
    assert {n: b for n, (b, _) in got.items()} == {n: n for n in rows}
    assert got["impersonation"][1] == "review" and got["unsupported_vote"][1] == "review"


def test_incomplete_is_never_clean(spark):
    got = policy.verdicts(evidence(spark, {"m": {"authenticated": True, "inspection_incomplete": True}})).first()
    assert (got.technical_risk, got.final_verdict) == ("uncertain", "review")
    tones = policy.tone(evidence(spark, {"a": {"analysis_incomplete": True, "informational_only": True, "dkim_missing_only": True}, "b": {"informational_only": True, "dkim_missing_only": True}, "c": {}}))
    assert {r.msg_id: r.tone for r in tones.collect()} == {"a": "review", "b": "safe", "c": "review"}


def test_signals_and_effects(spark):
    rows = [("m", "HIGH", "SPF", ""), ("m", "MEDIUM", "DKIM", "result none"), ("m", "MEDIUM", "Odd thing", ""), ("m", "HIGH", "MIME diagnostics", ""), ("n", "LOW", "Link", "")]
    df = spark.createDataFrame(rows, "msg_id string, level string, field string, message string")
    p = dims.table(spark, dims.SIGNAL_POLICY, "field_key string, signal string, category string")
    s = policy.verdict_signals(df, p)
    assert {(r.msg_id, r.signal, r.effect) for r in s.collect()} == {("m", "auth.spf", "decisive"), ("m", "auth.dkim", "informational"), ("m", "static.odd-thing", "supporting"), ("n", "link.structure", "informational")}
    assert {r.msg_id: (r.effect, r.labels) for r in policy.technical_effect(s).collect()} == {"m": ("decisive", ["SPF"]), "n": ("informational", ["Link"])}


def test_extraction_and_merge(spark):
    raw1 = 'noise {"requested_action": "pay_or_transfer", "action_channel": "link", "evidence": "Please  PAY", "signals": ["Urgency", "urgency"], "risk_assessment": "phishing", "confidence": "0.25"} tail'
    raw2 = '{"requested_action": "fly", "signals": ["threat"], "risk_assessment": "legitimate", "confidence": "7"}'
    df = spark.createDataFrame([("m", 0, raw2, "text"), ("m", 1, raw1, "well, please pay today"), ("n", 0, "no json", "x")], "msg_id string, section int, raw string, body string")
    x = policy.normalised_extraction(df)
    got = {(r.msg_id, r.section): r for r in x.collect()}
    assert (got["m", 1].evidence, got["m", 1].signals, got["m", 1].confidence) == ("Please  PAY", ["urgency"], 0.25)
    assert (got["m", 0].requested_action, got["m", 0].confidence, got["n", 0].json_valid) == ("none", 1.0, False)
    m = {r.msg_id: r for r in policy.merged_sections(x).collect()}
    assert (m["m"].requested_action, m["m"].risk_assessment, m["m"].signals, m["m"].sections) == ("pay_or_transfer", "phishing", ["threat", "urgency"], 2)


def test_impersonation(spark):
    rows = [("a", "sender_lookalike", True, True), ("a", "action_lookalike", True, True), ("b", "authenticated_documented_sender", True, True), ("b", "documented_sender", True, True), ("c", "external_reply", True, True)]
    got = {r.msg_id: (r.score, r.status, r.decision) for r in policy.impersonation(spark.createDataFrame(rows, "msg_id string, signal string, represented boolean, official_known boolean")).collect()}
    assert got == {"a": (70, "inconsistent", "phishing"), "b": (0, "consistent", "none"), "c": (10, "insufficient_data", "review")}


def test_flags(spark):
    df = spark.createDataFrame([("m", "fail", None, "none", True, "HIGH", True, False)], "msg_id string, spf string, dkim string, dmarc string, dkim_present boolean, reply_level string, return_path_mismatch boolean, display_name_spoofing boolean")
    assert {(r.field, r.level) for r in flags.message_flags(df).collect()} == {("SPF", "MEDIUM"), ("DMARC", "INFO"), ("Reply-To", "HIGH"), ("Return-Path", "LOW")}


def test_registry(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [("r1", "Contoso Ltd", ["Contoso Mail"], "catalog", t("2024-01-01"), t("2025-01-01")), ("r2", "Contoso", None, "local", t("2024-01-01"), t("2025-01-01")), ("r3", "Fabrikam", None, "catalog", t("2020-01-01"), t("2021-01-01")), ("r4", "Twin", None, "catalog", t("2024-01-01"), t("2025-01-01")), ("r5", "TWIN", None, "catalog", t("2024-01-01"), t("2025-01-01"))]
    reg = spark.createDataFrame(rows, "record_id string, brand string, aliases array<string>, source string, verified_at timestamp, expires_at timestamp")
    names = spark.createDataFrame([("contoso",), ("CONTOSO  mail",), ("Contoso GmbH",), ("Fabrikam",), ("Twin",)], "name string")
    got = {r.name: r.record_id for r in registry.resolve(names, reg, F.to_timestamp(F.lit("2024-06-01"))).collect()}
    assert got == {"contoso": "r2", "CONTOSO  mail": "r1", "Contoso GmbH": "r2"}
    links = spark.createDataFrame([("m", 0, "https://a.contoso.com/pay/x", "r1"), ("m", 1, "https://contoso.com/payment", "r1"), ("m", 2, "http://contoso.com/pay", "r1"), ("m", 3, "https://contoso.com/pay/../x", "r1"), ("m", 4, "https://u@contoso.com/pay", "r1")], "msg_id string, link_index int, url string, record_id string")
    rel = spark.createDataFrame([("r1", "contoso.com", ["visit_link"], "/pay/")], "record_id string, domain string, scopes array<string>, path_prefix string")
    assert [r.link_index for r in registry.authorised_links(links, rel, "visit_link").collect()] == [0]


def test_lookalikes_and_suffixes(spark):
    names = ["www.contoso.com", "c0ntoso.com", "contosoo.com", "contoso-login.com", "mycontoso.net", "contoso.net", "a.b.co.uk", "co.uk", "host.unknown", "shop.pages.dev", "fabrikarn.com", "other.com", "contoso.com.evil.test", "contoso.evil.test", "contoso-shop.com"]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    sfx = dims.table(spark, dims.PUBLIC_SUFFIXES, "suffix string, private boolean")
    known = hosts.registered_domains(df, sfx)
    got = {r.host: r.registered_domain for r in known.collect()}
    assert (got["www.contoso.com"], got["a.b.co.uk"], got["co.uk"], got["host.unknown"], got["shop.pages.dev"]) == ("contoso.com", "b.co.uk", "co.uk", "host.unknown", "shop.pages.dev")
    found = {r.host: (r.brand, r.technique, r.level) for r in hosts.lookalikes(known, dims.table(spark, dims.BRANDS, "brand string, token string, official string")).collect()}
    assert found == {"c0ntoso.com": ("Contoso", "confusable", "HIGH"), "contosoo.com": ("Contoso", "edit_distance", "HIGH"), "contoso-login.com": ("Contoso", "lure_word", "HIGH"), "contoso-shop.com": ("Contoso", "combosquat", "MEDIUM"), "contoso.com.evil.test": ("Contoso", "official_prefix", "HIGH"), "contoso.evil.test": ("Contoso", "subdomain", "MEDIUM"), "mycontoso.net": ("Contoso", "embedded", "MEDIUM"), "fabrikarn.com": ("Fabrikam", "confusable", "HIGH")}
    senders = spark.createDataFrame([("m", "from", "c0ntoso.com"), ("m", "reply_to", "gmail.com"), ("n", "from", "contoso.com")], "msg_id string, role string, domain string")
    assert [(r.msg_id, r.role, r.technique) for r in hosts.sender_lookalikes(senders, sfx, dims.table(spark, dims.BRANDS, "brand string, token string, official string")).collect()] == [("m", "from", "confusable")]
    kinds = hosts.hosting_kind(spark.createDataFrame([("x.ipfs.io",), ("bit.ly",), ("a.pages.dev",), ("ok.com",)], "host string"), dims.table(spark, dims.LINK_HOSTS, "domain string, kind string"))
    assert {r.host: r.kind for r in kinds.collect()} == {"x.ipfs.io": "ipfs", "bit.ly": "shortener", "a.pages.dev": "abused_hosting"}


def test_indicators(spark):
    rows = [("m", "url", "hxxps://Evil[.]test/A#x", 1), ("m", "domain", "EVIL.test.", 2), ("m", "ip", "8.8.8.8", 3), ("m", "sha256", "xyz", 4)]
    df = spark.createDataFrame(rows, "msg_id string, type string, value string, source int")
    df = df.withColumn("value", indicators.normalised(F.col("type"), F.col("value")))
    d = indicators.distinct_indicators(df, "msg_id")
    assert {r.value for r in d.collect()} == {"https://evil.test/A", "evil.test", "8.8.8.8"}
    pulses = spark.createDataFrame([("domain", "evil.test", "p1", "x", None, ["Phishing"]), ("ip", "8.8.8.8", "p2", "y", None, ["malware"]), ("url", "https://evil.test/a", "p3", "z", None, ["info"])], "type string, value string, pulse_id string, name string, modified timestamp, tags array<string>")
    hits = indicators.pulse_matches(d, pulses)
    assert {(r.key, r.strong) for r in hits.collect()} == {("evil.test", True), ("8.8.8.8", False), ("https://evil.test/a", False)}
    bad = spark.createDataFrame([("8.8.8.8", "malicious")], "ip string, status string")
    assert {r.key for r in indicators.pulse_matches(d, pulses, bad).where("strong").collect()} == {"evil.test", "8.8.8.8"}
    s = indicators.pulse_summary(hits).first()
    assert (s.matches, s.strong_matches, s.status) == (3, 1, "match")


def test_link_rules(spark):
    addr = "bob@office.example"
    import base64

    enc = base64.urlsafe_b64encode(addr.encode()).decode().rstrip("=")
    links = spark.createDataFrame([("m", 0, f"https://x.test/#{addr}"), ("m", 1, f"https://x.test/?e={enc}"), ("m", 2, f"https://x.test/?e={addr}")], "msg_id string, link_index int, url string")
    got = {r.link_index: r.level for r in envelope.recipient_in_links(links, spark.createDataFrame([("m", addr)], "msg_id string, address string")).collect()}
    assert got == {0: "HIGH", 1: "MEDIUM"}
    masks = spark.createDataFrame([(True, True, False), (True, True, True), (True, False, False), (True, False, True), (False, True, False)], "display_mismatch boolean, protected boolean, tracker boolean")
    assert [r.mask_level for r in envelope.masked_links(masks).collect()] == ["HIGH", "MEDIUM", "MEDIUM", None, None]


@pytest.mark.parametrize(
    ("url", "scheme", "host", "targets"),
    [
        ("HTTPS://u:p@Shop.Example.com.:8443/a?b=1#c", "https", "shop.example.com", []),
        ("https://t.test/?url=https%253A%252F%252Fa.test&url=//b.test&x=https://c.test", "https", "t.test", ["https://a.test", "//b.test"]),
        ("mailto:a@b.test", "mailto", "", []),
    ],
)
def test_url_parts(spark, url, scheme, host, targets):
    r = spark.createDataFrame([(url,)], "u string").select(ur.scheme(F.col("u")).alias("s"), ur.host(F.col("u")).alias("h"), ur.redirect_targets(F.col("u")).alias("t")).first()
    assert (r.s, r.h, r.t) == (scheme, host, targets)


def test_text_functions(spark):
    one = lambda c, *v: spark.createDataFrame([v], ["x", "y"][: len(v)]).select(c.alias("r")).first().r
    x, y = F.col("x"), F.col("y")
    assert one(tx.evidence_form(x), "“Pay” —  now’s") == "\"pay\" - now's"
    assert one(tx.ai_view(x), "a​b  c\n\n\n\nd") == "ab c\n\nd" and one(tx.removed_controls(x), "a​­") == 2
    assert one(tx.segments(x), "First sentence. first sentence. Other line here\nok") == ["First sentence.", "Other line here"]
    assert [one(tx.reply_prefix(x), s) for s in ("Re: a", "[x] AW[2]: b", "Fwd: c", "Report: d")] == ["re", "aw", "fwd", ""]
    assert one(tx.typo_class(x, y), "contsoo", "contoso") and one(tx.typo_class(x, y), "con-toso", "contoso") and not one(tx.typo_class(x, y), "contaso", "contoso")
    assert one(tx.list_row_shape(x), "Item 12 at https://a.test/x costs 3,50") == one(tx.list_row_shape(x), "Thing 7 at https://b.test costs 9")


def test_history_rules(spark):
    rows = [(f"2024-01-{d:02d}", "danger" if d % 2 else "safe") for d in range(1, 31)]
    h = spark.createDataFrame(rows, "d string, tone string").select(F.to_date("d").alias("day"), "tone")
    for a, b in (("2024-01-01", "2024-01-30"), ("2024-01-05", "2024-01-09"), ("2022-03-15", "2026-02-01"), ("2024-01-07", "2024-01-07")):
        bars = history.activity_buckets(h, F.lit(a), F.lit(b)).collect()
        assert len(bars) <= 12 and sum(r.total for r in bars) == sum(a <= d <= b for d, _ in rows)
        assert all(r.total == r.danger + r.review + r.safe for r in bars)
    assert history.tone_counts(h.limit(0)).first().danger_share is None
    m = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,), (float("inf"),), (None,), (3.0,)], "duration double")
    assert tuple(history.median_duration(m).first()) == (2.0, 2)
    old = spark.createDataFrame([("r1", "safe", 5)], "record_id string, tone string, n int")
    assert tuple(history.replaced(old, spark.createDataFrame([("r1", "danger", None)], "record_id string, tone string, n int"), ["tone", "n"]).first()) == ("r1", "danger", 5)
