"""Rules and cascades over facts made from the driver's tables by arithmetic, so that SQL can make the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailquarry import dims
from mailquarry.operators import actions, attachments, auth, envelope, evaluation, hosts, identity, payments, pdf, policy, registry, siem
from mailquarry.plans.table_queries import query, read


class Bits:
    """Named booleans of a key: the i-th is true for the keys with (key * (2 i + 1) + 3 i) % (5 + i % 7) = 0."""

    def __init__(self, key: str, names: list[str]):
        self.key, self.names = key, names

    def _terms(self):
        return ((n, 2 * i + 1, 3 * i, 5 + i % 7) for i, n in enumerate(self.names))

    def columns(self) -> dict:
        return {n: (F.col(self.key) * a + b) % m == 0 for n, a, b, m in self._terms()}

    def sql(self) -> str:
        return ", ".join(f"({self.key} * {a} + {b}) % {m} = 0 AS {n}" for n, a, b, m in self._terms())


def _pick(key: str, values: list, step: int):
    out = None
    for i, v in enumerate(values):
        c = F.floor(F.col(key) / step) % len(values) == i
        out = F.when(c, F.lit(v)) if out is None else out.when(c, F.lit(v))
    return out


def _pick_sql(key: str, values: list, step: int) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'"
    return "CASE " + " ".join(f"WHEN ({key} // {step}) % {len(values)} = {i} THEN {one(v)}" for i, v in enumerate(values)) + " END"


def _case(branches: list[tuple[str, str, str]], otherwise: tuple[str, str], value: str, by: str) -> str:
    """The same cascade as SQL: the first condition that holds gives value and branch."""
    v = "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{r}'" for _, c, r in branches) + f" ELSE '{otherwise[1]}' END AS {value}"
    b = "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{n}'" for n, c, _ in branches) + f" ELSE '{otherwise[0]}' END AS {by}"
    return f"{v}, {b}"


# --- the three risks, the verdict and the tone over one row of facts for each event

_CONTENT = Bits("event_id", policy.CONTENT_FLAGS)
_VOTES = ["legitimate", "suspicious", "phishing"]
_OPINIONS = [None, "agrees", "disagrees", "unavailable"]
_VOTE_SQL = f"{_pick_sql('event_id', _VOTES, 1)} AS risk_assessment, {_pick_sql('event_id', [None, 'quoted'], 3)} AS risk_evidence, {_pick_sql('event_id', [None, 'because'], 7)} AS risk_rationale, {_pick_sql('event_id', _OPINIONS, 5)} AS second_opinion"


def _votes(df):
    return df.withColumns({"risk_assessment": _pick("event_id", _VOTES, 1), "risk_evidence": _pick("event_id", [None, "quoted"], 3), "risk_rationale": _pick("event_id", [None, "because"], 7), "second_opinion": _pick("event_id", _OPINIONS, 5)})


_CONTENT_CASE = _case(
    [
        ("copy_deception", "high_copy_deception", "malicious"), ("extortion", "structured_extortion AND payment_requested", "malicious"),
        ("payment_diversion", "bank_transfer AND grounded_destination_change AND bec_or_invoice_scam", "malicious"), ("reward_impersonation", "corroborated_reward", "malicious"),
        ("workflow_hijack", "payment_workflow_hijack", "malicious"), ("security_lure", "security_lure AND deterministic_identity_deception", "malicious"),
        ("credential_submission", "(credential_submission AND risky_channel) OR credential_disclosure", "malicious"), ("bypass_request", "bypass_requested", "malicious"),
        ("deception", "deceptive AND deterministic_identity_deception AND (sensitive_request OR (settings_change AND supplied_channel))", "malicious"),
        ("grounded_vote", "risk_assessment = 'phishing' AND risk_evidence IS NOT NULL AND risk_rationale IS NOT NULL AND coalesce(second_opinion, '') <> 'disagrees'", "malicious"),
    ],
    ("reasons", "rest"), "v", "branch",
)
_REASONS = "payment_requested OR sensitive_request OR credentials_mentioned OR ((settings_change OR verification_requested OR reward_claim) AND supplied_channel) OR (urgent AND targeted) OR (pretext AND threat AND supplied_channel) OR (incentive AND urgent AND supplied_channel) OR unresolved_qr OR (risk_assessment <> 'legitimate' AND risk_evidence IS NULL)"


@query(f"WITH f AS (SELECT event_id, {_CONTENT.sql()}, {_VOTE_SQL} FROM events), c AS (SELECT *, {_CONTENT_CASE} FROM f) SELECT event_id, CASE WHEN v <> 'rest' THEN v WHEN {_REASONS} THEN 'suspicious' ELSE 'benign' END AS content_risk, branch AS content_decided_by FROM c")
def content_risk_cascade(spark, sf_dir):
    e = _votes(read(spark, sf_dir, "events").select("event_id").withColumns(_CONTENT.columns()))
    return policy.content_risk(e).select("event_id", "content_risk", "content_decided_by")


_IDENTITY = Bits("event_id", policy.IDENTITY_FLAGS)
_DECISIONS, _STATUSES, _CONFIDENCES = ["phishing", "review", "none"], ["consistent", "inconsistent", "insufficient_data"], ["high", "low"]
_IMP_SQL = f"{_pick_sql('event_id', _DECISIONS, 2)} AS impersonation_decision, {_pick_sql('event_id', _STATUSES, 3)} AS impersonation_status, {_pick_sql('event_id', _CONFIDENCES, 1)} AS impersonation_confidence"


def _impersonations(df):
    return df.withColumns({"impersonation_decision": _pick("event_id", _DECISIONS, 2), "impersonation_status": _pick("event_id", _STATUSES, 3), "impersonation_confidence": _pick("event_id", _CONFIDENCES, 1)})


_IDENTITY_CASE = _case(
    [
        ("claimed_phishing", "claimed_assessed AND impersonation_decision = 'phishing' AND impersonation_confidence = 'high'", "spoofing_evidence"),
        ("claimed_consistent_reply", "claimed_assessed AND impersonation_status = 'consistent' AND reply_mismatch", "uncertain"),
        ("claimed_consistent", "claimed_assessed AND impersonation_status = 'consistent'", "verified"), ("claimed_other", "claimed_assessed", "uncertain"),
        ("display_name", "display_name_spoofing", "spoofing_evidence"), ("double_mismatch", "risky_action AND sender_mismatch AND action_mismatch AND NOT public_reference", "spoofing_evidence"),
        ("brand_mismatch", "claimed_brand_mismatch", "spoofing_evidence"), ("public_reference", "risky_action AND public_reference AND (sender_mismatch OR action_mismatch)", "uncertain"),
        ("reply", "reply_mismatch", "uncertain"), ("forwarded", "forwarded_identity AND supplied_action", "uncertain"), ("authenticated", "authenticated OR qualified_spf", "verified"),
    ],
    ("unproved", "uncertain"), "identity_risk", "identity_decided_by",
)


@query(f"WITH f AS (SELECT event_id, {_IDENTITY.sql()}, {_IMP_SQL} FROM events) SELECT event_id, {_IDENTITY_CASE} FROM f")
def identity_risk_cascade(spark, sf_dir):
    e = _impersonations(read(spark, sf_dir, "events").select("event_id").withColumns(_IDENTITY.columns()))
    return policy.identity_risk(e).select("event_id", "identity_risk", "identity_decided_by")


#: Every flag of the technical cascade is rare here, so that all three risks occur.
_BAD, _DOUBT = policy.TECHNICAL_MALICIOUS, policy.TECHNICAL_UNCERTAIN
_EFFECTS = ["decisive", "supporting", "informational", None]


def _rare(names, offset):
    return {n: F.col("event_id") % (37 + i) == offset + i for i, n in enumerate(names)}


def _rare_sql(names, offset):
    return ", ".join(f"event_id % {37 + i} = {offset + i} AS {n}" for i, n in enumerate(names))


_LIST = lambda names: "list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"


@query(
    f"""WITH f AS (SELECT event_id, {_rare_sql(_BAD, 1)}, {_rare_sql(_DOUBT, 9)}, {_pick_sql('event_id', _EFFECTS, 11)} AS effect FROM events),
l AS (SELECT event_id, effect, {_LIST(_BAD)} AS b, {_LIST(_DOUBT)} AS d FROM f),
k AS (SELECT event_id, CASE WHEN len(b) = 0 AND effect = 'decisive' THEN ['decisive_finding'] ELSE b END AS b, CASE WHEN effect = 'supporting' THEN list_append(d, 'supporting_finding') ELSE d END AS d FROM l)
SELECT event_id, CASE WHEN len(b) > 0 THEN 'malicious' WHEN len(d) > 0 THEN 'uncertain' ELSE 'clean' END AS technical_risk, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE d END, ',') AS reasons FROM k"""
)
def technical_risk_reasons(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id").withColumns(_rare(_BAD, 1) | _rare(_DOUBT, 9) | {"technical_effect": _pick("event_id", _EFFECTS, 11)})
    return policy.technical_risk(e).select("event_id", "technical_risk", F.array_join("technical_reasons", ",").alias("reasons"))


_VERDICT = Bits("event_id", policy.VERDICT_FLAGS)
_RISKS = (["benign", "suspicious", "benign", "malicious", "benign"], ["verified", "uncertain", "spoofing_evidence"], ["clean", "uncertain", "clean", "malicious"])
_RISK_SQL = ", ".join(f"{_pick_sql('event_id', v, s)} AS {n}" for n, v, s in zip(("content_risk", "identity_risk", "technical_risk"), _RISKS, (2, 3, 7), strict=True))


def _risks(df):
    return df.withColumns({n: _pick("event_id", v, s) for n, v, s in zip(("content_risk", "identity_risk", "technical_risk"), _RISKS, (2, 3, 7), strict=True)})


_UNSURE = "(coalesce(second_opinion IN ('disagrees', 'unavailable'), false) OR risk_evidence IS NULL OR (risk_assessment = 'phishing' AND risk_rationale IS NULL))"
_VERDICT_CASE = _case(
    [
        ("malicious", "technical_risk = 'malicious' OR content_risk = 'malicious'", "phishing"), ("spoofed_action", "identity_risk = 'spoofing_evidence' AND supplied_action", "phishing"),
        ("auth_failed_spoofed", "all_auth_failed AND identity_risk = 'spoofing_evidence'", "phishing"), ("auth_failed_action", "all_auth_failed AND risky_action", "phishing"),
        ("unsupported_vote", f"risk_assessment IN ('suspicious', 'phishing') AND {_UNSURE}", "review"),
        ("payment_spf", "content_risk = 'suspicious' AND payment_requested AND risk_evidence IS NOT NULL AND spf_failed_at_sender", "phishing"),
        ("suspicious_corroborated", "content_risk = 'suspicious' AND (identity_risk = 'spoofing_evidence' OR (technical_risk = 'uncertain' AND NOT only_qr_mismatch))", "phishing"),
        ("doubt", "content_risk = 'suspicious' OR identity_risk = 'spoofing_evidence' OR (identity_risk = 'uncertain' AND supplied_action AND NOT benign_unavailable AND NOT local_only_clear) OR technical_risk = 'uncertain'", "review"),
    ],
    ("otherwise", "legitimate"), "v", "branch",
)


@query(
    f"""WITH f AS (SELECT event_id, {_VERDICT.sql()}, {_VOTE_SQL}, {_IMP_SQL}, {_RISK_SQL} FROM events), c AS (SELECT *, {_VERDICT_CASE} FROM f)
SELECT event_id, CASE WHEN v = 'legitimate' AND impersonation_decision = 'review' THEN 'review' ELSE v END AS final_verdict, CASE WHEN v = 'legitimate' AND impersonation_decision = 'review' THEN 'impersonation' ELSE branch END AS verdict_decided_by FROM c"""
)
def final_verdict_cascade(spark, sf_dir):
    e = _risks(_impersonations(_votes(read(spark, sf_dir, "events").select("event_id").withColumns(_VERDICT.columns()))))
    return policy.final_verdict(e).select("event_id", "final_verdict", "verdict_decided_by")


_TONE = ["confirmed_indicator", "high_html_attachment", "analysis_incomplete", "resource_unverified", "high_flag", "medium_flag", "first_party_notice", "informational_only", "dkim_missing_only", "any_mismatch"]
_TONE_BITS = Bits("event_id", _TONE)
_FINAL = ["phishing", "review", "legitimate", "legitimate", None]


@query(
    f"""WITH f AS (SELECT event_id, {_TONE_BITS.sql()}, {_pick_sql('event_id', _FINAL, 13)} AS final_verdict, {_pick_sql('event_id', ['benign', 'benign', 'suspicious', 'benign', 'malicious'], 17)} AS content_risk FROM events)
SELECT event_id, {_case([
        ("confirmed", "confirmed_indicator OR high_html_attachment OR high_flag", "danger"), ("phishing", "coalesce(final_verdict, '') = 'phishing' OR content_risk = 'malicious'", "danger"), ("incomplete", "analysis_incomplete", "review"),
        ("unverified", "resource_unverified", "review"), ("suspicious", "content_risk = 'suspicious'", "review"), ("first_party", "first_party_notice", "safe"), ("informational", "informational_only AND dkim_missing_only AND NOT any_mismatch", "safe"),
        ("review", "coalesce(final_verdict, '') = 'review' OR medium_flag", "review"), ("legitimate", "final_verdict = 'legitimate'", "safe")], ("otherwise", "review"), "tone", "tone_decided_by")} FROM f"""
)
def tone_cascade(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id").withColumns(_TONE_BITS.columns() | {"final_verdict": _pick("event_id", _FINAL, 13), "content_risk": _pick("event_id", ["benign", "benign", "suspicious", "benign", "malicious"], 17)})
    return policy.tone(e).select("event_id", "tone", "tone_decided_by")


_CLEAR = Bits("event_id", [f"b{i}" for i in range(len(policy.CLEARANCE_BARS))])


@query(
    f"""WITH f AS (SELECT event_id, event_id % 4 > 0 AS local_only, event_id % 3 > 0 AS links_own, event_id % 5 > 0 AS attachments_clean, {_pick_sql('event_id', ['pass', 'pass', 'fail'], 2)} AS dmarc, {_pick_sql('event_id', ['pass', None, 'softfail'], 9)} AS spf,
  event_id % 10 / 10 AS confidence, event_id % 50 IN ({", ".join(str(i) for i in range(len(policy.CLEARANCE_BARS)))}) AS barred FROM events)
SELECT event_id, local_only AND links_own AND attachments_clean AND dmarc = 'pass' AND coalesce(spf, '') <> 'softfail' AND confidence >= 0.8 AND NOT barred AS local_only_clear FROM f"""
)
def local_clearance_rule(spark, sf_dir):
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id").withColumns({b: k % 50 == i for i, b in enumerate(policy.CLEARANCE_BARS)})
    e = e.withColumns(
        {
            "local_only": k % 4 > 0, "links_own": k % 3 > 0, "attachments_clean": k % 5 > 0, "dmarc_direct": F.lit(True), "dmarc": _pick("event_id", ["pass", "pass", "fail"], 2), "spf": _pick("event_id", ["pass", None, "softfail"], 9),
            "confidence": k % 10 / 10, "content_risk": F.lit("benign"), "technical_risk": F.lit("clean"), "risk_assessment": F.lit("legitimate"), "risk_rationale": F.lit("r"), "requested_action": F.lit("visit_link"),
        }
    )
    return policy.local_clearance(e).select("event_id", "local_only_clear")


@query(
    f"""WITH f AS (SELECT event_id, {_pick_sql('event_id', ['phishing', 'review', 'legitimate'], 1)} AS v, {_pick_sql('event_id', _RISKS[1], 3)} AS i, {_pick_sql('event_id', ['clean', 'uncertain', 'malicious'], 9)} AS t, ['who ' || event_id % 3, 'sender authentication passed'] AS w, ['what ' || event_id % 2, 'what 0', 'more'] AS x FROM events),
c AS (SELECT event_id, v IN ('phishing', 'review') AS threat, i = 'verified' AS proved, t = 'clean' AS clean, w, CASE WHEN event_id % 2 = 0 THEN ['what 0', 'more'] ELSE x END AS x FROM f)
SELECT event_id, CASE WHEN threat THEN array_to_string(CASE WHEN proved THEN [] ELSE w END || CASE WHEN clean THEN [] ELSE x END, '|') ELSE array_to_string(CASE WHEN proved THEN ['sender authentication passed'] ELSE [] END || CASE WHEN clean THEN x ELSE [] END, '|') END AS details_all,
  CASE WHEN threat THEN array_to_string(CASE WHEN proved THEN ['sender authentication passed'] ELSE [] END || CASE WHEN clean THEN x ELSE [] END, '|') ELSE array_to_string(CASE WHEN proved THEN w[1:1] ELSE w END || CASE WHEN clean THEN [] ELSE x END, '|') END AS caveats_all FROM c"""
)
def corroboration_lists(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("who "), (F.col("event_id") % 3).cast("string")).alias("who"), F.concat(F.lit("what "), (F.col("event_id") % 2).cast("string")).alias("what"))
    c = policy.corroboration(_pick("event_id", ["phishing", "review", "legitimate"], 1), _pick("event_id", _RISKS[1], 3), F.array("who", F.lit("sender authentication passed")), _pick("event_id", ["clean", "uncertain", "malicious"], 9), F.array("what", F.lit("what 0"), F.lit("more")), 9)
    return e.withColumn("c", c).select("event_id", F.array_join("c.details", "|").alias("details_all"), F.array_join("c.caveats", "|").alias("caveats_all"))


_SCAMS, _THREATS = [None, "none", "other", "extortion", "sextortion", "odd"], ["none", "other", "data_exposure", "reputation_harm", "private_material_exposure", None]


def _rank_sql(column, ranks):
    return f"CASE coalesce({column}, 'none') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 1 END"


@query(
    f"""WITH f AS (SELECT event_id, {_pick_sql('event_id', _SCAMS, 1)} AS s1, {_pick_sql('event_id', _SCAMS, 7)} AS s2, {_pick_sql('event_id', _THREATS, 2)} AS t1, {_pick_sql('event_id', _THREATS, 5)} AS t2, {_pick_sql('event_id', ['btc', '', None], 3)} AS a1, {_pick_sql('event_id', ['', 'eur', None], 4)} AS a2 FROM events)
SELECT event_id, coalesce(nullif(a2, ''), nullif(a1, '')) AS payment_asset, CASE WHEN {_rank_sql('s1', policy.SCAM_RANK)} > {_rank_sql('s2', policy.SCAM_RANK)} THEN s1 ELSE s2 END AS scam_type, CASE WHEN {_rank_sql('t1', policy.THREAT_RANK)} > {_rank_sql('t2', policy.THREAT_RANK)} THEN t1 ELSE t2 END AS threat_type FROM f"""
)
def verifier_merge_specificity(spark, sf_dir):
    side = lambda a, s, t: F.struct(a.alias("payment_asset"), F.lit("").alias("amount"), s.alias("scam_type"), t.alias("threat_type"))
    first = side(_pick("event_id", ["btc", "", None], 3), _pick("event_id", _SCAMS, 1), _pick("event_id", _THREATS, 2))
    second = side(_pick("event_id", ["", "eur", None], 4), _pick("event_id", _SCAMS, 7), _pick("event_id", _THREATS, 5))
    e = read(spark, sf_dir, "events").select("event_id", first.alias("a"), second.alias("b"))
    return e.withColumn("m", policy.verifier_merge(F.col("a"), F.col("b"))).select("event_id", "m.payment_asset", "m.scam_type", "m.threat_type")


# --- rules on envelopes, links, money

_ROUTE = Bits("o_orderkey", ["embedded", "authenticated", "is_bulk_sender", "same_registered", "sharing_service", "authentication_failed"])


@query(
    f"""WITH f AS (SELECT o_orderkey, {_ROUTE.sql()}, o_orderkey % 3 AS replies, 1 + CAST(o_custkey % 7 = 0 AS INTEGER) AS senders, o_custkey % 5 = 0 AS same FROM orders)
SELECT o_orderkey, {_case([
        ("embedded", "embedded", "NONE"), ("no_reply", "replies = 0 OR (senders = 1 AND replies = 1 AND same)", "NONE"), ("ambiguous", "senders <> 1 OR replies <> 1", "HIGH"), ("bulk", "authenticated AND is_bulk_sender AND same_registered", "INFO"),
        ("sharing_proved", "sharing_service AND authenticated", "INFO"), ("sharing", "sharing_service AND NOT authentication_failed", "MEDIUM")], ("other", "HIGH"), "reply_level", "reply_decided_by")} FROM f"""
)
def reply_routing_levels(spark, sf_dir):
    k = F.col("o_orderkey")
    own, other = F.lit("a@x.example"), F.lit("b@y.example")
    reply = F.when(F.col("o_custkey") % 5 == 0, own).otherwise(other)
    o = read(spark, sf_dir, "orders").select("o_orderkey", (1 + (F.col("o_custkey") % 7 == 0).cast("int")).alias("from_count"), own.alias("from_address"), reply.alias("reply_address"), F.when(k % 3 == 0, "").when(k % 3 == 1, reply).otherwise(F.concat(reply, F.lit(", c@z.example"))).alias("reply_to"))
    return envelope.reply_routing(o.withColumns(_ROUTE.columns())).select("o_orderkey", "reply_level", "reply_decided_by")


_SUBJECTS = ["Re: offer", "AW[2]: offer", "offer", "[list] Fwd: offer", "Regarding: offer"]


@query(
    f"""WITH f AS (SELECT o_orderkey, {_pick_sql('o_orderkey', [True, True, False, True, False], 1).replace("'True'", 'true').replace("'False'", 'false')} AS reply, o_custkey % 3 = 0 AS threaded, o_custkey % 4 AS mine, o_custkey % 5 AS others, o_custkey % 11 = 0 AS bulk FROM orders)
SELECT o_orderkey, CASE WHEN NOT reply OR threaded THEN 'NONE' WHEN mine > 0 THEN 'HIGH' WHEN others > 0 THEN 'MEDIUM' WHEN bulk THEN 'LOW' ELSE 'MEDIUM' END AS threading_level FROM f"""
)
def reply_threading_levels(spark, sf_dir):
    c = F.col("o_custkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", _pick("o_orderkey", _SUBJECTS, 1).alias("subject"), F.when(c % 3 == 0, "<1@x>").alias("in_reply_to"), F.lit(None).cast("string").alias("references"), (c % 4).alias("quoted_recipient"), (c % 5).alias("quoted_other"), (c % 11 == 0).alias("is_bulk_sender"))
    return envelope.reply_threading(o).select("o_orderkey", "threading_level")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 5 <> 0 THEN 'HIGH' WHEN l_suppkey % 3 = 0 OR l_partkey % 5 <> 0 THEN 'MEDIUM' END END AS mask_level,
  CASE WHEN l_suppkey % 4 = 0 THEN 'MEDIUM' WHEN l_suppkey % 4 = 1 THEN CASE WHEN l_returnflag = 'R' THEN 'MEDIUM' ELSE 'INFO' END END AS hosting_level FROM lineitem"""
)
def masked_and_hosted_links(spark, sf_dir):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").withColumns({"display_mismatch": p % 2 == 0, "protected": s % 3 == 0, "tracker": p % 5 == 0, "kind": F.when(s % 4 == 0, "ipfs").when(s % 4 == 1, "shortener"), "cta": F.col("l_returnflag") == "R"})
    return envelope.masked_links(rows).select("l_orderkey", "l_linenumber", "mask_level", envelope.hosting_level(F.col("kind"), F.col("cta")).alias("hosting_level"))


@query(
    """WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS files, count(*) FILTER (l_returnflag = 'R') AS away, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 3 > 0 AND files = 0 AND away > 0 THEN CASE WHEN bad > 0 THEN 'HIGH' ELSE 'MEDIUM' END END AS invoice_level FROM f"""
)
def invoice_delivery_levels(spark, sf_dir):
    r = F.col("l_returnflag")
    m = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(r == "A").alias("usable_attachments"), F.count_if(r == "R").alias("foreign_links"), F.count_if((r == "R") & (F.col("l_quantity") > 40)).alias("dangerous_links"))
    return envelope.invoice_delivery(m.withColumn("financial_claim", F.col("l_orderkey") % 3 > 0)).select("l_orderkey", "invoice_level")


_IBANS = ["DE89", "FR14", "IT60", "ES91"]


@query(
    f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE [{_pick_sql('o_orderkey', _IBANS, 1)}] END AS body, CASE WHEN o_custkey % 4 = 0 THEN [{_pick_sql('o_custkey', _IBANS, 2)}] ELSE [] END AS quoted, o_custkey % 3 = 0 AS changed, {_pick_sql('o_orderkey', ['DE', 'IT', ''], 5)} AS country FROM orders),
k AS (SELECT o_orderkey, len(body) > 0 AS named, len(quoted) > 0 AND NOT list_has_all(quoted, body) AS other, changed, len(list_filter(body, lambda i: country <> '' AND left(i, 2) <> country)) > 0 AS away FROM f)
SELECT o_orderkey, CASE WHEN named THEN CASE WHEN other THEN 'HIGH' WHEN changed THEN CASE WHEN away THEN 'HIGH' ELSE 'MEDIUM' END WHEN away THEN 'LOW' END END AS payment_level FROM k"""
)
def payment_detail_levels(spark, sf_dir):
    none = F.array().cast("array<string>")
    o = read(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderkey") % 6 == 0, none).otherwise(F.array(_pick("o_orderkey", _IBANS, 1)))
    quoted = F.when(F.col("o_custkey") % 4 == 0, F.array(_pick("o_custkey", _IBANS, 2))).otherwise(none)
    o = o.select("o_orderkey", body.alias("b"), quoted.alias("q"), none.alias("a"), (F.col("o_custkey") % 3 == 0).alias("c"), _pick("o_orderkey", ["DE", "IT", ""], 5).alias("country"))
    return o.select("o_orderkey", payments.payment_level(F.col("b"), F.col("q"), F.col("a"), F.col("c"), F.col("country")).alias("payment_level"))


@query(
    """WITH m AS (SELECT user_id AS sender, CAST(floor(value) AS BIGINT) % 9 AS digest, event_id AS msg_id, CAST(ts AS DATE) AS day FROM events), u AS (SELECT * FROM m WHERE day >= DATE '2024-01-20'), k AS (SELECT * FROM m WHERE day < DATE '2024-01-20'),
o AS (SELECT u.sender, u.digest, u.msg_id, bool_or(k.digest = u.digest) AS known FROM u JOIN k ON k.sender = u.sender AND k.msg_id <> u.msg_id GROUP BY ALL)
SELECT sender, digest, msg_id, CASE WHEN digest % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM o WHERE NOT known"""
)
def remembered_accounts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("sender"), (F.col("value").cast("bigint") % 9).alias("digest"), F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("seen_at"))
    uses = e.where("seen_at >= '2024-01-20'").select("sender", "digest", "msg_id", (F.col("digest") % 2 == 0).alias("change_phrase"))
    return payments.remembered(uses, e.where("seen_at < '2024-01-20'"), F.to_timestamp(F.lit("2024-02-01"))).select("sender", "digest", "msg_id", "level")


@query(
    """WITH c AS (SELECT l_orderkey, l_suppkey, bool_or(l_returnflag = 'R') AS cta, min(l_linenumber) AS first FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY l_orderkey, l_suppkey),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cta DESC, first, l_suppkey) AS rn FROM c), a AS (SELECT l_orderkey, l_suppkey, l_suppkey % 40 AS age, l_orderkey % 4 = 0 AS bulk FROM k WHERE rn <= 5)
SELECT l_orderkey, l_suppkey, CAST(age AS DOUBLE) AS age_days, CASE WHEN age < 7 THEN CASE WHEN bulk THEN 'MEDIUM' ELSE 'HIGH' END ELSE 'MEDIUM' END AS level FROM a WHERE age < 30"""
)
def domain_age_levels(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-02-01"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_id"), F.col("l_suppkey").alias("registered_domain"), F.col("l_linenumber").alias("link_index"), (F.col("l_returnflag") == "R").alias("cta"), (F.col("l_orderkey") % 4 == 0).alias("is_bulk_sender"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("registered_domain"))
    known = s.withColumn("registered_at", F.timestamp_add("DAY", -(F.col("registered_domain") % 40).cast("int"), now))
    out = envelope.domain_age(li, known, now, s.where("registered_domain % 7 = 0"))
    return out.select(F.col("msg_id").alias("l_orderkey"), F.col("registered_domain").alias("l_suppkey"), "age_days", "level")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 AND o_orderkey % 3 > 0 AND o_custkey % 5 > 0 THEN 'MEDIUM' WHEN o_custkey % 4 > 0 THEN 'INFO' WHEN o_orderkey % 3 > 0 AND o_custkey % 5 > 0 THEN 'LOW' END AS level FROM orders")
def calendar_levels(spark, sf_dir):
    organiser = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_custkey") % 5 == 0, "own.example").otherwise("other.example")
    return read(spark, sf_dir, "orders").select("o_orderkey", attachments.calendar_level(F.col("o_custkey") % 4, organiser, F.array(F.lit("own.example"))).alias("level"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') >= 0 AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 90 AS recent FROM orders")
def recent_registrations(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", identity.recently_registered(F.col("o_orderdate"), F.to_date(F.lit("1998-08-02"))).alias("recent"))


_SCANS = ["critical", "low", "clean", "medium", "unknown", None]


@query(
    f"""WITH f AS (SELECT o_orderkey, [{_pick_sql('o_orderkey', _SCANS, 1)}, {_pick_sql('o_custkey', ['high', 'suspicious', None, 'clean'], 1)}] AS s FROM orders)
SELECT o_orderkey, CASE {" ".join(f"WHEN list_contains(s, '{r}') THEN '{r}'" for r in siem.ATTACHMENT_RISKS)} END AS risk FROM f"""
)
def attachment_risk_first(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", siem.attachment_risk(_pick("o_orderkey", _SCANS, 1), _pick("o_custkey", ["high", "suspicious", None, "clean"], 1)).alias("risk"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 15 THEN 'MEDIUM' ELSE 'INFO' END AS level, CASE l_returnflag WHEN 'R' THEN 'PDF Attachment' WHEN 'A' THEN 'Attachment' ELSE 'Link' END AS field FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE level WHEN 'HIGH' THEN 100 ELSE 0 END + CASE field WHEN 'PDF Attachment' THEN 20 WHEN 'Attachment' THEN 10 ELSE 0 END DESC, l_linenumber, l_partkey) AS r FROM f WHERE level <> 'INFO'),
x AS (SELECT o_orderkey AS k, 0 AS g, 1 AS p, 'HIGH' AS level, 'indicator' AS message FROM orders WHERE o_custkey % 9 = 0
  UNION ALL SELECT l_orderkey, 1, r, level, field || ' · ' || l_partkey % 5 FROM b WHERE r <= 3
  UNION ALL SELECT o_orderkey, 2, i, 'CHECK', 'check ' || i FROM orders, range(1, 5) t(i) WHERE o_custkey % 2 = 0),
o AS (SELECT k, message, min(struct_pack(g := g, p := p, level := level)) AS f FROM x GROUP BY k, message), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f.g, f.p) AS rank FROM o)
SELECT k AS msg_id, rank, f.level AS level, message FROM n WHERE rank <= 6"""
)
def evidence_first(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    level = F.when(F.col("l_quantity") > 40, "HIGH").when(F.col("l_quantity") > 15, "MEDIUM").otherwise("INFO")
    name = F.when(F.col("l_returnflag") == "R", "PDF Attachment").when(F.col("l_returnflag") == "A", "Attachment").otherwise("Link")
    found = li.select(F.col("l_orderkey").alias("msg_id"), F.struct("l_linenumber", "l_partkey").alias("finding_index"), level.alias("level"), name.alias("field"), (F.col("l_partkey") % 5).cast("string").alias("message"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), "o_custkey")
    sure = o.where("o_custkey % 9 = 0").select("msg_id", F.lit(1).alias("position"), F.lit("indicator").alias("message"))
    checks = o.where("o_custkey % 2 = 0").select("msg_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("position")).withColumn("message", F.concat(F.lit("check "), F.col("position").cast("string")))
    return siem.evidence_order(found, sure, checks).select("msg_id", F.col("rank").cast("bigint").alias("rank"), "level", "message")


# --- joins and aggregates

@query(
    """WITH s AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), t AS (SELECT l_orderkey, l_partkey, count(*) + 1 AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT coalesce(s.l_orderkey, t.l_orderkey) AS att_id, coalesce(s.l_partkey, t.l_partkey) AS key, coalesce(t.n, s.n) AS count FROM s FULL JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_partkey = t.l_partkey"""
)
def scan_counts_merged(spark, sf_dir):
    by = lambda df, n: df.groupBy(F.col("l_orderkey").alias("att_id"), F.col("l_partkey").alias("key")).agg((F.count("*") + n).alias("count"))
    li = read(spark, sf_dir, "lineitem")
    return pdf.merged_counts(by(li.where("l_returnflag <> 'N'"), 0), by(li.where("l_linestatus = 'O'"), 1))


@query("SELECT user_id AS msg_id, count(*) AS calls, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 100 END) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def model_calls_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("msg_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 100).alias("tokens"), F.lit(0.0).alias("seconds"))
    return evaluation.performance_summary(e).select("msg_id", "calls", "tokens")


@query("SELECT median(value) AS median_seconds, count(*) AS timed FROM events WHERE value > 0")
def prediction_latency(spark, sf_dir):
    return evaluation.latency(read(spark, sf_dir, "events").select(F.col("value").alias("seconds")))


@query(
    """WITH w AS (SELECT doc_id, 'f' || doc_id % 3 AS field, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS want, CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS got, doc_id % 6 = 0 AS missing FROM documents)
SELECT field, count(*) FILTER (want IS NOT DISTINCT FROM CASE WHEN missing THEN NULL ELSE got END) AS correct, count(*) AS total FROM w GROUP BY field"""
)
def semantic_fields_correct(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("field"), "lang")
    want = d.select("id", "field", F.when(F.col("id") % 5 != 0, F.col("lang")).alias("value"))
    got = d.where("id % 6 <> 0").select("id", "field", F.when(F.col("id") % 4 == 0, "xx").when(F.col("id") % 10 != 0, F.col("lang")).alias("value"))
    return evaluation.field_correctness(want, got).select("field", "correct", "total")


@query("SELECT CAST(count(*) AS BIGINT) AS quoted, count(*) FILTER (doc_id % 3 > 0) AS grounded FROM documents WHERE trim(substr(text, 11, 60)) <> ''")
def grounded_quotations(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 3 > 0, F.substring("text", 11, 60)).otherwise(F.concat(F.substring("text", 11, 60), F.lit("@never@")))
    q = d.select(F.when(F.trim(F.substring("text", 11, 60)) != "", quote).alias("quotation"), "text")
    return evaluation.grounded_rate(q).select("quoted", "grounded")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'malicious' WHEN l_discount > 0.08 THEN 'suspicious' WHEN l_suppkey % 5 > 0 THEN 'clean' ELSE 'unknown' END AS status FROM lineitem")
def engine_verdicts(spark, sf_dir):
    one = hosts.engine_status((F.col("l_quantity") > 45).cast("int"), (F.col("l_discount") > 0.08).cast("int"), F.col("l_suppkey") % 5)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", one.alias("status"))


_ROUTE_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


@query(f"WITH r AS ({_ROUTE_SQL}) SELECT l_orderkey AS msg_id, max(l_suppkey) FILTER (i = 0) AS nearest, max(l_suppkey) FILTER (i = 1) AS injection, max(l_suppkey) FILTER (i = n - 1) AS sender FROM r GROUP BY l_orderkey")
def route_ends(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("msg_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "msg_id").withColumn("header_index", F.row_number().over(w) - 1)
    return auth.route_ends(li, "l_suppkey")


@query(
    """WITH s AS (SELECT s_suppkey AS ip, CASE s_nationkey % 4 WHEN 0 THEN 'malicious' WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' END AS status FROM supplier WHERE s_suppkey % 3 > 0)
SELECT l_orderkey AS msg_id, count(DISTINCT l_suppkey) AS ips, count(DISTINCT CASE WHEN status = 'malicious' THEN l_suppkey END) AS malicious, count(DISTINCT CASE WHEN status IS NULL THEN l_suppkey END) AS unknown FROM lineitem LEFT JOIN s ON ip = l_suppkey GROUP BY l_orderkey"""
)
def hop_reputation_counts(spark, sf_dir):
    route = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("msg_id"), F.col("l_returnflag").alias("route_index")).agg(F.collect_set("l_suppkey").alias("all_ips"))
    status = F.when(F.col("s_nationkey") % 4 == 0, "malicious").when(F.col("s_nationkey") % 4 == 1, "clean").when(F.col("s_nationkey") % 4 == 2, "suspicious")
    snapshot = read(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("ip"), status.alias("status"), F.lit(1).alias("observed_at"))
    r = hosts.hop_reputation(route, snapshot).select("msg_id", "ip", "status").distinct()
    return r.groupBy("msg_id").agg(F.count("*").alias("ips"), F.count_if(F.col("status") == "malicious").alias("malicious"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query(
    """WITH l AS (SELECT event_id, user_id, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, event_type FROM events)
SELECT event_type AS kind, user_id AS key FROM l WHERE rn = 1 AND event_type IN ('view', 'click') AND ts + CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN INTERVAL 3600 SECOND ELSE INTERVAL 120 SECOND END ELSE CASE WHEN event_id % 2 = 0 THEN INTERVAL 86400 SECOND ELSE INTERVAL 300 SECOND END END > TIMESTAMP '2024-01-30 12:00:00'"""
)
def fresh_observations(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    kind = F.when(F.col("event_type") == "view", "dns").otherwise("rdap")
    o = e.select(kind.alias("kind"), F.col("user_id").alias("key"), (F.col("event_id") % 2 == 0).alias("found"), F.col("ts").cast("timestamp").alias("observed_at"), "event_type", "event_id")
    kept = identity.fresh(o, F.to_timestamp(F.lit("2024-01-30 12:00:00")))
    return kept.select(F.col("event_type").alias("kind"), "key")


@query(
    """WITH b AS (SELECT user_id, list_distinct(list(event_type)) AS known FROM events WHERE event_id % 3 = 0 GROUP BY user_id), c AS (SELECT user_id, list_distinct(list(event_type || CASE WHEN event_id % 50 = 1 THEN '!' ELSE '' END)) AS now FROM events WHERE event_id % 3 = 1 GROUP BY user_id)
SELECT c.user_id AS msg_id, CAST(len(list_filter(now, lambda x: NOT list_contains(known, x))) AS BIGINT) AS news FROM c JOIN b ON b.user_id = c.user_id WHERE len(list_filter(now, lambda x: NOT list_contains(known, x))) > 0"""
)
def baseline_news(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    at = F.to_timestamp(F.lit("2024-01-30"))
    old = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("partner")).agg(F.collect_set("event_type").alias("action_domains")).withColumns({"sender": F.lit("s"), "reply_domains": F.array().cast("array<string>"), "written_at": at})
    now = e.where("event_id % 3 = 1").groupBy(F.col("user_id").alias("partner")).agg(F.collect_set(F.concat("event_type", F.when(F.col("event_id") % 50 == 1, "!").otherwise(""))).alias("action_domains"))
    now = now.withColumns({"sender": F.lit("s"), "reply_domains": F.array().cast("array<string>"), "msg_id": F.col("partner")})
    out = registry.baseline_anomalies(now, old, at)
    return out.select("msg_id", F.size("new_action_domains").cast("bigint").alias("news"))


@query(
    """WITH c AS (SELECT o_custkey AS record_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P'), last AS (SELECT * FROM c WHERE rn = 1)
SELECT c_custkey AS record_id, c_name AS brand FROM customer WHERE c_custkey NOT IN (SELECT record_id FROM last) UNION ALL SELECT record_id, 'order ' || o_orderkey FROM last WHERE o_orderstatus = 'F'"""
)
def registry_changes(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("brand"))
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    changes = o.select(F.col("o_custkey").alias("record_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("brand"), F.when(F.col("o_orderstatus") == "F", "add").otherwise("remove").alias("op"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return registry.merged(base, changes)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 100 <= 10 THEN 'stale_sequence' WHEN o_orderkey % 5 = 0 THEN 'bad_interval' WHEN o_custkey % 4 = 0 THEN 'unknown_role' WHEN o_custkey % 3 = 0 THEN 'bad_domain' END AS reject_reason FROM orders"""
)
def import_checks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rel = F.array(F.struct(F.when(c % 4 == 0, "owner").otherwise("official").alias("role"), F.when(c % 3 == 0, "-bad-.example").otherwise("shop.example").alias("domain")))
    at = F.to_timestamp(F.lit("2024-01-01"))
    d = read(spark, sf_dir, "orders").select("o_orderkey", (k % 100).alias("sequence"), at.alias("verified_at"), F.when(k % 5 == 0, at).otherwise(F.to_timestamp(F.lit("2025-01-01"))).alias("expires_at"), rel.alias("relations"))
    return registry.checked_import(d, 10).select("o_orderkey", "reject_reason")


_SIGNALS = list(dims.IMPERSONATION_WEIGHTS)


@query(
    f"""WITH s AS (SELECT l_orderkey, {_pick_sql('l_partkey', _SIGNALS, 1)} AS signal, l_orderkey % 2 = 0 AS rep, l_suppkey % 3 > 0 AS off FROM lineitem), w AS (SELECT * FROM {dims.sql_values([(k, w, f) for k, (w, f) in dims.IMPERSONATION_WEIGHTS.items()], "v", "signal, weight, family")}),
f AS (SELECT l_orderkey, family, max(weight) AS hi, min(weight) AS lo, bool_or(rep) AS rep, bool_or(off) AS off, bool_or(s.signal = 'sender_domain_mismatch') AS mis, bool_or(s.signal IN ('sensitive_external_action', 'action_lookalike')) AS dest, bool_or(s.signal = 'authenticated_documented_sender') AS auth FROM s JOIN w ON s.signal = w.signal GROUP BY l_orderkey, family),
m AS (SELECT l_orderkey, CAST(greatest(0, least(100, sum(CASE WHEN hi > 0 THEN hi ELSE lo END))) AS INTEGER) AS score, count(*) FILTER (hi >= 25) AS strong, bool_or(hi >= 25 AND family = 'action_destination') AS act, bool_or(rep) AS rep, bool_or(off) AS off, bool_or(hi > 0) AS pos, bool_or(mis) AS mis, bool_or(dest) AS dest, bool_or(auth) AS auth FROM f GROUP BY l_orderkey)
SELECT l_orderkey AS msg_id, score, rep AND off AND (strong >= 2 OR act) AS escalated, CASE WHEN strong > 0 OR mis OR dest THEN 'inconsistent' WHEN auth THEN 'consistent' ELSE 'insufficient_data' END AS status, CASE WHEN rep AND off AND (strong >= 2 OR act) THEN 'phishing' WHEN pos THEN 'review' ELSE 'none' END AS decision FROM m"""
)
def impersonation_scores(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_id"), _pick("l_partkey", _SIGNALS, 1).alias("signal"), (F.col("l_orderkey") % 2 == 0).alias("represented"), (F.col("l_suppkey") % 3 > 0).alias("official_known"))
    return policy.impersonation(s)


_ACTIONS = list(dims.ACTION_PRIORITY)


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {_pick_sql('l_partkey', _ACTIONS, 1)} AS action, CASE WHEN l_suppkey % 3 > 0 THEN 'q' END AS ev, l_suppkey % 2 = 0 AS ch, (l_partkey % 11) / 10 AS conf, l_suppkey % 7 = 0 AS vague, {_pick_sql('l_suppkey', _VOTES, 1)} AS vote FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, ev, action) - 1 AS section FROM s),
w AS (SELECT *, CASE action {" ".join(f"WHEN '{a}' THEN {v}" for a, v in dims.ACTION_PRIORITY.items())} END + CASE WHEN ev IS NOT NULL THEN 8 WHEN action NOT IN ('none', 'informational') THEN -120 ELSE 0 END + CASE WHEN ch THEN 3 ELSE 0 END + CAST(round_even(10 * conf, 0) AS INTEGER) - CASE WHEN vague THEN 10 ELSE 0 END AS score,
  CASE vote WHEN 'phishing' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END AS risk FROM k)
SELECT l_orderkey AS msg_id, arg_max(action, struct_pack(a := score, b := -section)) AS requested_action, arg_max(vote, struct_pack(a := risk, b := -section)) AS risk_assessment, count(*) AS sections FROM w GROUP BY l_orderkey"""
)
def sections_merged(spark, sf_dir):
    from pyspark.sql import Window

    p, s = F.col("l_partkey"), F.col("l_suppkey")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_id"), "l_linenumber", "l_partkey", _pick("l_partkey", _ACTIONS, 1).alias("requested_action"), F.when(s % 3 > 0, "q").alias("evidence"), (s % 2 == 0).alias("supplied_channel"), ((p % 11) / 10).alias("confidence"), F.when(s % 7 == 0, "high").otherwise("low").alias("ambiguity"), _pick("l_suppkey", _VOTES, 1).alias("risk_assessment"))
    w = Window.partitionBy("msg_id").orderBy("l_linenumber", "l_partkey", F.asc_nulls_last("evidence"), "requested_action")
    li = li.withColumns({"section": F.row_number().over(w) - 1, "action_channel": F.lit("none"), "risk_evidence": F.lit(None).cast("string"), "risk_rationale": F.lit(None).cast("string"), "signals": F.array().cast("array<string>"), "urgent": F.lit(False), "deceptive": F.lit(False)})
    return policy.merged_sections(li).select("msg_id", "requested_action", "risk_assessment", "sections")


@query(
    """WITH f AS (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS r, 'field ' || l_returnflag AS field FROM lineitem), t AS (SELECT l_orderkey, max(r) AS r FROM f GROUP BY l_orderkey)
SELECT t.l_orderkey AS msg_id, CASE t.r WHEN 2 THEN 'decisive' WHEN 1 THEN 'supporting' ELSE 'informational' END AS effect, string_agg(DISTINCT f.field, '|' ORDER BY f.field) AS labels FROM t JOIN f ON f.l_orderkey = t.l_orderkey AND f.r = t.r GROUP BY t.l_orderkey, t.r"""
)
def technical_effects(spark, sf_dir):
    q = F.col("l_quantity")
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_id"), F.when(q > 45, "decisive").when(q > 20, "supporting").otherwise("informational").alias("effect"), F.concat(F.lit("field "), F.col("l_returnflag")).alias("field"))
    return policy.technical_effect(s).select("msg_id", "effect", F.array_join("labels", "|").alias("labels"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey WHERE length(p_name) >= 4), o AS (SELECT l_orderkey, lower(t) AS k, min(struct_pack(i := l_linenumber, t := t)) AS f FROM l GROUP BY l_orderkey, lower(t)),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY f) AS r FROM o) SELECT l_orderkey AS msg_id, string_agg(f.t, '|' ORDER BY r) AS labels FROM n WHERE r <= 8 GROUP BY l_orderkey"""
)
def link_labels(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("msg_id"), F.col("l_linenumber").alias("link_index"), F.col("p_name").alias("text"))
    return actions.labels(li).select("msg_id", F.array_join("labels", "|").alias("labels"))


_CORRELATED = ["has_links", "has_attachments", "qr_requested", "implicit_bank_instruction", "copy_deception", *actions.PATTERNS]
_COR = Bits("event_id", _CORRELATED)
_STEPS = [
    ("qr", "qr_requested AND {a} IN ('none', 'informational')", "visit_link"), ("implicit_bank", "implicit_bank_instruction", "pay_or_transfer"), ("copy_deception", "copy_deception AND {a} IN ('none', 'informational', 'visit_link', 'open_attachment')", "other"),
    ("reward", "reward AND has_links AND {a} IN ('none', 'informational', 'visit_link')", "claim_reward"), ("payment", "payment_request AND (bank_details OR payment)", "pay_or_transfer"), ("credential", "credentials AND supplied_channel", "provide_credentials"),
    ("unsupported_payment", "{a} = 'pay_or_transfer' AND NOT payment AND NOT bank_details AND NOT implicit_bank_instruction", "informational"), ("unsupported_credentials", "{a} = 'provide_credentials' AND NOT credentials", "informational"),
    ("unsupported_information", "{a} = 'provide_information' AND NOT information_request AND NOT qr_requested", "informational"),
    ("link_fallback", "{a} IN ('none', 'informational') AND visit_link AND has_links", "visit_link"), ("attachment_fallback", "{a} IN ('none', 'informational') AND open_attachment AND has_attachments", "open_attachment"),
    ("link_for_attachment", "{a} = 'open_attachment' AND NOT has_attachments AND has_links", "visit_link"), ("no_attachment", "{a} = 'open_attachment' AND NOT has_attachments", "informational"), ("no_link", "{a} = 'visit_link' AND NOT has_links AND NOT qr_requested", "informational"),
    ("ungrounded", "{a} NOT IN ('none', 'informational') AND evidence IS NULL AND NOT payment AND NOT credentials AND NOT visit_link AND NOT open_attachment AND NOT qr_requested AND NOT copy_deception AND NOT implicit_bank_instruction AND NOT reward", "informational"),
]


def _steps_sql() -> str:
    out = f"WITH s0 AS (SELECT event_id, {_COR.sql()}, {_pick_sql('event_id', _ACTIONS, 1)} AS a0, CASE WHEN event_id % 2 = 0 THEN 'q' END AS evidence, event_id % 3 = 0 AS supplied_channel, [] :: VARCHAR[] AS o0 FROM events)"
    for i, (name, cond, action) in enumerate(_STEPS):
        c = f"({cond.format(a=f'a{i}')}) AND a{i} <> '{action}'"
        out += f", s{i + 1} AS (SELECT *, CASE WHEN {c} THEN '{action}' ELSE a{i} END AS a{i + 1}, CASE WHEN {c} THEN list_append(o{i}, '{name}') ELSE o{i} END AS o{i + 1} FROM s{i})"
    return out + f" SELECT event_id, a{len(_STEPS)} AS requested_action, array_to_string(o{len(_STEPS)}, '|') AS overrides FROM s{len(_STEPS)}"


@query(_steps_sql())
def semantic_correlation(spark, sf_dir):
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id").withColumns(_COR.columns() | {"requested_action": _pick("event_id", _ACTIONS, 1), "evidence": F.when(k % 2 == 0, "q"), "supplied_channel": k % 3 == 0})
    return actions.correlated(e).select("event_id", "requested_action", F.array_join("overrides", "|").alias("overrides"))


@query(
    """WITH f AS (SELECT event_id, CASE event_type WHEN 'error' THEN ['urgency', 'threat'] WHEN 'click' THEN ['incentive'] WHEN 'view' THEN ['financial_pretext', 'urgency'] ELSE [] END AS s, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'other' ELSE 'visit_link' END AS a, event_id % 6 = 0 AS coercion FROM events)
SELECT event_id, list_contains(s, 'financial_pretext') AS financial_pretext_present, list_contains(s, 'incentive') AS financial_incentive_present, list_contains(s, 'threat') OR coercion AS threat_or_consequence_present, list_contains(s, 'urgency') AS urgency_present, list_contains(s, 'urgency') AND a NOT IN ('none', 'other') AS urgency_targets_risky_action FROM f"""
)
def derived_signal_booleans(spark, sf_dir):
    t, lit = F.col("event_type"), lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    s = F.when(t == "error", lit("urgency", "threat")).when(t == "click", lit("incentive")).when(t == "view", lit("financial_pretext", "urgency")).otherwise(lit())
    e = read(spark, sf_dir, "events").select("event_id", s.alias("signals"), F.when(F.col("event_id") % 4 == 0, "none").when(F.col("event_id") % 4 == 1, "other").otherwise("visit_link").alias("requested_action"), (F.col("event_id") % 6 == 0).alias("coercion"))
    return policy.derived_signals(e).select("event_id", "financial_pretext_present", "financial_incentive_present", "threat_or_consequence_present", "urgency_present", "urgency_targets_risky_action")
