"""What a message asks for, and through which links and attachments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions.text import evidence_form

# Own patterns for what a sentence asks for.
PATTERNS = {
    "credentials": r"(?i)\b(password|passcode|otp|pin|one-time code|recovery code|credenzial\w+|contraseña|passwort|mot de passe)\b",
    "payment": r"(?i)\b(pay|payment|transfer|wire|invoice|bonifico|pagamento|pago|überweis\w+|virement)\b",
    "payment_request": r"(?i)\b(please|kindly|you (must|need to|have to)|prego di|bitte|veuillez|por favor) (pay|transfer|wire|remit|settle|send (the )?(payment|money)|pagare|versare|überweisen|payer|virer|pagar|transferir)\b|\b(pay|wire|transfer|remit) (now|today|immediately|by \w+|the (amount|sum|balance|invoice)|to (the|this|our))\b",
    "bank_details": r"(?i)\b(iban|bic|swift|account number|bank details|coordinate bancarie|cuenta bancaria|bankverbindung)\b",
    "information_request": r"(?i)\b(send|give|confirm|provide|update|complete|enter|fill in|verify) (us |me )?(your|the) (full )?(details|data|information|address|date of birth|name|documents?|profile|records?)\b|\b(inserisc\w+|fornisc\w+|conferm\w+) (i tuoi|i suoi|le tue) (dati|informazioni)\b",
    "threat": r"(?i)\b(suspend\w*|terminat\w*|legal action|blocked|deactivat\w*|sospes\w+|gesperrt|bloque\w+)\b",
    "urgency": r"(?i)\b(urgent\w*|immediately|within \d+ (hours?|days?)|today|subito|sofort|inmediatamente|immédiatement)\b",
    "reward": r"(?i)\b(prize|reward|gift card|winner|lottery|premio|gewinn)\b",
    "bypass": r"(?i)\b(do not (tell|inform|call)|keep (this|it) (secret|confidential)|skip the (usual )?(procedure|approval))\b",
    "extortion": r"(?i)\b(bitcoin|btc|webcam|recorded you|leak (the|your) (video|data))\b",
    "visit_link": r"(?i)\b(click|tap|follow|open) (here|the link|this link|below)\b|\bclicca qui\b|\bhaga clic\b|\bklicken sie\b",
    "open_attachment": r"(?i)\b(open|see|review|check) (the )?(attach\w+|document|file)\b|\bin allegato\b|\bim anhang\b",
}
#: A line that must not be cut away.
RISK_LINE = "|".join(p.replace("(?i)", "") for p in PATTERNS.values())


def evidence_flags(text: Column, taken: Callable[[str], str] = str) -> dict[str, Column]:
    """Whether each kind of request or pressure is in a text; ``taken`` is how a pattern is read."""
    return {k: F.coalesce(text.rlike(taken(p)), F.lit(False)) for k, p in PATTERNS.items()}


def risk_bearing(line: Column) -> Column:
    return F.coalesce(line.rlike("(?i)" + RISK_LINE), F.lit(False)) | F.coalesce(line.rlike(r"(?i)https?://"), F.lit(False))


def web_actionable(links: DataFrame) -> DataFrame:
    """Web links that act or of which it isn't known."""
    return links.where(F.col("scheme").isin("http", "https") & ~F.col("actionable").eqNullSafe(False))


def of_selected_turn(links: DataFrame, selected: DataFrame, least: int = 4) -> DataFrame:
    """Links whose label of ``least`` characters or more, address or host occurs in the selected text of the message."""
    s = selected.select("msg_id", evidence_form(F.col("text")).alias("_t"))
    hit = (F.length(F.trim("text")) >= least) & F.contains("_t", evidence_form(F.col("text"))) | F.contains("_t", F.lower("url")) | ((F.col("host") != "") & F.contains("_t", F.col("host")))
    return links.join(s, "msg_id").where(hit).drop("_t")


def labels(links: DataFrame, most: int = 8) -> DataFrame:
    """(msg_id, labels): the first ``most`` labels of four characters or more that aren't addresses, each once but for case."""
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    r = links.withColumn("_t", t).where((F.length("_t") >= 4) & ~F.col("_t").rlike(r"(?i)^(https?://|www\.)"))
    one = r.groupBy("msg_id", F.lower("_t").alias("_k")).agg(F.min(F.struct("link_index", "_t")).alias("f"))
    return one.groupBy("msg_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["_t"]), 1, most).alias("labels"))


def destinations(links: DataFrame, most: int = 8, chars: int = 1800) -> DataFrame:
    """(msg_id, observations, omitted): label to host, calls to action first, as long as number and size allow."""
    d = links.where("host <> ''").groupBy("msg_id", F.trim("text").alias("label"), "host").agg(F.max("cta").alias("cta"), F.min("link_index").alias("i"))
    row = F.struct(F.when(F.col("cta"), 0).otherwise(1).alias("o"), "i", "label", "host")
    all_ = d.groupBy("msg_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<struct<label:string,host:string>>").alias("kept"), F.lit(2).alias("size"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        more = acc["size"] + F.length(x["label"]) + F.length(x["host"]) + 25
        fits = ~acc["full"] & (F.size(acc["kept"]) < most) & (more <= chars)
        return F.struct(
            F.when(fits, F.array_append(acc["kept"], F.struct(x["label"].alias("label"), x["host"].alias("host")))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, more).otherwise(acc["size"]).cast("int").alias("size"),
            (acc["full"] | ~fits).alias("full"),
        )

    out = all_.withColumn("_k", F.aggregate("rows", start, step, lambda a: a["kept"]))
    return out.select("msg_id", F.col("_k").alias("observations"), (F.size("rows") - F.size("_k")).alias("omitted"))


def primary_links(links: DataFrame, quotation: str | None = None) -> DataFrame:
    """The links a message is about: calls to action if there are any, of those the ones whose label is in the quotation if any are."""
    own = Window.partitionBy("msg_id")
    a = links.withColumn("_any", F.max("cta").over(own)).where("cta or not _any").drop("_any")
    if quotation is None:
        return a
    named = F.coalesce((F.length(F.trim("text")) >= 4) & F.contains(evidence_form(F.col(quotation)), evidence_form(F.col("text"))), F.lit(False))
    return a.withColumn("_named", named).withColumn("_some", F.max("_named").over(own)).where("_named or not _some").drop("_named", "_some")


def embedded_scrub(m: DataFrame, columns: list[str], scope: str = "scope") -> DataFrame:
    """Delivery facts of an embedded message become null; the originals stay in ``outer_delivery_evidence``."""
    hidden = F.coalesce(F.col(scope) == "embedded_unavailable", F.lit(False))
    out = m.withColumn("outer_delivery_evidence", F.when(hidden, F.struct(*columns)))
    return out.withColumns({c: F.when(~hidden, F.col(c)) for c in columns})


def strongly_authenticated(m: DataFrame) -> DataFrame:
    """authenticated: a verified domain has the registrable domain of the visible sender."""
    return m.withColumn("authenticated", F.coalesce(F.exists("verified_registered", lambda d: d == F.col("from_registered")), F.lit(False)))


def correlated(m: DataFrame) -> DataFrame:
    """requested_action after the message's structure had its say; each step reads the one before, the order is the meaning.

    Reads requested_action, evidence, supplied_channel and the booleans
    has_links, has_attachments, qr_requested, implicit_bank_instruction,
    copy_deception, and the evidence flags of PATTERNS.
    """
    names = ["has_links", "has_attachments", "qr_requested", "implicit_bank_instruction", "copy_deception", *PATTERNS]
    m = m.withColumns({n: F.lit(False) for n in names if n not in m.columns})
    f = lambda n: F.coalesce(F.col(n), F.lit(False))
    a = F.col("requested_action")
    steps = [
        ("qr", f("qr_requested") & a.isin("none", "informational"), "visit_link"),
        ("implicit_bank", f("implicit_bank_instruction"), "pay_or_transfer"),
        ("copy_deception", f("copy_deception") & a.isin("none", "informational", "visit_link", "open_attachment"), "other"),
        ("reward", f("reward") & f("has_links") & a.isin("none", "informational", "visit_link"), "claim_reward"),
        ("payment", f("payment_request") & (f("bank_details") | f("payment")), "pay_or_transfer"),
        ("credential", f("credentials") & f("supplied_channel"), "provide_credentials"),
        ("unsupported_payment", (a == "pay_or_transfer") & ~f("payment") & ~f("bank_details") & ~f("implicit_bank_instruction"), "informational"),
        ("unsupported_credentials", (a == "provide_credentials") & ~f("credentials"), "informational"),
        ("unsupported_information", (a == "provide_information") & ~f("information_request") & ~f("qr_requested"), "informational"),
        ("link_fallback", a.isin("none", "informational") & f("visit_link") & f("has_links"), "visit_link"),
        ("attachment_fallback", a.isin("none", "informational") & f("open_attachment") & f("has_attachments"), "open_attachment"),
        ("link_for_attachment", (a == "open_attachment") & ~f("has_attachments") & f("has_links"), "visit_link"),
        ("no_attachment", (a == "open_attachment") & ~f("has_attachments"), "informational"),
        ("no_link", (a == "visit_link") & ~f("has_links") & ~f("qr_requested"), "informational"),
        ("ungrounded", ~a.isin("none", "informational") & F.col("evidence").isNull() & ~f("payment") & ~f("credentials") & ~f("visit_link") & ~f("open_attachment") & ~f("qr_requested") & ~f("copy_deception") & ~f("implicit_bank_instruction") & ~f("reward"), "informational"),
    ]
    out = m.withColumn("overrides", F.array().cast("array<string>"))
    for name, condition, action in steps:
        c = F.coalesce(condition, F.lit(False))
        out = out.withColumn("_c", c & (F.col("requested_action") != action)).withColumn("overrides", F.when(F.col("_c"), F.array_append("overrides", F.lit(name))).otherwise(F.col("overrides"))).withColumn("requested_action", F.when(F.col("_c"), action).otherwise(F.col("requested_action"))).drop("_c")
    if "action_channel" not in m.columns:
        return out
    # a channel that the message doesn't have is none
    gone = (F.col("action_channel").isin("link", "form") & ~f("has_links")) | ((F.col("action_channel") == "attachment") & ~f("has_attachments"))
    out = out.withColumn("action_channel", F.when(F.coalesce(gone, F.lit(False)), "none").otherwise(F.col("action_channel")))
    return out.withColumn("supplied_channel", F.coalesce(F.col("supplied_channel"), F.lit(False)) & F.col("action_channel").isin("link", "form", "attachment"))


def verifier_gates(m: DataFrame) -> DataFrame:
    """Which second looks a message needs, given what the first one said."""
    f = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in m.columns else F.lit(False)
    vague = F.col("requested_action").isin("none", "other", "informational")
    return m.withColumns(
        {
            "needs_intent": vague & (f("credentials") | f("payment") | f("visit_link")),
            "needs_payment_diversion": (F.col("requested_action") == "pay_or_transfer") & f("bank_details"),
            "needs_security_lure": f("threat") & f("supplied_channel"),
            "needs_extortion": f("extortion") | (f("threat") & f("payment")),
            "needs_content_risk": F.coalesce(F.col("risk_assessment") != "legitimate", F.lit(False)) if "risk_assessment" in m.columns else F.lit(False),
        }
    )


def threat_labels(m: DataFrame, most: int = 3) -> Column:
    """At most three labels of what makes a message dangerous, the worst first."""
    f = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in m.columns else F.lit(False)
    order = [("Extortion", "extortion"), ("Credential theft", "credentials"), ("Payment diversion", "bank_details"), ("Fake reward", "reward"), ("Procedure bypass", "bypass"), ("Threat", "threat"), ("Urgency", "urgency")]
    return F.slice(F.array_compact(F.array(*(F.when(f(c), n) for n, c in order))), 1, most)


def summary(action: Column, channel: Column, risk: Column) -> Column:
    """Plain sentences from the final enums."""
    asks = F.when(action.isin("none", "informational"), "The message asks for nothing.").otherwise(F.concat(F.lit("The message asks the reader to "), F.replace(action, F.lit("_"), F.lit(" ")), F.lit(".")))
    through = F.when(channel.isin("link", "form", "attachment", "reply", "phone"), F.concat(F.lit("It offers a "), channel, F.lit(" for that.")))
    grade = F.when(risk == "malicious", "Its content is dangerous.").when(risk == "suspicious", "Its content needs checking.")
    return F.array_join(F.array_compact(F.array(asks, F.when(~action.isin("none", "informational"), through), grade)), " ")
