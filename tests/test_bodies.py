from __future__ import annotations

from pyspark.sql import functions as F

from mailquarry import sinks
from mailquarry.functions import unicode as un
from mailquarry.operators import actions, body, policy


def test_repeats_chunks_tails():
    block = "\n".join(f"line number {k} with enough words to be counted as a real one {k}" for k in range(12))
    text = f"start\n{block}\nmiddle\n{block}\nend"
    assert body.without_repeats(text) == f"start\n{block}\nmiddle\nend"
    assert body.without_repeats("a\nb\nc\na\nb\nc") == "a\nb\nc\na\nb\nc" and body.without_repeats(None) is None
    long = ("Sentence number one is here. " * 200).strip()
    parts = body.chunks(long, 500, 50)
    assert all(len(p) <= 500 for p in parts) and long.startswith(parts[0]) and long.endswith(parts[-1])
    assert all(a[-20:] in b + a for a, b in zip(parts, parts[1:], strict=False)) and body.chunks("", 10, 2) == []
    assert body.trimmed_tail("Hello\nplease pay\nBest regards\nAnn\nACME\nThis message is confidential") == "Hello\nplease pay"
    assert body.trimmed_tail("Hello\nKind regards\nAnn\nphone") == "Hello\nKind regards\nAnn"
    assert body.instruction_segments('He said "send the money now". Please call me today.')[-1] == "Please call me today."


def test_selection(spark):
    text = "FYI\n\n---------- Forwarded message ----------\nFrom: E <e@x.test>\nDate: d\nSubject: s\n\nPay the invoice today please\n"
    rows = spark.createDataFrame([("a", text), ("b", "Just text"), ("c", None), ("d", "ok\n\nOn Monday Bob <b@x.test> wrote:\n> old")], "id string, t string")
    got = {r.id: r.s for r in rows.select("id", body.select_body("t").alias("s")).collect()}
    assert (got["a"].mode, got["b"].mode, got["c"].body, got["d"].mode, got["d"].body) == ("forwarded", "normal", "", "reply", "ok")
    assert "Pay the invoice" in got["a"].body


def test_noise_and_boundaries(spark):
    lines = [("m", k, "A" * 600) for k in range(1, 9)] + [("m", 0, "hello"), ("m", 9, "bye"), ("n", 0, "B" * 600)]
    df = spark.createDataFrame(lines, "id string, position int, line string")
    assert {(r.id, r.position) for r in body.without_noise(df, ["id"]).collect()} == {("m", 0), ("m", 9), ("n", 0)}
    t = spark.createDataFrame([("m", k, "---" if k % 2 else "x") for k in range(8)], "id string, position int, line string")
    assert sorted(r.position for r in body.until_boundaries(t, ["id"], F.col("line") == "---").collect()) == [0, 1, 2, 3, 4]


def links(spark):
    rows = [("m", 0, "https://a.test/x", "Pay now", "a.test", True, "https", True), ("m", 1, "https://b.test", "Read", "b.test", False, "https", None), ("m", 2, "mailto:x@y.test", "Mail", "", False, "mailto", True), ("n", 0, "https://c.test", "https://c.test", "c.test", False, "https", False), ("n", 1, "https://d.test", "Look here", "d.test", False, "https", True)]
    return spark.createDataFrame(rows, "msg_id string, link_index int, url string, text string, host string, cta boolean, scheme string, actionable boolean")


def test_link_choices(spark):
    df = links(spark)
    assert {(r.msg_id, r.link_index) for r in actions.web_actionable(df).collect()} == {("m", 0), ("m", 1), ("n", 1)}
    assert {(r.msg_id, r.link_index) for r in actions.primary_links(df).collect()} == {("m", 0), ("n", 0), ("n", 1)}
    quoted = df.withColumn("q", F.lit("please LOOK  here"))
    assert {(r.msg_id, r.link_index) for r in actions.primary_links(quoted, "q").collect()} == {("m", 0), ("n", 1)}
    assert {r.msg_id: r.labels for r in actions.labels(df).collect()} == {"m": ["Pay now", "Read", "Mail"], "n": ["Look here"]}
    d = {r.msg_id: ([(o.label, o.host) for o in r.observations], r.omitted) for r in actions.destinations(df, most=1).collect()}
    assert d["m"] == ([("Pay now", "a.test")], 1)
    sel = spark.createDataFrame([("m", "Please pay now at once"), ("n", "see c.test")], "msg_id string, text string")
    assert {(r.msg_id, r.link_index) for r in actions.of_selected_turn(df, sel).collect()} == {("m", 0), ("n", 0)}


def test_correlation_order(spark):
    rows = [("a", "none", None, True, False, "click here"), ("b", "pay_or_transfer", "x", False, False, "nothing"), ("c", "informational", None, True, True, "your password please"), ("d", "none", None, True, False, "you won a prize, click here")]
    df = spark.createDataFrame(rows, "msg_id string, requested_action string, evidence string, has_links boolean, supplied_channel boolean, text string")
    df = df.withColumns(actions.evidence_flags(F.col("text")))
    got = {r.msg_id: (r.requested_action, r.overrides) for r in actions.correlated(df).collect()}
    assert got == {"a": ("visit_link", ["link_fallback"]), "b": ("informational", ["unsupported_payment"]), "c": ("provide_credentials", ["credential"]), "d": ("claim_reward", ["reward"])}
    gates = {r.msg_id: r for r in actions.verifier_gates(df).collect()}
    assert gates["a"].needs_intent and gates["c"].needs_intent and not gates["b"].needs_intent
    assert df.where("msg_id = 'd'").select(actions.threat_labels(df).alias("t")).first().t == ["Fake reward"]
    assert df.limit(1).select(actions.summary(F.lit("pay_or_transfer"), F.lit("link"), F.lit("malicious")).alias("s")).first().s == "The message asks the reader to pay or transfer. It offers a link for that. Its content is dangerous."


def test_scrub_and_signature(spark):
    df = spark.createDataFrame([("a", "embedded_unavailable", "x"), ("b", "outer", "y")], "msg_id string, scope string, reply_to string")
    got = {r.msg_id: (r.reply_to, r.outer_delivery_evidence and r.outer_delivery_evidence.reply_to) for r in actions.embedded_scrub(df, ["reply_to"]).collect()}
    assert got == {"a": (None, "x"), "b": ("y", None)}
    auth = spark.createDataFrame([(["a.test"], "a.test"), (None, "a.test"), ([], "a.test")], "verified_registered array<string>, from_registered string")
    assert [r.authenticated for r in actions.strongly_authenticated(auth).collect()] == [True, False, False]
    assert [spark.range(1).select(policy.worst_risk(F.lit(x)).alias("r")).first().r for x in ("clean", None, "CRITICAL")] == [0, 2, 5]


def test_unicode():
    assert un.plain_form("ﬁ​ne ṕay️") == "fine ṕay" and un.plain_form(None) is None
    assert un.ascii_host("BÜcher.example.") == "xn--bcher-kva.example" and un.ascii_host("a..b") is None and un.ascii_host("[2001:DB8::1]") == "2001:db8::1"
    assert un.shown_host("xn--bcher-kva.example") == "bücher.example"
    assert un.mixed_script("pаypal.test") and not un.mixed_script("paypal.test")
    assert (un.public_ip("8.8.8.8"), un.public_ip("10.0.0.1"), un.public_ip("x")) == (True, False, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", b"x", [("f", b"y")])], "id string, raw binary, parts array<struct<name:string,payload:binary>>")
    sinks.write_reports(df, f"file://{tmp_path}/r")
    assert spark.read.text(f"file://{tmp_path}/r").first().value == '{"id":"m","parts":[{"name":"f"}]}'
    raw = ("Subject: a\r\n\r\n" + ("A" * 76 + "\r\n") * 5 + "end").encode()
    one = spark.createDataFrame([(raw,)], "c binary").select(sinks.redacted_preview(F.col("c")).alias("p")).first().p
    assert "removed" in one and "AAAA" not in one and one.endswith("end")
    t = spark.createDataFrame([("a@b.test DE89370400440532013000",), ("DE89370400440532013000 DE00370400440532013000",)], "text string")
    r = sinks.privacy_audit(t).first()
    assert (r.rows, r.with_mail, r.accounts, r.valid_accounts) == (2, 1, 2, 1)
