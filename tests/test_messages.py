from __future__ import annotations

import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailquarry.operators import attachments as at
from mailquarry.operators import auth, conversation, envelope, html, payments
from mailquarry.sources import eml


def raw_message(headers: list[tuple[str, str]], body: str = "hello", html_body: str | None = None, files=()) -> bytes:
    m = EmailMessage()
    for k, v in headers:
        m[k] = v
    m.set_content(body)
    if html_body:
        m.add_alternative(html_body, subtype="html")
    for name, kind, data in files:
        a, b = kind.split("/")
        m.add_attachment(data, maintype=a, subtype=b, filename=name)
    return bytes(m)


BASE = [("From", "Ann <ann@shop.example>"), ("To", "bob@office.example"), ("Subject", "Order"), ("Message-ID", "<1@shop.example>")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("mail")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("run.exe", b"MZ..")
        f.writestr("../up.txt", b"x")
    auth_headers = [
        ("Received", "from relay.example (relay.example [203.0.113.9]) by mx.office.example with ESMTPS (TLSv1.3 cipher=X) for <bob@office.example>; Mon, 01 Jan 2024 10:00:05 +0000"),
        ("Received", "from origin.example ([8.8.8.8]) by relay.example; Mon, 01 Jan 2024 11:00:00 +0100"),
        ("Authentication-Results", "mx.office.example; spf=pass smtp.mailfrom=shop.example; dkim=fail header.d=shop.example; dkim=pass header.d=other.example; dmarc=none"),
        ("Authentication-Results", "second.example; spf=fail smtp.mailfrom=shop.example"),
        ("Received-SPF", "softfail (x) client-ip=8.8.8.8; envelope-from=a@shop.example"),
        ("ARC-Authentication-Results", "i=1; relay.example; spf=neutral smtp.mailfrom=shop.example"),
        ("ARC-Authentication-Results", "i=2; mx.office.example; arc=pass; spf=fail smtp.mailfrom=relay.example"),
    ]
    body = '<a class="btn" href="https://pay.example/go?url=https%3A%2F%2Fevil.test%2Fx.exe">https://bank.example</a><p style="display:none">secret</p><form action="https://evil.test/in"><input type="password" name="pwd"></form><footer><a href="https://shop.example/u">unsubscribe</a></footer>'
    (d / "a.eml").write_bytes(raw_message(BASE + auth_headers, "see https://pay.example/path.", body, [("invoice.pdf.exe", "application/octet-stream", b"MZ\x90"), ("pack.zip", "application/zip", z.getvalue())]))
    (d / "b.EML").write_bytes(b"junk line\nFrom: x@y.example\nSubject: hi\nno separator\n")
    (d / "c.eml").write_bytes(b"\n\n")
    (d / "note.txt").write_bytes(b"not mail")
    return f"file://{d}"


@pytest.fixture(scope="module")
def messages(spark, folder):
    return eml.read_folder(spark, folder).cache()


def test_folder_and_rejects(messages):
    got = {r.path.rsplit("/", 1)[1]: r for r in messages.collect()}
    assert set(got) == {"a.eml", "b.EML", "c.eml"}
    assert got["c.eml"].reject_reason == "no_headers" and got["a.eml"].reject_reason is None
    assert {x.name for x in got["b.EML"].repairs} == {"leading_lines_removed", "separator_added"}
    assert [r.reject_reason for r in eml.rejects(messages).collect()] == ["no_headers"]
    row = eml.six_columns(eml.accepted(messages)).where("subject = 'Order'").first()
    assert row.sender == "Ann <ann@shop.example>" and row.body.startswith("see https")


def test_decoding_cascade_and_utf7():
    assert eml.decoded("é".encode("latin-1"), "utf-8") == "é" and eml.decoded(b"\x81", None) == "\x81"
    page = "<html><body><p>a</p><p>b</p></body></html>".encode("utf-7").decode()
    assert eml.recovered_utf7(page + "+AGE-+AGI-+AGM-+AGQ-").startswith("<html>") and eml.recovered_utf7("1+1") == "1+1"


def test_envelope(messages):
    r = envelope.envelope(eml.accepted(messages)).where("subject = 'Order'").first()
    assert (r.from_address, r.from_domain, r.from_ambiguous, r.is_bulk_sender, r.reply_to_mismatch) == ("ann@shop.example", "shop.example", False, False, False)


def test_auth_precedence_and_hops(messages):
    m = eml.accepted(messages)
    items = auth.items(m)
    plain = {r.protocol: (r.status, r.source) for r in auth.effective_results(items).collect()}
    assert plain == {"SPF": ("pass", "direct"), "DKIM": ("fail", "direct"), "DMARC": ("none", "direct")}
    arc = {r.protocol: r for r in auth.effective_results(items, auth.arc_passed(m)).collect()}
    assert (arc["SPF"].status, arc["SPF"].delivery_status, arc["SPF"].path_conflict, arc["SPF"].source) == ("neutral", "pass", True, "arc")
    route = auth.hops(m)
    assert [(r.header_index, r.from_host, r.sender_ip) for r in route.orderBy("route_index").collect()] == [(1, "origin.example", "8.8.8.8"), (0, "relay.example", "203.0.113.9")]
    assert [r.injection_ip for r in auth.injection_ip(items, route).collect()] == ["8.8.8.8"]
    points = auth.checkpoints(items, route)
    assert [r.route_index for r in points.where("source = 'received_spf'").collect()] == [0]
    assert [r.spf_authorised for r in auth.injection_authorised(points, auth.injection_ip(items, route)).collect()] == [False]


def test_links_forms_text(spark, messages):
    m = eml.accepted(messages).where("body_html is not null").select("msg_id", F.col("body_html").alias("html"), F.col("body_plain").alias("text"))
    rows = {r.url: r for r in html.extract_links(m).collect()}
    pay = next(r for u, r in rows.items() if "go?url" in u)
    assert pay.cta and pay.display_mismatch and pay.redirect_targets == ["https://evil.test/x.exe"] and pay.actionable
    assert rows["https://shop.example/u"].role == "footer" and "https://pay.example/path" in rows
    one = m.select(html.visible_text("html").alias("t"), html.html_forms("html").alias("f")).first()
    assert "secret" not in one.t and "https://bank.example" in one.t
    assert (one.f[0].risk, one.f[0].action_kind) == ("high", "external")
    assert html.overlays_of('<div style="position:absolute;color:transparent">\\\\evil.test\\x</div>')[0]["severity"] == "high"


def test_attachments(messages):
    rows = {r.filename: r for r in at.attachments(eml.accepted(messages)).collect()}
    exe = rows["invoice.pdf.exe"]
    assert {f.key for f in exe.findings} == {"double_extension", "dangerous_extension"} and exe.risk_level == "high" and exe.magic_format == "exe" and exe.extension_match
    scan = at.attachments(eml.accepted(messages)).where("ext = 'zip'").select(at.archive_scan("payload").alias("s")).first().s
    assert {f.key for f in scan.findings} == {"dangerous_member", "path_traversal"} and scan.complete and scan.entries == 2
    assert at.archive_findings(b"PK\x03\x04 broken")[2] is False


def test_archive_limits():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("big.bin", b"\0" * 200_000)
    found, _, complete = at.archive_findings(z.getvalue())
    assert found[0][0] == "compression_bomb" and not complete


def test_calendar():
    e = at.calendar_events("BEGIN:VEVENT\r\nSUMMARY:Meet\\, now\r\nORGANIZER;CN=x:mailto:Eve@Evil.test\r\nDESCRIPTION:go https://evil.te\r\n st/x\r\nATTENDEE:a\r\nEND:VEVENT")
    assert e == [{"organizer": "eve@evil.test", "summary": "Meet, now", "attendees": 1, "links": ["https://evil.test/x"]}]


def test_conversation(spark):
    text = "Please pay by bank account.\n\n---------- Forwarded message ----------\nFrom: Eve <eve@evil.test>\nDate: today\nSubject: IBAN\n\nSend your password, proof of payment and IBAN\n\nOn Monday Bob <bob@office.example> wrote:\n> all fine\n"
    segs = conversation.segments(spark.createDataFrame([("m", text), ("n", None)], "msg_id string, body string"))
    rows = segs.where("msg_id = 'm'").orderBy("position").collect()
    assert [(r.kind, r.address, r.recommended_role) for r in rows] == [("outer", "", "context"), ("forwarded", "eve@evil.test", "target"), ("quoted", "bob@office.example", "context")]
    assert rows[2].text == "all fine" and "text" not in conversation.manifest(segs).schema["segments"].dataType.elementType.names
    assert segs.where("msg_id = 'n'").count() == 1


def test_ibans(spark):
    good = "DE89 3704 0044 0532 0130 00"
    assert payments.ibans_of(f"pay {good} today") == ["DE89370400440532013000"]
    for k in range(4, 22):
        bad = "DE89370400440532013000"
        bad = bad[:k] + str((int(bad[k]) + 1) % 10) + bad[k + 1 :]
        assert payments.ibans_of(bad) == []
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    df = spark.range(1).select(
        payments.payment_level(a("DE1"), a("DE2"), a(), F.lit(False), F.lit("DE")).alias("thread"),
        payments.payment_level(a("DE1"), a(), a(), F.lit(True), F.lit("DE")).alias("change"),
        payments.payment_level(a("FR1"), a(), a(), F.lit(True), F.lit("DE")).alias("foreign_change"),
        payments.payment_level(a("FR1"), a(), a(), F.lit(False), F.lit("DE")).alias("foreign"),
        payments.payment_level(a("DE1"), a(), a(), F.lit(False), F.lit("DE")).alias("plain"),
    )
    assert tuple(df.first()) == ("HIGH", "MEDIUM", "HIGH", "LOW", None)


def test_payment_memory_is_idempotent(spark):
    memory = spark.createDataFrame([("s", "d1", "m1", "2024-01-01"), ("s", "d2", "m2", "2024-01-05"), ("t", "d9", "m8", "2010-01-01")], "sender string, digest string, msg_id string, seen string").withColumn("seen_at", F.to_timestamp("seen"))
    uses = spark.createDataFrame([("s", "d2", "m2", True), ("s", "d3", "m3", False), ("s", "d1", "m4", True), ("t", "d7", "m5", True)], "sender string, digest string, msg_id string, change_phrase boolean")
    got = {(r.digest, r.msg_id): r.level for r in payments.remembered(uses, memory, F.to_timestamp(F.lit("2024-02-01"))).collect()}
    assert got == {("d2", "m2"): "HIGH", ("d3", "m3"): "MEDIUM"}


def test_reply_rules(spark):
    rows = [("a@x.example", "", 1, None, False, False, False), ("a@x.example", "b@y.test", 1, "b@y.test", False, False, False), ("a@x.example", "b@x.example", 1, "b@x.example", True, True, True)]
    df = spark.createDataFrame(rows, "from_address string, reply_address string, from_count int, reply_to string, same_registered boolean, authenticated boolean, is_bulk_sender boolean")
    assert [r.reply_level for r in envelope.reply_routing(df).collect()] == ["NONE", "HIGH", "INFO"]
    t = spark.createDataFrame([("Re: x", None, None, 0, 0), ("Re: x", "<1>", None, 0, 0), ("Hello", None, None, 0, 2), ("AW: x", None, None, 0, 1)], "subject string, in_reply_to string, references string, quoted_recipient int, quoted_other int")
    assert [r.threading_level for r in envelope.reply_threading(t).collect()] == ["MEDIUM", "NONE", "NONE", "MEDIUM"]
    assert [r.threading_level for r in envelope.reply_threading(t.withColumns({"quoted_recipient": F.lit(1)})).collect()] == ["HIGH", "NONE", "NONE", "HIGH"]
    assert [r.threading_level for r in envelope.reply_threading(t.withColumns({"is_bulk_sender": F.lit(True)})).collect()] == ["LOW", "NONE", "NONE", "MEDIUM"]


def test_messages_are_parsed_once_and_go_on_together(spark, tiny):
    import pyarrow as pa

    from mailquarry.plans import mail_queries

    raw = [b"From: a@b.test\r\n\r\nx", b"", None, b"From: c@d.test\r\n\r\ny"]
    batch = pa.RecordBatch.from_pydict({"path": list("abcd"), "content": pa.array(raw, pa.binary())})
    out = list(eml._rows([batch, batch]))
    assert len(out) == 1 and out[0].column(0).to_pylist() == list("abcdabcd")
    files = mail_queries.mail_attachments(spark, tiny)
    assert files._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert mail_queries._files(spark, tiny).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_results_of_a_row_are_those_of_the_tables(spark):
    own = "Authentication-Results: mx.test; spf=pass smtp.mailfrom=a.test; dkim=fail header.d=a.test; dkim=none; dmarc=pass header.from=a.test"
    arc = "ARC-Authentication-Results: i={}; mx.test; spf={} smtp.mailfrom=x@b.test client-ip={}; arc={}"
    spf = "Received-SPF: {} client-ip={}; envelope-from=x@c.test"
    hop = "Received: from h{} ([{}]) by mx.test; {}"
    day, none = "Mon, 01 Jan 2024 1{}:00:00 +0100", "some day"
    heads = [
        [own, hop.format(1, "203.0.113.9", day.format(2)), hop.format(2, "8.8.8.8", day.format(1))],
        [own, hop.format(1, "203.0.113.9", day.format(1)), hop.format(2, "8.8.8.8", day.format(2)), hop.format(3, "x", none)],
        [own, own.replace("pass", "fail"), arc.format(2, "neutral", "9.9.9.9", "pass"), arc.format(1, "fail", "8.8.4.4", "none")],
        [arc.format(2, "neutral", "9.9.9.9", "fail"), arc.format(1, "pass", "9.9.9.9", "pass"), hop.format(1, "10.0.0.1", none)],
        [own, spf.format("Fail", "8.8.8.8"), spf.format("Pass", "8.8.8.8"), spf.format("Pass", "9.9.9.9")],
        [spf.format("Pass", "9.9.9.9"), arc.format(1, "pass", "9.9.9.9", "pass")],
        [hop.format(1, "203.0.113.9", day.format(1)), hop.format(2, "8.8.8.8", day.format(1))],
        ["Subject: nothing"],
    ]
    rows = [(str(k), "\r\n".join(["From: a@a.test", *h, "", "x"]).encode()) for k, h in enumerate(heads)]
    m = eml.parse(spark.createDataFrame(rows, "path string, content binary")).localCheckpoint()
    items, route = auth.items(m), auth.hops(m)
    eff, ip = auth.effective_results(items, auth.arc_passed(m)).localCheckpoint(), auth.injection_ip(items, route)
    status = eff.groupBy("msg_id").agg(*(F.max(F.when(F.col("protocol") == p, F.col("status"))).alias(p.lower()) for p in ("SPF", "DKIM", "DMARC")), F.bool_or((F.col("protocol") == "SPF") & F.col("path_conflict")).alias("spf_conflict"), F.bool_or((F.col("protocol") == "DMARC") & (F.col("source") == "direct")).alias("dmarc_direct"))
    passed = eff.where("protocol = 'SPF' and status = 'pass'").select("msg_id", F.lower(F.regexp_extract("identity", r"([^@]*)$", 1)).alias("spf_domain"))
    want = m.select("msg_id", "path").join(status, "msg_id", "left").join(passed, "msg_id", "left").join(ip, "msg_id", "left").join(auth.injection_authorised(auth.checkpoints(items, route), ip), "msg_id", "left")
    names = ["path", "spf", "dkim", "dmarc", "spf_conflict", "dmarc_direct", "spf_domain", "injection_ip", "spf_authorised"]
    got = {r.path: tuple(r) for r in auth.message_results(m).select(*names).collect()}
    assert got == {r.path: tuple(r) for r in want.select(*names).collect()} and len(got) == len(heads)
    assert [got[k][1] for k in ("0", "2", "3", "7")] == ["pass", "fail", "neutral", None] and got["4"][-1] is True and got["1"][-2] == "8.8.8.8"
    assert auth.clauses("from a (x (from y) z) by b) with c (open by d") == {"from": "a", "by": "b", "with": "c"}


def test_verdicts_parse_messages_once(spark, tiny):
    from mailquarry.plans import mail_queries

    out = mail_queries.mail_verdicts(spark, tiny)
    assert "MapInArrow" not in out._jdf.queryExecution().analyzed().toString()  # no message is parsed again for its id
    assert out.count() == spark.read.parquet(f"{tiny}/customer.parquet").count()
